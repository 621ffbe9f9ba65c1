"""Application forms: labelled values, owner, address, dates and contacts of texts (doc_id, raw_text, filename).

Only lines that hold a label, a section's heading or a word of a date become rows; each brings the five lines below it,
cut from the text's array of lines inside the row, so texts are split once and never shuffled. Sections, the address block
and the signature block are windows over a document's rows; a field is the least (label, line) whose value it accepts.

A null or empty text has no fields. A date that the calendar doesn't have is none. Social security numbers leave masked.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

OWNER_REACH, ADDRESS_LINES, SIGNED_LINES = 15, 18, 60


def form_lines(value: Column) -> Column:
    """The lines of a form without the white space around them, without empty ones."""
    return F.filter(F.transform(F.split(T.text_of(value), r"\n+"), lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")), lambda x: x != "")


def bounded(value: Column) -> Column:
    """A field's value up to the next field on its line, without a colon at its end."""
    return F.trim(F.regexp_replace(T.clean_space(F.regexp_extract(T.text_of(value), L.BOUNDED, 1)), r"\s*:\s*$", ""))


def looks_like_label(value: Column) -> Column:
    """Whether a value is a field's label: empty, with a colon at its end or two, or of nothing but words of labels."""

    def read(v: Column) -> Column:
        words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(v), r"[():,]", " "), r"\s+"), lambda w: w != ""))
        only = T.let(words, lambda some: (F.size(some) > 0) & (F.size(F.array_except(some, F.split(F.lit(" ".join(L.LABEL_WORDS)), " "))) == 0))
        return (v == "") | v.rlike(r":\s*$") | v.rlike(":.*:") | only

    return T.let(T.clean_space(value), read)


def clean_company(value: Column) -> Column:
    v = F.trim(F.regexp_replace(F.regexp_replace(T.clean_space(value), L.COMPANY_PREFIX, ""), r"[^A-Za-z0-9&.,'\- /]", ""))
    return F.when(v.rlike("[A-Za-z]{3}"), F.substring(v, 1, 90))


def company_of(value: Column) -> Column:
    """A company's name, cut at the next field that follows without a colon; null if that is a label."""
    name = clean_company(F.regexp_extract(value, L.COMPANY_BOUNDED, 1))
    return T.let(name, lambda n: F.when(n.isNotNull() & ~looks_like_label(n), n))


def person(value: Column) -> Column:
    """A person's name of two to five words; null for labels and for words that are no person's."""
    v = F.trim(F.regexp_replace(T.clean_space(F.regexp_replace(T.text_of(value), L.OWNER_PREFIX, "")), r"\s*:\s*$", ""))
    return T.let(v, lambda n: F.when(n.rlike(L.PERSON) & ~n.rlike(L.NOT_A_PERSON) & ~looks_like_label(n), n))


def short_date(value: Column, this_year: int) -> Column:
    """mm/dd/yy of a date of birth; null for one without its year or out of 1900 to this year."""

    def read(v: Column) -> Column:
        def part(pattern: str, no: int) -> Column:
            return F.lpad(F.regexp_extract(v, pattern, no), 2, "0")

        vague = v.rlike(r"\b[A-Za-z]{3,9},?\s+\d{1,2},?\s+\d{2}\b") & ~v.rlike(r"\b(?:19|20)\d{2}\b")
        return (
            F.when((v == "") | vague, None)
            .when(v.rlike(L.YEAR_DATE), F.concat(part(L.YEAR_DATE, 2), F.lit("/"), part(L.YEAR_DATE, 3), F.lit("/"), F.right(F.regexp_extract(v, L.YEAR_DATE, 1), F.lit(2))))
            .when(v.rlike(L.NUMBER_DATE), F.concat(part(L.NUMBER_DATE, 1), F.lit("/"), part(L.NUMBER_DATE, 2), F.lit("/"), F.right(F.regexp_extract(v, L.NUMBER_DATE, 3), F.lit(2))))
            .otherwise(T.let(T.parse_date(v), lambda d: F.when(F.year(d).between(1900, this_year), F.date_format(d, "MM/dd/yy"))))
        )

    return T.let(bounded(F.regexp_replace(T.text_of(value), r"\s+0:00:00\b", "")), read)


def long_date(value: Column) -> Column:
    """mm/dd/yyyy of a date, with or without its day's name."""

    def read(v: Column) -> Column:
        year, month, day = (F.regexp_extract(v, L.YEAR_DATE, i) for i in (1, 2, 3))
        plain = F.date_format(T.parse_date(F.regexp_replace(v, L.DAY_NAME, "")), "MM/dd/yyyy")
        return F.when(v.rlike(L.YEAR_DATE), F.concat(F.lpad(month, 2, "0"), F.lit("/"), F.lpad(day, 2, "0"), F.lit("/"), year)).otherwise(plain)

    return T.let(bounded(F.regexp_replace(T.text_of(value), r"\s+0:00:00\b", "")), read)


def date_beside(rest: Column, below: Column, read) -> Column:
    """The date after a label: on its line (a year may stand on one of the five below), else on the first of the three lines below
    that has one, before a line of another field."""

    def same(v: Column) -> Column:
        year = F.get(F.filter(F.transform(below, lambda x: F.regexp_extract(T.text_of(x), r"\b((?:19|20)\d{2})\b", 1)), lambda y: y != ""), F.lit(0))
        lacks = v.rlike(L.MONTH_DAY) & ~v.rlike(r"\b(?:19|20)\d{2}\b")
        return F.when(v != "", read(F.when(lacks, F.concat_ws(" ", v, year)).otherwise(v)))

    def under(lines: Column) -> Column:
        other = F.get(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(lines, i).rlike(L.OTHER_FIELD), F.lit(False))), F.lit(0))
        dates = F.transform(lines, lambda x, i: F.when((x != "") & (i < F.coalesce(other, F.lit(3))), read(x)))
        return F.get(F.array_compact(dates), F.lit(0))

    return F.coalesce(T.let(bounded(rest), same), T.let(F.transform(F.slice(below, 1, 3), bounded), under))


def signed_date(rest: Column, below: Column, room: Column) -> Column:
    """The date of a signature: after the label, else on the first of the two lines below that has one (within `room` lines), before a line
    of another kind of date."""

    def under(lines: Column) -> Column:
        other = F.get(F.filter(F.sequence(F.lit(0), F.lit(1)), lambda i: F.coalesce(F.get(lines, i).rlike(L.OTHER_DATE), F.lit(False))), F.lit(0))
        return F.get(F.array_compact(F.transform(lines, lambda x, i: F.when((i < F.coalesce(other, F.lit(2))) & (i < room), long_date(x)))), F.lit(0))

    return F.coalesce(long_date(bounded(rest)), T.let(F.slice(below, 1, 2), under))


def label_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, below (the five lines after it) and of its document section (the last owner heading's line up to it),
    address_at and signed_at (the first lines of those blocks, 0 if there is none): the lines that can tell a field."""

    def tells(low: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [low.contains(x) for x in L.FORM_WORDS])

    def near(lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: F.coalesce(T.let(F.lower(F.get(lines, i)), tells), F.lit(False)))
        return F.transform(at, lambda i: F.struct(i.alias("line_no"), F.get(lines, i).alias("line"), F.slice(lines, i + 2, F.lit(5)).alias("below")))

    w = Window.partitionBy("doc_id")
    upto = w.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = docs.select("doc_id", F.explode(T.let(form_lines(F.col("raw_text")), near)).alias("x")).select("doc_id", "x.*")

    def first(condition: Column) -> Column:
        return F.coalesce(F.min(F.when(condition, F.col("line_no"))).over(w), F.lit(0))

    return d.withColumns({
        "section": F.last(F.when(F.col("line").rlike(L.OWNER_SECTION), F.col("line_no")), ignorenulls=True).over(upto),
        "address_at": first(F.lower("line").contains("business address")), "signed_at": first(F.col("line").rlike(L.AUTHORISATION)),
    })


def labelled_values(docs: DataFrame, this_year: int = 2026) -> DataFrame:
    """doc_id, company, owner, address, dob (mm/dd/yy), start_date and app_date (mm/dd/yyyy) of forms (doc_id, raw_text)."""
    c = F.col
    known = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("no"), F.lit(x.lower()).alias("low")) for f, some in L.FORM_LABELS.items() for i, x in enumerate(some)])
    rows = label_rows(docs).withColumn("low", F.lower("line"))
    names = rows.where(c("low").rlike(r"^name\b") & ~c("low").rlike(r"^name\s*of"))
    told = F.regexp_extract("line", r"(?i)^name\s*:?\s*(.*)$", 1)
    names = names.withColumn("v", F.coalesce(person(told), F.when(told == "", person(F.get("below", F.lit(0))))))
    near = F.coalesce(c("line_no") <= c("section") + OWNER_REACH, F.lit(False)) | F.forall(F.split("v", " "), lambda w: w.rlike("^[A-Z]"))
    none = F.lit(None).cast("string")
    names = names.where(c("v").isNotNull() & near).select("doc_id", F.lit("name").alias("field"), F.lit(0).alias("no"), c("line_no").cast("int").alias("line_no"), "v", none.alias("line"))

    hits = rows.withColumn("k", F.explode(F.filter(known, lambda k: F.contains(c("low"), k["low"]))))
    at, field = F.instr(c("low"), c("k.low")), c("k.field")
    hits = hits.withColumn("rest", F.regexp_replace(F.substring(c("line"), at + F.length("k.low"), F.length("line")), r"^[\s:#\-|]+", ""))
    begins = (at == 1) | ~F.substring(c("low"), at - 1, F.lit(1)).rlike("[a-z0-9]")
    answers = F.struct(T.clean_space(F.regexp_extract("rest", L.BOUNDED, 1)).alias("beside"), T.clean_space(F.get("below", F.lit(0))).alias("under"))
    answer = T.let(answers, lambda a: F.when(~looks_like_label(a["beside"]), bounded(a["beside"])).when(~a["under"].contains(":") & ~looks_like_label(a["under"]), bounded(a["under"])))
    named = field.isin("company", "owner") & begins
    in_block = (c("line_no") >= c("address_at")) & (c("line_no") < c("address_at") + ADDRESS_LINES)
    in_signed = (c("line_no") >= c("signed_at")) & (c("line_no") < c("signed_at") + SIGNED_LINES) & ~c("low").rlike(L.OTHER_DATE)
    name = T.let(answer, lambda a: F.when(field == "company", company_of(a)).otherwise(person(a)))
    value = (
        F.when(named, name).when(field.isin("company", "owner"), None)
        .when(field == "dob", date_beside(c("rest"), c("below"), lambda v: short_date(v, this_year))).when(field == "start_date", date_beside(c("rest"), c("below"), long_date))
        .when(field == "app_date", F.when(in_signed, signed_date(c("rest"), c("below"), c("signed_at") + SIGNED_LINES - 1 - c("line_no"))))
        .when(field.isin("city", "state", "zip"), F.when(in_block, c("rest"))).otherwise(c("rest"))
    )
    hits = hits.select("doc_id", field.alias("field"), c("k.no").alias("no"), c("line_no").cast("int").alias("line_no"), value.alias("v"), F.when(field == "address", c("line")).alias("line")).where("v is not null")

    def least(name: str, *order: str, of: str = "v") -> Column:
        return F.min_by(of, F.when(c("field") == name, F.struct(*order)))

    by_label, by_line = ("no", "line_no"), ("line_no", "no")
    g = hits.unionByName(names).groupBy("doc_id").agg(
        *[least(x, *by_label).alias(x) for x in ("company", "owner")], *[least(x, *by_line).alias(x) for x in ("dob", "start_date", "app_date", "first", "last", "name", "address", "city", "state", "zip")],
        least("address", *by_line, of="line").alias("address_line"),
    )
    both = F.concat_ws(" ", *[F.trim(F.regexp_replace(bounded(c(x)), r"[^A-Za-z\- ]", "")) for x in ("first", "last")])
    g = g.withColumn("owner", F.coalesce("owner", person(both), "name"))
    return docs.select("doc_id").join(g.select("doc_id", "company", "owner", form_address().alias("address"), "dob", "start_date", "app_date"), "doc_id", "left")


def form_address() -> Column:
    """Street, town, state and postcode from columns address, city, state, zip and address_line; a line that has them all wins."""
    c, whole = F.col, F.col("address_line").rlike(L.WHOLE_ADDRESS)

    def cleaned(value: Column) -> Column:
        v = F.regexp_replace(F.regexp_replace(T.clean_space(value), L.ADDRESS_LABEL, " "), r"\s*,\s*", ", ")
        return F.trim(F.regexp_replace(F.regexp_replace(v, r"(?:,\s*){2,}", ", "), r"^,|,$", ""))

    street, city, state, code = (cleaned(F.when(whole, F.regexp_extract("address_line", L.WHOLE_ADDRESS, i)).otherwise(bounded(c(x)))) for i, x in enumerate(("address", "city", "state", "zip"), 1))
    state = F.substring(F.upper(F.regexp_replace(state, "[^A-Za-z]", "")), 1, 2)
    state = T.let(state, lambda v: F.when(F.array_contains(F.split(F.lit(" ".join(L.STATES)), " "), v), v))
    street = T.let(street, lambda v: F.when(v.rlike(r"\d") & ~looks_like_label(v), v))
    city = T.let(city, lambda v: F.when(~looks_like_label(v), v))
    place = F.concat_ws(", ", city, state)
    place = T.let(F.struct(place.alias("p"), F.regexp_extract(code, r"\b(\d{5}(?:-\d{4})?)\b", 1).alias("z")), lambda x: F.concat(x["p"], F.when(x["z"] != "", F.concat(F.lit(" "), x["z"])).otherwise("")))
    joined = F.concat_ws(", ", street, T.let(place, lambda v: F.when(v != "", v)))
    out = F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s+,", ","), r"(?:,\s*){2,}", ", "))
    return T.let(out, lambda v: F.when(v != "", v))


def extract_application(docs: DataFrame, this_year: int = 2026) -> DataFrame:
    """Fields of application texts (doc_id, raw_text, filename); social security numbers only masked."""
    from .verdicts import fields_found

    t = F.col("raw_text")
    d = docs.select("doc_id", "filename", T.ein(t).alias("ein"), T.masked_ssn(t).alias("ssn_mask"), T.phones(t).alias("phones"), T.emails(t).alias("emails"), T.stated_revenue(t).alias("stated_revenue"))
    d = d.join(labelled_values(docs, this_year), "doc_id")
    d = d.withColumn("any_company", F.coalesce("company", T.company_from_filename(F.col("filename")))).drop("filename")
    return d.withColumn("fields_found", fields_found())
