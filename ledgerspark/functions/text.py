"""Document and line functions: columns in, columns out, all built from Spark's own functions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .money import MONEY

AMOUNT = r"\(?-?\$?\s?[\d,]+\.\d{2}\)?-?"
PRINTED = r"\d,\d{3}|\d\.\d{2}|\$\s*\d|(?:^|[^0-9.])\.\d{2}"


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def ascii_edges(pattern: str) -> str:
    """The pattern with \\b between ASCII word characters and all others, as JavaScript and SQL have it; Java's counts letters of every alphabet."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def clean_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text_of(value), " ", " "), r"\s+", " "))


def clean_lines(value: Column) -> Column:
    """The lines of a text with single spaces, without empty ones, in order."""
    lines = F.split(text_of(value), r"\r?\n")
    return F.filter(F.transform(lines, clean_space), lambda x: x != "")


def chars(value: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text_of(value), r"\s+", ""))


def has_printed_amounts(value: Column) -> Column:
    """Whether a figure with a comma, a decimal point or a dollar sign is printed."""
    return F.exists(clean_lines(value), lambda x: x.rlike(PRINTED))


def parse_amount(value: Column) -> Column:
    """A signed amount: negative in parentheses or with a minus before or after; null for none."""
    v = F.trim(value)
    number = F.regexp_replace(v, r"[^\d.]", "").try_cast(MONEY)
    return F.when(v == "", None).when(v.rlike(r"^\(.*\)$|^-|-\s*$"), -number).otherwise(number)


def full_year(year: Column, cut: int) -> Column:
    """A two-digit year above (cut) 19xx, else 20xx; others as they are."""
    y = year.try_cast("int")
    return F.when(F.length(year) == 2, y + F.when(y > cut, 1900).otherwise(2000)).otherwise(y)


def iso(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd, padded and not checked; null if a part is missing."""
    def pad(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    ok = year.isNotNull() & month.isNotNull() & (month.cast("string") != "") & day.isNotNull() & (day.cast("string") != "")
    return F.when(ok, F.concat_ws("-", year.cast("string"), pad(month), pad(day)))


def month_number(name: Column) -> Column:
    """Of a month's name or its first three letters; null for none."""
    low = F.substring(F.lower(name), 1, 3)
    return functools.reduce(lambda rest, m: F.when(low == m[1][:3], m[0]).otherwise(rest), enumerate(L.MONTHS, 1), F.lit(None).cast("int"))


def _group(value: Column, pattern: str, no: int) -> Column:
    found = F.regexp_extract(value, pattern, no)
    return F.when(found != "", found)


def parse_date(value: Column) -> Column:
    """The first date m/d/y, Month d yyyy or Mon-d-yy as a DATE; two-digit years from 30 on are 19xx."""

    def made(x: Column) -> Column:
        year = F.when(F.length(x["y"]) == 2, F.concat(F.when(x["y"] > "29", "19").otherwise("20"), x["y"])).otherwise(x["y"].try_cast("int").cast("string"))
        date = F.concat(year, F.lit("-"), F.lpad(x["m"], 2, "0"), F.lit("-"), F.lpad(x["d"], 2, "0"))
        return F.when(x["y"] != "", F.to_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))))

    def read(v: Column) -> Column:
        def parts(pattern: str, *no: int) -> list[Column]:
            return [F.regexp_extract(v, pattern, i).alias(n) for n, i in zip("ymd", no, strict=True)]

        number, word = F.struct(*parts(L.NUMBER_DATE, 3, 1, 2)), parts(L.WORD_DATE, 3, 1, 2)
        month = ((F.instr(F.lit("".join(m[:3] for m in L.MONTHS)), F.lower(F.substring(word[1], 1, 3))) + 2) / 3).cast("int").cast("string").alias("m")
        return F.coalesce(let(number, made), let(F.struct(word[0], month, word[2]), made))

    return let(F.translate(clean_space(value), ",", ""), read)


# -- kinds of documents -------------------------------------------------------------------------


def statement_signals(value: Column) -> Column:
    """Statement phrases that the text has."""
    low = F.lower(text_of(value))
    return F.filter(F.array(*[F.lit(p) for p in L.STATEMENT_PHRASES]), lambda p: F.contains(low, p))


def application_signals(value: Column) -> Column:
    """Application phrases that the text has as whole phrases."""
    low = F.concat(F.lit(" "), F.lower(text_of(value)), F.lit(" "))
    quoted = [p.replace("%", r"%").replace("/", "/") for p in L.APPLICATION_PHRASES]
    found = [F.when(low.contains(p) & low.rlike(rf"[^a-z0-9]{q}[^a-z0-9]"), p) for p, q in zip(L.APPLICATION_PHRASES, quoted, strict=True)]
    return F.array_compact(F.array(*found))


def document_kind(value: Column) -> Column:
    bank, app = F.size(statement_signals(value)), F.size(application_signals(value))
    return F.when((bank >= L.MIN_SIGNALS) & (bank >= app), "bank_statement").when(app >= L.MIN_SIGNALS, "application").when(chars(value) == 0, "unreadable").otherwise("unknown")


def is_contact_sheet(value: Column) -> Column:
    """Two or more lines of nothing but phones and e-mails, and four in five lines those or labels."""
    lines = F.filter(F.transform(F.split(text_of(value), r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")

    def data(x: Column) -> Column:
        return F.forall(F.split(x, r"\s+"), lambda t: t.rlike(L.PHONE_LINE) | t.rlike(L.EMAIL_LINE)) | x.rlike(L.PHONE_LINE)

    n = F.size(F.filter(lines, data))
    labels = F.size(F.filter(lines, lambda x: ~data(x) & x.rlike(L.CONTACT_LABEL)))
    return (n >= 2) & ((n + labels) / F.greatest(F.size(lines), F.lit(1)) >= 0.8)


def text_quality(value: Column, application: Column, proven: Column) -> Column:
    """struct(trusted, reason, char_count, signals)."""
    signals = F.when(application, application_signals(value)).otherwise(statement_signals(value))
    n = chars(value)
    reason = (
        F.when(n < L.MIN_CHARS, "insufficient_text").when(proven, "statement_arithmetic_proven")
        .when(F.size(signals) < L.MIN_SIGNALS, F.when(application, "no_application_signal").otherwise("no_statement_signal"))
        .when(text_of(value).rlike(L.ENVELOPE) & (F.size(signals) == 0), "envelope_only_text").otherwise("ok")
    )
    return F.struct(reason.isin("ok", "statement_arithmetic_proven").alias("trusted"), reason.alias("reason"), n.alias("char_count"), signals.alias("signals"))


def needs_ocr(value: Column) -> Column:
    return (chars(value) < L.OCR_CHARS) | ~has_printed_amounts(value)


def is_mtd(value: Column, filename: Column) -> Column:
    return F.concat_ws(" ", text_of(value), text_of(filename)).rlike(L.MONTH_TO_DATE)


# -- fields -------------------------------------------------------------------------------------


def bank(value: Column, filename: Column) -> Column:
    """The bank: the earliest letterhead name above the table, else the first of the ordered rules that holds."""

    def by_head(head: Column) -> Column:
        seen = [F.struct(F.when(F.instr(head, p) > 0, F.instr(head, p)).alias("at"), F.lit(i).alias("no"), F.lit(b).alias("bank")) for i, (b, patterns) in enumerate(L.LETTERHEADS) for p in patterns]
        nano = F.when((F.instr(head, "nano") > 0) & (F.instr(head, "ban") > 0), F.greatest(F.instr(head, "nano"), F.instr(head, "ban")))
        seen.append(F.struct(nano.alias("at"), F.lit(len(L.LETTERHEADS)).alias("no"), F.lit("Nano Banc").alias("bank")))
        return F.array_min(F.filter(F.array(*seen), lambda x: x["at"].isNotNull()))["bank"]

    def by_rules(x: Column) -> Column:
        def part(p: str) -> Column:
            where, what = p[0], p[2:]
            return x["f"].rlike(rf"\b{what}\b") if where == "w" else x[where].contains(what)

        holds = [functools.reduce(lambda a, c: a | c, [functools.reduce(lambda a, c: a & c, map(part, y.split(" + "))) for y in ways]) for _, ways in L.BANK_RULES]
        return F.coalesce(*[F.when(h, b) for h, (b, _) in zip(holds, L.BANK_RULES, strict=True)])

    def found(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.lit(29)), lambda i: F.coalesce(F.get(lines, i), F.lit("")).rlike(L.TABLE_START))
        end = F.greatest(F.coalesce(F.get(starts, F.lit(0)), F.lit(30)), F.lit(6))
        wide = F.lower(F.array_join(F.slice(lines, 1, 120), "\n"))
        places = F.struct(wide.alias("h"), F.lower(text_of(value)).alias("t"), F.lower(text_of(filename)).alias("f"))
        return F.coalesce(let(F.lower(F.array_join(F.slice(lines, F.lit(1), end), "\n")), by_head), let(places, by_rules))

    return let(clean_lines(value), found)


def account_token(value: Column) -> Column:
    """Digits and X alone; stars and small x are X."""
    v = F.regexp_replace(text_of(value), r"[^0-9Xx*]", "")
    return F.translate(v, "x*", "XX")


def account_number(value: Column) -> Column:
    """The account by nine rules in order: 'ending', a draft's member number, a label on its line, a masked number, a label
    alone above it, the table of accounts, the rows above a summary, a long number on a plain line, stars and four digits."""
    flat = text_of(value)

    def toll_free(t: Column) -> Column:
        return t.rlike(L.TOLL_FREE)

    def first(tokens: Column, good) -> Column:
        return F.get(F.filter(tokens, good), F.lit(0))

    def below(lines: Column, heads, most: int | None, count: int) -> Column:
        """The `count` lines after each of the first `most` lines that heads holds for."""
        at = F.filter(F.sequence(F.lit(0), F.lit(most - 1) if most else F.size(lines)), lambda i: heads(F.lower(F.coalesce(F.get(lines, i), F.lit("")))))
        return F.flatten(F.transform(at, lambda i: F.slice(lines, i + 2, F.lit(count))))

    def cut(t: Column) -> Column:
        twice = (F.length(t) == 18) & (F.substring(t, 1, 9) == F.substring(t, 10, 9))
        return F.when(t.rlike(r"^\d{24}$"), F.substring(t, 1, 12)).when(t.rlike(r"^\d{18}$") & twice, F.substring(t, 1, 9)).otherwise(t)

    def found(lines: Column) -> Column:
        ending = account_token(_group(flat, L.ACCOUNT_ENDING, 1))
        draft = F.exists(lines, lambda x: F.upper(x).contains("MICRO BUSINESS DRAFT"))
        digits = first(F.transform(below(lines, lambda x: x == "member #:", None, 3), lambda x: F.regexp_extract(x, r"\b(\d{4,})\b", 1)), lambda t: t != "")
        member = F.when(draft, F.concat(F.coalesce(_group(clean_space(value), L.MEMBER_NUMBER, 1), digits), F.lit("050")))
        tokens = F.transform(F.filter(F.slice(lines, 1, 180), lambda x: x.rlike(L.ACCOUNT_LABEL)), lambda x: cut(account_token(F.regexp_extract(x, L.ACCOUNT_LABEL, 1))))
        labelled = first(tokens, lambda t: (t != "") & (t.rlike(r"^X+\d{4,}$") | ~toll_free(t)))
        masked = account_token(_group(flat, L.ACCOUNT_MASKED, 1))
        rows = F.filter(below(lines, lambda x: x.rlike(L.ACCOUNT_ALONE), 180, 7), lambda x: ~x.rlike(L.NOT_AN_ACCOUNT))
        alone = first(F.transform(rows, account_token), lambda t: t.rlike(r"\d{4,}") & (t != "0000") & ~toll_free(t))
        table = F.exists(F.slice(lines, 1, 60), lambda x: F.upper(x) == "ACCOUNTS SUMMARY") & F.exists(F.slice(lines, 1, 70), lambda x: F.upper(x).contains("ACCOUNT NUMBER"))
        listed = F.when(table, first(F.transform(below(lines, lambda x: x.rlike("business checking|business draft"), 120, 5), account_token), lambda t: t.rlike(r"^\d{5,12}$") & ~t.rlike("^(2026|2025)")))
        at = F.filter(F.sequence(F.lit(0), F.lit(89)), lambda i: F.coalesce(F.get(lines, i), F.lit("")).startswith("Account Summary Account #"))
        above = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(9)), lambda j: account_token(F.coalesce(F.get(lines, F.when(i >= j, i - j)), F.lit(""))))))
        summary = first(above, lambda t: t.rlike(r"^\d{8,12}$") & ~t.rlike("^(800|888|877|866|855|844|833)"))
        bare = F.filter(F.slice(lines, 1, 35), lambda x: ~x.rlike(L.ACCOUNT_DATED) & ~x.rlike(L.ACCOUNT_NARRATIVE))
        plain = first(F.transform(bare, account_token), lambda t: t.rlike(r"^\d{10,17}$") & ~toll_free(t))
        stars = F.concat(F.lit("XXXX"), _group(flat, r"\*{2,}\s*(\d{4})", 1))
        return F.coalesce(*[F.when(x != "", x) for x in (ending, member, labelled, masked, alone, listed, summary, plain, stars)])

    return let(clean_lines(value), found)


def mask_account(number: Column) -> Column:
    t = account_token(number)
    return F.when(t == "", None).when(t.contains("X"), t).otherwise(F.concat(F.lit("XXXX"), F.right(t, F.lit(4))))


def statement_period(value: Column, filename: Column, year: int) -> Column:
    """struct(start, end, source): ranges in the text, single dates, then the file name; `year` for a month alone."""
    t = F.translate(text_of(value), " ", " ")
    numbers, words, single, this, scanned = L.NUMBER_RANGE, L.WORD_RANGE, L.SINGLE_DATE, L.THIS_STATEMENT, L.STATEMENT_FOR
    f = F.translate(text_of(filename), "_", " ")
    compact = L.FILE_RANGE
    dates = F.regexp_extract_all(f, F.lit(L.FILE_DATE))
    last = F.element_at(F.split(F.get(dates, F.size(dates) - 1), "-"), 1), F.element_at(F.split(F.get(dates, F.size(dates) - 1), "-"), 2), F.element_at(F.split(F.get(dates, F.size(dates) - 1), "-"), 3)
    ym, named = L.FILE_MONTH, L.FILE_MONTH_NAME

    def g(v: Column, p: str, n: int) -> Column:
        return _group(v, p, n)

    def part(start, end, source: str) -> Column:
        none = F.lit(None).cast("string")
        return F.when((end if end is not None else none).isNotNull(), F.struct((start if start is not None else none).alias("start"), end.alias("end"), F.lit(source).alias("source")))

    def text_date(p: str, n: int = 1) -> Column:
        return parse_date(g(t, p, n)).cast("string")

    def month_end(y: Column, m: Column) -> Column:
        return F.last_day(F.to_date(F.try_to_timestamp(iso(y, m, F.lit(1)), F.lit("yyyy-MM-dd")))).cast("string")

    return F.coalesce(
        part(iso(full_year(g(t, numbers, 3), 50), g(t, numbers, 1), g(t, numbers, 2)), iso(full_year(g(t, numbers, 6), 50), g(t, numbers, 4), g(t, numbers, 5)), "document_text_numeric_range"),
        part(iso(g(t, words, 3), month_number(g(t, words, 1)), g(t, words, 2)), iso(g(t, words, 6), month_number(g(t, words, 4)), g(t, words, 5)), "document_text_word_range"),
        part(None, text_date(single), "document_text_single_date"),
        part(None, text_date(this), "ocr_this_statement"),
        part(text_date(scanned), text_date(scanned, 2), "ocr_range_end"),
        part(iso(g(f, compact, 1), g(f, compact, 2), g(f, compact, 3)), iso(g(f, compact, 4), g(f, compact, 5), g(f, compact, 6)), "filename_compact_range"),
        part(None, F.when(F.size(dates) > 0, iso(*last)), "filename_single_end_date"),
        part(None, month_end(g(f, ym, 1), g(f, ym, 2)), "filename_year_month"),
        part(None, month_end(F.coalesce(g(f, r"(20\d{2})", 1), F.lit(str(year))), month_number(g(f, named, 1))), "filename_month"),
    )


def strip_noise_prefix(name: Column) -> Column:
    """Without a leading mail-sort code (capitals, four consonants in a run), or an account code that begins as the name
    after it does, if a business name of two words or more with a legal suffix is left."""

    def parts(pattern: str) -> Column:
        code = F.regexp_extract(name, pattern, 1)
        return F.struct(code.alias("code"), F.trim(F.substring(name, F.length(code) + 1, F.length(name))).alias("rest"))

    def named(x: Column) -> Column:
        return (x["code"] != "") & x["rest"].rlike(L.ENTITY_SUFFIX) & (F.size(F.split(x["rest"], r"\s+")) >= 2)

    sort = let(parts(L.SORT_CODE), lambda x: F.when(named(x) & x["code"].rlike(L.CONSONANTS), x["rest"]))
    fused = let(parts(L.FUSED_CODE), lambda x: F.when(named(x) & F.lower(x["code"]).startswith(F.lower(F.get(F.split(x["rest"], r"\s+"), F.lit(0)))), x["rest"]))
    return F.coalesce(sort, fused, name)


def company_key(name: Column) -> Column:
    """The key that spellings of one company share; 'unassociated' for none."""

    def single(w: Column) -> Column:
        return F.when((F.length(w) >= 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    base = F.regexp_replace(F.lower(let(clean_space(name), strip_noise_prefix)), r"['’]s\b", "")
    words = F.filter(F.split(F.trim(F.regexp_replace(base, r"[^a-z0-9]+", " ")), " "), lambda w: (w != "") & (w != "s"))

    def key(joined: Column) -> Column:
        short = F.trim(F.regexp_replace(joined, L.NAME_SUFFIX, ""))
        return F.when(joined == "", "unassociated").when(short == "", joined).otherwise(short)

    return let(F.array_join(F.transform(words, single), " "), key)


def significant_words(name: Column) -> Column:
    return F.filter(F.split(company_key(name), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*L.GENERIC_NAME_WORDS))


def names_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(significant_words(a), significant_words(b))


def address_parts(value: Column) -> Column:
    """struct(house, postcode, town) that tells a place."""
    v = text_of(value)
    codes, place = F.regexp_extract_all(v, F.lit(ascii_edges(r"\b(\d{5})(?:-\d{4})?\b"))), ascii_edges(L.TOWN)
    town = F.concat_ws(" ", F.trim(F.lower(F.regexp_extract(v, place, 1))), F.lower(F.regexp_extract(v, place, 2)))
    return F.struct(F.lower(_group(v, ascii_edges(r"\b(\d+[A-Za-z]?)\b"), 1)).alias("house"), F.get(codes, F.size(codes) - 1).alias("postcode"), F.when(v.rlike(place), town).alias("town"))


def same_address(a: Column, b: Column) -> Column:
    x, y = address_parts(a), address_parts(b)
    by_code = F.when(x["postcode"].isNotNull() & y["postcode"].isNotNull(), x["postcode"] == y["postcode"]).otherwise(F.coalesce(x["town"] == y["town"], F.lit(False)))
    return F.coalesce(x["house"] == y["house"], F.lit(False)) & by_code


def phones(value: Column) -> Column:
    """Up to eight distinct phones in order, as (ddd) ddd-dddd."""
    digits = F.transform(F.regexp_extract_all(text_of(value), F.lit(f"({L.PHONES})")), lambda x: F.right(F.regexp_replace(x, r"\D", ""), F.lit(10)))
    made = F.transform(digits, lambda d: F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)))
    return F.slice(F.array_distinct(made), 1, 8)


def emails(value: Column) -> Column:
    """Up to eight distinct e-mails in lower case, in order, over three spacings of the text."""
    raw = F.lower(text_of(value))
    tight = F.regexp_replace(F.regexp_replace(raw, r"\s*@\s*", "@"), r"\s*\.\s*([a-z]{2,}(?:\s|$))", ".$1")
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+", " "), r"\s*@\s*", "@"), r"\s*\.\s*", ".")
    found = F.concat(*[F.regexp_extract_all(x, F.lit(f"({L.EMAILS})")) for x in (raw, tight, flat)])
    kept = F.slice(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^\.+|\.+$", ""))), 1, 8)
    return F.when(raw.contains("@"), kept).otherwise(F.array().cast("array<string>"))


def ein(value: Column) -> Column:
    t = text_of(value)
    return F.coalesce(*[F.when(_group(t, p, 1).isNotNull(), F.concat_ws("-", _group(t, p, 1), _group(t, p, 2))) for p in (L.EIN_NEAR, L.EIN_PLAIN)])


def masked_ssn(value: Column) -> Column:
    """The last four digits alone ever leave this function."""
    p = L.SSN
    return F.when(_group(text_of(value), p, 3).isNotNull(), F.concat(F.lit("XXX-XX-"), _group(text_of(value), p, 3)))


def stated_revenue(value: Column) -> Column:
    """Monthly revenue on an application in whole units: a monthly label first, else an annual one over 12."""

    def found(lines: Column) -> Column:
        def read(label: str) -> Column:
            same = F.get(F.filter(F.transform(lines, lambda x: _group(x, label + r"[^0-9]*" + L.REVENUE, 1)), lambda x: x.isNotNull()), F.lit(0))
            where = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(label), F.get(lines, i + 1))), lambda x: x.isNotNull() & x.rlike(L.REVENUE_LINE))
            return F.translate(F.coalesce(same, _group(F.get(where, F.lit(0)), L.REVENUE, 1)), ",", "").try_cast("double")

        return F.coalesce(F.floor(read(L.MONTHLY_LABEL) + 0.5), F.floor(read(L.ANNUAL_LABEL) / 12 + 0.5)).cast("double")

    return F.when(F.lower(text_of(value)).rlike("revenue|sales"), let(clean_lines(value), found))


def folder_of(filename: Column) -> Column:
    parts = F.filter(F.transform(F.split(text_of(filename), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))


def company_from_folder(folder: Column) -> Column:
    name = F.trim(F.regexp_replace(F.translate(F.regexp_replace(folder, L.FOLDER_STAMP, ""), "_", " "), r"\s+", " "))
    return F.when(name.rlike("[A-Za-z]{3}"), name)


def company_from_filename(filename: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.element_at(F.split(text_of(filename), "/"), -1), r"(?i)\.[a-z0-9]+$", ""), r"[_\-]+", " ")
    words = F.filter(F.split(clean_space(F.regexp_replace(base, L.FILENAME_NOISE, " ")), " "), lambda w: (F.length(w) > 1) | (w == "&"))
    name = F.trim(F.regexp_replace(F.array_join(words, " "), r"[^A-Za-z0-9&.,'\- /]", ""))
    return F.when(name.rlike("[A-Za-z]{3}") & ~name.rlike(L.GENERIC_FILENAME), F.substring(name, 1, 90))


def doc_label(kind: Column, mtd: Column, period_end: Column) -> Column:
    """APP, MTD, the month of the period's end, STM or DOC."""
    month = F.upper(F.date_format(F.to_date(F.try_to_timestamp(period_end, F.lit("yyyy-MM-dd"))), "MMM"))
    return F.when(kind == "application", "APP").when(mtd, "MTD").when(month.isNotNull(), month).when(kind == "bank_statement", "STM").otherwise("DOC")
