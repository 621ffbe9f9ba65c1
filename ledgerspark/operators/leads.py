"""Documents to companies and leads, and what is reported of them.

Inputs are document facts (see verdicts). Every order has arrival_no at its end, so results don't depend on
partitions. Documents are never gathered into arrays of records: a lead is a key, and its facts are
aggregates over the bridge lead_id -> doc_id.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.money import MONEY
from ..sources.store import kept
from .verdicts import bank_accounts, document_revenue, extraction_score, revenue_verification

LEVELS = {"high": 4, "medium": 3, "low": 2, "needs_review": 1}


def ranked(value: Column, ranks: dict[str, int]) -> Column:
    return functools.reduce(lambda rest, r: F.when(value == r[0], r[1]).otherwise(rest), ranks.items(), F.lit(0))


# -- sets and duplicates ------------------------------------------------------------------------


def mark_duplicates(files: DataFrame, mode: str = "flag") -> DataFrame:
    """files: doc_id, file_hash, file_size, arrival_no. Later files equal in hash and size point at the earliest
    (flag) or go (skip). A null hash never matches, and those rows aren't shuffled together."""
    known, unknown = files.where("file_hash is not null"), files.where("file_hash is null").withColumn("duplicate_of", F.lit(None).cast(files.schema["doc_id"].dataType))
    first = known.groupBy("file_hash", "file_size").agg(F.min(F.struct("arrival_no", "doc_id")).alias("first"))
    k = known.join(first, ["file_hash", "file_size"]).withColumn("duplicate_of", F.when(F.col("first.doc_id") != F.col("doc_id"), F.col("first.doc_id"))).drop("first")
    out = k.unionByName(unknown)
    return out if mode == "flag" else out.where("duplicate_of is null")


def dedupe_by_period(statements: DataFrame) -> DataFrame:
    """One statement per company and period (missing dates are a period too): the most confident, the first on a tie."""
    keys = ["company_key", "period_start", "period_end"]
    order = F.struct(-ranked(F.col("level"), LEVELS), F.col("arrival_no"))
    w = Window.partitionBy(*keys).orderBy(order)
    return statements.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def distinct_ci(values: DataFrame, keys: list[str], value: str = "value", order: str = "arrival_no") -> DataFrame:
    """Distinct trimmed values without regard to case, the first spelling, with their place."""
    v = values.withColumn("_v", F.trim(value)).where("_v <> ''").groupBy(*keys, F.lower("_v").alias("_k")).agg(F.min_by("_v", order).alias(value), F.min(order).alias("_o"))
    return v.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy("_o", value)).cast("long").alias("place"))


def run_diff(before: DataFrame, after: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """doc_id, field, old, new: every field that differs between two runs, nulls compared as values."""
    b, a = (df.select(key, *[F.col(f).cast("string").alias(f"{f}_{n}") for f in fields], F.lit(True).alias(f"in_{n}")) for n, df in (("old", before), ("new", after)))
    j = b.join(a, key, "full_outer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").alias("old"), F.col(f"{f}_new").alias("new")) for f in fields])
    return j.select(key, F.explode(pairs).alias("x")).select(key, "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


# -- grouping -----------------------------------------------------------------------------------


def aggregate_by_company(facts: DataFrame) -> DataFrame:
    """company_key, bucket, doc_id and the company's printed name (its first document's); statements one per period."""
    f = facts.withColumn("company_key", T.company_key(F.col("company")))
    bucket = F.when(F.col("doc_type") == "application", "application").when(F.col("is_mtd"), "mtd").when(F.col("doc_type") == "bank_statement", "statement").otherwise("unknown")
    f = f.withColumn("bucket", bucket)
    names = f.groupBy("company_key").agg(F.min_by("company", "arrival_no").alias("name"))
    kept = dedupe_by_period(f.where("bucket = 'statement'")).unionByName(f.where("bucket <> 'statement'"))
    return kept.join(names, "company_key").select("company_key", "name", "bucket", "doc_id", "arrival_no", "period_end")


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_names(facts: DataFrame) -> DataFrame:
    """facts with read_names: the names that a document itself reads, in order: of an application its form's and its trade name, of others
    the holder's, the trade name and the company. One guessed from a file name isn't read. (holder_name, dba and company_source may be missing.)"""
    company, dba, holder = F.col("company"), _optional(facts, "dba"), _optional(facts, "holder_name")
    app = F.array(F.when(F.coalesce(_optional(facts, "company_source"), F.lit("form")) == "form", company), dba)
    names = F.when(F.col("doc_type") == "application", app).otherwise(F.array(holder, dba, company))
    return facts.withColumns({"read_names": F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), "dba": dba})


def company_folders(facts: DataFrame) -> DataFrame:
    """folder, folder_company of the folders that are companies: not where two or more other companies are read and no name agrees."""
    f = with_names(facts).withColumn("folder", T.folder_of(F.col("filename"))).where("folder is not null").withColumn("folder_company", T.company_from_folder(F.col("folder")))
    f = f.select("folder", "folder_company", F.explode_outer("read_names").alias("name"))
    agrees = F.coalesce(T.names_overlap(F.col("name"), F.col("folder_company")), F.lit(False))
    g = f.groupBy("folder", "folder_company").agg(F.countDistinct(F.when(F.col("name").isNotNull() & ~agrees, T.company_key(F.col("name")))).alias("others"), F.max(F.when(F.col("name").isNotNull(), agrees)).alias("agree"))
    good = g.where(F.col("folder_company").isNotNull() & ~((F.col("others") >= 2) & ~F.coalesce("agree", F.lit(False))))
    folders = g.agg(F.count("*").alias("n"))
    return good.crossJoin(F.broadcast(folders)).where("n >= 2").select("folder", "folder_company")  # folders: one row


def lead_keys(facts: DataFrame) -> DataFrame:
    """facts with read_names and lead_id: the folder's company key, else the document's own, else one of its own."""
    f = with_names(facts).withColumn("folder", T.folder_of(F.col("filename"))).join(company_folders(facts), "folder", "left")
    own = T.company_key(F.coalesce("company", "dba"))
    return f.withColumn("lead_id", F.when(F.col("folder_company").isNotNull(), T.company_key(F.col("folder_company"))).when(own == "unassociated", F.concat(F.lit("unassociated:"), F.col("doc_id").cast("string"))).otherwise(own))


def merge_same_address(keyed: DataFrame) -> DataFrame:
    """Groups with statements alone join the first group with an application alone at the same address.

    Two equi-joins (house and postcode; house and town where one has no postcode); a statement group
    goes to one application group and there is no chaining."""
    real = (F.col("doc_type") == "bank_statement") & F.col("duplicate_of").isNull() & ~F.coalesce("is_mtd", F.lit(False))
    app = F.col("doc_type") == "application"
    g = keyed.groupBy("lead_id").agg(F.max(real).alias("has_statement"), F.max(app).alias("has_application"), F.min("arrival_no").alias("first"), F.min_by("address", F.when(app, F.col("arrival_no"))).alias("app_address"))
    apps = g.where("has_application and not has_statement").select(F.col("lead_id").alias("to_lead"), "first", T.address_parts(F.col("app_address")).alias("p"))
    alone = g.where("not has_application and has_statement").select("lead_id")
    stmts = keyed.where(real).join(alone, "lead_id", "left_semi").select("lead_id", T.address_parts(F.col("address")).alias("p")).select("lead_id", "p.house", "p.postcode", "p.town").distinct()
    a = apps.select("to_lead", "first", F.col("p.house").alias("a_house"), F.col("p.postcode").alias("a_postcode"), F.col("p.town").alias("a_town")).where("a_house is not null")
    by_code = stmts.join(a, (F.col("house") == F.col("a_house")) & (F.col("postcode") == F.col("a_postcode")))
    by_town = stmts.join(a, (F.col("house") == F.col("a_house")) & (F.col("town") == F.col("a_town"))).where("postcode is null or a_postcode is null")
    best = by_code.unionByName(by_town).groupBy("lead_id").agg(F.min_by("to_lead", F.struct("first", "to_lead")).alias("to_lead"))
    return keyed.join(best, "lead_id", "left").withColumn("lead_id", F.coalesce("to_lead", "lead_id")).drop("to_lead")


def possible_same_business(leads: DataFrame, max_pairs_per_lead: int | None = None) -> DataFrame:
    """Leads with an application alone beside leads with statements alone: the number of the others for each, which
    is what the product of the two lists comes to; no pair is made. With max_pairs_per_lead the first of them by name are listed too."""
    app_only = F.col("has_application") & (F.col("statement_count") == 0)
    stmt_only = ~F.col("has_application") & (F.col("statement_count") > 0)
    side = leads.withColumn("side", F.when(app_only, "application").when(stmt_only, "statement")).where("side is not null")
    n = side.groupBy("side").agg(F.count("*").cast("long").alias("others"))
    other = F.when(F.col("side") == "application", "statement").otherwise("application")
    out = side.join(F.broadcast(n.select(F.col("side").alias("other"), "others")), other == F.col("other"), "left")  # two rows
    out = out.select("lead_id", "side", F.coalesce("others", F.lit(0)).cast("long").alias("others"))
    if max_pairs_per_lead is None:
        return out
    order = Window.partitionBy("side").orderBy("lead_id")
    first = side.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_pairs_per_lead).select(F.col("side").alias("other"), F.col("lead_id").alias("other_lead"))
    return out.join(F.broadcast(first), F.when(F.col("side") == "application", "statement").otherwise("application") == F.col("other"), "left").drop("other")  # max_pairs_per_lead rows a side


# -- leads --------------------------------------------------------------------------------------


def application_rank() -> Column:
    """The order of a lead's applications, the best highest: unique ones by what was read of them, a form before a contact sheet, the first of
    equals; if all are duplicates, the first of those."""
    unique = F.col("duplicate_of").isNull()
    read = F.when(F.coalesce(F.col("kind") == "contact_sheet", F.lit(False)), 0).otherwise(100) + F.coalesce("fields_found", F.lit(0))
    return F.struct(unique.cast("int"), F.when(unique, read).otherwise(0), -F.col("arrival_no"))


def lead_facts(keyed: DataFrame) -> DataFrame:
    """One row per lead: name, owner, revenue and source, score, status, counts, issues."""
    c = F.col
    unique = c("duplicate_of").isNull()
    app, stmt = c("doc_type") == "application", c("doc_type") == "bank_statement"
    plain = unique & stmt & ~F.coalesce("is_mtd", F.lit(False))
    k = keyed if "read_names" in keyed.columns else with_names(keyed)
    k = k.withColumns({"score": extraction_score(), "verification": revenue_verification(), "doc_revenue": document_revenue(), "printed_name": F.coalesce("company", "dba")})

    def agrees(name: Column) -> Column:
        return F.coalesce(T.names_overlap(name, c("lead_id")), F.lit(False))  # a folder's lead has its company key as lead_id

    k = k.withColumns({"agreeing": F.get(F.filter("read_names", agrees), F.lit(0)), "read_name": F.get("read_names", F.lit(0))})
    own_folder = c("folder_company").isNotNull() & (T.company_key(c("folder_company")) == c("lead_id"))
    best = F.max_by(F.struct("doc_id", "stated_revenue", "score", "owner", "printed_name", "agreeing", "read_name"), F.when(app, application_rank()))
    verified = plain & (c("verification") == "verified")
    positive = c("doc_revenue") > 0
    g = k.groupBy("lead_id").agg(
        F.max(app).alias("has_application"), best.alias("app"), F.min_by("printed_name", "arrival_no").alias("first_company"),
        F.max_by(F.struct("folder", F.col("folder_company").alias("company")), F.when(own_folder, c("arrival_no"))).alias("of"),
        F.min_by("agreeing", F.when(c("agreeing").isNotNull(), c("arrival_no"))).alias("agreeing"), F.min_by("read_name", F.when(c("read_name").isNotNull(), c("arrival_no"))).alias("any_read"),
        F.count(F.when(plain, 1)).cast("long").alias("statement_count"), F.count(F.when(verified, 1)).alias("verified_count"),
        F.avg(F.when(verified & positive, c("doc_revenue"))).alias("verified_mean"), F.avg(F.when(plain & positive, c("doc_revenue"))).alias("plain_mean"),
        F.avg(F.when(unique & stmt, c("score"))).alias("statement_score"), F.max_by("status", F.struct(ranked(c("status"), L.STATUS_RANKS), -c("arrival_no"))).alias("status"),
        F.count(F.when(~unique, 1)).cast("long").alias("duplicate_count"), F.sum(F.coalesce("review_count", F.lit(0))).cast("long").alias("issue_count"), F.count("*").cast("long").alias("doc_count"),
    )
    mean = F.when(c("verified_count") > 0, c("verified_mean")).otherwise(c("plain_mean"))
    a, s = c("app.score"), c("statement_score")
    score = F.when(s.isNull() & a.isNull(), 0).when(s.isNull(), F.floor(a * 0.3 + 0.5)).when(a.isNull(), F.floor(s * 0.85 + 0.5)).otherwise(F.floor(s * 0.7 + a * 0.3 + 0.5))
    source = F.when(c("app.stated_revenue").isNotNull(), "application").when(mean.isNull(), "none").when(c("verified_count") > 0, "verified_statements").otherwise("unverified_statements")
    # A name that the lead's own files read (its application's first) and that agrees with its folder; else a stamped folder's; else the
    # first read. Without a folder, what the application or else the first document is called.
    stamped = F.when(c("of.folder").rlike(L.FOLDER_STAMP), c("of.company"))
    in_folder = F.coalesce("app.agreeing", "agreeing", stamped, "app.read_name", "any_read", "of.company")
    name = F.coalesce(F.when(c("of").isNotNull(), in_folder).when(c("app").isNotNull(), c("app.printed_name")).otherwise(c("first_company")), F.lit("Unassociated"))
    return g.select(
        "lead_id", name.alias("company_name"), c("app.owner").alias("owner_name"), F.coalesce(c("app.stated_revenue").cast("double"), F.floor(mean * 100 + 0.5) / 100, F.lit(0.0)).alias("revenue"), source.alias("revenue_source"),
        score.cast("long").alias("score"), "status", "has_application", "statement_count", "duplicate_count", "issue_count", "doc_count",
    )


def lead_contacts(keyed: DataFrame) -> DataFrame:
    """lead_id, kind (phone or email) and value of every contact that an application of a lead carries, duplicates aside (if all are
    duplicates, the first one's); a row for each, so no lead's list is gathered in one task."""
    apps = keyed.where("doc_type = 'application'")
    some = apps.groupBy("lead_id").agg(F.max(F.col("duplicate_of").isNull()).alias("any_unique"), F.min("arrival_no").alias("first_no"))
    apps = apps.join(some, "lead_id").where(F.when(F.col("any_unique"), F.col("duplicate_of").isNull()).otherwise(F.col("arrival_no") == F.col("first_no")))

    def tagged(values: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    pairs = [tagged("phones", "phone"), tagged("emails", "email")]
    return apps.select("lead_id", F.explode(F.concat(*pairs)).alias("x")).select("lead_id", "x.*").distinct()


def reconciliation_badge(keyed: DataFrame) -> DataFrame:
    """lead_id, checked, failing and badge of every lead: how many of its checked statements agree with their own summaries; null unchecked."""
    plain = F.col("duplicate_of").isNull() & (F.col("doc_type") == "bank_statement") & ~F.coalesce("is_mtd", F.lit(False))
    checked, failing = F.count(F.when(plain & F.col("reconciles").isNotNull(), 1)), F.count(F.when(plain & ~F.col("reconciles"), 1))
    g = keyed.groupBy("lead_id").agg(checked.cast("long").alias("checked"), failing.cast("long").alias("failing"))
    share = F.concat((F.col("checked") - F.col("failing")).cast("string"), F.lit("/"), F.col("checked").cast("string"))
    return g.withColumn("badge", F.when(F.col("failing") > 0, F.concat(F.lit("\u26a0 "), share)).when(F.col("checked") > 0, F.concat(F.lit("\u2713 "), share)))


def build_leads(facts: DataFrame) -> DataFrame:
    """Leads in the order revenue, score (both descending), name; lower-case binary order stands for a locale's."""
    leads = lead_facts(merge_same_address(lead_keys(facts)))
    return leads.orderBy(F.desc("revenue"), F.desc("score"), F.lower("company_name"), "company_name", "lead_id")


def company_info(keyed: DataFrame) -> DataFrame:
    """Distinct names, trade names and addresses of all statements of a lead, duplicates too, and whether any differs from the best
    application's; nothing differs from what an application lacks."""
    k = keyed if "read_names" in keyed.columns else with_names(keyed)
    app = F.col("doc_type") == "application"
    g = k.groupBy("lead_id").agg(F.max_by(F.struct("company", "dba", "address"), F.when(app, application_rank())).alias("app"))
    s = k.where("doc_type = 'bank_statement'").select("lead_id", F.coalesce(_optional(k, "holder_name"), F.col("company")).alias("company"), "dba", "address").join(g, "lead_id")

    def printed(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))

    def differs(name: str) -> Column:
        return F.max(F.col(name).isNotNull() & F.col(f"app.{name}").isNotNull() & (printed(F.col(name)) != printed(F.col(f"app.{name}"))))

    def number(name: str) -> Column:
        return F.countDistinct(F.when(F.trim(name) != "", F.lower(F.trim(name)))).cast("long")

    placed = F.col("address").isNotNull() & F.col("app.address").isNotNull() & ~T.same_address(F.col("address"), F.col("app.address"))
    d = s.groupBy("lead_id").agg(number("company").alias("name_count"), number("dba").alias("dba_count"), number("address").alias("address_count"), differs("company").alias("name_differs"), differs("dba").alias("dba_differs"), F.max(placed).alias("address_differs"))
    counts, marks = ("name_count", "dba_count", "address_count"), ("name_differs", "dba_differs", "address_differs")
    return g.select("lead_id").join(d, "lead_id", "left").select("lead_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], *[F.coalesce(c, F.lit(False)).alias(c) for c in marks])


# -- reports ------------------------------------------------------------------------------------


def display_amount(value: Column) -> Column:
    """Up to the next 500, from 50,000 on to the next 50,000; negatives to whole units."""
    v = value.cast("double")
    return F.when(v < 0, F.floor(v + 0.5)).when(v >= 50000, F.ceil(v / 50000) * 50000).otherwise(F.ceil(v / 500) * 500).cast("double")


def real_statement() -> Column:
    """Neither a duplicate nor a preview of a month."""
    return (F.col("doc_type") == "bank_statement") & F.col("duplicate_of").isNull() & ~F.coalesce("is_mtd", F.lit(False))


def plain_number(value: Column) -> Column:
    """An amount without zeros at its end, as text."""
    return F.regexp_replace(value.cast(MONEY).cast("string"), r"\.?0+$", "")


def newest_statements(keyed: DataFrame, most: int | None = None) -> DataFrame:
    """lead_id, place (from 1), doc_id and entry of each lead's read statements, the newest first and of equals the first to arrive; with
    `most` so many a lead, of which each task keeps no more before rows are dealt by lead."""
    order = Window.partitionBy("lead_id").orderBy(F.coalesce("period_end", F.lit("")).desc(), "arrival_no")
    d = keyed.where(real_statement() & F.col("status").isin("complete", "needs_review")).withColumn("place", F.row_number().over(order))
    d = d.where(F.col("place") <= most) if most is not None else d
    mark = revenue_verification()
    told = F.when(mark == "verified", "balances add up").when(mark == "conflicting", "does not add up").otherwise("not proven")
    deposits = F.coalesce(F.col("true_revenue").cast(MONEY), F.col("total_deposits").cast(MONEY))
    entry = F.concat_ws(" • ", F.coalesce("period_end", "filename"), *[F.coalesce(plain_number(x), F.lit("—")) for x in (deposits, _optional(keyed, "ending", "double"))], told)
    return d.select("lead_id", F.col("place").cast("long").alias("place"), "doc_id", entry.alias("entry"))


def first_issues(keyed: DataFrame, items: DataFrame, most: int = 6) -> DataFrame:
    """lead_id, place, doc_id, type: the first `most` review items (doc_id, type, detail) of each lead, in the order of its documents."""
    j = items.join(keyed.select("doc_id", "lead_id", "arrival_no"), "doc_id")
    order = Window.partitionBy("lead_id").orderBy("arrival_no", "type", F.coalesce("detail", F.lit("")))
    j = j.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return j.select("lead_id", F.col("place").cast("long").alias("place"), "doc_id", "type")


def joined_text(rows: DataFrame, keys: list[str], text: str, order: list[str], between: str, name: str) -> DataFrame:
    """One text for each key: rows' texts in their order. A cell is one text by nature, so it holds all of its key's rows."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return rows.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_text"]), between).alias(name))


def contact_cells(keyed: DataFrame) -> DataFrame:
    """lead_id, phone, email: the contacts of lead_contacts' applications as cells, each once, in the order of documents."""
    apps = keyed.where("doc_type = 'application'")
    some = apps.groupBy("lead_id").agg(F.max(F.col("duplicate_of").isNull()).alias("any_unique"), F.min("arrival_no").alias("first_no"))
    apps = apps.join(some, "lead_id").where(F.when(F.col("any_unique"), F.col("duplicate_of").isNull()).otherwise(F.col("arrival_no") == F.col("first_no")))
    cells = []
    for values, name in (("phones", "phone"), ("emails", "email")):
        each = apps.select("lead_id", "arrival_no", F.posexplode(_optional(apps, values, "array<string>")).alias("at", "v")).where(F.trim("v") != "")
        once = each.groupBy("lead_id", F.lower(F.trim("v")).alias("same")).agg(F.min(F.struct("arrival_no", "at", F.trim("v").alias("v"))).alias("x")).select("lead_id", "x.*")
        cells.append(joined_text(once, ["lead_id"], "v", ["arrival_no", "at"], " • ", name))
    return cells[0].join(cells[1], "lead_id", "full_outer")


def results_sheet(leads: DataFrame, keyed: DataFrame, positions: DataFrame) -> DataFrame:
    """The sixteen cells of each lead that has a company, one row each. keyed: documents with their lead; positions: doc_id, funder, monthly_burden.

    Each list is an aggregate of its own over the bridge of lead and document, in a total order: statements newest first, banks by
    their newest statement, funders by the newest statement that has them, contacts by document."""
    c = F.col
    statements = newest_statements(keyed)
    banks = bank_accounts(keyed.where(real_statement()))
    real = keyed.where(real_statement()).withColumn("place", F.row_number().over(Window.partitionBy("lead_id").orderBy(F.coalesce("period_end", F.lit("")).desc(), "arrival_no"))).select("lead_id", "doc_id", "place")
    paid = positions.join(real, "doc_id").groupBy("lead_id", F.coalesce("funder", F.lit("Unknown lender")).alias("funder")).agg(F.min("place").alias("place"), F.floor(F.sum(F.col("monthly_burden").cast(MONEY)).cast("double") + 0.5).cast("long").alias("burden"))
    paid = paid.withColumn("entry", F.concat("funder", F.lit(" • $"), c("burden").cast("string"), F.lit("/mo")))
    app, addressed = c("doc_type") == "application", (c("doc_type") == "bank_statement") & (F.trim("address") != "")
    told = keyed.select("*", _optional(keyed, "app_date").alias("_signed"), _optional(keyed, "start_date").alias("_started")).groupBy("lead_id").agg(F.max_by(F.struct("address", "_signed", "_started"), F.when(app, application_rank())).alias("app"), F.min_by(F.trim("address"), F.when(addressed, c("arrival_no"))).alias("stated"))
    out = leads.where("company_name <> 'Unassociated'").join(told, "lead_id")
    for cells in (contact_cells(keyed), joined_text(statements, ["lead_id"], "entry", ["place"], " · ", "statements"), joined_text(banks, ["lead_id"], "entry", ["place"], " · ", "bank"), joined_text(paid, ["lead_id"], "entry", ["place", "funder"], " · ", "mca")):
        out = out.join(cells, "lead_id", "left")
    source = F.when(c("revenue_source") == "application", "Application").when(c("revenue_source") == "verified_statements", "Statements (balances add up)").when(c("revenue_source") == "unverified_statements", "Statements (NOT proven)")
    return out.select(
        "lead_id", c("company_name").alias("company"), c("owner_name").alias("owner"), display_amount(c("revenue")).alias("revenue"), (display_amount(c("revenue")) + 150000).alias("approval"), "phone", "email", F.coalesce("app.address", "stated").alias("address"),
        c("app._signed").alias("app_date"), "statements", "bank", c("app._started").alias("bsd"), "mca", "score", "status", F.when(c("duplicate_count") > 0, c("duplicate_count")).alias("duplicates_excluded"), source.alias("revenue_source"),
    )


def burden_by_funder(positions: DataFrame, bridge: DataFrame) -> DataFrame:
    """lead_id, funder, burden: monthly burdens over a lead's statements (bridge: lead_id, doc_id)."""
    g = positions.join(bridge, "doc_id").groupBy("lead_id", F.coalesce("funder", F.lit("Unknown lender")).alias("funder"))
    return g.agg(F.floor(F.sum(F.col("monthly_burden").cast("decimal(18,2)")).cast("double") + 0.5).cast("long").alias("burden"))


def search_results(leads: DataFrame, text: str = "", status: str | None = None, by: str = "revenue", limit: int | None = None) -> DataFrame:
    """Leads with a company whose name or owner has the text, by revenue or name; with limit the first of them."""
    low = F.lower(F.concat_ws(" ", "company_name", "owner_name"))
    out = leads.where((F.col("company_name") != "Unassociated") & low.contains(text.lower()))
    out = out.where(F.col("status") == status) if status else out
    out = out.orderBy(*([F.desc("revenue")] if by == "revenue" else []), F.lower("company_name"), "lead_id")
    return out.limit(limit) if limit is not None else out


def audit_summary(leads: DataFrame) -> DataFrame:
    """One row of counts."""
    def n(x: Column, name: str) -> Column:
        return F.count(F.when(x, 1)).cast("long").alias(name)

    c = F.col
    return leads.agg(n(c("company_name") == "Unassociated", "missing_company"), n(c("status") == "needs_review", "needs_review"), n(c("status") == "failed", "failed"), n((c("score") > 0) & (c("score") < 70), "low_score"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).cast("long").alias("duplicate_issues"), n((c("status") == "complete") & (c("company_name") != "Unassociated"), "ready"))


def numbered_by(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `position` from 0 in a total order: a range sort, counts per part, then numbers inside each part, so
    no task gets all rows."""
    ordered = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ordered = kept(ordered)  # both branches below then see one and the same dealing
    placed = ordered.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = placed.groupBy("part").agg(F.max("inside").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row per part
    return placed.join(before.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part").withColumn("position", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def numbered(leads: DataFrame) -> DataFrame:
    """leads with `position` from 0 in lead order."""
    return numbered_by(leads, F.desc("revenue"), F.desc("score"), F.lower("company_name"), "lead_id")


def assign_leads(leads: DataFrame, reps: list[str], rule: str = "round_robin", threshold: float = 0.0) -> DataFrame:
    """lead_id, rep: round_robin or odd_even by position, over_threshold (revenue strictly over it to the first rep), or all to the first."""
    n = numbered(leads)
    names = F.array(*[F.lit(r) for r in reps])
    if rule in ("round_robin", "odd_even"):
        rep = F.get(names, (F.col("position") % len(reps)).cast("int"))
    elif rule == "over_threshold":
        rep = F.when(F.col("revenue") > threshold, F.lit(reps[0]))
    else:
        rep = F.lit(reps[0])
    return n.select("lead_id", "position", rep.alias("rep")).where("rep is not null")


def exclude_low_revenue(facts: DataFrame, threshold: float) -> DataFrame:
    """Queued and stopped documents in the folder of an application that states less than the threshold become skipped."""
    f = facts.withColumn("folder", T.folder_of(F.col("filename")))
    if threshold <= 0:
        return f.withColumn("excluded", F.lit(False))
    low = f.where((F.col("doc_type") == "application") & (F.col("stated_revenue") < threshold) & (F.col("status") != "failed") & F.col("folder").isNotNull()).select("folder").distinct().withColumn("low", F.lit(True))
    out = f.join(low, "folder", "left")
    hit = F.coalesce("low", F.lit(False)) & F.col("status").isin("queued", "stopped")
    return out.withColumns({"excluded": hit, "status": F.when(hit, "skipped").otherwise(F.col("status"))}).drop("low")


def recover_statuses(statuses: DataFrame) -> DataFrame:
    """Documents in flight when a run broke off become stopped, with no attempts and an error text."""
    flight = F.col("status").isin("validating", "extracting", "ocr")
    return statuses.withColumns({"error": F.when(flight, "scan_interrupted").otherwise(F.col("error")), "attempts": F.when(flight, 0).otherwise(F.col("attempts")), "status": F.when(flight, "stopped").otherwise(F.col("status"))})


def batch_report(facts: DataFrame) -> DataFrame:
    """One row per status: documents, mean positive score (one decimal), proven and mismatched statements."""
    k = facts.withColumn("score", extraction_score())
    stmt = F.col("doc_type") == "bank_statement"
    mean = F.avg(F.when(F.col("score") > 0, F.col("score")))
    return k.groupBy("status").agg(F.count("*").cast("long").alias("documents"), (F.floor(mean * 10 + 0.5) / 10).alias("mean_score"), F.count(F.when(stmt & F.col("reconciles"), 1)).cast("long").alias("proven"), F.count(F.when(stmt & ~F.col("reconciles"), 1)).cast("long").alias("mismatched"))


def short_period(start: Column, end: Column) -> Column:
    """mm/dd/yyyy - mm/dd/yyyy, or the one date there is."""
    def date(x: Column) -> Column:
        return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat_ws("/", F.substring(x, 6, 2), F.substring(x, 9, 2), F.substring(x, 1, 4)))

    both = F.concat_ws(" - ", date(start), date(end))
    return F.when(both != "", both)


def document_sheet(facts: DataFrame) -> DataFrame:
    """The grid's twenty columns, a row per document; the account masked, withdrawals fall back to the rows' debits. What facts lack stays null."""
    c = F.col
    score = F.floor(c("points") / 4 * 100 + 0.5) / 100
    return facts.select(
        "doc_id", "filename", F.when(c("status").isin("complete", "needs_review", "failed"), c("status")).otherwise("needs_review").alias("status"), c("company").alias("company_name"), _optional(facts, "dba").alias("dba"), _optional(facts, "holder_name").alias("statement_name"),
        "address", "bank", T.mask_account(c("account")).alias("account_number"), short_period(c("period_start"), c("period_end")).alias("statement_period"), _optional(facts, "opening", "double").alias("opening_balance"), _optional(facts, "ending", "double").alias("ending_balance"),
        c("total_deposits").cast("double").alias("deposits"), F.coalesce(_optional(facts, "summary_withdrawals", "double"), _optional(facts, "total_debits", "double")).cast("double").alias("withdrawals"), "reconciles", c("true_revenue").cast("double").alias("revenue"),
        F.when(c("level").isin("high", "medium", "low"), c("level")).alias("confidence_level"), _optional(facts, "pages_read", "long").cast("long").alias("pages_read"), "used_ocr", score.alias("extraction_score"), _optional(facts, "time_taken", "long").cast("long").alias("time_taken"),
    )


def header_stats(facts: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: files, leads, complete, review, failed, ready, total revenue, mean score, share of files done in whole percent."""
    c = F.col
    done = c("status").isin("complete", "needs_review", "failed", "stopped", "skipped")
    f = facts.agg(F.count("*").cast("long").alias("files"), F.count(F.when(c("status") == "failed", 1)).cast("long").alias("failed"), F.count(F.when(done, 1)).alias("done"))
    n = [F.count(F.when(x, 1)).cast("long").alias(name) for x, name in ((c("status") == "complete", "complete"), (c("status") == "needs_review", "review"), ((c("status") == "complete") & (c("company_name") != "Unassociated"), "ready"))]
    g = leads.agg(F.count("*").cast("long").alias("leads"), *n, F.coalesce(F.sum(c("revenue").cast(MONEY)), F.lit(0)).cast("double").alias("revenue"), F.coalesce(F.floor(F.avg("score") + 0.5), F.lit(0)).cast("long").alias("mean_score"))
    share = F.when(c("files") > 0, F.floor(c("done") * 100 / c("files") + 0.5)).otherwise(0).cast("long")
    return f.crossJoin(F.broadcast(g)).withColumn("progress", share).drop("done")  # one row each


def lead_pitch(leads: DataFrame, positions: DataFrame, recurring: DataFrame) -> DataFrame:
    """One line per lead (positions, recurring: lead_id ...): the first advance, else the largest recurring expense, else a neutral text."""
    p = positions.groupBy("lead_id").agg(F.min_by("funder", F.struct(-F.col("n"), F.col("funder"))).alias("funder"))
    r = recurring.groupBy("lead_id").agg(F.max_by("counterparty", F.struct("total_amount", "counterparty")).alias("counterparty"))
    j = leads.select("lead_id").join(p, "lead_id", "left").join(r, "lead_id", "left")
    return j.select("lead_id", F.coalesce(F.concat(F.lit("Paying "), "funder"), F.concat(F.lit("Recurring: "), "counterparty"), F.lit("No recurring payments seen")).alias("pitch"))


def display_value(value: Column, used_ocr: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), value).when(used_ocr, "OCR failed").otherwise("Blank")


def display_list(values: Column, used_ocr: Column) -> Column:
    """The values that aren't blank, or one label that says why there are none."""
    some = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return T.let(some, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.when(used_ocr, "OCR failed").otherwise("Blank"))))


def display_money(value: Column, used_ocr: Column) -> Column:
    """Whole dollars, or the label of a missing value."""
    whole = F.floor(value.cast("double") + 0.5).cast("long")
    return F.when(value.isNotNull(), F.concat(F.lit("$"), F.format_number(whole, 0))).when(used_ocr, "OCR failed").otherwise("Blank")
