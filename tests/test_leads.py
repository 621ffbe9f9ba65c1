"""Leads from facts worked out by hand: names read, folders that disagree, best applications, contacts and company records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import leads as G

SCHEMA = (
    "doc_id long, arrival_no long, filename string, doc_type string, kind string, company string, company_source string, holder_name string, dba string, owner string, address string, duplicate_of long, is_mtd boolean, status string, "
    "fields_found int, stated_revenue double, true_revenue double, total_deposits double, reconciles boolean, points int, level string, review_count int, period_end string, phones array<string>, emails array<string>, bank string, account string"
)


def doc(no, filename, doc_type="bank_statement", company=None, **more):
    base = dict.fromkeys([x.split()[0] for x in SCHEMA.split(", ")])
    return base | {"doc_id": no, "arrival_no": no, "filename": filename, "doc_type": doc_type, "company": company, "is_mtd": False, "status": "complete", "level": "high", "phones": [], "emails": []} | more


DOCS = [
    # a stamped folder, an application whose name comes from its file, a trade name that agrees
    doc(1, "Harbor Foods LLC 02_11_2026/APP.pdf", "application", "APP form", company_source="filename", dba="Harbor Cafe", fields_found=3),
    doc(2, "Harbor Foods LLC 02_11_2026/1.pdf", company="Zed Bank", holder_name="Zed Bank"),
    # a stamped folder and one stray name: the folder's own name
    doc(3, "Cedar Tools Inc 03-04-26/1.pdf", company="Huntington Footer"),
    # a plain folder and one stray name: the name that was read
    doc(4, "January/1.pdf", company="Summit Works"),
    # a folder of two companies that aren't its own: no lead of its own
    doc(5, "Mixed Files/1.pdf", company="River One LLC"), doc(6, "Mixed Files/2.pdf", company="Lake Two LLC"),
    # a folder of two other names where a trade name agrees: one lead, called by it
    doc(7, "Polar Group/1.pdf", company="Alpha One"), doc(8, "Polar Group/2.pdf", company="Beta Two", dba="Polar Ice"),
    # a loose file with the folder's name joins it; a form that reads nothing stands alone
    doc(9, "loose.pdf", company="HARBOR FOODS, INC."), doc(10, "x.pdf", "application"),
    # all applications are duplicates: the first is the lead's, whatever was read of the others
    doc(11, "a.pdf", "application", "Mono Co", duplicate_of=99, fields_found=2, owner="First Lee", phones=["1"], emails=["a@x.org"], address="1 Main St, Austin, TX 78753"),
    doc(12, "b.pdf", "application", "Mono Co", duplicate_of=11, fields_found=8, owner="Second Lee", phones=["2"]),
    doc(13, "c.pdf", company="MONO, CO.", dba="Mono Bar", address="2 Main St, Austin, TX 78753", duplicate_of=98),
    # a duplicate and a contact sheet before the form
    doc(14, "d.pdf", "application", "Trio Inc", duplicate_of=15, fields_found=8, owner="Dup", phones=["7"]),
    doc(15, "e.pdf", "application", "Trio Inc", kind="contact_sheet", fields_found=8, owner="Sheet", phones=["8"]),
    doc(16, "f.pdf", "application", "Trio, Inc.", fields_found=1, owner="Form", dba="Trio Shop", address="5 Oak Ave, Reno, NV 89501", phones=["8", "9"]),
    doc(17, "g.pdf", company="Trio Inc", dba="trio shop", address="5 Oak Avenue, Reno, NV 89501-1234"), doc(18, "h.pdf", company="Trio Inc", address=None),
]


@pytest.fixture(scope="module")
def keyed(spark):
    return G.merge_same_address(G.lead_keys(spark.createDataFrame([tuple(d.values()) for d in DOCS], SCHEMA).repartition(3))).cache()


@pytest.fixture(scope="module")
def lead_of(keyed):
    return {r["doc_id"]: r["lead_id"] for r in keyed.collect()}


def test_names(keyed, lead_of):
    leads = {r["lead_id"]: r for r in G.lead_facts(keyed).collect()}

    def name(no):
        return leads[lead_of[no]]["company_name"]

    assert [name(i) for i in (1, 3, 4, 5, 6, 7, 10)] == ["Harbor Cafe", "Cedar Tools Inc", "Summit Works", "River One LLC", "Lake Two LLC", "Polar Ice", "Unassociated"]
    assert lead_of[9] == lead_of[1] == lead_of[2] and lead_of[7] == lead_of[8] and lead_of[10] == "unassociated:10"
    assert (leads[lead_of[11]]["owner_name"], leads[lead_of[14]]["owner_name"]) == ("First Lee", "Form")


def test_contacts(keyed, lead_of):
    got = sorted((r["lead_id"], r["kind"], r["value"]) for r in G.lead_contacts(keyed).collect())
    assert got == sorted([(lead_of[11], "phone", "1"), (lead_of[11], "email", "a@x.org"), (lead_of[16], "phone", "8"), (lead_of[16], "phone", "9")])


def test_company_info(keyed, lead_of):
    got = {r["lead_id"]: r for r in G.company_info(keyed).collect()}
    mono, trio = got[lead_of[11]], got[lead_of[16]]
    assert (mono["name_count"], mono["dba_count"], mono["address_count"], mono["name_differs"], mono["dba_differs"], mono["address_differs"]) == (1, 1, 1, False, False, True)
    assert (trio["name_count"], trio["dba_count"], trio["address_count"], trio["name_differs"], trio["dba_differs"], trio["address_differs"]) == (1, 1, 1, False, False, False)
    assert got[lead_of[4]]["name_differs"] is False and got[lead_of[10]]["name_count"] == 0


def test_positions_in_order_without_a_setting(spark):
    rows = [(f"l{i:03}", float(i % 7), i % 3, f"Name {i % 5}") for i in range(300)]
    d = spark.createDataFrame(rows, "lead_id string, revenue double, score int, company_name string").repartition(7)
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], r[3].lower(), r[0]))]
    assert [r["lead_id"] for r in G.numbered(d).orderBy("position").collect()] == want


def test_newest_statements_keep_few_rows_before_they_are_dealt(spark):
    rows = [doc(i, f"{i}.pdf", company="Hot Co", period_end=f"2026-{i % 12 + 1:02}-28" if i % 5 else None, reconciles=[True, False, None][i % 3], total_deposits=i / 4, status=["complete", "needs_review", "queued"][i % 7 % 3]) for i in range(400)]
    keyed = spark.createDataFrame([tuple(d.values()) for d in rows], SCHEMA).withColumn("lead_id", F.lower("company"))
    newest = G.newest_statements(keyed, 6)
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()  # six rows of each task at most are dealt
    want = sorted((d for d in rows if d["status"] != "queued"), key=lambda d: d["arrival_no"])
    want = sorted(want, key=lambda d: d["period_end"] or "", reverse=True)
    assert [r["doc_id"] for r in newest.orderBy("place").collect()] == [d["doc_id"] for d in want[:6]]
    assert G.newest_statements(keyed).count() == len(want)


def test_cells_of_the_sheet(spark, keyed, lead_of):
    positions = spark.createDataFrame([(17, "Kapitus", 100.4), (18, "OnDeck", 7.0), (18, "Kapitus", 50.2), (13, "FundX", 9.0)], "doc_id long, funder string, monthly_burden double")
    got = {r["lead_id"]: r for r in G.results_sheet(G.lead_facts(keyed), keyed, positions).collect()}
    trio, mono = got[lead_of[16]], got[lead_of[11]]
    assert len(trio) == 17 and (trio["owner"], trio["phone"], trio["email"], trio["address"], trio["mca"]) == ("Form", "8 • 9", None, "5 Oak Ave, Reno, NV 89501", "Kapitus • $151/mo · OnDeck • $7/mo")
    assert trio["statements"] == "g.pdf • — • — • not proven · h.pdf • — • — • not proven"
    assert (mono["phone"], mono["email"], mono["mca"], mono["statements"], mono["duplicates_excluded"]) == ("1", "a@x.org", None, None, 3)
    assert lead_of[10] not in got


def test_numbers_and_labels(spark):
    d = spark.range(1)
    row = d.select(*[G.plain_number(F.lit(x)).alias(f"n{i}") for i, x in enumerate((100.0, 1234.5, 0.25, 0.0))], G.display_list(F.array(F.lit(" "), F.lit(None)), F.lit(True)).alias("l"), G.display_money(F.lit(-2.5), F.lit(False)).alias("m"), G.short_period(F.lit(None).cast("string"), F.lit("2026-01-31")).alias("p")).first()
    assert tuple(row) == ("100", "1234.5", "0.25", "0", ["OCR failed"], "$-2", "01/31/2026")
