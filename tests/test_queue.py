"""The queue's rows and the diagnoses' sentences against values set down by hand."""

from ledgerspark.operators import queue as Q

STATUS = "doc_id long, arrival_no long, filename string, status string, attempts int, error string, error_message string"


def test_requeue(spark):
    s = spark.createDataFrame([(1, 1, "a.pdf", "stopped", 2, "scan_interrupted", "x"), (2, 2, "b.pdf", "failed", 3, "job_timeout", "y"), (3, 3, None, None, 1, "e", None)], STATUS)
    got = {r.doc_id: (r.status, r.attempts, r.error, r.error_message) for r in Q.requeue(s, "stopped").collect()}
    assert got == {1: ("queued", 0, None, None), 2: ("failed", 3, "job_timeout", "y"), 3: (None, 1, "e", None)}
    got = {r.doc_id: (r.status, r.attempts, r.error, r.error_message) for r in Q.requeue(s, "failed").collect()}
    assert got == {1: ("stopped", 2, "scan_interrupted", "x"), 2: ("queued", 0, None, None), 3: (None, 1, "e", None)}


def test_scan_order(spark):
    rows = [(1, 1, "x/January.pdf", "queued"), (2, 2, "x/Signed APPLICATION.pdf", "stopped"), (3, 3, "Applications/y.pdf", "queued"), (4, 4, "use_this_app.pdf", "complete"), (5, 5, None, "queued"), (6, 6, "a/Use_This_App.pdf", "queued"), (7, 0, "z.pdf", "queued")]
    s = spark.createDataFrame([(*r, 0, None, None) for r in rows], STATUS)
    claimed = spark.createDataFrame([(1,), (1,)], "doc_id long")
    assert [r.doc_id for r in Q.scan_order(s).orderBy("position").collect()] == [2, 6, 7, 1, 3, 5]
    assert [(r.position, r.doc_id) for r in Q.scan_order(s, claimed).orderBy("position").collect()] == [(0, 2), (1, 6), (2, 7), (3, 3), (4, 5)]
    assert Q.scan_order(s.limit(0)).count() == 0


FACTS = """doc_id long, lead_id string, status string, error_message string, duplicate_of long, doc_type string, kind string, needs_ocr boolean, used_ocr boolean, missing array<string>, company_source string,
 phone_count int, email_count int, opening double, ending double, deposits double, bank string, period_end string, account string, holder_name string, page_count int, scanned_page_count int, reconciles boolean, difference double, text_chars long"""
NAMES = [x.split()[0] for x in FACTS.replace("\n", " ").split(",")]
LEADS = "lead_id string, company_name string, has_application boolean, statement_count long"


def facts(spark, *rows):
    base = {"status": "complete", "doc_type": "bank_statement", "used_ocr": False, "needs_ocr": False, "missing": [], "lead_id": "a"}
    return spark.createDataFrame([tuple({**base, "doc_id": i, **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], FACTS)


WHOLE = {"opening": 1.0, "ending": 2.0, "deposits": 3.0, "bank": "Chase", "period_end": "2026-01-31", "account": "1", "holder_name": "Acme", "reconciles": True}
FORM = {"doc_type": "application", "lead_id": "b"}
FOUR = ["Company", "Owner", "Address", "Start date"]


def test_diagnoses(spark):
    d = facts(
        spark, WHOLE, {**WHOLE, "lead_id": "c", "used_ocr": True}, {**WHOLE, "bank": "", "ending": None, "page_count": 5, "scanned_page_count": 2, "reconciles": False, "difference": 2.5}, {"used_ocr": True, "page_count": 5, "scanned_page_count": 2},
        {**WHOLE, "needs_ocr": True}, {**WHOLE, "status": "ocr"}, {**WHOLE, "status": "failed", "error_message": ""}, {**WHOLE, "duplicate_of": 0, "status": "failed"}, {**WHOLE, "status": "stopped"}, {**WHOLE, "status": "skipped", "error_message": "why"},
        FORM, {**FORM, "missing": ["DOB"], "company_source": "filename", "used_ocr": True}, {**FORM, "missing": FOUR, "needs_ocr": True, "phone_count": 1}, {**FORM, "kind": "contact_sheet", "phone_count": 1, "email_count": 2, "lead_id": "a"},
        {"doc_type": "unknown", "text_chars": 7, "lead_id": None}, {**FORM, "missing": [*FOUR, "EIN", "DOB"]}, {**WHOLE, "reconciles": False},
    )
    leads = spark.createDataFrame([("a", "Acme", True, 1), ("b", "Blue", True, 0), ("c", "Coal", False, 1)], LEADS)
    got = {r.doc_id: (r.verdict, r.summary, r.company) for r in Q.diagnoses(d, leads).collect()}
    assert got == {
        0: ("good", "Bank, period, balances and deposits found; balances add up", "Acme"),
        1: ("good", "Bank, period, balances and deposits found; balances add up (read by OCR) · no application for this company", "Coal"),
        2: ("partial", "Read, but bank not recognised, no ending balance, read 2 of 5 pages, balances do not add up (Δ 2.5) -- revenue not proven", "Acme"),
        3: ("bad", "No balances or deposit total found — nothing to total — OCR read 2 of 5 pages; raise the OCR page limit and re-run (read by OCR)", "Acme"),
        4: ("bad", "Scanned image — no usable text layer, nothing read yet. Needs OCR", "Acme"),
        5: ("pending", "", "Acme"),
        6: ("bad", "Processing failed", "Acme"),
        7: ("excluded", "Duplicate of an already-scanned file — excluded from company totals", "Acme"),
        8: ("pending", "Stopped before it finished — restart to read it", "Acme"),
        9: ("excluded", "why", "Acme"),
        10: ("good", "All 8 application fields found · no statements matched to it", "Blue"),
        11: ("good", "Found 7 of 8 — missing DOB; company name not on the form, only in the filename (read by OCR) · no statements matched to it", "Blue"),
        12: ("bad", "Form labels only — the answers are not in this PDF's text (typed onto the page image, or printed apart from their labels). Needs OCR; 1 phone(s), 0 email(s) found so far", "Blue"),
        13: ("partial", "Contact list only — 1 phone, 2 emails; no application form in this file, so no owner, start date or address", "Acme"),
        14: ("bad", "Not recognised as a bank statement or an application (7 characters of text)", None),
        15: ("bad", "Found 2 of 8 — missing Company, Owner, Address, Start date, EIN, DOB", "Blue"),
        16: ("partial", "Read, but balances do not add up (Δ ?) -- revenue not proven", "Acme"),
    }


def test_ocr_candidates(spark):
    d = facts(spark, {"needs_ocr": True}, {"needs_ocr": True, "used_ocr": True}, {}, {**FORM, "missing": FOUR}, {**FORM, "missing": FOUR[:3], "needs_ocr": True}, {**FORM, "missing": [*FOUR, "EIN"], "kind": "contact_sheet"}, {**FORM, "missing": FOUR, "used_ocr": True}, {"needs_ocr": None})
    assert sorted(r.doc_id for r in Q.ocr_candidates(d).collect()) == [0, 3]
    t = facts(spark, *[{"scanned_page_count": a, "page_count": b} for a, b in [(2, 5), (5, 5), (0, 5), (None, 5), (2, None), (2, 0)]])
    assert [r.t for r in t.select(Q.truncated(t).alias("t"), "doc_id").orderBy("doc_id").collect()] == [True, False, False, False, False, False]
