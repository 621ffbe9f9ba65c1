"""Application forms: answers worked out by hand."""

from __future__ import annotations

import pytest

from ledgerspark.operators import applications

# text, and the fields it must give (others are null)
FORMS = [
    ("Owner Name: Credit Score", {}),
    ("Owner Name: Date of Birth:\nAnn Lee", {"owner": "Ann Lee"}),
    ("Owner Name: Ann Lee 123", {}),
    ("Owner Information\nName: Ann B. Lee", {"owner": "Ann B. Lee"}),
    ("Business Start Date: 2011-01-05", {"start_date": "01/05/2011"}),
    ("Business start date under\ncurrent ownership\nFeb 27, 2022", {"start_date": "02/27/2022"}),
    ("Business Name: Blue River Doing Business As Blue Cafe", {"company": "Blue River"}),
    ("Your Full Name: Kim Lee", {"owner": "Kim Lee"}),
    ("Business Name: DBA: Mobile Number:", {}),
    ("Business Name:\nDBA:\nAcme LLC", {}),
    ("DBA Business Name: Wrong\nLegal/Corporate Name - Acme Tools, Inc.", {"company": "Acme Tools, Inc."}),
    ("Company Name: later\nLegal Company Name: First One LLC", {"company": "First One LLC"}),
    ("Owner Information" + "\nrow 1:" * 15 + "\nname kim lee", {}),
    ("Owner Information" + "\nrow 1:" * 14 + "\nname kim lee", {"owner": "kim lee"}),
    ("Name of bank: First Bank\nname\nKim Lee", {"owner": "Kim Lee"}),
    ("First Name: Joe   Last Name: Ray\nDOB: 3/4/31", {"owner": "Joe Ray", "dob": "03/04/31"}),
    ("Guarantor Name: Owner #2: Max Ray  Title: CEO", {"owner": "Max Ray"}),
    ("Date of Birth: March 3, 62", {}),
    ("Date of Birth: March 3\nx\n1962", {"dob": "03/03/62"}),
    ("Date of Birth: 1962-03-04 0:00:00", {"dob": "03/04/62"}),
    ("Birth Date\nSSN: 1\n01/02/1960", {"app_date": "01/02/1960"}),
    ("Date Established: Monday, May 6, 2019", {"start_date": "05/06/2019"}),
    ("Business Address: 1 Main St City: Austin State: TX Zip Code: 78701", {"address": "1 Main St, Austin, TX 78701"}),
    ("Business Address: 1 Main St\nCity: Austin\nState: tx\nZip: 78701-0001", {"address": "1 Main St, Austin, TX 78701-0001"}),
    ("Business Address: City: State: Zip Code:", {}),
    ("City: Reno State: ZZ Zip: 12", {"address": "Reno"}),
    ("Authorizations\nDate of Birth 1/1/1960\nDate Signed: 2024-2-10", {"dob": "01/01/60", "app_date": "02/10/2024"}),
    ("date\n3/4/24" + "\nx1" * 5 + "\nAuthorization\nSigned on\nnothing\n5/6/24", {"app_date": "05/06/2024"}),
    ("Authorization" + "\nx1" * 60 + "\nDate: 5/6/24", {}),
    ("", {}),
    (None, {}),
]
NAMES = ("company", "owner", "dob", "start_date", "app_date", "address")


@pytest.fixture(scope="module")
def read(spark):
    docs = spark.createDataFrame([(i, t, "app.pdf", "clash") for i, (t, _) in enumerate(FORMS)], "doc_id int, raw_text string, filename string, company string").repartition(3)
    return {r["doc_id"]: r for r in applications.extract_application(docs).collect()}


@pytest.mark.parametrize("no", range(len(FORMS)))
def test_forms(read, no):
    got = {n: read[no][n] for n in NAMES if read[no][n] is not None}
    assert got == FORMS[no][1], FORMS[no][0]


def test_every_document_keeps_its_row(read):
    assert len(read) == len(FORMS) and read[0]["any_company"] is None and read[10]["any_company"] == "Acme Tools, Inc."
