"""The lead store: whole batches only, nothing stale, old versions gone."""

from __future__ import annotations

import os

import pytest

from ledgerspark.operators import leads as G
from ledgerspark.streaming import jobs

from .test_leads import DOCS, SCHEMA


def leads_of(df):
    return sorted(str(r.asDict()) for r in df.collect())


def test_store_keeps_whole_batches(spark, tmp_path, monkeypatch):
    keyed = G.merge_same_address(G.lead_keys(spark.createDataFrame([tuple(d.values()) for d in DOCS], SCHEMA)))
    late = keyed.where("doc_id in (2, 18)").collect()
    rows = [keyed.where(f"doc_id % 3 = {i} and doc_id not in (2, 18)") for i in range(3)]
    source, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))

    def add(df):
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = jobs.stream_leads(stream, store, state, parts=4).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(ValueError):
        jobs.read_store(spark, store)
    for df in rows[:2]:
        add(df)
        run()
    before = leads_of(jobs.read_store(spark, store))
    facts = leads_of(jobs.read_store(spark, store, "facts"))
    assert before == leads_of(G.lead_facts(rows[0].unionByName(rows[1])))

    real = jobs.lead_facts
    monkeypatch.setattr(jobs, "lead_facts", lambda now: (_ for _ in ()).throw(RuntimeError("lost between the two writes")))
    add(rows[2])
    with pytest.raises(Exception, match="lost between the two writes"):
        run()
    assert leads_of(jobs.read_store(spark, store)) == before and leads_of(jobs.read_store(spark, store, "facts")) == facts

    monkeypatch.setattr(jobs, "lead_facts", real)
    run()
    add(spark.createDataFrame(late, keyed.schema))
    # a document again with another status: the last one counts
    run()
    add(keyed.where("doc_id = 3").selectExpr(*[("'failed' as status" if c == "status" else "arrival_no + 100 as arrival_no" if c == "arrival_no" else c) for c in keyed.columns]))
    run()
    changed = keyed.where("doc_id <> 3").unionByName(keyed.where("doc_id = 3").selectExpr(*[("'failed' as status" if c == "status" else "arrival_no + 100 as arrival_no" if c == "arrival_no" else c) for c in keyed.columns]))
    assert leads_of(jobs.read_store(spark, store)) == leads_of(G.lead_facts(changed))
    kept = {int(x) for x in os.listdir(f"{store}/data")}
    used = set(jobs._manifest(spark, store).values())
    assert used <= kept and len(os.listdir(f"{store}/manifests")) == 2 and len(kept) <= 5
