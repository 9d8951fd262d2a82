from collections import Counter

import corpus_pipeline
from keystrata.llm import decontaminate, hilbert, mixing, near_dup, toxicity


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, items = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, small).cache()
        assert after.columns == docs.columns, name
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(now, labels).collect() if not r.predicted}
        elif name == "near_dedup":
            want = {r.doc_id for r in near_dup.near_duplicates(now).collect() if r.doc_id == r.class_id}
        elif name == "decontamination":
            want = {r.doc_id for r in now.collect()} - {r.doc_id for r in decontaminate.leaks(now, items).collect()}
        if name != "mixing":
            got = [r.doc_id for r in after.collect()]
            assert len(got) == len(set(got)) and set(got) == want
        else:
            got = Counter(r.doc_id for r in after.collect())
            assert all(got[r.doc_id] * r["size"] == r.taken for r in mixing.mix(now).collect())
        counts.append(after.count())
        now = after
    assert counts[0] > counts[1] > counts[2] > counts[3]
    last = corpus_pipeline.run(spark, small)
    want = hilbert.hilbert_shards(now)
    assert last.columns == want.columns and last.count() == counts[-1]
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect()))
