from __future__ import annotations

import corpus_pipeline
from test_models import plain_statistics, plain_verdicts
from test_simhash import components, plain_fingerprint
from test_tokens import check_packing

from tidemark.llm.common import materialise


def test_stages_over_the_whole_table(spark, sf_dir, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == documents.columns
    rows = {name: {r["doc_id"]: r["text"] for r in frame.collect()} for name, frame in list(seen.items())[:-1]}
    before = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(not plain_statistics(t)[5] for t in rows["quality_rules"].values())
    sound = [i for i, t in before.items() if not plain_statistics(t)[5]]
    verdicts = {i: v[2] for i, v in plain_verdicts([(r["doc_id"], r["lang"], r["text"]) for r in documents.collect()]).items() if len(v) > 2}
    assert rows["quality_rules"].keys() == {i for i in sound if verdicts[i]}
    groups = components({i: plain_fingerprint(t) for i, t in rows["quality_rules"].items()})
    assert rows["near_duplicates"].keys() == {i for i, root in groups.items() if i == root}
    assert rows["personal_data"].keys() == rows["near_duplicates"].keys()
    assert rows["source_mixing"].items() <= rows["personal_data"].items()
    packed = seen["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == rows["source_mixing"].keys()
    check_packing(packed, [r["length"] for r in packed])


def test_stages_on_odd_rows(spark, odd, none, sf_dir):
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf_dir), "odd")
        assert docs.count() >= 0
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, start, sf_dir).count()
