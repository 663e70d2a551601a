"""The pipeline's stages on a small corpus."""

from __future__ import annotations

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from evidentia.llm import langid, simhash, toxicity
    from evidentia.llm.common import stored
    from tests.llm.test_ops import brute_components, brute_fingerprint, brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "line_dedup", "simhash_near_dedup", "packing"]
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF), "t")
        assert after.columns == docs.columns
        seen[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()})
        before = after
    full, kept = seen["language_id"]
    assert set(kept) == {i for i, t in full.items() if any(map(str.isalpha, t))} and langid.UNKNOWN == "und"
    full, kept = seen["toxicity"]
    insults = ("idiot", "moron", "scum", "trash", "pathetic", "stupid")
    assert not any(w in t.lower().split() for t in kept.values() for w in insults) or len(kept) < len(full)
    assert toxicity.MAX_ROWS == 4000
    full, kept = seen["line_dedup"]
    want = brute_lines(sorted(full.items()))
    assert kept == {i: t for i, t in want.items() if t.strip() or t == full[i]}
    full, kept = seen["simhash_near_dedup"]
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in full.items()])
    assert set(kept) == set(groups.values()) and simhash.DIRECT
    packed = corpus_pipeline.pack(spark, before, SF).collect()
    totals = Counter()
    for r in packed:
        totals[r.doc_id] += r.length
    assert set(totals) == set(kept) and all(totals[r.doc_id] == r.doc_tokens for r in packed)


def test_language_rejects_only_on_enough_bytes(spark, monkeypatch):
    from evidentia.llm import langid

    rows = [(1, "Re.", 0.3, "en"), (2, "x" * 400, 0.3, "en"), (3, "x" * 400, 0.36, "en"), (4, "x" * 400, 0.9, "en"), (5, "12", 0.0, "und"), (6, None, 0.0, "und"), (7, "", 0.0, "und"), (8, "é" * 32, 0.25, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s double, l string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: docs)
    monkeypatch.setattr(langid, "train", lambda *a, **k: None)
    monkeypatch.setattr(langid, "predict", lambda d, m: d.selectExpr("*", "l as lang_pred", "s as lang_score"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == {1, 3, 4}  # 0.3 + 0.05, 0.25 + 0.125 lie below 0.4
