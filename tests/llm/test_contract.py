"""The registered queries against DuckDB, and the pipeline against a brute-force version."""

from __future__ import annotations

import pytest

pytest.importorskip("vecloom.llm")
from tests.llm import test_operators as brute  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402
from vecloom.llm import oracle, packing, queries, simhash, toxicity  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_equals_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), oracle.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows(spark, sf_dir, name):
    table = "embeddings" if name.startswith("op8") else "documents"
    wanted = queries.table(spark, sf_dir, table).count()
    key = "vec_id" if name.startswith("op8") else "doc_id"
    found = queries.QUERIES[name](spark, sf_dir)
    if name.startswith("op10"):
        assert found.where("piece = 0").count() == wanted
    else:
        assert found.count() == wanted
    assert found.select(key).distinct().count() == wanted


def test_pipeline_equals_brute_force(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    kept = brute.brute_verdicts(rows)
    left = {i: t for i, t, *_ in rows if kept[i]}
    stage = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in stage.collect()} == set(left)
    model = toxicity.train(stage, toxicity.learnable(queries.table(spark, sf_dir, "labels")))
    left = {i: t for i, t in left.items() if model.score(t) < 0.7}
    components = brute.brute_components({i: brute.brute_fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if components[i] == i}

    def masked(text):
        out, at = "", 0
        for a, b in sorted((a, b) for a, _, _, b in brute.brute_secrets(text) + brute.brute_entropy(text)):
            if a > at or at == 0:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    ids = {i: [*brute.library_ids(masked(t)), 2] for i, t in left.items()}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    parts = {}
    for r in found:
        parts.setdefault(r["doc_id"], {})[r["piece"]] = r
    assert set(parts) == set(ids)
    for i, own in parts.items():
        assert sum(r["length"] for r in own.values()) == len(ids[i])
        for r in own.values():
            assert r["ids_crc32"] == brute.crc(ids[i][r["start"] : r["start"] + r["length"]])
    histogram = {}
    for r in found:
        histogram[r["length"]] = histogram.get(r["length"], 0) + 1
    assert len({r["sequence_id"] for r in found}) <= packing.lower_bound(histogram, 1024) + 2
    assert simhash.BITS == 64
