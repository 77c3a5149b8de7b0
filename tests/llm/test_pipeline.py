"""The pipeline against its stages done by hand, and the registered corpus queries."""

import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stationloom.llm import packing, quality, queries, token_count
from tests.llm.conftest import DOCS
from tests.llm.test_dedup import fingerprint, grouped_sets
from tests.llm.test_scan import PIECES, contamination_truth


def test_pipeline_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    net = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in left.items() if net.scores(pa.array([t]))[0] >= 0.3}
    left = {i: t for t, i in {t: i for i, t in sorted(left.items())}.items()}
    fps = {i: fingerprint(t) for i, t in left.items()}
    comp = grouped_sets(set(fps.values()), [(a, b) for a in set(fps.values()) for b in set(fps.values()) if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for i in sorted(fps):
        first.setdefault(comp[fps[i]], i)
    left = {i: left[i] for i in first.values()}
    clean = {r[0] for r in contamination_truth(list(left.items()), items) if not r[5]}
    model = token_count._processor(PIECES)
    want = sorted((i, k, min(packing.MAX_LENGTH, len(model.encode(left[i])) + 1 - k * packing.MAX_LENGTH))
                  for i in clean for k in range(-(-(len(model.encode(left[i])) + 1) // packing.MAX_LENGTH)))
    found = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["part"], r["length"]) for r in found.collect()) == want
    assert 0 < len(clean) < docs.count()


@pytest.mark.parametrize("pairs", [[], None])
def test_stages_take_odd_and_empty_tables(spark, sf, make_docs, odd_pairs, pairs):
    docs = make_docs(odd_pairs if pairs is None else pairs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema == DOCS, name
        assert set(out.select("doc_id").collect()) <= set(docs.select("doc_id").collect())
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0) == (pairs is None)


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n in queries.QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
