"""The manifest against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stationloom.llm import merkle
from tests.llm.conftest import DOCS, NONE, lower


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def measured(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    """Root, and the siblings of every leaf level by level."""
    level, place, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, p in enumerate(place):
            run = level[p - p % fanout : p - p % fanout + fanout]
            paths[k].append((p % fanout, run[: p % fanout] + run[p % fanout + 1 :]))
        level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        place = [p // fanout for p in place]
    return level[0], paths


def truth(rows, fanout, tampered):
    leaf = lambda i, t, lang: h(*map(measured, (i, "s", lang, None if t is None else len(t), t)))
    trees = {}
    for i, t, lang in rows:
        was = leaf(i, t, lang)
        now = leaf(i, lower(t) if t is not None else None, lang) if tampered(i) else was
        trees.setdefault(lang, []).append(((i is not None, i or 0), was, now, i))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    subs = {}
    for k in order:
        trees[k].sort(key=lambda r: r[:2])
        subs[k] = tree([r[1] for r in trees[k]], fanout)
    root, tops = tree([subs[k][0] for k in order], fanout)
    out = []
    for k, top in zip(order, tops, strict=True):
        for (_, was, now, i), path in zip(trees[k], subs[k][1], strict=True):
            path = path + top
            x = now
            for at, others in path:
                x = h(*others[:at], x, *others[at:])
            out.append((i, was, subs[k][0], root, h(*(o for _, others in path for o in others)), x, x == root))
    return sorted(out, key=str)


def tampered_with(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("siblings").collect()), key=str)


def manifest(docs, **sizes):
    altered = F.when(merkle.is_tampered_with(F.col("doc_id")), merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.merkle_manifest(docs, altered, **sizes)


@pytest.fixture(scope="module")
def in_languages(odd_pairs):
    """Odd rows, and languages of 1 to 45 documents, one of them null and one empty."""
    langs = {"a": 45, "": 9, None: 7, "zz": 1, "ä": 2, "b": 3, "c": 1, "d": 1, "e": 1, "f": 28}
    rows, i = [(k, t, "en") for k, t in odd_pairs], 100
    for lang, n in langs.items():
        for _ in range(n):
            i += 1
            rows.append((i, f"Text {i % 7}", lang))
    rows += [(150, "Same", "f")] * 4
    return rows


@pytest.mark.parametrize("fanout,block_levels", [(2, 1), (3, 1), (8, 4)])
def test_manifest_is_the_tree_s(in_languages, spark, fanout, block_levels):
    rows = [(i, t, lang, "s", None if t is None else len(t), *NONE) for i, t, lang in in_languages]
    found = manifest(spark.createDataFrame(rows, DOCS).repartition(3), fanout=fanout, block_levels=block_levels)
    assert rows_of(found) == truth(in_languages, fanout, tampered_with)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 26, 27, 28, 55, 82])
def test_butterfly_of_uneven_trees(spark, n):
    nodes = spark.createDataFrame([("t", k, n, h(str(k))) for k in range(n)], "_tree string, _index long, _n long, _root string")
    root, paths = tree([h(str(k)) for k in range(n)], 3)
    found = merkle.butterfly(nodes, 3).collect()
    assert {r["_root"] for r in found} == {root}
    assert {r["_index"]: [(s["at"], s["others"]) for s in r["_path"]] for r in found} == dict(enumerate(paths))


def test_siblings_prove_a_leaf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = merkle.merkle_manifest(docs).collect()
    assert len(rows) == docs.count() and all(r["verified"] for r in rows)
    assert all(r["proof_sha256"] == h(*(x for level in r["siblings"] for x in level)) for r in rows)
    changed = {r["doc_id"] for r in manifest(docs).filter("not verified").select("doc_id").collect()}
    assert changed == {r["doc_id"] for r in docs.collect() if tampered_with(r["doc_id"]) and lower(r["text"]) != r["text"]}


def test_empty_table(make_docs):
    assert manifest(make_docs([])).collect() == []
