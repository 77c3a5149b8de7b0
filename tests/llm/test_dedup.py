"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stationloom.llm import buckets, components, exact_dedup, repeated, simhash, substring_dedup
from tests.llm.conftest import alnum_words, space_words


def grouped_sets(n, edges):
    sets = components.UnionFind()
    for a, b in edges:
        sets.union(a, b)
    return {x: sets.find(x) for x in n}


# exact dedup


def exact_truth(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(make_docs, odd_pairs):
    found = exact_dedup.exact_dedup(make_docs(odd_pairs))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == exact_truth(odd_pairs)


def test_exact_dedup_of_nothing(make_docs):
    assert exact_dedup.exact_dedup(make_docs([])).collect() == []
    assert exact_dedup.drop_exact_copies(make_docs([])).collect() == []


def test_chunks_join_to_the_text(spark):
    rng = random.Random(3)
    texts = ["", "a", "b" * 9000, "\n" * 2000, " ".join(rng.choice(["on a", "the", "x\n", "zz"]) for _ in range(20_000)), "é🙂" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.chunk_list(F.col("text")).alias("c"))
    for r in df.collect():
        assert "".join(r["c"]) == r["text"]
        assert all(len(c) <= exact_dedup.MOST + exact_dedup.LEAST for c in r["c"])


def test_chunks_are_cut_by_content(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["river", "stone", "once upon a time", "light", "sea"]) for _ in range(5000))
    df = spark.createDataFrame([(text,), ("inserted " + text,)], "text string").select(exact_dedup.chunk_list(F.col("text")).alias("c"))
    a, b = (set(r["c"]) for r in df.collect())
    assert len(a & b) > 0.5 * len(a)


def test_identifiers_survive_colliding_hashes(make_docs, odd_pairs, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)))
    found = exact_dedup.exact_dedup(make_docs(odd_pairs))
    assert sorted(map(tuple, found.collect()), key=str) == exact_truth(odd_pairs)


def test_dropping_exact_copies_keeps_columns(make_docs, odd_pairs):
    docs = make_docs(odd_pairs)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.schema == docs.schema
    want = sorted({(r[0], r[4]) for r in exact_truth(odd_pairs) if r[3]}, key=str)
    assert sorted([(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()], key=str) == want


# SimHash


def fingerprint(text):
    words = space_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts += np.array([h >> k & 1 for k in range(64)])
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def simhash_truth(pairs):
    fps = [fingerprint(t) for _, t in pairs]
    edges = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 3]
    comp = grouped_sets(set(fps), edges)
    least = {}
    for (i, _), f in zip(pairs, fps, strict=True):
        c = comp[f]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted([(i, f"{f:016x}", least[comp[f]]) for (i, _), f in zip(pairs, fps, strict=True)], key=str), comp


def test_simhash_matches_brute_force(make_docs, odd_pairs):
    found = simhash.simhash_dedup(make_docs(odd_pairs)).drop("text_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == simhash_truth(odd_pairs)[0]


def test_simhash_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = simhash.simhash_dedup(docs).drop("text_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == simhash_truth(pairs)[0]


def test_simhash_stage_keeps_one_of_each_component(make_docs, odd_pairs):
    docs = make_docs(odd_pairs)
    kept = simhash.drop_near_copies(docs)
    assert kept.schema == docs.schema
    rows, comp = kept.collect(), simhash_truth(odd_pairs)[1]
    seen = [comp[fingerprint(r["text"])] for r in rows]
    assert sorted(seen) == sorted(set(comp.values()))
    by = defaultdict(list)
    for i, t in odd_pairs:
        by[comp[fingerprint(t)]].append(i)
    for r, c in zip(rows, seen, strict=True):
        assert r["doc_id"] == min((i for i in by[c] if i is not None), default=None)


def test_simhash_of_nothing(make_docs):
    assert simhash.simhash_dedup(make_docs([])).collect() == []
    assert simhash.drop_near_copies(make_docs([])).collect() == []


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_close_fingerprints_link_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(block)
    fps = {rng.getrandbits(64) for _ in range(200)}
    dense = rng.getrandbits(64)
    for _ in range(150):  # a large group of near copies
        fps.add(dense ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))))
    for f in list(fps)[:40]:
        fps.add(f ^ sum(1 << k for k in rng.sample(range(64), 3)))
    signed = [(n, f - (1 << 64) if f >> 63 else f) for n, f in enumerate(sorted(fps))]
    found = simhash.simhash_components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    comp = grouped_sets(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    names = {f: n for n, f in enumerate(sorted(fps))}
    want = {f: min(names[x] for x in fps if comp[x] == comp[f]) for f in fps} if block == 40 else None
    got = {r["fp"] % (1 << 64): r["component_id"] for r in found}
    if want is None:
        least = {}
        for f in fps:
            least[comp[f]] = min(least.get(comp[f], names[f]), names[f])
        want = {f: least[comp[f]] for f in fps}
    assert got == want


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
    p = simhash.reference_fingerprints()
    ta, tb = simhash.pivot_table(a, p), simhash.pivot_table(b, p)
    assert np.abs(ta - tb).max() <= 3
    c = rng.permutation(a)
    assert (np.abs(ta - simhash.pivot_table(c, p)).max(axis=1) > 3).mean() > 0.99


# helpers


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_random_graphs(spark, kind):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(80)]
    edges = [(f"{a:05d}", f"{b:05d}") if kind == "string" else (a, b) for a, b in edges]
    found = components.components(spark.createDataFrame(edges, f"x {kind}, y {kind}"))
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["component"] for r in found.collect()} == grouped_sets(nodes, edges)
    assert found.count() == len(nodes)


def test_no_edges_no_components(spark):
    assert components.components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_groups_stay_whole_across_batches():
    table = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    got = [t.column("v").to_pylist() for t in buckets.grouped(iter(table.to_batches(max_chunksize=2)), ["k"])]
    assert sum(got, []) == list(range(6))
    assert all(set(table["k"].to_pylist()[a] for a in g).isdisjoint(table["k"].to_pylist()[b] for b in h) for g in got for h in got if g is not h)


# passages


def passage_truth(pairs, size):
    """Ids of documents that share a run of ``size`` words with another id."""
    where = defaultdict(set)
    for i, t in pairs:
        w = alnum_words(t)
        for k in range(len(w) - size + 1):
            where[tuple(w[k : k + size])].add(i)
    return {i for ids in where.values() if len(ids) > 1 for i in ids}


def test_passages_of_over_50_words_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(docs).collect()}
    assert passage_truth(pairs, 50) <= found


def word_stream(seed, n):
    rng = random.Random(str(seed))
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}" for _ in range(n)]


def test_pasted_and_edited_passages(make_docs):
    passage = word_stream("p", 55)
    line = word_stream("l", 120)
    edited = [*line[:60], "changed", *line[61:]]
    pairs = [
        (1, " ".join(word_stream(1, 80) + passage + word_stream(2, 70))),
        (2, "\n".join([" ".join(word_stream(3, 40)), " ".join(passage)])),
        (3, " ".join(passage[:25]) + " " + " ".join(word_stream(4, 60))),
        (4, "head\n" + " ".join(line) + "\ntail"), (5, " ".join(edited)), (6, " ".join(word_stream(6, 300))),
        (7, " ".join(["same"] * 400)), (None, None), (8, ""), (9, "\n\n"),
    ]
    rows = substring_dedup.repeated_passages(make_docs(pairs)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert set(by) == {1, 2, 4, 5}
    assert by[1]["kept"] and by[1]["keep_id"] == 1 and not by[2]["kept"] and by[2]["keep_id"] == 1
    assert by[4]["kept"] and not by[5]["kept"] and by[5]["keep_id"] == 4
    assert by[5]["first_word"] == 0 and by[5]["n_words"] == 120
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(make_docs(pairs), substring_dedup.repeated_passages(make_docs(pairs))).collect()}
    assert cut[1] == pairs[0][1] and cut[5] == "" and cut[6] == pairs[5][1] and len(cut[2]) < len(pairs[1][1])


def shared_words(pairs, size):
    """Per id, words in a run of ``size`` words that stands in another id too, split by whether it stands in a smaller one."""
    where = defaultdict(set)
    runs = [(i, k, tuple(w[k : k + size])) for i, t in pairs for w in [alnum_words(t)] for k in range(len(w) - size + 1)]
    for i, _, r in runs:
        where[r].add(i)
    out = defaultdict(set)
    for i, k, r in runs:
        if len(where[r]) > 1:
            out[i, min(where[r]) == i].update(range(k, k + size))
    return out


def test_runs_of_30_words_are_found_in_full(make_docs):
    pairs = []
    for k in range(12):
        passage = word_stream(("q", k // 2), 30 + k // 2 * 7)
        pairs.append((k, " ".join(word_stream(("h", k), 50 + k) + passage + word_stream(("t", k), 40))))
    pairs.append((20, " ".join(alnum_words(pairs[10][1])[20:90] + word_stream("z", 9) + alnum_words(pairs[0][1])[30:75])))
    docs = make_docs(pairs)
    passages = substring_dedup.repeated_passages(docs)
    got = defaultdict(set)
    for r in passages.collect():
        got[r["doc_id"], r["kept"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert got == shared_words(pairs, 30)
    cut = {r["doc_id"]: alnum_words(r["text"]) for r in substring_dedup.remove_repeats(docs, passages).collect()}
    assert cut[1] == word_stream(("h", 1), 51) + word_stream(("t", 1), 40)


def test_short_lines_are_compared(make_docs):
    line = word_stream("s", 29)
    pairs = [(1, "first\nOne two three four five.\nend"), (2, "one, two three FOUR five\nother words here"), (3, "one two three four"),
             (4, "a b\n" + " ".join(line)), (5, " ".join(line[:28])), (6, "one two three four"), (7, "one two three four six")]
    rows = substring_dedup.repeated_passages(make_docs(pairs)).collect()
    assert sorted((r["doc_id"], r["first_word"], r["n_words"], r["keep_id"], r["kept"]) for r in rows) == [
        (1, 1, 5, 1, True), (2, 0, 5, 1, False), (4, 2, 29, 4, True), (5, 0, 28, 4, False)]


def test_passages_of_odd_rows(make_docs, odd_pairs):
    rows = substring_dedup.repeated_passages(make_docs(odd_pairs)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in rows) == [(6, 6, True), (7, 6, False), (8, 6, False)]
    assert substring_dedup.repeated_passages(make_docs([])).collect() == []


def test_line_links_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", 4)
    rng = random.Random(9)
    base = [word_stream(("b", k), 60) for k in range(4)]
    lines = []
    for k in range(60):
        w = list(base[k % 4])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        lines.append(" ".join(w))
    lines = sorted(set(lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    nodes, links = substring_dedup.line_links(docs)
    name = {r["low"]: r["node"] for r in nodes.collect()}
    found = grouped_sets(name.values(), [tuple(r) for r in links.collect()])
    sets = [substring_dedup._shingle_set(t.encode()) for t in lines]
    pairs = [(name[a], name[b]) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert found == grouped_sets(name.values(), pairs)


@pytest.mark.parametrize("runs", [3, 4096])
def test_stretches_that_overlap_or_repeat(make_docs, monkeypatch, runs):
    monkeypatch.setattr(substring_dedup, "STRETCH_RUNS", runs)
    a, b, c = word_stream("a", 90), word_stream("b", 45), word_stream("c", 33)
    pairs = [(k, " ".join(w)) for k, w in enumerate([
        a, a, a[10:60], a[30:] + b, b + a[:50], b + c + b, word_stream("d", 20) + c + a[55:90], a, c + c, word_stream("e", 80)])]
    pairs += [(3, " ".join(word_stream("f", 9) + a[5:40])), (12, "x y z " * 40), (13, "x y z " * 30), (None, " ".join(c))]
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(make_docs(pairs)).collect():
        got[r["doc_id"], r["kept"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    lowest = -1
    truth = shared_words([(lowest if i is None else i, t) for i, t in pairs], 30)
    assert {(lowest if i is None else i, kept): w for (i, kept), w in got.items()} == truth


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_filters_of_repeated_keys(spark, monkeypatch, most):
    monkeypatch.setattr(repeated, "GATHERED", most)
    rng = np.random.default_rng(4)
    once, twice, hot = rng.integers(-(1 << 63), (1 << 63) - 1, 3000), rng.integers(-(1 << 63), (1 << 63) - 1, 200), 7
    keys = [*once.tolist(), *twice.tolist(), *twice.tolist(), *[hot] * 500]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k1 long").repartition(5)
    twice = np.append(twice, hot)
    (only,) = repeated.repeated_keys(df, repeated._first_key, 1)
    assert only.value.passes(twice).all() and only.value.passes(once).mean() < 0.02
    assert repeated.key_filter(df).value.passes(once).all()
    none = repeated.key_filter(df.limit(0)).value
    assert not none.passes(once).any()
    monkeypatch.setattr(repeated, "FILTER_BYTES", 30)
    assert repeated.key_filter(df) is None


def test_texts_that_share_nothing_leave_no_rows(make_docs):
    docs = make_docs([(k, " ".join(word_stream(("u", k), 120))) for k in range(40)])
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS row")
    seeds, buckets = repeated.repeated_keys(docs.select("text"), substring_dedup._seeds_and_buckets, 2)
    (runs,) = repeated.repeated_keys(docs.select("text"), substring_dedup._run_keys(seeds), 1)
    nodes, links = substring_dedup.line_links(docs, buckets)
    assert not nodes.count() and not links.count() and not substring_dedup.shared_runs(rows, seeds, runs).count()
