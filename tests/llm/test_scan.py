"""Token counts, classifier, decontamination, token files, packing, licences and URL rules against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from stationloom.llm import decontaminate, licences, packing, quality, queries, rans, token_count, token_file, url_filter
from stationloom.session import scratch_path
from tests.llm.conftest import alnum_words

PIECES, WORDS = queries.tokenizer_file(queries.PIECE_MODEL), queries.tokenizer_file(queries.WORD_MODEL)
TEXTS = [
    "", " ", "  ", "a  b", "a ", " a", "\n\na", "▁x ▁▁ y", "<s> </s> <unk> <0x0A>", "é́ e\u0301\u0000b", "🙂  🙂\t x", "   ", "a" * 5000,
    " " * 500 + "b", "a b  c\u3000d", "▁", "a▁ ", "<|startoftext|> A <|endoftext|>b", "İstanbul ΣΣ ’s it's 12 34", "x\u200by", "Zürich ſ Å\u0301",
]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# token counts


def test_token_counts_are_the_library_s(make_docs, odd_pairs):
    pairs = odd_pairs + [(100 + k, t) for k, t in enumerate(TEXTS)]
    model = token_count._processor(PIECES)
    want = []
    for i, t in pairs:
        n = len(model.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert rows_of(token_count.token_counts(make_docs(pairs), PIECES)) == sorted(want, key=str)
    assert token_count.token_counts(make_docs([]), PIECES).collect() == []


def test_remembered_pre_tokens_are_forgotten_in_time(monkeypatch):
    counter = token_count.TokenCounter(PIECES)
    monkeypatch.setattr(token_count, "REMEMBERED", len(counter.known) + 5)
    texts = [f"zq{k}x word{k}" for k in range(50)]
    assert [counter.count([t])[0] for t in texts] == [len(counter.model.encode(t)) for t in texts]


def test_single_tokens_are_proved():
    model = token_count._processor(PIECES)
    known = token_count.single_tokens(PIECES)
    assert len(known) > 1000
    assert all(len(model.encode(w[1:].replace("▁", " "))) == 1 for w in list(known)[::50])


def test_token_counts_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = token_count._processor(PIECES)
    for r in queries.op3_token_counts(spark, sf).collect():
        assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]]))


# classifier


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_quality(spark, sf).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 500
    assert np.mean([p == q for p, q in held]) > 0.97
    assert np.mean([p for p, q in held if q == 1]) > 0.99


def test_a_score_depends_on_its_own_text_only():
    rng = np.random.default_rng(0)
    net = quality.ByteNet.fresh(rng)
    texts = ["", "short", "x" * 127, "y" * 128, "z" * 129, "mixed words " * 700, None, "🙂" * 90]
    together = net.scores(pa.array(texts))
    assert np.allclose(together, [net.scores(pa.array([t]))[0] for t in texts], atol=1e-6)
    assert together[0] == pytest.approx(together[6])


def test_the_whole_text_counts():
    net = quality.train(["plain words here " * 20, "$$$ ### $$$ " * 20] * 20, np.array([1, 0] * 20), 0.0, epochs=8)
    good, tail = net.scores(pa.array(["plain words here " * 400, "plain words here " * 400 + "$$$ ### $$$ " * 200]))
    assert good > 0.8 and tail < good - 0.1


def test_pooling_is_a_plain_convolution_over_every_position():
    net = quality.ByteNet.fresh(np.random.default_rng(4))
    texts = ["", "ab", "x" * 127 + "yz", "".join(chr(33 + k * 7 % 90) for k in range(700)), "q" * 128, "end"]
    best, _ = net.pooled(*quality.blocks_of(*quality.raw_bytes(pa.array(texts)))[:1])
    row = 0
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        blocks = max(1, -(-len(data) // quality.BLOCK))
        padded = np.append(data, np.zeros(blocks * quality.BLOCK + quality.WIDTH - len(data), np.uint8))
        at = [sum(net.embedding[padded[p + k]] @ net.filters[k] for k in range(quality.WIDTH)) for p in range(blocks * quality.BLOCK)]
        want = np.array(at).reshape(blocks, quality.BLOCK, -1).max(axis=1)
        assert np.allclose(best[row : row + blocks], want, atol=1e-4)
        row += blocks


def test_a_text_beyond_the_bound_is_passed_over(spark, make_docs, monkeypatch):
    pairs = [(i, "long " * 3000 if i % 9 == 0 else f"text {i} " * 5) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality, "train", lambda texts, y, odds: seen.update(texts=texts, y=y))
    quality.fit(make_docs(pairs), labels, per_class=100, sample_bytes=10_000)
    assert len(seen["texts"]) > 100 and max(map(len, seen["texts"])) < 100 and set(seen["y"].tolist()) == {0, 1}


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = quality.ByteNet.fresh(rng)
    rows, before = quality.blocks_of(*quality.raw_bytes(pa.array(["some words " * 30, "other! " * 60, ""])))
    labels = np.array([1, 0, 1], np.float32)

    def loss():
        z = net.logits(rows, before).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - labels * z)

    for w, g in zip(net.weights(), net.gradients(rows, before, labels), strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.15, abs=1e-4)


def test_classifier_without_usable_labels(spark, make_docs, odd_pairs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    docs = make_docs(odd_pairs)
    net = quality.fit(docs, labels)
    scored = quality.quality_scores(docs, net).collect()
    assert len(scored) == len(odd_pairs) and all(r["score"] == 0.5 for r in scored)
    kept = quality.keep_good(docs, net)
    assert kept.schema == docs.schema and kept.count() == len(odd_pairs)
    assert quality.quality_scores(make_docs([]), net).collect() == []


def test_the_sample_is_bounded(spark, make_docs):
    pairs = [(i, ("good text " if i % 2 else "@@ ## ") * 50) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] * 2, "doc_id long, quality int")
    seen = {}
    real = quality.train
    try:
        quality.train = lambda texts, y, odds: seen.update(n=len(texts), size=sum(map(len, texts))) or real(texts, y, odds, epochs=1)
        quality.fit(make_docs(pairs), labels, per_class=20, sample_bytes=10_000)
    finally:
        quality.train = real
    assert 0 < seen["n"] <= 40 and seen["size"] <= 10_000


# decontamination


def contamination_truth(pairs, items):
    known = [(i, w) for i, t in items if i is not None and (w := alnum_words(t))]
    out = []
    for d, t in pairs:
        w, hit, found = alnum_words(t), set(), set()
        for item, x in known:
            size = min(10, len(x))
            grams = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "two Words"), (2, None), (3, "!!! ..."), (None, "no id at all"),
         (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (10, "Solo"), (5, "é 中文"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]


@pytest.mark.parametrize("most", [1000, 3])
def test_contamination_matches_brute_force(spark, make_docs, odd_pairs, most):
    pairs = odd_pairs + [
        (50, "x Alpha, beta. gamma\ndelta epsilon zeta eta theta iota kappa lambda mu nu"), (51, "alpha beta gamma delta epsilon zeta eta theta iota nu kappa"),
        (52, "two words two words solo"), (53, "two-words é 中文"), (54, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu two"),
    ]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(pairs)
    assert rows_of(decontaminate.contamination(docs, bench, most)) == contamination_truth(pairs, ITEMS)
    kept = decontaminate.drop_contaminated(docs, bench, most)
    assert kept.schema == docs.schema
    clean = [r[:1] for r in contamination_truth(pairs, ITEMS) if not r[5]]
    assert rows_of(kept.select("doc_id")) == sorted(clean, key=str)


def test_contamination_of_nothing(spark, make_docs, odd_pairs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(make_docs([]), bench).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.contamination(make_docs(odd_pairs), bench.limit(0)).collect())


# token files


@pytest.mark.parametrize("n,lanes,every", [(0, 4, 2), (1, 256, 256), (5, 4, 1), (1000, 7, 3), (70_000, 256, 16), (70_000, 256, 256), (64, 64, 256)])
def test_blocks_round_trip_whole_and_in_parts(n, lanes, every):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_000).astype(np.uint32)
    table = rans.FrequencyTable.from_counts(np.bincount(ids, minlength=49_408) if n else np.zeros(5))
    block = rans.encode(ids, table, lanes, every)
    assert np.array_equal(rans.decode(block, table), ids)
    parts = [rans.decode(block, table, k) for k in range(rans.checkpoints_of(block))] if n else []
    assert np.array_equal(np.concatenate(parts) if parts else np.empty(0), ids)
    if every == 256 and n > 1000:
        assert len(block) < 1.15 * n


def test_damage_and_foreign_tables_are_noticed():
    ids = np.arange(100, dtype=np.uint32) % 7
    table = rans.FrequencyTable.from_counts(np.bincount(ids))
    block = bytearray(rans.encode(ids, table))
    with pytest.raises(ValueError, match="another table"):
        rans.decode(bytes(block), rans.FrequencyTable.from_counts(np.array([5, 5, 5, 5, 5, 5, 6])))
    block[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(bytes(block), table)
    with pytest.raises(ValueError, match="know"):
        rans.encode(np.array([9]), rans.FrequencyTable.from_counts(np.array([1] * 9 + [0])))


def test_frequencies_fill_the_slots():
    for counts in ([1], [1, 10**12], [0, 3, 0, 5], list(range(1000))):
        f = rans.FrequencyTable.from_counts(np.array(counts)).frequency
        assert f.sum() == 1 << rans.PRECISION and all((a > 0) == (b > 0) for a, b in zip(f, counts, strict=True))


def token_truth(pairs):
    tokenizer = token_file._tokenizer(WORDS)
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in pairs]


@pytest.mark.parametrize("block", [50, 1 << 18])
def test_token_files_hold_the_library_s_ids(spark, make_docs, odd_pairs, block, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_IDS", 20_000)
    pairs = odd_pairs + [(100 + k, t) for k, t in enumerate(TEXTS)]
    folder = scratch_path(spark, "t")
    token_file.write_token_files(make_docs(pairs), folder, WORDS, block_ids=block)
    rows = token_file.read_token_files(spark, folder).collect()
    got = sorted([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows], key=str)
    assert got == sorted(token_truth(pairs), key=str)
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert order == sorted(order)


def test_plain_pieces_are_the_model_s():
    file = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_file.Encoder(file)
    assert encoder.plain
    rng = random.Random(6)
    signs = "abcdefghijklmnopqrstuvwxyzABCé0123456789.,;:!?*&%$#|()<>'\"[]{}~^_`@/+-=\x7f\x01\u0301"
    texts = [" ".join("".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(30)) for _ in range(300)]
    texts += ["it's they'll a.b,c 12.5 x<|endoftext|>y <|startoftext|> don't 'twas ``q'' e-mail@host.org http://a.b/c?d=1"]
    learnt, encoder._learn = [], lambda pieces, learn=encoder._learn: (learnt.extend(pieces), learn(pieces))
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert learnt and not [p for p in learnt if token_file._PLAIN.fullmatch(p) and p.isalnum()]


def test_token_file_query(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, at = [], 0
    for d, ids in token_truth(docs):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op6_token_files(spark, sf).collect())) == want


def test_token_files_of_nothing(spark, make_docs):
    folder = scratch_path(spark, "t")
    token_file.write_token_files(make_docs([]), folder, WORDS)
    assert token_file.token_digest(token_file.read_token_files(spark, folder)).collect() == []


# packing


def padding_of(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 50) for _ in lengths]
        k = rng.randint(1, 5)
        bounds = packing.optimal_boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding_of(lengths, counts, (*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert len(bounds) <= k and padding_of(lengths, counts, bounds) == best


@pytest.mark.parametrize("salt_rows", [3, 50_000])
def test_packing_places_every_token_once(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(packing, "SALT_ROWS", salt_rows)
    rng = random.Random(2)
    pairs = [(k, rng.choice([0, 3, 50, 99, 100, 250, 1001])) for k in range(300)] + [(None, 5), (None, 5), (7, 3), (8, None)]
    rows = packing.pack(spark.createDataFrame(pairs, "doc_id long, n_tokens long"), max_length=100, buckets=4, batch_tokens=350).collect()
    want = sorted(((d, k, k * 100, min(100, (n or 0) + 1 - k * 100)) for d, n in pairs for k in range(-(-((n or 0) + 1) // 100))), key=str)
    assert sorted(((r["doc_id"], r["part"], r["first_token"], r["length"]) for r in rows), key=str) == want
    hist = np.bincount([r["length"] for r in rows])
    bounds = packing.optimal_boundaries(np.flatnonzero(hist), hist[hist > 0], 4)
    groups = {}
    for r in rows:
        assert r["bucket_length"] == bounds[r["bucket"]] == min(b for b in bounds if b >= r["length"])
        assert r["padding"] == r["bucket_length"] - r["length"]
        groups.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), own in groups.items():
        per = 350 // bounds[bucket]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == per or batch == max(b for x, b in groups if x == bucket)
        assert len(own) * bounds[bucket] <= 350


def test_packing_of_nothing(make_docs, odd_pairs):
    assert packing.pack_documents(make_docs([]), PIECES).collect() == []
    rows = packing.pack_documents(make_docs(odd_pairs), PIECES).collect()
    model = token_count._processor(PIECES)
    assert sum(r["length"] for r in rows) == sum(len(model.encode(t or "")) + 1 for _, t in odd_pairs)


# licences


def test_rules_need_their_order(make_docs):
    s = licences.SENTENCES
    mit = [s["j"].upper() + ":", s["k"].capitalize() + ".", s["l"] + "."]
    pairs = [
        (1, "Intro. " + " ".join(mit)), (2, "\n".join(mit[::-1])), (3, f"{mit[0]}\nA.\nB.\n{mit[1]}\n{mit[2]}"), (4, f"{mit[0]}\nA.\nB.\nC.\n{mit[1]}\n{mit[2]}"),
        (5, "Text.\nLicensed   under the Apache-License, Version 2.0.\nAll rights reserved."), (6, "see Released under the MIT License here"), (7, None), (8, ""),
        (9, "Released under the MIT License"), (9, "Released under the MIT License"), (None, "nothing"),
    ]
    rows = {(r["doc_id"], k): r for k, r in enumerate(sorted(licences.scan_licences(make_docs(pairs)).collect(), key=lambda r: r["doc_id"] or 0))}
    got = sorted((i or 0, r["licences"], r["restricted"]) for (i, _), r in rows.items())
    assert got == [(0, "", False), (1, "mit-text", False), (2, "", False), (3, "mit-text", False), (4, "", False), (5, "apache-2.0,proprietary", True), (6, "", False),
                   (7, "", False), (8, "", False), (9, "mit", False), (9, "mit", False)]
    assert licences.scan_licences(make_docs([])).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_notices_are_found_as_they_are_wrapped(make_docs):
    texts = [APACHE, MIT, BSD, GPL]
    commented = ["\n".join(f" * {line}".rstrip() for line in t.split("\n")) for t in texts]
    windows = [t.replace("\n", "\r\n") for t in texts]
    odd = ["Copyright 2020 Someone\n\n" + t + "\n\nEnd" for t in texts]
    pairs = list(enumerate(texts + commented + windows + odd)) + [(90, MIT.replace("charge", "fee")), (91, GPL.split("\n\n")[0])]
    got = {r["doc_id"]: (r["licences"], r["restricted"]) for r in licences.scan_licences(make_docs(pairs)).collect()}
    want = [("apache-2.0,apache-2.0-notice", False), ("mit-text", False), ("bsd-2-clause,bsd-3-clause", False), ("gpl-3.0-or-later", True)]
    assert [got[k] for k in range(16)] == want * 4
    assert got[90] == got[91] == ("", False)


# URL rules


def url_truth(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_rules_match_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.net", "example.net", "x.example.net", "NET", "notexample.com", "example.com", "deep.sub.example.com", "b.org", "org", "fr.org", "", "::", "a.b.c.d.e.net"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/fr/?q=/de/", "#/en/", "?x://y/", "/EN/", "/en/a/b#c"]
    urls = [f"{s}{h}{p}" for s in ("http://", "//", "x://") for h in hosts for p in paths] + [None, "", "://", "no scheme", "a://b://c/en/"]
    rules = url_filter.RULES + [url_filter.Rule(f"h{k}.com", f"/p{k % 3}/", "block") for k in range(50)]
    urls += [f"http://{rng.choice(['', 'w.'])}h{rng.randrange(80)}.com/p{rng.randrange(4)}/x" for _ in range(400)]
    pages = spark.createDataFrame([(k, u, "html", "clash") for k, u in enumerate(urls)] + [(0, urls[0], "html", "clash")], "page_id long, url string, html string, rule string")
    got = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=str)
    want = sorted([(k, *url_truth(u, rules)) for k, u in enumerate(urls)] + [(0, *url_truth(urls[0], rules))], key=str)
    assert got == want
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_cascades_are_exact_over_their_universe(spark):
    keys = [(f"key{k}",) for k in range(20_000)]
    listed = {f"key{k}" for k in range(0, 20_000, 9)} | {"outside"}
    universe = spark.createDataFrame(keys, "key string")
    cascade = url_filter.build_cascade(universe, spark.createDataFrame([(k,) for k in listed], "key string"))
    rows = universe.select("key", *url_filter.hashed(url_filter.F.col("key"))).toPandas()
    inside = cascade.contains(rows["h1"].to_numpy(), rows["h2"].to_numpy())
    assert (inside == rows["key"].isin(listed).to_numpy()).all()
    assert len(cascade.levels) > 2


def test_a_filter_that_is_too_large_is_refused(spark):
    keys = spark.createDataFrame([(f"k{k}",) for k in range(5000)], "key string")
    with pytest.raises(MemoryError):
        url_filter.build_cascade(keys, keys, most_bytes=100)
