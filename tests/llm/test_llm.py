"""The training-data operators against brute force on small tables, with nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquilt.llm import common, decontaminate, embeddings, hmm, jaccard, licenses, packing, quality, sharding, suffixes, warc

SF = "/root/testdata/sf0.001"


def texts_with_copies(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(120))
    out: list[str | None] = [None, "", "one", "Two words", " \t\n"]
    for _ in range(n):
        w = [word() for _ in range(rng.randint(3, 250))]
        out.append(" ".join(w))
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = "zzz"
            out.append(" ".join(w))
        if rng.random() < 0.2:
            out.append(" ".join(w[:50]) + " " + passage + " " + word())
        if rng.random() < 0.2:
            out.append(out[-1])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts_with_copies(1, 120)
    rows = [(i, x, "en", "src0", len(x or "")) for i, x in enumerate(t)] + [(None, t[7], None, None, None), (8, t[8], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"slot": F.lit(1), "row": F.lit("x"), "spans": F.lit(2), "key": F.lit(None).cast("string")}).cache()


def empty(df):
    return df.where("false")


# 3: sharding


def test_sharding_is_exact_and_uniform(spark, docs):
    out = sharding.shard_uniform(docs.repartition(5), 4, cell_rows=20).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(out) == docs.count()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sorted(x["row"] for x in out["row"]) == ["x"] * len(out)
    assert sharding.shard_uniform(empty(docs), 4).count() == 0


def test_matrix_rows_add_up():
    before, room = np.array([0, 10, 10, 37, 100]), np.array([25, 25, 25, 25])
    m = np.array([sharding.matrix_row(before, room, p, 3) for p in range(4)])
    assert m.sum(0).tolist() == room.tolist() and m.sum(1).tolist() == np.diff(before).tolist()
    rng = np.random.default_rng(0)
    draws = [sharding._wide_draw(rng, 3_000_000_000, 1_000_000_000, 1_000_000) for _ in range(200)]
    assert abs(np.mean(draws) - 750_000) < 5 * 433 / 14


# 9: packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_best_fit_is_valid_and_bounded(lengths):
    n = np.array(lengths)
    bins, offsets, free = packing.best_fit(n, 50)
    least = packing.dual_bound(n, 50)
    assert least <= len(free)
    for b in range(len(free)):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == np.cumsum([0, *n[at][:-1]]).tolist()
        assert n[at].sum() + free[b] == 50


def test_packing_places_every_piece(spark, docs):
    out = packing.pack(docs, capacity=64, bucket_rows=30, keep_ids=True).toPandas()
    encode = packing.Encoder()
    whole = collections.Counter(tuple(encode(r.text).tolist()) for r in docs.collect())
    seqs = out.groupby("sequence_id")
    for _, g in seqs:
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() <= 64
    assert out.length.sum() == sum(len(k) * v for k, v in whole.items())
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(out.ids, out.ids_crc32))
    best = packing.best_fit(out.length.to_numpy(np.int64), 64)[2]
    assert packing.dual_bound(out.length.to_numpy(np.int64), 64) <= len(seqs) <= 1.01 * len(best) + 1
    assert packing.pack(empty(docs)).count() == 0


def test_ids_are_those_of_the_tokenizer():
    encode = packing.Encoder()
    for t in ["", "Hello wörld ñandú\n\n  x", "a<|endoftext|>b", "日本語 🙂" * 5, " " * 50]:
        assert encode(t).tolist() == [*encode.whole.encode(t, add_special_tokens=False).ids, 0]


# 2: licences


def test_license_sequences(spark):
    mit = "Permission is here.\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, None), (3, ""), (4, "MIT License\n\n" + mit), (5, "licensed under cc by-nc 4.0. Released under the MIT License!"), (6, "a licence of sorts"), (None, "SPDX-License-Identifier: MIT")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("licenses", F.lit("clash"))
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert got == {1: "Apache-2.0", 2: "", 3: "", 4: "MIT", 5: "CC-BY-NC-4.0,MIT", 6: "", None: "MIT"}
    assert licenses.scan_licenses(empty(df)).count() == 0


PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "// SPDX-License-Identifier: BSD-3-Clause",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}


def test_published_texts_are_recognised(spark):
    rows = [(i, name, text) for i, (name, text) in enumerate(PUBLISHED.items())]
    rows += [(100 + i, name, text.replace("\n", "\r\n")) for i, name, text in rows]
    df = spark.createDataFrame(rows, "doc_id int, name string, text string")
    got = {r.doc_id: (r.name, r.licenses) for r in licenses.scan_licenses(df).join(df.select("doc_id", "name"), "doc_id").collect()}
    assert {i: b for i, (a, b) in got.items() if a != b and i < 100} == {}


def test_every_sentence_has_an_anchor():
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())
    assert {n for _, seq in licenses.RULES for n in seq} <= set(licenses.SENTENCES)


def test_license_sql(spark):
    from compare import connect, differences

    assert differences(licenses.op2_license_scan(spark, SF), licenses.oracle(), connect(SF)) == ""


# 5: WARC


def test_warc_round_trip(spark):
    x = "x" * 200
    rows = [(1, "u", x), (None, "v", x), (1, "a", x), (3, None, None), (None, "q", "y" * 150), (2, "b c\n", x), (4, "z é", "x" * 99), (5, "z", "x" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(0))
    stage = common.Stage(spark, "t")
    index = warc.write_archives(df, stage)
    records = warc.read_records(index, f"{stage.root}/archives")
    out = warc.resolve(records).toPandas()
    assert len(out) == len(rows)
    assert sorted(out[out.record_type == "revisit"].refers_to) == [1, 1, 1]
    whole = out[out.record_type == "response"]
    assert sorted(len(p) for p in whole.payload) == [0, 99, 99, 150, 200]
    assert all(hashlib.sha256(p).hexdigest() == d for p, d in zip(whole.payload, whole.payload_digest))
    some = warc.read_records(index.where("page_id = 4"), f"{stage.root}/archives").collect()
    assert len(some) == 1 and some[0].payload == b"x" * 99
    i = index.where("page_id = 3").first()
    raw = open(f"{stage.root}/archives/{i.archive}".removeprefix("file://"), "rb").read()[i.offset : i.offset + i.length]
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n") and base64.b32decode("A" * 8)
    assert warc.read_records(warc.write_archives(empty(df), common.Stage(spark, "t")), "file:///tmp").count() == 0


# 6: embeddings


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 6))
    v = np.vstack([base, base[:10] + 0.1 * rng.normal(size=(10, 6)), base[:5], np.zeros((1, 6))]).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (62, [float("nan")] * 6), (63, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link_embeddings(df).collect()}
    u = v.astype(float)[:55] / np.linalg.norm(v.astype(float)[:55], axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    f = embeddings.Forest(55)
    for i, j in zip(*np.nonzero(link)):
        f.join(int(i), int(j))
    for i in range(55):
        assert got[i] == (link[i].sum(), f.find(i), f.find(i) == i)
    assert all(got[i] == (0, i, True) for i in (55, 60, 61, 62, 63))
    assert embeddings.link_embeddings(empty(df)).count() == 0


@pytest.mark.parametrize("leaf", [1, 20, 1 << 16])
def test_dual_traversal(monkeypatch, leaf):
    monkeypatch.setattr(embeddings, "LEAF_PAIRS", leaf)
    rng = np.random.default_rng(leaf)
    for _ in range(15):
        d = int(rng.integers(2, 8))
        x = embeddings.unit(np.vstack([rng.normal(size=(int(rng.integers(1, 90)), d)), np.ones((1, d)) + 0.1 * rng.normal(size=(6, d))]))
        y = embeddings.unit(np.vstack([rng.normal(size=(int(rng.integers(1, 90)), d)), x[:2]]))
        a, b = embeddings.CoverTree(x), embeddings.CoverTree(y)
        assert sorted(zip(*embeddings.dual_pairs(a, b, 0.9))) == sorted(zip(*np.nonzero(x @ y.T >= 0.9)))
        p, q = embeddings.dual_pairs(a, a, 0.9)
        assert sorted((min(s), max(s)) for s in zip(p, q)) == sorted(zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1))))


# 7: Jaccard join


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    f = embeddings.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                f.join(i, j)
    label = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            label[f.find(i)] = min(label.get(f.find(i), doc), doc)
    return [(len(s), label.get(f.find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, num, den, classes", [(4, 85, 100, None), (5, 4, 5, ((2, 2), (5, 3)))])
def test_jaccard_equals_brute_force(spark, docs, monkeypatch, n, num, den, classes):
    if classes:
        monkeypatch.setattr(jaccard, "CLASSES", classes)
        monkeypatch.setattr(jaccard, "CHUNK", 2000)
        monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(zip(rows, brute_components(rows, n, num, den)), key=str)
    got = jaccard.shingle_links(docs, n_words=n, num=num, den=den).join(docs.select("doc_id", "text", *jaccard._row_keys()).distinct(), ["d1", "d2"]).select(docs.doc_id, "text", "n_shingles", "component_id").collect()
    assert sorted(((tuple(r[:2]), tuple(r[2:])) for r in got), key=str) == want
    kept = jaccard.drop_near_copies(docs, n_words=n, num=num, den=den)
    assert kept.columns == docs.columns
    with_words = {c for (_, t), (s, c) in want if s}
    alone = sum(1 for _, (s, _) in want if not s)
    assert kept.count() == len(with_words) + alone
    assert jaccard.shingle_links(empty(docs)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_signatures_never_miss_a_pair(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 260))
    x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.07], rng.integers(0, 2**63, int(size * 0.05), dtype=np.uint64)]))
    kind_of = dict(zip(x.tolist(), rng.choice([0, 1, 2, 3], len(x), p=[0.2, 0.1, 0.3, 0.4] if seed % 2 else [0.9, 0.1, 0, 0]).tolist()))
    shared = set(np.intersect1d(x, y).tolist())

    def sign(tokens):
        tokens = jaccard.candidates(tokens, 4, 5)
        kind = [jaccard.UNCOUNTED if o >= jaccard.counted_share(4, 5) else max(kind_of.get(t, 0), int(t in shared)) for t, o in zip(tokens.tolist(), jaccard.order_of(tokens))]
        return jaccard.Signatures(4, 5)(size_of, tokens, np.array(kind, np.uint8))

    if 5 * len(shared) >= 4 * (len(x) + len(y) - len(shared)):
        size_of = len(x)
        a = sign(x)
        size_of = len(y)
        assert len(np.intersect1d(a, sign(y)))


@pytest.mark.parametrize("num, den", [(4, 5), (85, 100), (76, 100)])
def test_prefixes_fit_into_their_sets(num, den):
    assert all(jaccard.most_needed(n, num, den) <= n for n in [*range(1, 3000), 10**5, 10**6])


def test_signatures_grow_with_the_set():
    rng = np.random.default_rng(4)
    for n in (1000, 50_000):
        tokens = jaccard.candidates(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), 4, 5)
        assert len(jaccard.Signatures(4, 5)(n, tokens, np.full(len(tokens), 3, np.uint8))) < 3 * n


# 4: suffix arrays


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_prefixes(symbols):
    t = np.array([*symbols, 0], np.int16)
    text = t.tolist()
    want = sorted(range(len(text)), key=lambda i: text[i:])
    sa = suffixes.suffix_array(t)
    assert sa.tolist() == want
    before, shared = suffixes.permuted_prefixes(t, sa)
    for a, b in zip(want, want[1:]):
        n = next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), len(text))
        assert before[b] == a and shared[b] == n


def brute_cut(rows, length):
    data = [(t or "").encode() for t in rows]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), len(suffixes.runs(gone)), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("variants", [16_384, 1])
def test_repeats_equal_brute_force(spark, docs, monkeypatch, variants):
    monkeypatch.setattr(suffixes, "NARROW", (16, 4, 1))
    monkeypatch.setattr(suffixes, "MOST_VARIANTS", variants)
    monkeypatch.setattr(suffixes, "CHUNK", 3000)
    rows = docs.select("text").collect()
    out = suffixes.cut_repeats(docs, length=100).select("row.text", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.begin)").alias("gone"), F.size("spans").alias("n"), "kept").collect()
    want = sorted(zip([r.text for r in rows], brute_cut([r.text for r in rows], 100)), key=str)
    assert sorted(((r.text, (r.n_bytes, r.gone, r.n, bytes(r.kept))) for r in out), key=str) == want
    assert suffixes.drop_repeats(docs, length=100).columns == docs.columns
    assert suffixes.cut_repeats(empty(docs)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=80))
def test_reduced_strings_are_sorted_by_induction(symbols):
    t = [*symbols, 0]
    assert suffixes._induced(np.array(t), 4).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_cuts_keep_whole_characters(spark):
    rng = random.Random(2)
    shared = "".join(rng.choices("éÅ日本🙂\ufffd a", k=90))
    rows = ["\ufffdAé" + shared + "\ufffd end\u0085", "Ã" + shared + "ß" + shared, "own \ufffd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = [r.text for r in suffixes.drop_repeats(df, length=60).orderBy("doc_id").collect()]
    assert got == ["\ufffdAé\ufffd end\u0085", "Ãß", "own \ufffd"]


def test_long_uniform_texts_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_VARIANTS", 500)
    texts = ["a" * 5_000_000, "ab" * 1000, "".join(random.Random(1).choices("abcd", k=900))]
    copies = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit(texts[2]).alias("text"))
    df = copies.union(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate([*texts[:2], "a" * 399, "own", None])], "doc_id long, text string"))
    got = suffixes.cut_repeats(df.repartition(6)).select("row.doc_id", F.length("kept").alias("n"), F.size("spans").alias("spans")).collect()
    assert {(r.n, r.spans) for r in got if r.doc_id < 10_000} == {(0, 1)}
    assert {r.doc_id: (r.n, r.spans) for r in got if r.doc_id >= 20_000} == {20_000: (0, 1), 20_001: (0, 1), 20_002: (399, 0), 20_003: (3, 0), 20_004: (0, 0)}


def brute_word_cut(rows, length, n):
    """Kept bytes under both rules: strings of ``length`` bytes and runs of ``n`` words that also start elsewhere."""
    data = [(t or "").encode() for t in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    runs = [[tuple(b[x:y].lower() for x, y in s[i : i + n]) for i in range(len(s) - n + 1)] for b, s in zip(data, spans)]
    seen = collections.Counter(r for rs in runs for r in rs)
    strings = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b, s, rs in zip(data, spans, runs):
        gone = np.zeros(len(b), bool)
        for i, r in enumerate(rs):
            if seen[r] > 1:
                gone[s[i][0] : s[i + n - 1][1]] = True
        for i in range(len(b) - length + 1):
            if strings[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_pipeline_cuts_passages_of_over_50_short_words(spark, monkeypatch):
    import corpus_pipeline as P

    monkeypatch.setattr(suffixes, "CHUNK_WORDS", 300)
    rng = random.Random(8)
    own = lambda k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))
    rows: list[str | None] = [None, "", "la " * 70]
    passages = {n: " ".join("".join(rng.choices("ijklmnop", k=3)) for _ in range(n)) for n in (50, 51, 52, 55, 60)}
    for p in passages.values():
        assert len(p) < 400
        rows += [f"{own(rng.randint(5, 400))} {p} {own(20)}", f"{own(rng.randint(5, 90))}\n{p.upper()}\t{own(3)}", p + " " + own(9)]
    rows += [own(60)] * 2 + [own(700)] * 2
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.repeated_passages(spark, df.repartition(3), SF).collect()}
    assert got == {i: None if t is None else k.decode() for i, (t, k) in enumerate(zip(rows, brute_word_cut(rows, 400, 51)))}
    for n, p in passages.items():
        assert sum(p in (t or "").lower() for t in got.values()) == (3 if n == 50 else 0)


# 1: decontamination


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40))).capitalize() + "? " + " ".join(word() for _ in range(6))) for i in range(30)] + [(30, None), (31, ""), (2, "short one")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(5, 400))]
        if i % 5 == 0:
            at = rng.randrange(len(body))
            body[at:at] = ["###" + items[i % 30][1].replace(" ", "  ").upper() + "***"]
        if i % 7 == 3:
            body.append(items[i % 30][1].split("?")[0])  # the question without its answer
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame([*docs, (99, None), (98, ""), (None, items[1][1])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(i, i % 30) for i in range(0, 60, 5)} | {(None, 1)}
    left = decontaminate.drop_leaks(df, bench)
    assert left.count() == df.count() - 13 and left.columns == df.columns
    assert decontaminate.find_leaks(df, empty(bench)).count() == 0
    assert decontaminate.find_leaks(empty(df), bench).count() == 0


@pytest.mark.parametrize("n_answer", [3, 4, 6, 12, 28])
def test_leaks_with_one_word_changed_in_each_part_are_found(n_answer):
    rng = random.Random(n_answer)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    parts = [([word() for _ in range(rng.randint(16, 60))], [word() for _ in range(n_answer)]) for _ in range(20)]
    texts = [" ".join(q) + ". " + " ".join(a) for q, a in parts]
    df = collections.Counter(w for t in texts for w in set(decontaminate.terms_of(t)))
    index = decontaminate.Index(texts, len(texts), df, 40.0)
    around = lambda k: " ".join(word() for _ in range(k))
    for i, (q, a) in enumerate(parts):
        q2, a2 = list(q), list(a)
        q2[rng.randrange(len(q))], a2[rng.randrange(len(a))] = word(), word()
        assert set(index.leaks(f"{around(90)} {' '.join(q2)}. {' '.join(a2)} {around(rng.randint(0, 90))}")) == {i}
        assert not index.leaks(f"{around(90)} {' '.join(q2)}. {around(n_answer)}")


def test_search_finds_all_above_the_threshold():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab, rng.integers(3, 15))) for _ in range(50)]
    df = collections.Counter(w for t in texts for w in set(decontaminate.terms_of(t)))
    index = decontaminate.Index(texts, 50, df, 9.0)
    for _ in range(200):
        terms = np.unique(rng.integers(0, len(index.vocabulary), rng.integers(1, 25)))
        scores = np.zeros(50)
        for t in terms:
            scores[index.items[t]] += index.impacts[t]
        bound = index.bounds(np.zeros(len(terms), np.int64), terms, 1)[0]
        got = index.search(terms.tolist(), bound, 0.5)
        assert {i for i, _ in got} == set(np.flatnonzero(scores >= 0.5 - 1e-9).tolist())
        assert all(s == pytest.approx(scores[i]) for i, s in got)


# 8: language model


def test_forward_and_counts_equal_brute_force():
    rng = np.random.default_rng(0)
    m = hmm.Model.random(np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS), 1)
    m.move = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    texts = [rng.integers(0, hmm.SYMBOLS, n) for n in (5, 3, 3, 1)]
    got, _, _ = hmm.forward(m, *hmm.by_time(texts), keep=False)
    for t, g in zip(texts, got):
        a = m.start * m.emit[t[0]]
        for x in t[1:]:
            a = (a @ m.move) * m.emit[x]
        assert g == pytest.approx(np.log10(a.sum()))
    start, move, emit = hmm.expected_counts(m, texts)
    assert start.sum() == pytest.approx(4) and move.sum() == pytest.approx(5 + 3 + 3 + 1 - 4) and emit.sum() == pytest.approx(12)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, 50, 40) + (50 if k % 2 else 0), hmm.END) for k in range(40)]
    freq = np.bincount(np.concatenate(texts), minlength=hmm.SYMBOLS) + 0.5
    freq = freq / freq.sum()
    m = hmm.Model.random(freq, 2)
    last = -np.inf
    for _ in range(6):
        now = sum(hmm.forward(m, *hmm.by_time([texts[i] for i in c]), keep=False)[0].sum() for c in hmm.batches_of(texts))
        assert now >= last - 1e-6
        last, m = now, hmm.Model.fitted(*hmm.expected_counts(m, texts), freq, weight=1e-3)


def test_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(hmm, "TABLE", 50)
    rows = docs.select("doc_id", "text").collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c = collections.Counter(w for (d, _), ws in zip(rows, tokens) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(ws), sum(w in c for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, _), ws in zip(rows, tokens))
    got = hmm.score_texts(docs).toPandas()
    have = sorted((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert [x[:5] for x in have] == [x[:5] for x in want] and np.allclose([x[5] for x in have], [x[5] for x in want], atol=1e-5)
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert hmm.score_texts(empty(docs)).count() == 0


# 10: quality


def test_isotonic_is_the_least_squares_fit():
    w, y = np.array([1.0, 1, 1, 2]), np.array([1.0, 3, 2, 1])
    assert quality.isotonic(w, w * 0 + y).tolist() == pytest.approx([1.0, 1.5, 1.5, 1.5])


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.op10_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95 and out.score.between(0, 1).all()
    assert docs.count() == 1000


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, 0), (8, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(docs, empty(labels)).where("score <> 0.5").count() == 0
    assert quality.score_quality(empty(docs), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert len(quality.statistics("x" * 100_000 + " y")) == quality.WIDTH


# Components and the pipeline


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (None, 1)]
    f = embeddings.Forest(201)
    for a, b in edges:
        if a is not None:
            f.join(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in common.components(common.Stage(spark, "cc"), df).collect()}
    assert got == {i: f.find(i) for e in edges for i in e if i is not None and e[0] is not None and e[0] != e[1]}


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    stage, docs = common.Stage(spark, "p"), spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, f) in enumerate(P.STAGES):
        docs = stage.write(f(spark, docs, sf), str(k))
        seen.append(docs)
        if k < 4:
            assert docs.columns == seen[0].columns
    good, single, cut, clean, packed = (d.collect() for d in seen[1:])
    rows = sorted((r.doc_id, r.text) for r in good)
    comp = brute_components(rows, 5, 4, 5)
    assert sorted(r.doc_id for r in single) == sorted(d for (d, _), (s, c) in zip(rows, comp) if not s or c == d)
    order = sorted(single, key=lambda r: r.doc_id)
    want = {r.doc_id: b.decode("utf-8", "ignore") for r, b in zip(order, brute_word_cut([r.text for r in order], 400, 51))}
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean} <= {r.doc_id for r in cut}


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    numbered = {m.group(1) for n in names if (m := re.match(r"op(\d+)_", n))}
    assert numbered == {str(n) for n in range(1, len(numbered) + 1)} and len(numbered) >= 10 and "pipeline" in names
