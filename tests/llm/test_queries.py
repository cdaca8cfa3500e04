"""The queries themselves against brute force on the smallest tables, and what must not depend on how rows are dealt."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from skyquilt.llm import common, hmm, jaccard, packing, queries

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_shards_hold_every_row_once(spark):
    docs = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    out = queries.QUERIES["op3_hypergeometric_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs) and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    for r in out:
        b = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_every_cell_of_the_shuffle_is_as_likely(spark):
    """Over many seeds a row falls into each shard, and into each half of its slots, equally often."""
    from skyquilt.llm.sharding import matrix_row

    before, room = np.array([0, 7, 20, 24]), np.array([6, 6, 6, 6])
    mean = np.mean([[matrix_row(before, room, p, seed) for p in range(3)] for seed in range(3000)], axis=0)
    want = np.diff(before)[:, None] * room[None] / 24
    assert np.abs(mean - want).max() < 0.12


def test_records_equal_the_pages(spark):
    pages = {r.page_id: (r.html or "").encode() for r in read(spark, "pages").collect()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    out = queries.QUERIES["op5_indexed_warc"](spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        b = pages[r.page_id]
        again = len(b) >= 100 and first[b] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[b]) if again else ("response", None))


def test_base_scores_and_known_words(spark):
    docs = {r.doc_id: (r.text or "") for r in read(spark, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*t.encode().lower().split(), None] for d, t in docs.items()}
    c = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    out = queries.QUERIES["op8_hidden_markov_model"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, abs(r.base_score))
    # States tell the languages apart, so texts that were not seen are likelier than by single words.
    unseen = [r for r in out if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_scores_are_a_distribution():
    """The probabilities of all sequences of a length add up to one."""
    m = hmm.Model.random(np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS), 1)
    rng = np.random.default_rng(0)
    m.move, m.emit = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), np.zeros((hmm.SYMBOLS, hmm.STATES))
    m.emit[:3] = rng.dirichlet(np.ones(3), hmm.STATES).T
    texts = [np.array(t) for t in np.ndindex(3, 3, 3, 3)]
    assert abs((10 ** hmm.forward(m, *hmm.by_time(texts), keep=False)[0]).sum() - 1) < 1e-9


def test_packed_pieces_equal_the_tokenizers(spark):
    docs = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    encode = packing.Encoder()
    ids = {d: encode(t) for d, t in docs.items()}
    out = queries.QUERIES["op9_best_fit_packing"](spark, SF).toPandas()
    pieces = collections.defaultdict(list)
    for r in out.itertuples():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for d, ps in pieces.items():
        ps.sort(key=lambda r: r.piece)
        assert [r.piece for r in ps] == list(range(len(ps))) and [r.start for r in ps] == np.cumsum([0, *[r.length for r in ps[:-1]]]).tolist()
        assert sum(r.length for r in ps) == len(ids[d]) and all(r.length == 2048 for r in ps[1:])
        assert all(zlib.crc32(ids[d][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in ps)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= packing.dual_bound(out.length.to_numpy(np.int64), 2048) + 1


def test_the_bound_needs_counts_only():
    n = np.random.default_rng(1).integers(1, 60, 500)
    assert packing.histogram_bound(np.bincount(n, minlength=61).astype(np.int64), 60) == packing.dual_bound(n, 60)
    huge = np.zeros(2049, np.int64)
    huge[1025] = 10**12
    assert packing.histogram_bound(huge, 2048) == 10**12


def test_classes_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choices("abcdefghij", k=44))
    texts = [f"{' '.join(str(rng.random())[2:8] for _ in range(60))} {passage} {i}" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def known(parts: int) -> dict[int, int]:
        scan = common.Stage(spark, "t").write(jaccard._scan(df.repartition(parts), 4, 4, 5, 64), "scan")
        found = {}
        for r in jaccard._repeats(scan).collect():
            found |= dict(zip(np.frombuffer(r.tokens, np.uint64).tolist(), np.frombuffer(r.kind, np.uint8).tolist()))
        return found

    few, many = known(2), known(60)
    assert few == many and set(few.values()) == {2}


def test_a_long_text_gives_signatures_in_proportion(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.random())[2:9] for _ in range(50_000))
    changed = long[: len(long) // 2] + " other words here " + long[len(long) // 2 :]
    df = spark.createDataFrame([(1, long), (2, changed), (3, "one two three four five six")] + [(10 + i, long[: 9 * 40_000]) for i in range(3)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.shingle_links(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 10: 10, 11: 10, 12: 10} or got == {1: 1, 2: 1, 3: 3, 10: 1, 11: 1, 12: 1}
    share = 40_000 / 50_000
    assert (got[10] == 1) == (share >= 0.8) or abs(share - 0.8) < 1e-3


def test_word_table_follows_the_counts(spark):
    df = spark.createDataFrame([(i, 0, c) for i, c in enumerate([1] * 50 + [2] * 20 + [40, 41, 1000])], "h long, kind int, c long")
    for most in (1, 2, 3, 23, 72, 73, 1000):
        cut = hmm._least_count(df, most)
        n = df.where(F.col("c") >= cut).count()
        assert n <= most and (most < 73 or n == 73)


def test_stages_of_other_threads_are_not_collected(spark):
    import threading

    other = []
    with common.stages_made() as outer:
        first = common.Stage(spark, "a")
        with common.stages_made() as inner:
            second = common.Stage(spark, "b")
            t = threading.Thread(target=lambda: other.append(common.Stage(spark, "c")))
            t.start()
            t.join()
        third = common.Stage(spark, "d")
    common.Stage(spark, "e")
    assert outer == [first, second, third] and inner == [second] and len(other) == 1


def test_two_pipelines_leave_each_others_tables_alone(spark):
    import corpus_pipeline as P

    docs = read(spark, "documents")
    stage = common.Stage(spark, "two")
    a = stage.write(P.quality(spark, docs, SF), "a")
    lazy = P.near_copies(spark, a, SF)
    b = P.quality(spark, docs, SF)  # a second pipeline begins before the first one's result is read
    assert lazy.count() > 0 and b.count() == a.count()


def test_hot_word_runs_are_found_like_others(spark, monkeypatch):
    from skyquilt.llm import suffixes

    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(1000)}" for _ in range(40))
    rows = [(i, f"own{i} " + passage + f" end{i}") for i in range(40)] + [(100 + i, f"a{i % 2} " + " ".join(f"b{k}" for k in range(25)) + f" l{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, suffixes.repeated_word_runs(df, common.Stage(spark, "w"), 20).collect()))
    monkeypatch.setattr(suffixes, "MOST_HOT_RUNS", 5)
    assert sorted(map(tuple, suffixes.repeated_word_runs(df, common.Stage(spark, "w"), 20).collect())) == want and len(want) >= 42


def test_runs_of_one_anchors_variants_are_counted_in_tasks(spark, monkeypatch):
    """Near copies of a passage have one kind of segment each; their runs of words are no rows of a staged or exchanged table."""
    from skyquilt.llm import suffixes

    rng = random.Random(5)
    body = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(f"own{i}" if k == 20 + i % 110 else w for k, w in enumerate(body))) for i in range(220)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables = {}
    write = common.Stage.write

    def counted(self, frame, name):
        out = write(self, frame, name)
        tables[name] = out.count()
        return out

    monkeypatch.setattr(common.Stage, "write", counted)
    want = {(i, " ".join(words[k : k + 51])) for i, words in ((i, t.split()) for i, t in rows) for k in range(100)}
    seen = collections.Counter(r for _, r in want)
    texts = {r.t1: r.text for r in df.select(suffixes._text_keys("text")[0], "text").collect()}

    def found():
        gone = {t: np.zeros(len(t), bool) for t in texts.values()}
        for r in suffixes.repeated_word_runs(df, common.Stage(spark, "w"), 51).collect():
            gone[texts[r.t1]][r.begin : r.end] = True
        return {t: suffixes.runs(x) for t, x in gone.items()}

    got = found()
    for t in texts.values():
        x, words = np.zeros(len(t), bool), t.split()
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        for k in range(100):
            if seen[" ".join(words[k : k + 51])] > 1:
                x[ends[k] - len(words[k]) : ends[k + 50]] = True
        assert got[t] == suffixes.runs(x)
    assert max(tables.values()) <= 1.2 * tables["word-segments"]  # before: each kind's runs, many times as many
    monkeypatch.setattr(suffixes, "MOST_ANCHOR_BYTES", 2000)
    assert found() == got and tables["word-runs"] > 0


def test_segments_that_share_only_their_anchor_are_not_sorted(monkeypatch):
    """Texts with a phrase in common have segments under its anchor; only those that share half a string beside it are sorted."""
    from skyquilt.llm import suffixes

    rng = random.Random(6)
    own = lambda k: "".join(rng.choices("abcdefgh ", k=k)).encode()
    phrase, long = own(200), own(420)
    alone = [own(500) + phrase + own(500) for _ in range(40)]
    near = [own(300) + long[: 350 + 5 * k] + own(300) for k in range(14)] + [own(300) + long[20 + k :] + own(9) for k in range(3)] + [long, b"ab" * 600, own(5) + b"ab" * 300]

    def parts(texts):
        named = collections.defaultdict(dict)
        for *_, anchor, several, raw in suffixes.segments(texts, 400):
            for a, s, r in zip(anchor.tolist(), several.tolist(), raw, strict=True):
                named[a][bytes(r)] = s
        chosen = [(a, r) for a, v in named.items() if len(v) > 1 or any(v.values()) for r in v]
        return np.array([a for a, _ in chosen], np.uint64).view(np.int64), [r for _, r in chosen]

    anchors, cut = parts(alone)
    assert len(cut) >= 20 and not suffixes._may_repeat(anchors, cut, 400).any()
    anchors, cut = parts(alone + near)
    repeated = suffixes.repeated_starts(cut, 400)
    for chunk in (700, 20_000, 1 << 21):
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
        use = suffixes._may_repeat(anchors, cut, 400)
        assert not use.all() and all(u for u, w in zip(use, repeated, strict=True) if w.any())
        left = iter(suffixes.repeated_starts([r for r, u in zip(cut, use, strict=True) if u], 400))
        assert all(np.array_equal(w, next(left)) if u else not w.any() for u, w in zip(use, repeated, strict=True))


def test_passages_of_over_50_short_words_are_shown(spark, tmp_path, monkeypatch):
    """The contract's columns follow strings of 400 bytes; those of passages follow runs of 51 words too, in any case and white space."""
    import re

    from skyquilt.llm import suffixes

    monkeypatch.setattr(suffixes, "CHUNK", 3000)
    monkeypatch.setattr(suffixes, "CHUNK_WORDS", 300)
    monkeypatch.setattr(suffixes, "MOST_HOT_RUNS", 5)
    rng = random.Random(8)
    own = lambda k: " ".join("".join(rng.choices("abcdéfgh", k=6)) for _ in range(k))
    rows: list[str | None] = [None, "", "la " * 70, "LA\n" * 60, "x" * 9000]
    passages = {n: " ".join("".join(rng.choices("ijklmnop", k=3)) for _ in range(n)) for n in (50, 51, 52, 60)}
    for p in passages.values():
        rows += [f"{own(rng.randint(5, 900))} {p} {own(20)}", f"{own(9)}\n{p.upper()}\t\t{own(3)}", p.replace(" ", "  ") + " " + own(9), f"{own(4)} {p} {own(2)} {p}"]
    rows += [own(60)] * 2 + [own(55)[:399]] + [own(700)] * 3 + [own(300)]
    long = own(700)
    rows += [long, long.replace(long[2000:2006], "changed", 1), own(5) + " " + long[900:1500]] + [f"{own(3)} {passages[52]} {own(k % 3)}" for k in range(12)]
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op4_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    data = [(t or "").encode() for t in rows]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    runs = [[tuple(b[x:y].lower() for x, y in s[i : i + 51]) for i in range(len(s) - 50)] for b, s in zip(data, words)]
    seen = collections.Counter(r for rs in runs for r in rs)
    strings = collections.Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    assert sorted(got) == list(range(len(rows)))
    for i, (b, s, rs) in enumerate(zip(data, words, runs)):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if strings[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), gone.sum(), len(suffixes.runs(gone)), hashlib.sha256(kept).hexdigest())
        for k, r in enumerate(rs):
            if seen[r] > 1:
                gone[s[k][0] : s[k + 50][1]] = True
        assert (got[i].passage_bytes, got[i].n_passages) == (gone.sum(), len(suffixes.runs(gone)))
        assert got[i].passage_text == (None if rows[i] is None else np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore"))
    for n, p in passages.items():
        left = sum(p in " ".join((r.passage_text or "").lower().split()) for r in got.values())
        assert left == (4 if n == 50 else 0)
