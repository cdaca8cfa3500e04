"""Hard negatives, mixing and the conversation trie against brute force, with nulls, empties, ties, repeats, long texts and clashing names."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.llm import common, conversations, mixing, negatives, queries

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import connect, differences  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_product_quantised_negatives", "op13_conversation_trie"])
def test_queries_equal_their_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE[name], connect(SF)) == ""


# 11: hard negatives


def brute_negatives(rows, asks, n_pos=5, n_neg=5, low=80, high=100):
    out = collections.Counter()
    last = lambda i: math.inf if i is None else i
    for k, (a, label, v) in enumerate(rows):
        if not asks(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last(i), i, other) for j, (i, other, w) in enumerate(rows) if j != k and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for s, _, i, _ in [x for x in scored if x[3] == label][:n_pos]:
            fits = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s][:n_neg]
            for r, x in enumerate(fits):
                out[a, i, r + 1, x[2], -s, -x[0]] += 1
    return out


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vec = lambda n=6: [rng.gauss(0, 40) for _ in range(n)]
    rows = [(i, vec(), rng.randrange(3)) for i in range(300)]
    rows += [(i, rows[i % 40][1], rng.randrange(3)) for i in range(300, 360)]  # copies under other labels: ties
    rows += [(100, vec(), 1), (7, rows[9][1], 1), (None, rows[3][1], 0), (None, rows[100][1], 2)]
    rows += [(900 + k, vec(5), k % 2) for k in range(6)] + [(1000, vec(3), 1)]
    rows += [(2000, [0.0] * 6, 1), (2001, None, 1), (2002, [1.0, None] * 3, 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] * 6, 2), (2005, vec(), None), (2006, [], 1), (2007, [1e300] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit("x"), "codes": F.lit(1), "asks": F.lit(2)}).repartition(3)
    good = [(i, c, [math.floor(x) for x in v]) for i, v, c in rows if c is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 1e8 for x in v)]
    asks = lambda i: i is not None and i % 10 == 0
    mark = F.coalesce((F.col("vec_id") != 2**63 - 1) & (F.col("vec_id") % 10 == 0), F.lit(False))
    want = brute_negatives(good, asks)
    assert len(want) > 100
    for block, centres in ((4096, 256), (7, 4)):  # few anchors a pass, and bounds that say little
        monkeypatch.setattr(negatives, "ANCHORS", block)
        monkeypatch.setattr(negatives, "CENTRES", centres)
        got = collections.Counter(tuple(r) for r in negatives.mine(negatives.quantised(df, 1), mark).collect())
        assert got == want


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 30, (500, 9)))
    books = [negatives.fit_part(v[:200, s]) for s in negatives.parts(9)]
    codes, left = negatives.encode(v, books)
    low, high = negatives.bounded_scores(v[:40], codes, left, books)
    exact = v[:40] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    # Rows of the sample stand on their centres where a part has few values, so bounds are narrow there.
    assert (high - low)[:, :200].mean() < 0.5 * np.abs(exact).max()


def test_no_vectors_no_negatives(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(negatives.quantised(df, 256), F.lit(True)).count() == 0


# 12: mixing


def brute_targets(sizes, weights, most=3):
    full, total = {s for s in sizes if not sizes[s]}, sum(sizes.values())
    while True:
        w = sum(weights[s] for s in sizes if s not in full)
        level = (total - most * sum(sizes[s] for s in full)) / w if w else 0
        more = {s for s in sizes if s not in full and level * weights[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= more


def mixed(spark, rows, **args):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "n": F.lit(1), "pos": F.lit(0), "target": F.lit(None).cast("double")})
    place = F.pmod("place", F.lit(3))
    return mixing.mix(df.repartition(3), F.when(place == 0, 5).when(place == 1, 2).otherwise(1), **args)


def word_rows():
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(min(800, int(rng.expovariate(1 / 40))))), rng.choice(["a", "a", "a", "b", "Ä", "", "c c"])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "b"), (402, " \t\n", None), (403, "one two", None), (404, "x\x0by\x1cz v", None), (405, "nothing", "zz"), (None, "no id", "a"), (7, "other text", "b"), (406, None, "empty")]
    rows += [(500, "same words here", "c c")] * 60 + [(600, "word " * 30_000, "a")]
    return rows


def test_mix_meets_targets(spark):
    rows = word_rows()
    out = mixed(spark, rows).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r.size) for r in out) == collections.Counter((i, count(t)) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    # Every row's source is known by its size and target; copies are whole and at most three.
    by_target = collections.defaultdict(list)
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        by_target[r.source_size, round(r.target, 6)].append(r)
    assert set(by_target) == {(sizes[s], round(want[s], 6)) for s in order}
    for (size, target), group in by_target.items():
        small = min([r.size for r in group if r.size] or [0])
        taken = sum(r.taken for r in group)
        assert abs(taken - target) <= max(small, 0.01 * size)
        # The rates themselves give the target's words.
        assert abs(sum(r.rate * r.size for r in group) - target) <= 1e-6 * max(1, target)
    # Within a source rates are one exponential of the root of the size, up to three.
    for (size, target), group in by_target.items():
        free = [(math.sqrt(r.size), math.log(r.rate)) for r in group if r.size and r.rate < 3]
        slopes = [y / x for x, y in free]
        assert not slopes or max(slopes) - min(slopes) < 1e-6


def test_mix_is_the_same_however_rows_are_dealt(spark):
    rows = word_rows()
    a = collections.Counter(map(tuple, mixed(spark, rows).collect()))
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = collections.Counter(map(tuple, mixed(spark, rows).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {k[:4]: v for k, v in a.items()} == {k[:4]: v for k, v in b.items()}
    assert collections.Counter((r[0], r[1], r[-1]) for r in a.elements()) == collections.Counter((r[0], r[1], r[-1]) for r in b.elements())


def test_mix_of_one_source_and_of_nothing(spark):
    out = mixed(spark, [(1, "a b c", "s"), (2, None, "s")]).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in out) == [(1, 3.0, 3), (2, 3.0, 0)]
    assert mixed(spark, []).count() == 0
    out = mixed(spark, [(1, None, "s"), (2, "", None)]).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in out) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_full_sources_get_three_copies_of_everything(spark):
    rows = [(i, "a " * (i % 9 + 1), "few") for i in range(20)] + [(100 + i, "b " * 50, "many") for i in range(200)]
    out = mixed(spark, rows).collect()
    assert {r.copies for r in out if r.doc_id < 100} == {3}
    assert sum(r.taken for r in out) == pytest.approx(sum(r.size for r in out), abs=50)


def test_numbers_within_keys(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None, "zz"]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(5)
    out = common.number_in_order(common.Stage(spark, "t"), df, "k", [F.col("o").asc(), F.col("i").asc()], "n").collect()
    want = {}
    for k in {r[0] for r in rows}:
        for p, (_, i) in enumerate(sorted((o, i) for x, o, i in rows if x == k)):
            want[i] = p
    assert {r.i: r.pos for r in out} == want and len(out) == len(rows)


# 13: conversations

NAMES = [c.split()[0] for c in conversations.NODE.split(", ")]


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    nodes = collections.defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        p = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
        for d in range(len(p) + 1):
            nodes[p[:d]].append((c, len(p) == d))
    kids, totals = collections.defaultdict(list), {}
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1, saved + sum(totals[k][1] for k in kids[p]))
    least = lambda p: min(c for c, _ in nodes[p])
    ids = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, end in m if end))).encode()).hexdigest()
    return collections.Counter((least(p), len(p), least(p[:-1]) if p else None, len(m), len(kids[p]), *totals[p], ids(m)) for p, m in nodes.items())


def trie(spark, rows, **args):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "n": F.lit(1), "path": F.lit(2), "length": F.lit(0)})
    c = F.col("conv_id")
    out = conversations.prefix_trie(df.repartition(3), base=c - F.pmod(c, F.lit(100)), borrowed=F.crc32(c.cast("string")) % 6, most=5, **args)
    return collections.Counter(tuple(r) for r in out.select(*NAMES).collect())


def talk():
    rng = random.Random(8)
    roles = ["user", "assistant", None, ""]
    rows = []
    for c in [*range(0, 130), *range(205, 260), 1000, 10**12, 10**12 + 1]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(roles[: 1 + t % 4]), rng.choice(["hi", "hi", "ha ha", None, "", "é𝄞" * 5])))
    rows += [(c, t, "user", "the same") for c in range(300, 340) for t in range(7)]  # copies
    rows += [(c, t, "user", "the same") for c in (341, 342) for t in range(40)] + [(341, 40, "user", "x")]  # long ones that share
    rows += [(350, 1, "b", "tie"), (350, 1, "a", "tie"), (350, 1, "a", "tie"), (None, 0, "user", "nobody"), (351, 0, "user", "w " * 100_000)]
    return rows


@pytest.mark.parametrize("task_turns", [conversations.TASK_TURNS, 25])
def test_trie_equals_brute_force(spark, task_turns):
    rows = talk()
    assert trie(spark, rows, task_turns=task_turns) == brute_trie(rows)


def test_long_conversations_are_rows_of_nodes(spark):
    rows = [(c, t, "u", f"turn {min(t, 900 + c)}") for c in (1000, 2000, 3000) for t in range(1500)]
    assert trie(spark, rows, task_turns=400) == brute_trie(rows)


def test_ids_of_many_copies_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "IDS_AT_ONCE", 3)
    rows = [(c, 0, "u", "same") for c in range(0, 6000, 100)]
    assert trie(spark, rows) == brute_trie(rows)


def test_no_conversations_no_nodes(spark):
    assert not trie(spark, []) and not trie(spark, [(None, 1, "a", "b")])
    one = trie(spark, [(5, 0, "u", "x")])
    assert one == brute_trie([(5, 0, "u", "x")])
