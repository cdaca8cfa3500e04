"""Suffix-array deduplication: every byte under a string of LENGTH bytes that also starts elsewhere is removed. Shorter passages are found by their words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, mix, signed, utf8

LENGTH = 400
#: Words of the shortest passage that a result by passages leaves out, whatever its bytes: over 50.
PASSAGE_WORDS = 51
#: Bytes of an anchor: within every string of LENGTH bytes the anchor of least hash decides on the string's shard.
ANCHOR = 32
#: Bytes of text hashed together, of a shard, and starting places of a segment.
CHUNK, SHARD_BYTES, SEGMENT = 2 << 20, 2 << 20, 1 << 14
#: Variants of one anchor beyond which its segments are divided, and the starting places of their parts, step by step.
MOST_VARIANTS, NARROW = 16_384, (64, 8, 1)
#: Partitions of the shards at most; beyond, a partition has several shards, one after another.
PARTITIONS = 32_768
#: Bytes of an anchor's segments of words beyond which their runs are counted as rows, not in one task.
MOST_ANCHOR_BYTES = 4 * SHARD_BYTES
#: Words of an anchor of a run of words, and words hashed together.
WORD_ANCHOR, CHUNK_WORDS = 16, 1 << 20
#: A run of words is hot when it has more than one in so many of all starts; so there are fewer hot runs than that.
MOST_HOT_RUNS = 1000
_WORD, _GAP = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
_SEPARATOR = 0xF9  # never occurs in UTF-8
_PLACE = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER_TABLE = _TABLE[list(bytes(range(256)).lower())]
_IS_SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0A\x0B\x0C\x0D"))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starting places of strings of ``length`` bytes whose anchors have one hash: first place, number, anchor hash, and whether the run has several anchors.

    ``data`` joins texts that end at ``ends``; no string crosses an end. A run has SEGMENT starting places at most.
    """
    return _anchored(_TABLE[data], ends, length, ANCHOR)


def _anchored(h: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for symbols given by their hashes; ``anchor`` is a power of two."""
    place, h, inside = _places(h, ends, length, anchor)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    moved = np.append(False, place[1:] != place[:-1])
    edge = np.append(True, (h[place[1:]] != h[place[:-1]]) | (inside[1:] != inside[:-1]))
    first = np.flatnonzero(edge)
    n = len(place)
    if (np.diff(np.append(first, n)) > SEGMENT).any():
        at = np.arange(n)
        edge |= (at - np.maximum.accumulate(np.where(edge, at, 0))) % SEGMENT == 0
        first = np.flatnonzero(edge)
    count = np.diff(np.append(first, n))
    use = inside[first]
    several = np.add.reduceat(moved & ~edge, first) > 0
    return first[use], count[use], h[place[first[use]]], several[use]


def _places(h: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every starting place the first place of its anchor; the hashes of all anchors; and which starting places have a whole string."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    k = 1
    while k < anchor:
        h = (h[:-k] ^ (h[:-k] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:]
        k *= 2
    h = mix(h)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, k = length - anchor + 1, 1
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if k < span:
        low = np.minimum(low[: len(low) - (span - k)], low[span - k :])
    place = (low[:n] & _PLACE).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    return place, h, inside


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Texts joined into chunks of about CHUNK bytes; longer texts in parts that overlap so that every string is whole in one part."""
    held: list[bytes] = []
    names: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for s in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[s : s + CHUNK + length - 1]
            if held and size + len(part) > CHUNK:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), names
                held, names, size = [], [], 0
            held.append(part)
            names.append((i, s))
            size += len(part)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), names


def segments(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple]:
    """Chunk by chunk: text number, first starting place, number of starting places, anchor, whether it has several anchors, and the segment's bytes."""
    for data, ends, names in pieces(texts, length):
        first, count, anchor, several = anchors(data, ends, length)
        which = np.searchsorted(ends, first, side="right")
        begin = ends - np.diff(np.append(0, ends))
        base = np.array([s for _, s in names], np.int64) - begin
        raw = memoryview(data)
        text = np.array([i for i, _ in names], np.int64)[which]
        yield text, first + base[which], count, anchor, several, (raw[a : a + c + length - 1] for a, c in zip(first.tolist(), count.tolist(), strict=True))


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last symbol is the sentinel."""
    n = len(t)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    sign[-1] = 1
    at = np.where(sign != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place that decides
    return sign[at] > 0


def _names(t: np.ndarray, lms: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings (equal ones share a rank), by blocks of ``width`` symbols of ``bits`` bits.

    A substring that another one continues ranks behind it, since its last suffix is of S type and the other's is of L type.
    """
    sizes = np.append(np.diff(lms) + 1, 1)
    padded = np.append(t, np.zeros(width + 1, t.dtype)).astype(np.uint64)
    end, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    rank, open_, depth = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(open_):
        key = np.zeros(len(open_), np.uint64)
        for k in range(width):
            within = depth + k < sizes[open_]
            at = np.minimum(lms[open_] + depth + k, len(padded) - 1)
            key = (key << shift) | np.where(within, padded[at], end)
        by = np.lexsort((key, rank[open_]))
        r, k = rank[open_][by], key[by]
        new_group = np.append(True, r[1:] != r[:-1])
        new_key = new_group | np.append(True, k[1:] != k[:-1])
        start = np.maximum.accumulate(np.where(new_group, np.arange(len(by)), 0))
        first = np.maximum.accumulate(np.where(new_key, np.arange(len(by)), 0))
        rank[open_[by]] = r + first - start
        many = np.diff(np.append(np.flatnonzero(new_key), len(by))) > 1
        tied = np.repeat(many, np.diff(np.append(np.flatnonzero(new_key), len(by))))
        depth += width
        left = open_[by[tied]]
        open_ = left[sizes[left] > depth]
    return rank


def _sort_recursively(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string, which ends with its only smallest name: at once where all names differ, else by induced sorting again."""
    distinct, dense = np.unique(names, return_inverse=True)
    if len(distinct) == len(names):
        return np.argsort(names)
    return _induced(dense, len(distinct))


def _induced(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of integers 0 to ``size`` - 1 of which 0 is the last and occurs once.

    Substrings are named by whole arrays, as on the first level; what remains symbol by symbol is the one pass that
    induces the large suffixes and the one that induces the small ones.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    order = lms[_sort_recursively(_names(t, lms, 31, 2))].tolist()
    count = np.bincount(t, minlength=size)
    tails = np.cumsum(count)
    begin, tails = (tails - count).tolist(), tails.tolist()
    # Of every place the symbol before it, if that suffix is large or small, else -1.
    before = np.append(-1, t[:-1])
    large = np.where(np.append(False, ~s_type[:-1]), before, -1).tolist()
    little = np.where(np.append(False, s_type[:-1]), before, -1).tolist()
    sa, end, symbol = [-1] * n, tails.copy(), t.tolist()
    for i in reversed(order):
        c = symbol[i]
        end[c] -= 1
        sa[end[c]] = i
    for k in range(n):
        i = sa[k]
        if i > 0:
            c = large[i]
            if c >= 0:
                sa[begin[c]] = i - 1
                begin[c] += 1
    for k in range(n - 1, -1, -1):
        i = sa[k]
        if i > 0:
            c = little[i]
            if c >= 0:
                tails[c] -= 1
                sa[tails[c]] = i - 1
    return np.array(sa, np.int64)


def _push(queues: list[list[np.ndarray]], places: np.ndarray, symbols: np.ndarray) -> None:
    if len(places):
        by = np.argsort(symbols, kind="stable")
        s = symbols[by]
        cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        for part, at in zip(np.split(places[by], cut[1:]), cut.tolist(), strict=True):
            queues[int(s[at])].append(part)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting. ``t`` holds symbols 1 to 256 and ends with the only 0."""
    n, size = len(t), 257
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = lms[_sort_recursively(_names(t, lms, 9, 7))] if len(lms) else lms
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _push(seeds, order, t[order])
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    found_l: list[np.ndarray] = []
    none = np.zeros(0, np.int64)
    for c in range(size):
        wave, done = (np.concatenate(large[c]) if large[c] else none), []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            same = t[before] == c
            _push(large, before[~same], t[before[~same]])
            wave = before[same]
        found_l.append(np.concatenate(done) if done else none)
        for part in seeds[c]:
            before = part[part > 0] - 1
            before = before[~small[before]]
            _push(large, before, t[before])
    # From the largest symbol down; all lists run backwards here.
    queue: list[list[np.ndarray]] = [[] for _ in range(size)]
    found_s: list[np.ndarray] = [none] * size
    for c in range(size - 1, -1, -1):
        wave, done = (np.concatenate(queue[c]) if queue[c] else none), []
        if c == 0:
            wave = np.array([n - 1])
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            same = t[before] == c
            _push(queue, before[~same], t[before[~same]])
            wave = before[same]
        found_s[c] = np.concatenate(done)[::-1] if done else none
        part = found_l[c][::-1]
        before = part[part > 0] - 1
        before = before[small[before]]
        _push(queue, before, t[before])
    return np.concatenate([x for c in range(size) for x in (found_l[c], found_s[c])])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the suffix before its own in order, and how many symbols both share.

    Only places whose preceding symbols differ are compared; from one such place to the next the shared
    length falls by one each step.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1
    word = np.zeros(n + 8, np.uint64)
    for k in range(7):
        word[:n] = (word[:n] << np.uint64(9)) | np.append(t[k:], np.zeros(min(k, n), t.dtype))[:n].astype(np.uint64)
    left = np.append(-1, t[:-1])
    own = left != np.where(before > 0, t[np.maximum(before, 1) - 1], -2)
    own[0] = True
    start = np.flatnonzero(own)
    shared = np.zeros(n, np.int64)
    a, b, live = start.copy(), before[start].copy(), np.arange(len(start))
    far = np.zeros(len(start), np.int64)
    while len(live):
        x, y = np.minimum(a[live] + far[live], n), np.minimum(b[live] + far[live], n)
        same = (word[x] == word[y]) & (x < n) & (y < n)
        far[live[same]] += 7
        stop = live[~same]
        for _ in range(7):
            x, y = a[stop] + far[stop], b[stop] + far[stop]
            ok = (x < n) & (y < n)
            ok[ok] = t[x[ok]] == t[y[ok]]
            stop = stop[ok]
            far[stop] += 1
        live = live[same]
    shared[start] = far
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return before, np.maximum(shared[last] - (np.arange(n) - last), 0)


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For every part, whether the string of ``length`` bytes at each starting place also starts elsewhere in the parts."""
    joined = np.frombuffer(bytes([_SEPARATOR]).join(parts), np.uint8).astype(np.int16) + 1
    t = np.append(joined, np.int16(0))
    sa = suffix_array(t)
    before, shared = permuted_prefixes(t, sa)
    long = shared >= length
    twice = long.copy()
    twice[before[long]] = True
    begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]).tolist() if parts else []
    return [twice[b : b + max(0, len(p) - length + 1)] for b, p in zip(begin, parts, strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags: first and last place."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _text_keys(text) -> list:
    return [F.xxhash64(F.lit(k), text).alias(f"t{k}") for k in (1, 2)]


def _keys(parts) -> np.ndarray:
    """128-bit keys of byte strings, two numbers each."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in parts), np.int64).reshape(-1, 2)


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, first, count, anchor, several, raw in segments([utf8(t) for t in batch.column(2).to_pylist()], length):
                keys, at = _keys(raw), pa.array(which)
                cols = [batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, (first, count.astype(np.int32), signed(anchor), several, keys[:, 0], keys[:, 1]))]
                yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "first", "n", "anchor", "self", "s1", "s2"])

    rows = docs.select(*_text_keys("text"), "text").where(F.octet_length("text") >= length)
    return rows.mapInArrow(run, "t1 long, t2 long, first long, n int, anchor long, self boolean, s1 long, s2 long")


def _kinds(found: DataFrame, size: str) -> DataFrame:
    """The kinds of segments: how many there are of each, and the place of one. All first values are those of one row, as in ``dropDuplicates``."""
    place = [F.first(c).alias(c) for c in ("t1", "t2", "first", size)]
    return found.groupBy("anchor", "s1", "s2").agg(F.count("*").alias("copies"), F.max("self").alias("self"), *place)


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted segments (t1, t2, first, n, ...). Copies of a text become one row before it meets its segments."""
    by_text = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "n", "anchor", "s1", "s2")).alias("parts"))
    rows = docs.where(F.octet_length("text") >= length).groupBy(*_text_keys("text")).agg(F.first("text").cast("binary").alias("data")).join(by_text, ["t1", "t2"])
    part = F.explode("parts").alias("p")
    cut = rows.select("data", part).select("p.anchor", "p.s1", "p.s2", F.expr(f"substring(data, cast(p.first + 1 as int), p.n + {length - 1})").alias("bytes"))
    return cut


def _narrow(cut: DataFrame, length: int, width: int) -> DataFrame:
    """Segments of one anchor (anchor, s1, s2, bytes) in parts of ``width`` starting places: anchor, p1, p2, s1, s2, low, n, bytes.

    The new anchor is made of the old one, of the part's distance from it, and of the bytes that all of the
    part's strings have in common, so equal strings still meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, s1, s2, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                place, _, _ = _places(_TABLE[np.frombuffer(data, np.uint8)], np.array([len(data)]), length, ANCHOR)
                back = (place - np.arange(len(place))) // width
                low = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (back[1:] != back[:-1])))
                n = np.diff(np.append(low, len(place)))
                # Common to a part of full width, whatever of it is here: the bytes from its last start to its first string's end.
                last = place[low] - back[low] * width
                own = [anchor.to_bytes(8, "little", signed=True) + b.to_bytes(4, "little") + data[e : e + length - width + 1] for b, e in zip(back[low].tolist(), last.tolist(), strict=True)]
                parts = [data[a : a + k + length - 1] for a, k in zip(low.tolist(), n.tolist(), strict=True)]
                new, keys = _keys(own), _keys(parts)
                cols = (new[:, 0], keys[:, 0], keys[:, 1], np.full(len(low), s1), np.full(len(low), s2), low.astype(np.int32), n.astype(np.int32), parts)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if c is parts else pa.array(c) for c in cols], names=["anchor", "p1", "p2", "s1", "s2", "low", "n", "bytes"])

    return cut.select("anchor", "s1", "s2", "bytes").mapInArrow(run, "anchor long, p1 long, p2 long, s1 long, s2 long, low int, n int, bytes binary")


def _may_repeat(anchors_: np.ndarray, parts: list[bytes], length: int) -> np.ndarray:
    """Which of the segments (whole strings only, equal strings in equal anchors) can share a string of ``length`` bytes with another one.

    Two equal strings hold the anchor at the same place, so they have at least half of their other bytes in common on
    one side of it. A segment is left out when neither its half before nor its half behind the anchor occurs
    under the anchor again. Where a segment has several anchors, all of that anchor stay.
    """
    half = -(-(length - ANCHOR) // 2)
    size = np.array([len(p) for p in parts], np.int64)
    several, keys = np.zeros(len(parts), bool), np.zeros((2, len(parts)), np.uint64)
    known = np.zeros((2, len(parts)), bool)
    cut = np.searchsorted(np.cumsum(size), np.arange(CHUNK, size.sum() + CHUNK, CHUNK), side="right").tolist()
    for a, b in zip([0, *cut], [*cut, len(parts)], strict=True):
        if a == b:
            continue
        ends = np.cumsum(size[a:b])
        begin = ends - size[a:b]
        symbols = _TABLE[np.frombuffer(b"".join(parts[a:b]), np.uint8)]
        place, h, _ = _places(symbols, ends, length, ANCHOR)
        at = place[begin]
        several[a:b] = at != place[ends - length]
        # Of ANCHOR + half bytes: by twice as many as far as they go, then by two that overlap.
        k = ANCHOR
        while 2 * k <= ANCHOR + half:
            h = mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
            k *= 2
        over = ANCHOR + half - k
        for side, (start, ok) in enumerate(((at - half, at - half >= begin), (at, at + ANCHOR + half <= ends))):
            x = start[ok]
            known[side, a:b] = ok
            keys[side, a:b][ok] = mix(h[x] * np.uint64(0xC2B2AE3D27D4EB4F) + h[x + over])
    use = np.isin(anchors_, anchors_[several])
    for side in range(2):
        have = np.flatnonzero(known[side])
        by = have[np.lexsort((keys[side, have], anchors_[have]))]
        same = (anchors_[by[1:]] == anchors_[by[:-1]]) & (keys[side, by[1:]] == keys[side, by[:-1]])
        use[by[1:][same]] = True
        use[by[:-1][same]] = True
    return use


def _repeats_in(stage: Stage, cut: DataFrame, length: int, step: int = 0) -> DataFrame:
    """(s1, s2, low, high): starting places of the segments (anchor, s1, s2, bytes) whose strings start elsewhere in a segment of the anchor.

    Anchors make shards of bounded size, each with a suffix array. Segments of an anchor with more than
    MOST_VARIANTS of them are divided into narrower parts with longer anchors, which are treated alike.
    """
    hot = cut.groupBy("anchor").count().where(F.col("count") > MOST_VARIANTS).select("anchor", F.lit(True).alias("hot"))
    cut = stage.write(cut.join(hot, "anchor", "left"), f"cut-{step}")
    size, many = cut.agg(F.coalesce(F.sum(F.when(F.col("hot").isNull(), F.length("bytes"))), F.lit(0)), F.count("hot")).first()
    shards = max(1, -(-size // SHARD_BYTES))

    def sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "s1", "s2"], kind="stable")
        pdf = pdf[_may_repeat(pdf["anchor"].to_numpy(), list(pdf["bytes"]), length)]
        rows = [(s1, s2, a, b) for s1, s2, flags in zip(pdf["s1"], pdf["s2"], repeated_starts(list(pdf["bytes"]), length), strict=True) for a, b in runs(flags)]
        return pd.DataFrame(rows, columns=["s1", "s2", "low", "high"])

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    out = cut.where("hot is null").select("anchor", "s1", "s2", "bytes", shard).repartition(min(shards, PARTITIONS), "shard").groupBy("shard").applyInPandas(sort_shard, "s1 long, s2 long, low int, high int")
    if not many:
        return out
    parts = stage.write(_narrow(cut.where("hot"), length, NARROW[step]), f"parts-{step}")
    kinds = parts.groupBy("anchor", "p1", "p2").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.first("bytes").alias("bytes"))
    kinds = stage.write(kinds, f"kinds-{step}")
    whole = kinds.where("copies > 1").select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.lit(0).alias("low"), (F.col("n") - 1).cast("int").alias("high"))
    if step + 1 < len(NARROW):
        several = kinds.groupBy("anchor").count().where("count > 1").select("anchor")
        whole = whole.unionByName(_repeats_in(stage, kinds.join(several, "anchor").select("anchor", F.col("p1").alias("s1"), F.col("p2").alias("s2"), "bytes"), length, step + 1))
    found = whole.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("low").alias("l"), F.col("high").alias("h"))
    return out.unionByName(parts.join(found, ["p1", "p2"]).select("s1", "s2", (F.col("low") + F.col("l")).alias("low"), (F.col("low") + F.col("h")).alias("high")))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``data`` (those of ``common.words``): hashes without regard to the case of A-Z, first byte and end."""
    found = []
    low = 0
    while low < len(data):
        # Cut at white space only.
        gap = _GAP.search(data, low + CHUNK)
        high = gap.start() if gap else len(data)
        part = np.frombuffer(data, np.uint8)[low:high]
        inside = ~_IS_SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        begin, end = edge[::2], edge[1::2]
        if len(begin):
            size = end - begin
            start = np.cumsum(size) - size
            symbols = _LOWER_TABLE[part[inside]]
            weight = mix(np.arange(1, size.max() + 1, dtype=np.uint64)) | np.uint64(1)
            symbols *= weight[np.arange(len(symbols)) - np.repeat(start, size)]
            found.append((mix(np.add.reduceat(symbols, start) + size.astype(np.uint64)), begin + low, end + low))
        low = high
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _run_keys(h: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Two independent 64-bit keys of every run of ``n_words`` word hashes."""
    n = max(0, len(h) - n_words + 1)
    keys = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        word, key = mix(h ^ np.uint64(seed)), np.zeros(n, np.uint64)
        for k in range(n_words):
            key *= np.uint64(seed)
            key += word[k : k + n]
        keys.append(mix(key))
    return keys


def _passage_segments(texts: list[bytes], n_words: int) -> Iterator[tuple]:
    """Part by part: text number, first byte, size, anchor, whether it has several anchors, and bytes of the segments of runs of ``n_words`` words."""
    held: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if held and (t is None or size + len(t) > CHUNK):
            joined = b"\n".join([texts[k] for k in held])
            until = np.cumsum([len(texts[k]) + 1 for k in held])
            h, begin, end = _hash_words(joined)
            ends = np.searchsorted(begin, until)
            for s in range(0, len(h) - n_words + 1, CHUNK_WORDS):
                part = h[s : s + CHUNK_WORDS + n_words - 1]
                first, count, anchor, several = _anchored(part, np.clip(ends - s, 0, len(part)), n_words, WORD_ANCHOR)
                which = np.searchsorted(ends, first + s, side="right")
                low, high = begin[first + s], end[first + s + count + n_words - 2]
                yield np.array(held)[which], low - np.append(0, until)[which], high - low, anchor, several, [joined[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            held, size = [], 0
        if t is not None:
            held.append(i)
            size += len(t)


def _runs_in(parts: list[bytes], n_words: int) -> tuple[np.ndarray, ...]:
    """Every run of ``n_words`` words of the parts: part, place in it, first byte and end in it, two keys. A batch's parts are hashed together; runs across two of them are left out."""
    until = np.cumsum(np.array([len(x) + 1 for x in parts], np.int64))
    h, begin, end = _hash_words(b"\n".join(parts))
    last = np.searchsorted(begin, until)
    n = np.diff(np.append(0, last)) - n_words + 1
    which = np.repeat(np.arange(len(parts)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = (last - n - n_words + 1)[which] + place
    low = np.append(0, until)[which]
    return which, place, begin[at] - low, end[at + n_words - 1] - low, *(signed(x[at]) for x in _run_keys(h, n_words))


def _count_runs(parts: list[bytes], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges under runs of ``n_words`` words that occur twice in the parts: part, first byte and end in it. Neighbouring runs make one."""
    which, place, begin, end, k1, k2 = _runs_in(parts, n_words)
    by = np.lexsort((k2, k1))
    same = (k1[by[1:]] == k1[by[:-1]]) & (k2[by[1:]] == k2[by[:-1]])
    hit = np.zeros(len(by), bool)
    hit[by[1:][same]] = True
    hit[by[:-1][same]] = True
    at = np.flatnonzero(hit)
    apart = (which[at[1:]] != which[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)
    edge = np.flatnonzero(np.concatenate([[len(at) > 0], apart, [len(at) > 0]]))
    first, last = at[edge[:-1]], at[edge[1:] - 1]
    return which[first], begin[first], end[last]


def _listed_runs(stage: Stage, cut: DataFrame, n_words: int) -> DataFrame:
    """(s1, s2, low, high): the same for segments (s1, s2, bytes) that are too many for a task. Their runs are rows, counted by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, *cols = _runs_in(batch.column(2).to_pylist(), n_words)
            keys = [batch.column(k).take(pa.array(which)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, cols)], names=["s1", "s2", "place", "begin", "end", "k1", "k2"])

    starts = stage.write(cut.select("s1", "s2", "bytes").mapInArrow(run, "s1 long, s2 long, place long, begin long, end long, k1 long, k2 long"), "word-runs")
    counts = stage.write(starts.groupBy("k1", "k2").count().where("count > 1"), "word-counts")
    # Runs with more than a share of all starts are few, whatever the corpus: they go to all tasks, and their starts stay where they are.
    share = max(MOST_HOT_RUNS, starts.count() // MOST_HOT_RUNS)
    hot = F.broadcast(counts.where(F.col("count") > share).select("k1", "k2"))
    rest = starts.join(hot, ["k1", "k2"], "left_anti").join(counts.where(F.col("count") <= share).select("k1", "k2"), ["k1", "k2"])
    places = ["s1", "s2", "place", "begin", "end"]
    hits = starts.join(hot, ["k1", "k2"], "left_semi").select(*places).unionByName(rest.select(*places))
    # Neighbouring starts make one range.
    order = F.row_number().over(Window.partitionBy("s1", "s2").orderBy("place"))
    return hits.withColumn("island", F.col("place") - order).groupBy("s1", "s2", "island").agg(F.min("begin").alias("low"), F.max("end").alias("high")).drop("island")


def repeated_word_runs(docs: DataFrame, stage: Stage, n_words: int) -> DataFrame:
    """(t1, t2, begin, end): byte ranges under runs of ``n_words`` words that also start elsewhere, in the same or another row; ranges of one text may meet.

    Words are those of ``common.words``, so case and the kind of white space do not count. Equal runs share the
    hash of their anchor, the 16 words of least hash in them. Segments are as for strings: runs of starting words that
    share the anchor. One that occurs twice with the same bytes is repeated as a whole. Only segments whose anchor has
    several kinds of them (or which hold it several times) are cut out, one of each kind. Anchors make shards of
    bounded size; a task counts its shards' runs by 128-bit keys and gives ranges, so runs do not become rows, except
    those of anchors whose segments have over MOST_ANCHOR_BYTES.
    """
    texts = docs.where(F.octet_length("text") >= 2 * n_words - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, first, size, anchor, several, raw in _passage_segments([utf8(t) for t in batch.column(2).to_pylist()], n_words):
                keys, at = _keys(raw), pa.array(which)
                cols = [batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, (first, size, signed(anchor), several, keys[:, 0], keys[:, 1]))]
                yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "first", "size", "anchor", "self", "s1", "s2"])

    found = stage.write(texts.select(*_text_keys("text"), "text").mapInArrow(cut, "t1 long, t2 long, first long, size long, anchor long, self boolean, s1 long, s2 long"), "word-segments")
    twice = found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("self").alias("any")).where("n > 1 or any").select("anchor")
    shared = stage.write(found.join(twice, "anchor"), "word-shared")
    stage.drop("word-segments")
    kinds = stage.write(_kinds(shared, "size"), "word-kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("variants"), F.max("self").alias("any"), F.sum("size").alias("bytes")).where("variants > 1 or any")
    several = kinds.join(several.select("anchor", (F.col("bytes") > MOST_ANCHOR_BYTES).alias("hot")), "anchor")
    by_text = several.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "hot", "first", "size", "s1", "s2")).alias("parts"))
    rows = texts.groupBy(*_text_keys("text")).agg(F.first("text").cast("binary").alias("data")).join(by_text, ["t1", "t2"]).select("data", F.explode("parts").alias("p"))
    bytes_ = F.expr("substring(data, cast(p.first + 1 as int), cast(p.size as int))").alias("bytes")
    parts = stage.write(rows.select("p.anchor", "p.hot", "p.s1", "p.s2", bytes_), "word-cut")
    size, many = parts.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.length("bytes"))), F.lit(0)), F.count_if("hot")).first()
    shards = max(1, -(-size // SHARD_BYTES))

    def count_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        part, low, high = _count_runs(list(pdf["bytes"]), n_words)
        return pd.DataFrame({"s1": pdf["s1"].to_numpy()[part], "s2": pdf["s2"].to_numpy()[part], "low": low, "high": high})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    spans = parts.where("not hot").select("s1", "s2", "bytes", shard).repartition(min(shards, PARTITIONS), "shard").groupBy("shard").applyInPandas(count_shard, "s1 long, s2 long, low long, high long")
    if many:
        spans = spans.unionByName(_listed_runs(stage, parts.where("hot"), n_words))
    whole = kinds.where("copies > 1").select("s1", "s2", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))
    spans = stage.write(whole.unionByName(spans), "word-spans")
    return shared.join(spans, ["s1", "s2"]).select("t1", "t2", (F.col("first") + F.col("low")).alias("begin"), (F.col("first") + F.col("high")).alias("end")).distinct()


def _string_ranges(docs: DataFrame, stage: Stage, length: int) -> DataFrame:
    """(t1, t2, begin, end): byte ranges under strings of ``length`` bytes that also start elsewhere; ranges of one text may meet.

    Every string of ``length`` bytes has an anchor, the 32 bytes of least hash in it, so equal strings have
    equal anchors. A text is divided into segments: runs of starting places whose strings share the anchor.
    Equal segments are counted, not gathered; one that occurs twice is repeated as a whole. Anchors with
    several different segments, and segments that hold their anchor several times, make shards of bounded
    size (see ``_repeats_in``); a shard's segments (one of each kind) get a suffix array by induced sorting
    and the permuted shared prefixes, which give the starting places that repeat.
    """
    found = stage.write(_segment_rows(docs, length), "segments")
    kinds = stage.write(_kinds(found, "n"), "kinds")
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("variants"), F.max("self").alias("any")).where("variants > 1 or any").select("anchor")
    several = kinds.select("anchor", "s1", "s2", "t1", "t2", "first", "n").join(shared, "anchor")
    whole = kinds.where("copies > 1").select("s1", "s2", F.lit(0).alias("low"), (F.col("n") - 1).cast("int").alias("high"))
    spans = stage.write(whole.unionByName(_repeats_in(stage, _cut_out(docs, several, length), length)), "spans")
    stage.drop("kinds")
    stage.drop("cut-0")
    return found.join(spans, ["s1", "s2"]).select("t1", "t2", (F.col("first") + F.col("low")).alias("begin"), (F.col("first") + F.col("high") + length).alias("end")).distinct()


def _merged(of_text: DataFrame) -> DataFrame:
    """(t1, t2, spans): the ranges of each text; ranges that meet make one, a new one begins behind the end of all before it."""
    order = Window.partitionBy("t1", "t2").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = of_text.withColumn("new", F.coalesce(F.col("begin") > before, F.lit(True)).cast("long")).withColumn("range", F.sum("new").over(order))
    ranges = ranges.groupBy("t1", "t2", "range").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return ranges.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, n_words: int = 0, passage_words: int = 0) -> DataFrame:
    """(t1, t2, spans): for every text with repeats, by its key, the merged byte ranges [begin, end) under repeated strings.

    With ``n_words``, runs of so many words that repeat are added to the ranges, however few bytes they have. With
    ``passage_words``, ``spans`` (null: none) stay those of strings, and ``passages`` are the merged ranges under
    strings and under runs of so many words.
    """
    stage = Stage(docs.sparkSession, "suffixes")
    of_text = _string_ranges(docs, stage, length)
    if n_words:
        of_text = of_text.unionByName(repeated_word_runs(docs, stage, n_words)).distinct()
    if not passage_words:
        return stage.write(_merged(of_text), "merged")
    of_text = stage.write(of_text, "ranges")
    stage.drop("segments")
    stage.drop("spans")
    passages = _merged(of_text.unionByName(repeated_word_runs(docs, stage, passage_words))).withColumnRenamed("spans", "passages")
    out = stage.write(passages.join(_merged(of_text), ["t1", "t2"], "left"), "merged")
    stage.drop("word-shared")
    stage.drop("word-cut")
    return out


def _rest(text, spans) -> tuple:
    """What is left of a text without its ``spans``: as bytes, and as a text without the halves of cut characters."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    # What is kept lies between the spans: from each end (or 0) to the next begin (or the text's end).
    ends = F.concat(F.array(F.lit(0).cast("long")), spans["end"])
    begins = F.concat(spans["begin"], F.array(F.octet_length(data).cast("long")))
    gaps = F.zip_with(ends, begins, lambda a, b: F.decode(F.substring(data, (a + 1).cast("int"), (b - a).cast("int")), "ISO-8859-1"))
    kept = F.when(spans.isNull(), data).otherwise(F.encode(F.array_join(gaps, ""), "ISO-8859-1"))
    # In the text, a cut inside a character takes all of it: what is left of one at a gap's ends goes.
    gaps = F.transform(gaps, lambda g: F.regexp_replace(F.regexp_replace(g, r"^[\x80-\xBF]{1,3}", ""), r"([\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z", ""))
    return kept, F.when(spans.isNull(), text).otherwise(F.decode(F.encode(F.array_join(gaps, ""), "ISO-8859-1"), "UTF-8"))


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, n_words: int = 0, passage_words: int = 0) -> DataFrame:
    """Every row as ``row`` (a struct of all its columns), its ``spans``, n_bytes, the ``kept`` bytes and the remaining ``text``.

    A null text is empty. Copies of a text of ``length`` bytes or more lose all of it; shorter texts keep
    all. Repeated ids are rows of their own; an empty table gives an empty result. With ``passage_words``, two more
    columns follow, for strings and runs of so many words together: ``passages`` (spans) and ``passage_text`` (the rest).
    """
    spans = repeated_spans(docs, length=length, n_words=n_words, passage_words=passage_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_text_keys(F.col("text")))
    joined = rows.join(spans, ["t1", "t2"], "left")
    given = F.col("row.text")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    kept, text = _rest(given, F.col("spans"))
    columns = ["row", F.coalesce("spans", none).alias("spans"), F.coalesce(F.octet_length(given), F.lit(0)).cast("long").alias("n_bytes"), kept.alias("kept"), text.alias("text")]
    if passage_words:
        columns += [F.coalesce("passages", none).alias("passages"), _rest(given, F.col("passages"))[1].alias("passage_text")]
    return joined.select(*columns)


def drop_repeats(docs: DataFrame, *, length: int = LENGTH, n_words: int = 0) -> DataFrame:
    """The rows of ``docs`` with the repeated strings cut out of ``text``; other columns as they were.

    A cut inside a character drops what is left of it. A row whose whole text repeats keeps an empty text.
    """
    kept = cut_repeats(docs, length=length, n_words=n_words)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document keeps when strings of 400 bytes that repeat anywhere are removed; ``text`` is the rest without halves of characters.

    Passages of over 50 words have about 305 bytes and more, so many are under 400. The columns behind ``text`` leave
    these out as well: bytes and number of maximal runs under repeated strings or repeated runs of 51 words, and the rest.
    """
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage_words=PASSAGE_WORDS)
    under = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    contract = [F.col("row.doc_id").alias("doc_id"), "n_bytes", under("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return out.select(*contract, "text", under("passages").alias("passage_bytes"), F.size("passages").cast("long").alias("n_passages"), "passage_text")
