"""Benchmark decontamination: BM25 over the test items with block-max WAND, then question and answer overlap."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, union_all

K1, B = 1.2, 0.75
#: Items of one index; more items are searched in blocks of this many, so what is sent to tasks is bounded.
BLOCK_ITEMS = 20_000
#: Neighbouring items of a list for which one maximum is kept. Blocks start at multiples, so those of all lists align.
BLOCK = 4
#: Entries of block bounds that are added up at once.
ENTRIES = 1 << 20
#: Share of an item's own score that a passage must reach, and share of 5-word shingles of question and answer.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Shingles from which a part is judged by them alone.
SHORT = 25

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits; marks around words do not count."""
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words up to the first question mark and those after it; without one, all sentences but the last and the last.

    A single sentence gives its last quarter (a word at least) as the answer.
    """
    head, mark, tail = text.partition("?")
    if not (mark and terms_of(tail)):
        parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if terms_of(p)]
        head, tail = (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")
    q, a = terms_of(head), terms_of(tail)
    if not a and len(q) > 1:
        k = max(1, len(q) // 4)
        q, a = q[:-k], q[-k:]
    return q, a


def grams(ids: np.ndarray | list, n: int) -> set[tuple]:
    ids = list(ids)
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)}


def aligned(part: np.ndarray, passage: np.ndarray) -> float:
    """The largest share of the part's words that stand at their places in one stretch of the passage."""
    n = len(part)
    if not n or len(passage) < 2:
        return 0.0
    padded = np.concatenate([np.full(n - 1, -1), passage, np.full(n - 1, -1)])
    return float((np.lib.stride_tricks.sliding_window_view(padded, n) == part).sum(1).max() / n)


def overlap_of(part: np.ndarray, shingles: set[tuple], n: int, passage: np.ndarray, least: float) -> float:
    """Share of the part's shingles in the passage; a part of few shingles that lacks some is judged by its words in place.

    One other word costs up to SHINGLE shingles, which from SHORT shingles on leaves the share at ``least``.
    In a shorter part one other word is allowed among three or more, so it counts as ``least`` at least.
    """
    if not shingles:
        return 1.0
    share = len(shingles & grams(passage, n)) / len(shingles)
    if share < least and 3 <= len(part) < SHORT + SHINGLE - 1:
        words = aligned(part, passage)
        share = max(share, words, least if words * len(part) > len(part) - 1.5 else 0.0)
    return share


class Index:
    """Inverted lists of normalised impacts: a passage that holds all words of an item scores 1 for it.

    An impact is the BM25 weight of the word in the item over the item's own total, so that one
    threshold holds for all items. Each list is in item order, with the largest impact of the list and of
    each block of postings.
    """

    def __init__(self, texts: list[str | None], documents: int, frequency: dict[bytes, int], mean_words: float):
        self.vocabulary: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        self.checks: list[tuple[set, set, int, int, np.ndarray, np.ndarray]] = []
        longest = 1
        for item, text in enumerate(texts):
            words = terms_of(text)
            longest = max(longest, len(words))
            for w in words:
                if w not in self.vocabulary:
                    self.vocabulary[w] = len(postings)
                    postings.append([])
            tf = Counter(words)
            norm = K1 * (1 - B + B * len(words) / max(mean_words, 1e-9))
            weight = {w: math.log(1 + (documents - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            total = sum(weight.values())
            for w, x in weight.items():
                postings[self.vocabulary[w]].append((item, x / total))
            q, a = ([self.vocabulary[w] for w in part] for part in question_and_answer(text or ""))
            nq, na = min(SHINGLE, max(1, len(q))), min(SHINGLE, max(1, len(a)))
            self.checks.append((grams(q, nq), grams(a, na), nq, na, np.array(q, np.int64), np.array(a, np.int64)))
        self.window = 2 * max(64, longest)
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.max = [max(x, default=0.0) for x in self.impacts]
        # Block maxima of all lists, one after another: word t has those from first[t] to first[t + 1].
        self.blocks = -(-len(texts) // BLOCK)
        block_max: list[dict[int, float]] = []
        for p in postings:
            block_max.append({})
            for i, x in p:
                block_max[-1][i // BLOCK] = max(x, block_max[-1].get(i // BLOCK, 0.0))
        self.first = np.cumsum([0, *map(len, block_max)])
        self.block_of = np.array([b for m in block_max for b in m], np.int64)
        self.block_max = np.array([x for m in block_max for x in m.values()])

    def bounds(self, window: np.ndarray, term: np.ndarray, windows: int) -> np.ndarray:
        """For every window and block of items, the sum of the block's maxima over the window's words."""
        size = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.repeat(window, size) * self.blocks + self.block_of[at]
        return np.bincount(key, self.block_max[at], windows * self.blocks).reshape(windows, self.blocks)

    def search(self, terms: list[int], bound: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All items that score ``least`` or more, by WAND over the lists; blocks whose ``bound`` is lower are passed over."""
        slack, end = least - 1e-9, len(self.checks)
        live = np.append(np.flatnonzero(bound >= slack) * BLOCK, end).tolist()
        lists = sorted((self.items[t][0], t, 0) for t in terms)
        top, found = self.max, []
        while lists:
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(lists):
                total += top[t]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = lists[pivot][0]
            start = live[bisect.bisect_right(live, at) - 1] if at >= live[0] else -BLOCK
            if at >= start + BLOCK:
                target = live[bisect.bisect_right(live, at)]  # the next block that can hold a hit
            elif lists[0][0] == at:
                score = sum(self.impacts[t][pos] for item, t, pos in lists if item == at)
                if score >= slack:
                    found.append((at, score))
                target = at + 1
            else:
                target = at
            if target >= end:
                break
            moved = []
            for item, t, pos in lists:
                if item < target:
                    pos = bisect.bisect_left(self.items[t], target, pos)
                    if pos == len(self.items[t]):
                        continue
                    item = self.items[t][pos]
                moved.append((item, t, pos))
            lists = sorted(moved)
        return found

    def leaks(self, text: str | None, least: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """Items that a passage of the text holds: the best score, and the overlap of question and answer."""
        get = self.vocabulary.get
        words = terms_of(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple[float, float, float]] = {}
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return best
        # A word counts once in a window: where its last occurrence lies before the window's start.
        order = known[np.argsort(ids[known], kind="stable")]
        before = np.full(len(ids), -1, np.int64)
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        half = self.window // 2
        every = np.arange(0, max(1, len(ids) - half), half)
        step = max(1, ENTRIES // (self.window * max(1, self.blocks)))
        for starts in (every[k : k + step] for k in range(0, len(every), step)):
            places = np.minimum(starts[:, None] + np.arange(self.window), len(ids))
            distinct = np.append(before, -1)[places] < starts[:, None]
            term = np.append(ids, -1)[places]
            window, column = np.nonzero(distinct & (term >= 0))
            term = term[window, column]
            bounds = self.bounds(window, term, len(starts))
            for k in np.flatnonzero(bounds.max(1) >= least - 1e-9).tolist():
                passage = ids[starts[k] : starts[k] + self.window]
                for item, score in self.search(term[window == k].tolist(), bounds[k], least):
                    q, a, nq, na, words_q, words_a = self.checks[item]
                    part_q = overlap_of(words_q, q, nq, passage, overlap)
                    part_a = overlap_of(words_a, a, na, passage, overlap)
                    if part_q >= overlap and part_a >= overlap and (q or a):
                        best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, part_q, part_a))
        return best


def indexes(benchmark: DataFrame) -> Iterator[tuple[list[int | None], Index]]:
    """Indexes of about BLOCK_ITEMS items each, one of them at a time on the driver; word statistics are those of the whole benchmark."""
    items = benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("place"))
    items = Stage(benchmark.sparkSession, "benchmark").write(items, "items")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    block = lambda k: items.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == k).orderBy("place").collect()
    frequency: Counter = Counter()
    words = n = 0
    for k in range(blocks):
        for r in block(k):
            found = terms_of(r.text)
            words, n = words + len(found), n + 1
            frequency.update(set(found))
    for k in range(blocks):
        part = block(k)
        yield [r.item_id for r in part], Index([r.text for r in part], n, frequency, words / max(n, 1))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Every text is read whole, in overlapping passages of twice the longest item; a passage is a query to
    the index of the items, and all items that reach the threshold are verified: ``overlap`` of the 5-word
    shingles (fewer words: the whole) of both the question and the answer must stand in the passage. A part
    of under 25 shingles and of three words or more also counts with that share of its words in their
    places, or with all but one. No exchange: a document is judged in the task that reads it. Null or empty texts and items match
    nothing; equal documents and equal items each get their rows. Without documents or without items there are no rows.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    found = []
    for ids, index in indexes(benchmark):
        sent = spark.sparkContext.broadcast((ids, index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, index = sent.value
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            for batch in batches:
                rows = [(doc, ids[i], *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, x in index.leaks(text, least, overlap).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

        found.append(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"))
    return union_all(found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they were; judged row by row, so ids may repeat or be null. Without items all rows stay; an empty table stays empty."""
    spark = docs.sparkSession
    for _, index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not sent.value.leaks(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and test item that it holds."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
