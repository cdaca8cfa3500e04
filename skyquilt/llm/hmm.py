"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by scaled forward recursion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, add_in_levels, utf8, words

#: Hidden states; words with an emission of their own; classes of the other words; words whose counts are sent to tasks.
STATES, HEAD, TAIL_CLASSES, TABLE = 8, 8192, 1024, 1 << 19
#: Rounds of Baum-Welch over all training texts, and over the bounded sample that only gives them a start.
ROUNDS, START_DOCS, START_ROUNDS = 4, 1500, 15
#: Tokens and texts that are worked on together.
BATCH_TOKENS, BATCH_DOCS = 1 << 19, 1024
END = HEAD + TAIL_CLASSES
SYMBOLS = END + 1


def tail_class(word: bytes) -> int:
    """Class of a word without an emission of its own: by its last three bytes."""
    return xxhash.xxh3_64_intdigest(word[-3:]) % TAIL_CLASSES


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols by states

    @staticmethod
    def random(frequency: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * rng.uniform(0.3, 1.7, (SYMBOLS, STATES))
        move = np.full((STATES, STATES), 0.02) + np.eye(STATES) * (1 - 0.02 * STATES)
        return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @staticmethod
    def fitted(start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray, weight: float = 200.0) -> Model:
        """From expected counts, smoothed towards the frequency of symbols so that nothing has probability zero."""
        emit = emit + weight * frequency[:, None]
        move, start = move + 0.1, start + 0.1
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def batches_of(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts by falling length, in batches of bounded size."""
    held, tokens = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if held and (len(held) >= BATCH_DOCS or tokens + len(texts[i]) > BATCH_TOKENS):
            yield held
            held, tokens = [], 0
        held.append(i)
        tokens += len(texts[i])
    if held:
        yield held


def by_time(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts sorted by falling length, place after place; and how many texts reach each place."""
    sizes = np.array([len(t) for t in texts])
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    place = np.concatenate([np.arange(n) for n in sizes])
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.concatenate([[0], np.cumsum(live)])
    out = np.empty(sizes.sum(), np.int64)
    out[at[place] + row] = np.concatenate(texts)
    return out, live


def forward(model: Model, tokens: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward recursion over texts side by side: log10 likelihoods, and if kept all states and scales."""
    likely, at = np.zeros(live[0]), 0
    states = np.empty((len(tokens) if keep else 0, STATES))
    scales = np.empty(len(tokens) if keep else 0)
    now = None
    for n in live.tolist():
        now = (model.start if now is None else now[:n] @ model.move) * model.emit[tokens[at : at + n]]
        scale = now.sum(1)
        now = now / scale[:, None]
        likely[:n] += np.log10(scale)
        if keep:
            states[at : at + n], scales[at : at + n] = now, scale
        at += n
    return likely, states, scales


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions."""
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
    for chosen in batches_of(texts):
        tokens, live = by_time([texts[i] for i in chosen])
        _, states, scales = forward(model, tokens, live, keep=True)
        ends = np.cumsum(live)
        back = np.ones((live[-1], STATES))
        for t in range(len(live) - 1, -1, -1):
            lo, hi = ends[t] - live[t], ends[t]
            if t:
                reached = model.emit[tokens[lo:hi]] * back / scales[lo:hi, None]
                before = states[ends[t - 1] - live[t - 1] : ends[t - 1]]
                move += before[: live[t]].T @ reached
                earlier = np.ones((live[t - 1], STATES))
                earlier[: live[t]] = reached @ model.move.T
            states[lo:hi] *= back
            if t:
                back = earlier
        start += states[: live[0]].sum(0)
        for k in range(STATES):
            emit[:, k] += np.bincount(tokens, states[:, k], SYMBOLS)
    return start, move * model.move, emit


def _held_out(column: str, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod == rest


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, kind, c): hash, tail class and count of every word; tasks count before rows are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found)).view(np.int64)
            kind = np.fromiter((tail_class(w) for w in found), np.int32, len(found))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(kind), pa.array(np.fromiter(found.values(), np.int64, len(found)))], names=["h", "kind", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words(utf8(text)))
            if len(found) > 1 << 20:
                yield rows()
                found.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "h long, kind int, c long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` words, on a scale of sixteenths of a power of two."""
    step = F.floor(F.log2("c") * 16).cast("int")
    left, cut = most, None
    for s, n in sorted(map(tuple, counts.groupBy(step).count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        cut = s
    return int(np.ceil(2 ** (cut / 16) - 1e-9)) if cut is not None else 2**62


@dataclass
class Table:
    """The most frequent words: their place by hash, counts and symbols; and the log of each tail class's total."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    class_log: np.ndarray
    end_count: int

    def places(self) -> dict[int, int]:
        return dict(zip(self.hashes.tolist(), range(len(self.hashes)), strict=True))


class Places(dict):
    """Word -> place in the table; words outside it get places behind it, with their hash and class."""

    def __init__(self, table: Table):
        super().__init__()
        self.table, self.known = table, table.places()
        self.hash: list[int] = []
        self.kind: list[int] = []

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        at = self.known.get(h)
        if at is None:
            at = len(self.known) + len(self.hash)
            self.hash.append(h)
            self.kind.append(tail_class(word))
        self[word] = at
        return at


def encode(docs: DataFrame, sent, mod: int, rest: int) -> DataFrame:
    """Every text as symbols, with the sums over the words in the table and the hashes of those outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Table = sent.value
        places, n = Places(table), len(table.hashes)
        log_count = np.log10(table.counts + 1.0)
        head = table.symbols < HEAD
        emit_log = np.where(head, 0.0, log_count - table.class_log[np.maximum(table.symbols.astype(np.int64) - HEAD, 0)])
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "codes", "tails"]
        end_log = float(np.log10(table.end_count + 1.0))
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                tokens = words(utf8(text))
                at = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
                inside = at[at < n]
                outside = (at[at >= n] - n).tolist()
                kinds = np.array([places.kind[i] for i in outside], np.int64)
                codes = np.empty(len(at) + 1, np.uint16)
                codes[:-1][at < n] = table.symbols[inside]
                codes[:-1][at >= n] = HEAD + kinds
                codes[-1] = END
                hashes = np.array([places.hash[i] for i in outside], np.uint64).view(np.int64)
                row = (len(at) + 1, len(inside) + (table.end_count > 0), float(log_count[inside].sum()) + end_log, float(emit_log[inside].sum() - table.class_log[kinds].sum()), codes.tobytes(), hashes)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                if len(places) > 1 << 20 or len(places.hash) > 20_000:
                    # Known words stay cheap to find again; the lists of unknown ones are kept short.
                    places = Places(table) if len(places) > 1 << 20 else _without_tails(places)
            kinds_of = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds_of, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _held_out("doc_id", mod, rest).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, emit double, codes binary, tails array<long>")


def _without_tails(places: Places) -> Places:
    n = len(places.known)
    for word in [w for w, at in places.items() if at >= n]:
        del places[word]
    places.hash, places.kind = [], []
    return places


def _texts(column) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16).astype(np.int64) for c in column]


def baum_welch_round(training: DataFrame, model: Model, frequency: np.ndarray) -> Model:
    """One round over all training texts: every task sums its texts' expected counts; the sums are added block by block on the executors."""
    sent = training.sparkSession.sparkContext.broadcast(model)
    rows = 1024  # symbols of a block

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            for total, part in zip((start, move, emit), expected_counts(sent.value, held), strict=True):
                total += part

        for pdf in frames:
            held += _texts(pdf["codes"])
            size = sum(map(len, held))
            if size > 8 * BATCH_TOKENS:
                add()
                held.clear()
        if held:
            add()
        blocks = [np.vstack([start, move]), *(emit[s : s + rows] for s in range(0, SYMBOLS, rows))]
        yield pd.DataFrame({"block": range(len(blocks)), "part": TaskContext.get().partitionId(), "sums": [b.tobytes() for b in blocks]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(sums=[np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0).tobytes()])

    sums = add_in_levels(training.select("codes").mapInPandas(count, "block int, part int, sums binary"), ["block"], total, training.rdd.getNumPartitions())
    got = {r.block: np.frombuffer(r.sums).reshape(-1, STATES) for r in sums.collect()}
    if not got:
        return model
    emit = np.vstack([got[k] for k in range(1, len(got))])
    return Model.fitted(got[0][0], got[0][1:], emit, frequency)


def score_texts(docs: DataFrame, *, mod: int = 7, rest: int = 2, seed: int = 3) -> DataFrame:
    """Scores all whole texts; returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(doc_id as text) mod ``mod`` is not ``rest``. Words are counted
    over all of them. The HEAD most frequent words are symbols of the model, every other word belongs to
    one of TAIL_CLASSES symbols by its ending, within which its share is (c + 1) over the class's sum of
    (c + 1), plus 1 for an unknown word: so the score is a log10 probability over the known words and one
    unknown word for each class. A bounded sample gives Baum-Welch its start only; every round sums the
    expected counts of all training texts. The TABLE most frequent words' counts are sent to tasks; the
    counts of all rarer words come by a join. Words are known by a 64-bit hash.

    Null texts are empty: the end alone. Null ids count as the empty text. Repeated rows count each time.
    Without any training text, known counts are 0 and the model is uniform over symbols. An empty table gives no rows.
    A text is one recursion in one task, whatever its length: while it trains, about 200 bytes a token (8 states, three times).
    """
    spark = docs.sparkSession
    stage = Stage(spark, "hmm")
    train = docs.where(~_held_out("doc_id", mod, rest))
    counts = stage.write(word_counts(train), "counts")
    ends = train.count()
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, types = n_words + ends, n_types + (ends > 0)
    top = counts.where(F.col("c") >= _least_count(counts, TABLE)).select("h", "kind", "c").toArrow().to_pandas()
    top = top.sort_values(["c", "h"], ascending=[False, True], kind="stable").reset_index(drop=True)
    head = top.head(HEAD)
    symbols = np.where(np.arange(len(top)) < HEAD, np.arange(len(top)), HEAD + top["kind"].to_numpy(np.int64)).astype(np.uint16)
    class_total, class_tokens = np.ones(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for kind, c, n in counts.groupBy("kind").agg(F.sum("c"), F.count("*")).collect():
        class_total[kind] += c + n
        class_tokens[kind] += c
    np.subtract.at(class_total, head["kind"].to_numpy(np.int64), head["c"].to_numpy() + 1.0)
    np.subtract.at(class_tokens, head["kind"].to_numpy(np.int64), head["c"].to_numpy().astype(float))
    frequency = np.concatenate([np.pad(head["c"].to_numpy(float), (0, HEAD - len(head))), class_tokens, [ends]]) + 0.5
    frequency /= frequency.sum()
    sent = spark.sparkContext.broadcast(Table(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), symbols, np.log10(class_total), ends))
    coded = stage.write(encode(docs, sent, mod, rest).withColumn("uid", F.monotonically_increasing_id()), "coded")

    training = coded.where(~F.col("held_out"))
    # About START_DOCS texts of least hash; a task passes on those below the bound only.
    below = -(2**63) + min(2**64 - 1, 2**64 * START_DOCS // max(1, ends))
    sample = training.where(F.xxhash64("uid") <= F.lit(below)).select("codes").toArrow().column("codes").to_pylist()
    model, texts = Model.random(frequency, seed), _texts(sample)
    for _ in range(START_ROUNDS if texts else 0):
        model = Model.fitted(*expected_counts(model, texts), frequency, weight=20.0)
    for _ in range(ROUNDS):
        model = baum_welch_round(training, model, frequency)
    final = spark.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, out = _texts(pdf["codes"]), np.zeros(len(pdf))
            for chosen in batches_of(texts):
                out[chosen] = forward(final.value, *by_time([texts[i] for i in chosen]), keep=False)[0]
            yield pd.DataFrame({"uid": pdf["uid"], "likely": out})

    likely = coded.select("uid", "codes").mapInPandas(score, "uid long, likely double")
    rare = coded.select("uid", F.explode("tails").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare"), F.count("c").alias("rare_known"))
    rows = coded.drop("codes", "tails").join(likely, "uid").join(rare, "uid", "left")
    more = F.coalesce("rare", F.lit(0.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        (F.col("likely") + F.col("emit") + more).alias("score"),
    )


def op8_hidden_markov_model(spark, sf_dir: str) -> DataFrame:
    """The base score and the model's score of every document."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
