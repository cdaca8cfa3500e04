"""Quality scores: random Fourier features of document statistics, ridge by partition sums, isotonic calibration."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, add_in_levels, utf8

FEATURES = 256
FOLDS = 4
#: Calibration bins over raw scores; the isotonic fit sees bin sums only.
BINS = 2000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, each of moderate size; an empty or null text has the zero vector but for its last entry."""
    b = utf8(text)
    tokens = b.split()
    if not tokens:
        return [0.0] * 25 + [1.0]
    n, k = len(b), len(tokens)
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    letters = hist[_LETTER].sum()
    upper, digits = hist[65:91].sum(), hist[48:58].sum()
    space = hist[[9, 10, 11, 12, 13, 32]].sum()
    rare = hist[[35, 36, 37, 38, 42]].sum()
    sizes = np.fromiter(map(len, tokens), np.int64, k)
    counts = Counter(tokens)
    top = counts.most_common(1)[0][1]
    same_next = sum(a == c for a, c in zip(tokens, tokens[1:]))
    ends = b"".join(t[-1:] for t in tokens)
    last = np.bincount(np.frombuffer(ends, np.uint8), minlength=256)
    capital = sum(t.isupper() for t in tokens)
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    p = hist[hist > 0] / n
    packed = len(zlib.compress(b, 1)) / n
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        letters / n,
        upper / max(1, letters),
        10 * digits / n,
        space / n,
        10 * rare / n,
        10 * hist[33] / n,
        10 * hist[124] / n,
        10 * (hist[46] + hist[44]) / n,
        10 * hist[63] / n,
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        float(np.log1p(sizes.max())),
        len(counts) / k,
        top / k,
        same_next / k,
        (last[35] + last[36] + last[37] + last[38] + last[42]) / k,
        last[33] / k,
        (last[46] + last[44]) / k,
        counts.get(b"|", 0) / k,
        capital / k,
        repeated / max(1, len(lines)),
        float(np.log1p(k / max(1, len(lines)))),
        float(-(p * np.log(p)).sum()),
        float(packed),
    ]


WIDTH = len(statistics(None))


def _lists(texts: list[str | None]) -> pa.ListArray:
    stats = np.array([statistics(t) for t in texts], np.float32).reshape(-1, WIDTH)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, WIDTH, dtype=np.int32)), pa.array(stats.ravel()))


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, WIDTH)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``stats`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(batch.column(1).to_pylist())], names=["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<float>")


class Model:
    """Standardisation, Fourier directions, ridge weights (one set for each fold left out, last of all rows) and calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(WIDTH, FEATURES)) * np.sqrt(1.0 / WIDTH)
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros((FOLDS + 1, FEATURES + 1))
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.phases), np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights[FOLDS]
        return np.interp(raw, *self.steps)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit to total / weight by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total, strict=True):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), t / w) for w, t, k in blocks]) if blocks else np.zeros(0)




def _array(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, WIDTH))


def fit(train: DataFrame, *, seed: int = 5, ridge: float = 1e-4) -> Model:
    """Fits the model to ``train`` (stats, y, fold).

    Every task sums the outer products of its rows, fold by fold; the sums of all tasks are added in
    levels on the executors, and one (features + 1)-square system for each fold reaches the driver.
    Calibration uses each row's score from the weights fitted without its fold.
    """
    wide = train.select("stats", "y", "fold")

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for pdf in frames:
            x = _array(pdf["stats"])
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pd.DataFrame({"i": np.arange(WIDTH), "n": n, "s": s, "q": q})

    got = wide.mapInPandas(moments, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toPandas()
    n = int(got["n"].max()) if len(got) else 0
    if not n:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), seed)
    mean = got["s"].to_numpy() / n
    model = Model(mean, np.sqrt(np.maximum(got["q"].to_numpy() / n - mean**2, 1e-6)), seed)
    side = FEATURES + 1

    def normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FOLDS, side, side + 1))
        for pdf in frames:
            z, y, fold = model.features(_array(pdf["stats"])), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
            for f in range(FOLDS):
                m = fold == f
                sums[f] += z[m].T @ np.hstack([z[m], y[m, None]])
        yield pd.DataFrame({"fold": np.arange(FOLDS), "part": TaskContext.get().partitionId(), "sums": [x.tobytes() for x in sums]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(sums=[np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()])

    sums = np.zeros((FOLDS, side, side + 1))
    for r in add_in_levels(wide.mapInPandas(normal, "fold int, part int, sums binary"), ["fold"], add, train.rdd.getNumPartitions()).collect():
        sums[r.fold] = np.frombuffer(r.sums).reshape(side, side + 1)
    whole = sums.sum(0)
    for f in range(FOLDS + 1):
        part = whole - sums[f] if f < FOLDS else whole
        rows = max(1.0, part[-1, -2])
        model.weights[f] = np.linalg.solve(part[:, :side] + ridge * rows * np.eye(side), part[:, side])

    def left_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw = (model.features(_array(pdf["stats"])) * model.weights[pdf["fold"].to_numpy()]).sum(1)
            yield pd.DataFrame({"bin": np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1), "y": pdf["y"].to_numpy(float), "raw": raw})

    bins = wide.mapInPandas(left_out, "bin int, y double, raw double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("raw").alias("raw")).orderBy("bin").toPandas()
    level = isotonic(bins["n"].to_numpy(float), bins["y"].to_numpy(float))
    model.steps = (bins["raw"].to_numpy(), np.clip(level, 0.0, 1.0))
    return model


def _residue(column: str, m: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, held_out_mod: int = 5) -> DataFrame:
    """Scores every whole text; returns doc_id, held_out, score, predicted.

    Labels teach only where crc32(doc_id as text) mod ``held_out_mod`` is not 0; only the text's
    statistics enter a score. A document's labels are averaged; null labels and ids teach nothing. With
    no label at all every score is 0.5. Null texts score as empty ones; repeated rows are scored each. An
    empty table gives no rows; of a text of any length only its statistics are kept.
    """
    stage = Stage(docs.sparkSession, "quality")
    stats = stage.write(document_statistics(docs), "stats")
    model = fit_quality(stage, stats, labels, held_out_mod)
    return apply_quality(stats, model, threshold, held_out_mod)


def fit_quality(stage: Stage, stats: DataFrame, labels: DataFrame, held_out_mod: int = 5) -> Model:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = known.where(_residue("doc_id", held_out_mod) != 0)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = stats.join(known, "doc_id").select("stats", F.when(F.col("y") >= 0.5, 1.0).otherwise(0.0).alias("y"), fold.alias("fold"))
    return fit(stage.write(train, "train"))


def apply_quality(stats: DataFrame, model: Model, threshold: float, held_out_mod: int = 5) -> DataFrame:
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_flat(batch.column(1))))], names=["doc_id", "score"])

    out = stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (_residue("doc_id", held_out_mod) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns as they were; statistics are worked out once, next to the rows.

    Null and empty texts are judged by the score of the empty text, repeated rows each; an empty table stays empty.
    """
    stage = Stage(docs.sparkSession, "quality")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("stats", T.ArrayType(T.FloatType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(texts)], names=["row", "stats"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_flat(batch.column(1))) >= threshold)).select(["row"])

    rows = stage.write(docs.select(row).mapInArrow(measure, schema), "stats")
    model = fit_quality(stage, rows.select("row.doc_id", "stats"), labels)
    return rows.mapInArrow(keep, schema[:1]).select("row.*")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labelled documents outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels)
