"""Hard negatives of anchors: product quantisation with stored residual norms, rigorous bounds, exact integer scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

#: Vectors of the sample that the codebooks are fitted to, at most about so many; what is indexed is every row.
FIT_ROWS = 4096
#: Dimensions of a part, centres of a part's codebook (codes are bytes), and rounds that fit them.
PART, CENTRES, ROUNDS = 2, 256, 8
#: Anchors that are searched in one pass over the rows: what is broadcast holds no more than these and their positives.
ANCHORS = 4096
#: Anchors and rows whose table scores a task holds at once.
TILE_ANCHORS, TILE_ROWS = 256, 4096
#: Ids of rows without one: they come last among ties.
_NO_ID = 2**63 - 1
_FOUND = "anchor_id long, positive_id long, positive_score long, anchor long, place int, vec_id long, score long"


def parts(width: int) -> list[slice]:
    return [slice(k, min(k + PART, width)) for k in range(0, width, PART)]


def fit_part(points: np.ndarray) -> np.ndarray:
    """At most CENTRES centres by Lloyd's rounds from evenly spaced distinct points."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= CENTRES:
        return distinct
    centres = distinct[np.linspace(0, len(distinct) - 1, CENTRES).astype(int)]
    for _ in range(ROUNDS):
        code = nearest(points, centres)
        n = np.bincount(code, minlength=CENTRES)
        sums = np.stack([np.bincount(code, points[:, k], CENTRES) for k in range(points.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for k in range(0, len(points), 8192):
        out[k : k + 8192] = ((centres**2).sum(1) / 2 - points[k : k + 8192] @ centres.T).argmin(1)
    return out


def encode(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every part, and the length of what every part's centre leaves over."""
    codes, left = np.zeros((len(vectors), len(books)), np.uint8), np.zeros((len(vectors), len(books)))
    for k, (at, book) in enumerate(zip(parts(vectors.shape[1]), books, strict=True)):
        code = nearest(vectors[:, at], book)
        codes[:, k], left[:, k] = code, np.sqrt(((vectors[:, at] - book[code]) ** 2).sum(1))
    return codes, left


def bounded_scores(anchors: np.ndarray, codes: np.ndarray, left: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each row can have with each anchor.

    A part's product with the anchor is that of its centre, looked up in the anchor's table, plus that of what is
    left over, which is at most the product of both lengths.
    """
    table, reach = np.zeros((len(anchors), len(codes))), np.zeros((len(anchors), len(books)))
    for k, (at, book) in enumerate(zip(parts(anchors.shape[1]), books, strict=True)):
        table += np.take(anchors[:, at] @ book.T, codes[:, k], axis=1)
        reach[:, k] = np.sqrt((anchors[:, at] ** 2).sum(1))
    longest = np.array([np.sqrt((book**2).sum(1).max()) for book in books])
    away = reach @ left.T * (1 + 1e-9)
    away += (1e-12 * reach @ longest)[:, None] + 1e-6  # rounding of the sums
    return table - away, table + away


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


class Best:
    """The ``n`` first rows by descending score and ascending id of each of many lists, and what a row must reach to enter."""

    def __init__(self, lists: int, n: int):
        self.n = n
        self.score = np.full((lists, n), np.iinfo(np.int64).min)
        self.id = np.full((lists, n), _NO_ID)
        self.has = np.zeros((lists, n), bool)

    def least(self) -> np.ndarray:
        """Score of the last row of a full list."""
        return np.where(self.has[:, -1], self.score[:, -1].astype(float), -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        touched = np.unique(at)
        old = self.has[touched]
        row = np.repeat(touched, self.n).reshape(old.shape)
        at = np.concatenate([at, row[old]])
        score, ids = np.concatenate([score, self.score[touched][old]]), np.concatenate([ids, self.id[touched][old]])
        by = np.lexsort((ids, -score, at))
        at, score, ids = at[by], score[by], ids[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.n
        self.has[touched] = False
        self.score[at[keep], place[keep]], self.id[at[keep], place[keep]], self.has[at[keep], place[keep]] = score[keep], ids[keep], True


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of an index as arrays: row numbers, ids, labels, vectors, codes, lengths left over."""
    for batch in batches:
        for k in range(0, len(batch), TILE_ROWS):
            x = batch.slice(k, TILE_ROWS).to_pydict()
            flat = lambda name, kind: np.frombuffer(b"".join(x[name]), kind).reshape(len(x["row"]), -1)
            yield np.array(x["row"]), np.array(x["vec_id"]), np.array(x["label"]), flat("vector", np.int64), flat("codes", np.uint8), flat("left", np.float64)


def _pairs(anchors: np.ndarray, rows: tuple[np.ndarray, ...], books: list[np.ndarray], wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, exact score) of the pairs that ``wanted`` cannot rule out by their bounds."""
    for k in range(0, len(anchors), TILE_ANCHORS):
        low, high = bounded_scores(anchors[k : k + TILE_ANCHORS].astype(float), rows[4], rows[5], books)
        a, r = np.nonzero(wanted(slice(k, k + TILE_ANCHORS), low, high))
        if len(a):
            yield a + k, r, exact_scores(anchors[a + k], rows[3][r])


def _positives(block: pd.DataFrame, books: list[np.ndarray], n: int):
    """The first ``n`` other rows of each anchor's label, of those that a task holds."""
    own, ids, labels = (block[c].to_numpy(np.int64) for c in ("row", "vec_id", "label"))
    anchors = np.stack([np.frombuffer(x, np.int64) for x in block["vector"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), n)
        for rows in _read(batches):

            def wanted(s, low, high):
                ok = (labels[s, None] == rows[2]) & (own[s, None] != rows[0])
                # Of these rows the n-th largest lower bound, or what earlier rows have reached.
                floor = best.least()[s]
                if len(rows[0]) >= n:
                    floor = np.maximum(floor, np.partition(np.where(ok, low, -np.inf), len(rows[0]) - n, axis=1)[:, len(rows[0]) - n])
                return ok & (high >= floor[:, None])

            for a, r, score in _pairs(anchors, rows, books, wanted):
                best.add(a, score, rows[1][r])
        yield _found(best, ids, np.arange(len(ids)), np.zeros(len(ids), np.int64))

    return run


def _negatives(block: pd.DataFrame, wins: pd.DataFrame, books: list[np.ndarray], n: int, low_percent: int, high_percent: int):
    """The first ``n`` rows in the window of each (anchor, positive), of those that a task holds."""
    ids, labels = (block[c].to_numpy(np.int64) for c in ("vec_id", "label"))
    anchors = np.stack([np.frombuffer(x, np.int64) for x in block["vector"]])
    of, place, goal, positive = (wins[c].to_numpy(np.int64) for c in ("anchor", "place", "score", "vec_id"))
    slot = np.full((len(block), int(place.max()) + 1), -1)
    slot[of, place] = np.arange(len(wins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(wins), n)
        for rows in _read(batches):
            floor = np.maximum(low_percent * goal / 100, best.least())
            least, top = np.full(len(block), np.inf), np.full(len(block), -np.inf)
            np.minimum.at(least, of, floor)
            np.maximum.at(top, of, high_percent * goal / 100)

            def wanted(s, low, high):
                return (labels[s, None] != rows[2]) & (high >= least[s, None] - 1) & (low <= top[s, None] + 1)

            for a, r, score in _pairs(anchors, rows, books, wanted):
                for j in range(slot.shape[1]):
                    w = slot[a, j]
                    ok = (w >= 0) & (low_percent * goal[w] <= 100 * score) & (100 * score <= high_percent * goal[w])
                    best.add(w[ok], score[ok], rows[1][r[ok]])
        yield _found(best, ids[of], of, place, positive, goal)

    return run


def _found(best: Best, ids: np.ndarray, anchor: np.ndarray, place: np.ndarray, positive: np.ndarray | None = None, goal: np.ndarray | None = None) -> pa.RecordBatch:
    k, j = np.nonzero(best.has)
    none = pa.nulls(len(k), pa.int64())
    return pa.RecordBatch.from_pydict(
        {
            "anchor_id": pa.array(ids[k], pa.int64()),
            "positive_id": none if positive is None else pa.array(positive[k], pa.int64()),
            "positive_score": none if goal is None else pa.array(goal[k], pa.int64()),
            "anchor": pa.array(anchor[k], pa.int64()),
            "place": pa.array(place[k], pa.int32()),
            "vec_id": pa.array(best.id[k, j], pa.int64()),
            "score": pa.array(best.score[k, j], pa.int64()),
        }
    )


def quantised(table: DataFrame, scale: int) -> DataFrame:
    """Rows that take part: (vec_id, label, vector) with whole-number components, floor(scale * x)."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("double"))
    fit = F.coalesce(~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & (F.size("embedding") > 0), F.lit(False))
    rows = table.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fit).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("vector"))
    small = F.aggregate("vector", F.lit(0.0), lambda s, e: s + e * e) < float(2**56)
    return rows.where(small).withColumn("vector", F.transform("vector", lambda e: e.cast("long")))


def mine(rows: DataFrame, is_anchor: F.Column, *, n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """Hard negatives of rows (vec_id, label, vector of whole numbers); returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product with the anchor; higher scores come first, ties by smaller id, rows without an id
    last. An anchor's positives are its first ``n_positives`` other rows of its label; a positive's negatives are the
    first ``n_negatives`` rows of other labels whose score lies between ``low_percent`` and ``high_percent`` of the
    positive's. Codebooks of two dimensions a part are fitted to a sample of about FIT_ROWS rows; every row is stored
    with its codes and the lengths that the codes leave over. ANCHORS anchors at a time meet all rows in one pass
    without an exchange: bounds from the anchor's tables rule rows out, the rest are scored exactly, and each task
    passes on its first rows only. Nothing is cut off by the bounds that the exact score would let in.
    Vectors of different lengths do not meet. Rows that repeat an id are rows of their own: an anchor's copy may be
    its positive. An empty table gives no rows.
    """
    stage = Stage(rows.sparkSession, "negatives")
    rows = stage.write(rows.select("vec_id", "label", "vector", F.size("vector").alias("width"), is_anchor.alias("asks")), "rows")
    out = [_mined(stage, rows.where(F.col("width") == w), n, w, n_positives, n_negatives, low_percent, high_percent) for w, n in sorted(tuple(r) for r in rows.groupBy("width").count().collect())]
    out = [x for found in out for x in found]
    if not out:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _mined(stage: Stage, rows: DataFrame, n: int, width: int, n_positives: int, n_negatives: int, low_percent: int, high_percent: int) -> list[DataFrame]:
    spark = stage.spark
    below = -(2**63) + min(2**64 - 1, 2**64 * FIT_ROWS // max(1, n))
    sample = rows.where(F.xxhash64("vec_id", "vector") <= F.lit(below))
    if sample.isEmpty():
        sample = rows.limit(1)
    cut = parts(width)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        book = fit_part(np.array(pdf["x"].tolist(), float))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "side": [book.shape[1]], "book": [book.ravel()]})

    pieces = F.posexplode(F.array(*[F.slice("vector", s.start + 1, s.stop - s.start) for s in cut])).alias("part", "x")
    fitted = sample.select(pieces).groupBy("part").applyInPandas(fit, "part int, side int, book array<double>").toPandas().sort_values("part")
    books = [np.array(b).reshape(-1, s) for b, s in zip(fitted["book"], fitted["side"], strict=True)]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                v = np.array(pdf["vector"].tolist(), np.int64)
                codes, left = encode(v.astype(float), books)
                yield pdf[["row", "vec_id", "label", "asks"]].assign(vector=[x.tobytes() for x in v], codes=[x.tobytes() for x in codes], left=[x.tobytes() for x in left])

    kinds = "row long, vec_id long, label long, asks boolean, vector binary, codes binary, left binary"
    indexed = stage.write(rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(index, kinds), f"index-{width}")
    asking = indexed.where("asks").select("row", "vec_id", "label", "vector")
    # Blocks of anchors by a hash of their rows' numbers, which are all different: a tenth of room is over ten deviations.
    asked = asking.count()
    blocks = 1 if asked <= ANCHORS else -(-asked * 11 // (ANCHORS * 10))
    every, out = indexed.drop("asks"), []
    for k in range(blocks):
        block = asking.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).toPandas()
        if not len(block):
            continue
        first = every.mapInArrow(_positives(block, books, n_positives), _FOUND)
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
        wins = first.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n_positives).select("anchor", (F.col("at") - 1).alias("place"), "vec_id", "score").toPandas()
        if not len(wins):
            continue
        last = every.mapInArrow(_negatives(block, wins, books, n_negatives, low_percent, high_percent), _FOUND)
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
        last = last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
        known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
        last = last.select("anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(stage.write(last, f"found-{width}-{k}"))
    return out


def op11_product_quantised_negatives(spark, sf_dir: str) -> DataFrame:
    """Five positives of every hundredth vector, and of each the five hardest negatives between 80% and 100% of its score."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    seven = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    rows = quantised(table.withColumn("label", F.when(seven, (F.col("label") + 1) % 10).otherwise(F.col("label"))), 256)
    return mine(rows, F.coalesce((F.col("vec_id") != _NO_ID) & (F.col("vec_id") % 100 == 0), F.lit(False)))


def oracle() -> str:
    return """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
    from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, cast(row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as integer) as rank,
    s.id as negative_id, p.score as positive_score, s.score as negative_score
    from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select * from n where rank <= 5
"""
