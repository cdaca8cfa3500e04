"""Exact threshold pairs of embeddings by a dual traversal of cover trees, with links and components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, components

#: Vectors of the sample from which the top levels of the tree are built, and centres that they may have.
TOP_SAMPLE, TOP_CENTRES = 2048, 64
#: Vectors of one subtree, and of one side of a pair of subtrees' task.
TREE_ROWS, SIDE_ROWS = 2048, 8192
#: Pairs of points that are compared without going further down the trees.
LEAF_PAIRS = 1 << 16
_SLACK = 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first to a safe size, so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class CoverTree:
    """Nested levels with halving radii over unit vectors.

    The points of a node are ``order[first[node]:last[node]]``; the first of them is its centre and also
    the centre of its first child. ``radius`` is the node's covering radius, measured, so at most that
    of its level.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.first: list[int] = []
        self.last: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(points)
        self.points = points[self.order]
        self.rough = self.points.astype(np.float32)  # for pruning; what is found is compared in double precision

    def _node(self, parent: int, first: int, last: int, radius: float) -> int:
        node = len(self.first)
        self.first.append(first)
        self.last.append(last)
        self.radius.append(radius)
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(node)
        return node

    def _grow(self, points: np.ndarray) -> None:
        stack = [(-1, 0, len(points), 2.0)]
        while stack:
            parent, low, high, r = stack.pop()
            members = self.order[low:high].copy()
            dots = points[members] @ points[members].T
            node = self._node(parent, low, high, math.sqrt(max(0.0, 2 - 2 * float(dots[0].min()))) if len(members) > 1 else 0.0)
            while r > self.radius[node] > 0:
                r /= 2  # levels that would hold this node alone
            left, at = np.arange(len(members)), low
            while len(left):
                near = dots[left[0], left] >= 1 - r * r / 2
                near[0] = True
                group, left = left[near], left[~near]
                self.order[at : at + len(group)] = members[group]
                if len(group) == 1 or len(group) == len(members):
                    self._node(node, at, at + len(group), 0.0 if len(group) == 1 else self.radius[node])
                else:
                    stack.append((node, at, at + len(group), r / 2))
                at += len(group)


def _within(dots: np.ndarray, ra: np.ndarray, rb: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Entries that the largest radii of their rows' and columns' size groups may let pass."""
    found = []
    groups = [[np.flatnonzero((r > low) & (r <= high)) for low, high in ((-1, 0.05), (0.05, 0.3), (0.3, 9))] for r in (ra, rb)]
    for x in groups[0]:
        for y in groups[1]:
            if len(x) and len(y):
                reach = far + ra[x].max() + rb[y].max() + _SLACK
                part = dots[np.ix_(x, y)] if len(x) < len(ra) or len(y) < len(rb) else dots
                i, j = np.nonzero(part >= (1 - reach**2 / 2 if reach < 2 else -2))
                found.append((x[i], y[j]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _compare(a: CoverTree, b: CoverTree, x: np.ndarray, y: np.ndarray, first: np.ndarray, sizes: np.ndarray, cosine: float):
    """For each node of ``x`` all points of its ``y`` nodes at once: places of near points, and their nodes."""
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    edges = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1 if len(x) else np.zeros(0, np.int64)
    for lo, hi in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=False):
        node, others = int(x[lo]), y[lo:hi]
        size = sizes[others]
        q = np.repeat(first[others] - np.cumsum(size) + size, size) + np.arange(size.sum())
        p, k = np.nonzero(a.rough[a.first[node] : a.last[node]] @ b.rough[q].T >= cosine - _SLACK)
        if len(p):
            yield p + a.first[node], q[k], np.full(len(p), node), np.repeat(others, size)[k]


def _hits(a: CoverTree, b: CoverTree, p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    hit = (a.points[p] * b.points[q]).sum(1) >= cosine
    if a is b:
        hit &= (p < q) | (x != y)
    return p[hit], q[hit]


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), points of ``a`` and ``b``, with that cosine or more; for a is b each pair once.

    Starts from the pair of roots; a pair of nodes is dropped when its centres are farther apart than
    the threshold distance and both covering radii; else its nodes are replaced by their children, down
    to nodes without children or few points, whose points are compared.
    """
    if not a.first or not b.first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = math.sqrt(2 - 2 * cosine)
    fa, fb, ra, rb = np.array(a.first), np.array(b.first), np.array(a.radius), np.array(b.radius)
    na_size, nb_size = np.array(a.last) - fa, np.array(b.last) - fb
    leaf_a, leaf_b = np.array([not c for c in a.children]), np.array([not c for c in b.children])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(np.array([0]), np.array([0]))]  # products of node lists
    while stack:
        na, nb = stack.pop()
        dots = a.rough[fa[na]] @ b.rough[fb[nb]].T
        i, j = _within(dots, ra[na], rb[nb], far)
        reach = far + ra[na[i]] + rb[nb[j]] + _SLACK
        near = (reach >= 2) | (dots[i, j] >= 1 - reach**2 / 2)
        if a is b:
            near &= na[i] <= nb[j]
        x, y = na[i[near]], nb[j[near]]
        stop = (na_size[x] * nb_size[y] <= LEAF_PAIRS) | (leaf_a[x] & leaf_b[y])
        for k in np.flatnonzero(~stop).tolist():
            stack.append((np.array(a.children[x[k]] or [x[k]]), np.array(b.children[y[k]] or [y[k]])))
        x, y = x[stop], y[stop]
        over = na_size[x] >= nb_size[y]
        for p, q, px, qy in _compare(a, b, x[over], y[over], fb, nb_size, cosine):
            out.append(_hits(a, b, p, q, px, qy, cosine))
        for q, p, qy, px in _compare(b, a, y[~over], x[~over], fa, na_size, cosine):
            out.append(_hits(a, b, p, q, px, qy, cosine))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = (np.concatenate(x) for x in zip(*out, strict=True))
    return a.order[p], b.order[q]


class Forest:
    """Union-find over positions; the links that joined two sets span all others."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def top_centres(sample: np.ndarray) -> np.ndarray:
    """The finest level of a cover tree of the sample that has no more than TOP_CENTRES nodes."""
    if not len(sample):
        return sample
    level, best = [np.arange(len(sample))], [0]
    r = 1.0
    while level:
        finer: list[np.ndarray] = []
        for members in level:
            left = members
            while len(left):
                inside = np.sqrt(np.maximum(0, 2 - 2 * sample[left] @ sample[left[0]])) <= r
                finer.append(left[inside])
                left = left[~inside]
        if len(finer) > TOP_CENTRES or r < 1e-3:
            # The nodes of that level with most points, the coarser level's among them.
            finer.sort(key=len, reverse=True)
            best = list(dict.fromkeys([*best, *(int(g[0]) for g in finer)]))[:TOP_CENTRES]
            break
        level, best = finer, [int(g[0]) for g in finer]
        r /= 2
    return sample[best]


def link_embeddings(table: DataFrame, *, cosine: float = 0.9) -> DataFrame:
    """Links of all vectors with cosine of at least ``cosine``; returns vec_id, n_links, component_id, kept.

    Equal vectors form a class, which enters the trees once and carries its size. The top of a cover tree
    comes from a bounded sample; every vector goes to its nearest top centre, and each cell, in parts of at
    most TREE_ROWS vectors where it is large, grows its subtree in one task. Pairs of cells whose covering
    radii rule out a link are dropped before any exchange; the rest meet in tasks of bounded size, each a
    dual traversal that emits link counts and a spanning forest of its links rather than all pairs.
    Vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing. Rows that
    repeat an id count as vectors of their own. A null id takes part; it is nobody's component unless alone.
    Vectors of different lengths do not link. An empty table gives no rows.
    """
    stage = Stage(table.sparkSession, "embeddings")
    spark = table.sparkSession
    valid = F.coalesce(
        (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    key = F.when(valid, F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), "embedding")), F.hex(F.xxhash64(F.lit(2), "embedding"))))
    rows = stage.write(table.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("key"), F.when(valid, F.col("embedding")).alias("embedding")), "rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding"))
    classes = stage.write(classes.select(F.monotonically_increasing_id().alias("cid"), "*", F.size("embedding").alias("width")), "classes")

    parts = []
    for width, _ in sorted(tuple(r) for r in classes.groupBy("width").count().collect()):
        parts.append(_links(stage, classes.where(F.col("width") == width).drop("width"), cosine, f"w{width}"))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = stage.write(found, "found")
    else:
        found = spark.createDataFrame([], "cid long, links long, u long, v long")
    counts = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(stage, found.where("u is not null").select("u", "v"))
    groups = classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "key", "size", "first_id", F.coalesce("component", "cid").alias("component"))
    least = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = groups.join(least, "component").join(counts, "cid", "left").select("key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(of_class, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(stage: Stage, classes: DataFrame, cosine: float, name: str) -> DataFrame:
    """(cid, links) and (u, v) rows: weighted link counts and spanning links between classes of one width."""
    spark = stage.spark
    far = math.sqrt(2 - 2 * cosine)
    # About TOP_SAMPLE classes of least hash; a task passes on those below the bound only.
    below = -(2**63) + min(2**64 - 1, 2**64 * TOP_SAMPLE // max(1, classes.count()))
    sample = classes.where(F.xxhash64("key") <= F.lit(below)).select("embedding").toArrow().column("embedding").to_pylist()
    sample = sample or [classes.select("embedding").first()[0]]
    centres = top_centres(unit(np.array(sample)))

    def nearest(frames):
        for pdf in frames:
            if len(pdf):
                dots = unit(np.array(pdf["embedding"].tolist())) @ centres.T
                cell = dots.argmax(1)
                away = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(cell)), cell]))
                yield pd.DataFrame({"cid": pdf["cid"], "size": pdf["size"], "cell": cell, "away": away, "vector": [np.asarray(v, np.float64).tobytes() for v in pdf["embedding"]]})

    dealt = stage.write(classes.select("cid", "size", "embedding").mapInPandas(nearest, "cid long, size long, cell int, away double, vector binary"), f"{name}-dealt")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).orderBy("cell").toPandas()
    n = int(cells["n"].sum())
    # Cells in order make sides; a large cell is divided by a hash. Both are bounded by the number of centres.
    cells["trees"] = -(-cells["n"] // TREE_ROWS)
    cells["first"] = cells["trees"].cumsum() - cells["trees"]
    total = int(cells["trees"].sum())
    sides = max(min(6, total), -(-n // SIDE_ROWS))
    side_of = lambda tree: tree * sides // total
    gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    pairs: set[tuple[int, int]] = set()
    spans = [(int(r.cell), float(r.r), side_of(int(r.first)), side_of(int(r.first + r.trees - 1))) for r in cells.itertuples()]
    for x, rx, x0, x1 in spans:
        for y, ry, y0, y1 in spans:
            if gap[x, y] <= far + rx + ry + _SLACK:
                pairs.update((s, t) for s in range(x0, x1 + 1) for t in range(y0, y1 + 1) if s <= t)
    meets: dict[int, list[int]] = {}
    numbered = sorted(pairs)
    for k, (s, t) in enumerate(numbered):
        for side in {s, t}:
            meets.setdefault(side, []).append(k)
    first = F.create_map(*[F.lit(int(x)) for r in cells.itertuples() for x in (r.cell, r.first)])
    trees = F.create_map(*[F.lit(int(x)) for r in cells.itertuples() for x in (r.cell, r.trees)])
    tree = F.element_at(first, F.col("cell")) + F.pmod(F.xxhash64("cid"), F.element_at(trees, F.col("cell"))).cast("int")
    side = F.expr(f"cast(tree * {sides}L div {total}L as int)")
    plan = spark.createDataFrame([(s, ks) for s, ks in meets.items()], "side int, meets array<int>")
    ends = {k: st for k, st in enumerate(numbered)}
    sent = dealt.withColumn("tree", tree).withColumn("side", side).join(F.broadcast(plan), "side").select(F.explode("meets").alias("meet"), "side", "tree", "cid", "size", "vector")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "cid"], kind="stable").reset_index(drop=True)
        s, t = ends[int(pdf["meet"].iloc[0])]
        vectors = unit(np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(len(pdf), -1))
        grown = {}
        for (side, tree), at in pdf.groupby(["side", "tree"], sort=True).indices.items():
            grown[side, tree] = (at, CoverTree(vectors[at]))
        weight, links, forest, spanning = pdf["size"].to_numpy(), np.zeros(len(pdf), np.int64), Forest(len(pdf)), []
        left, right = [k for k in grown if k[0] == s], [k for k in grown if k[0] == t]
        for x in left:
            for y in right:
                if s == t and x > y:
                    continue
                (ax, tx), (ay, ty) = grown[x], grown[y]
                i, j = dual_pairs(tx, ty, cosine)
                i, j = ax[i], ay[j]
                links += np.bincount(i, weight[j], len(pdf)).astype(np.int64) + np.bincount(j, weight[i], len(pdf)).astype(np.int64)
                spanning += [(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q)]
        cid = pdf["cid"].to_numpy()
        has = np.flatnonzero(links)
        u, v = ([int(cid[e[k]]) for e in spanning] for k in (0, 1))
        blank = [None]
        return pd.DataFrame({"cid": [*cid[has].tolist(), *blank * len(u)], "links": [*links[has].tolist(), *blank * len(u)], "u": [*blank * len(has), *u], "v": [*blank * len(has), *v]}, dtype=object)

    return sent.groupBy("meet").applyInPandas(run, "cid long, links long, u long, v long")


def op6_cover_tree_links(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component at a cosine of 0.9."""
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
