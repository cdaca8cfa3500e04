"""Prefix trie of conversations: partitioned by the first turn, pointer tries inside tasks, large subtries dealt again by the next turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, number_in_order

#: Turns of distinct conversations that one task's tries hold: larger subtries are dealt again by the next turn.
TASK_TURNS = 1 << 15
#: Ids that are joined to a text at once.
IDS_AT_ONCE = 1 << 13
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_key(role: Column, text: Column) -> Column:
    """Half of the SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def numbered_turns(stage: Stage, table: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, chars): turns in order, null first, ties by role and text; a null role or text is empty. Rows without conv_id take no part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = table.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), turn_key(role, text).alias("turn"), F.length(text).cast("long").alias("chars"), F.substring(role, 1, 64).alias("_role"), F.xxhash64(role).alias("_hash"))
    order = [F.col("_turn").asc_nulls_first(), F.col("_role").asc(), F.col("_hash").asc(), F.col("turn").asc()]
    return number_in_order(stage, turns, "conv_id", order, "turns").select("conv_id", "pos", "turn", "chars")


def rebuilt(stage: Stage, turns: DataFrame, base: Column, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns, each starting with the first ``borrowed`` (at most ``most``) turns of ``base`` in place of its own."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    convs = stage.write(convs.withColumn("base", base).withColumn("h", borrowed.cast("long")), "convs")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = stage.write(convs.join(lengths, "base", "left").withColumn("shift", F.col("h") - F.least("h", F.coalesce("base_length", F.lit(0)))), "based")
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "turn", "chars")
    # Only conversations whose base is too short need more than their own rows: the rest keep their places.
    moved = convs.where("shift > 0").select("conv_id", "shift")
    own = turns.join(moved, "conv_id", "left").where(F.col("pos") >= borrowed)
    own = own.select("conv_id", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "turn", "chars")
    return convs.select("conv_id"), stage.write(taken.unionByName(own), "rebuilt")


def distinct_paths(stage: Stage, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(path, length, n, ends): conversations that are equal as a whole are one path, known by its smallest id.

    A conversation's key adds up hashes of (place, turn), so long conversations are summed before they are exchanged.
    Equal conversations' ids are joined in order in pieces of IDS_AT_ONCE and hashed piece after piece; a task
    holds one piece, however many copies there are.
    """
    lane = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "pos", "turn")).alias(f"k{k}")
    keys = turns.groupBy("conv_id").agg(lane(1), lane(2), F.count("*").alias("length"))
    keys = convs.join(keys, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k1", "k2", "length")])
    parts = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["length", "k1", "k2", "conv_id"]
    pieces = keys.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInPandas(_pieces, "length long, k1 long, k2 long, first long, n long, ids string")
    by = ["length", "k1", "k2", "first"]
    dealt = pieces.repartition(parts, "length", "k1", "k2").sortWithinPartitions(*by)
    return stage.write(dealt.mapInPandas(_hashed, "path long, length long, n long, ends string"), "paths")


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    key = pdf[["length", "k1", "k2"]].to_numpy()
    edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(pdf)], strict=True):
        yield tuple(key[low].tolist()), low, high


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        ids, out = pdf["conv_id"].to_numpy(), []
        if len(pdf):
            for key, low, high in _runs(pdf):
                for k in range(low, high, IDS_AT_ONCE):
                    part = ids[k : min(high, k + IDS_AT_ONCE)].tolist()
                    out.append((*key, part[0], len(part), ",".join(map(str, part))))
        yield pd.DataFrame(out, columns=["length", "k1", "k2", "first", "n", "ids"])


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, first, n, sha = None, 0, 0, hashlib.sha256()
    for pdf in frames:
        out = []
        for *k, f, m, ids in pdf[["length", "k1", "k2", "first", "n", "ids"]].itertuples(index=False):
            if k != key:
                if key is not None:
                    out.append((first, key[0], n, sha.hexdigest()))
                key, first, n, sha = k, f, 0, hashlib.sha256()
            sha.update((b"," if n else b"") + ids.encode())
            n += m
        yield pd.DataFrame(out, columns=["path", "length", "n", "ends"])
    if key is not None:
        yield pd.DataFrame([(first, key[0], n, sha.hexdigest())], columns=["path", "length", "n", "ends"])


class Trie:
    """Nodes as parallel lists, children as dictionaries from a turn to a node; node 0 stands for what all paths have behind them."""

    def __init__(self):
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.chars, self.n, self.least, self.ends = [-1], [0], [0], [None], [NO_ENDS]

    def insert(self, path: int, n: int, turns: list[bytes], chars: list[int], ends: str) -> None:
        node = 0
        for turn, size in zip(turns, chars, strict=True):
            step = self.children[node].get(turn)
            if step is None:
                step = self.children[node][turn] = len(self.parent)
                self.children.append({})
                self.parent.append(node)
                self.chars.append(size)
                self.n.append(0)
                self.least.append(path)
                self.ends.append(NO_ENDS)
            node = step
            self.n[node] += n
            self.least[node] = min(self.least[node], path)
        self.ends[node] = ends

    def totals(self) -> tuple[list[int], list[int]]:
        """Leaves and saved characters of every node's subtree, children before their parents."""
        leaves, saved = [0] * len(self.parent), [0] * len(self.parent)
        stack = [(0, iter(self.children[0].values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(self.children[child].values())))
                continue
            stack.pop()
            if not self.children[node]:
                leaves[node] = 1
            saved[node] += (self.n[node] - 1) * self.chars[node]
            if stack:
                above = stack[-1][0]
                leaves[above] += leaves[node]
                saved[above] += saved[node]
        return leaves, saved


def _tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtries of a task's groups; ``root`` marks the top of each."""
    out = []
    pdf = pdf.sort_values(["grp", "path", "pos"], kind="stable")
    for (group, depth), rows in pdf.groupby(["grp", "depth"], sort=False, dropna=False):
        trie = Trie()
        path, turn, chars, n, ends = (rows[c].to_numpy() for c in ("path", "turn", "chars", "n", "ends"))
        edges = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        for low, high in zip(edges, edges[1:]):
            trie.insert(int(path[low]), int(n[low]), turn[low:high].tolist(), chars[low:high].tolist(), ends[high - 1])
        leaves, saved = trie.totals()
        level = [int(depth) - 1] * len(trie.parent)
        for k in range(1, len(trie.parent)):
            up = trie.parent[k]
            level[k] = level[up] + 1
            out.append((bytes(group), up == 0, trie.least[k], level[k], trie.least[up] if up else None, trie.n[k], len(trie.children[k]), leaves[k], saved[k], trie.ends[k]))
    names = ["grp", "top", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    frame = pd.DataFrame(out, columns=names)
    return frame.astype({"parent_conv_id": "Int64"})


def build(convs: DataFrame, turns: DataFrame, *, stage: Stage, task_turns: int = TASK_TURNS) -> DataFrame:
    """Nodes of the trie of conversations (conv_id) and their turns (conv_id, pos, turn, chars).

    Paths are grouped by their first turn. Groups of at most ``task_turns`` turns are hashed into tasks of about that
    many and built there. The paths of a larger group share their turns down to the first place where they
    differ or one of them ends: these nodes come from one of the paths, and what is below is grouped again by the next
    turn, until all groups fit. A group of one path is a row of nodes at any length. Totals go back up level by level.
    """
    paths = distinct_paths(stage, convs, turns)
    rows = turns.join(paths.withColumnRenamed("path", "conv_id"), "conv_id")
    rows = stage.write(rows.select(F.col("conv_id").alias("path"), "pos", "turn", "chars", "n", "length", F.when(F.col("pos") == F.col("length") - 1, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends")), "rows")
    # Groups: grp is the digest of the turns down to the group's top node, whose depth is ``depth``.
    open_ = rows.where("pos = 0").select("path", F.col("turn").alias("grp"), F.lit(1).cast("long").alias("depth"))
    spines, done, level = [], [], 0
    while True:
        open_ = stage.write(open_, f"open-{level}")
        # The path itself is known by its longest place, so a group's turns are summed from one row a path.
        member = open_.join(paths.select("path", "length", "n"), "path")
        groups = stage.write(member.groupBy("grp", "depth").agg(F.count("*").alias("paths"), F.sum(F.col("length") - F.col("depth") + 1).alias("turns"), F.sum("n").alias("n_convs"), F.min("path").alias("least")), f"groups-{level}")
        fits = groups.where(F.col("turns") <= task_turns)
        size = fits.agg(F.sum("turns")).first()[0] or 0
        tasks = max(1, -(-size // task_turns))
        small = open_.join(fits.select("grp", "depth"), ["grp", "depth"])
        held = rows.join(small, "path").where(F.col("pos") >= F.col("depth") - 1).withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks)))
        kinds = "grp binary, top boolean, " + NODE
        done.append(stage.write(held.select("task", "grp", "depth", "path", "pos", "turn", "chars", "n", "ends").groupBy("task").applyInPandas(_tries, kinds), f"nodes-{level}"))
        large = groups.where(F.col("turns") > task_turns)
        if large.isEmpty():
            break
        spine, open_ = _cut(stage, rows, open_, large, level)
        spines.append(spine)
        level += 1
    return _joined(stage, convs, paths, done, spines)


def _cut(stage: Stage, rows: DataFrame, open_: DataFrame, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Of groups that are too large: the nodes that all of a group's paths share, and the groups below the last of them.

    A spine's rows are (grp, depth, last, at, path, chars, n_convs, ends): the node at depth ``at`` of a group whose shared turns end at depth ``last``.
    """
    members = rows.join(open_.join(large.select("grp", "depth", "paths", "n_convs", "least"), ["grp", "depth"]), "path").where(F.col("pos") >= F.col("depth") - 1)
    places = members.groupBy("grp", "depth", "pos").agg(F.count("*").alias("c"), F.max("paths").alias("paths"), F.min("turn").alias("a"), F.max("turn").alias("b"))
    # The first place where paths differ or one has ended; without one the group is a single path.
    first = places.where("c < paths or a <> b").groupBy("grp", "depth").agg(F.min("pos").alias("last"))
    whole = places.groupBy("grp", "depth").agg(F.max("pos").alias("top"))
    last = stage.write(whole.join(first, ["grp", "depth"], "left").select("grp", "depth", F.coalesce("last", F.col("top") + 1).alias("last")), f"last-{level}")
    members = members.join(last, ["grp", "depth"])
    spine = members.where((F.col("path") == F.col("least")) & (F.col("pos") < F.col("last"))).select("grp", "depth", "last", (F.col("pos") + 1).alias("at"), "path", "chars", "n_convs")
    ended = members.where((F.col("length") == F.col("last")) & (F.col("pos") == F.col("last") - 1)).select("grp", "depth", "ends")
    spine = spine.join(ended.withColumnRenamed("ends", "_ends"), ["grp", "depth"], "left").withColumn("ends", F.when(F.col("at") == F.col("last"), F.coalesce("_ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS))).drop("_ends")
    below = members.where(F.col("pos") == F.col("last")).select("path", F.substring(F.unhex(F.sha2(F.concat("grp", F.col("depth").cast("string").cast("binary"), "turn"), 256)), 1, 16).alias("grp"), (F.col("last") + 1).alias("depth"), F.col("grp").alias("above"))
    spine = stage.write(spine, f"spine-{level}")
    below = stage.write(below, f"below-{level}")
    stage.write(below.groupBy("grp", "depth").agg(F.first("above").alias("above")), f"above-{level}")
    return spine, below.drop("above")


def _joined(stage: Stage, convs: DataFrame, paths: DataFrame, done: list[DataFrame], spines: list[DataFrame]) -> DataFrame:
    """All nodes: those of the tries with the parents of their tops, shared nodes with totals of what is below, the root."""
    names = [c.split()[0] for c in NODE.split(", ")]
    out, tops = [], None
    for level in range(len(done) - 1, -1, -1):
        nodes = done[level]
        below = nodes.where("top")
        if level < len(spines):
            spine = spines[level]
            # Sub-tops are those of the next level, with the group above each.
            sums = tops.groupBy("above").agg(F.count("*").alias("subs"), F.sum("n_leaves").alias("sub_leaves"), F.sum("saved_tokens").alias("sub_saved"))
            rest = Window.partitionBy("grp", "depth").orderBy(F.desc("at"))
            end = F.col("at") == F.col("last")
            full = spine.join(sums, F.col("grp") == F.col("above"), "left").select(
                "grp",
                (F.col("at") == F.col("depth")).alias("top"),
                F.col("path").alias("conv_id"),
                F.col("at").alias("depth"),
                F.when(F.col("at") > F.col("depth"), F.col("path")).alias("parent_conv_id"),
                "n_convs",
                F.when(end, F.coalesce("subs", F.lit(0))).otherwise(1).alias("n_children"),
                F.coalesce("sub_leaves", F.lit(1)).alias("n_leaves"),
                (F.coalesce("sub_saved", F.lit(0)) + F.sum((F.col("n_convs") - 1) * F.col("chars")).over(rest)).alias("saved_tokens"),
                F.col("ends").alias("ends_sha256"),
            )
            nodes = stage.write(nodes.unionByName(full), f"all-{level}")
            below = nodes.where("top")
        if level:
            # The node above a top is the last of the shared nodes of the group above.
            above = stage.spark.read.parquet(f"{stage.root}/above-{level - 1}")
            least = spines[level - 1].where("at = last").select(F.col("grp").alias("above"), F.col("path").alias("up"))
            linked = above.join(least, "above")
            tops = stage.write(below.join(linked.select("grp", "above"), "grp"), f"tops-{level}")
            nodes = nodes.join(linked.select("grp", "up"), "grp", "left").withColumn("parent_conv_id", F.when(F.col("top"), F.col("up")).otherwise(F.col("parent_conv_id")))
        else:
            tops = below
        out.append((nodes, level))
    root_of = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    sums = tops.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    empty = paths.where("length = 0").agg(F.max("ends").alias("ends"))
    root = root_of.crossJoin(sums).crossJoin(empty).where("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    root = stage.write(root, "root")
    found = root
    for nodes, level in out:
        if not level:
            nodes = nodes.crossJoin(F.broadcast(root.select(F.col("conv_id").alias("up")))).withColumn("parent_conv_id", F.when(F.col("top"), F.col("up")).otherwise(F.col("parent_conv_id")))
        found = found.unionByName(nodes.select(*names))
    return found


def prefix_trie(table: DataFrame, *, base: Column, borrowed: Column, most: int, task_turns: int = TASK_TURNS) -> DataFrame:
    """Nodes of the prefix trie of conversations (conv_id, turn, role, text), each rebuilt on the first turns of another.

    A conversation starts with the first ``borrowed`` turns (a column over conv_id, at most ``most``) of conversation
    ``base`` (likewise; fewer or none where it is shorter or absent), then has its own turns after as many. A node is
    a distinct sequence of first turns, from the root without turns; it has its smallest member (conv_id), depth, its
    parent's smallest member, members, children, childless nodes in its subtree, the characters that sharing saves in its
    subtree (of every node's last text once for each member but one) and the SHA-256 of the ids that end there.
    Turns are ordered by ``turn``, null first, ties by role and text; rows that repeat are turns of their own. A
    null role or text is empty. Rows without conv_id take no part; other columns are not read. A conversation may
    have no turns left: it is a member of the root. An empty table has no nodes.
    """
    stage = Stage(table.sparkSession, "trie")
    turns = numbered_turns(stage, table)
    convs, turns = rebuilt(stage, stage.write(turns, "numbered"), base, borrowed, most)
    return build(convs, turns, stage=stage, task_turns=task_turns)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each on the first turns of its hundred's first."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = F.col("conv_id")
    return prefix_trie(table, base=c - F.pmod(c, F.lit(100)), borrowed=F.crc32(c.cast("string")) % 6, most=5)


def oracle() -> str:
    return """
with recursive turns as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
    from conversations where conv_id is not null),
own as (select c, list({'r': r, 't': t} order by i) as l from turns group by c),
crc as (select c, cast(c as varchar) as s, 0 as k, cast(4294967295 as bigint) as v from own
    union all select c, s, k + 1, xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end)
    from (select c, s, k, case when k % 8 = 0 then xor(v, cast(ascii(substr(s, k // 8 + 1, 1)) as bigint)) else v end as x from crc where k < 8 * length(s))),
h as (select c, xor(v, 4294967295) % 6 as h from crc where k = 8 * length(s)),
p as (select h.c, list_concat(coalesce(list_slice(b.l, 1, h.h), []), list_slice(o.l, h.h + 1, len(o.l))) as p
    from h join own o on o.c = h.c left join own b on b.c = h.c - h.c % 100),
members as (select c, p, unnest(range(0, len(p) + 1)) as d from p),
nodes as (select list_slice(p, 1, d) as q, d, min(c) as conv_id, count(*) as n, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (len(p) = d), '')) as ends from members group by 1, 2),
kids as (select list_slice(q, 1, d - 1) as q, count(*) as n from nodes where d > 0 group by 1),
own_sums as (select nodes.*, coalesce(kids.n, 0) as n_children, case when d > 0 then (nodes.n - 1) * length(nodes.q[d].t) else 0 end as saved from nodes left join kids on kids.q = nodes.q),
ups as (select q, d, n_children, saved, unnest(range(0, d + 1)) as e from own_sums),
sums as (select list_slice(q, 1, e) as q, e as d, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved from ups group by 1, 2)
select x.conv_id, x.d as depth, up.conv_id as parent_conv_id, x.n as n_convs, x.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, x.ends as ends_sha256
from own_sums x join sums s on s.d = x.d and s.q = x.q left join nodes up on up.d = x.d - 1 and up.q = list_slice(x.q, 1, x.d - 1)
"""
