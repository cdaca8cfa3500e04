"""Exact Jaccard join of word-shingle sets by extended prefixes with token combinations."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, WordHash, add_in_levels, components, mix, shingles, signed, utf8, words

#: A token is frequent from so many sets on: (sets, tokens in a combination). Below SMALL tokens a set uses single tokens for all.
CLASSES, SMALL = ((64, 2), (4096, 3)), 16
#: Counted tokens of a chunk, the unit in which tasks hand over sets and get back the classes of their tokens.
CHUNK = 1 << 19
#: Bits of the filter that chooses texts to be read again, for each chosen set, and at most.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
#: Words of 64 bits in a set's parity sketch: bit b tells whether an odd number of its tokens fall on b.
SKETCH = 16
#: Pivots that a set meets in a round after the first, and rounds before what is still apart is compared pair by pair.
PIVOTS, ROUNDS = 8, 4
#: Eighths of the signatures up to which pairs are compared in one go: sets that share many meet in the first.
SLICES = (1, 8)
ALONE, RARE, UNCOUNTED = 0, 1, 9


def set_of(text: str | None, n: int, hashes: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingles(hashes.of(words(utf8(text))), n))


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    data = tokens.tobytes()
    return xxhash.xxh3_64_intdigest(data), xxhash.xxh3_64_intdigest(data, 1)


def order_of(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ np.uint64(0x5851F42D4C957F2D))


def needed(size: int, num: int, den: int) -> int:
    """Length of a prefix that holds a token of every overlap that a link needs."""
    return size - -(-num * size // den) + 1


def levels(size: int, num: int, den: int) -> list[int]:
    """Levels (powers of two) of the larger set in a pair that a set of this size can be in; 0 below SMALL."""
    return sorted({n.bit_length() - 1 if n >= SMALL else 0 for n in (size, size * den // num)})


def groups_of(level: int, num: int, den: int) -> int:
    """Groups of a class: so many that a group holds a few tokens of a prefix, whatever the size of the set."""
    return max(1, -(-needed(1 << level, num, den) // 2))


def most_needed(size: int, num: int, den: int) -> int:
    """The longest prefix that a set can need, whatever the classes of its tokens."""
    loss = sum(k - 1 for _, k in CLASSES)
    return needed(size, num, den) + max(loss * groups_of(v, num, den) if v else 0 for v in levels(size, num, den))


def counted_share(num: int, den: int) -> np.uint64:
    """Tokens of a lower order are counted: twice as many as a prefix of rare tokens needs."""
    return np.uint64(min(0.9, 2 * (1 - num / den)) * 2.0**64)


def candidates(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens that can be in the set's prefix, in order of their hashes: all counted ones, and others if those may be too few."""
    order = order_of(tokens)
    by = np.argsort(order)
    n = int(np.searchsorted(order[by], counted_share(num, den)))
    return tokens[by[: max(n, min(len(tokens), most_needed(len(tokens), num, den)))]]


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(17)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(a: str, b: str, na: str, nb: str, num: int, den: int) -> str:
    """Condition that sizes and sketches leave a link possible: sets differ in at least as many tokens as sketches do in bits."""
    bits = " + ".join(f"bit_count({a}{k} ^ {b}{k})" for k in range(SKETCH))
    return f"least({na}, {nb}) * {den} >= greatest({na}, {nb}) * {num} and ({na} + {nb} - ({bits})) * {num + den} >= {2 * num} * ({na} + {nb})"


@functools.cache
def _places_of(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


class Signatures:
    """The signatures of a set, so that two sets of Jaccard ``num / den`` or more share one.

    Tokens are ordered by class, rare ones first, and by hash in a class. A token that occurs in no other
    set comes first of all: it takes its place in the prefix but is no signature. With t the smallest
    overlap that a partner can have, a prefix is extended until its tokens, less one short of a combination
    for each group of a frequent class, exceed size - t: if in every group of both prefixes fewer tokens
    than a combination were shared, the overlap could not reach t. So single tokens of the rare class and
    combinations within the groups of frequent classes, taken from the prefix, are enough. Groups grow in
    number with the set, so a set has about as many combinations as its prefix has tokens; sets of a pair
    use the groups of the larger one's level, so a set near a power of two gives signatures of two levels.
    Tokens that were not counted come last, in the groups of the last class.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def __call__(self, size: int, tokens: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """``tokens``: the set's candidates; ``kind``: ALONE, RARE, RARE + number of the class, or UNCOUNTED."""
        need = needed(size, self.num, self.den)
        by = np.lexsort((order_of(tokens), kind))
        tokens, kind = tokens[by], kind[by]
        alone, known = (int(np.searchsorted(kind, k, side="right")) for k in (ALONE, RARE))
        if alone >= need:
            return np.zeros(0, np.uint64)
        out = [mix(tokens[alone : min(need, known)] + np.uint64(1))]
        if known < need:
            rest, classes = tokens[known:], np.minimum(kind[known:] - RARE, len(CLASSES)).tolist()
            for level in levels(size, self.num, self.den):
                out.append(self._combinations(rest, classes, need - known, level) if level else mix(rest[: need - known] + np.uint64(2)))
        return np.unique(np.concatenate(out))

    def _combinations(self, tokens: np.ndarray, classes: list[int], need: int, level: int) -> np.ndarray:
        parts = groups_of(level, self.num, self.den)
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (part, c) in enumerate(zip((mix(tokens) % np.uint64(parts)).tolist(), classes, strict=True)):
            if need <= 0:
                break
            group = groups.setdefault((c, part), [])
            group.append(i)
            need -= len(group) >= CLASSES[c - 1][1]
        if need > 0:
            raise RuntimeError("a set's candidates are too few")
        out = [np.zeros(0, np.uint64)]
        for (c, part), group in groups.items():
            k = CLASSES[c - 1][1]
            if len(group) >= k:
                chosen = np.sort(tokens[group])[_places_of(len(group), k)]
                h = np.full(len(chosen), (level * 16 + c) << 40 | part, np.uint64)
                for j in range(k):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chosen[:, j])
                out.append(h)
        return np.concatenate(out)


def _scan(docs: DataFrame, n_words: int, num: int, den: int, blocks: int) -> DataFrame:
    """First pass: ``what`` 0 are rows of documents (size, keys and sketch of their sets), 1 a chunk's sets, 2 a chunk's counted tokens by block of their hashes."""
    names = ["what", "doc_id", "d1", "d2", "size", "k1", "k2", "sketch", "chunk", "block", "first", "data", "more"]
    kinds = [pa.int8(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    share = counted_share(num, den)

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHash(), set()
        held: list[tuple[int, int, int, np.ndarray]] = []
        count = done = 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0

        def report() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([t for *_, t in held])
            # Tokens in order of their hashes, so those of a block stand together and the counted ones come first.
            order = order_of(flat)
            distinct, first, place, sets = np.unique(order, return_index=True, return_inverse=True, return_counts=True)
            tokens = flat[first]
            ends = np.cumsum([len(t) for *_, t in held])
            # A set's places, followed by the tokens of those that were not counted.
            counted = int(np.searchsorted(distinct, share))
            rows = []
            for (_, _, _, t), e in zip(held, ends.tolist(), strict=True):
                at = place[e - len(t) : e]
                n = int((at < counted).sum())
                rows.append(np.uint32(n).tobytes() + at[:n].astype(np.uint32).tobytes() + t[n:].tobytes())
            chunk = (task << 32) + done
            k1, k2, size = (np.array([h[i] for h in held], np.uint64) for i in range(3))
            yield batch_of(len(held), what=np.ones(len(held), np.int8), chunk=np.full(len(held), chunk), k1=signed(k1), k2=signed(k2), size=size.astype(np.int64), data=rows)
            block = (distinct[:counted] // (share // np.uint64(blocks) + np.uint64(1))).astype(np.int64)
            cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])[:counted]), counted)
            parts = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            # Few tokens are in several sets of a chunk: their places in the block, and the numbers of sets.
            more = [(k := np.flatnonzero(sets[p] > 1).astype(np.uint32)).tobytes() + sets[p][k].astype(np.uint32).tobytes() for p in parts]
            data = [tokens[p].tobytes() for p in parts]
            yield batch_of(len(parts), what=np.full(len(parts), 2, np.int8), chunk=np.full(len(parts), chunk), block=block[cut[:-1]].astype(np.int32), first=cut[:-1].astype(np.int32), data=data, more=more)

        for batch in batches:
            sizes, k1, k2, bits = [], [], [], []
            for text in batch.column(3).to_pylist():
                tokens = set_of(text, n_words, hashes)
                a, b = set_keys(tokens) if len(tokens) else (0, 0)
                sizes.append(len(tokens))
                k1.append(a)
                k2.append(b)
                bits.append(sketch_of(tokens))
                if len(tokens) and a not in seen:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(a)
                    held.append((a, b, len(tokens), candidates(tokens, num, den)))
                    count += len(held[-1][3])
                if count > CHUNK:
                    yield from report()
                    held, count, done = [], 0, done + 1
            keys = {n: signed(np.array(k, np.uint64)) for n, k in (("k1", k1), ("k2", k2))}
            own = {n: batch.column(i) for i, n in enumerate(("doc_id", "d1", "d2"))}
            yield batch_of(len(sizes), what=np.zeros(len(sizes), np.int8), size=sizes, sketch=bits, **keys, **own)
        if held:
            yield from report()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row_keys(), "text")
    return rows.mapInArrow(run, "what byte, doc_id long, d1 long, d2 long, size long, k1 long, k2 long, sketch array<long>, chunk long, block int, first int, data binary, more binary")


def _repeats(scan: DataFrame) -> DataFrame:
    """(chunk, at, kind, tokens): the counted tokens that several sets hold, with their classes by the number of sets.

    A block holds a range of hashes, so a group has the tokens of that range once for each chunk.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in pdf["data"]]
        sets = []
        for part, more in zip(parts, pdf["more"], strict=True):
            sets.append(np.ones(len(part)))
            k, n = np.frombuffer(more, np.uint32).reshape(2, -1)
            sets[-1][k] = n
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(sets))
        kind = np.searchsorted([2, *(c[0] for c in CLASSES)], n, side="right").astype(np.uint8)[inverse]
        out, at = [], 0
        for chunk, first, part in zip(pdf["chunk"], pdf["first"], parts, strict=True):
            k = kind[at : at + len(part)]
            at += len(part)
            keep = np.flatnonzero(k)
            if len(keep):
                out.append((chunk, (keep + first).astype(np.uint32).tobytes(), k[keep].tobytes(), part[keep].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "at", "kind", "tokens"])

    return scan.where("what = 2").select("chunk", "block", "first", "data", "more").groupBy("block").applyInPandas(count, "chunk long, at binary, kind binary, tokens binary")


def _row_keys() -> list:
    return [F.xxhash64(F.lit(k), "doc_id", "text").alias(f"d{k}") for k in (1, 2)]


def _signature_rows(scan: DataFrame, repeats: DataFrame, sign: Signatures, clash: frozenset[int]) -> DataFrame:
    """Second pass, by chunk: (sig, id, least). A chunk gives each signature's smallest id once (least null), and links others of its ids to it."""

    def run(sets: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        parts = [(n := int(np.frombuffer(x, np.uint32, 1)[0]), np.frombuffer(x, np.uint32, n, 4), np.frombuffer(x, np.uint64, -1, 4 + 4 * n)) for x in sets["data"]]
        side = 1 + max((int(p.max()) for _, p, _ in parts if len(p)), default=0)
        kind, token = np.zeros(side, np.uint8), np.zeros(side, np.uint64)
        for at, k, t in zip(known["at"], known["kind"], known["tokens"], strict=True):
            at = np.frombuffer(at, np.uint32)
            kind[at], token[at] = np.frombuffer(k, np.uint8), np.frombuffer(t, np.uint64)
        found, ids = [], []
        for (n, p, t), k1, k2, size in zip(parts, sets["k1"], sets["k2"], sets["size"], strict=True):
            key = k2 if k1 & (2**64 - 1) in clash else k1
            s = sign(size, np.concatenate([token[p], t]), np.concatenate([kind[p], np.full(len(t), UNCOUNTED, np.uint8)]))
            found.append(s)
            ids.append(np.full(len(s), key, np.int64))
        sig, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, ids))
        by = np.lexsort((ids, sig))
        sig, ids = sig[by], ids[by]
        first = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
        least = ids[np.flatnonzero(first)][np.cumsum(first) - 1] if len(sig) else ids
        return pd.DataFrame({"sig": signed(sig), "id": ids, "least": pd.arrays.IntegerArray(least, first)})

    sets = scan.where("what = 1").select("chunk", "k1", "k2", "size", "data")
    return sets.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInPandas(run, "sig long, id long, least long")


def _stars(rows: DataFrame) -> DataFrame:
    """(sig, id, least) for every id of a signature that several tasks found, but the smallest: the sorted rows are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            sig, ids = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(sig):
                continue
            first = np.append(True, sig[1:] != sig[:-1])
            least = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
            if last and last[0] == sig[0]:
                least[sig == sig[0]] = last[1]
            last = (sig[-1], least[-1])
            keep = ids != least
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(ids[keep]), pa.array(least[keep])], names=["sig", "id", "least"])

    return rows.select("sig", "id").repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(run, "sig long, id long, least long")


def _filter(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """Bits set at the places of all ``n`` values: FILTER_BITS for each, MOST_FILTER_BITS at most. Tasks' parts are joined in levels."""
    size = min(MOST_FILTER_BITS, max(1 << 16, 1 << (FILTER_BITS * n).bit_length()))
    width = max(1 << 16, size >> 6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, bool)
        for pdf in frames:
            for at in _places(pdf[column].to_numpy(), size):
                bits[at] = True
        used = np.flatnonzero(bits.reshape(-1, width).any(1))
        yield pd.DataFrame({"block": used, "part": TaskContext.get().partitionId(), "bits": [np.packbits(bits[k * width : (k + 1) * width]).tobytes() for k in used]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(bits=[np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()])

    out = np.zeros((size // width, width // 8), np.uint8)
    parts = keys.select(column).mapInPandas(run, "block int, part int, bits binary")
    for r in add_in_levels(parts, ["block"], join, keys.rdd.getNumPartitions()).toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _places(values: np.ndarray, size: int) -> list[np.ndarray]:
    x = np.ascontiguousarray(values, np.int64).view(np.uint64)
    return [(mix(x + np.uint64(k)) % np.uint64(size)).astype(np.int64) for k in (11, 12, 13)]


def _fetch(docs: DataFrame, n_words: int, chosen, clash: frozenset[int]) -> DataFrame:
    """(d1, id, tokens) of the rows whose key the filter ``chosen`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHash(), chosen.value
        for batch in batches:
            keep = np.logical_and.reduce([(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1 for at in _places(batch.column(0).to_numpy(), 8 * len(bits))])
            part = batch.filter(pa.array(keep))
            sets = [set_of(t, n_words, hashes) for t in part.column(1).to_pylist()]
            ids = [b if a in clash else a for a, b in map(set_keys, sets)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(np.array(ids, np.uint64))), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["d1", "id", "tokens"])

    return docs.select(_row_keys()[0], "text").mapInArrow(run, "d1 long, id long, tokens array<long>")


def shingle_links(docs: DataFrame, *, n_words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Every row's class of linked shingle sets: doc_id, d1, d2 (keys of the row), n_shingles, component_id, id.

    Two rows link when ``den`` * intersection >= ``num`` * union of their sets. Equal sets form a class
    and are handled once. Signatures (see ``Signatures``) bring together all sets that can link; the
    classes of tokens come from their counts over all texts, exchanged by ranges of hashes, so they do not
    depend on how rows are dealt. In each signature a set meets pivots that are still in another component,
    round after round; only sets of one signature that remain in different components are compared pair by
    pair, after their sizes and sketches. So groups of similar sets cost as many comparisons as they have
    members, and no link between components is lost. Nothing but counts and a filter of bounded size
    passes through the driver; when the filter is full, more texts are read again and results stay the same.

    Null texts and texts without words have no set: n_shingles 0, component_id their own doc_id. A null
    doc_id takes part; it is a component's id only where no other is. Repeated rows are equal sets. A long
    text is a set like others, with signatures in proportion to its words. An empty table gives no rows.
    """
    if num * 4 <= den * 3:
        raise ValueError("a similarity above 0.75 is needed")
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    blocks = max(64, 2 * docs.rdd.getNumPartitions())
    scan = stage.write(_scan(docs, n_words, num, den, blocks), "scan")
    rows = stage.write(scan.where("what = 0").select("doc_id", "d1", "d2", "size", "k1", "k2", "sketch"), "rows")
    classes = rows.where("size > 0").groupBy("k1").agg(F.min("k2").alias("low"), F.max("k2").alias("high"))
    clash = frozenset(r[0] & (2**64 - 1) for r in classes.where("low <> high").select("k1").toLocalIterator())
    own = F.when(F.col("size") > 0, F.when(F.col("k1").isin([signed(np.array([c], np.uint64))[0].item() for c in clash]), F.col("k2")).otherwise(F.col("k1")) if clash else F.col("k1"))
    rows = rows.select("doc_id", "d1", "d2", "size", own.alias("id"), "sketch")

    repeats = stage.write(_repeats(scan), "repeats")
    found = stage.write(_signature_rows(scan, repeats, Signatures(num, den), clash), "signatures")
    stage.drop("repeats")
    stage.drop("scan")
    stars = _stars(found.where("least is null")).unionByName(found.where("least is not null and id <> least"))
    stars = stage.write(stars, "stars")
    stage.drop("signatures")

    sizes = rows.where("id is not null").groupBy("id").agg(F.first("size").alias("size"), F.min("d1").alias("d1"), F.min("doc_id").alias("doc_id"), *[F.min(F.col("sketch")[k]).alias(f"x{k}") for k in range(SKETCH)])
    sizes = stage.write(sizes, "classes")
    taking_part = stars.select("id").union(stars.select("least")).distinct()
    involved = stage.write(sizes.join(taking_part, "id", "left_semi"), "involved")
    chosen = spark.sparkContext.broadcast(_filter(involved, "d1", involved.count()))
    sets = _fetch(docs, n_words, chosen, clash).join(involved.select("id", "d1"), ["id", "d1"], "left_semi").dropDuplicates(["id"]).select("id", "tokens")
    sets = stage.write(sets, "sets")

    side = lambda c: involved.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), *[F.col(f"x{k}").alias(f"{c}{k}") for k in range(SKETCH)])

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that sizes and sketches leave possible."""
        return pairs.join(side("u"), "u").join(side("v"), "v").where(may_link("u", "v", "nu", "nv", num, den)).select("u", "v", "nu", "nv")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("tokens").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("tokens").alias("sv")), "v")
        common = F.size(F.array_intersect("su", "sv"))
        return both.where(den * common >= num * (F.col("nu") + F.col("nv") - common)).select("u", "v")

    # Rounds: in each signature whose sets are in several components, every set meets pivots of other
    # components, first one that is the same in all signatures, then some that each signature draws for
    # itself; of those that are possible for it, a set is compared with two.
    members = stage.write(stars.select("sig", "id").union(stars.select("sig", "least")).distinct(), "members-0")
    of = members.select(F.col("id").alias("node"), F.col("id").alias("component")).where("false")
    tried = links = None
    for k in range(ROUNDS):
        labelled = members.join(of.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("c"))
        draw = lambda j, k=k: F.min(F.struct(F.xxhash64("id", *([F.lit(j), F.lit(k), "sig"] if k else [])).alias("h"), "id", "c"))
        per = labelled.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), *[draw(j).alias(f"p{j}") for j in range(2 if k else 1)]).where("low <> high").drop("low", "high")
        mixed = stage.write(labelled.join(per, "sig"), f"members-{k + 1}")
        stage.drop(f"members-{k}")
        members = mixed.select("sig", "id")
        if k:
            pairs = mixed.select(F.col("id").alias("u"), "c", F.explode(F.array("p0", "p1")).alias("p")).where("c <> p.c").select("u", F.col("p.id").alias("v"))
        else:
            other = mixed.where("c <> p0.c").groupBy("sig").agg(draw(0).alias("q"))
            pairs = mixed.join(other, "sig").select(F.col("id").alias("u"), F.when(F.col("c") == F.col("p0.c"), F.col("q.id")).otherwise(F.col("p0.id")).alias("v"))
        pairs = pairs.groupBy("u").agg(*[F.min(F.struct(F.xxhash64("v", "u", F.lit(j)).alias("h"), "v")).alias(f"m{j}") for j in range(PIVOTS)])
        pairs = pairs.select("u", F.explode(F.array_distinct(F.array(*[F.col(f"m{j}.v") for j in range(PIVOTS)]))).alias("v"))
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        two = possible(pairs).groupBy("u").agg(*[F.min(F.struct(F.xxhash64("v", "u", F.lit(j)).alias("h"), "v", "nu", "nv")).alias(f"m{j}") for j in (8, 9)])
        now = stage.write(two.select("u", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{m}.{c}").alias(c) for c in ("v", "nu", "nv")]) for m in ("m8", "m9")]))).alias("m")).select("u", "m.*"), f"tried-{k}")
        good = stage.write(verified(now), f"links-{k}")
        tried = now.select("u", "v") if tried is None else tried.unionByName(now.select("u", "v"))
        links = good if links is None else links.unionByName(good)
        if good.isEmpty():
            break
        of = stage.write(components(stage, links, f"cc{k}"), f"of-{k}")
    # What is still apart, pair by pair: first in a few signatures, then in more, so that sets which share
    # many of them are in one component by then and are not paired in each.
    before = 0
    for k, end in enumerate(SLICES):
        part = members.where(F.pmod(F.xxhash64("sig"), F.lit(SLICES[-1])).between(before, end - 1))
        before = end
        labelled = part.join(of.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("c"))
        several = labelled.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
        left = stage.write(labelled.join(several, "sig", "left_semi").join(involved.drop("d1", "doc_id"), "id"), f"left-{k}")
        other = left.select("sig", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("size").alias("nv"), *[F.col(f"x{j}").alias(f"y{j}") for j in range(SKETCH)])
        apart = F.expr(f"id > v and c <> cv and {may_link('x', 'y', 'size', 'nv', num, den)}")
        rest = left.withColumnRenamed("sig", "s").join(other, (F.col("s") == F.col("sig")) & apart).select(F.col("id").alias("u"), "v", F.col("size").alias("nu"), "nv").distinct()
        last = stage.write(verified(rest), f"links-rest-{k}")
        stage.drop(f"left-{k}")
        if not last.isEmpty():
            links = last if links is None else links.unionByName(last)
            of = stage.write(components(stage, links, f"cc-rest-{k}"), f"of-rest-{k}")

    of_class = sizes.join(of.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("c"))
    least = of_class.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_class = stage.write(of_class.join(least, "c").select("id", "c", "component_id"), "component")
    out = rows.join(of_class, "id", "left")
    return out.select("doc_id", "d1", "d2", F.col("size").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("c").alias("id"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id (then row key); rows without words all stay. An empty table stays empty."""
    stage = Stage(docs.sparkSession, "near-copies")
    found = stage.write(shingle_links(docs, **options), "rows")
    best = found.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "d1", "d2")).alias("m"))
    alone = found.where("id is null").select("d1", "d2", F.lit(False).alias("one"))
    keep = best.select("m.d1", "m.d2", F.lit(True).alias("one")).union(alone.distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_keys())
    kept = row.join(keep, ["d1", "d2"])
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("d1", "d2").orderBy("one")))
    return kept.where("place = 1 or not one").select("row.*")


def op7_token_combination_join(spark, sf_dir: str) -> DataFrame:
    """Every document's component of links at a Jaccard similarity of 0.85 over 4-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shingle_links(docs, n_words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
