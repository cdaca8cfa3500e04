"""Best-fit packing of documents into sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, union_all

CAPACITY = 2048
END_ID = 0


class Encoder:
    """Ids of a byte-level BPE. The tokenizer file decides; its rank form gives the same ids several times faster.

    A text that holds the string of a special token goes to the tokenizer itself, which gives it that token's id.
    """

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(END_ID)
        return np.array(ids, dtype="<u4")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity`` at the end, the first may be shorter."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def dual_bound(lengths: np.ndarray, capacity: int) -> int:
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def histogram_bound(count: np.ndarray, capacity: int) -> int:
    """A lower bound on the number of bins for ``count[n]`` items of each length n: the best of a family of dual feasible functions.

    For each threshold t up to half the capacity, items above capacity - t count as whole bins, items
    below t as nothing, the others as their length (Martello and Toth's L2); t = 0 is the volume bound.
    """
    volume = count * np.arange(capacity + 1)
    c_upto, v_upto = np.cumsum(count), np.cumsum(volume)
    t = np.arange(0, capacity // 2 + 1)
    large = c_upto[-1] - c_upto[capacity - t]
    middle = v_upto[capacity - t] - np.where(t > 0, v_upto[np.maximum(t - 1, 0)], 0)
    return int((large + -(-middle // capacity)).max())


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's free room. Bins by free room, so an item is O(log capacity)."""
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # free rooms that some bin has, in order
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = left = room - n
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins, offsets, np.array(free, dtype=np.int64)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; with ``keep_ids`` also the piece's ids. A null text is empty: one end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text)
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    for c, v in zip(cols, (doc, k, s, n, zlib.crc32(part.tobytes()), part.view(np.int32) if keep_ids else None), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def _pack_buckets(items: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing in each ``bucket``; a bin is named by the piece at its start. Adds the bin's free room and the bucket's bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "pid"], ascending=[False, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, free = best_fit(lengths, capacity)
        head = np.zeros(len(free), np.int64)
        head[bins[offsets == 0]] = pdf["pid"].to_numpy()[offsets == 0]
        return pdf.assign(sequence_id=head[bins], offset=offsets, room=free[bins], proven=len(free) == dual_bound(lengths, capacity))

    return items.groupBy("bucket").applyInPandas(run, f"pid long, {PIECES}, bucket long, sequence_id long, offset long, room long, proven boolean")


def least_bins(pieces: DataFrame, capacity: int) -> int:
    """The dual-feasible bound for all pieces, from the counts of the at most ``capacity`` different lengths."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        count[length] = n
    return histogram_bound(count, capacity)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, bucket_rows: int = 10_000, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into as few sequences of ``capacity`` tokens as it can.

    Documents longer than a sequence are cut; pieces that fill a sequence are placed at once. The others
    are dealt at random into buckets of about ``bucket_rows`` pieces, each with the same mix of lengths,
    and each bucket is packed by best-fit decreasing. A bucket's dual-feasible bound certifies its bin
    count; the same bound over all lengths certifies the whole. While the whole is not certified, the
    bins of all buckets that still have room exchange their documents: they are dealt anew, into fewer
    buckets, and packed again. It ends when certified or when a round saves no bin. Only counts and the
    histogram of lengths (at most ``capacity`` rows) reach the driver.

    Returns pid (the piece's number), doc_id, piece, start, length, ids_crc32, sequence_id, offset and,
    with ``keep_ids``, ids. Null texts are empty (one end id); equal documents and repeated ids are packed
    row by row; ties in length go by pid; an empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "pack")
    found = pieces_of(docs, capacity, tokenizer, keep_ids).withColumn("pid", F.monotonically_increasing_id())
    whole = stage.write(found, "pieces")
    pieces = whole.drop("ids")
    names = ["pid", "doc_id", "piece", "start", "length", "ids_crc32"]
    done = [pieces.where(F.col("length") == capacity).select(*names, F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items, kept, before, k = pieces.where(F.col("length") < capacity), 0, None, 0
    target, n = least_bins(items, capacity), items.count()
    while n:
        buckets = -(-n // bucket_rows)
        key = F.pmod(F.xxhash64("pid", F.lit(k)), F.lit(buckets)).cast("long")
        packed = stage.write(_pack_buckets(items.select(*names, key.alias("bucket")), capacity), f"packed-{k}")
        bins, loose = packed.where("offset = 0").agg(F.count("*"), F.coalesce(F.sum((F.col("room") > 0).cast("int")), F.lit(0))).first()
        last = buckets == 1 or kept + bins <= target or (before is not None and bins >= before)
        stay = packed if last else packed.where("room = 0")
        done.append(stay.select(*names, "sequence_id", "offset"))
        if last:
            break
        items, before, kept, k = packed.where("room > 0"), loose, kept + bins - loose, k + 1
        n = items.count()
    out = union_all(done)
    return out.join(whole.select("pid", "ids"), "pid") if keep_ids else out


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(docs)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
