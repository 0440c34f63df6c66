"""Best-fit packing by hierarchical residual packing.

Each partition packs its pieces best-fit (longest first) and sets its nearly full bins aside.
Underfull bins become items of the next round, in which a group of partitions' bins meets:
the tree of groups narrows until one bounded group is left or a round saves nothing more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .util import Scratch, batches, doc_text

LENGTH = 1024
#: Items that meet in one task at most on average: bounds a task's memory at any input size.
GROUP_ITEMS = 200_000
#: A bin with at most this share left empty is set aside.
SLACK = 0.002

_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _cut(path: str, end: int, size: int):
    def run(it):
        enc = tokens.encoder(path)
        for b in batches(it, 2048, 8 << 20):
            starts, ids = enc.encode(b.column(1), end)
            raw, rows = memoryview(ids.tobytes()), []
            for d, first, last in zip(b.column(0).to_pylist(), starts.tolist(), starts[1:].tolist()):
                at, k = first, 0
                while at < last:
                    to = at + ((last - at) % size or size) if k == 0 else at + size
                    rows.append((d, k, at - first, to - at, zlib.crc32(raw[4 * at : 4 * to])))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], _PIECES.names)

    return run


def pieces(docs: DataFrame, path: str | None = None, end: int = tokens.END_ID, size: int = LENGTH) -> DataFrame:
    """Documents as pieces of at most size ids; of a longer one the first piece is the shorter."""
    return doc_text(docs).mapInArrow(_cut(path or tokens.vocabulary_path(), end, size), _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, into the fullest open bin that still has room."""
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set when a bin with r left is open
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b = capacity, n
            n += 1
        out[i] = b
        if r := r - s:
            room[r].append(b)
            free |= 1 << r
    return out


_BINS = "bin string, fill long, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"


def _pack(level: int, capacity: int):
    """Packs whatever bins a task holds, GROUP_ITEMS at a time."""

    def run(it):
        from pyspark import TaskContext

        part, chunk, held, k = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            t = pa.Table.from_batches(chunk).combine_chunks()
            fill = t["fill"].to_numpy()
            to = best_fit(fill, capacity)
            order = np.argsort(to, kind="stable")
            members = t["members"].combine_chunks().take(pa.array(order)) if t.num_rows else None
            first = np.flatnonzero(np.diff(to[order], prepend=-1))
            lens = np.diff(members.offsets.to_numpy())
            edge = np.append(np.concatenate([[0], np.cumsum(lens)])[first], lens.sum())
            sums = np.add.reduceat(fill[order], first)
            names = [f"{level}-{part}-{k}-{j}" for j in range(len(first))]
            flat = members.flatten()
            fields = [flat.field(c) for c in _PIECES.names]
            end = np.cumsum(fields[3].to_numpy())
            start = end - fields[3].to_numpy()
            offset = pa.array(start - np.repeat(start[edge[:-1]], np.diff(edge)))
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([*fields, offset], [*_PIECES.names, "offset"]))
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums, pa.int64()), lists], ["bin", "fill", "members"])

        for b in it:
            if not b.num_rows:
                continue
            chunk.append(b)
            held += b.num_rows
            if held >= GROUP_ITEMS:
                yield flush()
                chunk, held, k = [], 0, k + 1
        if held:
            yield flush()

    return run


def pack(items: DataFrame, scratch: Scratch, capacity: int = LENGTH, fan_in: int = 8) -> DataFrame:
    """items: doc_id, piece, start, length (1 to capacity), ids_crc32 -> the same with sequence_id and offset."""
    spark = items.sparkSession
    member = F.struct(*[F.col(c) for c in _PIECES.names], F.lit(0).cast("long").alias("offset"))
    single = items.select(F.lit("").alias("bin"), F.col("length").alias("fill"), F.array(member).alias("members"))
    keep = int(capacity * (1 - SLACK))
    level, done = 0, []
    bins = scratch.table(single.mapInArrow(_pack(0, capacity), _BINS), "bins0")
    count = left = None
    while True:
        done.append(bins.filter(F.col("fill") >= keep))
        rest = bins.filter(F.col("fill") < keep)
        now = rest.count()
        groups = max(1, -(-now // GROUP_ITEMS)) if left is None else max(1, -(-now // GROUP_ITEMS), -(-groups // fan_in))
        if left is None:
            groups = max(groups, min(bins.rdd.getNumPartitions(), now) // fan_in, 1)
        if now < 2 or count == 1 or (left is not None and groups == count and now > 0.995 * left):
            done.append(rest)
            break
        level, left, count = level + 1, now, groups
        dealt = rest.repartition(groups, F.xxhash64("bin")).sortWithinPartitions(F.desc("fill"), "bin")
        bins = scratch.table(dealt.mapInArrow(_pack(level, capacity), _BINS), f"bins{level}")
    final = done[0]
    for d in done[1:]:
        final = final.unionByName(d)
    return final.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("members").alias("m")).select(*[f"m.{c}" for c in _PIECES.names], "sequence_id", "m.offset")


def op5(spark, docs: DataFrame) -> DataFrame:
    """One row per piece. Null texts are empty documents of one end id; rows without doc_id are packed
    like others; very long texts are cut into as many pieces as they need; repeated rows are packed as
    often as they come; an empty table gives no rows."""
    scratch = Scratch(spark, "op5")
    cut = scratch.table(pieces(docs), "pieces")
    return pack(cut, scratch)
