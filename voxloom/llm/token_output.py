"""Token-ID output as directly addressable codes.

A shard holds the ids of consecutive documents. Each id is cut into chunks, low bits first;
level k stores the chunk of every id that reaches it, a bitmap says which ids continue on
level k+1, and a rank directory counts the set bits before each block of the bitmap. So
token i is read with one rank per level and nothing else is decoded.

Shards are rows of a table (key columns and the payload), written by Spark's committed
writer: a lost executor's tasks are done again and leave nothing behind, and any store that
Spark can write to will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .util import Scratch, batches, doc_text

MAGIC = b"DACT"
WIDTHS = (8, 8, 16)
BLOCK_BITS = 512
SHARD_TOKENS = 1 << 20
_KIND = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(doc_ids, ids: list[np.ndarray], widths=WIDTHS) -> bytes:
    """One shard: document ids, document starts, and the chunk levels of all their ids."""
    starts = np.zeros(len(ids) + 1, "<i8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    v = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
    levels = []
    for k, w in enumerate(widths):
        chunk = (v & ((1 << w) - 1)).astype(_KIND[w])
        v = (v >> np.uint32(w)) if w < 32 else np.zeros_like(v)
        more = v > 0
        if k == len(widths) - 1 and more.any():
            raise ValueError("an id is too large for the chunk widths")
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype="<u4") if len(more) else np.zeros(0, "<u4")
        rank = np.zeros(len(ones) + 1, "<u4")
        np.cumsum(ones, out=rank[1:])
        levels.append((w, len(chunk), chunk.tobytes(), bitmap.tobytes(), rank.tobytes()))
        v = v[more]
        if not len(v):
            break
    out = [MAGIC, struct.pack("<IQQI", 1, len(ids), int(starts[-1]), len(levels)), np.array(doc_ids, "<i8").tobytes(), starts.tobytes()]
    for w, n, *data in levels:
        out += [struct.pack("<IQ", w, n), *data]
    return b"".join(out)


class Shard:
    """A shard opened from its bytes; nothing is decoded until it is asked for."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        _, self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<IQQI", raw, 4)
        at = 4 + struct.calcsize("<IQQI")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids, self.starts, self.levels = take("<i8", self.n_docs), take("<i8", self.n_docs + 1), []
        for _ in range(n_levels):
            w, n = struct.unpack_from("<IQ", raw, at)
            at += struct.calcsize("<IQ")
            self.levels.append((w, take(_KIND[w], n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK_BITS) + 1)))

    def token(self, i: int) -> int:
        """Token i of the shard, by one rank a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for w, chunk, bitmap, rank in self.levels:
            value |= int(chunk[i]) << shift
            shift += w
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            whole = int(np.bitwise_count(bitmap[first:byte]).sum(dtype=np.int64))
            i = int(rank[block]) + whole + int(bitmap[byte] & ((1 << bit) - 1)).bit_count()
        return value

    def decode(self) -> np.ndarray:
        """All ids of the shard."""
        value = np.zeros(self.n_tokens, "<u4")
        where, shift = slice(None), 0
        for w, chunk, bitmap, _ in self.levels:
            value[where] |= chunk.astype("<u4") << np.uint32(shift)
            shift += w
            more = np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)
            where = np.flatnonzero(more) if isinstance(where, slice) else where[more]
        return value

    def docs(self):
        ids = self.decode()
        for k, d in enumerate(self.doc_ids.tolist()):
            yield d, int(self.starts[k]), ids[self.starts[k] : self.starts[k + 1]]


_SHARDS = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("shard", T.IntegerType()), ("before", T.LongType()), ("first_doc", T.LongType()), ("last_doc", T.LongType()), ("n_docs", T.LongType()), ("n_tokens", T.LongType()), ("payload", T.BinaryType()))])
_KINDS = (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
_DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _shards(path: str, end: int, limit: int):
    def run(it):
        from pyspark import TaskContext

        part, enc, shard, before = TaskContext.get().partitionId(), tokens.encoder(path), 0, 0
        doc_ids, got, n = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, shard, before, doc_ids[0], doc_ids[-1], len(doc_ids), n, pack(doc_ids, got)), _KINDS)], _SHARDS.names)

        for b in batches(it, 3072, 12 << 20):
            starts, ids = enc.encode(b.column(1), end)
            for d, a, z in zip(b.column(0).to_pylist(), starts.tolist(), starts[1:].tolist()):
                if doc_ids and n + z - a > limit:
                    yield row()
                    doc_ids, got, n, shard, before = [], [], 0, shard + 1, before + n
                doc_ids.append(d)
                got.append(ids[a:z])
                n += z - a
        if doc_ids:
            yield row()

    return run


def write(docs: DataFrame, scratch: Scratch, path: str | None = None, end: int = tokens.END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every document, in ascending doc_id order (ties by a hash of the text), into shards; returns the shard table."""
    src = doc_text(docs).filter(F.col("doc_id").isNotNull()).withColumn("tie", F.xxhash64("text"))
    ranged = src.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")  # range bounds are sampled by key: texts are not part of it
    return scratch.table(ranged.mapInArrow(_shards(path or tokens.vocabulary_path(), end, shard_tokens), _SHARDS), "shards")


def with_base(shards: DataFrame) -> DataFrame:
    """Adds base: the ids in all shards before. One total a written partition goes over the driver, no more."""
    spark = shards.sparkSession
    per = shards.groupBy("part").agg(F.min("first_doc").alias("a"), F.max("last_doc").alias("b"), F.sum("n_tokens").alias("n")).collect()
    base, rows = 0, []
    for r in sorted(per, key=lambda r: (r.a, r.b)):
        rows.append((r.part, base))
        base += r.n
    parts = F.broadcast(spark.createDataFrame(rows, "part int, part_base long"))
    return shards.join(parts, "part").withColumn("base", F.col("part_base") + F.col("before"))


def _read(it):
    for b in batches(it, 1):  # a shard at a time
        base, s = b.column(0)[0].as_py(), Shard(b.column(1)[0].as_py())
        rows = [(d, base + at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, at, x in s.docs()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(shards: DataFrame) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32.

    Null doc_ids have no place in the order and are left out; null texts are empty (the end
    id only); repeated rows are written as often as they come; an empty table gives no rows.
    """
    return with_base(shards).select("base", "payload").mapInArrow(_read, _DOCS)


def op1(spark, docs: DataFrame) -> DataFrame:
    """One row per document, read back from the shards. Null texts are empty documents of the end id
    alone; rows without doc_id are left out; a very long text is a shard of its own; repeated rows are
    written as often as they come, texts of one doc_id in the order of a hash; an empty table gives no rows."""
    return read_back(write(docs, Scratch(spark, "op1")))
