"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses boundaries between lines: the
least one of each window of WINDOW words (winnowing), so lines put in or taken out before a
passage don't shift the boundaries within it, and no stretch of two windows lacks one. A line
of WINDOW words or more has boundaries on both sides. A chunk runs from a boundary to the
first one that leaves it MIN_WORDS words. Chunks with equal 128-bit hashes are candidates;
their bytes are compared with those of the first one (smallest doc_id, then place), which
stays. A verified match is extended line by line at both ends over short lines for as long as
the bytes are equal, and the lines of the other occurrence are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, batches, doc_text, plain

#: The least words of a chunk: shorter passages are left alone, as blank lines and stock phrases are.
MIN_WORDS = 16
#: Words of a window in which a boundary is chosen.
WINDOW = 8
#: Chunks' least words that a match is extended by at most; the next boundary is nearer than that.
REACH = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_NO_ID = (1 << 63) - 1


def boundaries(lines: list[bytes], words: list[int], window: int = WINDOW) -> list[int]:
    """The numbers of the lines before which there is a boundary, both ends of the text included."""
    from xxhash import xxh3_64_intdigest

    n = len(lines)
    cut = {0, n}
    cut.update(k for k in range(n) if words[k] >= window)
    cut.update(k + 1 for k in range(n) if words[k] >= window)
    if len(cut) == n + 1:
        return list(range(n + 1))
    h = np.array([xxh3_64_intdigest(x) for x in lines], np.uint64)
    roll = ((h[:-1] * np.uint64(3) + h[1:]) * _MIX >> np.uint64(32)).tolist()  # of the gap before line k + 1
    held: list[int] = []  # gaps of the window, their hashes ascending
    first = total = 0
    for k in range(1, n):  # windows of lines first..k, the gap before line k the last one
        if words[k] >= window or words[k - 1] >= window:
            held, first, total = [], k, 0
            continue
        total += words[k - 1]
        while held and roll[held[-1] - 1] > roll[k - 1]:
            held.pop()
        held.append(k)
        while total >= window:
            cut.add(held[0])
            total -= words[first]
            first += 1
            if held and held[0] <= first:
                held.pop(0)
    return sorted(cut)


def chunks(lines: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(h1, h2, first line, lines) of each chunk of a text."""
    from xxhash import xxh3_128_intdigest

    words = [len(x.split()) for x in lines]
    total = np.concatenate([[0], np.cumsum(words)])
    if total[-1] < min_words:
        return []
    edge = np.array(boundaries(lines, words))
    at = total[edge]
    out = []
    for a, k in zip(edge.tolist(), np.searchsorted(at, at + min_words).tolist()):
        if k == len(edge):
            break
        b = int(edge[k])
        while not words[a]:  # neither start nor end blank
            a += 1
        while not words[b - 1]:
            b -= 1
        h = xxh3_128_intdigest(b"\n".join(lines[a:b]))
        out.append(((h >> 64) - (1 << 63), (h & _MASK) - (1 << 63), a, b - a))
    return sorted(set(out), key=lambda c: (c[2], c[3]))


def _occurrences(min_words):
    names = ["h1", "h2", "doc", "key", "at", "n"]

    def run(it):
        for b in batches(it):
            rows = [(h1, h2, d, key, at, n) for d, key, t in zip(*(b.column(k).to_pylist() for k in range(3))) for h1, h2, at, n in chunks(t.encode("utf-8", "surrogatepass").split(b"\n"), min_words)]
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 20_000])], names)

    return run


def cover(marks: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Of spans (at, n) few that cover all lines of them: each time the one that reaches furthest."""
    marks, chosen, to, i = sorted(marks), set(), -1, 0
    while i < len(marks):
        at, n = marks[i]
        if at + n - 1 <= to:
            i += 1
            continue
        uncovered, best, j = max(at, to + 1), marks[i], i
        while j < len(marks) and marks[j][0] <= uncovered:
            best = max(best, marks[j], key=sum)
            j += 1
        chosen.add(best)
        to = sum(best) - 1
    return chosen


def _selected(it):
    """Of each document's repeated chunks a cover of their lines."""
    for b in batches(it):
        rows = []
        for doc, key, marks in zip(*(b.column(k).to_pylist() for k in range(3))):
            own = cover([(m["at"], m["n"]) for m in marks])
            rows += [(m["h1"], m["h2"], doc, key, m["at"], m["n"]) for m in marks if (m["at"], m["n"]) in own]
        for a in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 20_000])], ["h1", "h2", "doc", "key", "at", "n"])


def _beside(lines: list[bytes], at: int, step: int, min_words: int) -> bytes:
    """The short lines next to a chunk, its nearest one first, up to the next long line or REACH windows."""
    out, total = [], 0
    while 0 <= at < len(lines) and (n := len(lines[at].split())) < min_words and total < REACH * min_words:
        out.append(lines[at])
        total += n
        at += step
    return b"\n".join([b"", *out])


def _texts(min_words: int):
    """The bytes of each chosen chunk, and of the short lines before and after it."""

    def run(it):
        for b in batches(it):
            rows = []

            def batch():
                kinds = (*[pa.int64()] * 6, pa.bool_(), *[pa.binary()] * 3)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["h1", "h2", "doc", "key", "at", "n", "first", "left", "bytes", "right"])

            held = 0
            for doc, key, text, marks in zip(*(b.column(k).to_pylist() for k in range(4))):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                for m in marks:
                    a, z = m["at"], m["at"] + m["n"]
                    said = b"\n".join(lines[a:z])
                    rows.append((m["h1"], m["h2"], doc, key, a, m["n"], m["first"], _beside(lines, a - 1, -1, min_words), said, _beside(lines, z, 1, min_words)))
                    held += len(said)
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
            if rows:
                yield batch()

    return run


def _common(x: bytes, y: bytes) -> int:
    """Equal lines at the start of two lists of lines, without blank ones at their end."""
    a, b = x.split(b"\n")[1:], y.split(b"\n")[1:]
    n = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    while n and not a[n - 1].strip():
        n -= 1
    return n


def _extend(it):
    """Pairs of equal bytes -> the lines to remove from the second document."""
    for b in it:
        key = [b.column(k) for k in (0, 1)]
        at, n, *sides = (b.column(k).to_pylist() for k in range(2, 8))
        grown = [(a - (x := _common(lx, ly)), m + x + _common(rx, ry)) for a, m, lx, ly, rx, ry in zip(at, n, *sides)]
        yield pa.RecordBatch.from_arrays([*key, pa.array([g[0] for g in grown], pa.int64()), pa.array([g[1] for g in grown], pa.int64())], ["doc", "key", "at", "n"])


def _rewrite(position: int, marks_at: int):
    """The documents without their marked lines; marks become the numbers of lines before and removed."""

    def run(it):
        for b in batches(it):
            texts, before, gone = b.column(position).to_pylist(), [], []
            for k, marks in enumerate(b.column(marks_at).to_pylist()):
                text = texts[k]
                if text is None:
                    before.append(0)
                    gone.append(0)
                    continue
                n = text.count("\n") + 1
                before.append(n)
                drop = {x for m in marks or () for x in range(m["at"], m["at"] + m["n"])}
                gone.append(len(drop))
                if drop:
                    texts[k] = "\n".join([x for j, x in enumerate(text.split("\n")) if j not in drop])
            cols = [b.column(k) for k in range(b.num_columns) if k != marks_at]
            cols[position] = pa.array(texts, pa.string())
            names = [n for k, n in enumerate(b.schema.names) if k != marks_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*names, "__lines", "__removed"])

    return run


def name() -> tuple:
    """(doc, key): a document's id and a hash of its text; rows that agree in both are one document."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def repeated(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, key, marks array<struct<at, n>>): lines to remove from each document."""
    doc, key = name()
    text = doc_text(docs).select(doc.alias("doc"), key.alias("key"), "text")
    occ = scratch.table(text.mapInArrow(_occurrences(min_words), "h1 long, h2 long, doc long, key long, at long, n long"), "chunks")
    place = F.struct("doc", "key", "at")
    many = occ.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p <> q").select("h1", "h2", F.col("p.doc").alias("d1"), F.col("p.key").alias("k1"), F.col("p.at").alias("a1"))
    many = scratch.table(many, "repeated")
    later = occ.join(many.hint("merge"), ["h1", "h2"]).filter("doc <> d1 or key <> k1 or at <> a1").select("h1", "h2", "doc", "key", "at", "n").distinct()
    chosen = later.groupBy("doc", "key").agg(F.collect_list(F.struct("h1", "h2", "at", "n")).alias("marks")).mapInArrow(_selected, "h1 long, h2 long, doc long, key long, at long, n long")
    chosen = scratch.table(chosen, "chosen")
    wanted = chosen.groupBy("h1", "h2").agg(F.min("n").alias("n"))
    firsts = many.join(wanted.hint("merge"), ["h1", "h2"]).select("h1", "h2", F.col("d1").alias("doc"), F.col("k1").alias("key"), F.col("a1").alias("at"), "n", F.lit(True).alias("first"))
    marks = firsts.unionByName(chosen.withColumn("first", F.lit(False))).groupBy("doc", "key").agg(F.collect_list(F.struct("h1", "h2", "at", "n", "first")).alias("marks"))
    marks = scratch.table(marks, "marks")
    scratch.drop("chunks", "repeated", "chosen")
    once = text.join(marks.hint("merge"), ["doc", "key"]).select("doc", "key", "text", "marks")  # marks grow with the corpus: one plan at every size
    held = scratch.table(once.mapInArrow(_texts(min_words), "h1 long, h2 long, doc long, key long, at long, n long, first boolean, left binary, bytes binary, right binary"), "bytes")
    scratch.drop("marks")
    one = held.filter("first").dropDuplicates(["h1", "h2"]).select("h1", "h2", F.col("bytes").alias("original"), F.col("left").alias("l1"), F.col("right").alias("r1"))
    one = scratch.table(one, "originals")  # a table of its own, so a frequent chunk's side of the join can be split
    same = held.filter("not first").join(one.hint("merge"), ["h1", "h2"]).filter("bytes = original").select("doc", "key", "at", "n", "left", "l1", "right", "r1")
    grown = same.mapInArrow(_extend, "doc long, key long, at long, n long").distinct()
    out = scratch.table(grown.groupBy("doc", "key").agg(F.collect_list(F.struct("at", "n")).alias("marks")), "lines")
    scratch.drop("bytes", "originals")
    return out


def remove(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with all its columns (but those named with two underscores), repeated chunks removed, plus __lines and __removed."""
    docs = plain(docs)
    marks = repeated(docs, scratch, min_words).select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("marks").alias("__marks"))
    doc, key = name()
    keyed = docs.withColumns({"__doc": doc, "__key": key})
    joined = keyed.join(marks.hint("merge"), ["__doc", "__key"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__marks")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "__lines long", "__removed long"])
    return joined.mapInArrow(_rewrite(docs.columns.index("text"), len(docs.columns)), schema)


def op4(spark, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_chars, kept_md5 of the text that is left.

    Null and empty texts have nothing to remove; rows without doc_id come after all others; rows with
    equal doc_id and text are one document and get the same decision; a very long text is handled
    whole, by one task; an empty table gives no rows.
    """
    out = remove(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scratch(spark, "op4"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.char_length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"))
