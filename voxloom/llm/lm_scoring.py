"""LM scoring by a hierarchical Pitman-Yor model over preceding words.

Each preceding word (and the start of a document) is a context restaurant that serves the words
following it; all share one parent, the root restaurant, whose customers are the tables of the
contexts. The root's base is open: every training word has one table there, and the mass of a
new table is the unknown word's, so the probabilities of the V training words and the unknown
one sum to one. Seatings are sampled by Gibbs sweeps, given the tables of all others as the sweep
before left them. All customers of one word in one context are reseated together: their number of
tables is drawn from its conditional, which sums over all seatings through generalised Stirling
numbers (a pair that occurs once has one table and is never drawn). Up to EXACT customers these
numbers are read from a table, for more they are integrals; the draws are the same either way. A
token's probability is its predictive probability averaged over the kept sweeps.

How it is distributed. A batch of documents becomes packed cells, one for each bucket of
contexts: the pairs (context, word) and the documents they stand in. Contexts lie whole in a
bucket, but for those that a bounded sample finds too frequent for one: these are dealt by word
too, and their totals, a row each, go over the driver. Words have parts of their own, which
hold the root's counts; a sweep sends each bucket's tables to the parts and the root's counts
back. The cells are made twice, for counting and for scoring, rather than kept: the documents
must be the same both times. Draws depend on context, word and sweep alone, so scores don't
depend on the layout of the input. Contexts and words are told apart by 56 bits of a hash.
"""

from __future__ import annotations

import contextlib
import functools
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import held_out
from .util import Scratch, batches, doc_text, gathered

BURN_IN, KEPT = 2, 2
STRENGTH = 1.0
#: Bytes of text that a bucket of contexts stands for, and those of the sample that frequent contexts are found in.
BUCKET_BYTES, SAMPLE_BYTES = 8 << 20, 16 << 20
#: Documents and bytes of text in a batch.
BATCH = 2048, 8 << 20
#: Contexts that are dealt by word too, at most; they only balance tasks.
HOT = 100_000
#: Customers up to which Stirling numbers are read from a table; it doesn't change what is drawn.
EXACT = 2048
#: Weights of numbers of tables below the largest by this logarithm are left out: together they weigh less than rounding.
NEGLIGIBLE = 40.0
#: Bytes of sums that a task holds.
HELD_BYTES = 24 << 20
#: Rows of packed cells in one Arrow batch.
CELL_ROWS = 16
START = np.uint64(1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
# Kinds of rows between jobs.
WORDS, STATE, TOTALS, EXTRA, ROOT, PRICES, CELL, OWN = range(8)
_ROWS = "kind int, to int, frm int, blob binary, a long, b long, c long"
_NAMES = ["kind", "to", "frm", "blob", "a", "b", "c"]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(starts, codes, words): text k has the words codes[starts[k]:starts[k + 1]], its end (the empty word) included."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    edge = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(edge)
    values = lists.values.slice(edge[0], edge[-1] - edge[0])
    blank = (n == 1) & (pc.binary_length(texts).to_numpy() == 0) | (pc.binary_length(pc.ascii_trim_whitespace(texts)).to_numpy() == 0)
    coded = values.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    end = words.index("") if "" in words else len(words)
    if end == len(words):
        words.append("")
    edge = edge - edge[0]
    size = np.where(blank, 1, n + 1)
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.full(starts[-1], end, np.int64)
    kept = np.repeat(~blank, n)
    inner = np.ones(len(out), bool)
    inner[starts[1:] - 1] = False
    out[inner] = codes[kept]
    return starts, out, words


def word_hash(words: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w) for w in words], np.uint64) >> np.uint64(8)


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    return ((x * _C1) >> np.uint64(33)).astype(np.int64) % n


# Packed arrays: bytes of equal rank lie together, so small and sorted numbers press well


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    press, out = zstandard.ZstdCompressor(level=1), [struct.pack("<i", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = press.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""
        out += [struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(raw)), raw]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    press, at, out = zstandard.ZstdDecompressor(), 4, []
    for _ in range(struct.unpack_from("<i", raw)[0]):
        kind, n, size = struct.unpack_from("<2sqq", raw, at)
        at += struct.calcsize("<2sqq")
        dtype = np.dtype("<" + kind.decode())
        if n:
            flat = np.frombuffer(press.decompress(raw[at : at + size]), np.uint8)
            out.append(np.ascontiguousarray(flat.reshape(dtype.itemsize, n).T).view(dtype).ravel())
        else:
            out.append(np.zeros(0, dtype))
        at += size
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _pairs(hu: np.ndarray, hw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, distinct words, and each token's pair of them as one number."""
    u, ui = np.unique(hu, return_inverse=True)
    w, wi = np.unique(hw, return_inverse=True)
    return u, w, ui * len(w) + wi


def counts_cell(hu: np.ndarray, hw: np.ndarray, trains: np.ndarray) -> bytes:
    """Tokens (hash of context, hash of word) as sorted pairs with their occurrences in documents that train."""
    u, w, pair = _pairs(hu, hw)
    pairs, at = np.unique(pair, return_inverse=True)
    pu, pw = np.divmod(pairs, len(w))
    return pack(_deltas(u), _deltas(w), _small(np.bincount(pu, minlength=len(u))), _small(pw), _small(np.bincount(at, trains).astype(np.int64)))


def cell(hu: np.ndarray, hw: np.ndarray, doc: np.ndarray, n_docs: int, held: np.ndarray) -> bytes:
    """Tokens as sorted pairs, each with its documents in the batch and its occurrences there."""
    u, w, pair = _pairs(hu, hw)
    key, times = np.unique(pair * n_docs + doc, return_counts=True)
    pair, docs = np.divmod(key, n_docs)
    _, first, n = np.unique(pair, return_index=True, return_counts=True)
    pu, pw = np.divmod(pair[first], len(w))
    return pack(_deltas(u), _deltas(w), _small(np.bincount(pu, minlength=len(u))), _small(pw), _small(n), _small(docs), _small(times), np.packbits(held))


class Cell:
    """A cell of either kind, from its bytes."""

    def __init__(self, raw: bytes):
        u, w, per, pw, *rest = unpack(raw)
        self.u, self.w, self.pw = np.cumsum(u, dtype=np.uint64), np.cumsum(w, dtype=np.uint64), pw
        self.pu = np.repeat(np.arange(len(u), dtype=np.int32), per)
        if len(rest) == 1:
            self.c = rest[0].astype(np.int64)
        else:
            self.n, self.docs, self.times, held = rest
            n, times = self.n.astype(np.int64), np.where(np.unpackbits(held)[self.docs] == 0, self.times, 0).astype(np.int64)
            self.c = np.add.reduceat(times, np.cumsum(n) - n)


def _contexts(it):
    for b in batches(it, *BATCH):
        starts, codes, words = tokens(b.column(0))
        n = np.bincount(codes, minlength=len(words))
        n[words.index("")] = 0  # nothing follows an end
        u = np.append(word_hash(words), START)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.append(n, b.num_rows))], ["u", "n"])


def _cells(n_buckets: int, hot_b, whole: bool):
    """(kind, to, frm, blob, a): the cells of each batch of documents, the batch in a; whole ones come with a row of its doc_ids and
    token numbers, in any bucket."""

    def run(it):
        from pyspark import TaskContext

        part, k, hot = TaskContext.get().partitionId(), -1, hot_b.value
        for b in gathered(it, *BATCH):
            k += 1
            ids, held = b.column(0), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            starts, codes, words = tokens(b.column(1))
            h = word_hash(words)
            hw = h[codes]
            hu = np.concatenate([[START], hw[:-1]])
            hu[starts[:-1]] = START
            often = np.concatenate([[False], np.isin(h, hot)[codes[:-1]]])
            often[starts[:-1]] = START in hot
            by = np.where(often, hu ^ (hw * _C2), hu)
            doc = np.repeat(np.arange(b.num_rows, dtype=np.int32), np.diff(starts))
            to, number = _spread(by, n_buckets), part << 32 | k
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(n_buckets + 1)).tolist()
            rows, size = [], 0
            if whole:
                own = pack(ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False).astype("u1"), np.diff(starts).astype("<i8"), held.astype("u1"))
                rows.append(_row(OWN, number % n_buckets, None, own, number))
            for j in range(n_buckets):
                at = order[edge[j] : edge[j + 1]]
                if len(at):
                    raw = cell(hu[at], hw[at], doc[at], b.num_rows, held) if whole else counts_cell(hu[at], hw[at], ~held[doc[at]])
                    rows.append(_row(CELL, j, None, raw, number))
                    size += len(raw)
                if rows and (size > 4 << 20 or j == n_buckets - 1):
                    yield _batch(rows)
                    rows, size = [], 0

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int32()] * 3, pa.binary(), *[pa.int64()] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


def _row(kind, to, frm=None, blob=None, a=None, b=None, c=None) -> tuple:
    return (kind, to, frm, blob, a, b, c)


def _groups(it, key: int = 1):
    """Rows of equal key, one group after the other; rows come sorted by it."""
    held, at = [], None
    for b in it:
        for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
            if held and r[key] != at:
                yield at, held
                held = []
            at = r[key]
            held.append(r)
    if held:
        yield at, held


class Bucket:
    """The pairs of a bucket's cells: contexts u, words w in the order of their parts, counts c in training. Cells are opened one at a time."""

    def __init__(self, raws: list[bytes], n_parts: int):
        some = [(x.u, x.w) for x in map(Cell, raws)]
        self.u, self.words = (np.unique(np.concatenate(x)) for x in zip(*some))
        order = np.argsort(_spread(self.words ^ _C3, n_parts), kind="stable")
        self.w = self.words[order]
        self.part = _spread(self.w ^ _C3, n_parts)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        each = [(self.key(x), x.c) for x in map(Cell, raws)]
        key, c = (np.concatenate(x) for x in zip(*each))
        del some, each
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        c = np.add.reduceat(c[order], first)
        self.pairs, self.c = key[first][c > 0], c[c > 0]
        self.pu, self.pw = np.divmod(self.pairs, len(self.w))

    def key(self, x: Cell) -> np.ndarray:
        u, w = np.searchsorted(self.u, x.u), self.place[np.searchsorted(self.words, x.w)]
        return u[x.pu] * len(self.w) + w[x.pw]

    def per_context(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.pu, v, len(self.u)).astype(np.int64)


def _cut(part: np.ndarray, n_parts: int):
    """(part, first, last) of the stretches of equal parts."""
    edge = np.searchsorted(part, np.arange(n_parts + 1))
    return [(p, a, z) for p, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if z > a]


def _gather(n_parts: int, hot_b):
    """A bucket's words with their counts and contexts for the parts, its pairs of two and more, and totals of frequent contexts."""

    def run(it):
        hot = hot_b.value
        for bucket, rows in _groups(it):
            x = Bucket([r[3] for r in rows], n_parts)
            rows.clear()
            n, contexts = np.bincount(x.pw, x.c, len(x.w)).astype(np.int64), np.bincount(x.pw, minlength=len(x.w))
            out = [_row(WORDS, p, bucket, pack(x.w[a:z], n[a:z], contexts[a:z])) for p, a, z in _cut(x.part, n_parts)]
            many = x.c > 1
            mw, wi = np.unique(x.pw[many], return_inverse=True)
            customers, tables = x.per_context(x.c), x.per_context(np.ones(len(x.c)))
            state = pack(x.u, customers, tables, x.w[mw], x.pu[many], wi, x.c[many])
            out.append(_row(STATE, bucket, None, state))
            out += [_row(EXTRA, p, bucket, pack(x.w[mw][a:z], np.zeros(z - a, np.int64))) for p, a, z in _cut(x.part[mw], n_parts)]
            often = np.isin(x.u, hot)
            out += [_row(TOTALS, -1, bucket, None, int(u), int(c), int(t)) for u, c, t in zip(x.u[often], customers[often], tables[often])]
            out.append(_row(TOTALS, -2, bucket, None, int((x.c == 1).sum()), int((x.c == 2).sum()), 0))
            for at in range(0, len(out), CELL_ROWS):
                yield _batch(out[at : at + CELL_ROWS])

    return run


def _words(it):
    """A part's training words: counts and numbers of contexts, which are their least tables."""
    for part, rows in _groups(it):
        w, c, m = (np.concatenate(x) for x in zip(*(unpack(r[3]) for r in rows)))
        names, at = np.unique(w, return_inverse=True)
        c, m = (np.bincount(at, x, len(names)).astype(np.int64) for x in (c, m))
        on = c > 0
        yield _batch([_row(WORDS, part, None, pack(names[on], c[on], m[on])), _row(TOTALS, -1, part, None, int(on.sum()), int(c.sum()), int(m.sum())), _row(TOTALS, -2, part, None, int((m == 1).sum()), int((m == 2).sum()), 0)])


def _look(names: np.ndarray, values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The values of w among the sorted names, 0 for others."""
    if not len(names):
        return np.zeros(len(w), values.dtype)
    at = np.minimum(np.searchsorted(names, w), len(names) - 1)
    return np.where(names[at] == w, values[at], 0)


def _tables(names: np.ndarray, m: np.ndarray, extras: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    t = m.copy()
    for w, more in extras:
        np.add.at(t, np.searchsorted(names, w), more)  # the words of pairs train, so all are there
    return t


def _root(it):
    """The root's customers of the words that each bucket's pairs have, in their order there."""
    for part, rows in _groups(it):
        names, _, m = next(unpack(r[3]) for r in rows if r[0] == WORDS)
        asked = [(r[2], unpack(r[3])) for r in rows if r[0] == EXTRA]
        t = _tables(names, m, [x for _, x in asked])
        for bucket, (w, _) in asked:
            yield _batch([_row(ROOT, bucket, part, pack(_look(names, t, w)))])


def _prices(sweeps: list[int]):
    """Counts, and the root's customers in each kept sweep (their extra tables have its number in a), of all words of each bucket."""

    def run(it):
        for part, rows in _groups(it):
            names, c, m = next(unpack(r[3]) for r in rows if r[0] == WORDS and r[2] is None)
            t = [_tables(names, m, [unpack(r[3]) for r in rows if r[0] == EXTRA and r[4] == s]) for s in sweeps]
            for bucket, raw in ((r[2], r[3]) for r in rows if r[0] == WORDS and r[2] is not None):
                w = unpack(raw)[0]
                yield _batch([_row(PRICES, bucket, part, pack(_look(names, c, w), *[_look(names, x, w) for x in t]))])

    return run


# Tables of a pair


@functools.lru_cache(2)
def stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t), c and t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, n + 1)
    for c in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def _path(k: np.ndarray, t: np.ndarray, d: float, q: np.ndarray, close: float) -> np.ndarray:
    """Logarithm of f(x)^t x^(-k t), f(x) = 1 - (1 - x)^d, on its path of steepest descent, where it is real: at arg x =
    v pi (1 - d) / (k - d), v = 1 / (1 + e^-q).

    With 1 - x = r e^(-ia) the triangles 0, 1, x and 0, 1, f(x) give r and r^d by the law of sines; a is where they agree.
    """
    shape = np.shape(q)
    k, t, q = (np.broadcast_to(x, shape).ravel() for x in (k, t, q))
    theta, left = math.pi * (1 - d) / (k - d) / (1 + np.exp(-q)), math.pi * (1 - d) / (1 + np.exp(q))
    psi = k * theta
    sine = lambda a, rest: np.sin(np.minimum(a, rest))  # noqa: E731  of a, the rest to pi known as exactly
    cot = lambda a, rest: np.where(a < rest, 1, -1) / np.tan(np.minimum(a, rest))

    def angles(g, on):
        a, e = (math.pi - theta[on]) / (1 + np.exp(-g)), (math.pi - theta[on]) / (1 + np.exp(g))
        return a, e, d * a + psi[on], left[on] + d * e

    fixed = d * np.log(np.sin(theta)) - np.log(sine(psi, math.pi - psi))
    least = theta * (k - 1) / (1 - d)
    low = np.log(least) - np.log(math.pi - theta - least)
    high, g, on = low + 600, low + 2, np.arange(len(theta))
    for _ in range(100):
        a, e, b, rest = angles(g[on], on)
        off = fixed[on] - d * np.log(sine(a + theta[on], e)) + np.log(sine(b, rest))
        low[on], high[on] = np.where(off < 0, g[on], low[on]), np.where(off < 0, high[on], g[on])
        slope = d * (cot(b, rest) - cot(a + theta[on], e)) * a * e / (math.pi - theta[on])
        with np.errstate(divide="ignore", invalid="ignore"):
            to = g[on] - off / slope
        to = np.where((to > low[on]) & (to < high[on]), to, np.minimum((low[on] + high[on]) / 2, g[on] + 8))
        moved = np.abs(to - g[on]) > close * np.maximum(1, np.abs(to))
        g[on] = to
        on = on[moved]
        if not len(on):
            break
    a, e, b, rest = angles(g, slice(None))
    return (t * np.log(np.sin(d * a) / sine(b, rest)) - k * t * np.log(sine(a, e + theta) / sine(a + theta, e))).reshape(shape)


def log_coefficient(c: int, t: np.ndarray, d: float, rough: bool = False) -> np.ndarray:
    """Logarithm of the coefficient of x^c in (1 - (1 - x)^d)^t, t from 1 to c: S_d(c, t) is c! / (t! d^t) of it.

    Cauchy's integral on the path of steepest descent, on which nothing cancels, by the trapezoidal rule over the
    logit of the angle; a rough one is good for finding where the weight is.
    """
    t = np.asarray(t, float)
    out = np.full(len(t), c * math.log(d))
    inner = np.flatnonzero(t < c)
    if not len(inner):
        return out
    t, step = t[inner, None], 0.25 * min(1.0, 2 * d)
    k = c / t
    q = np.arange(3.0, -45.0, -1.5 if rough else -3.0)[None, :] + np.zeros((len(t), 1))
    g = _path(k, t, d, q, 1e-3)
    if rough:
        step = 1.5
    else:
        edge = q[0, (g >= g[:, -1:] - 1).argmax(1)][:, None]  # where it has fallen by one
        q = edge + 6 - step * np.arange(math.ceil(17.5 / step))[None, :]
        g = _path(k, t, d, q, 1e-10)
    top, v = g[:, -1:], 1 / (1 + np.exp(-q))  # the saddle, all but
    sums = step * ((np.exp(g - top) * v / (1 + np.exp(q))).sum(1) + v[:, -1] / math.expm1(step))
    out[inner] = np.log((1 - d) / (k[:, 0] - d)) + top[:, 0] + np.log(sums)
    return out


def draw_tables(c: int, own: int, root: int, total: int, d: Discounts, chance: float) -> int:
    """The number of tables of c customers, any number of them, from its conditional; own, root and total are those of all others."""
    lgamma = lambda x: np.array([math.lgamma(y) for y in x])

    def rough(t):
        rises = ((1, STRENGTH / d.d1 + own + 1), (1, root + 1 - d.d0), (-1, STRENGTH + total + 1))  # products of new tables' weights
        return log_coefficient(c, t, d.d1, True) - lgamma(t + 1) - math.log(d.d1) + sum(sign * (lgamma(x + t - 1) - math.lgamma(x)) for sign, x in rises)

    low, high, width = 1, c, 24
    while high - low > 32:
        t = np.unique(np.round(np.exp(np.linspace(math.log(low), math.log(high), width))).astype(np.int64))
        lw = rough(t)
        near = np.flatnonzero(lw > lw.max() - NEGLIGIBLE)
        a, z = int(t[max(near[0] - 1, 0)]), int(t[min(near[-1] + 1, len(t) - 1)])
        done = 2 * (z - a) > high - low
        low, high, width = a, z, 14
        if done:
            break
    t, far = np.arange(low, high + 1), high > c // 2  # up to there (c - t)! is smooth
    if len(t) <= 33:
        lw = log_coefficient(c, t, d.d1) + (lgamma(c - t + 1) if far else 0)
    else:
        ends = np.log([low, min(high, c - 1)])
        at = lambda x: (2 * np.log(x) - ends.sum()) / (ends[1] - ends[0])
        nodes = np.cos(math.pi * (np.arange(40) + 0.5) / 40)
        x = np.exp((nodes * (ends[1] - ends[0]) + ends.sum()) / 2)
        y = log_coefficient(c, x, d.d1) + (lgamma(c - x + 1) if far else 0)
        lw = np.polynomial.chebyshev.chebval(at(t), np.polynomial.chebyshev.chebfit(nodes, y, 39))
        lw[t == c] = c * math.log(d.d1)
    i = t[1:] - 1
    steps = np.log(STRENGTH + d.d1 * (own + i)) + np.log(root + i - d.d0) - np.log(STRENGTH + total + i) - np.log(t[1:]) - math.log(d.d1)
    if far:
        steps += np.log(c - t[1:] + 1)
    lw = lw + np.concatenate([[0.0], np.cumsum(steps)])
    up = np.cumsum(np.exp(lw - lw.max()))
    return low + int(min((up < chance * up[-1]).sum(), len(t) - 1))


def _uniform(u: np.ndarray, w: np.ndarray, salt: int) -> np.ndarray:
    """A number from [0, 1) for each context and word, the same wherever it is drawn."""
    x = (u * _C1) ^ (w * _C2) ^ np.uint64((salt * int(_C3)) & (1 << 64) - 1)
    for shift in (30, 27, 31):
        x = (x ^ (x >> np.uint64(shift))) * _C1
    return (x >> np.uint64(11)).astype(float) / 2.0**53


class Discounts:
    """Discounts of contexts and root, from pairs and words of one and two; the strength is the same in both."""

    def __init__(self, pairs: tuple[int, int], words: tuple[int, int]):
        self.d1, self.d0 = (float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5 for a, b in (pairs, words))


def reseat(c, t, own, root, total: int, d: Discounts, u, w, salt: int) -> np.ndarray:
    """New tables of pairs with c customers and t tables: own is the tables of their contexts, root the
    customers of their words at the root, total all its customers, each with the t counted in."""
    out, table, chance = t.copy(), stirling(EXACT, d.d1), _uniform(u, w, salt)
    order = np.argsort(c, kind="stable")
    sizes = c[order]
    for n in np.unique(sizes[sizes <= EXACT]).tolist():
        a, z = np.searchsorted(sizes, [n, n + 1])
        step = max(1, 1_000_000 // n)
        for at in range(a, z, step):
            k = order[at : min(z, at + step)]
            i = np.arange(1, n)[None, :]  # the next table is opened when there are i
            here = np.log(STRENGTH + d.d1 * ((own[k] - t[k])[:, None] + i))
            there = np.log((root[k] - t[k])[:, None] + i - d.d0) - np.log(STRENGTH + (total - t[k])[:, None] + i)
            lw = np.concatenate([np.zeros((len(k), 1)), np.cumsum(here + there, 1)], 1) + table[n, 1 : n + 1]
            up = np.cumsum(np.exp(lw - lw.max(1, keepdims=True)), 1)
            out[k] = 1 + np.minimum((up < (chance[k] * up[:, -1])[:, None]).sum(1), n - 1)
    for k in np.flatnonzero(c > EXACT).tolist():
        n = int(t[k])
        out[k] = draw_tables(int(c[k]), int(own[k]) - n, int(root[k]) - n, total - n, d, float(chance[k]))
    return out


def reseat_singly(c: int, sizes: np.ndarray | None, own: int, root: int, total: int, d: Discounts, seed: list[int], moves: int = 64) -> np.ndarray:
    """New table sizes of a pair of c customers, one by one, which the draws are tested against; no sweep uses it. own, root and
    total are those of all others. Without sizes they sit down first."""
    rng = np.random.Generator(np.random.PCG64(seed))
    new = lambda t: (STRENGTH + d.d1 * (own + t)) * (root + t - d.d0) / (STRENGTH + total + t)  # noqa: E731  weight of a new table
    if sizes is None:
        t, n = 1, 1
        while n < c:  # n sit; so many again sit down
            to = min(c, 2 * n)
            low = new(t) + n - d.d1 * t
            t = min(t + int(rng.poisson(new(t) * math.log1p((to - n) / low))), to)
            n = to
        sizes = 1 + rng.multinomial(c - t, rng.dirichlet(np.full(t, 1 - d.d1)))
    sizes = sizes.copy()
    for _ in range(moves):
        k = int(np.searchsorted(np.cumsum(sizes), rng.integers(c), "right"))
        sizes[k] -= 1
        if not sizes[k]:
            sizes = np.delete(sizes, k)
        up = np.append(np.cumsum(sizes - d.d1), 0.0)
        up[-1] = (up[-2] if len(sizes) else 0.0) + new(len(sizes))
        k = int(np.searchsorted(up, rng.random() * up[-1], "right"))
        if k < len(sizes):
            sizes[k] += 1
        else:
            sizes = np.append(sizes, 1)
    return sizes


def _sweep(number: int, kept: bool, d: Discounts, total: int, hot_b, n_parts: int):
    """Draws the tables of each bucket's pairs; gives its state, the tables beyond the least for the parts, and totals."""

    def run(it):
        hot_u, hot_t = hot_b.value
        for bucket, rows in _groups(it):
            u, customers, least, mw, pu, pw, c, *t = unpack(next(r[3] for r in rows if r[0] == STATE))
            last = t[-1] if t else np.ones(len(c), np.int64)
            root = np.concatenate([np.zeros(0, np.int64), *[unpack(r[3])[0] for r in sorted((r for r in rows if r[0] == ROOT), key=lambda r: r[2])]])
            tables = least + np.bincount(pu, last - 1, len(u)).astype(np.int64)
            tables = _override(u, tables, hot_u, hot_t)
            new = reseat(c, last, tables[pu], root[pw], total, d, u[pu], mw[pw], number)
            out = [_row(STATE, bucket, None, pack(u, customers, least, mw, pu, pw, c, *(t if kept else []), new))]
            more, part = np.bincount(pw, new - 1, len(mw)).astype(np.int64), _spread(mw ^ _C3, n_parts)
            out += [_row(EXTRA, p, bucket, pack(mw[a:z], more[a:z]), number) for p, a, z in _cut(part, n_parts)]
            grown = np.bincount(pu, new - 1, len(u)).astype(np.int64)
            often = np.isin(u, hot_u)
            out += [_row(TOTALS, -1, bucket, None, int(k), int(g), 0) for k, g in zip(u[often], grown[often])]
            out.append(_row(TOTALS, -2, bucket, None, 0, int(more.sum()), 0))
            for at in range(0, len(out), CELL_ROWS):
                yield _batch(out[at : at + CELL_ROWS])

    return run


def _override(u: np.ndarray, values: np.ndarray, hot_u: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The totals of frequent contexts in place of a bucket's own share."""
    if not len(hot_u) or not len(u):
        return values
    at = np.minimum(np.searchsorted(hot_u, u), len(hot_u) - 1)
    return np.where(hot_u[at] == u, hot[at], values)


class Predictive:
    """The model as the kept sweeps left it: totals of the root, and of frequent contexts (customers, tables a sweep)."""

    def __init__(self, d: Discounts, tokens: int, types: int, totals: list[int], hot_u, hot_c, hot_t):
        self.d, self.tokens, self.types, self.totals, self.hot_u, self.hot_c, self.hot_t = d, tokens, types, totals, hot_u, hot_c, hot_t

    def root(self, t: np.ndarray, k: int) -> np.ndarray:
        """Probability of words with t customers at the root in kept sweep k; of the unknown word for none."""
        return np.where(t > 0, t - self.d.d0, STRENGTH + self.d.d0 * self.types) / (STRENGTH + self.totals[k])

    def prob(self, c, t, customers, tables, root) -> np.ndarray:
        """Mean over the sweeps of the probability after a context; t, tables and root (its probabilities) are lists over sweeps."""
        p = [np.where(customers > 0, (np.maximum(c - self.d.d1 * x, 0) + (STRENGTH + self.d.d1 * y) * z) / (STRENGTH + customers), z) for x, y, z in zip(t, tables, root)]
        return np.mean(p, 0)


def _score(model_b, n_parts: int):
    """(batch, bucket, blob): per document of the cells' batches the sums over tokens, of a task's buckets together while they take little."""

    def result(batch, bucket, blob):
        return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["batch", "bucket", "blob"])

    def flush(held, bucket):
        for batch in sorted(held):
            some = np.flatnonzero(held[batch][3])
            yield result(batch, bucket, pack(_small(some), _small(held[batch][0][some].astype(np.int64)), *held[batch][1:3, some]))
        held.clear()

    def run(it):
        m, held = model_b.value, {}
        for bucket, rows in _groups(it):
            for r in rows:
                if r[0] == OWN:
                    yield result(r[4], -1, r[3])
            cells = [(r[4], r[3]) for r in rows if r[0] == CELL]
            if not cells:
                continue
            x = Bucket([raw for _, raw in cells], n_parts)
            priced = [unpack(r[3]) for r in sorted((r for r in rows if r[0] == PRICES), key=lambda r: r[2])]
            n, *root = (np.concatenate(v) for v in zip(*priced))
            tables = unpack(next(r[3] for r in rows if r[0] == STATE))[7:]
            kept, customers = [], _override(x.u, x.per_context(x.c), m.hot_u, m.hot_c)
            for k, t in enumerate(tables):
                own = np.ones(len(x.c), np.int64)
                own[x.c > 1] = t  # both are in the order of context and word
                kept.append((own, _override(x.u, x.per_context(own), m.hot_u, m.hot_t[k]), m.root(root[k], k)))
            base = np.log10((n + 1) / (m.tokens + m.types + 1))
            for batch, raw in cells:
                one = Cell(raw)
                key = x.key(one)
                at = np.minimum(np.searchsorted(x.pairs, key), max(0, len(x.pairs) - 1))
                seen = x.pairs[at] == key if len(x.pairs) else np.zeros(len(key), bool)
                c = np.where(seen, x.c[at], 0) if len(x.pairs) else np.zeros(len(key), np.int64)
                ku, kw = np.divmod(key, len(x.w))
                t = [np.where(seen, own[at], 0) if len(x.pairs) else c for own, _, _ in kept]
                lp = np.log10(np.maximum(m.prob(c, t, customers[ku], [y[ku] for _, y, _ in kept], [z[kw] for _, _, z in kept]), 1e-300))
                of = np.repeat(np.arange(len(key)), one.n)
                sums = held.setdefault(batch, np.zeros((4, BATCH[0])))
                for row, v in zip(sums, ((n[kw] > 0).astype(float), base[kw], lp, np.ones(len(lp)))):
                    row += np.bincount(one.docs, one.times * v[of], BATCH[0])
                if len(held) * sums.nbytes > HELD_BYTES:
                    yield from flush(held, bucket)
        yield from flush(held, n_parts)

    return run


def _sum_up(it):
    """Documents with their sums over all buckets."""
    for _, rows in _groups(it, 0):
        ids, none, n, held = unpack(next(r[2] for r in rows if r[1] < 0))
        known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for r in rows:
            if r[1] >= 0:
                at, k, b, s = unpack(r[2])
                known[at] += k
                base[at] += b
                score[at] += s
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


@contextlib.contextmanager
def _few_rows(spark):
    """Packed rows are large, so Arrow batches of them are short."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, CELL_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _frequent(text: DataFrame, nbytes: int, n_buckets: int) -> np.ndarray:
    """Contexts with over a quarter of a bucket's tokens, by a bounded sample: found ones are dealt by word too."""
    if n_buckets < 2:
        return np.zeros(0, np.uint64)
    some = text.select("text") if nbytes <= SAMPLE_BYTES else text.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(SAMPLE_BYTES / nbytes * (1 << 30)) + 1).select("text")
    least = max(20, min(nbytes, SAMPLE_BYTES) / 6 / (4 * n_buckets))  # about six bytes a word
    per = some.mapInArrow(_contexts, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).filter(F.col("n") > least)
    return np.sort(np.array([r.u for r in per.orderBy(F.desc("n"), "u").limit(HOT).collect()], np.int64).view(np.uint64))


def score(docs: DataFrame, scratch: Scratch, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts hold the end alone; rows without doc_id train and are scored like the
    others; repeated rows train as often as they come; a very long text is a batch of its own and
    is scored whole; an empty table gives no rows.
    """
    spark, text = docs.sparkSession, doc_text(docs)
    sc = spark.sparkContext
    nbytes = text.agg(F.coalesce(F.sum(F.octet_length("text") + 6), F.lit(0))).first()[0]
    n = max(1, -(-nbytes // bucket_bytes))
    hot = _frequent(text, nbytes, n)
    hot_b = sc.broadcast(hot)
    cells = lambda whole: text.select("doc_id", "text", held_out(7).alias("held")).mapInArrow(_cells(n, hot_b, whole), _ROWS)

    def dealt(df: DataFrame, each: int) -> DataFrame:
        """Rows of one bucket or part together, so many of them to a task, one after the other."""
        tasks = -(-n // each)
        return df.repartitionById(tasks, F.col("to") % tasks).sortWithinPartitions("to", "kind", "frm", "a")

    rows_of = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    totals = lambda df, to: df.filter((F.col("kind") == TOTALS) & (F.col("to") == to))
    with _few_rows(spark):
        gathered = scratch.table(dealt(cells(False), 4).mapInArrow(_gather(n, hot_b), _ROWS), "gathered")
        words = scratch.table(dealt(rows_of(gathered, WORDS), 16).mapInArrow(_words, _ROWS), "words")
        scratch.free()
        pairs, singles = (totals(df, -2).agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first() for df in (gathered, words))
        types, train, least = (v or 0 for v in totals(words, -1).agg(F.sum("a"), F.sum("b"), F.sum("c")).first())
        d = Discounts(tuple(pairs), tuple(singles))
        by_context = sorted((r.a, r.b, r.c) for r in totals(gathered, -1).groupBy("a").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).collect())  # HOT rows at most
        hot_u, hot_c, hot_least = (np.array([r[k] for r in by_context], np.int64) for k in range(3))
        hot_u = hot_u.view(np.uint64)
        hot_t, state, asked, total, kept_rows = hot_least, rows_of(gathered, STATE), rows_of(gathered, EXTRA), least, []
        kept_totals, kept_hot = [], []
        for s in range(BURN_IN + KEPT):
            root = scratch.table(dealt(rows_of(words, WORDS).unionByName(asked), 16).mapInArrow(_root, _ROWS), f"root{s}")
            before, kept = sc.broadcast((hot_u, hot_t)), s >= BURN_IN
            swept = scratch.table(dealt(state.unionByName(root), 8).mapInArrow(_sweep(s, s > BURN_IN, d, total, before, n), _ROWS), f"sweep{s}")
            total = least + (totals(swept, -2).agg(F.sum("b")).first()[0] or 0)
            grown = {r.a: r.b for r in totals(swept, -1).groupBy("a").agg(F.sum("b").alias("b")).collect()}
            hot_t = hot_least + np.array([grown.get(r[0], 0) for r in by_context], np.int64)
            state, asked = rows_of(swept, STATE), rows_of(swept, EXTRA)
            if kept:
                kept_rows.append(asked)
                kept_totals.append(total)
                kept_hot.append(hot_t)
            scratch.drop(f"root{s}", *([f"sweep{s - 1}"] if 0 < s <= BURN_IN else []))
        model = sc.broadcast(Predictive(d, train, types, kept_totals, hot_u, hot_c, kept_hot))
        asks = rows_of(gathered, WORDS).unionByName(rows_of(words, WORDS))
        for df in kept_rows:
            asks = asks.unionByName(df)
        prices = scratch.table(dealt(asks, 16).mapInArrow(_prices(list(range(BURN_IN, BURN_IN + KEPT))), _ROWS), "prices")
        scratch.drop("gathered", "words")
        sums = scratch.table(dealt(cells(True).unionByName(state).unionByName(prices), 4).mapInArrow(_score(model, n), "batch long, bucket int, blob binary"), "sums")
        scratch.drop("prices", *[f"sweep{s}" for s in range(BURN_IN, BURN_IN + KEPT)])
        out = scratch.table(sums.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(_sum_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
        scratch.drop("sums")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")


def op9(spark, docs: DataFrame) -> DataFrame:
    """One row per document, as score gives them; cases as there."""
    return score(docs, Scratch(spark, "op9"))
