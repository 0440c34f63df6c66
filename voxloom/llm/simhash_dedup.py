"""SimHash near-duplicates by pivot distance tables.

Equal fingerprints are one class. Fingerprints that differ in at most four bits agree in two
of six blocks of bits at least, so each class goes to the fifteen pairs of blocks and only
meets those of an equal pair. There, pairs come from a window over the distance to the first
pivot; those of which any coordinate of the pivot table differs by more than the limit are
discarded (triangle inequality), and the survivors are verified on all 64 bits.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, local_roots
from .util import Scratch, batches, doc_text, plain

SEED = 42
MAX_BITS = 4
N_PIVOTS = 32
BUFFER_ROWS = 1 << 18


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, n, dtype=np.uint64)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each window of size words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if more than half the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _prints(size: int):
    def run(it):
        for b in batches(it):
            fps = np.array([fingerprint(shingle_hashes(x, size)) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return doc_text(docs).mapInArrow(_prints(size), "doc_id long, fp long")


def blocks(max_bits: int) -> list[int]:
    """Masks of max_bits + 2 blocks that share the 64 bits out evenly."""
    edges = np.linspace(0, 64, max_bits + 3).round().astype(int).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: From this size on, rows of one key are linked by leaders first.
LARGE_GROUP = 512


def link_group(fp: np.ndarray, dist: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows of fp (rows x words) within limit bits, as comparing all pairs would.

    Leaders take all rows near them that are still free. Two rows of the largest such cluster
    are connected already, so only the rows outside it are compared with all others: a group
    of near copies costs its size times the few rows apart from it, not its square.
    """

    def near(k: int, among: np.ndarray) -> np.ndarray:
        among = among[np.abs(dist[among] - dist[k]).max(1) <= limit]
        return among[np.bitwise_count(fp[among] ^ fp[k]).sum(1, dtype=np.int64) <= limit]

    free, cluster, ii, jj = np.arange(len(fp)), np.zeros(len(fp), np.int64), [], []
    while len(free):
        got = near(free[0], free)
        cluster[got] = free[0]
        ii.append(got)
        jj.append(np.full(len(got), free[0]))
        free = np.setdiff1d(free, got, assume_unique=True)
    everyone = np.arange(len(fp))
    for k in np.flatnonzero(cluster != np.bincount(cluster).argmax()):
        got = near(k, everyone)
        ii.append(got)
        jj.append(np.full(len(got), k))
    i, j = np.concatenate(ii), np.concatenate(jj)
    root = local_roots(len(fp), i, j)
    far = np.flatnonzero(root != everyone)
    return far, root[far]


def _large_groups(key: np.ndarray):
    """(first, last) of the runs of equal keys that are large, and which rows are in none."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    large = [(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()) if b - a >= LARGE_GROUP]
    rest = np.ones(len(key), bool)
    for a, b in large:
        rest[a:b] = False
    return large, rest


def _links(max_bits: int, n_pivots: int):
    table = pivots(n_pivots)

    def flush(key, fp, rep):
        """Spanning links of the verified pairs among rows sorted by key and first coordinate."""
        dist = np.bitwise_count(fp[:, None] ^ table[None, :]).astype(np.int16)
        d0, n = dist[:, 0], len(fp)
        large, rest = _large_groups(key)
        at, shift, ii, jj = np.flatnonzero(rest), 0, [], []
        for a, b in large:
            i, j = link_group(fp[a:b, None], dist[a:b], max_bits)
            ii.append(a + i)
            jj.append(a + j)
        held, root = 0, None
        while True:
            shift += 1
            at = at[at + shift < n]
            to = at + shift
            at = at[(key[at] == key[to]) & (d0[to] - d0[at] <= max_bits)]
            if not len(at):
                break
            to = at + shift
            for a in range(0, len(at), 1 << 16):
                i, j = at[a : a + (1 << 16)], to[a : a + (1 << 16)]
                near = np.abs(dist[i] - dist[j]).max(1) <= max_bits
                i, j = i[near], j[near]
                true = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                ii.append(i[true])
                jj.append(j[true])
                held += int(true.sum())
            if held > 4_000_000:
                root = local_roots(n, np.concatenate(ii), np.concatenate(jj))
                far = np.flatnonzero(root != np.arange(n))
                ii, jj, held = [far], [root[far]], len(far)
        if ii:
            root = local_roots(n, np.concatenate(ii), np.concatenate(jj))
            far = np.flatnonzero(root != np.arange(n))
            if len(far):
                return pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[root[far]])], ["a", "b"])
        return None

    def run(it):
        held, n = [], 0

        def arrays():
            return [np.concatenate(c) for c in zip(*held)]

        for b in it:
            if not b.num_rows:
                continue
            held.append([b.column(c).to_numpy() for c in range(3)])
            n += b.num_rows
            if n < BUFFER_ROWS:
                continue
            key, fp, rep = arrays()
            fp = fp.view(np.uint64)
            if (out := flush(key, fp, rep)) is not None:
                yield out
            d0 = np.bitwise_count(fp ^ table[0]).astype(np.int16)
            tail = (key == key[-1]) & (d0 >= d0[-1] - max_bits)
            held = [[key[tail], fp[tail].view(np.int64), rep[tail]]]
            n = 0
        if held:
            key, fp, rep = arrays()
            if (out := flush(key, fp.view(np.uint64), rep)) is not None:
                yield out

    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = N_PIVOTS) -> DataFrame:
    """classes (fp, rep), fp distinct -> links (a, b) of reps that connect all within max_bits."""
    masks = blocks(max_bits)
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(x | y)))) for k, (x, y) in enumerate(combinations(masks, 2))]
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(pivots(1)[0])))))
    dealt = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("key")).repartition("key")
    return dealt.select("key", "fp", "rep").sortWithinPartitions("key", first).mapInArrow(_links(max_bits, n_pivots), "a long, b long")


def dedup(docs: DataFrame, scratch: Scratch, size: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row.

    Null texts and texts without words have fingerprint zero and link like any other; rows
    without doc_id are returned with the component of their fingerprint, null if nothing
    with an id is in it; an empty table gives no rows.
    """
    prints = scratch.table(fingerprints(docs, size), "prints")
    classes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    found = links(classes.select("fp", F.col("fp").alias("rep")), max_bits)  # a class is its fingerprint, whatever ids its rows have
    comp = components(found, scratch)
    of = scratch.table(classes.join(comp, classes["fp"] == comp["id"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component")), "of")
    lowest = scratch.table(of.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    return prints.join(of.join(lowest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10(spark, docs: DataFrame) -> DataFrame:
    out = dedup(docs, Scratch(spark, "op10"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by the Jaccard similarity of sets of shingles. Wider fingerprints (the share of
# differing bits estimates the angle between sets) only find large groups cheaply: each row meets a
# few leaders. All other links come from prefixes, which lose none: two sets of n and m shingles of
# that similarity have SIMILARITY / (1 + SIMILARITY) * (n + m) in common, so, sorted in one order, the
# first of these is among the first n - SIMILARITY * n + 1 of one and m - SIMILARITY * m + 1 of the other.

WIDE = 512
WIDE_WORDS = 5
#: Documents are near-duplicates from this Jaccard similarity of their sets of shingles on.
SIMILARITY = 0.8
#: Bits in which a row may differ from its leader: similarity 0.8 is an angle of 0.476, 77.6 of 512 bits on average, and three deviations.
WIDE_BITS = 102
#: Bits of a band at least; more where there are more rows, so a key's rows don't grow with the corpus.
BAND_BITS = 16
#: Rows of a key, if bits were independent.
BAND_ROWS = 16
#: Bands and leaders of the first round, which leaves little of large groups.
LEADER_BANDS, LEADERS = 16, 8
#: A band's number stands above its bits in a key.
BAND_SHIFT = 50
#: Pairs of sets in one Arrow batch: a set may be as long as its document.
ALIKE_BATCH = 256
#: Parities of a set's hashes, for small sets and in rows of shingles; as many as its shingles or up to twice that
#: for others. Sets differ in as many shingles at least as they do in these bits.
PARITIES = 256
#: Bytes of the sample of texts that frequent shingles are found in, and how many of them go last in the order; both only balance tasks.
SAMPLE_BYTES, OFTEN = 16 << 20, 100_000
_FAMILIES = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, WIDE // 64, dtype=np.uint64) | np.uint64(1)


def band_width(rows: int) -> int:
    """Bits of keys wide enough for so many rows."""
    return max(BAND_BITS, math.ceil(math.log2(max(1, rows / BAND_ROWS))))


def wide_bits(h: np.ndarray) -> np.ndarray:
    """WIDE bits over the hashes of distinct shingles: a mixing of each hash for every 64 bits, one bit set where most hashes have it."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(h), 1 << 13):
        part = h[at : at + (1 << 13), None] * _FAMILIES[None, :]
        part ^= part >> np.uint64(29)
        part *= _FAMILIES[None, ::-1]
        part ^= part >> np.uint64(32)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return 2 * ones > len(h)


def least_common(n, m, least: float):
    """Shingles that sets of n and m have in common at least if they have that similarity."""
    return np.ceil(least / (1 + least) * (n + m) - 1e-9)


def prefix(h: np.ndarray, often: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's sorted hashes, frequent ones (often is sorted) last in the order of their rank: one at
    least is common to both of any two sets of that similarity."""
    n = len(h) - math.ceil(least * len(h) - 1e-9) + 1
    if not len(often):
        return h[:n]
    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
    return h[np.argsort(np.where(often[at] == h, rank[at], -1), kind="stable")[:n]]


def parities(h: np.ndarray) -> bytes:
    """Whether a set holds an odd number of hashes of each remainder: a power of two of them, so longer ones fold to shorter."""
    n = max(PARITIES, 1 << (max(1, len(h)) - 1).bit_length())
    return np.packbits(np.bincount((h % np.uint64(n)).astype(np.int64), minlength=n) & 1, bitorder="little").tobytes()


def folded(raw: bytes, nbytes: int = PARITIES // 8) -> bytes:
    """Those of the shorter length."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, nbytes), axis=0).tobytes()


def _wide_prints(size: int, least: float, often_b):
    """A row for each text: its words as a hash, fingerprint, and its set's size, prefix and parities."""

    def run(it):
        from xxhash import xxh3_64_intdigest

        for b in batches(it):
            rows = []
            for x in b.column(2).to_pylist():
                h = np.unique(shingle_hashes(x, size))
                same = np.uint64(xxh3_64_intdigest(b" ".join(x.encode("utf-8", "surrogatepass").lower().split()))).view(np.int64)
                bits = np.packbits(wide_bits(h), bitorder="little").tobytes()
                rows.append((same, bits, len(h), prefix(h, *often_b.value, least).tobytes(), parities(h)))
            kinds = pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc", "key", "same", "bits", "n", "grams", "odd"])

    return run


def _shingles(size: int):
    def run(it):
        for b in batches(it):
            h = [np.zeros(0, np.uint64), *[np.unique(shingle_hashes(x, size)) for x in b.column(0).to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], ["gram"])

    return run


def frequent(text: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a bounded sample of texts (doc, key, text), sorted, and their ranks from the rarest on."""
    nbytes = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if nbytes > SAMPLE_BYTES:
        text = text.filter(F.pmod(F.xxhash64("doc", "key"), F.lit(1 << 30)) < int(SAMPLE_BYTES / nbytes * (1 << 30)) + 1)
    per = text.select("text").mapInArrow(_shingles(size), "gram long").groupBy("gram").count().filter("count > 1")
    rows = per.orderBy(F.desc("count"), "gram").limit(OFTEN).collect()
    h = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - 1 - np.arange(len(h)))[order]


def _chosen(bands: int, width: int) -> np.ndarray:
    """The places of each band's bits, fixed ones out of all."""
    return np.array([np.random.Generator(np.random.PCG64([SEED, k])).choice(WIDE, width, replace=False) for k in range(bands)])


def _bands(bands: int, width: int):
    """A row for each class and band: the band's bits are the key, its number above them."""
    chosen = _chosen(bands, width)

    def run(it):
        weights = (np.uint64(1) << np.arange(width, dtype=np.uint64)).astype(np.int64)
        for b in batches(it):
            raw = b.column(1)
            bits = np.unpackbits(np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little")
            for k in range(bands):
                key = bits[:, chosen[k]].astype(np.int64) @ weights + (k << BAND_SHIFT)
                yield pa.RecordBatch.from_arrays([pa.array(key), raw, b.column(0)], ["key", "bits", "rep"])

    return run


def _pair_batch(rep, i, j):
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[i], rep[j])), pa.array(np.minimum(rep[i], rep[j]))], ["a", "b"])


def _led(limit: int, leaders: int):
    """Pairs of one key within limit bits: each row with its leader, for so many leaders a key."""

    def by_leaders(key, fp, rep):
        at = np.arange(len(key))
        for _ in range(leaders):
            first = np.concatenate([[True], key[at[1:]] != key[at[:-1]]]) if len(at) else np.zeros(0, bool)
            lead = at[first][np.cumsum(first) - 1]
            near = ~first & (np.bitwise_count(fp[at] ^ fp[lead]).sum(1, dtype=np.int16) <= limit)
            if near.any():
                yield _pair_batch(rep, at[near], lead[near])
            at = at[~first & ~near]
            if not len(at):
                break

    def run(it):
        held, n = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, WIDE // 64), b.column(2).to_numpy()))
            n += b.num_rows
            if n >= BUFFER_ROWS:
                key, fp, rep = (np.concatenate(c) for c in zip(*held))
                yield from by_leaders(key, fp, rep)
                tail = np.flatnonzero(key == key[-1])[:64]
                held, n = [(key[tail], fp[tail], rep[tail])], 0
        if held:
            yield from by_leaders(*(np.concatenate(c) for c in zip(*held)))

    return run


def _grams(it):
    """A row for each shingle of a set's prefix, with its place there; rows come as (rep, component, n, grams, odd)."""
    for b in batches(it):
        grams = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
        sizes, odds = np.array([len(x) for x in grams]), pa.array([folded(x) for x in b.column(4).to_pylist()], pa.binary())
        of = np.repeat(np.arange(len(grams)), sizes)
        place, grams = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.concatenate(grams)
        for a in range(0, len(of), 1 << 16):
            k = pa.array(of[a : a + (1 << 16)])
            rep, component, n, odd = (c.take(k) for c in (b.column(0), b.column(1), b.column(2), odds))
            yield pa.RecordBatch.from_arrays([pa.array(grams[a : a + (1 << 16)]), rep, component, n, pa.array(place[a : a + (1 << 16)].astype(np.int32)), odd], ["key", "rep", "component", "n", "place", "odd"])


def _across(least: float):
    """Pairs of one shingle from different components that may have that similarity: all that have it and share no earlier shingle."""

    def flush(key, rep, component, n, place, odd):
        left = n - place

        def close(i, j):
            on = component[i] != component[j]
            i, j = i[on], j[on]
            need = least_common(n[i], n[j], least)
            on = (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & (np.minimum(left[i], left[j]) >= need)
            i, j, need = i[on], j[on], need[on]
            on = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= n[i] + n[j] - 2 * need
            return i[on], j[on]

        large, rest = _large_groups(key)
        at, shift, found = np.flatnonzero(rest), 0, []
        for a, z in large:  # the largest component's rows meet those of others alone
            names, of = np.unique(component[a:z], return_inverse=True)
            apart = a + np.flatnonzero(of != np.bincount(of).argmax())
            everyone = np.arange(a, z)
            for k in apart.tolist():
                found.append(close(np.full(z - a, k), everyone))
        while True:
            shift += 1
            at = at[at + shift < len(key)]
            at = at[key[at] == key[at + shift]]
            if not len(at):
                break
            for a in range(0, len(at), 1 << 16):
                found.append(close(at[a : a + (1 << 16)], at[a : a + (1 << 16)] + shift))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            if len(i):
                pairs = np.unique(np.stack([np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])], 1), axis=0)
                for a in range(0, len(pairs), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + (1 << 16), 0].copy()), pa.array(pairs[a : a + (1 << 16), 1].copy())], ["a", "b"])

    def run(it):
        held, n = [], 0
        for b in it:
            if not b.num_rows:
                continue
            odd = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
            held.append((*[b.column(c).to_numpy() for c in range(3)], *[b.column(c).to_numpy().astype(np.int64) for c in (3, 4)], odd))
            n += b.num_rows
            if n >= BUFFER_ROWS:
                cols = [np.concatenate(c) for c in zip(*held)]
                whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
                yield from flush(*(c[:whole] for c in cols))
                held = [tuple(c[whole:].copy() for c in cols)]
                n = 0
        if held:
            yield from flush(*(np.concatenate(c) for c in zip(*held)))

    return run


def _may_be_alike(least: float):
    """The pairs (a, b, n and parities of a, those of b) that differ in no more parities than such sets do in shingles."""

    def run(it):
        for b in batches(it):
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in (2, 4))
            most, near = n + m - 2 * least_common(n, m, least), []
            for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist()):
                k = min(len(x), len(y))
                near.append((int.from_bytes(folded(x, k)) ^ int.from_bytes(folded(y, k))).bit_count())
            on = pa.array(np.array(near) <= most)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], ["a", "b"])

    return run


def _sets(size: int):
    """The sorted distinct shingle hashes of each text."""

    def run(it):
        for b in batches(it):
            raw = [np.unique(shingle_hashes(x, size)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["rep", "grams"])

    return run


def jaccard(x: bytes, y: bytes) -> float:
    """Similarity of two sets of hashes from _sets."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def _alike(least: float):
    def run(it):
        for b in it:
            near = [jaccard(x, y) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return run


def verified(pairs: DataFrame, classes: DataFrame, text: DataFrame, scratch: Scratch, name: str, size: int = WIDE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of classes (rep, doc, key) whose texts in (doc, key, text) have that similarity; a text may come more than once."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    some = text.join(classes.select("rep", "doc", "key").join(wanted, "rep", "left_semi").hint("merge"), ["doc", "key"]).select("rep", "text")
    sets = scratch.table(some.mapInArrow(_sets(size), "rep long, grams binary").dropDuplicates(["rep"]), f"{name}-sets")
    one = pairs.join(sets.withColumnRenamed("rep", "b").withColumnRenamed("grams", "gb").hint("merge"), "b")
    two = one.join(sets.withColumnRenamed("rep", "a").withColumnRenamed("grams", "ga").hint("merge"), "a")
    conf, rows = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    conf.set(rows, ALIKE_BATCH)
    try:
        out = scratch.table(two.select("a", "b", "ga", "gb").mapInArrow(_alike(least), "a long, b long"), f"{name}-alike")
    finally:
        conf.set(rows, before)
    scratch.drop(f"{name}-sets")
    return out


def wide_links(classes: DataFrame, text: DataFrame, scratch: Scratch, limit: int = WIDE_BITS, size: int = WIDE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """classes (rep, doc, key, bits, n, grams, odd), texts (doc, key, text) -> links (a, b) that connect all near-duplicates.

    The first round compares rows with leaders of their bands, so a group of near copies costs its
    size. The second one compares all rows that share a shingle of their prefixes, but for those that the
    first round has connected already.
    """
    width = band_width(classes.count())
    spread = classes.select("rep", "bits").mapInArrow(_bands(LEADER_BANDS, width), "key long, bits binary, rep long")
    led = spread.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_led(limit, LEADERS), "a long, b long")
    first = verified(scratch.table(led.distinct(), "led"), classes, text, scratch, "led", size, least)
    comp = components(first, scratch, "led")
    of = classes.join(comp, classes["rep"] == comp["id"], "left").select("rep", F.coalesce("component", "rep").alias("component"), "n", "grams", "odd")
    dealt = of.mapInArrow(_grams, "key long, rep long, component long, n int, place int, odd binary").repartition("key").sortWithinPartitions("key")
    across = scratch.table(dealt.mapInArrow(_across(least), "a long, b long").distinct(), "across")
    scratch.free()
    odd = lambda c: of.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}"))
    both = across.join(odd("a").hint("merge"), "a").join(odd("b").hint("merge"), "b").select("a", "b", "na", "odda", "nb", "oddb")
    across = scratch.table(both.mapInArrow(_may_be_alike(least), "a long, b long"), "may")
    return first.unionByName(verified(across, classes, text, scratch, "across", size, least))


def one_of_each(docs: DataFrame, scratch: Scratch, limit: int = WIDE_BITS, size: int = WIDE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs with all its columns (but those named with two underscores): of each group of near-duplicates the smallest doc_id stays, once.

    Near-duplicates have that similarity or more; groups are chains of them, and no pair is left out. Texts with the same words
    are one class. Null texts and texts without words are left as they are; rows without doc_id stay
    if nothing with an id is like them; rows that agree in doc_id and text stay once; very long texts
    are handled whole, their shingles a batch of hashes at a time; an empty table gives no rows.
    """
    docs = plain(docs)
    worded = "[^\\x20\\x09-\\x0D]"
    doc, key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce("text", F.lit("")))
    text = doc_text(docs).select(doc.alias("doc"), key.alias("key"), "text").filter(F.col("text").rlike(worded))
    often = docs.sparkSession.sparkContext.broadcast(frequent(text, size))
    prints = scratch.table(text.mapInArrow(_wide_prints(size, least, often), "doc long, key long, same long, bits binary, n int, grams binary, odd binary"), "prints")
    first = F.min(F.struct("doc", "key"))
    classes = prints.groupBy("same", "bits").agg(first.alias("p"), *[F.first(c).alias(c) for c in ("n", "grams", "odd")]).select("same", "bits", "p.doc", "p.key", "n", "grams", "odd")
    classes = scratch.table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers of their own, which no two classes share
    comp = components(wide_links(classes, text, scratch, limit, size, least), scratch, "wide")
    of = classes.join(comp, classes["rep"] == comp["id"], "left").select("doc", "key", F.coalesce("component", "rep").alias("component"))
    keep = of.groupBy("component").agg(first.alias("p")).select("p.doc", "p.key")
    gone = prints.select("doc", "key").distinct().join(keep, ["doc", "key"], "left_anti").select(F.col("doc").alias("__doc"), F.col("key").alias("__key"))
    gone = scratch.table(gone, "gone")
    scratch.drop("prints", "classes")
    keyed = docs.withColumns({"__doc": doc, "__key": key})
    left = keyed.join(gone.hint("merge"), ["__doc", "__key"], "left_anti")
    bare = ~F.coalesce(F.col("text"), F.lit("")).rlike(worded)
    once = left.filter(~bare).dropDuplicates(["__doc", "__key"]).unionByName(keyed.filter(bare))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
