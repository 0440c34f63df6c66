"""The training-data operators against brute force, round trips and held-out accuracy, with the odd cases:
nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxloom.llm import chat_format, components, embedding_dedup, line_dedup, lm_scoring, mixing, packing, quality_rules, queries, simhash_dedup, token_output, tokens, toxicity
from voxloom.llm.util import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
SENT = "The quick brown fox jumps over the lazy dog while many other animals look on from afar"
ROWS = [
    (1, f"{SENT}\n{SENT} again\nThird line", "en", "src1", 5),
    (2, f"{SENT}\n{SENT} again\nOther line", "en", "src1", None),
    (3, None, None, None, None),
    (4, "", "de", "src2", 0),
    (5, "   \n\t ", None, "src0", 0),
    (6, LONG, "fr", "src4", 1),
    (7, "Ünïcödé  wörds\x85and\xa0more — “quotes” 日本語 🙂 <|endoftext|>", "fr", None, 1),
    (8, "Ünïcödé  wörds\x85and\xa0more — “quotes” 日本語 🙂 <|endoftext|>", "fr", "src9", 1),
    (9, "one", "xx", "src3", 3),
    (9, "one", "xx", "src3", 3),
    (10, "a b c d e f g h a b c d e f g h # $ * <x>\nline\nline\n\n\nline", "en", "src3", 3),
    (None, "no id here", "en", "src3", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with columns that operators use inside, to clash with them."""
    df = spark.createDataFrame(ROWS, DOCS)
    for c in ("key", "word", "fp", "tie", "rid", "bin", "n", "x0", "score", "domain", "marks"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def ids_of(rows):
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    return [tok.encode(t, add_special_tokens=False).ids + [2] for _, t in rows]


# 1 token output


def check_encoding(e, texts):
    starts, ids = e.encode(texts, 2)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == ids_of([(0, t) for t in texts])


def test_piecewise_encoding_is_whole_encoding():
    e = tokens.Encoder(tokens.vocabulary_path(), memo_bytes=5000)
    odd = [t or "" for _, t, *_ in ROWS] + [" a", "a ", "a  b", "'s 'll don't it's,", "x\n\ny \n z", "½ a² ﷺ", "Ġa ĠĠ b", "é a.b,c! 12 3a", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|> y <|endoftext", " <|endoftext|>"]
    for _ in range(2):
        check_encoding(e, odd)
    assert len(e.encode([])[1]) == 0


def test_random_texts_encode_as_the_library_does():
    rng = np.random.Generator(np.random.PCG64(30))
    kinds = [list("abcxyzABC'019 .,!?-\n\t "), [chr(c) for c in range(0x20, 0x250)], [chr(c) for c in (*range(0x2000, 0x2030), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640), 0x85, 0xA0, 0x0B, 0x1C, 0x300, 0x0D)] + list(" a")]
    rows = ["".join(rng.choice(kinds[k % 3], rng.integers(0, 40))) for k in range(10_000)]
    e = tokens.Encoder(tokens.vocabulary_path())
    for a in range(0, len(rows), 2500):
        check_encoding(e, rows[a : a + 2500])


def test_very_long_texts_are_encoded_within_the_memo():
    rng = np.random.Generator(np.random.PCG64(31))
    blob = "".join(rng.choice(list("abcdefABCDEF0123+/"), 1_200_000))
    e = tokens.Encoder(tokens.vocabulary_path(), memo_bytes=100_000)
    check_encoding(e, [blob, f"some words {blob[:300_000]} and more", LONG * 5])
    assert not e.memo


def test_shard_random_access():
    rng = np.random.Generator(np.random.PCG64(3))
    docs = [rng.integers(0, 1 << int(b), n, dtype=np.uint32) for b, n in ((8, 700), (16, 0), (17, 900), (31, 5), (1, 1))]
    raw = token_output.pack(range(5), docs)
    s = token_output.Shard(raw)
    flat = np.concatenate(docs)
    assert np.array_equal(s.decode(), flat)
    assert [s.token(i) for i in range(len(flat))] == flat.tolist()
    assert all(np.array_equal(x, docs[k]) for k, (_, _, x) in enumerate(s.docs()))
    with pytest.raises(IndexError):
        s.token(len(flat))
    assert token_output.Shard(token_output.pack([], [])).decode().size == 0


def _op1_want(rows):
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    out, base = [], 0
    for (d, _), x in zip(rows, ids_of(rows)):
        out.append((d, base, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        base += len(x)
    return out


def test_op1(spark, docs, empty, real):
    for df in (docs, real):
        got = sorted(tuple(r) for r in token_output.op1(spark, df).collect())
        assert got == _op1_want(texts(df))
    small = token_output.write(real, Scratch(spark, "t"), shard_tokens=5000)
    assert small.count() > 20
    assert sorted(tuple(r) for r in token_output.read_back(small).collect()) == _op1_want(texts(real))
    assert token_output.op1(spark, empty).count() == 0


# 2 embeddings, 10 SimHash


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 790)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect())
    want = union(800, pairs)
    for a, b in pairs:
        if a != b:
            assert got.get(a, a) == want[a] and got.get(b, b) == want[b]


def test_op2(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    centres = rng.standard_normal((60, 16))
    near = np.repeat(centres, 8, 0) + 0.08 * rng.standard_normal((480, 16))
    x = np.vstack([near, rng.standard_normal((300, 16)), np.repeat(centres[:1], 200, 0), centres[:1] * 3]).astype("f4")
    rows = [(k * 3 + 1, v.tolist(), 0) for k, v in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = unit @ unit.T >= 0.95
    np.fill_diagonal(g, False)
    comp = union(len(x), zip(*np.nonzero(g)))
    want = {rows[k][0]: (int(g[k].sum()), rows[comp[k]][0]) for k in range(len(x))}
    bad = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0, None] * 8, 1), (5004, [float("inf")] * 16, 1), (5005, [], None), (5006, [1.0, 2.0], None), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r.vec_id: r for r in embedding_dedup.op2(spark, df).collect()}
    assert len(got) == len(rows) + len(bad)
    hit = sum(got[k].n_links for k in want)
    assert hit >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[k].n_links <= n for k, (n, _) in want.items())
    assert sum(got[k].component_id == c for k, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] for b in bad)
    assert all(r.kept == (r.vec_id == r.component_id) for k, r in got.items() if k is not None)
    assert embedding_dedup.op2(spark, df.limit(0)).count() == 0


def test_op2_tiles_count_each_pair_once(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(4))
    x = np.ones((300, 8)) + 0.01 * rng.standard_normal((300, 8))
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in embedding_dedup.op2(spark, df).collect()} == {(299, 0)}


def test_op2_dense_group_loses_no_links(spark):
    """A third of the rows in one group of distinct vectors around the threshold."""
    rng = np.random.Generator(np.random.PCG64(21))
    group = rng.standard_normal(64) / 8 + math.sqrt(1 / 0.955 - 1) / 8 * rng.standard_normal((2000, 64))
    x = np.vstack([group, rng.standard_normal((4000, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert 0.5 < want[:2000].mean() / 2000 < 0.95
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.op2(spark, df).collect()}
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * want.sum()


def fingerprint(t):
    from xxhash import xxh64_intdigest

    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_op10(spark, docs, empty, real):
    for df in (real, docs):
        rows = texts(df)
        fp = np.array([fingerprint(t) for _, t in rows], np.uint64)
        pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if int(fp[i] ^ fp[j]).bit_count() <= 4]
        want = collections.Counter()
        comp = union(len(rows), pairs)
        groups = collections.defaultdict(list)
        for k, c in enumerate(comp):
            groups[c].append(k)
        for g in groups.values():
            low = min((rows[k][0] for k in g if rows[k][0] is not None), default=None)
            want.update((rows[k][0], f"{fp[k]:016x}", low) for k in g)
        assert collections.Counter(tuple(r) for r in simhash_dedup.op10(spark, df).collect()) == want
    assert simhash_dedup.op10(spark, empty).count() == 0


def test_unlike_rows_may_share_ids(spark):
    """Two texts, or vectors, under one id are two nodes: neither takes the other's links."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, b)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash_dedup.op10(spark, df).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 1): 1}
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, x), (1, y), (2, [1.0, 0.1, 0.0, 0.0]), (3, [0.1, 1.0, 0.0, 0.0]), (5, [0.0, 0.1, 0.01, 0.0])]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.op2(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == {(1, 1, 1): 1, (1, 2, 1): 1, (2, 1, 1): 1, (3, 2, 1): 1, (5, 2, 1): 1}


def test_links_lose_nothing(spark):
    """Chains and balls of fingerprints up to four bits apart, over buffers of a few rows."""
    rng = np.random.Generator(np.random.PCG64(6))
    fps = set()
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
    fps = sorted(fps)
    simhash_dedup.BUFFER_ROWS, old = 16, simhash_dedup.BUFFER_ROWS
    try:
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
        got = union(len(fps), [tuple(r) for r in simhash_dedup.links(df).collect()])
    finally:
        simhash_dedup.BUFFER_ROWS = old
    assert got == union(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])


def test_leaders_link_as_all_pairs_do():
    rng = np.random.Generator(np.random.PCG64(18))
    ball = np.uint64(0x0F0F123456789ABC) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 3)).astype(np.uint64), axis=1)
    fp = np.unique(np.concatenate([ball, rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    dist = np.bitwise_count(fp[:, None] ^ simhash_dedup.pivots(8)[None, :]).astype(np.int16)
    for limit in (2, 4, 20):
        i, j = simhash_dedup.link_group(fp[:, None], dist, limit)
        got = union(len(fp), zip(i.tolist(), j.tolist()))
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= limit
        assert got == union(len(fp), zip(*np.nonzero(near)))


def test_one_of_each(spark, docs, empty):
    rng = np.random.Generator(np.random.PCG64(8))
    words = [f"t{k}" for k in range(3000)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(10):
        w = base[k].split()
        w[150] = "changed"
        rows += [(100 + k, " ".join(w)), (200 + k, base[k].upper())]
    rows += [(300, None), (301, ""), (302, " \n"), (29, base[29])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__key", F.lit(1)).withColumn("bits", F.lit(2))
    got = sorted(r.doc_id for r in simhash_dedup.one_of_each(df, Scratch(spark, "t")).collect())
    assert got == [*range(30), 300, 301, 302]
    assert set(simhash_dedup.one_of_each(docs, Scratch(spark, "t")).columns) == set(docs.columns)
    assert simhash_dedup.one_of_each(empty, Scratch(spark, "t")).count() == 0


def test_near_duplicates_by_exact_similarity(spark):
    """Pairs just above the similarity lose one document, those below it lose none, also in a group that shares a text."""
    rng = np.random.Generator(np.random.PCG64(22))
    rows, lost = [], 0
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(160):
        w = [f"d{k}w{j}" for j in rng.integers(0, 10**6, 400)]
        v, least = list(w), (0.805, 0.74)[k % 2]
        while True:
            u = list(v)
            u[rng.integers(len(u))] = f"new{rng.integers(10**9)}"
            a, b = grams(w), grams(u)
            if len(a & b) < least * len(a | b):
                break
            v = u
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        lost += k % 2 == 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash_dedup.one_of_each(df, Scratch(spark, "t")).collect()}
    assert all(2 * k in got for k in range(160)) and all(2 * k + 1 in got for k in range(1, 160, 2))
    assert sum(2 * k + 1 not in got for k in range(0, 160, 2)) >= 0.95 * lost


def test_near_duplicates_lose_no_link(spark, monkeypatch):
    """Chains whose ends are unlike, short texts and sets of frequent shingles: the groups are those of comparing all pairs."""
    rng = np.random.Generator(np.random.PCG64(29))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def less(w, least):
        """w with words changed, as many as leave that similarity."""
        v = list(w)
        for _ in range(len(w)):
            u = list(v)
            u[rng.integers(len(u))] = f"new{rng.integers(10**9)}"
            if len(grams(w) & grams(u)) < least * len(grams(w) | grams(u)):
                break
            v = u
        return v

    told = []
    for k in range(60):
        w = [f"d{k}w{j}" for j in rng.integers(0, 10**6, rng.integers(60, 500))]
        told += [w, v := less(w, 0.8), less(v, 0.8)]
    for k in range(60):
        w = [f"s{k}w{j}" for j in range(int(rng.integers(5, 20)))]
        told += [w, [*w, "more"], ["less", *w], w[1:]]
    common = [f"c{j}" for j in range(200)]
    told += [[f"m{k}", *common[k : k + 120], f"n{k}"] for k in range(0, 80, 2)]
    order = rng.permutation(len(told))
    sets = [grams(told[k]) for k in order]
    alike = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(root)
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    df = spark.createDataFrame([(k, " ".join(told[at])) for k, at in enumerate(order)], "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in simhash_dedup.one_of_each(df, Scratch(spark, "t")).collect()}
    assert got == {k for k, r in enumerate(root) if k == r}

    hashed = [np.unique(simhash_dedup.shingle_hashes(" ".join(told[k]), 5)) for k in order]
    many = collections.Counter(h for x in hashed for h in x.tolist())
    often = np.array(sorted(h for h in many if many[h] > 3), np.uint64)
    rank = np.argsort(np.argsort([many[h] for h in often.tolist()]))
    rows = sorted((int(np.uint64(h).view(np.int64)), k, k // 200, len(x), at) for k, x in enumerate(hashed) for at, h in enumerate(simhash_dedup.prefix(x, often, rank, 0.8)))
    odd = [simhash_dedup.folded(simhash_dedup.parities(x)) for x in hashed]
    for large, held in ((512, 1 << 18), (4, 64)):  # here, as workers don't see other constants
        monkeypatch.setattr(simhash_dedup, "LARGE_GROUP", large)
        monkeypatch.setattr(simhash_dedup, "BUFFER_ROWS", held)
        cut = (rows[at : at + 50] for at in range(0, len(rows), 50))
        cols = ([pa.array([r[0] for r in x]), pa.array([r[1] for r in x]), pa.array([r[2] for r in x]), *[pa.array([r[c] for r in x], pa.int32()) for c in (3, 4)], pa.array([odd[r[1]] for r in x])] for x in cut)
        found = simhash_dedup._across(0.8)(pa.RecordBatch.from_arrays(x, ["key", "rep", "component", "n", "place", "odd"]) for x in cols)
        pairs = {(b, a) for x in found for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
        want = {(i, j) for i, j in alike if i // 200 != j // 200}
        assert want <= pairs
    of, odd = sorted(pairs), [simhash_dedup.parities(x) for x in hashed]
    cols = [pa.array(c) for k in (0, 1) for c in ([len(hashed[p[k]]) for p in of], [odd[p[k]] for p in of])]
    left = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*of)] + cols, ["a", "b", "na", "odda", "nb", "oddb"])
    assert want <= {(a, b) for x in simhash_dedup._may_be_alike(0.8)([left]) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}


# 3 toxicity


def test_isotonic_and_trees():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0, 1, 0, 1, 0, 1]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    rng = np.random.Generator(np.random.PCG64(9))
    f = rng.standard_normal((2000, 3))
    label = ((f[:, 0] > 0.3) & (f[:, 1] < 0)).astype(int)
    t = toxicity.Trees(rounds=40).fit(f[:1500], label[:1500])
    assert ((t.raw(f[1500:]) > 0) == label[1500:]).mean() > 0.97


def test_fold():
    assert toxicity.fold("Idiot!!") == ("idiot", False)
    assert toxicity.fold("1d10t") == ("idiot", True) and toxicity.fold("i-d-i-o-t") == ("idiot", True)
    assert toxicity.fold("123") == ("", False)


def test_op3(spark, docs, empty):
    rng = np.random.Generator(np.random.PCG64(10))
    plain, bad = [f"word{k}" for k in range(400)], ["blarg", "grunk", "snorv", "quibz"]
    rows, marks = [], []
    for k in range(3000):
        w = list(rng.choice(plain, rng.integers(20, 200)))
        toxic = rng.random() < 0.2
        for _ in range(rng.integers(1, 5) if toxic else 0):
            w[rng.integers(len(w))] = str(rng.choice(bad))
        rows.append((k, " ".join(w), "en", "src0", 1))
        marks.append((k, int(toxic)))
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks + [(None, 1), (7, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    truth = dict(marks)
    got = toxicity.op3(spark, df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 500 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    few = toxicity.op3(spark, docs, labels.limit(3)).collect()
    assert len(few) == len(ROWS) and all(0 <= r.score <= 1 for r in few)
    assert toxicity.op3(spark, empty, labels).count() == 0
    assert {r.score for r in toxicity.op3(spark, docs, labels.limit(0)).collect()} == {0.0}


# 4 line dedup


def check_line_dedup(rows, gone):
    """rows (doc_id, text); gone: the numbers of the lines removed from each. By comparing lines alone:
    every removed line lies in a run of 16 words or more that another place has, and a run of lines that
    an earlier place has goes but for its ends, up to 48 words of short lines each."""
    key = [(d if d is not None else 1 << 62, t) for d, t in rows]
    lines = [t.split("\n") for _, t in rows]
    words = [[len(x.split()) for x in ls] for ls in lines]
    where = collections.defaultdict(list)
    for k, ls in enumerate(lines):
        for j, x in enumerate(ls):
            if x.split():
                where[x].append((k, j))

    def run(k, j, p, q):
        """The first and last line of the equal run through line j of k and line q of p."""
        a = z = 0
        while j - a > 0 and q - a > 0 and lines[k][j - a - 1] == lines[p][q - a - 1]:
            a += 1
        while j + z + 1 < len(lines[k]) and q + z + 1 < len(lines[p]) and lines[k][j + z + 1] == lines[p][q + z + 1]:
            z += 1
        return j - a, j + z

    for k, ls in enumerate(lines):
        for j, x in enumerate(ls):
            if not x.split():
                continue
            others = [(p, q) for p, q in where[x][:200] if (p, q) != (k, j) and (key[p] != key[k] or q != j)]
            if j in gone[k]:
                assert any(sum(words[k][a : z + 1]) >= 16 for a, z in (run(k, j, p, q) for p, q in others))
            elif others and words[k][j] >= 16:  # a line of a chunk's length stays in its first place alone
                assert all((key[k], j) < (key[p], q) for p, q in others)
            elif others:
                for p, q in others:
                    if (key[p], q) < (key[k], j) and key[p] != key[k]:
                        a, z = run(k, j, p, q)
                        assert sum(words[k][a:j]) <= 48 or sum(words[k][j + 1 : z + 1]) <= 48 or any((key[p2], q2) < (key[p], q) for p2, q2 in others)
    return sum(map(len, gone))


def removed_lines(spark, df):
    """Each row's text and the numbers of its lines removed, found by aligning what is left with what was there."""
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()]
    marks = {(r.doc, r.key): {x for m in r.marks for x in range(m["at"], m["at"] + m["n"])} for r in line_dedup.repeated(df, Scratch(spark, "t")).collect()}
    keys = [tuple(r) for r in df.select(*line_dedup.name()).collect()]
    return rows, [marks.get(k, set()) for k in keys]


def test_op4(spark, docs, empty, real):
    rows, gone = removed_lines(spark, real)
    assert check_line_dedup(rows, gone) >= 150
    want = []
    for (d, t), drop in zip(rows, gone):
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
        want.append((d, t.count("\n") + 1, len(drop), len(kept), hashlib.md5(kept.encode()).hexdigest()))
    assert sorted(map(tuple, line_dedup.op4(spark, real).collect())) == sorted(want)
    got = {r.doc_id: r for r in line_dedup.op4(spark, docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 2 and got[3].n_removed == 0 and got[9].n_removed == 0
    assert line_dedup.op4(spark, docs).count() == len(ROWS)
    assert line_dedup.op4(spark, empty).count() == 0
    assert line_dedup.remove(docs, Scratch(spark, "t")).columns[: len(docs.columns)] == docs.columns


def test_ids_that_rows_share_name_texts_of_their_own(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (1, f"{a}\n{b}"), (1, a), (None, b)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.op4(spark, df).collect())
    assert sum(n * k for (_, _, k), n in got.items()) in (3, 4) and got[None, 1, 1] == 1


def test_cover_keeps_every_line():
    rng = np.random.Generator(np.random.PCG64(32))
    for _ in range(300):
        marks = [(int(a), int(n)) for a, n in zip(rng.integers(0, 30, 12), rng.integers(1, 7, 12))]
        lines = lambda ms: {x for a, n in ms for x in range(a, a + n)}
        few = line_dedup.cover(marks)
        assert lines(few) == lines(marks) and few <= set(marks)
        assert all(lines(few - {m}) != lines(marks) for m in few) or len(few) <= 3


def test_boundaries_resist_shifts():
    """Inside a shared passage the boundaries and chunks are the same whatever stands before it."""
    rng = np.random.Generator(np.random.PCG64(12))
    line = lambda n: " ".join(f"u{k}" for k in rng.integers(0, 10**6, n)).encode()
    for size in (1, 2, 5, 7, 12, 30):
        passage = [line(size) for _ in range(400 // size)]
        a, b = [line(3) for _ in range(5)] + passage, [line(9) for _ in range(8)] + passage + [line(4)]
        one = {(h, g): (at - 5, n) for h, g, at, n in line_dedup.chunks(a)}
        two = {(h, g): (at - 8, n) for h, g, at, n in line_dedup.chunks(b)}
        shared = one.keys() & two.keys()
        assert all(one[k] == two[k] for k in shared)
        assert size * len({x for k in shared for x in range(one[k][0], sum(one[k]))}) >= 400 - 4 * 48
        if size < 8:
            assert len(line_dedup.boundaries(passage, [size] * len(passage))) < 0.8 * len(passage)


def _shared_part(spark, part):
    """Lines removed from the second of two texts that share these lines alone."""
    rows = [(1, "\n".join(["before one", *part, "after one"])), (2, "\n".join(["before two", *part, "after two"]))]
    got = {r.doc_id: r.n_removed for r in line_dedup.op4(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 0
    return got[2]


def test_a_line_alone_is_a_passage(spark):
    line = " ".join(f"u{k}" for k in range(60))
    assert _shared_part(spark, [line]) == 1
    df = spark.createDataFrame([(1, line), (2, line), (3, "short line")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.op4(spark, df).collect()} == {1: 0, 2: 1, 3: 0}


def test_short_lines_are_a_passage(spark):
    rng = np.random.Generator(np.random.PCG64(23))
    for sizes in ([7] * 8, [1] * 56, [3, 20, 2, 1, 30, 4], [16, 0, 5, 0, 40]):
        part = [" ".join(f"v{k}" for k in rng.integers(0, 10**9, n)) for n in sizes]
        assert _shared_part(spark, part) == len(part)


# 5 packing


def test_best_fit_fills_bins():
    rng = np.random.Generator(np.random.PCG64(13))
    sizes = rng.integers(1, 300, 5000)
    to = packing.best_fit(sizes, 1024)
    fill = np.bincount(to, sizes)
    assert fill.max() <= 1024 and len(fill) <= math.ceil(sizes.sum() / 1024) + 2
    assert packing.best_fit(np.array([700, 600, 424, 324]), 1024).tolist() == [0, 1, 1, 0]


def check_packing(got, rows):
    ids = collections.Counter()
    for (d, _), x in zip(rows, ids_of(rows)):
        at, k = 0, 0
        while at < len(x):
            to = at + ((len(x) - at) % 1024 or 1024) if k == 0 else at + 1024
            ids[d, k, at, to - at, zlib.crc32(np.array(x[at:to], "<u4").tobytes())] += 1
            at, k = to, k + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    return len(bins), math.ceil(sum(r.length for r in got) / 1024)


def test_op5(spark, docs, empty, real):
    n, least = check_packing(packing.op5(spark, real).collect(), texts(real))
    assert n <= least + 3
    check_packing(packing.op5(spark, docs).collect(), texts(docs))
    assert packing.op5(spark, empty).count() == 0


def test_packing_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 200)
    rng = np.random.Generator(np.random.PCG64(14))
    items = spark.createDataFrame([(k, 0, 0, int(x), 0) for k, x in enumerate(rng.integers(100, 700, 3000))], packing._PIECES).repartition(12)
    got = packing.pack(items, Scratch(spark, "t")).collect()
    assert len(got) == 3000
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.06 * sum(fill.values()) / 1024


# 6 mixing


def test_op6(spark, duck, docs, empty, real):
    same(mixing.op6(spark, real), duck.sql(mixing.OP6_SQL))
    assert mixing.op6(spark, empty).count() == 0
    got = mixing.select(docs, Scratch(spark, "t"))
    assert got.columns[: len(docs.columns)] == docs.columns
    assert got.agg(F.sum("__tokens")).first()[0] <= 2 * sum(len(re.findall(WORD, t)) for _, t in texts(docs))


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)]
    df = spark.createDataFrame(leaves, "__domain string, __lang string, __source string, tokens long")
    got = {r["__source"]: r.budget for r in mixing.budgets(df, 0.2, 1).collect()}
    total = 0.2 * 3010
    en = total / 2 * 50 / 70
    assert abs(got["s4"] - total / 2) < 1e-6 and abs(got["s3"] - total / 2 * 20 / 70) < 1e-6
    assert got["s1"] == 10 and abs(got["s2"] - (en - 10)) < 1e-6
    short = {r["__source"]: r.budget for r in mixing.budgets(df, 1.0, 1).collect()}
    assert short == {s: float(n) for _, _, s, n in leaves}


# 7 chat


def test_op7(spark, duck):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    same(chat_format.op7(spark, df), duck.sql(chat_format.OP7_SQL))
    odd = [(1, 0, "user", "a<b>\\l</msg>\n<+>"), (1, 1, "assistant", None), (1, 1, "assistant", "x\\s\\g🙂"), (1, 2, None, "q"), (1, None, "assistant", ""), (2, 600, "assistant", "last"), (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (3, 1, "we<i>rd>", "<msg role=user>"), (None, 0, "user", "none")]
    df = spark.createDataFrame(odd + [(4, k, "assistant", f"t{k} " + "é" * 300) for k in range(900)], "conv_id long, turn int, role string, text string").withColumn("piece", F.lit(1)).withColumn("formatted", F.lit(2))
    c = duckdb.connect()
    c.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    same(chat_format.op7(spark, df), c.sql(chat_format.OP7_SQL))
    assert chat_format.op7(spark, df.limit(0)).count() == 1


# 8 quality


def _statistics(t):
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = collections.Counter(windows)
    cover = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed


def test_op8(spark, docs, empty, real):
    for df in (docs, real):
        got = quality_rules.op8(spark, df).collect()
        want = collections.Counter((d, *_statistics(t)) for d, t in texts(df))
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.op8(spark, empty).count() == 0


def _distances(rows):
    """rows (lang, source, features) past the base -> squared distances, by NumPy over whole groups: starts, concentration
    steps with the binned share of H, reweighting, floors and pools as the operator states them. None without an estimate."""
    q = quality_rules
    x = np.array([r[2] for r in rows])
    size, langs = collections.Counter(r[:2] for r in rows), collections.Counter(r[0] for r in rows)
    judge = [r[:2] if size[r[:2]] >= q.LEAST else (r[0], "*") if langs[r[0]] >= q.LEAST else ("*", "*") for r in rows]
    out = [None] * len(rows)
    for key in set(judge):
        own = [k for k, r in enumerate(rows) if (r[:2] == key if "*" not in key else key[0] in ("*", r[0]))]
        if len(own) < q.LEAST:
            continue
        g = x[own]

        def factor(v, f):
            v = v * f
            np.fill_diagonal(v, np.maximum(np.diag(v), np.array(q.FLOOR) ** 2))
            return v

        def d2(centre, v, z):
            return np.einsum("ij,jk,ik->i", z - centre, np.linalg.inv(v), z - centre)

        low, mid, high = (np.quantile(g, p, 0, method="inverted_cdf") for p in (0.25, 0.5, 0.75))
        starts = [(mid, factor(np.diag(((high - low) / 1.349) ** 2), 1.0))]
        best = None
        for centre, v in starts:
            for _ in range(q.STEPS):
                bins = np.floor(64 * np.log(d2(centre, v, g) + 1e-6))
                edge = np.sort(bins)[math.ceil(len(own) * q.H) - 1]
                some = g[bins <= edge]
                centre, v = some.mean(0), factor(np.cov(some.T, bias=True), q.FACTOR_H)
            if best is None or np.linalg.slogdet(v)[1] < np.linalg.slogdet(best[1])[1]:
                best = centre, v
        some = g[d2(*best, g) <= q.CHI_975]
        centre, v = some.mean(0), factor(np.cov(some.T, bias=True), q.FACTOR_W)
        mine = [k for k in range(len(rows)) if judge[k] == key]
        for k, d in zip(mine, d2(centre, v, x[mine])):
            out[k] = float(d)
    return out


def test_distances_against_numpy(spark, real, monkeypatch):
    """With the start from the medians alone, as the other one's rows are chosen by Spark's hash."""
    monkeypatch.setattr(quality_rules, "CHOSEN", 0)
    got = {r.doc_id: r for r in quality_rules.op8(spark, real).collect()}
    rows, ids = [], []
    for r in real.collect():
        n, c, sym, dup, rep, failed = _statistics(r.text or "")
        if not failed:
            rows.append((r.lang or "", r.source or "", [math.log1p(n), math.log(c / max(n, 1) + 1e-9), math.log1p(100 * sym / max(c, 1)), math.log1p(dup), math.log1p(100 * rep / max(n, 1))]))
            ids.append(r.doc_id)
    want = _distances(rows)
    assert all(d is not None for d in want) and len(want) > 100
    for k, d in zip(ids, want):
        assert abs(got[k].d2 - d) < 1e-6 * max(1, d) and got[k].kept == (d <= quality_rules.CUTOFF)


def test_outliers_by_robust_distance(spark):
    rng = np.random.Generator(np.random.PCG64(15))
    rows = [(k, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(int(rng.lognormal(5, 0.4)))), "en", "s", 0) for k in range(500)]
    rows += [(1000 + k, " ".join("#" * 40 + f"{k}x{j}" + "$" * 40 for j in range(60)), "en", "s", 0) for k in range(60)]
    got = {r.doc_id: r.kept for r in quality_rules.op8(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[1000 + k] for k in range(60))
    assert sum(got[k] for k in range(500) if len(rows[k][1].split()) >= 20) >= 0.99 * sum(len(r[1].split()) >= 20 for r in rows[:500])


def _prose(n, symbols=0.0, seed=24):
    rng = np.random.Generator(np.random.PCG64([seed, n]))
    for _ in range(n):
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(int(rng.lognormal(5, 0.3)) + 20)]
        yield " ".join("".join("#" if rng.random() < symbols else c for c in x) for x in w)


def test_small_groups_are_judged_by_their_pool(spark):
    rows = [(k, t, "en" if k < 250 else f"l{k % 5}", f"s{k % 10}", 0) for k, t in enumerate(_prose(300))]
    rows += [(1000 + k, t, "en" if k < 5 else "l1", f"s{k}", 0) for k, t in enumerate(_prose(10, 0.7))]
    got = {r.doc_id: r.kept for r in quality_rules.op8(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[1000 + k] for k in range(10)) and sum(got[k] for k in range(300)) >= 297


def test_moderate_symbol_spam_is_an_outlier(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(_prose(300))] + [(1000 + k, t, "en", "s", 0) for k, t in enumerate(_prose(10, 0.23))]
    got = {r.doc_id: r.kept for r in quality_rules.op8(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[1000 + k] for k in range(10)) and sum(got[k] for k in range(300)) >= 297


# 9 LM scoring


def test_stirling_numbers():
    """Against the weights of all seatings of a few customers, and the exact recursion for many."""
    d = 0.6

    def seatings(sizes, left):
        if not left:
            yield sizes
            return
        yield from seatings([*sizes, 1], left - 1)
        for k in range(len(sizes)):
            yield from seatings([*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]], left - 1)

    for c in (1, 2, 4, 6):
        want = collections.Counter()
        for sizes in seatings([], c):
            want[len(sizes)] += math.prod(math.prod(j - d for j in range(1, n)) for n in sizes)
        got = np.exp(lm_scoring.stirling(8, d)[c])
        assert all(abs(got[t] - want[t]) < 1e-9 * max(1, want[t]) for t in range(1, c + 1)) and got[c + 1 :].sum() == 0


def test_tables_are_drawn_from_their_conditional():
    d = lm_scoring.Discounts((60, 20), (40, 30))
    n = 20_000
    u, w = np.arange(n, dtype=np.uint64) * np.uint64(977) + np.uint64(5), np.arange(n, dtype=np.uint64) * np.uint64(31)
    own, root, total = 12, 5, 60
    for c in (2, 7, 64, 300, 12):
        if c != 12:
            t = lm_scoring.reseat(np.full(n, c), np.ones(n, np.int64), np.full(n, own), np.full(n, root), total, d, u, w, 3)
        else:
            t = np.array([len(lm_scoring.reseat_singly(c, None, own - 1, root - 1, total - 1, d, [k, 5], 400)) for k in range(1000)])
        i = np.arange(1, c)
        steps = np.log(lm_scoring.STRENGTH + d.d1 * (own - 1 + i)) + np.log(root - 1 + i - d.d0) - np.log(lm_scoring.STRENGTH + total - 1 + i)
        lp = lm_scoring.stirling(c, d.d1)[c, 1:] + np.concatenate([[0], np.cumsum(steps)])
        p = np.exp(lp - lp.max())
        p /= p.sum()
        assert np.abs(np.bincount(t, minlength=c + 1)[1:] / len(t) - p).max() < (0.02 if len(t) == n else 0.06)


def test_many_customers_are_drawn_as_few(monkeypatch):
    """The draws are the same whether Stirling numbers come from the table or from integrals, for any number of customers."""
    rng = np.random.Generator(np.random.PCG64(41))
    for pairs in ((60, 20), (95, 3)):
        d = lm_scoring.Discounts(pairs, (40, 30))
        for top, total in ((300, 900), (3000, 10**7)):
            c = np.append(rng.integers(41, top, 24), [41, top])
            t = rng.integers(1, 40, len(c))
            own, root = t + rng.integers(0, 10 ** rng.integers(1, 6, len(c))), t + rng.integers(0, 10 ** rng.integers(1, 6, len(c)))
            u, w = (rng.integers(0, 1 << 56, len(c), dtype=np.uint64) for _ in range(2))
            got = []
            for exact in (top, 40):
                monkeypatch.setattr(lm_scoring, "EXACT", exact)
                got.append(lm_scoring.reseat(c, t, own, root, total + int(root.max()), d, u, w, 3).tolist())
            assert got[0] == got[1] and len(set(got[0])) > 3
        for n in (41, 3000):
            t = np.unique(np.linspace(1, n, 60).astype(int))
            want = lm_scoring.stirling(3000, d.d1)[n, t] - math.lgamma(n + 1) + [math.lgamma(k + 1) + k * math.log(d.d1) for k in t.tolist()]
            assert np.abs(lm_scoring.log_coefficient(n, t, d.d1) - want).max() < 1e-4
    assert 50 < lm_scoring.draw_tables(10**8, 10**5, 10**4, 10**7, d, 0.5) < 10**4


def test_packed_cells():
    rng = np.random.Generator(np.random.PCG64(33))
    hu, hw = (rng.integers(0, 1 << 56, 40, dtype=np.uint64)[rng.integers(0, 40, 900)] for _ in range(2))
    doc, held = np.sort(rng.integers(0, 300, 900)), rng.random(300) < 0.3
    c = lm_scoring.Cell(lm_scoring.cell(hu, hw, doc, 300, held))
    got = collections.Counter()
    ends = np.cumsum(c.n.astype(int))
    for k, (a, b) in enumerate(zip(ends - c.n, ends)):
        for j in range(a, b):
            got[int(c.u[c.pu[k]]), int(c.w[c.pw[k]]), int(c.docs[j])] += int(c.times[j])
    assert got == collections.Counter(zip(hu.tolist(), hw.tolist(), doc.tolist()))
    train = collections.Counter((a, b) for a, b, x in zip(hu.tolist(), hw.tolist(), doc) if not held[x])
    few = lm_scoring.Cell(lm_scoring.counts_cell(hu, hw, ~held[doc]))
    for x in (c, few):
        assert [train[int(x.u[i]), int(x.w[j])] for i, j in zip(x.pu, x.pw)] == x.c.tolist()


def _pitman_yor(docs, train, sweeps, d1, d0, strength=1.0):
    """A sequential sampler: each customer of each restaurant leaves and sits down again. Mean log10 probability of each document."""
    rng = np.random.Generator(np.random.PCG64(34))
    seats, root = collections.defaultdict(list), collections.Counter()  # (context, word) -> sizes of its tables
    pairs = [(u, w) for k in train for u, w in zip([None, *docs[k]], docs[k])]
    total = collections.Counter()  # customers and tables of a context
    tables = collections.Counter()
    words = sorted({w for _, w in pairs})

    def p0(w):
        return ((root[w] - d0) if root[w] else strength + d0 * len(words)) / (strength + sum(root.values()))

    def sit(u, w):
        sizes = seats[u, w]
        new = (strength + d1 * tables[u]) * ((root[w] - d0) / (strength + sum(root.values())) if root[w] else 1.0)
        weights = np.array([n - d1 for n in sizes] + [new if root[w] else 1.0])
        k = rng.choice(len(weights), p=weights / weights.sum()) if root[w] else 0
        if not root[w] or k == len(sizes):
            sizes.append(1)
            root[w] += 1
            tables[u] += 1
        else:
            sizes[k] += 1
        total[u] += 1

    for u, w in pairs:
        sit(u, w)
    scores = []
    for s in range(sweeps):
        for u, w in pairs:
            sizes = seats[u, w]
            k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
            if sizes[k] == 1 and root[w] == 1:
                continue  # the only table of a word
            sizes[k] -= 1
            total[u] -= 1
            if not sizes[k]:
                del sizes[k]
                root[w] -= 1
                tables[u] -= 1
            sit(u, w)
        if s >= sweeps // 3:
            scores.append([[(sum(seats[u, w]) - d1 * len(seats[u, w]) + (strength + d1 * tables[u]) * p0(w)) / (strength + total[u]) if total[u] else p0(w) for u, w in zip([None, *x], x)] for x in docs])
    return [float(np.log10(np.mean([s[k] for s in scores], 0)).sum()) for k in range(len(docs))]


def test_scores_match_a_sequential_sampler(spark):
    rng = np.random.Generator(np.random.PCG64(35))
    p = 1 / np.arange(1, 31)
    follows = rng.dirichlet(np.full(30, 0.2), 30) * 0.7 + 0.3 * p / p.sum()
    docs = []
    for _ in range(70):
        w = [int(rng.integers(30))]
        for _ in range(25):
            w.append(int(rng.choice(30, p=follows[w[-1]])))
        docs.append(w)
    told = [[f"v{k}" for k in x] + [""] for x in docs]
    train = [k for k in range(70) if zlib.crc32(str(k).encode()) % 7 != 2]
    count = collections.Counter((u, w) for k in train for u, w in zip([None, *told[k]], told[k]))
    types = collections.Counter(w for _, w in count)
    d = lm_scoring.Discounts(tuple(sum(n == k for n in count.values()) for k in (1, 2)), tuple(sum(n == k for n in types.values()) for k in (1, 2)))
    want = _pitman_yor(told, train, 30, d.d1, d.d0)
    df = spark.createDataFrame([(k, " ".join(f"v{j}" for j in x)) for k, x in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.op9(spark, df).collect()}
    off = np.array([got[k] - want[k] for k in range(70)])
    assert abs(off.mean()) < 0.01 * abs(np.mean(want)) and np.abs(off).max() < 0.06 * abs(np.mean(want))


def test_model_sums_to_one():
    rng = np.random.Generator(np.random.PCG64(16))
    c = rng.integers(0, 9, (300, 8)) * rng.integers(0, 2, (300, 8))
    c[:, 0] += 1
    t = [np.minimum(c, k) for k in (1, 2)]
    d = lm_scoring.Discounts((60, 20), (40, 30))
    m = lm_scoring.Predictive(d, int(c.sum()), len(c), [int(x.sum()) for x in t], None, None, None)
    customers, none = np.append(c.sum(0), 0), np.zeros(9)
    wide = lambda x: np.concatenate([x, np.zeros((len(x), 1))], 1)  # noqa: E731  and a context that was never seen
    known = m.prob(wide(c), [wide(x) for x in t], customers, [np.append(x.sum(0), 0) for x in t], [m.root(x.sum(1), k)[:, None] for k, x in enumerate(t)])
    unknown = m.prob(none, [none, none], customers, [np.append(x.sum(0), 0) for x in t], [m.root(np.zeros(1), k) for k in range(2)])
    assert np.allclose(known.sum(0) + unknown, 1)


def test_scores_do_not_depend_on_the_layout(spark, real):
    few = real.filter("doc_id % 3 = 0")
    want = {r.doc_id: r for r in lm_scoring.score(few.coalesce(1), Scratch(spark, "t")).collect()}
    for parts, nbytes in ((4, 1 << 30), (9, 20_000)):
        got = lm_scoring.score(few.repartition(parts), Scratch(spark, "t"), nbytes).collect()
        assert len(got) == len(want)
        for r in got:
            assert abs(r.score - want[r.doc_id].score) < 1e-9 * abs(r.score) and abs(r.base_score - want[r.doc_id].base_score) < 1e-9 * abs(r.base_score)


def test_op9(spark, docs, empty, real):
    for df in (real, docs):
        rows = texts(df)
        lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        told = [(d, re.findall(WORD, lower(t)) + [None]) for d, t in rows]
        held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
        c = collections.Counter(w for (_, ws), h in zip(told, held) if not h for w in ws)
        total, distinct = sum(c.values()), len(c)
        want = sorted((str(d), h, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), 4)) for (d, ws), h in zip(told, held))
        got = lm_scoring.op9(spark, df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
        if df is real:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm_scoring.op9(spark, empty).count() == 0


# pipeline and registration


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "t").table(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id for r in docs.collect()}
        assert after <= before and len(after) == docs.count()
        before = after
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), texts(docs))


def test_pipeline_stages_with_odd_rows(spark, docs, empty):
    """Each stage over nulls, empty and long texts, repeated rows, clashing columns and no rows at all."""
    import corpus_pipeline

    odd = docs.withColumn("__key", F.lit(1)).withColumn("__removed", F.lit(2))
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            n = out.count()
            if name != "packing":
                assert n <= len(ROWS) and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
            assert n or df is empty
    kept = corpus_pipeline.STAGES[2][1](spark, odd, SF).collect()
    assert sum(r.doc_id == 9 for r in kept) == 1 and sum(r.doc_id in (7, 8) for r in kept) == 1


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.queries()}
    assert "pipeline" in names and set(queries.queries()) <= set(names)
