"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon, the trees and the calibration are fitted on a bounded sample of labelled rows
(FIT_ROWS, in the order of a hash of doc_id); every document is scored over its whole text.
Scores depend on the text alone.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, batches, doc_text, hashed_sample

FIT_ROWS = 30_000
LEXICON = 512
CUTOFF = 0.3
STEM = 5
NEAR = 5
MEMO = 150_000
# Second-person words, and the letters that digits and signs stand for.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros"]
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LEET = str.maketrans(LOOKALIKES)
_RUN = re.compile(r"(.)\1{2,}")
_TRIM = ".,;:!?\"'()[]{}<>|&%#*-_…«»¡¿"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def fold(word: str) -> tuple[str, bool]:
    """The word's letters, and whether it was disguised (signs or digits among letters, or drawn-out letters)."""
    bare = word.strip(_TRIM).lower()
    if bare.isalpha():
        short = _RUN.sub(r"\1", bare)
        return short, short != bare
    if not any(c.isalpha() for c in bare):
        return "", False
    return _RUN.sub(r"\1", "".join(c for c in bare.translate(_LEET) if c.isalpha())), True


def units(folded: str) -> list[str]:
    return [folded, "^" + folded[:STEM]] if len(folded) >= STEM else [folded] if folded else []


class Features:
    """Dense features of a text under a lexicon (unit -> weight)."""

    names = ("strong_density", "strong_count", "max_weight", "weight_mean", "types", "second_person", "near_second_person", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "disguised_hits", "log_words", "mild_density")

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo, self.you = lexicon, {}, frozenset(SECOND_PERSON)

    def _look(self, word: str) -> tuple:
        folded, disguised = fold(word)
        weight = max((self.lexicon.get(u, 0.0) for u in units(folded)), default=0.0)
        return (weight, disguised, folded in self.you, folded, len(word) > 2 and word.isupper())

    def __call__(self, text: str) -> list[float]:
        words, memo = text.split(), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                x = self._look(w)
                memo[w] = x if x[0] or x[1] or x[2] or x[4] else None
        n, raw = len(words), text.encode("utf-8", "surrogatepass")
        said = [(k, x) for k, x in enumerate(map(memo.__getitem__, words)) if x]
        strong = [(k, x) for k, x in said if x[0] >= 2.0]
        mild = sum(0 < x[0] < 2.0 for _, x in said)
        you = np.array([k for k, x in said if x[2]])
        near = 0
        if len(you) and strong:
            at = np.array([k for k, _ in strong])
            p = np.searchsorted(you, at)
            near = int((np.minimum(np.abs(you[np.minimum(p, len(you) - 1)] - at), np.abs(you[np.maximum(p - 1, 0)] - at)) <= NEAR).sum())
        upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
        d, c = max(1, n), max(1, len(raw))
        bang, ask = raw.count(b"!"), raw.count(b"?")
        return [
            len(strong) / d, math.log1p(len(strong)), max((x[0] for _, x in said), default=0.0), sum(x[0] for _, x in said) / d, math.log1p(len({x[3] for _, x in strong})),
            len(you) / d, near / (1 + len(strong)), upper / max(1, upper + lower), sum(x[4] for _, x in said) / d,
            bang / c, ask / c, (bang + ask + raw.count(b"..") + raw.count(b"*")) / c, sum(x[1] for _, x in said) / d, sum(x[1] for _, x in strong) / d, math.log1p(n), mild / d,
        ]


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge, self.trees, self.base = rounds, depth, rate, bins, least, ridge, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(p / (1 - p))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree, node = [], np.zeros(len(y), int)
            open_ = {0: np.arange(len(y))}
            tree.append(None)
            for _ in range(self.depth):
                nxt = {}
                for k, own in open_.items():
                    best = (1e-6, None)
                    total_g, total_h = g[own].sum(), h[own].sum()
                    for j, q in enumerate(cuts):
                        if not len(q):
                            continue
                        size = len(q) + 1
                        gs, hs, ns = (np.bincount(code[own, j], w, size).cumsum()[:-1] for w in (g[own], h[own], None))
                        ok = (ns >= self.least) & (len(own) - ns >= self.least)
                        if not ok.any():
                            continue
                        gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                        b = int(np.argmax(np.where(ok, gain, -1)))
                        if ok[b] and gain[b] > best[0]:
                            best = (gain[b], (j, b))
                    if best[1] is None:
                        continue
                    j, b = best[1]
                    left = code[own, j] <= b
                    tree[k] = (j, float(cuts[j][b]), len(tree), len(tree) + 1)
                    tree += [None, None]
                    for part, child in ((own[left], len(tree) - 2), (own[~left], len(tree) - 1)):
                        node[part] = child
                        nxt[child] = part
                open_ = nxt
            step = {k: self.rate * g[node == k].sum() / (h[node == k].sum() + self.ridge) for k, v in enumerate(tree) if v is None}
            tree = [v if v is not None else float(step[k]) for k, v in enumerate(tree)]
            f += np.array([step.get(k, 0.0) for k in range(len(tree))])[node]
            self.trees.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                k, own = todo.pop()
                if isinstance(tree[k], float):
                    f[own] += tree[k]
                elif len(own):
                    j, cut, a, b = tree[k]
                    left = x[own, j] <= cut
                    todo += [(a, own[left]), (b, own[~left])]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a rising map from raw score to rate, for linear interpolation."""
    order = np.argsort(score, kind="stable")
    at, first = np.unique(score[order], return_index=True)
    n = np.diff(np.append(first, len(order))).astype(float)
    v = np.add.reduceat(y[order].astype(float), first) / n
    rate, mass, low = [], [], []
    for a, b, c in zip(v, n, at):
        rate.append(a), mass.append(b), low.append(c * b)
        while len(rate) > 1 and rate[-2] >= rate[-1]:
            r, m, s = rate.pop(), mass.pop(), low.pop()
            rate[-1] = (rate[-1] * mass[-1] + r * m) / (mass[-1] + m)
            mass[-1] += m
            low[-1] += s
    return np.array(low) / np.array(mass), np.array(rate)


class Model:
    def __init__(self, lexicon, trees, points):
        self.lexicon, self.trees, self.points = lexicon, trees, points

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.points[1][0])
        return np.clip(np.interp(self.trees.raw(x), *self.points), 0, 1)


def held_out(mod: int = 4, rest: int = 2, doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def _unit_counts(it):
    for b in batches(it):
        got: dict[str, list[int]] = {}
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for u in {u for w in set(text.split()) for u in units(fold(w)[0])}:
                got.setdefault(u, [0, 0])[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([v[0] for v in got.values()], pa.int64()), pa.array([v[1] for v in got.values()], pa.int64())], ["unit", "pos", "neg"])


def _rows(lexicon):
    def run(it):
        f = Features(lexicon)
        for b in batches(it):
            rows = [f(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "part"])

    return run


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS) -> Model:
    """docs (doc_id, text); labels (doc_id, toxic). Two thirds of the sample make lexicon and trees, one third the calibration."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = hashed_sample(known, fit_rows, known.count(), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).cast("int")
    sample = scratch.table(doc_text(docs).join(F.broadcast(chosen), "doc_id").select("text", "y", part.alias("part")), "sample")
    sums = {(r.part == 0, r.y): r.n for r in sample.groupBy((F.col("part") == 0).alias("part"), "y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sums.get((False, 1), 0), sums.get((False, 0), 0)
    if min(pos, neg) < 8 or min(sums.get((True, 1), 0), sums.get((True, 0), 0)) < 2:
        rate = sum(n for (_, y), n in sums.items() if y) / max(1, sum(sums.values()))
        return Model({}, None, (np.zeros(1), np.array([rate])))
    counts = sample.filter("part <> 0").select("text", "y").mapInArrow(_unit_counts, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    best = counts.filter(F.col("pos") >= max(2, min(5, pos // 20))).withColumn("w", weight).filter("w >= 1").orderBy(F.desc(F.col("w") * F.sqrt("pos")), "unit").limit(LEXICON)
    lexicon = {r.unit: r.w for r in best.collect()}
    got = sample.mapInArrow(_rows(lexicon), "x array<double>, y int, part int").collect()
    got.sort(key=lambda r: (r.part, r.y, r.x))
    x, y, part = np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.part for r in got])
    trees = Trees(least=max(3, min(20, pos // 4))).fit(x[part != 0], y[part != 0])
    return Model(lexicon, trees, isotonic(trees.raw(x[part == 0]), y[part == 0]))


def _score(model_b):
    def run(it):
        f = Features(model_b.value.lexicon)
        for b in batches(it):
            x = np.array([f(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(Features.names))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model_b.value.score(x))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    return doc_text(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def _flag(model_b, cutoff: float):
    def run(it):
        f = Features(model_b.value.lexicon)
        for b in batches(it):
            at = b.schema.get_field_index("text")
            x = np.array([f(t or "") for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(Features.names))
            yield b.filter(pa.array(model_b.value.score(x) < cutoff))

    return run


def reject(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """docs without the rows that score cutoff or more; all columns stay."""
    return docs.mapInArrow(_flag(docs.sparkSession.sparkContext.broadcast(model), cutoff), docs.schema)


def op3(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document. Null and empty texts are scored as texts without words; repeated rows
    score alike; a document labelled twice counts as toxic if either says so; with too few labels
    of one class every score is the labelled rate (0 without labels)."""
    model = fit(docs, labels, Scratch(spark, "op3"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
