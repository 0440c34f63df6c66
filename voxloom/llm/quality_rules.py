"""Quality rules: text statistics, and robust multivariate outliers of them per language and source.

For each (lang, source) group the minimum covariance determinant estimate is found by
concentration steps from two starts: each takes the distances of all rows, the share H of
them with the smallest ones, and their mean and covariance, until STEPS are done; the start
with the smaller determinant is kept and reweighted once. Rows are rejected by Mahalanobis
distance. Everything is DataFrame aggregates; the share is found on a fine logarithmic
histogram of the distances, so no group is gathered or sorted.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import Scratch

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
H = 0.75
STEPS = 3
#: Eighths of the rows that the second start is made of.
CHOSEN = 1
LEAST = 50
#: Squared distance beyond which a document is rejected: the quantile of chi-square, for five features, that one of 100,000 normal rows exceeds.
CUTOFF = 30.856
# Fixed values for five features: 0.975 quantile of chi-square, and the factors that make the
# covariance of the inner 0.75 and 0.975 of a normal sample consistent.
CHI_975, FACTOR_H, FACTOR_W = 12.833, 1.41, 1.055
FEATURES = ("log_words", "log_word_length", "symbols", "dup_lines", "repeats")
#: The least standard deviation of each feature: a group of copies does not make others outliers.
FLOOR = (0.35, 0.1, 0.3, 0.5, 0.5)
_P = len(FEATURES)
_GROUP = ["lang", "source"]


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows that occur twice; equal hashes are confirmed on the words."""
    at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW))

    def found(p):
        hit = F.filter(p, lambda x, k: F.coalesce(same(x, F.get(p, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, k + 1)), F.lit(False)))
        places = F.array_sort(F.transform(hit, lambda x: x["i"]))
        gaps = lambda q: F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW))))
        return _let(places, lambda q: F.aggregate(gaps(q), F.lit(0), lambda a, x: a + x))

    return _let(at, found)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts; null texts have no words."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _GROUP], F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    n = F.size("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    text = text.select("*", hashes.alias("hashes"), lines.alias("lines"))
    bare = functools.reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("")), SYMBOLS, F.col("text"))
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _repeat_words(F.col("words"), F.col("hashes"))).otherwise(0)
    return text.select(
        "doc_id", *_GROUP,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )


def _features() -> list[Column]:
    n, c = F.col("n_words"), F.col("word_chars")
    return [F.log1p(n), F.log(c / F.greatest(n, F.lit(1)) + 1e-9), F.log1p(100 * F.col("n_symbols") / F.greatest(c, F.lit(1))), F.log1p(F.col("n_dup_lines")), F.log1p(100 * F.col("n_repeat_words") / F.greatest(n, F.lit(1)))]


_X = [f"x{k}" for k in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def _factor(stats: DataFrame, factor: float) -> DataFrame:
    """Adds the lower Cholesky factor l_ij of the covariance (variances are their floors at least) and its log determinant."""
    cov = {(i, j): F.greatest(F.col(f"v{i}{j}") * factor, F.lit(FLOOR[i] ** 2)) if i == j else F.col(f"v{i}{j}") * factor for i, j in _PAIRS}
    for i in range(_P):
        for j in range(i + 1):
            rest = functools.reduce(operator.add, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            value = F.sqrt(F.greatest(cov[i, i] - rest, F.lit(1e-9))) if i == j else (cov[i, j] - rest) / F.col(f"l{j}{j}")
            stats = stats.withColumn(f"l{i}{j}", value)
    return stats.withColumn("logdet", functools.reduce(operator.add, [F.log(f"l{i}{i}") for i in range(_P)]))


def _with_distance(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    out = rows.join(stats, keys, how)
    for i in range(_P):
        rest = functools.reduce(operator.add, [F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)], F.lit(0.0))
        out = out.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return out.withColumn("d2", functools.reduce(operator.add, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(_P)]))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(_X)], *[F.covar_pop(_X[i], _X[j]).alias(f"v{i}{j}") for i, j in _PAIRS], F.count("*").alias("used"))


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (lang, source, x0...) -> per group with LEAST rows or more: centre m, factor l of the reweighted estimate."""
    sizes = rows.groupBy(*_GROUP).agg(F.count("*").alias("n"), *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{k}") for k, x in enumerate(_X)]).filter(F.col("n") >= LEAST)
    sizes = scratch.table(sizes, "sizes")
    spread = [F.pow((F.get(f"q{k}", F.lit(2)) - F.get(f"q{k}", F.lit(0))) / 1.349, 2) for k in range(_P)]
    median = sizes.select(*_GROUP, F.lit(0).alias("start"), *[F.get(f"q{k}", F.lit(1)).cast("double").alias(f"m{k}") for k in range(_P)], *[(spread[i] if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _PAIRS])
    some = rows.filter(F.pmod(F.xxhash64(F.lit(17), *_X), F.lit(8)) < CHOSEN)
    chosen = _moments(some, _GROUP).join(sizes.select(*_GROUP), _GROUP).filter("used > 10").select(*_GROUP, F.lit(1).alias("start"), *[f"m{k}" for k in range(_P)], *[f"v{i}{j}" for i, j in _PAIRS])
    stats, keys = scratch.table(_factor(median.unionByName(chosen), 1.0), "start"), [*_GROUP, "start"]
    inner = sizes.select(*_GROUP, F.ceil(F.col("n") * H).alias("h"))
    bin_ = F.floor(64 * F.log(F.col("d2") + 1e-6)).cast("int")
    for step in range(STEPS):
        near = _with_distance(rows, stats, _GROUP).select(*keys, *_X, bin_.alias("bin"))
        counts = scratch.table(near.groupBy(*keys, "bin").agg(F.count("*").alias("n")), f"bins{step}")  # summed by bin first: tasks' counts of a large group don't meet in one
        upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*keys).orderBy("bin"))).join(inner, _GROUP)
        edge = scratch.table(upto.filter("upto >= h").groupBy(*keys).agg(F.min("bin").alias("edge")), f"edge{step}")  # one row a group: rows are combined before they are dealt
        stats = scratch.table(_factor(_moments(near.join(edge, keys).filter("bin <= edge"), keys), FACTOR_H), f"step{step}")
    best = stats.groupBy(*_GROUP).agg(F.min(F.struct("logdet", "start")).alias("b")).select(*_GROUP, F.col("b.start").alias("start"))
    stats = stats.join(best, keys).drop("start")
    inside = _with_distance(rows, stats, _GROUP).filter(F.col("d2") <= CHI_975).select(*_GROUP, *_X)
    return scratch.table(_factor(_moments(inside, _GROUP), FACTOR_W), "final")


def _pools(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Per (lang, source) the key of the estimate that judges it (jlang, jsource), and the keys that its rows go into.

    Groups under LEAST rows are judged by their language, languages under LEAST rows by all rows;
    keys of values start with "=", so a pool's "*" is none of them.
    """
    sizes = scratch.table(rows.groupBy(*_GROUP).agg(F.count("*").alias("n")), "groups")
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("all"), F.min("n").alias("low"))
    few = langs.agg((F.min("all") < LEAST).alias("few"))
    key = lambda x, y: F.struct(x.alias("jlang"), y.alias("jsource"))
    lang, source, pool = F.concat(F.lit("="), "lang"), F.concat(F.lit("="), "source"), F.lit("*")
    own, language, whole = F.col("n") >= LEAST, F.col("all") >= LEAST, key(pool, pool)
    to = F.when(own, key(lang, source)).when(language, key(lang, pool)).otherwise(whole)
    into = F.array_compact(F.array(F.when(own, key(lang, source)), F.when(language & (F.col("low") < LEAST), key(lang, pool)), F.when(F.col("few"), whole)))
    return scratch.table(sizes.join(langs, "lang").crossJoin(few).select(*_GROUP, to.alias("to"), into.alias("into")).select(*_GROUP, "to.jlang", "to.jsource", "into"), "pools")


def judge(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document; lang and source null are groups of their own.

    Base failures are rejected and take no part in the estimates; groups with under LEAST
    other rows are judged by their language's estimate or that of all rows, and by the base
    alone if all rows are under LEAST. Repeated rows count as often as they come; an empty
    table gives no rows.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = scratch.table(statistics(docs).withColumn("base_failed", failed).select("*", *[x.alias(n) for x, n in zip(_features(), _X)]), "base")
    fine = base.filter("not base_failed").select(*_GROUP, *_X)
    pools = _pools(fine, scratch)
    dealt = fine.join(pools, _GROUP).select(F.explode("into").alias("k"), *_X).select(F.col("k.jlang").alias("lang"), F.col("k.jsource").alias("source"), *_X)
    stats = estimates(dealt, scratch).withColumnRenamed("lang", "jlang").withColumnRenamed("source", "jsource")
    keyed = base.join(pools.drop("into"), _GROUP, "left")
    near = _with_distance(keyed, stats.select("jlang", "jsource", *[f"m{k}" for k in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS]), ["jlang", "jsource"], "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return near.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")


def op8(spark, docs: DataFrame) -> DataFrame:
    """One row per document: its statistics, base_failed, kept and the squared distance d2 (null without an
    estimate); cases as in judge. A very long text is one row's arrays of words and windows, in one task."""
    return judge(docs, Scratch(spark, "op8"))
