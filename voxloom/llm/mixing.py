"""Mixing sources to target weights by hierarchical budgeting, with Spark expressions only.

The token budget runs down the tree domain - language - source. Each node's budget is shared
among its children by weight, none getting more than its subtree can supply; what a child
cannot use goes to its siblings first, and only what no sibling can use has been left to the
node's own siblings. A leaf fills its budget with whole epochs and the prefix of one more, in
an order seeded by epoch; the prefix is given by the greatest order key that still fits, so
documents are chosen by a comparison and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import Scratch, plain

LEVELS = ("domain", "lang", "source")
SEED = 11
MAX_EPOCHS = 2
#: Lengths of the order key's prefixes (hexadecimal digits) on the way to the last document.
PREFIXES = (2, 4)
BUDGET_SHARE = 1.0
#: Target weights; other languages get OTHER, all domains and sources the same.
LANGUAGES = {"en": 50.0, "de": 20.0, "fr": 15.0, "es": 15.0}
OTHER = 5.0


def with_leaf(docs: DataFrame) -> DataFrame:
    """Adds the leaf's columns (nulls are empty) and n_tokens, the whitespace-separated words of the whole text."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.when(source.rlike("[0-2]$"), "reference").when(source.rlike("[3-5]$"), "books").otherwise("web")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return docs.withColumns({"__domain": domain, "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__source": source, "__tokens": F.size(words).cast("long")})


def weight(level: str) -> Column:
    if level != "lang":
        return F.lit(1.0)
    w = F.lit(OTHER)
    for k, v in LANGUAGES.items():
        w = F.when(F.col("__lang") == k, v).otherwise(w)
    return w


_KEYS = [f"__{x}" for x in LEVELS]


def budgets(leaves: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """leaves (keys, tokens) -> the same with budget: tokens to draw from the leaf."""
    leaves = leaves.withColumn("supply", F.col("tokens") * float(max_epochs))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * share).alias("parent_budget"))
    above = None
    for depth, level in enumerate(LEVELS):
        keys, parent = _KEYS[: depth + 1], _KEYS[:depth]
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply")).filter("supply > 0").withColumn("w", weight(level))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(total))  # total is one row
        order = W.partitionBy(*parent).orderBy(F.col("supply") / F.col("w"), keys[-1])
        upto = F.sum("supply").over(order.rowsBetween(W.unboundedPreceding, 0))
        rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
        nodes = nodes.withColumn("full", upto - F.col("supply") + F.col("supply") / F.col("w") * rest <= F.col("parent_budget"))
        group = W.partitionBy(*parent)
        used = F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(group), F.lit(0.0))
        open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
        nodes = nodes.withColumn("budget", F.when(F.col("full"), F.col("supply")).otherwise((F.col("parent_budget") - used) / open_ * F.col("w")))
        above = nodes.select(*keys, F.col("budget").alias("parent_budget"))
    return leaves.join(above.withColumnRenamed("parent_budget", "budget"), _KEYS)


def order_key(epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def select(docs: DataFrame, scratch: Scratch, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with all its columns (but those named with two underscores), one row for each time a document is drawn, plus __tokens and __epoch (from 0).

    Documents without words supply nothing and are drawn in whole epochs only; equal rows have
    equal order keys and are drawn together; an empty table gives no rows.
    """
    docs = plain(docs)
    sizes = scratch.table(with_leaf(docs).select("doc_id", *_KEYS, "__tokens"), "sizes")
    leaves = sizes.groupBy(*_KEYS).agg(F.sum("__tokens").alias("tokens"))
    plan = budgets(leaves, share, max_epochs).withColumn("budget", F.floor(F.col("budget") + 1e-6))
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = scratch.table(plan.select(*_KEYS, "whole", "rest"), "plan")
    keyed = sizes.join(plan, _KEYS).withColumn("key", order_key(F.col("whole"))).select(*_KEYS, "__tokens", "rest", "key")
    crossing = plan.select(*_KEYS, F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for depth in PREFIXES:  # down to the bucket of keys in which the budget runs out; a leaf has few buckets at any size
        inside = keyed.join(crossing, _KEYS).filter(F.col("key").startswith(F.col("prefix")))
        buckets = inside.groupBy(*_KEYS, "rest", "before", F.substring("key", 1, depth).alias("bucket")).agg(F.sum("__tokens").alias("n"))
        before = F.col("before") + F.sum("n").over(W.partitionBy(*_KEYS).orderBy("bucket")) - F.col("n")
        edge = buckets.withColumn("before", before).filter("before <= rest and before + n > rest")
        crossing = scratch.table(edge.select(*_KEYS, F.col("bucket").alias("prefix"), "before"), f"crossing{depth}")  # one row a leaf
    within = keyed.join(crossing, _KEYS).filter(F.col("key").startswith(F.col("prefix")))
    upto = F.sum("__tokens").over(W.partitionBy(*_KEYS).orderBy("key").rangeBetween(W.unboundedPreceding, 0)) + F.col("before")
    last = within.withColumn("upto", upto).filter("upto <= rest").groupBy(*_KEYS).agg(F.max("key").alias("last"))
    cut = plan.join(crossing, _KEYS, "left").join(last, _KEYS, "left").select(*_KEYS, F.col("whole").alias("__whole"), F.coalesce("last", "prefix", F.lit("")).alias("__last"))
    cut = scratch.table(cut, "cut")
    drawn = with_leaf(docs).join(cut, _KEYS)
    times = F.col("__whole") + F.when((F.col("__tokens") > 0) & (order_key(F.col("__whole")) <= F.col("__last")), 1).otherwise(0)
    drawn = drawn.withColumn("__times", times.cast("int")).filter("__times > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns], "__tokens", "__epoch")


def op6(spark, docs: DataFrame) -> DataFrame:
    out = select(docs.select("doc_id", "text", "lang", "source"), Scratch(spark, "op6"))
    return out.select("doc_id", "lang", "source", F.col("__epoch").cast("int").alias("epoch"), F.col("__tokens").alias("n_tokens"))


def _sql() -> str:
    levels = []
    for depth, level in enumerate(LEVELS):
        keys, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent} " if parent else ""
        w = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LANGUAGES.items()) + f" ELSE {OTHER}::DOUBLE END" if level == "lang" else "1::DOUBLE"
        join = f"JOIN (SELECT {parent}, budget AS parent_budget FROM b{depth - 1}) USING ({parent})" if parent else f"CROSS JOIN (SELECT sum(tokens) * {BUDGET_SHARE}::DOUBLE AS parent_budget FROM leaf)"
        levels.append(f"""
n{depth} AS (SELECT * FROM (SELECT {keys}, sum(supply) AS supply, {w} AS w FROM leaf GROUP BY {keys}) {join} WHERE supply > 0),
f{depth} AS (SELECT *, sum(supply) OVER ({by}ORDER BY supply / w, {level} ROWS UNBOUNDED PRECEDING) - supply
    + supply / w * sum(w) OVER ({by}ORDER BY supply / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= parent_budget AS filled FROM n{depth}),
b{depth} AS (SELECT *, CASE WHEN filled THEN supply ELSE (parent_budget - coalesce(sum(supply) FILTER (WHERE filled) OVER ({by}), 0)) / sum(w) FILTER (WHERE NOT filled) OVER ({by}) * w END AS budget FROM f{depth})""")
    return (
        rf"""
WITH d AS (SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN regexp_matches(coalesce(source, ''), '[0-2]$') THEN 'reference' WHEN regexp_matches(coalesce(source, ''), '[3-5]$') THEN 'books' ELSE 'web' END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MAX_EPOCHS}::DOUBLE AS supply FROM d GROUP BY ALL),"""
        + ",".join(levels)
        + rf""",
plan AS (SELECT domain, lang, source, floor(floor(budget + 1e-6) / tokens) AS whole, floor(budget + 1e-6) - floor(floor(budget + 1e-6) / tokens) * tokens AS rest FROM leaf JOIN (SELECT domain, lang, source, budget FROM b2) USING (domain, lang, source)),
o AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || CAST(whole AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN plan USING (domain, lang, source)),
t AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN upto <= rest AND n_tokens > 0 THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, lang0 AS lang, source0 AS source, CAST(unnest(range(times)) AS INTEGER) AS epoch, n_tokens FROM t
"""
    )


OP6_SQL = _sql()
