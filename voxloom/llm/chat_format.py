"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text); array
aggregation merges adjacent turns of one role into a message, in which a mark keeps each turn
apart, and the messages are concatenated. Control strings all start with "<"; inside roles and
texts "\\", "<" and ">" are escaped, so nothing a turn says can be taken for one. The loss mask
is a list of spans (start, length in code points), one for each assistant turn.

A conversation is built in stretches of turn numbers first, and the stretches are joined then,
so one with very many turns is spread over tasks until its parts meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<msg role=", "</msg>\n", "<+>"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))
LOSS_ROLE = "assistant"
STRETCH = 256
BLOCK = 1 << 16


def escape(x: Column) -> Column:
    for raw, code in ESCAPES:
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def _append(array: Column, x: Column) -> Column:
    return F.concat(array, F.array(x))


def merged(turns: Column) -> Column:
    """Sorted turns (.., role, text) -> messages (role, texts): adjacent turns of one role are one message."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(acc, x):
        last, own = F.get(acc, F.size(acc) - 1), F.array(x["text"])
        longer = F.struct(x["role"].alias("role"), F.concat(last["texts"], own).alias("texts"))
        return F.when(F.coalesce(last["role"] == x["role"], F.lit(False)), _append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(_append(acc, F.struct(x["role"].alias("role"), own.alias("texts"))))

    return F.aggregate(turns, none, step)


def _start(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(">"))


def _spans(pieces: Column) -> Column:
    """(gap, len, loss) of all turns in order -> start and length of those with loss."""
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"))

    def step(acc, x):
        at = acc["to"] + x["gap"]
        spans = F.when(x["loss"], _append(acc["spans"], F.struct(at.alias("start"), x["len"].alias("len")))).otherwise(acc["spans"])
        return F.struct((at + x["len"]).alias("to"), spans.alias("spans"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, formatted, loss_spans array<struct<start, len>>).

    Null texts and roles are empty; null turn numbers come first; ties are ordered by role and
    text; repeated rows are turns of their own; very long texts are copied by reference until they
    are joined; rows without conv_id are one conversation; an empty table gives no rows.
    """
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = said.groupBy("conv_id", F.floor(F.col("turn") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    shown = lambda m: F.struct(escape(m["role"]).alias("role"), (m["role"] == LOSS_ROLE).alias("loss"), F.transform(m["texts"], escape).alias("texts"))
    parts = parts.select("conv_id", "stretch", F.transform(merged(F.col("turns")), shown).alias("m"))
    between = lambda m, k: F.when(k > 0, F.concat(F.lit(CLOSE), _start(m["role"]))).otherwise("")

    def pieces(m, k):
        gap = lambda j: F.when(j > 0, F.lit(len(NEXT))).otherwise(F.char_length(between(m, k))).cast("long")
        return F.transform(m["texts"], lambda t, j: F.struct(gap(j).alias("gap"), F.char_length(t).cast("long").alias("len"), m["loss"].alias("loss")))

    stretches = parts.select(
        "conv_id",
        "stretch",
        F.array_join(F.transform("m", lambda m, k: F.concat(between(m, k), F.array_join(m["texts"], NEXT))), "").alias("s"),
        F.element_at("m", 1)["role"].alias("first"),
        F.element_at("m", -1)["role"].alias("last"),
        _spans(F.flatten(F.transform("m", pieces))).alias("spans"),
    )
    whole = stretches.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "s", "first", "last", "spans"))).alias("p"))

    def joint(x, k):
        before = F.get(F.col("p"), k - 1)["last"]
        return F.when(k == 0, _start(x["first"])).when(before == x["first"], F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), _start(x["first"])))

    whole = whole.select("conv_id", "p", F.transform("p", joint).alias("joints"))
    size = lambda x, k: F.char_length(F.get(F.col("joints"), k)) + F.char_length(x["s"])
    ends = F.aggregate(F.transform("p", size), F.array().cast("array<bigint>"), lambda acc, n: _append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n))
    whole = whole.select("conv_id", "p", "joints", ends.alias("ends"))
    shift = lambda base: lambda x: F.struct((x["start"] + base).alias("start"), x["len"].alias("len"))
    return whole.select(
        "conv_id",
        F.concat(F.array_join(F.transform("p", lambda x, k: F.concat(F.get(F.col("joints"), k), x["s"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten(F.transform("p", lambda x, k: F.transform(x["spans"], shift(F.get(F.col("ends"), k) - F.char_length(x["s"]))))).alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    messages = F.filter(F.split(formatted, OPEN, -1), lambda m: m != "")

    def one(m):
        role = F.substring_index(m, ">", 1)
        body = F.substring_index(F.substring(m, F.char_length(role) + 2, F.char_length(m)), "</msg>", 1)
        return F.transform(F.split(body, r"<\+>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, one))


def loss_text(blocks: Column, spans: Column) -> Column:
    """The text under the mask, unescaped; blocks are the conversation cut every BLOCK code points."""

    def one(s):
        first, last = F.floor(s["start"] / BLOCK), F.floor((s["start"] + s["len"]) / BLOCK)
        near = F.array_join(F.slice(blocks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescape(F.substring(near, (s["start"] - first * BLOCK + 1).cast("int"), s["len"].cast("int")))

    return F.array_join(F.transform(spans, one), "")


def op7(spark, turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted text, and the probe conversation -7;
    cases as in format_chats. A conversation is one value in the end: one of gigabytes can't be made."""
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = format_chats(rows)
    size = F.char_length("formatted")
    cut = F.transform(F.sequence(F.lit(0), F.floor(size / BLOCK).cast("int")), lambda k: F.substring(F.col("formatted"), k * BLOCK + 1, F.lit(BLOCK)))
    out = out.select("conv_id", "formatted", "loss_spans", cut.alias("blocks"), turns_of(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), loss_text(F.col("blocks"), F.col("loss_spans")).alias("loss"), size.cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') AS seg,
    replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS who,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(seg) + CASE WHEN before IS NULL THEN 11 + length(who) WHEN before = role THEN 3 ELSE 18 + length(who) END) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
