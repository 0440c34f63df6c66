"""One query for each operator of this subpackage; oracle SQL where SQL can express it."""

from __future__ import annotations

from . import chat_format, embedding_dedup, line_dedup, lm_scoring, mixing, packing, quality_rules, simhash_dedup, token_output, toxicity
from .util import read


def op1_token_output(spark, sf_dir):
    return token_output.op1(spark, read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.op2(spark, read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark, sf_dir):
    return toxicity.op3(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.op4(spark, read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.op5(spark, read(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.op6(spark, read(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    return chat_format.op7(spark, read(spark, sf_dir, "conversations"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.op8(spark, read(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    return lm_scoring.op9(spark, read(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark, sf_dir):
    return simhash_dedup.op10(spark, read(spark, sf_dir, "documents"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql():
    return {"op6_mixing": mixing.OP6_SQL, "op7_chat_format": chat_format.OP7_SQL}
