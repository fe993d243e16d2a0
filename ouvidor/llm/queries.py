"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers

from ouvidor.llm import bpe, chat, classifier, counts, lm, packing, rules, simhash, sketch, suffix
from ouvidor.llm.common import documents


def op1_bpe(spark, sf_dir):
    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_suffix(spark, sf_dir):
    return suffix.removals(documents(spark, sf_dir))


def op4_chat(spark, sf_dir):
    return chat.preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_counts(spark, sf_dir):
    return counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_classifier(spark, sf_dir):
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_rules(spark, sf_dir):
    return rules.judge(documents(spark, sf_dir))


def op9_sketch(spark, sf_dir):
    return sketch.fingerprints(documents(spark, sf_dir))


def op10_lm(spark, sf_dir):
    return lm.score(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_suffix, op4_chat, op5_counts, op6_classifier, op7_simhash, op8_rules, op9_sketch, op10_lm)}
ORACLES = {"op4_chat": chat.ORACLE}
