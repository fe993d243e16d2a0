"""The corpus pipeline: quality classifier, quality rules, near-duplicate removal, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and is judged on its own input; all but the last return the columns of
``documents``, and whatever further ones ``docs`` has, names of result columns among them. A null text counts as
empty, and what the classifier and the rules make of an empty text decides over it; rows that repeat an id are documents of their own, of whole copies one is
left by the third stage. An empty table gives no rows at any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ouvidor.llm import classifier, packing, rules, simhash, suffix
from ouvidor.llm.common import drop_table, materialise


def classify(spark, docs, sf_dir):
    """Documents that the classifier of operator 6 rejects go."""
    return classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def weak_rules(spark, docs, sf_dir):
    """Documents that the rules of operator 8 reject go; votes are counted over this stage's input."""
    return rules.keep(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of operator 7 stays, the one with the smallest doc_id; one without an id where the group has none."""
    return simhash.keep_one(docs)


def repeats(spark, docs, sf_dir):
    """Bytes that operator 3 finds repeated leave the texts, at every place; all documents stay, n_chars follows, a null text stays null."""
    return suffix.cut(docs)


def pack(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens by operator 2: the rows of op2's contract."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", classify), ("quality rules", weak_rules), ("near duplicates", near_duplicates), ("suffix-array dedup", repeats), ("packing", pack)]

#: Two stages are learned from the data and two hash whole texts: not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other, each written to the shared scratch folder and read again; its input's table goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
        if i:
            drop_table(before)  # packing has read it too: it writes its pieces before it returns
    return docs
