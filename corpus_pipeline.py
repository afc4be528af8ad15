"""The corpus pipeline: quality rules, SimHash near-dedup, sanitisation, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet into the shared folder and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from grove.llm import packing, pii, quality, simhash
from grove.llm.common import fresh_path, table
from grove.plans.storage import discard


def quality_rules(spark, docs, sf_dir):
    """Failing lines go, and the documents that the rules reject; a boilerplate phrase fails short lines only."""
    return quality.clean(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def sanitised(spark, docs, sf_dir):
    """Personal data and the terms that disclose it are masked, generalised or removed; every document stays."""
    return pii.sanitise(docs)


def packed(spark, docs, sf_dir):
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("PII", sanitised), ("packing", packed)]

#: SQL has neither the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)  # written out whole, the next stage needs it no more
        last = path
    return docs
