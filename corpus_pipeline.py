"""The corpus pipeline: its stages in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from functools import partial

from cairn.llm import stages
from cairn.llm.common import staged, table

STAGES = [
    ("language_id", stages.language),
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", partial(stages.near_duplicates, percent=80)),
    ("pii", stages.personal_data),
    ("packing", stages.packed),
]

#: Iterative estimates and hashed signatures are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
