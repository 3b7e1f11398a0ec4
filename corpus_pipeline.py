"""Corpus pipeline: stages over `documents`, each written as Parquet and reread by the next."""

from __future__ import annotations

from tokenwright.llm.common import stored, table
from tokenwright.llm.exact_dedup import drop_copies
from tokenwright.llm.minhash import drop_near
from tokenwright.llm.packing import pack
from tokenwright.llm.suffix import cut_repeats
from tokenwright.llm.toxicity import reject_toxic


def toxic(spark, docs, sf_dir):
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark, docs, sf_dir):
    return drop_copies(docs)


def near(spark, docs, sf_dir):
    return drop_near(docs)


def repeats(spark, docs, sf_dir):
    return cut_repeats(docs)


def packing(spark, docs, sf_dir):
    return pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packing),
]
# learned scores, approximate search, suffix structures and local search: tested against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
