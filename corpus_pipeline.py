"""The corpus pipeline: quality rules, exact dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's documents. All but the
last return the columns of ``documents``; the last returns one row per piece with its place in a sequence.

* quality: rejected documents go; failing lines of the others go from their text.
* exact: of equal texts the row with the largest id stays.
* near: of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.
* secrets: every span found is replaced by a mark; no document goes.
* packing: the remaining texts become sequences of at most 4096 tokens.

Defined results: a null or empty text has too few words and goes in the first stage; texts of any length are handled whole; rows that repeat
an id are rows of their own, and of equal ones one stays; a null id is carried through; empty documents give no rows; further columns are
kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.common import documents, staged
from tallyguard.llm.exact_dedup import drop_copies
from tallyguard.llm.near_dedup import one_of_each
from tallyguard.llm.packing import pack_documents
from tallyguard.llm.quality_rules import clean_documents
from tallyguard.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]
# tokenizing, MinHash and lexing have no SQL form; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
