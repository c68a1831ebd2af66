"""Exact duplicates by naming blocks: equal texts, and only they, end with the same name.

A text (A-Z lower-cased, as UTF-8) is cut into blocks of fixed size. Distinct blocks are sorted and numbered; then
neighbouring numbers are paired, distinct pairs are sorted and numbered, until each document has one number. Numbers stand for
content that was compared in full, so they cannot collide; the pair (rounds, number) is a document's identity.

Each naming is a distinct (combined before its shuffle), a sort inside the partitions of that shuffle, and a join back.
Equal blocks of one batch travel as one row with all their places, so a hot block is combined before it moves, and a hot pair's
rows are split by the optimiser. The number of rounds is the logarithm
of the longest text, and each round halves the rows and leaves out finished documents.

Defined results: null counts as the empty text, and all empty texts are equal; the row with the largest id stays, a null id
being the smallest, and of rows that share that id exactly one stays; long texts take more rounds; an empty table gives an
empty result; extra columns are ignored by ``exact_dedup`` and kept by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import documents, staged, text_of

BLOCK = 4096  # bytes


MEMBERS = "array<struct<_rid: bigint, _id: bigint, _sha: string, _n: bigint, _pos: bigint>>"


def _cut(block: int):
    """Equal blocks of one batch become one row with all their places, so a hot block travels once per batch."""
    def run(batches):
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for rid, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                low = text.as_py().lower()  # of bytes: A-Z only
                sha, n = hashlib.sha256(low).hexdigest(), max(1, -(-len(low) // block))
                for pos in range(n):
                    held.setdefault(low[pos * block:(pos + 1) * block], []).append(
                        {"_rid": rid, "_id": key, "_sha": sha if pos == 0 else None, "_n": n, "_pos": pos})
                size += len(low)
                if size > 1 << 24:
                    yield _batch(held)
                    held, size = {}, 0
        if held:
            yield _batch(held)
    return run


def _batch(held: dict[bytes, list]) -> pa.RecordBatch:
    member = pa.struct([("_rid", pa.int64()), ("_id", pa.int64()), ("_sha", pa.string()), ("_n", pa.int64()), ("_pos", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(member))], names=["_block", "_members"])


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct keys with their number in the order of the keys."""
    return rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id() + 1)


def identities(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_rid, _id, _sha, _level, _name) for rows of (_rid, _id, _text): equal texts share level and name."""
    c = F.col
    blocks = rows.select("_rid", c("_id").cast("bigint").alias("_id"), c("_text").cast("binary").alias("_text")).mapInArrow(
        _cut(block), f"_block binary, _members {MEMBERS}")
    level = staged(blocks.join(numbered(blocks, ["_block"], "_name"), "_block").select(F.inline("_members"), "_name"))
    done, at = [], 0
    while True:
        done.append(level.filter("_n = 1").select("_rid", "_id", "_sha", F.lit(at).alias("_level"), "_name"))
        rest = level.filter("_n > 1")
        if rest.isEmpty():
            break
        # 0 stands for "no right neighbour"; numbers start at 1
        pairs = rest.groupBy("_rid", F.expr("_pos div 2").alias("_pos")).agg(
            F.max("_id").alias("_id"), F.max("_sha").alias("_sha"), F.max(F.expr("(_n + 1) div 2")).alias("_n"),
            F.max(F.when(c("_pos") % 2 == 0, c("_name"))).alias("_a"), F.coalesce(F.max(F.when(c("_pos") % 2 == 1, c("_name"))), F.lit(0)).alias("_b"))
        pairs = staged(pairs)
        numbers = staged(numbered(pairs, ["_a", "_b"], "_name"))  # a table of its own, so a hot pair's rows can be split in the join
        level, at = staged(pairs.join(numbers, ["_a", "_b"]).drop("_a", "_b")), at + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def grouped(ids: DataFrame) -> DataFrame:
    """Adds group_size, keep_id and kept to the identities."""
    c = F.col
    groups = ids.groupBy("_level", "_name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_id", "_rid")).alias("_keep"))
    return ids.join(groups, ["_level", "_name"]).withColumns({"keep_id": c("_keep._id"), "kept": c("_keep._rid") == c("_rid")})


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, id of the row that stays, size of the group, whether this row stays, SHA-256."""
    # the row number is made where the row is read and used once, so a repeated task makes it again
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), docs[doc_id].alias("_id"), text_of(docs, text).alias("_text"))
    found = grouped(identities(rows, block))
    return found.select(F.col("_id").alias(doc_id), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows that stay, with all their columns."""
    whole = staged(docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*[docs[x] for x in docs.columns]).alias("_row")))
    rows = whole.select("_rid", F.col("_row")[doc_id].alias("_id"), F.coalesce(F.col("_row")[text].cast("string"), F.lit("")).alias("_text"))
    keep = grouped(identities(rows, block)).filter("kept").select("_rid")
    return whole.join(keep, "_rid", "left_semi").select("_row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
