"""Removal of repeated byte strings by sorting suffixes, spread over a cluster.

Every 200-byte string belongs to the smallest 32-byte gram it holds (by a hash, the leftmost of equals). Equal strings therefore
belong to equal grams, at the same place inside them, so suffixes need sorting only among strings of one gram. Neighbouring
strings of one gram form a segment of, on average, 85 suffixes and the bytes they read.

1. Each document is cut into segments; only (gram, document, place) is written.
2. Segments whose gram occurs once go. The text is read again for the others, and equal segments are counted before
   they move.
3. An equal segment elsewhere repeats all its strings. Other segments of a gram are sorted by suffix, deep-shallow, many grams
   at once in bounded batches; suffixes with 200 equal bytes are repeats.
4. A gram with more than ``WIDE`` different segments is not brought to one task: its suffixes are counted by a 128-bit digest of their
   200 bytes, combined before they move.
5. Runs of repeated strings go back to their documents, which lose the bytes they cover.

A document is known by its id and a hash of its text; the hash of a text and of a segment has 64 bits and acts only together with the id or
the gram.

Defined results: null counts as empty; texts shorter than 200 bytes keep every byte; two rows that are alike are two
documents that repeat one another; long texts are cut in slices; an empty table gives an empty result; extra columns are ignored;
a null id is an id like others. ``kept`` may end inside a character, so it is binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import documents, staged, text_of
from tallyguard.llm.suffix_sort import equal_classes
from tallyguard.llm.textnp import _LETTERS, _upto, mix

LENGTH, GRAM = 200, 32
SLICE = 1 << 19  # strings cut at once
WIDE = 20_000  # different segments of one gram that one task may sort
BATCH_BYTES = 1 << 21


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM, step: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram's hash, first string, number of strings) of each segment, in order."""
    keys, starts, counts = [], [], []
    for at in range(0, len(data) - length + 1, step):
        arr = np.frombuffer(data, np.uint8, min(step + length - 1, len(data) - at), at)
        n = len(arr)
        up, down = _upto(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[arr] * up[:n], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        # the place in the low bits: the smallest gram, leftmost of equals
        low = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        span, width = length - gram + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width:])
        owner = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        keys.append(grams[owner[first]].view(np.int64))
        starts.append(first + at)
        counts.append(np.diff(np.r_[first, len(owner)]))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


PLACE = "id bigint, mark bigint, key bigint, start bigint, n int"


def _cut(batches):
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for i, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            key, start, n = segments(text.as_py())
            for col, value in zip(cols, ([i] * len(key), np.full(len(key), mark), key, start, n.astype(np.int32))):
                col.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        arrays = [pa.array([x for part in cols[0] for x in part], types[0])]
        arrays += [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), t) for c, t in zip(cols[1:], types[1:])]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "key", "start", "n"])


def _read(batches):
    """The bytes of the wanted segments of each document."""
    for batch in batches:
        out: dict[str, list] = {x: [] for x in ("id", "mark", "key", "start", "n", "data")}
        size = 0
        for row in range(batch.num_rows):
            i, mark, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
            wanted = batch.column(3)[row].as_py()
            for key, start, n in {(w["key"], w["start"], w["n"]) for w in wanted}:
                part = data[start:start + n + LENGTH - 1]
                size += len(part)
                for col, value in zip(out.values(), (i, mark, key, start, n, part)):
                    col.append(value)
            if size > 1 << 24:
                yield _segment_batch(out)
                out, size = {x: [] for x in out}, 0
        yield _segment_batch(out)


def _segment_batch(out: dict) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


RUNS = "key bigint, seg bigint, lo int, hi int"


def _run_batch(key, seg, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(seg, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                                      names=["key", "seg", "lo", "hi"])


def _sort_groups(keys: list, segs: list, times: list, data: list) -> pa.RecordBatch:
    """Runs of repeated strings of each segment, of several whole groups."""
    n = np.array([len(d) - LENGTH + 1 for d in data])
    key, many = np.array(keys, np.int64), np.array(times) > 1
    size = np.array([len(d) for d in data])
    base = np.cumsum(size) - size
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    sole = np.bincount(group)[group] == 1
    work = np.flatnonzero(~sole)  # a segment alone with its gram has no strings to compare with
    total = int(n[work].sum())
    owner = np.repeat(work, n[work])
    inner = np.arange(total) - np.repeat(np.cumsum(n[work]) - n[work], n[work])
    buffer = np.frombuffer(b"".join(data), np.uint8)
    hit = equal_classes(buffer, base[owner] + inner, group[owner], LENGTH) >= 0
    # a string of a segment that occurs more than once is a repeat, and so is all of that segment
    once = ~many[owner]
    owner, inner = owner[hit & once], inner[hit & once]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)] if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(owner)] - 1 if len(first) else first
    whole = np.flatnonzero(many)
    seg = np.array(segs, np.int64)
    return _run_batch(np.r_[key[whole], key[owner[first]]], np.r_[seg[whole], seg[owner[first]]],
                      np.r_[np.zeros(len(whole), np.int64), inner[first]], np.r_[n[whole], inner[last] + 1])


def _sort(batches):
    """Rows come ordered by key; whole groups are sorted together until a batch is full."""
    held: list[list] = [[], [], [], []]
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if size > BATCH_BYTES and row[0] != held[0][-1]:
                yield _sort_groups(*held)
                held, size = [[], [], [], []], 0
            for col, value in zip(held, row):
                col.append(value)
            size += len(row[3])
    if held[0]:
        yield _sort_groups(*held)


def _strings(batches):
    """Each string of a segment by its digest."""
    for batch in batches:
        for key, seg, times, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            n = len(data) - LENGTH + 1
            digests = [hashlib.blake2b(data[i:i + LENGTH], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array([times] * n, pa.int64()), pa.array(range(n), pa.int32()),
                 pa.array(digests, pa.binary())], names=["key", "seg", "times", "at", "digest"])


def repeats(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """(id, mark, lo, hi): the strings that begin at lo, ..., hi - 1 are repeated. ``docs`` has id, mark and data."""
    c = F.col
    places = staged(docs.select("id", "mark", "data").mapInArrow(_cut, PLACE))
    # a table of its own, so a hot gram's places can be split in the join
    common = staged(places.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"))
    wanted = places.join(common, "key", "left_semi").groupBy("id", "mark").agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted"))
    found = docs.alias("d").join(wanted.alias("w"), c("d.id").eqNullSafe(c("w.id")) & (c("d.mark") == c("w.mark")))
    parts = staged(found.select("d.id", "d.mark", "d.data", "w.wanted").mapInArrow(_read, PLACE + ", data binary").withColumn("seg", F.xxhash64("data")))
    distinct = staged(parts.groupBy("key", "seg", "data").agg(F.count(F.lit(1)).alias("times")).select("key", "seg", "times", "data"))
    many = staged(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > wide).select("key"))
    narrow = distinct.join(many, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_sort, RUNS)
    broad = distinct.join(many, "key", "left_semi").mapInArrow(_strings, "key bigint, seg bigint, times bigint, at int, digest binary")
    again = broad.groupBy("key", "digest").agg(F.sum("times").alias("all")).filter(c("all") > 1).select("key", "digest")
    single = broad.join(again, ["key", "digest"], "left_semi").select("key", "seg", c("at").alias("lo"), (c("at") + 1).alias("hi"))
    runs = staged(narrow.unionByName(single))
    return parts.select("id", "mark", "key", "seg", "start").join(runs, ["key", "seg"]).select(
        "id", "mark", (c("start") + c("lo")).alias("lo"), (c("start") + c("hi")).alias("hi"))


def covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the strings that begin in the given runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        end = hi - 1 + LENGTH
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((lo, end))
    return out


def _remove(with_kept: bool):
    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for data, runs in zip(batch.column(1), batch.column(2)):
                data = data.as_py()
                spans = covered([(r["lo"], r["hi"]) for r in runs.as_py() or ()])
                rest, at = [], 0
                for lo, hi in spans:
                    rest.append(data[at:lo])
                    at = hi
                rest = b"".join([*rest, data[at:]])
                for col, value in zip((n_bytes, n_removed, n_spans, sha, kept), (len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest)):
                    col.append(value)
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(sha, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE, with_kept: bool = True) -> DataFrame:
    """One row per document: id, bytes, removed bytes, removed runs, digest of what is left and, if asked for, what is left."""
    c = F.col
    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), text_of(docs, text).alias("text")).select(
        "id", F.xxhash64("text").alias("mark"), c("text").cast("binary").alias("data"))
    runs = staged(repeats(rows, wide).distinct()).groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    joined = rows.alias("d").join(runs.alias("r"), c("d.id").eqNullSafe(c("r.id")) & (c("d.mark") == c("r.mark")), "left")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return joined.select("d.id", "d.data", "r.runs").mapInArrow(_remove(with_kept), schema).withColumnRenamed("id", doc_id)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_kept=False)


# texts as hex digits, two for each byte; a string that starts twice marks its 200 bytes, and marks that touch are one span
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
cut AS (SELECT doc_id, p, substr(h, 2 * p + 1, 798) AS part FROM (SELECT doc_id, h, unnest(range(0, n - 199, 200)) AS p FROM d)),
w AS (SELECT doc_id, p + j AS i, sha256(substr(part, 2 * j + 1, 400)) AS g
  FROM (SELECT doc_id, p, part, unnest(range(0, least(200, length(part) // 2 - 199))) AS j FROM cut)),
hit AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN span ON d.doc_id = span.doc_id GROUP BY d.doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS t FROM gap JOIN d ON gap.doc_id = d.doc_id GROUP BY gap.doc_id),
total AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, cast(n AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, cast(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN total ON d.doc_id = total.doc_id
"""
