"""Scoring with a hashed maximum-entropy model: the probability of a word given its history, factored along a tree of classes.

Each word has a path of ``LEVELS`` choices among ``WAYS``. The first ``CLASS_LEVELS`` of them name its class, a hash of its first three
bytes (the end of a text is a class of its own); the others part the words of the class by a hash of the whole word. Every choice is a
softmax over hashed features of the history, taken together with the node where the choice is made: the node alone, the word
before, the two words before, and the word before that one alone (a skip). So history speaks to the class and to the word in
it. Words with one path (``LEAVES`` in all) are told apart by their smoothed relative frequency there.

Training counts every word of every training document. The softmaxes start from the nodes' frequencies; each task then makes
gradient updates (AdaGrad, mini-batches) over its own documents and returns the rows it changed, and the rows are averaged by their
use, in Spark. The weights have a fixed size (``LEVELS`` x ``TABLE`` x ``WAYS``), so they are broadcast. Scoring looks the ``FREQUENT`` most
frequent words up in a broadcast table of that bounded size; all other words are counted per document and joined with their
counts, and none of them can be hot.

Defined results: null counts as empty, and an empty text is one end; a null id counts as the id with empty text (a training document);
equal rows are scored as so many documents; without training documents every probability of the base is 1; an empty table gives
an empty result; long texts are scored whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import documents, staged, text_of
from tallyguard.llm.textnp import hashes_and_heads, mix

LEVELS, CLASS_LEVELS, BITS = 4, 2, 3
WAYS, LEAVES, CLASSES = 1 << BITS, 1 << BITS * LEVELS, 1 << BITS * CLASS_LEVELS
BUCKETS, FREQUENT = 1 << 15, 100_000
TABLE = BUCKETS + (1 << BITS * (LEVELS - 1))  # rows of a level: hashed features, then one row for each node
BATCH, RATE, BLOCK_WORDS, COUNTED = 4096, 0.25, 65_536, 300_000
STEEPEST, ONES = np.float32(40), np.ones(WAYS, np.float32)
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def leaves_of(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The paths of words as numbers; class 0 is the end's."""
    classes = 1 + (mix(heads) % np.uint64(CLASSES - 1)).astype(np.int64)
    within = BITS * (LEVELS - CLASS_LEVELS)
    return (classes << within) + (mix(hashes) >> np.uint64(64 - within)).astype(np.int64)


def features(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Three hashes of each token's history, one row each. ``starts`` holds the first token of each text."""
    one, two = np.empty_like(hashes), np.empty_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    one[starts] = two[starts] = START
    second = starts + 1
    two[second[second < len(two)]] = START
    return np.stack([mix(one), mix(mix(one) + two), mix(two ^ np.uint64(0xA4093822299F31D0))])


def choices(history: np.ndarray, leaves: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the level's table, four for each token; the way taken) at the node of each path on that level."""
    node = leaves >> (BITS * (LEVELS - level))
    salt = mix(node.astype(np.uint64) + np.uint64(level << 32))
    rows = np.empty((len(leaves), 4), np.uint16)
    rows[:, 0] = BUCKETS + node
    for k, h in enumerate(history, 1):
        rows[:, k] = ((h ^ salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return rows, (leaves >> (BITS * (LEVELS - level - 1))) & (WAYS - 1)


def blocks(rows):
    """Texts in blocks of a bounded number of words: (positions of the rows, word lists, hashes with ends, leaves, first tokens)."""
    held: list[tuple[int, list, np.ndarray, np.ndarray]] = []
    size = 0
    for i, low in rows:
        hashes, heads = hashes_and_heads(low)
        held.append((i, low.split(), np.append(hashes, END), np.append(leaves_of(hashes, heads), 0)))
        size += len(hashes) + 1
        if size >= BLOCK_WORDS:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    lengths = np.array([len(h[2]) for h in held])
    return [h[0] for h in held], [h[1] for h in held], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), np.cumsum(lengths) - lengths


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the features' rows, held within +-``STEEPEST`` so that their exponentials are finite."""
    z = weights.take(rows[:, 0], axis=0)
    for k in (1, 2, 3):
        z += weights.take(rows[:, k], axis=0)
    return np.clip(z, -STEEPEST, STEEPEST, out=z)


def log_chances(weights: np.ndarray, history: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each path after its history."""
    total, token = np.zeros(len(leaves)), WAYS * np.arange(len(leaves))
    for level in range(LEVELS):
        rows, way = choices(history, leaves, level)
        z = logits(weights[level], rows)
        total += z.ravel()[token + way] - np.log(np.exp(z) @ ONES)
    return total


def update(weights: np.ndarray, seen: np.ndarray, used: np.ndarray, rows: np.ndarray, way: np.ndarray) -> None:
    """One mini-batch of one level: the summed gradient of each touched row, scaled by the row's own history."""
    grad = logits(weights, rows)
    np.exp(grad, out=grad)
    grad /= (grad @ ONES)[:, None]
    grad.ravel()[WAYS * np.arange(len(way)) + way] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # a radix sort for 16-bit numbers
    bucket = flat[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    touched = bucket[first].astype(np.int64)
    total = np.add.reduceat(grad.take(order >> 2, axis=0), first, axis=0)
    seen[touched] += np.einsum("ij,ij->i", total, total) / WAYS
    used[touched] += np.diff(np.r_[first, len(flat)])
    total *= (RATE / np.sqrt(seen[touched] + 1e-6))[:, None]
    weights[touched] -= total


def start_of(leaf_counts: np.ndarray) -> np.ndarray:
    """Weights before training: each node's row holds the logarithm of its ways' shares."""
    weights = np.zeros((LEVELS, TABLE, WAYS), np.float32)
    for level in range(LEVELS):
        n = leaf_counts.reshape(WAYS ** level, WAYS, -1).sum(axis=2)
        weights[level, BUCKETS:BUCKETS + len(n)] = np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * WAYS))
    return weights


def _count(batches):
    """(word, leaf, times) of training texts, summed up to a bounded number of words."""
    def out(counts):
        words = list(counts)
        leaves = leaves_of(*hashes_and_heads(b" ".join(words)))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(leaves, pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "leaf", "times"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(text.as_py().lower().split())
            if len(counts) > COUNTED:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


def _train(start):
    def run(batches):
        weights, seen, used = start.value.copy(), np.zeros((LEVELS, TABLE), np.float32), np.zeros((LEVELS, TABLE), np.int64)
        for batch in batches:
            for _, _, hashes, leaves, starts in blocks((0, t.as_py().lower()) for t in batch.column(0)):
                history = features(hashes, starts)
                for at in range(0, len(leaves), BATCH):
                    part = slice(at, at + BATCH)
                    for level in range(LEVELS):
                        update(weights[level], seen[level], used[level], *choices(history[:, part], leaves[part], level))
        flat, times = weights.reshape(-1, WAYS), used.ravel()
        rows = np.flatnonzero(times)
        for at in range(0, len(rows), 16_384):
            part = rows[at:at + 16_384]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(times[part]), *[pa.array(flat[part, k]) for k in range(WAYS)]],
                                             names=["bucket", "used", *[f"w{k}" for k in range(WAYS)]])
    return run


def train(texts: DataFrame, start: np.ndarray) -> np.ndarray:
    """Weights after the tasks' updates. The result has LEVELS x TABLE x WAYS numbers, whatever the corpus."""
    names = [f"w{k}" for k in range(WAYS)]
    run = _train(texts.sparkSession.sparkContext.broadcast(start))
    rows = texts.mapInArrow(run, "bucket bigint, used bigint, " + ", ".join(f"{x} float" for x in names))
    mean = rows.groupBy("bucket").agg(F.sum("used").alias("used"), *[F.sum(F.col("used") * F.col(x).cast("double")).alias(x) for x in names])
    table = mean.toPandas()
    weights = start.copy()
    if len(table):
        weights.reshape(-1, WAYS)[table["bucket"].to_numpy()] = table[names].to_numpy() / table["used"].to_numpy()[:, None]
    return weights


def _score(weights, index, times, base_log, leaf_log, n_end):
    """``base_log``, ``leaf_log``: logarithm of the denominators; the words without a known count go out by document."""
    def run(batches):
        known_leaf, known = leaf_log.value, index.value
        w, c = weights.value, times.value
        for batch in batches:
            m = batch.num_rows
            n_tokens, n_known, base, score = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
            # words that are looked up later, row after row: flat columns, not an object each
            late_words, late_leaves, late_times, late_rows = [], [], [], np.zeros(m + 1, np.int32)
            for at, words, hashes, target, starts in blocks((i, t.as_py().lower()) for i, t in enumerate(batch.column(2))):
                history, logs = features(hashes, starts), np.empty(len(target))
                for k in range(0, len(target), BATCH):
                    part = slice(k, k + BATCH)
                    logs[part] = log_chances(w, history[:, part], target[part])
                logs *= np.log10(np.e)
                place = np.full(len(target), -2, np.int64)  # -2: the end
                for first, ws in zip(starts, words):
                    place[first:first + len(ws)] = [known.get(x, -1) for x in ws]
                count = np.where(place == -2, n_end, np.where(place >= 0, c[np.maximum(place, 0)] if len(c) else 0, 0))
                here = place != -1
                numerator = np.log10(count + 0.5)
                b = np.where(here, numerator - base_log, 0.0)
                s = logs + np.where(here, numerator - known_leaf[target], 0.0)
                n_tokens[at], n_known[at] = np.diff(np.r_[starts, len(target)]), np.add.reduceat((here & (count > 0)).astype(np.int64), starts)
                base[at], score[at] = np.add.reduceat(b, starts), np.add.reduceat(s, starts)
                for row, first, ws in zip(at, starts, words):
                    miss = np.flatnonzero(place[first:first + len(ws)] == -1)
                    unknown = Counter([ws[i] for i in miss])
                    late_words.extend(unknown)
                    late_times.extend(unknown.values())
                    kinds = dict(zip([ws[i] for i in miss], target[first + miss].tolist()))
                    late_leaves.extend([kinds[x] for x in unknown])
                    late_rows[row + 1] = len(unknown)
            struct = pa.StructArray.from_arrays([pa.array(late_words, pa.binary()), pa.array(late_leaves, pa.int64()), pa.array(late_times, pa.int64())], ["word", "leaf", "n"])
            rest = pa.ListArray.from_arrays(pa.array(np.cumsum(late_rows), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x) for x in (n_tokens, n_known, base, score)], rest],
                                             names=["id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])
    return run


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(word, times) of the most frequent words, at most ``most`` of them: all words above a count that a histogram of a few
    hundred logarithmic bins gives, so no task sorts the vocabulary."""
    size = F.floor(F.log2("times") * 8)
    total, least = 0, None
    for row in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        total += row["count"]
        if total > most:
            break
        least = row["size"]
    return counts.filter(size >= least if least is not None else F.lit(False)).select("word", "times")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    c, spark = F.col, docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(docs[doc_id].cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), held.alias("held_out"), text_of(docs, text).cast("binary").alias("text"))
    training = rows.filter("not held_out").select("text")
    counts = staged(training.mapInArrow(_count, "word binary, leaf bigint, times bigint").groupBy("word", "leaf").agg(F.sum("times").alias("times")))
    n_docs = training.count()
    by_leaf = {r["leaf"]: (r["n"], r["v"]) for r in counts.groupBy("leaf").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    by_leaf[0] = (n_docs, 1 if n_docs else 0)
    n, v = (sum(x[k] for x in by_leaf.values()) for k in (0, 1))
    base_log = float(np.log10(n + 0.5 * (v + 1)))
    leaf_n, leaf_v = (np.array([by_leaf.get(k, (0, 0))[j] for k in range(LEAVES)], float) for j in (0, 1))
    leaf_log = np.log10(leaf_n + 0.5 * (leaf_v + 1))
    weights = train(training, start_of(leaf_n))

    top = most_frequent(counts, frequent).toPandas()
    index = {bytes(w): i for i, w in enumerate(top["word"])}
    share = spark.sparkContext.broadcast
    run = _score(share(weights), share(index), share(top["times"].to_numpy(np.int64)), base_log, share(leaf_log), n_docs)
    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rest array<struct<word: binary, leaf: bigint, n: bigint>>"
    scored = staged(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()))
    words = scored.select("rid", F.inline("rest"))
    table = F.broadcast(spark.createDataFrame(pd.DataFrame({"leaf": np.arange(LEAVES), "leaf_log": leaf_log})))  # LEAVES rows
    log = F.log10(F.coalesce(c("times"), F.lit(0)) + 0.5)
    late = words.join(counts.select("word", "times"), "word", "left").join(table, "leaf").groupBy("rid").agg(
        F.sum(F.when(c("times") > 0, c("n")).otherwise(0)).alias("late_known"), F.sum(c("n") * (log - base_log)).alias("late_base"),
        F.sum(c("n") * (log - c("leaf_log"))).alias("late_score"))
    return scored.drop("rest").join(late, "rid", "left").select(
        c("id").alias(doc_id), "held_out", "n_tokens", (c("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (c("base") + F.coalesce("late_base", F.lit(0.0))).alias("base_score"), (c("score") + F.coalesce("late_score", F.lit(0.0))).alias("score"))


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
