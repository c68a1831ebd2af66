"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of numbers that do not depend on its language: shares of kinds of characters, repeated words and lines, lengths.
Each number falls into a bin; the model is one lookup table per feature and one per chosen pair of features, so a score is a sum of looked-up
values. The tables are learned by cyclic boosting: feature after feature, a tree of at most four leaves is fitted to the gradients summed
per bin and a small part of it is added to that feature's table. What the features alone leave over ranks all pairs by the best cut in both;
the strongest get tables of their own, boosted the same way by trees that cut both sides.

Texts are read once, in all tasks; their features are a stored table from which the labelled rows are joined and all rows are scored. The
model is fitted on labelled rows of the training share: all of them up to ``FIT_ROWS``, beyond that a share chosen by a hash of id and row,
with about ``FIT_ROWS`` rows expected. Labels, language, source and id are never features.

Defined results: a text that is null counts as empty and is scored like any other; texts of any length are read whole; rows that repeat an
id are scored each on its own, and several labels of one id count by their mean; null labels are ignored; without labels every
score is 0.5; a null id is carried through, is never held out and never labelled; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import documents, staged, text_of
from tallyguard.llm.textnp import _slices, shingle_hashes, word_hashes

FIT_ROWS = 100_000  # labelled rows the model is fitted on, at most about
BINS, PAIR_BINS = 32, 8
CYCLES, PAIR_CYCLES, PAIRS = 120, 60, 8
RATE, RIDGE, LEAF_ROWS = 0.15, 2.0, 15
CUTOFF = 0.7

FEATURES = [
    "words", "word_bytes", "neighbours_equal", "distinct_words", "top_word", "distinct_threes", "short_words", "long_words", "longest_word",
    "symbols", "bars", "sentence_marks", "quotes_brackets", "upper", "digits", "not_ascii", "blanks", "equal_bytes", "byte_entropy", "kinds_of_bytes",
    "lines", "line_bytes", "repeated_lines", "ended_lines", "capitals", "marked_words",
]

# fixed values: kinds of characters
SYMBOLS, BARS, SENTENCE_MARKS, QUOTES_BRACKETS = b"#*$%&<>@^~\\`+=", b"|_{}", b".,;:!?", b"\"'()[]"
BLANK = bytes([0x20, *range(0x09, 0x0E)])


def _kind(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL, _BAR, _MARK, _QUOTE, _BLANK = map(_kind, (SYMBOLS, BARS, SENTENCE_MARKS, QUOTES_BRACKETS, BLANK))
_UPPER, _DIGIT, _HIGH = _kind(bytes(range(65, 91))), _kind(bytes(range(48, 58))), _kind(bytes(range(128, 256)))
_END = _kind(b".!?:;\"')")


def features(text: str) -> np.ndarray:
    """The numbers of one text, in the order of ``FEATURES``."""
    data = text.encode()
    out = np.zeros(len(FEATURES), np.float32)
    if not data:
        return out
    kinds, equal, capitals, marked = np.zeros(256, np.int64), 0, 0, 0
    lengths = []
    for part in _slices(data):
        arr = np.frombuffer(part, np.uint8)
        kinds += np.bincount(arr, minlength=256)
        equal += int((arr[1:] == arr[:-1]).sum())
        inside = np.zeros(len(arr) + 2, np.int8)
        inside[1:-1] = ~_BLANK[arr]
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        lengths.append(ends - starts)
        capitals += int(_UPPER[arr[starts]].sum())
        marked += int(_SYMBOL[arr[ends - 1]].sum())
    n, sizes = len(data), np.concatenate(lengths)
    words = word_hashes(data)
    share = kinds / n
    seen = share[share > 0]
    lines = [x for x in data.split(b"\n") if x.strip(BLANK)]
    out[9:20] = (share[_SYMBOL].sum(), share[_BAR].sum(), share[_MARK].sum(), share[_QUOTE].sum(), share[_UPPER].sum(), share[_DIGIT].sum(), share[_HIGH].sum(),
                 share[_BLANK].sum(), equal / n, -(seen * np.log2(seen)).sum(), len(seen))
    if len(words):
        count = np.unique(words, return_counts=True)[1]
        out[0:9] = (np.log1p(len(words)), sizes.mean(), (words[1:] == words[:-1]).mean() if len(words) > 1 else 0, len(count) / len(words), count.max() / len(words),
                    len(shingle_hashes(words, 3)) / max(1, len(words) - 2), (sizes <= 3).mean(), (sizes >= 12).mean(), np.log1p(sizes.max()))
        out[24:26] = capitals / len(words), marked / len(words)
    if lines:
        out[20:24] = (np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), np.mean([_END[x.rstrip(BLANK)[-1]] for x in lines]))
    return out


def featured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_rid, id, x): the features of every row as 32-bit floats."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["_rid", "_id", "x"])

    return docs.select(F.monotonically_increasing_id().alias("_rid"), docs[doc_id].alias("_id"), text_of(docs, text).alias("_text")).mapInArrow(
        run, f"_rid bigint, _id {kind}, x binary")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Gam:
    """Bounds of the bins and the tables of features and pairs."""

    start: float
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin of a feature -> its bin in tables of pairs
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]) if self.cuts else np.zeros((0, len(x)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, bins = np.full(len(x), self.start), self.bins(x)
        for f, table in enumerate(self.tables):
            total += table[bins[f]]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            total += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return sigmoid(total)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best place to cut a histogram in two, and what it gains; 0 where none is allowed."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh, ln = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(lg, lh) + _gain(g.sum() - lg, h.sum() - lh) - _gain(g.sum(), h.sum())
    gain[(ln < LEAF_ROWS) | (n.sum() - ln < LEAF_ROWS)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over the bins of one feature."""
    at = _cut(g, h, n)[1] if depth else 0
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([tree(g[:at], h[:at], n[:at], depth - 1), tree(g[at:], h[at:], n[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one side and then, in both halves, the other; its gain and its values."""
    best = (0.0, np.full(g.shape, -g.sum() / (h.sum() + RIDGE)))
    for turn in (False, True):
        a, b, m = (x.T if turn else x for x in (g, h, n))
        for at in range(1, len(a)):
            gain, values = -_gain(a.sum(), b.sum()), np.zeros(a.shape)
            for half in (slice(0, at), slice(at, None)):
                ga, hb, nm = a[half].sum(axis=0), b[half].sum(axis=0), m[half].sum(axis=0)
                more, cut = _cut(ga, hb, nm)
                gain += _gain(ga.sum(), hb.sum()) + more
                if nm.sum() < LEAF_ROWS:
                    gain = -np.inf
                values[half] = tree(ga, hb, nm, 1) if cut else -ga.sum() / (hb.sum() + RIDGE)
            if gain > best[0]:
                best = (float(gain), values.T if turn else values)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of tables for features, then for the pairs that gain most."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(rate / (1 - rate))) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return model
    marks = np.linspace(0, 1, BINS + 1)[1:-1]
    model.cuts = [np.unique(np.quantile(x[:, f], marks, method="higher")) for f in range(x.shape[1])]
    bins = model.bins(x)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.start)
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    for _ in range(CYCLES):
        for f, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            p = sigmoid(total)
            step = RATE * tree(np.bincount(bins[f], p - y, len(table)), np.bincount(bins[f], p * (1 - p), len(table)), rows[f])
            table += step
            total += step[bins[f]]
    # bins of about equal numbers of rows for the pairs
    model.coarse = [np.minimum(PAIR_BINS - 1, (np.cumsum(r) - r) * PAIR_BINS // len(y)) for r in rows]
    places = [c[b] for c, b in zip(model.coarse, bins)]
    square, area = (PAIR_BINS, PAIR_BINS), PAIR_BINS * PAIR_BINS

    def histograms(f: int, g: int, p: np.ndarray) -> list[np.ndarray]:
        at = places[f] * PAIR_BINS + places[g]
        return [np.bincount(at, w, area).reshape(square) for w in (p - y, p * (1 - p), None)]

    p, ranked = sigmoid(total), []
    for f in range(len(places)):
        for g in range(f):
            ranked.append((pair_tree(*histograms(f, g, p))[0], -f, -g))
    model.pairs = [(-f, -g) for gain, f, g in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros(square) for _ in model.pairs]
    for _ in range(PAIR_CYCLES):
        for (f, g), table in zip(model.pairs, model.pair_tables):
            step = RATE * pair_tree(*histograms(f, g, sigmoid(total)))[1]
            table += step
            total += step[places[f], places[g]]
    return model


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str, label: str, fit_rows: int) -> DataFrame:
    """(x, y) of the training rows that have a label, at most about ``fit_rows``."""
    c = F.col
    marks = labels.filter(labels[label].isNotNull()).groupBy(labels[doc_id].alias("_id")).agg(F.avg(labels[label].cast("double")).alias("y"))
    found = staged(rows.filter(~c("held_out")).select("_id", "_rid", "x").join(marks, "_id"))
    share = min(1.0, fit_rows / max(1, found.count()))
    return found.filter(F.pmod(F.xxhash64("_id", "_rid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x", "y")


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cutoff: float = CUTOFF,
                  folds: int = 4, held: int = 2, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Gam]:
    """One row per document with its score, and the model. Ids whose crc32 modulo ``folds`` is ``held`` are never learned from."""
    out = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    rows = staged(featured(docs, doc_id, text).withColumn("held_out", out))
    sample = labelled(rows, labels, doc_id, label, fit_rows).toArrow().sort_by([("y", "ascending"), ("x", "ascending")])  # one order, so reruns agree
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), "<f4").reshape(-1, len(FEATURES)).astype(np.float64)
    model = fit(x, sample.column("y").to_numpy())

    def run(batches):
        for batch in batches:
            score = model.score(np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4").reshape(-1, len(FEATURES)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= cutoff).astype(np.int32))],
                                             names=[doc_id, "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.select("_id", "held_out", "x").mapInArrow(run, f"{doc_id} {kind}, held_out boolean, score double, predicted int"), model


def op13_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
