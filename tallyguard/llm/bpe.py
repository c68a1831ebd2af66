"""Byte-pair encoding and decoding with a public vocabulary file of the word-end kind.

A word's symbols form a doubly linked list; a priority queue holds the ranks of neighbouring pairs. The lowest rank is taken,
a stale entry (its pair is no longer there) is skipped, the pair becomes one symbol and its two new neighbour pairs are
queued. Decoding joins the vocabulary strings; the file names no decoder, so they are joined by a space.

Encoding splits at white space only, so each run of other characters is encoded once per worker and kept in a bounded table
that is emptied when full. Nothing else is shared between rows and no row is moved.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty text; a text of any length is
encoded whole; the names of special tokens in a text become their ids; equal rows give equal results, one row each; an empty
table gives an empty result; extra columns are ignored; a null id is carried through. Characters assigned in Unicode 16 or later count
as symbols, as Python's tables do not know them; marks newer than Unicode 13 are ordered by Python's tables. Everything else is split as the library does.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.common import documents, text_of

KEPT_RUNS = 1_000_000  # entries of the table of encoded runs
POSITION_BITS = 40
NO_SPACE = regex.compile(r"(?:[^\s]|[\x1c-\x1f])+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def runs_of(text: str) -> list[str]:
    """Runs without white space. ``str.split`` also splits at four control characters, which are no white space here."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return NO_SPACE.findall(text)
    return text.split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's strings."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.runs: dict[str, tuple[bytes, bytes]] = {}

    def word(self, data: bytes) -> list[int]:
        """Ids of one word given as bytes."""
        ids, rank = [self.inner[b] for b in data], self.rank
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r << POSITION_BITS) | i for i in range(n - 1) if (r := rank.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapify(queue)
        mask = (1 << POSITION_BITS) - 1
        while queue:
            top = heappop(queue)
            r, i = top >> POSITION_BITS, top & mask
            j = after[i]
            if ids[i] < 0 or j < 0 or rank.get((ids[i] << 20) | ids[j]) != r:
                continue  # stale
            ids[i], ids[j] = self.made[r], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((ids[i] << 20) | ids[k])) is not None:
                    heappush(queue, (r << POSITION_BITS) | i)
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h] << 20) | ids[i])) is not None:
                heappush(queue, (r << POSITION_BITS) | h)
        return [x for x in ids if x >= 0]

    def run_ids(self, run: str) -> list[int]:
        """Ids of a run of characters without white space."""
        if "<|" in run and self.split_special and self.split_special.search(run):
            return [i for p in self.split_special.split(run) if p for i in ([self.special[p]] if p in self.special else self.run_ids(p))]
        if not run.isascii():
            run = unicodedata.normalize("NFC", run)
        low = "".join(map(str.lower, run)) if "Σ" in run else run.lower()  # letter by letter: no final sigma
        shadow = low
        if not low.isascii():  # the library's tables are of an older Unicode: letters it does not know are symbols there
            shadow = "".join([c if c < "\u0558" or unicodedata.category(c) != "Cn" and not "\U0002ebf0" <= c <= "\U0002ee5d" else "!" for c in low])
        return [i for m in self.piece.finditer(shadow) for i in self.word(low[m.start():m.end()].encode())]

    def decode(self, ids) -> str:
        return " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        runs, get = self.runs, self.runs.get
        found = []
        for run in runs_of(text):
            hit = get(run)
            if hit is None:
                ids = self.run_ids(run)
                hit = (np.array(ids, "<u4").tobytes(), self.decode(ids).encode())
                if len(run) <= 64:
                    if len(runs) >= KEPT_RUNS:
                        runs.clear()
                    runs[run] = hit
            if hit[0]:
                found.append(hit)
        return b"".join([x for x, _ in found]), b" ".join([x for _, x in found])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id, count, digest of the ids, digest of the decoded text and, if asked for, the ids."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            n, a, b, all_ids = [], [], [], []
            for text in batch.column(1):
                ids, decoded = bpe.encode(text.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs[doc_id].alias(doc_id), text_of(docs, text).alias("_text")).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), with_ids=False)
