"""Packing documents into few sequences by swap-based local search.

Tokens come from the public tokenizer file, a separator ends each document, and only documents longer than a sequence are cut.
Pieces are dealt evenly to groups of about ``GROUP`` pieces, however many there are, and each group is packed by one task:
a best-fit start, then a local search among the bins that are not full. The emptiest bin gives its pieces away: by a move where
one fits, else by exchanging one for a smaller one, or two for one, in a bin with room; each step fills a bin that is
fuller than the giver, so the sum of squared fills rises, which ends the search. It goes on until the lower bound is reached or no
step is left in any bin; all pairs of a bin's pieces are looked at, and a bin without a step is tried again with what changed since.

Defined results: null counts as empty, and an empty text is the separator alone; equal rows are packed as so many documents;
ties go to the smaller id; a null id is carried through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.bpe import runs_of, vocabulary_path
from tallyguard.llm.common import documents, staged, text_of

LENGTH, SEPARATOR, GROUP = 4096, 1, 20_000
END = np.uint32(SEPARATOR).tobytes()
KEPT_RUNS, TOGETHER = 1_500_000, 1 << 21  # entries of the table of encoded runs; characters encoded together


class LibraryEncoder:
    """Ids by the tokenizers library; runs between white space are encoded once and kept in a bounded table.

    New runs are joined by a mark of one known id and encoded together, for one call costs far more than one run."""

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self.ids(self.MARK)[0]
        self.runs: dict[str, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, runs: list[str]) -> None:
        for run in runs:
            if self.MARK in run or "<|" in run:
                self.runs[run] = np.array(self.ids(run), "<u4").tobytes()
        plain = [r for r in runs if r not in self.runs]
        for at in range(0, len(plain), 20_000):
            part = plain[at:at + 20_000]
            ids = np.array(self.ids(f" {self.MARK} ".join([*part, ""])), "<u4")
            ends = (4 * np.flatnonzero(ids == self.mark)).tolist()
            data, first = ids.tobytes(), 0
            for run, end in zip(part, ends, strict=True):
                self.runs[run] = data[first:end]
                first = end + 4

    def encode_many(self, texts: list[str]) -> list[bytes]:
        parts = [runs_of(t) for t in texts]
        new = set().union(*parts).difference(self.runs)
        if len(self.runs) + len(new) > KEPT_RUNS:
            self.runs.clear()
            new = set().union(*parts)
        if new:
            self.learn(list(new))
        known = self.runs
        return [b"".join([known[r] for r in runs]) for runs in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    return LibraryEncoder(path)


def pieces_of(docs: DataFrame, path: str, length: int, doc_id: str, text: str, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document."""
    def encoded(enc, batch):
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(key)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size > TOGETHER:
                yield from zip(keys, [x + END for x in enc.encode_many(texts)])
                keys, texts, size = [], [], 0
        yield from zip(keys, [x + END for x in enc.encode_many(texts)])

    def run(batches):
        enc = library(path)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for key, ids in encoded(enc, batch):
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at:at + 4 * length]
                    for col, value in zip(cols, (key, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None)):
                        col.append(value)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = [batch.schema.names[0], "piece", "start", "length", "ids_crc32", "ids"]
            take = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols[:take], types)], names=names[:take])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(docs[doc_id].alias(doc_id), text_of(docs, text).alias("_text")).mapInArrow(run, schema)


class Bins:
    """Bins of one group: sorted (size, item) lists and the room left in each."""

    def __init__(self, sizes: list[int], limit: int):
        self.limit, self.items, self.room = limit, [], []
        at_room: list[list[int]] = [[] for _ in range(limit + 1)]
        mask = 0
        for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):  # best fit, largest first
            size = sizes[item]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = at_room[room].pop()
                if not at_room[room]:
                    mask ^= 1 << room
                self.items[b].append((size, item))
            else:
                room, b = limit, len(self.items)
                self.items.append([(size, item)])
                self.room.append(0)
            self.room[b] = room - size
            if not at_room[room - size]:
                mask |= 1 << (room - size)
            at_room[room - size].append(b)
        for x in self.items:
            x.sort()

    def shift(self, src: int, dst: int, go: list, back: list) -> None:
        """Items ``go`` leave bin ``src`` for ``dst``, items ``back`` the other way."""
        for a, b, moved in ((src, dst, go), (dst, src, back)):
            for x in moved:
                at = bisect_left(self.items[a], x)
                del self.items[a][at]
                insort(self.items[b], x)
                self.room[a] += x[0]
                self.room[b] -= x[0]

    def step(self, src: int, others: list[int]) -> int:
        """One step that fills one of ``others`` from ``src``: the bin that was filled, -1 if there is none."""
        mine = self.items[src]
        most = max((self.room[b] for b in others), default=0)
        for size, item in reversed(mine):  # a move, to the tightest bin
            if size <= most:
                dst = min((b for b in others if self.room[b] >= size), key=lambda b: (self.room[b], b))
                self.shift(src, dst, [(size, item)], [])
                return dst
        gives = 0  # bit s: one item or two together have size s
        ones, sizes = 0, [s for s, _ in mine]
        for k, s in enumerate(sizes):
            if k == 0 or s != sizes[k - 1] or (k == 1 or s != sizes[k - 2]):  # a third equal one adds no pair
                gives |= ones << s
                ones |= 1 << s
        gives |= ones
        best, found = 0, None
        for b in sorted(others, key=lambda b: (-self.room[b], b)):
            room, last = self.room[b], -1
            if room <= best:  # none fills more than the room left
                break
            window = (1 << room) - 1
            for x in self.items[b]:
                if x[0] != last:
                    last = x[0]
                    gain = (gives >> (last + 1) & window).bit_length()
                    if gain > best:
                        best, found = gain, (b, x)
                        if gain == room:
                            break
        if found is None:
            return -1
        dst, back = found
        self.shift(src, dst, self.given(mine, best + back[0]), [back])
        return dst

    @staticmethod
    def given(mine: list, size: int) -> list:
        """One item of ``size``, or two that have it together."""
        first: dict[int, tuple[int, int]] = {}
        for x in mine:
            if x[0] == size:
                return [x]
        for x in mine:
            if size - x[0] in first:
                return [first[size - x[0]], x]
            first.setdefault(x[0], x)
        raise AssertionError("no such items")

    def improve(self, most: int | None = None) -> None:
        """Steps until the lower bound is reached or none is left; ``most`` of them if it is given."""
        total = self.limit * len(self.items) - sum(self.room)
        bound, left = -(-total // self.limit), sum(1 for x in self.items if x)
        log: list[int] = []  # bins as they change; a bin without a step is tried again only with what changed since
        tried: dict[int, int] = {}
        again = True
        while again and left > bound:
            again = False
            able = sorted((b for b, x in enumerate(self.items) if x and self.room[b] > 0), key=lambda b: (-self.room[b], b))
            for src in able:
                since = log[tried[src]:] if src in tried else able
                if src in tried and not since:
                    continue
                recent = able if src in since else set(since)
                others = [b for b in recent if b != src and self.items[b] and 0 < self.room[b] <= self.room[src]]
                while self.items[src] and (most is None or most > 0) and (dst := self.step(src, others)) >= 0:
                    most, again = None if most is None else most - 1, True
                    log += [src, dst]
                    # the bin has changed, and has more room: all others count
                    others = [b for b in able if b != src and self.items[b] and 0 < self.room[b] <= self.room[src]]
                if not self.items[src]:
                    left -= 1
                tried[src] = len(log)
                if again:
                    break
            if most == 0:
                return


def pack(sizes: list[int], limit: int = LENGTH, most: int | None = None) -> list[list[int]]:
    """Bins of positions in ``sizes``; none holds more than ``limit``."""
    bins = Bins(sizes, limit)
    bins.improve(most)
    return [[i for _, i in reversed(x)] for x in bins.items if x]


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    pieces = staged(pieces_of(docs, path or vocabulary_path(), length, doc_id, text, with_ids))
    groups = max(1, round(pieces.count() / group))

    def run(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        rows = pa.Table.from_batches(table)
        rows = rows.sort_by([("length", "descending"), (rows.column_names[0], "ascending"), ("piece", "ascending")])
        n, sizes = rows.num_rows, rows.column("length").to_pylist()
        seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first = TaskContext.get().partitionId() << 32
        for k, items in enumerate(pack(sizes, length)):
            at = 0
            for i in items:
                seq[i], offset[i] = first + k, at
                at += sizes[i]
        rows = rows.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=2000 if with_ids else 20_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return pieces.repartition(groups).mapInArrow(run, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
