"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Both tokenizers cut the same bytes (a space and the text). Their cuts together split those bytes into smallest parts, and each
part lies in exactly one token of either side, so the parts are the links; where both cut, a group ends.

The index holds, per pair of ids and block of documents, a compressed bitmap of the documents that link the pair, and multiplicity
planes: plane k+1 marks the documents whose number of further links has bit k. A block is a bounded run of consecutive rows; the
parts of a bitmap that its batches give are OR-merged where the block ends, and the bitmaps of different blocks are disjoint
parts of the pair's one bitmap. Popcounts give a pair's documents and links: combined in each task, then summed by a shuffle of one row per pair
and task. Scores travel back along the postings: each bitmap takes its pair's count to its block, where the documents add them up.

A bitmap is a list of 16-bit places or, where that is longer, a bit set. No pair is collected: a pair in every document has a row
per block and plane. Texts are cut into runs at single spaces between other characters: both tokenizers end a token there (checked on the
second's vocabulary when it is loaded; texts stay whole otherwise), so no link or group crosses, and each distinct run is linked once per worker.

Defined results: a text that is null, empty or not given back byte for byte by both tokenizers has no tokens: zeros and an empty
digest; names of special tokens are plain text; texts of any length are aligned whole; equal rows are documents of their own, one row each;
of ids that tie for the highest count each is a best one; an empty table gives an empty result; extra columns are ignored; a null id is carried through.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.bpe import byte_letters
from tallyguard.llm.common import documents, staged, text_of

BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16  # a block of documents: at most one text more than these bytes, places of 16 bits
BATCH_BYTES = 1 << 20  # linked at once
KEPT_CHARACTERS = 5_000_000  # of runs in a worker's table
JOINED = 1 << 16  # characters of new runs that are encoded as one text
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")

INDEX = "pair bigint, block bigint, plane int, dense boolean, n bigint, bits binary"
DOCUMENT = "at int, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """The two tokenizers, the bytes of their tokens, and the text of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        size_a, size_b = self.a.get_vocab_size(), self.b.vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [bytes(map(byte_of.__getitem__, x)) if all(c in byte_of for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = size_a, size_b
        self.cuts = not any(re.search("[^▁]▁", x) for x in pieces)
        # the text of an id within a side, at the end of the first side and at the end of the group
        self.shown = [f"{i}," for i in range(size_a)] + [f"{i}|" for i in range(size_a)] + [f"{i}," for i in range(size_b)] + [f"{i};" for i in range(size_b)]

    def encode(self, runs: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """The runs that both sides give back byte for byte, and the ids of each side over all of them. Runs that can stand side by
        side are encoded as one text."""
        kept: list[int] = []
        sides: tuple[list[list[int]], list[list[int]]] = ([], [])
        units: list[list[int]] = []
        open_chars = JOINED
        for k, run in enumerate(runs):
            bare = not (run[0].isspace() or run[-1].isspace())
            if bare and open_chars < JOINED:
                units[-1].append(k)
                open_chars += len(run)
            else:
                units.append([k])
                open_chars = len(run) if bare and self.cuts else JOINED
        for alone in (False, True):  # a text that does not come back whole is tried run by run
            texts = [" ".join([runs[k] for k in u]) for u in units]
            found_a, found_b = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1)
            again = []
            for unit, text, e, b in zip(units, texts, found_a, found_b):
                a = e.ids
                if b"".join(map(self.bytes_a.__getitem__, a)) == (" " + text).encode() == b"".join(map(self.bytes_b.__getitem__, b)):
                    kept += unit
                    sides[0].append(a)
                    sides[1].append(b)
                elif len(unit) > 1:
                    again += [[k] for k in unit]
            if not again:
                break
            units = again
        return kept, *sides

    def link(self, runs: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each run: whether both sides give it back, its tokens on either side, its groups and links; its groups as text; the
        place of its first link; and the pairs of all links."""
        counts, texts, start = np.zeros((5, len(runs)), np.int64), [""] * len(runs), np.zeros(len(runs), np.int64)
        kept, side_a, side_b = self.encode(runs)
        if not kept:
            return counts, texts, start, np.zeros(0, np.int64)
        a, b = (np.concatenate([np.array(x, np.int64) for x in s]) for s in (side_a, side_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        run_end = np.cumsum([len(runs[k].encode()) + 1 for k in kept])
        n_a, n_b = (np.diff(np.searchsorted(e, run_end, "right"), prepend=0) for e in (end_a, end_b))
        cuts = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        both = cuts[:-1][cuts[:-1] == cuts[1:]]
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        n_groups, n_links = (np.bincount(np.searchsorted(run_end, x), minlength=len(kept)) for x in (both, cuts))
        counts[:, kept] = np.ones(len(kept), np.int64), n_a, n_b, n_groups, n_links
        start[kept] = np.cumsum(n_links) - n_links
        # tokens in the order of their groups, the first side's before the second's
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        upto_a, upto_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(both)))]) for g in (group_a, group_b))
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + upto_b[group_a]] = a + self.size_a * last_a
        order[np.arange(len(b)) + upto_a[group_b + 1]] = b + self.size_b * last_b + 2 * self.size_a
        shown, at = [self.shown[x] for x in order.tolist()], 0
        for k, end in zip(kept, np.cumsum(n_a + n_b).tolist()):
            texts[k], at = "".join(shown[at:end])[:-1], end
        return counts, texts, start, a[np.searchsorted(end_a, cuts)] * self.size_b + b[np.searchsorted(end_b, cuts)]


class Aligner:
    """Links of texts, from a table of runs that is emptied when it is full."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.empty()

    def empty(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.texts = 0, []
        self.counts, self.start, self.pairs = np.zeros((5, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def runs(self, text: str) -> list[str]:
        if not text:
            return []
        return SAFE_CUT.split(text) if self.pair.cuts else [text]

    def add(self, runs: list[str]) -> None:
        counts, texts, start, pairs = self.pair.link(runs)
        self.start = np.concatenate([self.start, len(self.pairs) + start])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.texts += texts
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.held += sum(map(len, runs))

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray]:
        """Per text its counts and digest; then of all links the pair and the text's place in the list."""
        if self.held > KEPT_CHARACTERS:
            self.empty()
        parts = [self.runs(t) for t in texts]
        flat = [r for p in parts for r in p]
        new = [r for r in dict.fromkeys(flat) if r not in self.known]
        if new:
            self.add(new)
        run = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        whole = np.ones(len(texts), bool)
        whole[text[self.counts[0, run] == 0]] = False
        totals = np.zeros((4, len(texts)), np.int64)
        for k in range(4):
            np.add.at(totals[k], text, self.counts[k + 1, run])
        totals[:, ~whole] = 0
        rows, at = [], 0
        for k, (p, numbers) in enumerate(zip(parts, totals.T.tolist())):
            shown = ";".join([self.texts[r] for r in run[at:at + len(p)].tolist()]) if numbers[3] else ""
            rows.append((*numbers, hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
            at += len(p)
        run, text = run[whole[text]], text[whole[text]]
        n = self.counts[4, run]
        at = np.repeat(self.start[run] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return rows, self.pairs[at], np.repeat(text, n)


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    return Aligner(pair_of(path_a, path_b))


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def bitmaps(keys: np.ndarray, times: np.ndarray, rows: int, block: int):
    """Index rows of one block from its sorted keys (pair * 2**16 + place) and how often each is linked."""
    planes = [np.ones(len(keys), bool)]
    more = times - 1
    while (more >> (len(planes) - 1)).any():
        planes.append((more >> (len(planes) - 1)) & 1 == 1)
    width = -(-rows // 8)
    for plane, held in enumerate(planes):
        if not held.any():
            continue
        pair, place = keys[held] >> 16, keys[held] & 0xFFFF
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        n = np.diff(np.append(first, len(pair)))
        dense = 2 * n > width
        row_of = np.repeat(np.arange(len(first)), n)
        sparse = ~dense[row_of]
        ends = np.append(0, np.cumsum(2 * n[~dense])).astype(np.int32)
        lists = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(place[sparse].astype("<u2").tobytes())])
        yield _index_batch(pair[first][~dense], block, plane, False, n[~dense], lists)
        at = np.flatnonzero(dense)
        for some in np.array_split(at, max(1, -(-len(at) // 256))):
            if len(some):
                bits = np.zeros((len(some), 8 * width), bool)
                for r, k in enumerate(some):
                    bits[r, place[first[k]:first[k] + n[k]]] = True
                packed = np.packbits(bits, axis=1, bitorder="little")
                yield _index_batch(pair[first][some], block, plane, True, np.bitwise_count(packed).sum(axis=1, dtype=np.int64),
                                   pa.array([x.tobytes() for x in packed], pa.binary()))


def _index_batch(pair, block, plane, dense, n, bits) -> dict[str, pa.Array]:
    size = len(pair)
    return {"pair": pa.array(pair, pa.int64()), "block": pa.array(np.full(size, block), pa.int64()), "plane": pa.array(np.full(size, plane), pa.int32()),
            "dense": pa.array(np.full(size, dense)), "n": pa.array(n, pa.int64()), "bits": bits}


def places(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All documents' places in the bitmaps of a table, and the row each comes from."""
    out, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, (dense, bits) in enumerate(zip(table.column("dense").to_pylist(), table.column("bits").to_pylist())):
        if dense:
            out.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")))
            rows.append(np.full(len(out[-1]), row))
    sparse = np.flatnonzero(~table.column("dense").to_numpy(zero_copy_only=False).astype(bool))
    lists = table.column("bits").take(pa.array(sparse))
    chunks = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    at = 0
    for chunk in chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        if len(chunk) and ends[-1] > ends[0]:
            out.append(np.frombuffer(chunk.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, ends[0]).astype(np.int64))
            rows.append(np.repeat(sparse[at:at + len(chunk)], np.diff(ends) // 2))
        at += len(chunk)
    return np.concatenate(out), np.concatenate(rows)


def index_documents(docs: DataFrame, paths: tuple[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds: those with a ``pair`` are the index, the others hold one document each."""
    path_a, path_b = paths or vocabulary_paths()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"{INDEX}, {DOCUMENT.format(id=kind)}"

    def run(batches):
        aligner = aligner_of(path_a, path_b)
        names, arrow = None, None
        block, rows, size = None, 0, 0
        keys, times = [], []

        def whole(columns: dict[str, pa.Array]) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)

        def finish():
            # the batches' parts of each bitmap become one
            found, often = np.concatenate(keys), np.concatenate(times)
            order = np.argsort(found, kind="stable")
            yield from (whole(x) for x in bitmaps(found[order], often[order], rows, block) if len(x["pair"]))

        for batch in batches:
            if arrow is None:
                names = [x.split()[0] for x in schema.split(", ")]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), batch.schema.field(1).type, *[pa.int64()] * 4, pa.string()]
                arrow = pa.schema(list(zip(names, types)))
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and held < BATCH_BYTES and rows + upto - at < BLOCK_ROWS:
                    held += len(texts[upto])
                    upto += 1
                if block is None:
                    block = batch.column(0)[at].as_py()
                found, pairs, place = aligner.align(texts[at:upto])
                once, often = np.unique((pairs << 16) | (place + rows), return_counts=True)
                keys.append(once)
                times.append(often)
                n = upto - at
                yield whole({"block": pa.array(np.full(n, block), pa.int64()), "at": pa.array(np.arange(rows, rows + n), pa.int32()), "doc_id": batch.column(1).slice(at, n),
                             **{name: pa.array([r[k] for r in found], pa.string() if k == 4 else pa.int64())
                                for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))}})
                at, rows, size = upto, rows + n, size + held
                if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                    yield from finish()
                    block, rows, size, keys, times = None, 0, 0, [], []
        if keys:
            yield from finish()

    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), docs[doc_id].alias("doc_id"), text_of(docs, text).alias("_text"))
    return rows.mapInArrow(run, schema)


def pair_counts(index: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best) of every pair: popcounts of its bitmap, and of its planes by their weights."""
    c = F.col
    weight = F.when(c("plane") == 0, F.lit(1).cast("bigint")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    counts = staged(index.groupBy("pair").agg(F.sum(F.when(c("plane") == 0, c("n")).otherwise(F.lit(0))).alias("n_docs"), F.sum(c("n") * weight).alias("n_links")))
    counts = counts.withColumns({"a": F.expr(f"pair div {size_b}"), "b": c("pair") % size_b})
    highest = counts.groupBy("b").agg(F.max("n_links").alias("_highest"))  # at most one row per id of the second vocabulary
    return counts.join(highest, "b").select("pair", "a", "b", "n_docs", "n_links", (c("n_links") == c("_highest")).alias("best"))


def _add_up(table: pa.Table) -> pa.Table:
    """Scores of one block's documents from the bitmaps that came back to it."""
    place, row = places(table)
    n = int(place.max()) + 1
    plane, count = table.column("plane").to_numpy(), table.column("n_links").to_numpy()
    weight = np.where(plane == 0, 1, 1 << np.maximum(plane.astype(np.int64) - 1, 0))
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(total, place, (weight * count)[row])
    np.add.at(best, place, (weight * table.column("best").to_numpy(zero_copy_only=False).astype(np.int64))[row])
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(n, block), pa.int64()), "at": pa.array(np.arange(n), pa.int32()), "n_best": best, "count_sum": total})


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per document, and the table of id pairs with their counts."""
    paths = paths or vocabulary_paths()
    c = F.col
    found = staged(index_documents(docs, paths, doc_id, text))
    index = found.filter("pair is not null").select("pair", "block", "plane", "dense", "n", "bits")
    pairs = staged(pair_counts(index, pair_of(*paths).size_b))
    back = index.join(pairs.select("pair", "n_links", "best"), "pair").select("block", "plane", "dense", "bits", "n_links", "best")
    scores = back.groupBy("block").applyInArrow(_add_up, "block bigint, at int, n_best bigint, count_sum bigint")
    rows = found.filter("pair is null").select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = F.lit(0).cast("bigint")
    out = rows.join(scores, ["block", "at"], "left").select(
        c("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
    return out, pairs


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir))[0]
