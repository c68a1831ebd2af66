"""Near duplicates by circulant MinHash, bands, and exact Jaccard verification; groups are connected components.

Two permutations give all signature coordinates: the first scatters a shingle over a universe of 2^22 places, the second is
read at that place and, for coordinate k, k places further on (around the circle). A coordinate is the smallest value over the
document's shingles, so one look-up of a contiguous run yields all coordinates of a shingle. 36 bands of 5 coordinates miss a pair
at the threshold 0.8 with a chance of (1 - 0.8^5)^36 = 6e-7.

Scale. Equal word sequences become one node first. A band bucket is never expanded into pairs: its members are compared with
one centre, the member with most company over all its buckets; links merge components, and the next round compares what is
left of a bucket with another centre, members of the centre's own component excepted. A bucket is finished when its uncompared
members are in one component, for further links inside could not change any component. A round goes on with the buckets of more
than one block for as long as the last one shrank them to half. All others that are open, such as edited copies that are rarely
similar enough to each other, are finished in blocks: the remaining members are
dealt to parts, each two parts meet in one task, the sizes of all intersections there come from one pass over their shared shingles,
and only links between components that are still apart go out. So no candidate is lost. Buckets with the same members, as the
copies of one text have in many bands, are finished once. A centre's comparisons are dealt out in
parts of ``PART`` members. Texts are fetched by row, so rows that repeat an id or have none cost no more than others. Sets are compared in full, as 64-bit hashes of the shingles. Components come from alternating
large-star and small-star rounds. Nothing is collected but counters.

Defined results: null counts as empty; a text without words has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; rows that repeat an id or a text are in one component with their equals; a null id is larger than
every other; an empty table gives an empty result; extra columns are ignored by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import documents, staged, text_of
from tallyguard.llm.textnp import mix, shingle_hashes, word_hashes

PLACES, BANDS, ROWS = 1 << 22, 36, 5
PERCENT, SHINGLE = 80, 5
PART = 128
SHRUNK = 0.5  # another centre where the last one left at most this share of the large buckets' rows
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1_000_000  # of one part of a bucket


@lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """The second permutation as runs: row p holds the values at p, p+1, ... around the circle."""
    order = np.argsort(mix(np.arange(PLACES, dtype=np.uint64))).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: BANDS * ROWS]]), BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(42)).astype(np.int64)
    low, circle = np.full(BANDS * ROWS, PLACES, np.int32), _circle()
    for at in range(0, len(places), 512):
        np.minimum(low, circle[places[at:at + 512]].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key + column.astype(np.uint64))
    return key.view(np.int64)


def digest(low: bytes) -> bytes:
    """Stands for a word sequence."""
    return hashlib.blake2b(b" ".join(low.split()), digest_size=16).digest()


def _sign(shingle: int):
    def run(batches):
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column(2):
                low = text.as_py().lower()
                shingles = shingle_hashes(word_hashes(low), shingle)
                digests.append(digest(low))
                sizes.append(len(shingles))
                keys.append(band_keys(signature(shingles)) if len(shingles) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["rid", "id", "digest", "n", "bands"])
    return run


def _compare(shingle: int, percent: int):
    """Rows come ordered by centre and part, the centre first; links go out."""
    def run(batches):
        group, mine = None, None
        for batch in batches:
            found: list[list] = [[], []]
            for centre, part, node, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(4)):
                shingles = shingle_hashes(word_hashes(text.as_py().lower()), shingle)
                if (centre, part) != group:
                    group, mine = (centre, part), None
                if node == centre:
                    mine = shingles
                    continue
                both = len(np.intersect1d(mine, shingles, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(shingles) - both):
                    found[0].append(centre)
                    found[1].append(node)
            yield _link_batch(*found)
    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    m = len(sets)
    out = np.zeros(m * m, np.int64)
    values, owners = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(values)])
    for f in np.unique(times[(times > 1) & (times <= 12)]):  # few holders: pair by pair
        held = owners[first[times == f][:, None] + np.arange(f)]
        for p in range(f):
            for q in range(p + 1, f):
                out += np.bincount(held[:, p] * m + held[:, q], minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    common = np.flatnonzero(times > 12)
    for at in range(0, len(common), 2048):  # many holders: as a matrix product
        part = common[at:at + 2048]
        table = np.zeros((m, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), times[part])
        inside = np.arange(len(column)) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
        table[owners[first[part][column] + inside], column] = 1
        out += (table @ table.T).astype(np.int64)
    return out


def _block_links(nodes: list, comps: list, sets: list, percent: int) -> tuple[list, list]:
    """Links that join components of one block that are still apart."""
    both, size = shared_counts(sets), np.array([len(x) for x in sets])
    comp = np.array(comps)
    near = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :])
    up = {c: c for c in comps}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        x, y = root(comps[i]), root(comps[j])
        if x != y:
            up[x] = y
            a.append(nodes[i])
            b.append(nodes[j])
    return a, b


def _blocks(shingle: int, percent: int):
    """Rows come block by block: (key, lo, hi, node, comp, text)."""
    def run(batches):
        held: tuple[list, list, list] = ([], [], [])
        block, seen = None, set()
        for batch in batches:
            for key, lo, hi, node, comp, text in zip(*[batch.column(i).to_pylist() for i in range(5)], batch.column(5)):
                if (key, lo, hi) != block:
                    if len(held[0]) > 1:
                        yield _link_batch(*_block_links(*held, percent))
                    held, block, seen = ([], [], []), (key, lo, hi), set()
                if node not in seen:
                    seen.add(node)
                    for col, value in zip(held, (node, comp, shingle_hashes(word_hashes(text.as_py().lower()), shingle))):
                        col.append(value)
        if len(held[0]) > 1:
            yield _link_batch(*_block_links(*held, percent))
    return run


def _link_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _parts() -> Column:
    """How many parts a bucket's rows make."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES))


def settled(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between different components among the rows (key, node, n, comp) of each key, enough to join what belongs together."""
    c = F.col
    whole = rest.groupBy("key").agg(_parts().alias("parts"), F.count(F.lit(1)).alias("members"), *[
        F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)")).alias(f"set{seed}") for seed in (1, 2)])
    parts = whole.groupBy("members", "set1", "set2").agg(F.min(F.struct("key", "parts")).alias("one")).select("one.key", "one.parts")
    dealt = rest.join(parts, "key").withColumn("mine", F.pmod(F.xxhash64("node", "key"), c("parts")))
    met = dealt.select("key", "node", "comp", "mine", F.explode(F.sequence(F.lit(0).cast("bigint"), c("parts") - 1)).alias("other"))
    rows = met.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "comp").join(texts, "node")
    return rows.select("key", "lo", "hi", "node", "comp", "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(
        _blocks(shingle, percent), "a bigint, b bigint")


def verified(edges: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The (centre, node) rows of ``edges`` whose full sets are similar enough, as (a, b)."""
    c = F.col
    parts = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = edges.join(parts, "centre").select("centre", F.pmod(F.xxhash64("node"), c("parts")).alias("part"), "node", F.lit(1).alias("place"))
    centres = dealt.select("centre", "part").distinct().select("centre", "part", c("centre").alias("node"), F.lit(0).alias("place"))
    rows = dealt.unionByName(centres).join(texts, "node").select("centre", "part", "node", "place", "text")
    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "place").mapInArrow(_compare(shingle, percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node that has a link: comp is the smallest node that can be reached."""
    c = F.col
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(c("v").alias("u"), c("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), c("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(c("v").alias("u"), c("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = staged(small.select(c("v").alias("u"), c("m").alias("v")).unionByName(least.select("u", c("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(c("u").alias("node"), c("v").alias("comp"))
    return stars.unionByName(edges.select(c("v").alias("node"), c("v").alias("comp")).distinct())


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(rid, id, n, comp) for rows of (rid, id, text), a written table: comp is equal within a group of near duplicates."""
    c = F.col
    signed = staged(docs.select("rid", "id", c("text").cast("binary").alias("text")).mapInArrow(
        _sign(shingle), "rid bigint, id bigint, digest binary, n bigint, bands array<bigint>"))
    # one node for each word sequence, held by one of its rows; rows without words stand alone
    nodes = staged(signed.filter("n > 0").groupBy("digest").agg(
        F.min("rid").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("company")).filter("company > 1")
    open_rows = staged(members.join(shared, "key"))
    score = open_rows.groupBy("node").agg(F.sum("company").alias("score"))
    texts = staged(docs.select(c("rid").alias("node"), c("text").cast("binary").alias("text")).join(score.select("node"), "node", "left_semi"))
    rows = staged(open_rows.select("key", "node").join(score, "node").join(nodes.select("node", "n"), "node").withColumn("comp", c("node")))
    links, comps, large = None, None, None
    while True:
        keys = rows.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("score", (-c("node")).alias("back"), "comp")).alias("top"), _parts().alias("parts")
        ).filter("lo <> hi").select("key", (-c("top.back")).alias("centre"), c("top.comp").alias("centre_comp"), "parts")
        rest = staged(rows.join(keys, "key"))
        if rest.isEmpty():
            break
        left = rest.filter("parts > 1").count()
        central = large is None or 0 < left <= SHRUNK * large
        found = []
        if central:  # the first round takes every bucket, later ones the large ones
            centred = rest if large is None else rest.filter("parts > 1")
            found.append(verified(staged(centred.filter("comp <> centre_comp").select("centre", "node").distinct()), texts, shingle, percent))
        if large is not None:
            blocks = rest.filter("parts = 1") if central else rest
            found.append(settled(blocks.select("key", "node", "n", "comp"), texts, shingle, percent))
        for part in found:
            part = staged(part)
            links = part if links is None else links.unionByName(part)
        comps = staged(components(links))
        if not central:
            break
        rows = (rest if large is None else rest.filter("parts > 1")).filter("node <> centre").select("key", "node", "score", "n")
        rows = staged(rows.join(comps, "node", "left").select("key", "node", "score", "n", F.coalesce("comp", "node").alias("comp")))
        large = left
    by_digest = nodes.select("digest", "node")
    if comps is None:
        by_digest = by_digest.select("digest", c("node").alias("comp"))
    else:
        by_digest = by_digest.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    return signed.select("rid", "id", "n", F.when(c("n") > 0, c("digest")).alias("digest")).join(by_digest, "digest", "left").select("rid", "id", "n", "comp")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), docs[doc_id].cast("bigint").alias("id"), text_of(docs, text).alias("text"))


def _first(found: DataFrame) -> DataFrame:
    """The row that stands for each component: smallest id, nulls last, one row of those that repeat it."""
    return found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, size of its shingle set, smallest id of its component, whether that is its own."""
    c = F.col
    found = staged(linked(staged(_rows(docs, doc_id, text)), shingle, percent))
    out = found.join(_first(found), "comp", "left").withColumn("component_id", F.when(c("comp").isNull(), c("id")).otherwise(c("first.id")))
    return out.select(c("id").alias(doc_id), c("n").alias("n_shingles"), "component_id", c("id").eqNullSafe(c("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns."""
    c = F.col
    whole = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[x] for x in docs.columns]).alias("row")))
    rows = whole.select("rid", c("row")[doc_id].cast("bigint").alias("id"), F.coalesce(c("row")[text].cast("string"), F.lit("")).alias("text"))
    found = staged(linked(rows, shingle, percent))
    keep = _first(found).select(c("first.rid").alias("rid")).unionByName(found.filter("comp is null").select("rid"))
    return whole.join(keep, "rid", "left_semi").select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4)


OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, cast(len(sh) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
