"""A Merkle manifest of a dataset and, for every leaf, the proof that it belongs to the root.

Rows are leaves, in the order of their id inside their source. Sixteen neighbours become one node, level by level, until a source has
one subroot; the subroots in the order of their sources are the leaves of the tree above. Every level that is built is stored as
rows that name their parent and hold the digests to their left and right in its run.

A recursive query then climbs: it joins each row with the node it stands on, appends that node's siblings to the proof, folds the
digest with them and moves to the parent, until it stands on the root. A row of the climb is a bottom run, that is up to sixteen leaves:
each leaf's digest is folded on its own, and the siblings above the run, which its leaves share, are kept once. One row a leaf was
computed to need 13.9 KB a leaf, as the query keeps all its levels; one a run needs a sixteenth of the proofs.

Positions come from a sorted, stored table: a row's place in its partition and the partition's offset in the source, so a source that
holds a third of all rows is no one's single task. Nodes high up carry many climbing rows: those above ``weight`` rows, at most
UPPER_NODES by the choice of that weight, are climbed in a second query that broadcasts them; below, no node carries more rows than that.

Defined results: null fields count as ``-``, a null source and a null id come first; equal ids in one source are ordered by their leaf
digests; equal rows are leaves of their own; texts of any length are hashed whole; a row without siblings on its way has the proof of the empty text; a row with
a null id is not tampered with; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.llm.common import ascii_lower, documents, staged

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER_NODES = 8192  # rows of about 0.6 KB that may be broadcast
LEVEL = 50  # a node's number: its level above this bit, its position below
TOP = -1  # the tree over the subroots
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@contextmanager
def unlimited_recursion(spark: SparkSession):
    """A recursive query stops at a million rows unless told otherwise; ours ends at the root."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def digest(*parts: Column) -> Column:
    """H of texts and of digests as hex text."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def joined(digests: Column) -> Column:
    """Binary digests one after the other."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def leaf_digest(values: Iterable[Column]) -> Column:
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


@dataclass(frozen=True)
class Manifest:
    """``runs``: a row per sixteen leaves; ``nodes``: every node below the root with its parent and siblings; ``subroots``: one per
    source; ``root`` and ``height`` of the whole."""

    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    root_node: int
    height: int
    n_runs: int


def numbered_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tamper_mod: int = 5) -> DataFrame:
    """(sid, pos, total, doc_id, source, leaf, other): place in the source, and the tampered digest where there is one."""
    c = F.col
    key, source, *_, text = fields
    values = [docs[x] for x in fields]
    tampered = leaf_digest([*values[:-1], ascii_lower(docs[text].cast("string"))])
    chosen = F.crc32(docs[key].cast("string").cast("binary")) % tamper_mod == 0
    # texts are hashed once; the sort by ranges samples its input first
    leaves = staged(docs.select(docs[source].cast("string").alias("source"), docs[key].alias("doc_id"), leaf_digest(values).alias("leaf"),
                                F.when(chosen, tampered).alias("other")))
    order = ["source", "doc_id", "leaf"]
    leaves = staged(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
                    .withColumn("_part", F.shiftright("_at", 33)))
    shares = staged(leaves.groupBy("_part", "source").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # a source has at most one share a partition
    before = Window.partitionBy("source").orderBy("_part")
    shares = shares.withColumns({"_offset": F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), "_start": F.min("_first").over(before),
                                 "total": F.sum("_n").over(Window.partitionBy("source"))})
    starts = shares.filter(c("_first") == c("_start")).select("_part", "_start")
    per_part = starts.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    skipped = per_part.select("_part", F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_skipped"))  # a row a partition
    numbers = starts.join(skipped, "_part").select(
        "_start", (F.coalesce("_skipped", F.lit(0)) + F.row_number().over(Window.partitionBy("_part").orderBy("_start")) - 1).alias("sid"))
    shares = staged(shares.join(numbers, "_start").select(
        c("_part").alias("_share_part"), c("source").alias("_share_source"), "_first", F.coalesce("_offset", F.lit(0)).alias("_offset"), "total", "sid"))
    same = (c("_part") == c("_share_part")) & c("source").eqNullSafe(c("_share_source"))
    return leaves.join(shares, same).select("sid", (c("_offset") + c("_at") - c("_first")).alias("pos"), "total", "doc_id", "source", "leaf", "other")


def _parent(tree: Column, level: int, pos: Column, size: Column) -> tuple[Column, Column]:
    """Tree and number of the parent: a node of the next level or, where the source ends, a leaf of the tree above."""
    ends = (F.ceil(size / FAN) == 1) & (tree != TOP)
    up = F.lit((level + 1) << LEVEL) + F.floor(pos / FAN)
    return F.when(ends, F.lit(TOP)).otherwise(tree).cast("bigint"), F.when(ends, tree).otherwise(up).cast("bigint")


def _stack(level_rows: DataFrame, level: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """From the nodes (tree, pos, size, digest, weight) of one level: the node rows of all levels up to the tops, and the tops."""
    c = F.col
    nodes, tops = [], []
    while True:
        tops.append(level_rows.filter("size = 1").select("tree", "pos", "digest", "weight"))
        rest = level_rows.filter("size > 1")
        if rest.isEmpty():
            return nodes, tops, level
        runs = staged(rest.groupBy("tree", F.floor(c("pos") / FAN).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest", "weight"))).alias("members"), F.max("size").alias("size"), F.sum("weight").alias("total_weight")))
        parent_tree, parent = _parent(c("tree"), level, c("up") * FAN, c("size"))
        each = runs.select("tree", "size", "up", "members", "total_weight", F.posexplode("members").alias("i", "member"))
        nodes.append(each.select(
            "tree", (F.lit(level << LEVEL) + c("member.pos")).alias("node"), c("member.weight").alias("weight"), parent_tree.alias("parent_tree"), parent.alias("parent"),
            c("total_weight").alias("parent_weight"), joined(F.slice(c("members.digest"), F.lit(1), c("i"))).alias("lefts"),
            joined(F.slice(c("members.digest"), c("i") + 2, F.lit(FAN))).alias("rights")))
        level_rows = runs.select("tree", c("up").alias("pos"), F.ceil(c("size") / FAN).alias("size"), digest(as_hex(joined(c("members.digest")))).alias("digest"),
                                 c("total_weight").alias("weight"))
        level += 1


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tamper_mod: int = 5) -> Manifest:
    c = F.col
    leaves = numbered_leaves(docs, fields, tamper_mod)
    runs = staged(leaves.groupBy("sid", F.floor(c("pos") / FAN).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "other"))).alias("members"), F.max("total").alias("total")))
    lone = c("total") == 1
    first = runs.select(c("sid").alias("tree"), c("run").alias("pos"), F.ceil(c("total") / FAN).alias("size"),
                        F.when(lone, c("members")[0]["leaf"]).otherwise(digest(as_hex(joined(c("members.leaf"))))).alias("digest"), F.lit(1).cast("bigint").alias("weight"))
    nodes, tops, height = _stack(first, 1)
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    subroots = staged(subroots.select(c("tree").alias("sid"), "digest", "weight"))
    n_sources = subroots.count()
    above, roots, top_height = _stack(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), c("sid").alias("pos"), F.lit(n_sources).cast("bigint").alias("size"), "digest", "weight"), 0)
    everything = nodes + above
    all_nodes = None
    for part in everything:
        all_nodes = part if all_nodes is None else all_nodes.unionByName(part)
    if all_nodes is None:
        schema = "tree bigint, node bigint, weight bigint, parent_tree bigint, parent bigint, parent_weight bigint, lefts binary, rights binary"
        all_nodes = docs.sparkSession.createDataFrame([], schema)
    all_nodes = staged(all_nodes)
    root = roots[-1].select("digest").collect()  # one row
    return Manifest(runs, all_nodes, subroots, bytes(root[0][0]).hex() if root else None, top_height << LEVEL, height + top_height, runs.count())


CLIMB = """
WITH RECURSIVE climb(sid, run, tree, node, weight, folds, proof) AS (
  SELECT sid, run, tree, node, weight, folds, proof FROM {start}
  UNION ALL
  SELECT {hint} c.sid, c.run, n.parent_tree, n.parent, n.parent_weight,
         transform(c.folds, f -> unhex(sha2(cast(lower(hex(concat(n.lefts, f, n.rights))) AS binary), 256))),
         concat(c.proof, n.lefts, n.rights)
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.node = n.node)
SELECT * FROM climb
"""


def climb(start: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """Every stop of every row of ``start`` on its way up through ``nodes``."""
    spark = start.sparkSession
    names = {"start": f"merkle_start_{uuid.uuid4().hex}", "nodes": f"merkle_nodes_{uuid.uuid4().hex}"}
    start.createOrReplaceTempView(names["start"])
    nodes.createOrReplaceTempView(names["nodes"])
    try:
        return spark.sql(CLIMB.format(hint="/*+ BROADCAST(n) */" if few else "", **names))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def proofs(m: Manifest) -> DataFrame:
    """(sid, run, folds, proof) per bottom run: what each of its leaves folds to at the root, and the siblings above the run."""
    c = F.col
    lone = c("total") == 1
    parent_tree, parent = _parent(c("sid"), 0, c("run") * FAN, c("total"))
    own = F.transform(c("members"), lambda x, i: F.coalesce(x["other"], x["leaf"]))
    folded = F.transform(c("members"), lambda x, i: digest(as_hex(F.concat(
        joined(F.slice(c("members.leaf"), F.lit(1), i)), F.coalesce(x["other"], x["leaf"]), joined(F.slice(c("members.leaf"), i + 2, F.lit(FAN)))))))
    start = m.runs.select("sid", "run", F.when(lone, F.lit(TOP)).otherwise(parent_tree).cast("bigint").alias("tree"), F.when(lone, c("sid")).otherwise(parent).alias("node"),
                          F.lit(1).cast("bigint").alias("weight"), F.when(lone, own).otherwise(folded).alias("folds"), F.lit(b"").alias("proof"))
    weight = max(2, m.n_runs * m.height // UPPER_NODES + 1)
    at_root = (c("tree") == TOP) & (c("node") == m.root_node)
    spark = m.runs.sparkSession
    with unlimited_recursion(spark):
        half = staged(climb(start, m.nodes.filter(c("weight") < weight)).filter(at_root | (c("weight") >= weight)))
        return staged(climb(half, m.nodes.filter(c("weight") >= weight), few=True).filter(at_root).select("sid", "run", "folds", "proof"))


def verify(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tamper_mod: int = 5) -> DataFrame:
    """One row per row of ``docs``: its leaf, subroot and root, the digest of its proof, and what its (tampered) leaf folds to."""
    c = F.col
    m = build(docs, fields, tamper_mod)
    runs = m.runs.join(proofs(m), ["sid", "run"]).join(m.subroots.select("sid", c("digest").alias("subroot")), "sid")
    each = runs.select("members", "folds", "proof", "subroot", F.posexplode("members").alias("i", "member"))
    own = F.concat(joined(F.slice(c("members.leaf"), F.lit(1), c("i"))), joined(F.slice(c("members.leaf"), c("i") + 2, F.lit(FAN))))
    root = F.lit(m.root).cast("string")
    folded = as_hex(F.element_at("folds", c("i") + 1))
    return each.select(c("member.doc_id").alias(fields[0]), as_hex(c("member.leaf")).alias("leaf"), as_hex(c("subroot")).alias("subroot"), root.alias("root"),
                       F.sha2(as_hex(F.concat(own, c("proof"))).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(documents(spark, sf_dir))


def _sql(levels: int, top_levels: int) -> str:
    """The same rows in SQL, for sources of at most 16 ** levels rows and at most 16 ** top_levels sources. A level whose tree has one node
    hands it on."""
    crc = """(SELECT xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295))"""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    head = " || ".join(field.format(x) for x in FIELDS[:-1])
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""h AS (SELECT doc_id, source, sha256({head} || {field.format('text')}) AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field.format(low)}) END AS other FROM documents)""",
             """c0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    coalesce(other, leaf) AS f, '' AS proof FROM h)""", "n0 AS (SELECT sid, pos, leaf AS x FROM c0)"]

    def level(k: int, c: str, n: str) -> None:
        parts.append(f"g{k} AS (SELECT sid, pos // 16 AS up, list(x ORDER BY pos) AS xs, max(max(pos)) OVER (PARTITION BY sid) = 0 AS done FROM {n} GROUP BY sid, pos // 16)")
        parts.append(f"n{k + 1} AS (SELECT sid, up AS pos, CASE WHEN done THEN xs[1] ELSE sha256(array_to_string(xs, '')) END AS x FROM g{k})")
        left, right = "array_to_string(xs[1:pos % 16], '')", "array_to_string(xs[pos % 16 + 2:], '')"
        parts.append(f"""c{k + 1} AS (SELECT {c}.* REPLACE (pos // 16 AS pos, CASE WHEN done THEN f ELSE sha256({left} || f || {right}) END AS f, proof || {left} || {right} AS proof)
    FROM {c} JOIN g{k} ON {c}.sid = g{k}.sid AND {c}.pos // 16 = g{k}.up)""")

    for k in range(levels):
        level(k, f"c{k}", f"n{k}")
    parts.append(f"t AS (SELECT c.* REPLACE (-1 AS sid, c.sid AS pos), n.x AS subroot FROM c{levels} c JOIN n{levels} n ON c.sid = n.sid)")
    parts.append(f"s AS (SELECT -1 AS sid, sid AS pos, x FROM n{levels})")
    last = levels + top_levels
    for k in range(levels, last):
        level(k, "t" if k == levels else f"c{k}", "s" if k == levels else f"n{k}")
    body = ",\n".join(parts)
    return f"WITH {body}\nSELECT doc_id, leaf, subroot, x AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = x AS verified FROM c{last} CROSS JOIN (SELECT x FROM n{last}) r"


OP12_SQL = _sql(6, 4)
