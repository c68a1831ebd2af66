"""Small tables with the awkward cases every operator must take, and plain versions of some operators."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, kept string, rid string, id string, _row string, digest string, node string"


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Éa", "ñu", "straße", "zeta", "eta", "theta", "iota", "kappa"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n)) + "."
    rows: list[tuple[int | None, str | None]] = []
    base, passage = make(120), make(70)
    rows += [(1, base), (2, base), (3, base.encode().upper().decode()), (4, base + " tail end."), (5, base.replace("alpha", "omega", 1))]
    rows += [(6, make(60) + "\n" + passage + "\n" + make(40)), (7, make(50) + "\n" + passage), (8, passage)]
    rows += [(9, ""), (10, None), (11, "   \n\t "), (12, "one"), (13, "one"), (14, "two words"), (None, "no id here " + make(30)), (None, base)]
    rows += [(15, make(9000)), (16, "x" * 30_000), (17, make(30)), (17, make(30)), (18, passage), (18, passage)]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None if t is None else len(t), "a", "b", "c", "d", "e", "f") for i, t in rows], SCHEMA)


def ascii_lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def shingle_set(text: str | None, size: int) -> set:
    w = ascii_lower(text).split()
    return set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())


def near_groups(rows, size: int, percent: int = 80) -> list[tuple[int, list[int]]]:
    """(set size, positions of the component) of each row, by comparing all pairs that share a shingle."""
    sets = [shingle_set(t, size) for _, t in rows]
    holders, common = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for ks in holders.values():
        common.update(itertools.combinations(ks, 2))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(b)] = root(a)
    ids = defaultdict(list)
    for a in range(len(rows)):  # rows that repeat an id are one document to the contract
        ids[root(a)].append(a)
    return [(len(sets[a]), ids[root(a)]) for a in range(len(rows))]
