import hashlib
import random

import numpy as np
import pytest

from tallyguard.llm import exact_dedup, near_dedup
from tallyguard.llm.common import staged
from tallyguard.llm.textnp import shingle_hashes, word_hashes
from tests.llm.cases import ascii_lower, near_groups, shingle_set, table, texts


def by_text(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t), []).append(i)
    return groups


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_exact_dedup_matches_grouping_by_text(spark, block):
    rows = texts()
    found = exact_dedup.exact_dedup(table(spark), block=block).collect()
    assert len(found) == len(rows)
    groups = by_text(rows)
    want = sorted(((i, max((x for x in groups[ascii_lower(t)] if x is not None), default=None), len(groups[ascii_lower(t)]),
                    hashlib.sha256(ascii_lower(t)).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert sum(r.kept for r in found) == len(groups)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    assert exact_dedup.drop_copies(table(spark, [])).count() == 0


def test_drop_copies_keeps_one_whole_row_per_text(spark):
    df = table(spark)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len(by_text(texts())) == len({ascii_lower(r.text) for r in rows})
    assert {r.doc_id for r in rows} >= {3, 4, 5, 11, 13, 15, 16} and not {1, 2, 12} & {r.doc_id for r in rows}


def test_word_hashes_follow_the_word_rule():
    data = "Aa  b\x0bc\x1cd e\tf".encode()
    assert len(word_hashes(data)) == len(data.split()) == 4
    one, two = word_hashes(b"x y x z"), word_hashes(b"\n x\n\n y x z ")
    assert (one == two).all() and one[0] == one[2] != one[1]
    long = b"ab cd " * 400_000  # several slices
    assert len(set(word_hashes(long).tolist())) == 2 and len(word_hashes(long)) == 800_000
    assert len(shingle_hashes(word_hashes(b""), 4)) == 0 and len(shingle_hashes(word_hashes(b"a b"), 4)) == 1


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_all_pairs(spark, size):
    rows = texts()
    found = near_dedup.near_duplicates(table(spark), shingle=size).collect()
    assert len(found) == len(rows)
    want = []
    for (i, t), (n, group) in zip(rows, near_groups(rows, size)):
        comp = min((rows[k][0] for k in group if rows[k][0] is not None), default=None) if n else i
        want.append((i, n, comp, i == comp))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == sorted(want, key=str)


def chain_rows(count: int, seed: int):
    """Texts in which neighbours are similar and distant ones are not, groups around a hub, and look-alikes below the threshold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, text = [], [word() for _ in range(200)]
    for i in range(count):
        text = text[6:] + [word() for _ in range(6)]
        rows.append((i, " ".join(text)))
    hub = [word() for _ in range(150)]
    for i in range(count, 2 * count):
        copy = list(hub)
        for at in rng.sample(range(150), 3 if i % 3 else 9):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    return rows


def test_near_duplicates_of_chains_and_hubs(spark, monkeypatch):
    rows = chain_rows(40, 7)
    want = {i: min(g) for (i, _), (_, g) in zip(rows, near_groups(rows, 4))}
    for block, share in ((256, 0.5), (4, 0.0), (16, 0.9)):  # one block a bucket; many blocks after one centre; more centres
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
        monkeypatch.setattr(near_dedup, "SHRUNK", share)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows), shingle=4).collect()}
        assert got == want


def test_rows_without_id_are_fetched_once_each(spark):
    rows = [(None, t) for _, t in chain_rows(30, 9)] + [(5, t) for _, t in chain_rows(30, 9)]
    got = near_dedup.near_duplicates(table(spark, rows), shingle=4).collect()
    sizes = [n for n, _ in near_groups(rows, 4)]
    assert sorted(r.n_shingles for r in got) == sorted(sizes) and {r.component_id for r in got} == {5}
    found = near_dedup.linked(staged(near_dedup._rows(table(spark, rows), "doc_id", "text")), 4, 80).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.comp, []).append(r)
    assert sorted(map(len, groups.values())) == sorted(len(g) for g in {min(g): g for _, g in near_groups(rows, 4)}.values())


def test_signature_estimates_similarity():
    a, b = shingle_hashes(word_hashes(" ".join(map(str, range(1000))).encode()), 5), shingle_hashes(word_hashes(" ".join(map(str, range(100, 1100))).encode()), 5)
    share = np.mean(near_dedup.signature(a) == near_dedup.signature(b))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(share - exact) < 0.12
    assert len(shingle_set("a b c d e f", 5)) == len(shingle_hashes(word_hashes(b"a b c d e f"), 5)) == 2


def test_one_of_each_keeps_columns_and_unlinked_rows(spark):
    df = table(spark)
    out = near_dedup.one_of_each(df)
    assert out.columns == df.columns
    rows = texts()
    groups = {tuple(g) if n else (k,) for k, (n, g) in enumerate(near_groups(rows, 5))}
    assert out.count() == len(groups)
    assert near_dedup.one_of_each(table(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.range(n - 1).selectExpr("id as a", "id + 1 as b").unionByName(spark.range(1000, 1003).selectExpr("id as a", "1000 as b"))
    found = {r.node: r.comp for r in near_dedup.components(staged(links)).collect()}
    assert {found[k] for k in range(n)} == {0} and found[1002] == 1000
