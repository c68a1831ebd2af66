import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from checks.compare import difference, duck
from tallyguard.llm import merkle_manifest as mm
from tallyguard.llm import quality_gam as gam
from tallyguard.llm import token_alignment as ta
from tests.llm.cases import texts

SF = "/root/testdata/sf0.001"
PATHS = ta.vocabulary_paths()
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, pair bigint, block string, at string, n string, sid string, run string, "
          "node string, x string, y string, _id string, _rid string, best string")


def rows_of():
    rng = random.Random(2)
    odd = [(30, " leading  two   spaces "), (31, "<|endoftext|> and <s> </s> <unk>"), (32, "has ▁ sign"), (33, "tab\tand\nlines\r\n\n x"), (34, "日本語 text 한국어 \U0001F600"),
           (35, "a b"), (36, "\x00 nul \x1c sep"), (37, "\xa0nbsp and ideographic space　x"), (38, "word " * 3000)]
    return [(i, t, rng.choice(["en", None]), rng.choice(["a", "a", "b", "é", None]), None if t is None else len(t)) for i, t in [*texts(), *odd]]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, *["z"] * 11) for r in rows], SCHEMA)


def plain_links(text):
    """Tokens of both sides with their byte ranges, linked by walking along both; None without tokens."""
    pair = ta.pair_of(*PATHS)
    if not text:
        return None
    sides = []
    for ids, names in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.bytes_a), (pair.b.encode(text), pair.bytes_b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(names[i]), i))
            at += len(names[i])
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return None
        sides.append(out)
    a, b = sides
    i = j = 0
    links, groups, held = [], [], ([], [])
    while i < len(a) and j < len(b):
        links.append((a[i][2], b[j][2]))
        for side, token in zip(held, (a[i], b[j])):
            if not side or side[-1] != token:
                side.append(token)
        x, y = a[i][1], b[j][1]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append("|".join(",".join(str(t[2]) for t in side) for side in held))
            held = ([], [])
    return len(a), len(b), groups, links


def test_the_table_of_runs_is_emptied(monkeypatch):
    monkeypatch.setattr(ta, "KEPT_CHARACTERS", 200)
    aligner = ta.Aligner(ta.pair_of(*PATHS))
    for text in [t or "" for _, t, *_ in rows_of()]:
        rows, pairs, place = aligner.align([text, "and more", text])
        f = plain_links(text)
        assert rows[0] == rows[2] and rows[0][:4] == ((f[0], f[1], len(f[2]), len(f[3])) if f else (0, 0, 0, 0))
        assert pairs[place == 0].tolist() == ([a * aligner.pair.size_b + b for a, b in f[3]] if f else [])
        assert aligner.held <= 200 + len(text) + 8


@pytest.mark.parametrize("block_rows", [1 << 16, 3])
def test_alignment_equals_walking_along_both(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ta, "BLOCK_ROWS", block_rows)
    rows = rows_of()
    found = [plain_links(t) for _, t, *_ in rows]
    counts, holders = Counter(x for f in found if f for x in f[3]), Counter(x for f in found if f for x in set(f[3]))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    want = [(r[0], 0, 0, 0, 0, 0, 0, "") if not f else
            (r[0], f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == top[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
            for r, f in zip(rows, found)]
    out, pairs = ta.align_documents(table(spark, rows).repartition(3), PATHS)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in pairs.collect()} == {k: (holders[k], n, n == top[k[1]]) for k, n in counts.items()}
    assert sum(f is None for f in found) >= 3 and sum(x[1] > 0 for x in want) > 20


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "▁", "en", "a", 1)]):
        out, pairs = ta.align_documents(table(spark, rows), PATHS)
        assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, 0, 0, 0, 0, "")] * len(rows) and pairs.count() == 0


def test_bitmaps_come_back():
    rng = np.random.default_rng(1)
    pair, place, times = np.repeat(np.arange(40), 2000), np.tile(np.arange(2000), 40), rng.integers(0, 9, 80_000)
    times[(pair % 2 == 0) & (place % 50 != 0)] = 0
    times[pair == 3] = 0
    times[(pair == 3) & (place == 7)] = 1025  # planes between the first and the last stay empty
    held = times > 0
    keys = ((pair << 16) | place)[held]
    seen = np.zeros((40, 2000), np.int64)
    kinds = set()
    for batch in ta.bitmaps(keys, times[held], 2000, 5):
        import pyarrow as pa

        t = pa.table(batch)
        at, row = ta.places(t)
        plane, p = t.column("plane").to_numpy(), t.column("pair").to_numpy()
        weight = np.where(plane == 0, 1, 1 << np.maximum(plane.astype(np.int64) - 1, 0))
        np.add.at(seen, (p[row], at), weight[row])
        assert np.array_equal(np.bincount(row, minlength=len(p)), t.column("n").to_numpy())
        kinds |= set(t.column("dense").to_pylist())
    assert np.array_equal(seen.ravel(), times) and kinds == {True, False}


def plain_manifest(rows):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tower(digests):
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for k, p in enumerate(paths):
                run, own = digests[at[k] // 16 * 16:][:16], at[k] % 16
                p.append((run[:own], run[own + 1:]))
                at[k] //= 16
            digests = [h(*digests[s:s + 16]) for s in range(0, len(digests), 16)]
        return digests[0], paths

    by = {}
    for i, t, lang, source, n in rows:
        r = (i, source, lang, n, t)
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by.setdefault(source, []).append((i is not None, i or 0, leaf(r), leaf((*r[:4], t and t.encode().lower().decode())) if hit else leaf(r), i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    towers = [tower([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, above = tower([t[0] for t in towers])
    out = []
    for s, (sub, paths), up in zip(sources, towers, above):
        for x, p in zip(sorted(by[s], key=lambda x: x[:3]), paths):
            f = x[3]
            for left, right in p + up:
                f = h(*left, f, *right)
            out.append((x[4], x[2], sub, root, h(*[d for left, right in p + up for d in left + right]), f, f == root))
    return out


@pytest.mark.parametrize("upper", [mm.UPPER_NODES, 2])
def test_manifest_equals_a_plain_one(spark, monkeypatch, upper):
    monkeypatch.setattr(mm, "UPPER_NODES", upper)
    rng = random.Random(4)
    many = [(k, f"Text {k % 7}", "en", "hot", 5) for k in range(100, 700)] + [(k, None, None, f"s{k}", None) for k in range(700, 740)]
    rows = rows_of() + many
    rng.shuffle(rows)
    got = [tuple(r) for r in mm.verify(table(spark, rows).repartition(4)).collect()]
    want = plain_manifest(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert 0 < sum(r[-1] for r in got) < len(got) and all(r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in got if not r[-1])


@pytest.mark.parametrize("rows", [[], [(5, "One", "en", None, 3)], [(k, "A", "en", "s", 1) for k in range(16)], [(k, "A", "en", "s", 1) for k in range(17)],
                                  [(k, "A", "en", f"s{k:03d}", 1) for k in range(40)]])
def test_small_manifests(spark, rows):
    got = [tuple(r) for r in mm.verify(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_manifest(rows) if rows else []))


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
def test_manifest_equals_its_sql(spark):
    assert difference(mm.op12_merkle_manifest(spark, SF), duck(SF), mm.OP12_SQL) is None


def junk_and_prose(count=600):
    rng = random.Random(6)
    syllables = ["the", "in", "er", "on", "at", "re", "ing", "tion", "ble", "wh"]
    rows = []
    for k in range(count):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(30, 200))]
        kind = k % 4
        if kind == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        if kind == 1:
            words = [w for w in words[:20] for _ in range(8)]
        rows.append((k, " ".join(words) + ".", int(kind > 1)))
    return rows


def labels_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_gam_separates_held_out_junk(spark):
    rows = junk_and_prose()
    docs = table(spark, [(k, t, "en", "a", 1) for k, t, _ in rows] + [(None, None, None, None, None), (9000, "", "en", "a", 0), (9001, "x" * 3_000_000, "en", "a", 0), (9001, "x y", "en", "a", 0)])
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    # labels of the held-out share are turned round: nothing may be learned from them
    labels = labels_table(spark, [(k, 1 - q if k in held else q, 0) for k, _, q in rows] + [(9000, None, 0), (0, 0, 1), (None, 1, 0)])
    out, model = gam.score_quality(docs, labels)
    found = out.collect()
    assert len(found) == len(rows) + 4 and [r.doc_id for r in found].count(9001) == 2
    truth = {k: q for k, _, q in rows}
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert np.mean([r.predicted == truth[r.doc_id] for r in found if r.doc_id in held]) > 0.97
    again = {(r.doc_id, r.score) for r in gam.score_quality(docs.repartition(5), labels)[0].collect()}
    assert again == {(r.doc_id, r.score) for r in found}
    # a score is the sum of the looked-up values
    x = np.stack([gam.features(t or "") for _, t, _ in rows[:50]]).astype(np.float64)
    for row, score in zip(x, model.score(x)):
        bins = [int((c <= v).sum()) for c, v in zip(model.cuts, row)]
        total = model.start + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[f][bins[f]], model.coarse[g][bins[g]]] for (f, g), t in zip(model.pairs, model.pair_tables))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert model.pairs[0] == (2, 0)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_gam_without_labels_and_with_few(spark):
    docs = table(spark, [(1, "a b c", None, None, None), (2, None, None, None, None)])
    assert {r.score for r in gam.score_quality(docs, labels_table(spark, []))[0].collect()} == {0.5}
    assert {r.predicted for r in gam.score_quality(docs, labels_table(spark, [(k, 1, 0) for k in range(9)]))[0].collect()} <= {0, 1}
    assert gam.score_quality(table(spark, []), labels_table(spark, [(1, 1, 0)]))[0].count() == 0


def test_the_fit_takes_about_as_many_rows_as_it_may(spark):
    rows = [(k, f"t{k}", None, None, None) for k in range(3000)]
    held = gam.featured(table(spark, rows)).withColumn("held_out", gam.F.lit(False))
    labels = labels_table(spark, [(k, k % 2, 0) for k in range(3000)])
    assert gam.labelled(held, labels, "doc_id", "quality", 10_000).count() == 3000
    assert 400 < gam.labelled(held, labels, "doc_id", "quality", 500).count() < 600


def test_features_of_odd_texts():
    assert not gam.features("").any()
    for t in [" ", "\n\n", "é", "A", "a\n\na\n", "\x00" * 5]:
        assert np.isfinite(gam.features(t)).all() and len(gam.features(t)) == len(gam.FEATURES)
    f = dict(zip(gam.FEATURES, gam.features("go go go\ngo go go\n")))
    assert f["neighbours_equal"] == 1 and f["repeated_lines"] == 0.5 and f["distinct_words"] == pytest.approx(1 / 6)
