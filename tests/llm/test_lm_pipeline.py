import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyguard.llm import exact_dedup, maxent_lm, near_dedup, quality_rules, secret_scan
from tallyguard.llm.common import documents, staged
from tallyguard.llm.textnp import hashes_and_heads, mix
from tests.llm.cases import ascii_lower, near_groups, table, texts

SMALL = "/root/testdata/sf0.001"


def base(rows):
    key = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    counts = Counter()
    for i, t in rows:
        if i is None or key(i) != 1:
            counts.update([*ascii_lower(t).split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*ascii_lower(t).split(), None]
        yield str(i), i is not None and key(i) == 1, len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), 6)


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_base_scores_match_counting(spark, frequent):
    rows = texts()
    found = maxent_lm.score_documents(table(spark), frequent=frequent).collect()
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, base(rows)))
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_scores_without_documents_or_training(spark):
    assert maxent_lm.score_documents(table(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = maxent_lm.score_documents(table(spark, [(held, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_probabilities_of_a_history_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(maxent_lm.LEVELS, maxent_lm.TABLE, maxent_lm.WAYS)).astype(np.float32)
    leaves = np.arange(maxent_lm.LEAVES)
    for one in rng.integers(0, 2 ** 63, (5, 3)).astype(np.uint64):
        history = np.repeat(one[:, None], maxent_lm.LEAVES, axis=1)
        assert abs(np.exp(maxent_lm.log_chances(weights, history, leaves)).sum() - 1) < 1e-3


def test_start_weights_are_shares_of_the_nodes():
    counts = np.random.default_rng(3).integers(0, 50, maxent_lm.LEAVES).astype(float)
    start = maxent_lm.start_of(counts)
    for level in range(maxent_lm.LEVELS):
        bias = start[level, maxent_lm.BUCKETS:maxent_lm.BUCKETS + maxent_lm.WAYS ** level]
        assert np.allclose(np.exp(bias).sum(axis=1), 1, atol=1e-5) and not start[level, :maxent_lm.BUCKETS].any()


def test_update_is_the_gradient_of_the_log_likelihood():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(maxent_lm.TABLE, maxent_lm.WAYS)).astype(np.float32)
    rows, way = rng.choice(np.array([3, 5, 8, 13], np.uint16), (40, 4)), rng.integers(0, maxent_lm.WAYS, 40)
    loss = lambda w: -sum((z := w[r].sum(axis=0))[y] - np.log(np.exp(z).sum()) for r, y in zip(rows, way))
    moved, seen, used = weights.copy(), np.zeros(maxent_lm.TABLE, np.float32), np.zeros(maxent_lm.TABLE, np.int64)
    maxent_lm.update(moved, seen, used, rows, way)
    wide = weights.astype(float)
    for row in (3, 5, 8, 13):
        want = np.zeros(maxent_lm.WAYS)
        for k in range(maxent_lm.WAYS):
            up = wide.copy()
            up[row, k] += 1e-5
            want[k] = (loss(up) - loss(wide)) / 1e-5
        step = maxent_lm.RATE / np.sqrt((want ** 2).mean()) * want
        assert np.allclose(weights[row] - moved[row], step, atol=1e-3) and used[row] == (rows == row).sum()
    assert (moved != weights).any(axis=1).sum() == 4


def test_features_do_not_cross_texts():
    _, _, hashes, target, starts = next(maxent_lm.blocks([(0, b"a b"), (1, b""), (2, b"a b c")]))
    feats = maxent_lm.features(hashes, starts).T
    assert starts.tolist() == [0, 3, 4] and target.tolist().count(0) == 3
    assert (feats[0] == feats[3]).all() and (feats[0] == feats[4]).all() and (feats[1] == feats[5]).all() and (feats[2] == feats[6]).all()


def plain_scores(weights, rows, training):
    """Scores token by token with dictionaries and plain sums, given the weights."""
    path = lambda w: 0 if w is None else int(maxent_lm.leaves_of(*hashes_and_heads(w))[0])
    number = lambda w: maxent_lm.START if w == "start" else hashes_and_heads(w[1])[0][0]
    counts = Counter(x for t in training for x in [*ascii_lower(t).split(), None])
    held, kinds = Counter(), Counter()
    for x, k in counts.items():
        held[path(x)] += k
        kinds[path(x)] += 1
    for i, t in rows:
        words, total = ascii_lower(t).split(), 0.0
        for k, x in enumerate([*words, None]):
            one, two = (("w", words[k - j]) if k >= j else "start" for j in (1, 2))
            one, two = np.array([number(one)], np.uint64), np.array([number(two)], np.uint64)
            history = [mix(one), mix(mix(one) + two), mix(two ^ np.uint64(0xA4093822299F31D0))]
            leaf, node = path(x), 0
            for level in range(maxent_lm.LEVELS):
                salt = mix(np.array([node + (level << 32)], np.uint64))
                at = [maxent_lm.BUCKETS + node, *(int(((h ^ salt) * np.uint64(0x9E3779B97F4A7C15))[0]) >> 49 for h in history)]
                z = weights[level][at].astype(float).sum(axis=0)
                way = leaf >> 3 * (maxent_lm.LEVELS - level - 1) & 7
                total += math.log10(math.exp(z[way]) / sum(math.exp(v) for v in z))
                node = node * 8 + way
            total += math.log10((counts[x] + 0.5) / (held[leaf] + 0.5 * (kinds[leaf] + 1)))
        yield i, total


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_scores_equal_a_plain_recomputation(spark, monkeypatch, frequent):
    rng, fitted, train = random.Random(4), [], maxent_lm.train
    monkeypatch.setattr(maxent_lm, "train", lambda texts, start: fitted.append(train(texts, start)) or fitted[-1])
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "é", "mats", f"w{i % 7}", f"x{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(40)]
    got = {r.doc_id: r for r in maxent_lm.score_documents(table(spark, rows), frequent=frequent).collect()}
    training = [t for i, t in rows if not got[i].held_out]
    want = dict(plain_scores(fitted[0], rows, training))
    assert len(want) == 40 and all(abs(got[i].score - x) < 1e-3 for i, x in want.items())
    assert np.abs(fitted[0][:, :maxent_lm.BUCKETS]).max() > 0.1  # history has been learned


def test_history_tells_words_of_one_class_apart(spark):
    """Two words of one class (equal first bytes), each after a word of its own."""
    a, b = next((f"abc{i}", f"abc{j}") for i in range(9) for j in range(9)
                if maxent_lm.leaves_of(*hashes_and_heads(f"abc{i} abc{j}".encode())).tolist() != [maxent_lm.leaves_of(*hashes_and_heads(f"abc{i}".encode()))[0]] * 2)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice([f"left {a}", f"right {b}"]) for _ in range(200))) for i in range(400)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows += [(held[0], f"left {a} right {b}"), (held[1], f"left {b} right {a}")]
    got = {r.doc_id: r.score for r in maxent_lm.score_documents(table(spark, rows)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_model_learns_and_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(8)
    kinds = [[f"{p}{k}" for k in range(30)] for p in ("qua", "bro", "mis", "zet")]
    rows = [(i, " ".join(rng.choice(kinds[i % 4]) for _ in range(120))) for i in range(400)]
    held = [r for r in maxent_lm.score_documents(table(spark, rows)).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert len(held) > 40 and sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.3


def test_held_out_scores_on_given_documents(spark):
    found = [r for r in maxent_lm.op4_maxent_lm(spark, SMALL).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_each_stage_against_a_plain_version(spark):
    docs = documents(spark, SMALL)
    whole = docs.collect()
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"]

    verdict = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    clean = staged(stage["quality"](spark, docs, SMALL))
    kept = clean.collect()
    assert clean.columns == docs.columns and {r.doc_id for r in kept} == {i for i, v in verdict.items() if v.kept} and len(kept) < len(whole)
    assert all(r.text == verdict[r.doc_id].clean_text and r.n_chars == len(r.text) for r in kept)

    exact = staged(stage["exact"](spark, clean, SMALL))
    left = exact.collect()
    last = {}
    for r in kept:
        last[ascii_lower(r.text)] = max(r.doc_id, last.get(ascii_lower(r.text), -1))
    assert exact.columns == docs.columns and {r.doc_id for r in left} == set(last.values()) and len(left) < len(kept)

    near = staged(stage["near"](spark, exact, SMALL))
    rows = [(r.doc_id, r.text) for r in left]
    firsts = {min(rows[k][0] for k in g) if n else i for (i, _), (n, g) in zip(rows, near_groups(rows, 5))}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == firsts

    masked = staged(stage["secrets"](spark, near, SMALL))
    before = {r.doc_id: r for r in near.collect()}
    after = masked.collect()
    assert masked.columns == docs.columns and {r.doc_id for r in after} == set(before)
    for r in after:
        assert r.text == secret_scan.redacted(before[r.doc_id].text, "[SECRET]") and not secret_scan.find_spans(r.text)

    packed = stage["packing"](spark, masked, SMALL).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_run_equals_its_stages(spark):
    docs = documents(spark, SMALL)
    for _, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, SMALL))
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(docs)


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in ([], texts()):
        docs = table(spark, rows)
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = staged(f(spark, docs, SMALL))
            assert out.columns == docs.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0) == bool(rows)
    assert exact_dedup.drop_copies(table(spark)).count() and near_dedup.one_of_each(table(spark)).count()


def test_model_has_the_size_the_readme_names():
    with open(os.path.join(os.path.dirname(corpus_pipeline.__file__), "README.md")) as f:
        text = f.read()
    assert maxent_lm.CLASSES >= 64 and f"({maxent_lm.CLASSES} classes, {maxent_lm.BUCKETS:,} feature rows" in text
