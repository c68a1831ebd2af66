import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyguard.llm import bpe, packing
from tests.llm.cases import table, texts

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "  ", "<|endoftext|> a<|startoftext|>B it's I'LL 'S ’s", "ΑΣ ΟΔΟΣ. İstanbul ǅ", "a\x1cb \x85 \xa0z y​q", "١٢٣ ² ½ Ⅷ 12ab_cd--ef", "a" * 3000,
       "日本語テキスト 한국어 \U0001F600\U0001F601x", "\x00\x01 a\tb\r\n", "é ́e Å̧"]


def random_texts(count=150):
    rng = random.Random(3)
    spans = ((32, 127), (0x80, 0x600), (0x600, 0xD7FF), (0x10000, 0x1FFFF))
    known = lambda: next(c for c in iter(lambda: chr(rng.randrange(*rng.choice(spans))), None)
                         if unicodedata.category(c) != "Cn" and (c < "\u0700" or not unicodedata.combining(c)))
    return ["".join(known() for _ in range(200)) for _ in range(count)]


def test_encoder_equals_the_library():
    mine = bpe.encoder(PATH)
    for text in [*ODD, *random_texts(), *[t or "" for _, t in texts()]]:
        want = LIBRARY.encode(text, add_special_tokens=False)
        ids, decoded = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert decoded.decode() == LIBRARY.decode(want.ids, skip_special_tokens=False)
        assert packing.library(PATH).encode(text) == ids


def test_the_table_of_runs_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_RUNS", 50)
    monkeypatch.setattr(packing, "KEPT_RUNS", 50)
    mine, lib = bpe.WordBpe(PATH), packing.LibraryEncoder(PATH)
    for at in range(0, 400, 20):
        text = " ".join(f"run{k}" for k in range(at, at + 60))
        assert mine.encode(text)[0] == lib.encode(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(mine.runs) <= 50 and len(lib.runs) <= 60


def test_encode_documents(spark):
    rows = texts()
    found = bpe.encode_documents(table(spark)).collect()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert bpe.encoder(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert sorted(map(str, (tuple(r)[:4] for r in found))) == sorted(map(str, want))
    assert all(len(r.ids) == r.n_tokens for r in found)
    assert bpe.encode_documents(table(spark, [])).count() == 0


@pytest.mark.parametrize("group", [20_000, 5])
def test_packing_holds_every_piece_once(spark, group):
    rows = [(i if i is None else k, t) for k, (i, t) in enumerate(texts())]
    found = packing.pack_documents(table(spark, rows), group=group, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, (i, t) in enumerate(rows):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [packing.SEPARATOR]
        if i is not None:
            pieces = sorted(by_doc[i], key=lambda r: r.piece)
            assert [x for p in pieces for x in p.ids] == ids and all(p.length == 4096 for p in pieces[:-1])
            assert [p.start for p in pieces] == list(range(0, len(ids), 4096)) and [p.piece for p in pieces] == list(range(len(pieces)))
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert len(by_doc[None]) == 2
    if group == 20_000:
        assert len(by_seq) <= -(-sum(r.length for r in found) // 4096) + 1
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_local_search_beats_its_start_and_nears_the_bound():
    rng = random.Random(5)
    sizes = [min(4096, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(4000)]
    bins = packing.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(4000)) and max(sum(sizes[i] for i in b) for b in bins) <= 4096
    assert len(bins) <= -(-sum(sizes) // 4096) + 1
    hard = [60] * 20 + [50] * 40 + [40] * 20 + [30] * 20 + [20] * 20
    start = packing.Bins(hard, 100)
    before, squares = sum(1 for x in start.items if x), sum((100 - r) ** 2 for r in start.room)
    start.improve(500)
    assert sum(1 for x in start.items if x) <= before and sum((100 - r) ** 2 for r in start.room) >= squares
    assert packing.pack([]) == [] and packing.pack([4096, 4096, 1]) and packing.pack([7, 3, 3, 4, 2, 2], 7) and len(packing.pack([5, 4, 4, 3, 2, 2, 2, 2], 8)) == 3


@pytest.mark.parametrize("low, high, limit, count", [(900, 1300, 4096, 150), (20, 60, 100, 90), (1, 40, 400, 400), (1100, 1900, 4096, 120)])
def test_local_search_ends_only_where_no_step_is_left(low, high, limit, count):
    for seed in range(4):
        rng = random.Random(seed)
        bins = packing.Bins([rng.randint(low, high) for _ in range(count)], limit)
        bins.improve()
        used = [b for b, x in enumerate(bins.items) if x]
        if len(used) <= -(-sum(s for x in bins.items for s, _ in x) // limit):
            continue
        for a, b in ((a, b) for a in used for b in used if a != b and 0 < bins.room[b] <= bins.room[a]):
            sizes = [s for s, _ in bins.items[a]]
            gains = {*sizes, *(x + y for k, x in enumerate(sizes) for y in sizes[:k])}
            assert not any(s <= bins.room[b] for s in sizes)
            assert not any(0 < g - t <= bins.room[b] for g in gains for t, _ in bins.items[b])
