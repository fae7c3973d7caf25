"""Bounded-space packing: every id once, sequences gapless, little padding."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from counterlift.llm.window_packing import OpenWindows, pack_windows

WORDS = public_tokenizers.path("word_bpe_49k.json")


def _sequences(sizes, **options):
    windows = OpenWindows(**options)
    out, most = [], 0
    for doc, n in enumerate(sizes):
        out += windows.add(doc, n)
        most = max(most, len(windows.free))
    assert most <= windows.most
    return out + windows.finish()


def test_every_token_once_and_lengths_allowed():
    rng = random.Random(1)
    for least_cut in (1, 4):
        for n in (0, 1, 7, 300):
            sizes = [rng.randint(1, 63) for _ in range(n)]
            out = _sequences(sizes, capacity=64, most=5, least_cut=least_cut)
            seen = sorted((doc, i) for s in out for doc, start, m in s for i in range(start, start + m))
            assert seen == [(doc, i) for doc, m in enumerate(sizes) for i in range(m)]
            for s in out:
                size = sum(m for _, _, m in s)
                assert size > 64 - least_cut or size & (size - 1) == 0


def test_best_fit_takes_the_tightest_window():
    windows = OpenWindows(10, 4, 1)
    assert windows.add("a", 4) == []
    assert windows.add("b", 7) == []
    assert windows.add("c", 3) == [[("b", 0, 7), ("c", 0, 3)]]
    assert windows.add("d", 6) == [[("a", 0, 4), ("d", 0, 6)]]


def test_the_fullest_is_emitted_when_none_fits():
    windows = OpenWindows(10, 2, 2)
    windows.add("a", 6)
    windows.add("b", 8)
    assert windows.add("c", 9) == [[("b", 0, 8), ("c", 0, 2)]]  # then 7 of c open a new window
    assert windows.add("d", 5) == [[("c", 2, 7), ("d", 0, 3)]]
    windows = OpenWindows(10, 1, 3)
    windows.add("a", 8)
    assert windows.add("c", 9) == [[("a", 0, 8)]]  # a gap of two is padded


def test_packed_documents_equal_the_library(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta's", "GAMMA", "naïve", "日本", "42", "...", "<|endoftext|>", "x"]
    texts = [None, "", " ", "\n\t", " ".join(rng.choice(words) for _ in range(9000))] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    rows = [(i, t, "length", 0) for i, t in enumerate(texts)] + [(7, texts[7], "length", 0), (None, "no id", "start", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, sequence_id int").repartition(3)
    got = pack_windows(docs, WORDS, 1, capacity=256, most=8).collect()
    tok = Tokenizer.from_file(WORDS)
    want = sorted((str(i), [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows)
    pieces = {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    found = []
    for (doc_id, n), parts in pieces.items():
        if doc_id == 7:  # twice the same row
            assert sum(len(x) for _, x in parts) == 2 * n
            whole = dict(sorted(((s + k, t) for s, x in parts for k, t in enumerate(x))))
            found += [(str(doc_id), [whole[k] for k in range(n)])] * 2
            continue
        at, ids = 0, []
        for start, x in sorted(parts):
            assert start == at
            at += len(x)
            ids += x
        assert at == n
        found.append((str(doc_id), ids))
    assert sorted(found) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 256 and (at > 256 - 8 or at & (at - 1) == 0)


def test_empty_table(spark):
    assert pack_windows(spark.createDataFrame([], "doc_id long, text string"), WORDS, 1).collect() == []
