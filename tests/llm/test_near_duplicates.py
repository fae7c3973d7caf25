"""Jaccard join, cap filters and decontamination against brute force."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from counterlift.llm import jaccard_join
from counterlift.llm.cap_filters import near_duplicate_vectors
from counterlift.llm.decontamination import benchmark_passages
from counterlift.llm.jaccard_join import jaccard_components
from counterlift.llm.textarrays import pack, unpack

SPACE = "\t\n\x0b\x0c\r "


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in SPACE else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def varied(rng, n):
    """Texts in families: each member changes some words of its family's text."""
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n // 6):
        base = rng.choices(words, k=rng.choice([3, 6, 20, 60, 150]))
        for _ in range(6):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", " \t "]).join(t).upper() if rng.random() < 0.2 else " ".join(t))
    return out


DOCS = "doc_id long, text string, component string, node long"


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(5)
    texts = varied(rng, 180) + [None, "", "  \n", "one", "ONE", "nbsp stays one word", "É é"]
    rows = [(i * 7, t, "x", 1) for i, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t, _, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_large_group_of_near_copies(spark):
    """More near copies than a block holds: blocks meet, and no link is lost."""
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[: i % 90] + [f"x{i}"] + base[i % 90 + 1 :]), "", 0) for i in range(700)]
    got = jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 700


def test_jaccard_edges(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(f"v{i % 5000}" for i in range(200_000))
    rows = [(3, long, "", 0), (2, long, "", 0), (2, long, "", 0), (None, long, "", 0), (9, None, None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, DOCS)).collect() if r.doc_id)
    assert got == [(2, 5000, 2), (2, 5000, 2), (3, 5000, 2), (9, 0, 9)]


VECTORS = "vec_id long, embedding array<double>, node string, size long"


def test_cap_filters_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 48))
    x = np.concatenate([base + s * rng.standard_normal(base.shape) for s in (0, 0.05, 0.15, 0.25, 0.32)])
    x[7] = x[3] * 5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    near = cos >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all()
    assert found.sum() >= 0.97 * want.sum()
    exact = components(range(len(x)), list(zip(*np.nonzero(np.triu(near)), strict=True)))
    assert all(got[i].component_id >= exact[i] and got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_cap_filters_edges(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [
        (1, [1.0, 0.0], "", 0), (2, [2.0, 0.0], "", 0), (3, None, "", 0), (4, [0.0, 0.0], "", 0), (5, [math.nan, 1.0], "", 0),
        (6, [None, 1.0], "", 0), (7, [], "", 0), (8, [1.0, 0.0, 0.0], "", 0), (9, [1.0, 0.0], "", 0), (10, [1e300, 1e-300], "", 0), (11, [math.inf, 0.0], "", 0),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    alike = {1, 2, 9, 10}
    assert got == {i: (3, 1, i == 1) if i in alike else (0, i, True) for i in range(1, 12)}


def test_cap_filters_many_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0 + (i % 400) * 1e-4], "", 0) for i in range(1200)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1199, 0)}


def test_decontamination_finds_planted_passages(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([7, 9, 12, 20, 33, 47, 60, 90, 200])]
    docs, planted = [], set()
    for d in range(120):
        text = rng.choices(words, k=rng.choice([30, 100, 400]))
        if d % 2:
            k = d % len(items)
            at = rng.randrange(len(text))
            passage = items[k][1].split()
            if d % 4 == 3 and len(passage) >= 45:
                passage[len(passage) // 2] = "changed"
            text[at:at] = passage
            planted.add((d, k))
        docs.append((d, " ".join(text), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, "short", "x"), (503, items[4][1].upper(), "x"), (None, items[4][1], "x")]
    planted |= {(503, 4), (None, 4)}
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short x"), (None, items[3][1])], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = benchmark_passages(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    assert all(r.similarity >= 0.75 for r in got)


def test_decontamination_equals_brute_force(spark):
    """Every item against every window of its length, by the similarity of their shingles."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 24, 40, 70])]
    docs = []
    for d in range(80):
        text = rng.choices(words, k=rng.choice([20, 80, 200]))
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items[3:])[1].split()
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = rng.choice(words)
            at = rng.randrange(len(text))
            text[at:at] = passage
        docs.append((d, " ".join(text)))
    got = {(r.doc_id, r.item_id) for r in benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def shingles(x):
        return {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))}

    want, allowed = set(), set()
    for d, text in docs:
        x = text.split()
        for k, item in items:
            y = item.split()
            s = shingles(y)
            best = max((len(s & t) / len(s | t) for i in range(len(x) - len(y) + 1) for t in [shingles(x[i : i + len(y)])]), default=0)
            if best >= 0.75:
                want.add((d, k))
            if best >= 0.55:  # weights of rare words may lift a window over the limit
                allowed.add((d, k))
    assert len(want & got) >= 0.99 * len(want) and got <= allowed
    assert {(d, k) for d, k in want if k < 7} <= got


def test_decontamination_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_passages(docs, none).collect() == []
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert benchmark_passages(docs.limit(0), bench).collect() == []
    assert [(r.doc_id, r.item_id, r.similarity) for r in benchmark_passages(docs, bench).collect()] == [(1, 1, 1.0)]


def _random_texts(n, words, seed):
    rng = random.Random(seed)
    return pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": [" ".join(f"w{rng.randrange(500)}" for _ in range(words)) for _ in range(n)]})


def test_jaccard_tables_on_disk_are_small():
    """A task's counts and prefix entries, which are written and shuffled, as parts of the texts' bytes."""
    batch = _random_texts(2000, 300, 8)
    text = sum(len(t) for t in batch.column("text").to_pylist())
    digest = pa.Table.from_batches(jaccard_join._digest(5)(iter([batch])))
    counts = pa.Table.from_batches([digest.filter(digest["chunk"].is_valid()).combine_chunks().to_batches()[0]])
    assert sum(len(c) for c in counts["counts"].to_pylist()) < text  # 16 MB before
    total = np.zeros(1 << jaccard_join.COUNT_BITS, np.uint32)
    for c, raw in zip(counts["chunk"].to_pylist(), counts["counts"].to_pylist(), strict=True):
        total[c << jaccard_join.CHUNK_BITS : (c + 1) << jaccard_join.CHUNK_BITS] = unpack(raw, 1 << jaccard_join.CHUNK_BITS, [4])[0]
    assert total.sum() == sum(len(shingles(t)) for t in batch.column("text").to_pylist())
    often = SimpleNamespace(value=np.full_like(total, 2))
    entries = pa.Table.from_batches(jaccard_join._prefixes(5, 75, often)(iter([batch])))
    n = sum(entries["size"].to_pylist())
    assert n == sum(int(jaccard_join.prefix_length(np.int64(len(shingles(t))), 75)) for t in batch.column("text").to_pylist())
    assert sum(len(e) for e in entries["entries"].to_pylist()) < 16 * n  # 20 bytes an entry before, 32 as a row


def test_packed_columns_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 700):
        a, b = rng.integers(0, 1 << 40, n).astype(np.uint64), rng.integers(0, 1 << 32, n).astype(np.uint32)
        got = unpack(pack([(a, 5), (b, 4)]), n, [5, 4])
        assert (got[0] == a).all() and (got[1] == b).all()


def test_entries_that_meet_equal_brute_force(monkeypatch):
    """Packed entries of several tasks: those with a partner they may link with come out, once for a set."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    rng = random.Random(6)
    low = (1 << jaccard_join.SHORT_BITS) - 1
    grams = [rng.getrandbits(jaccard_join.SHORT_BITS) for _ in range(40)]
    hot = grams[0]
    size = {k: rng.choice([20, 22, 30, 60]) for k in (rng.getrandbits(40) for _ in range(60))}
    rows = [(g, k, rng.randrange(size[k] // 4), size[k]) for g in grams for k in rng.sample(list(size), rng.choice([1, 2, 5]))]
    rows = [r for r in rows if r[0] != hot] + [(hot, k, 0, n) for k, n in size.items()]
    tasks = [rows[0::2], rows[1::2], rows[:20]]  # some twice
    batches = [jaccard_join._packed([tuple(np.array(c, t) for c, t in zip(zip(*x, strict=True), ("u8", "u8", "u4", "u4"), strict=True))]) for x in tasks]
    table = pa.Table.from_batches(batches).sort_by("slot")
    got = [r for b in jaccard_join._meetings(75)(iter(table.combine_chunks().to_batches())) for r in b.to_pylist()]

    def may(x, y):
        need = jaccard_join.least_overlap(x[3] + y[3], 75)
        return 100 * min(x[3], y[3]) >= 75 * max(x[3], y[3]) and 1 + min(x[3] - x[2] - 1, y[3] - y[2] - 1) >= need

    want = {(r[0] & low, r[1], r[2]) for r in rows if r[0] == hot or any(x[0] == r[0] and x[1] != r[1] and may(x, r) for x in rows)}
    assert sorted((r["gram"], r["short"], r["pos"]) for r in got) == sorted(want)
    assert {r["n_blocks"] for r in got if r["gram"] == hot} == {8} and {r["n_blocks"] for r in got if r["gram"] != hot} == {1}


def test_jaccard_blocks_of_verification_meet(spark, monkeypatch):
    """With many small blocks no link is lost and none is made up."""
    monkeypatch.setattr(jaccard_join, "VERIFIED_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[: i % 90] + [f"x{i}"] + base[i % 90 + 1 :]), "", 0) for i in range(150)]
    rows += [(1000 + i, " ".join(f"c{i}-{k}" for k in range(60)), "", 0) for i in range(50)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _, _, _ in rows}
