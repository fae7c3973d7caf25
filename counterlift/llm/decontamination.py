"""Benchmark decontamination by SimHash of item-sized windows.

Items fall into classes by length; a class has one window length W. Every document's windows
of W words at stride STRIDE get a 128-bit SimHash over weighted words; each item is entered
with the windows at its first STRIDE offsets, so one of them lines up with a document window
wherever the passage starts. A multi-index of eight 16-bit blocks, each entered with all keys
at distance two or less, returns every entry within RADIUS = 23 bits (24 differing bits need
three in some block). Candidates are verified by the weighted Jaccard similarity of five-word
shingles between the item and the document's words at the item's place. Items of fewer than
LEAST_WORDS words have at most two shingles, so only their exact words reach the similarity; they
are found by the hash of every run of as many words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import _MULT, U64, Words, mix, slices, string_column, gives_back

STRIDE = 4
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
WIDTH = 5
LEAST_WORDS = 7  # of an item that is searched by fingerprints; shorter ones are searched by their exact words
ITEMS_AT_ONCE = 2000  # items whose index is broadcast together, about 60 MB
CHUNK_GROUPS = 8192
_SALT = mix(np.arange(1, 4, dtype=U64) * _MULT)
_FLIPS = np.array([sum(1 << i for i in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)], np.int64)


def window_length(n_words: int) -> int:
    """W of an item: the largest of 4, 8, 12, 16, 24, 32, 48, 64, 96, ... that leaves room for STRIDE offsets."""
    room, best, step = n_words - STRIDE + 1, 4, 4
    while step <= room:
        best = step
        step = step + 4 if step < 16 else step * 3 // 2 if (step & (step - 1)) == 0 else step * 4 // 3
    return best


@dataclass
class ItemIndex:
    """Items of one broadcast: word weights, and by window length the multi-index."""

    item_ids: list[int]
    shingles: list[np.ndarray]
    weights: list[np.ndarray]
    lengths: np.ndarray
    vocabulary: np.ndarray
    word_weight: np.ndarray
    rare: int
    classes: dict[int, tuple] = field(default_factory=dict)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by words: sorted hashes and their items

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """Weight of each word: 1 for those in most items, up to ``rare`` for those in none."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, self.word_weight[at], self.rare).astype(np.int8)


def sign_rows(words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """128 signed weights per word."""
    pair = np.stack((mix(words ^ _SALT[0]), mix(words ^ _SALT[1])), 1)
    bits = np.unpackbits(np.ascontiguousarray(pair).view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1) * weight[:, None]


def group_sums(words: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums, by groups of STRIDE words at ``start``, of the words' signed weights.

    Sums wrap at 16 bits; their differences over a window of less than 8192 words are exact.
    """
    at = (start[:, None] + np.arange(STRIDE)).ravel()
    sums = sign_rows(words[at], weight[at]).reshape(len(start), STRIDE, -1).sum(1, dtype=np.int16)
    run = np.zeros((len(start) + 1, sums.shape[1]), np.int16)
    np.cumsum(sums, axis=0, dtype=np.int16, out=run[1:])
    return run


def fingerprints(run: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the window of ``length`` words from each group on, as two 64-bit numbers."""
    k = length // STRIDE
    return np.packbits((run[k:] - run[:-k]) > 0, axis=1).view(np.uint64)


def shingle_hashes(words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted) and their weights, the mean weight of their words."""
    n = max(1, len(words) - WIDTH + 1)
    width = min(WIDTH, len(words))
    h, w = np.zeros(n, U64), np.zeros(n)
    for k in range(width):
        h = mix(h * _MULT + words[k : k + n])
        w += weight[k : k + n] / width
    h, one = np.unique(h, return_index=True)
    return h, w[one]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard, weight of the common shingles over weight of all, or the plain one if that is larger."""
    both = np.isin(a[0], b[0], assume_unique=True)
    common, plain = float(a[1][both].sum()), int(both.sum())
    every = float(a[1].sum() + b[1].sum()) - common
    return max(common / every, plain / (len(a[0]) + len(b[0]) - plain)) if every else 0.0


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    h = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        h = mix(h * _MULT + words[k : k + len(h)])
    return h


def build_index(items: list[tuple[int, str]]) -> ItemIndex | None:
    """Index of items; those that are null or without words are left out."""
    words = Words(pa.array([t for _, t in items], pa.string()))
    h = words.hashes()
    cut = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    use = [i for i, c in enumerate(cut) if len(c)]
    if not use:
        return None
    vocabulary, often = np.unique(np.concatenate([np.unique(cut[i]) for i in use]), return_counts=True)
    rare = 4
    weight = np.clip(np.round(1 + (rare - 1) * np.log(len(use) / often) / max(np.log(len(use)), 1e-9)), 1, rare).astype(np.int8)
    out = ItemIndex([items[i][0] for i in use], [], [], np.array([len(cut[i]) for i in use]), vocabulary, weight, rare)
    by_class: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    by_words: dict[int, list[tuple[np.uint64, int]]] = {}
    for k, i in enumerate(use):
        w = out.weigh(cut[i])
        s, sw = shingle_hashes(cut[i], w)
        out.shingles.append(s)
        out.weights.append(sw)
        if len(cut[i]) < LEAST_WORDS:
            by_words.setdefault(len(cut[i]), []).append((run_hashes(cut[i], len(cut[i]))[0], k))
            continue
        length = window_length(len(cut[i]))
        prints = np.concatenate([fingerprints(group_sums(cut[i], w, np.arange(o, o + length, STRIDE)), length) for o in range(STRIDE)])
        by_class.setdefault(length, []).extend((prints[o], k, o) for o in range(STRIDE))
    for length, entries in by_class.items():
        prints = np.stack([e[0] for e in entries])
        keys = prints.view(np.uint16)
        lists = []
        for b in range(BLOCKS):
            reach = (keys[:, b].astype(np.int64)[:, None] ^ _FLIPS[None, :]).ravel()
            owner = np.repeat(np.arange(len(entries), dtype=np.int32), len(_FLIPS))
            order = np.argsort(reach, kind="stable")
            starts = np.searchsorted(reach[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)
            lists.append((starts, owner[order]))
        out.classes[length] = (prints, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), lists)
    for n, entries in by_words.items():
        entries.sort()
        out.short[n] = (np.array([h for h, _ in entries], U64), np.array([k for _, k in entries]))
    return out


def within_radius(prints: np.ndarray, entries: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(window, entry) of all fingerprints at most RADIUS bits apart."""
    keys = prints.view(np.uint16)
    found = []
    for b, (starts, owner) in enumerate(lists):
        lo = starts[keys[:, b]]
        count = starts[keys[:, b].astype(np.int64) + 1] - lo
        window = np.repeat(np.arange(len(prints)), count)
        entry = owner[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(window))]
        near = np.bitwise_count(prints[window, 0] ^ entries[entry, 0]).astype(np.int16) + np.bitwise_count(prints[window, 1] ^ entries[entry, 1])
        ok = near <= RADIUS
        found.append(window[ok] * len(entries) + entry[ok])
    both = np.unique(np.concatenate(found))
    return both // len(entries), both % len(entries)


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("similarity", pa.float64())])


def _hits(piece: pa.RecordBatch, index: ItemIndex, least: float) -> dict[tuple[int, int], tuple[float, int]]:
    words = Words(string_column(piece, "text"))
    h = words.hashes()
    best: dict[tuple[int, int], tuple[float, int]] = {}
    if not len(h):
        return best
    for n, (hashes, items) in index.short.items():
        if len(h) < n:
            continue
        run = run_hashes(h, n)
        lo, hi = np.searchsorted(hashes, run, "left"), np.searchsorted(hashes, run, "right")
        at = np.flatnonzero((hi > lo) & (words.doc[: len(run)] == words.doc[n - 1 :]))
        for p, a, b in zip(at.tolist(), lo[at].tolist(), hi[at].tolist(), strict=True):
            for k in items[a:b].tolist():
                best.setdefault((int(words.doc[p]), k), (1.0, p))
    if not index.classes:
        return {(d, k): (s, a - int(words.first[d])) for (d, k), (s, a) in best.items()}
    weight = index.weigh(h)
    ends = words.first[words.doc + 1]
    groups = words.count // STRIDE
    owner = np.repeat(np.arange(words.n_docs), groups)
    begin = words.first[owner] + STRIDE * (np.arange(len(owner)) - (np.cumsum(groups) - groups)[owner])
    longest = max(index.classes) // STRIDE
    tried: set[tuple[int, int]] = set()
    for lo in range(0, len(owner), CHUNK_GROUPS):
        hi = min(len(owner), lo + CHUNK_GROUPS + longest - 1)
        run = group_sums(h, weight, begin[lo:hi])
        for length, (entries, item, offset, lists) in index.classes.items():
            k = length // STRIDE
            n = min(CHUNK_GROUPS, hi - lo - k + 1)
            if n <= 0:
                continue
            whole = owner[lo : lo + n] == owner[lo + k - 1 : lo + k - 1 + n]
            start = begin[lo : lo + n][whole]
            if not len(start):
                continue
            window, entry = within_radius(fingerprints(run[: n + k], length)[whole], entries, lists)
            for p, k, o in zip(start[window].tolist(), item[entry].tolist(), offset[entry].tolist(), strict=True):
                doc = int(words.doc[p])
                a = max(int(words.first[doc]), p - o)
                if (a, k) in tried:
                    continue
                tried.add((a, k))
                b = min(int(ends[p]), a + int(index.lengths[k]))
                alike = similarity(shingle_hashes(h[a:b], weight[a:b]), (index.shingles[k], index.weights[k]))
                if alike >= least and (alike, -a) > (best.get((doc, k), (0.0, 0))[0], -best.get((doc, k), (0.0, 0))[1]):
                    best[doc, k] = (alike, a)
    return {(d, k): (s, a - int(words.first[d])) for (d, k), (s, a) in best.items()}


def _search(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                found = _hits(piece, index, least)
                if found:
                    ids = string_column(piece, "doc_id").to_pylist()
                    rows = [(ids[d], index.item_ids[k], a, s) for (d, k), (s, a) in sorted(found.items())]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    return run


def _without(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                clean = np.ones(piece.num_rows, bool)
                clean[[d for d, _ in _hits(piece, index, least)]] = False
                yield piece.filter(pa.array(clean))

    return run


def _indexes(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of ITEMS_AT_ONCE items after another, by id and text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    after = None
    while True:
        left = items if after is None else items.filter((F.col("item_id") > after[0]) | ((F.col("item_id") == after[0]) & (F.col("text") > after[1])))
        block = [tuple(r) for r in left.orderBy("item_id", "text").limit(ITEMS_AT_ONCE).collect()]
        index = build_index(block) if block else None
        if index is not None:
            yield index
        if len(block) < ITEMS_AT_ONCE:
            return
        after = block[-1]


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, item_id, start_word and similarity of the best match of every item in every document.

    ``benchmark`` (item_id, text) is the query set; it is taken in blocks of ITEMS_AT_ONCE items by
    id, each searched over all documents. Items that are null, without words or without id match
    nothing, as do null and empty documents; ties go to the first place. Texts are read whole, however
    long. Repeated rows are searched each by itself. A document without id is reported with a null
    one. Other columns are ignored; with empty tables the result is empty.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, similarity double"
    out = None
    for index in _indexes(benchmark):
        hits = d.mapInArrow(gives_back(_search(spark.sparkContext.broadcast(index), least)), schema)
        out = hits if out is None else out.union(hits)
    return out if out is not None else spark.createDataFrame([], schema)


def without_passages(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, each judged by its own text.

    As ``benchmark_passages``; ids play no part, so rows without id or with a repeated one are
    kept or dropped by themselves. All columns pass through.
    """
    out = docs.withColumn("text", F.col("text").cast("string"))
    schema = out.schema
    for index in _indexes(benchmark):
        out = out.mapInArrow(gives_back(_without(docs.sparkSession.sparkContext.broadcast(index), least)), schema)
    return out


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
