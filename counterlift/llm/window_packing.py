"""Packing of freely cut token runs by bounded-space online best-fit over open windows.

Every partition keeps a fixed number of open windows. A run goes into the window with the least
free space that holds it; when none does and no more may open, the fullest window is emitted. At
the end of a partition its leftover windows are merged. Sequences are full, or as long as a power
of two, or at most ``least_cut - 1`` tokens short of full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import gives_back, slices, string_column
from counterlift.llm.tokenize import worker_encoder

CAPACITY = 2048
OPEN_WINDOWS = 256
LEAST_CUT = 8  # a gap of fewer tokens is padded, not filled by cutting a run

Run = tuple[object, int, int]  # a document, its first token here, the number of tokens
Sequence = list[Run]


class OpenWindows:
    """The open windows of a partition; ``add`` and ``finish`` return the sequences they emit."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.capacity, self.most, self.least_cut = capacity, most, least_cut
        self.free: list[tuple[int, int]] = []  # (free space, window), ascending
        self.held: dict[int, Sequence] = {}
        self.opened = 0

    def _put(self, free: int, window: int, out: list[Sequence]) -> None:
        if free:
            insort(self.free, (free, window))
        else:
            out.append(self.held.pop(window))

    def add(self, doc: object, n: int) -> list[Sequence]:
        """Places the tokens 0 to ``n`` of a document, at most ``capacity``."""
        out: list[Sequence] = []
        start = 0
        while start < n:
            rest = n - start
            at = bisect_left(self.free, (rest, -1))
            if at < len(self.free):
                free, window = self.free.pop(at)
            elif len(self.free) < self.most:
                free, window = self.capacity, self.opened
                self.held[window] = []
                self.opened += 1
            else:  # none fits: the fullest goes, filled with the head of the run where that is worth a cut
                free, window = self.free.pop(0)
                if free < self.least_cut:
                    out.append(self.held.pop(window))
                    continue
                rest = free
            self.held[window].append((doc, start, rest))
            start += rest
            self._put(free - rest, window, out)
        return out

    def finish(self) -> list[Sequence]:
        """Merges the open windows: longest runs first by best-fit, then the emptiest fill up the fullest;
        what remains of the last is cut at powers of two."""
        runs = sorted((r for w in self.held.values() for r in w), key=lambda r: -r[2])
        merged = OpenWindows(self.capacity, len(runs) + 1, self.least_cut)
        out = [s for doc, start, n in runs for s in merged._whole(doc, start, n)]
        order = [(free, merged.held[w]) for free, w in merged.free]
        lo, hi = 0, len(order) - 1
        while lo <= hi:
            free, into = order[lo]
            lo += 1
            while free >= self.least_cut and lo <= hi:
                doc, start, n = order[hi][1].pop()
                take = min(n, free)
                into.append((doc, start, take))
                free -= take
                if take < n:
                    order[hi][1].append((doc, start + take, n - take))
                elif not order[hi][1]:
                    hi -= 1
            out.extend([into] if free < self.least_cut else _powers_of_two(into))
        self.free, self.held = [], {}
        return out

    def _whole(self, doc: object, start: int, n: int) -> list[Sequence]:
        """Places a run uncut, in a window of its own if none fits."""
        out: list[Sequence] = []
        at = bisect_left(self.free, (n, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            free, window = self.capacity, self.opened
            self.held[window] = []
            self.opened += 1
        self.held[window].append((doc, start, n))
        self._put(free - n, window, out)
        return out


def _powers_of_two(runs: Sequence) -> list[Sequence]:
    """Sequences as long as the powers of two that make up the length of ``runs``, the largest first."""
    left = sum(n for _, _, n in runs)
    runs, out = list(reversed(runs)), []
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        made: Sequence = []
        while size:
            doc, start, n = runs.pop()
            take = min(n, size)
            made.append((doc, start, take))
            size -= take
            if take < n:
                runs.append((doc, start + take, n - take))
        out.append(made)
    return out


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


def _pack(vocabulary: str, end_id: int, glue: bool, capacity: int, most: int, least_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, glue)
        windows = OpenWindows(capacity, most, least_cut)
        first = TaskContext.get().partitionId() << 32  # sequences of a partition follow each other from here
        made = 0

        def rows(sequences: list[Sequence]) -> Iterator[tuple]:
            nonlocal made
            for sequence in sequences:
                offset = 0
                for (doc_id, total, before, ids), start, n in sequence:
                    yield doc_id, before + start, n, total, first + made, offset, ids[start : start + n].tobytes()
                    offset += n
                made += 1

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _OUT, strict=True)], schema=_OUT)

        for batch in batches:
            for part in slices(batch, "text"):
                found = encoder.encode([t or "" for t in string_column(part, "text").to_pylist()])
                held = []
                for doc_id, ids in zip(string_column(part, "doc_id").to_pylist(), found, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    full = len(ids) - len(ids) % capacity
                    held.extend(rows([[((doc_id, len(ids), 0, ids), lo, capacity)] for lo in range(0, full, capacity)]))
                    held.extend(rows(windows.add((doc_id, len(ids), full, ids[full:].copy()), len(ids) - full)))
                if held:
                    yield batch_of(held)
        if held := list(rows(windows.finish())):
            yield batch_of(held)

    return run


def pack_windows(
    docs: DataFrame, vocabulary: str, end_id: int, glue: bool = False, capacity: int = CAPACITY, most: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit) per piece.

    Each row is encoded whole and ``end_id`` appended; every id lies in exactly one piece. Partitions
    are packed as they come, without a shuffle, so memory is ``most`` windows and the texts at hand,
    whatever the text; sequence_id holds the partition and the sequence. A long document fills whole
    sequences and only its rest is placed. Documents in open windows keep their ids in memory, at
    most ``most * capacity`` documents. A null or empty text is the end id alone; rows that repeat
    are packed as often; a null doc_id is packed like any other. Other columns are ignored; an
    empty table gives an empty result. Pieces of a document may lie in different sequences.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return d.mapInArrow(gives_back(_pack(vocabulary, end_id, glue, capacity, most, least_cut)), shape)


@query("op12_window_packing")
def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_windows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
