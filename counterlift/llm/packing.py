"""Packing of token pieces into sequences by bounded-space online best-fit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import slices, string_column, gives_back
from counterlift.llm.tokenize import worker_encoder

CAPACITY = 4096
OPEN_BINS = 128
ROWS_AT_ONCE = 256
GROUP_BYTES = 16 << 20  # text per packing group, about 1,400 full sequences: the bound on open bins is reached


class BestFit:
    """Open bins in a bitset keyed by free space: bit s is set while a bin with s free places is open.

    An item goes to the open bin with the least space that holds it. When a bin must be opened
    beyond ``most``, the fullest one closes; a bin without space closes by itself.
    """

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.spaces = 0
        self.bins: dict[int, deque[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        held = self.bins[space]
        found = held.popleft()
        if not held:
            del self.bins[space]
            self.spaces &= ~(1 << space)
        self.n_open -= 1
        return found

    def _put(self, space: int, which: int) -> None:
        if space:
            self.bins.setdefault(space, deque()).append(which)
            self.spaces |= 1 << space
            self.n_open += 1

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to ``capacity`` places."""
        fitting = self.spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            which = self._take(space)
        else:
            if self.n_open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, which = self.capacity, self.n_bins
            self.n_bins += 1
        self._put(space - size, which)
        return which, self.capacity - space


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def _pieces(vocabulary: str, end_id: int, glue: bool, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, glue)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder.encode([t or "" for t in string_column(part, "text").to_pylist()])
                rows = []
                for doc_id, x in zip(string_column(part, "doc_id").to_pylist(), ids, strict=True):
                    x = np.append(x, np.uint32(end_id))
                    for k, lo in enumerate(range(0, len(x), capacity)):
                        cut = x[lo : lo + capacity]
                        rows.append((doc_id, k, lo, len(cut), cut.astype("<u2" if cut.max() < 65536 else "<u4").tobytes()))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return run


_PACKED = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"


def _pack(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, BestFit(capacity, most)
        # a batch of long pieces is large, and its ids are widened: few rows at a time
        for batch in (whole.slice(lo, ROWS_AT_ONCE) for whole in batches for lo in range(0, whole.num_rows, ROWS_AT_ONCE)):
            seq, off = [], []
            for g, n in zip(string_column(batch, "grp").to_pylist(), string_column(batch, "length").to_pylist(), strict=True):
                if g != group:
                    group, bins = g, BestFit(capacity, most)
                which, at = bins.add(n)
                seq.append((g << 32) + which)
                off.append(at)
            raw = string_column(batch, "ids")
            wide = [np.frombuffer(r.as_buffer(), f"<u{len(r.as_buffer()) // n}").astype("<u4").tobytes() for r, n in zip(raw, string_column(batch, "length").to_pylist(), strict=True)]
            kept = [string_column(batch, c) for c in ("doc_id", "piece", "start", "length")]
            yield pa.record_batch(
                [kept[0], kept[1].cast(pa.int32()), kept[2], kept[3], pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(wide, pa.binary())],
                names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"],
            )

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, glue: bool = False, capacity: int = CAPACITY, most: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset and ids (little-endian unsigned 32-bit) per piece.

    Each row is encoded and ``end_id`` appended; only rows longer than ``capacity`` are cut, into
    full pieces and a rest. Pieces are dealt by hash to groups of about GROUP_BYTES of text and
    each group is packed online in doc_id order, so the waste is at most one half-full sequence
    per group besides what best-fit leaves. sequence_id holds the group and the bin. A null or
    empty text is the end id alone; rows that repeat are packed as often; a null doc_id is packed
    like any other. Texts are encoded whole, however long. Other columns are ignored; an empty table
    gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = d.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    groups = max(1, -(-int(held) // GROUP_BYTES))
    pieces = d.mapInArrow(gives_back(_pieces(vocabulary, end_id, glue, capacity)), "doc_id long, piece long, start long, length long, ids binary")
    placed = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    dealt = placed.repartition(groups, "grp").sortWithinPartitions("grp", "doc_id", "piece", "ids")
    return dealt.mapInArrow(gives_back(_pack(capacity, most)), _PACKED)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
