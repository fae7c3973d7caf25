"""Token-ID files: independent Zstandard frames with a trailing seek table and checksums.

Layout of a file: frames, each the little-endian ids of whole documents; then a skippable
frame with the file's index (doc_id, first id, number of ids per document) as one more
Zstandard frame; last the seek table of the seekable format, with a checksum per frame. A
reader of a few documents reads the tail, then only the frames that hold them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterlift.llm import graph
from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import gives_back, slices, string_column
from counterlift.llm.tokenize import worker_encoder
from counterlift.llm.warc import open_folder, place_file
from counterlift.session import cut_lineage, shared_folder

# Fixed values of the seekable format
SKIPPABLE = 0x184D2A5E
INDEX_FRAME = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 20
FILE_BYTES = 64 << 20  # text per file beyond which there are more files than shuffle partitions


def _frame_checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def write_token_file(docs: Iterator[tuple[int | None, np.ndarray]], out, width: int) -> tuple[int, int]:
    """Writes (doc_id, ids) in the order given; ``width`` is the bytes of an id. Returns (documents, ids)."""
    codec = zstandard.ZstdCompressor(level=3)
    seek: list[tuple[int, int, int]] = []
    index: list[tuple[int, int, int, int]] = []
    held: list[bytes] = []
    size, total = 0, 0

    def flush():
        nonlocal held, size
        raw = b"".join(held)
        packed = codec.compress(raw)
        out.write(packed)
        seek.append((len(packed), len(raw), _frame_checksum(raw)))
        held, size = [], 0

    for doc_id, ids in docs:
        raw = ids.astype(f"<u{width}").tobytes()
        index.append((doc_id is None, doc_id or 0, total, len(ids)))
        total += len(ids)
        held.append(raw)
        size += len(raw)
        if size >= FRAME_BYTES:
            flush()
    if held:
        flush()
    table_ = np.array(index, np.int64).reshape(-1, 4)
    packed = codec.compress(struct.pack("<II", width, len(table_)) + table_.astype("<i8").tobytes())
    out.write(struct.pack("<II", INDEX_FRAME, len(packed)) + packed)
    seek.append((8 + len(packed), 0, _frame_checksum(b"")))
    body = b"".join(struct.pack("<III", *x) for x in seek) + struct.pack("<IBI", len(seek), CHECKSUM_FLAG, SEEK_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
    return len(table_), total


class TokenFile:
    """Reader of one file; ``documents(lo, hi)`` decompresses only the frames of those documents."""

    def __init__(self, src, size: int):
        self.src = src
        src.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end")
        src.seek(size - 9 - 12 * n)
        seek = np.frombuffer(src.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        ends = np.cumsum(seek[:, 0])
        src.seek(int(ends[-2]) if n > 1 else 0)
        head = src.read(int(seek[-1, 0]))
        raw = zstandard.ZstdDecompressor().decompress(head[8:])
        self.width, rows = struct.unpack("<II", raw[:8])
        self.index = np.frombuffer(raw[8:], "<i8").reshape(rows, 4)
        self.seek, self.at = seek[:-1], np.concatenate(([0], ends[:-1]))[: n - 1]
        self.first = np.concatenate(([0], np.cumsum(self.seek[:, 1])))

    def _frame(self, k: int) -> bytes:
        self.src.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.src.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
        if _frame_checksum(raw) != self.seek[k, 2]:
            raise ValueError(f"checksum of frame {k} differs")
        return raw

    def documents(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) of the documents lo to hi."""
        frame, k = b"", -1
        for null, doc_id, start, n in self.index[lo:hi].tolist():
            a, b = start * self.width, (start + n) * self.width
            j = int(np.searchsorted(self.first, a, "right")) - 1 if n else k
            if n and j != k:
                frame, k = self._frame(j), j
            base = int(self.first[max(k, 0)])
            yield (None if null else doc_id), start, np.frombuffer(frame[a - base : b - base] if n else b"", f"<u{self.width}").astype("<u4")


_FILES = "part int, file string, n_docs long, n_tokens long"


def _write(folder: str, vocabulary: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, glue=True)

        def docs():
            for batch in batches:
                for piece in slices(batch, "text"):
                    ids = encoder.encode([t or "" for t in string_column(piece, "text").to_pylist()])
                    for doc_id, x in zip(string_column(piece, "doc_id").to_pylist(), ids, strict=True):
                        yield doc_id, np.append(x, np.uint32(end_id))

        source = docs()
        head = next(source, None)
        if head is None:
            return
        part = TaskContext.get().partitionId()
        name, done = f"{folder}/part-{part:06d}.tok.zst", []

        def again():
            yield head
            yield from source

        place_file(name, lambda out: done.append(write_token_file(again(), out, width)))
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([done[0][0]], pa.int64()), "n_tokens": pa.array([done[0][1]], pa.int64())})

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, width: int = 2) -> DataFrame:
    """Encodes every row of ``docs`` and writes the ids in ascending doc_id order below ``folder``.

    Returns part, file, n_docs, n_tokens and base, the number of ids in the files before. Null and
    empty texts give the end id alone; rows that repeat are written as often (ordered by text among
    themselves); a null doc_id sorts first. Texts are encoded whole, however long. Other columns are
    ignored; an empty table writes nothing.
    Files follow each other in doc_id order, each holds a range. ``width`` is 2 bytes for a
    vocabulary of at most 65,536 ids, else 4.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = d.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    n_files = max(graph.partitions_of(docs), -(-int(held) // FILE_BYTES))
    ordered = d.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")
    files = cut_lineage(ordered.mapInArrow(gives_back(_write(folder, vocabulary, end_id, width)), _FILES))
    # one row per file, not per document
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = open_folder(name)
            with fs.open_input_file(path) as src:
                rows, held = [], 0
                for doc_id, start, ids in TokenFile(src, src.size()).documents():
                    rows.append((doc_id, base + start, len(ids), ids.tobytes()))
                    held += ids.nbytes
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.record_batch({"doc_id": pa.array(a, pa.int64()), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids": pa.array(d, pa.binary())})


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""
    names = files.select("file", "base").repartition(max(1, files.count()), "file")  # one row per file
    return names.mapInArrow(gives_back(_read), "doc_id long, start long, n_tokens long, ids binary")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
