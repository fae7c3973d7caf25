"""WARC archives with dictionary-compressed records.

One archive per task: a skippable frame with a Zstandard dictionary built from the archive's
own records, then one Zstandard frame per record, as the zstd profile of WARC has it.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm import graph
from counterlift.llm.registry import query, table
from counterlift.session import cut_lineage, shared_folder

# Fixed values of the format
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 100  # bytes; smaller payloads are always archived
SAMPLE_BYTES = 4 << 20  # records of an archive that its dictionary is built from
DICTIONARY_BYTES = 64 << 10


def record_id(page_id: int | None, digest: str, url: str | None = None, n: int = 0) -> str:
    """Name of a record: of its page and payload, and ``n``, its place among rows that agree in both. Without
    page_id the address stands in."""
    name = f"page:{page_id}:{digest}:{n}" if page_id is not None else f"address:{url}:{digest}:{n}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def target_uri(url: str | None) -> str:
    """The address with white space and unprintable characters as the percent-encoded bytes of their UTF-8."""
    return "".join(c if c.isprintable() and c != " " else quote(c, safe="") for c in (url or "urn:none"))


def warc_record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes, n: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit names the response it repeats and has no block."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, url, n)}", f"WARC-Target-URI: {target_uri(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(body) != size + 4:
        raise ValueError("record length differs from its header")
    return fields, body[:size]


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or a raw-content one where there is too little to train on."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 8))
    if len(records) >= 32:
        try:
            return zstandard.train_dictionary(size, [r[:65536] for r in records], level=3)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(records)[: max(size, 8)].ljust(8, b"\r"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: Iterator[bytes], out) -> Iterator[tuple[int, int]]:
    """Writes an archive and yields (offset, length) of each record's frame."""
    first: list[bytes] = []
    held = 0
    more = False
    for r in records:
        first.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            more = True
            break
    if not first:
        return
    trained = _dictionary(first)
    packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    at = 8 + len(packed)
    codec = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)

    def rest():
        yield from first
        first.clear()
        if more:
            yield from records

    for r in rest():
        frame = codec.compress(r)
        out.write(frame)
        yield at, len(frame)
        at += len(frame)


def read_archive(src) -> Iterator[bytes]:
    """Records of an archive in order; each frame is decompressed on its own."""
    head = src.read(8)
    if len(head) < 8:
        return
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    raw = zstandard.ZstdDecompressor().decompress(src.read(size))
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    frame, parts = None, []
    while block := src.read(64 << 10):
        while block:
            if frame is None:
                frame, parts = codec.decompressobj(), []
            parts.append(frame.decompress(block))
            block = b""
            if frame.eof:
                block = frame.unused_data
                frame = None
                yield b"".join(parts)
    if frame is not None:
        raise ValueError("truncated record")


def open_folder(path: str):
    """(filesystem, path) of a folder that executors share."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def place_file(path: str, write) -> None:
    """Lets ``write`` fill a file of this attempt and then moves it to its final name, so that a
    lost or repeated task leaves no half file."""
    fs, name = open_folder(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, name)


_INDEX = "archive string, page_id long, frame_offset long, frame_length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[tuple[int, int, int]] = []
        ids: list[int | None] = []
        last, alike = None, 0

        def records():
            nonlocal last, alike
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    for row in part.to_pylist():
                        ids.append(row["page_id"])
                        same = row["page_id"], row["digest"], row["url"] if row["page_id"] is None else None
                        last, alike = same, alike + 1 if same == last else 0  # rows that agree follow each other
                        yield warc_record(row["page_id"], row["url"], row["digest"], row["size"], row["refers_to"], (row["html"] or "").encode(), alike)

        source = records()
        head = next(source, None)
        if head is None:
            return
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"

        def fill(out):
            def again():
                yield head
                yield from source

            index.extend((o, n, 0) for o, n in write_archive(again(), out))

        place_file(name, fill)
        yield pa.record_batch({
            "archive": pa.array([name] * len(ids), pa.string()), "page_id": pa.array(ids, pa.int64()),
            "frame_offset": pa.array([x[0] for x in index], pa.int64()), "frame_length": pa.array([x[1] for x in index], pa.int64()),
        })

    return run


def write_warcs(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row of ``pages`` (page_id, url, html) as a record below ``folder``.

    Returns the index: archive, page_id, frame_offset, frame_length. Payload is the html in
    UTF-8, a null one is empty. Of equal payloads of at least LEAST_REVISIT bytes the smallest
    page_id is the response, the others revisit it. Repeated page_ids each get a record with a
    name of its own, and those whose payload equals that of the response with the same id are
    responses too. A row without page_id revisits the response of its payload; where no row with that payload
    has an id, all are responses. Very long html is one record. Other columns are ignored. An empty
    table writes no archive. The html is moved once, by page_id; digests are joined apart from it.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    html = F.coalesce("html", F.lit(""))
    facts = cut_lineage(p.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size")))
    large = facts.filter(F.col("size") >= LEAST_REVISIT)
    heads = large.groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("copies")).filter("copies > 1 AND head IS NOT NULL").drop("copies")
    revisits = large.join(heads, "digest").filter("page_id <> head").select("page_id", "digest", F.col("head").alias("refers_to")).distinct()
    n = graph.partitions_of(pages)
    digested = p.withColumns({"digest": F.sha2(html.cast("binary"), 256), "size": F.octet_length(html).cast("long")})
    columns = ["page_id", "url", "html", "digest", "size", "refers_to"]
    named = digested.filter("page_id IS NOT NULL").join(cut_lineage(revisits), ["page_id", "digest"], "left").select(*columns)
    known = heads.select("digest", F.col("head").alias("refers_to"))
    nameless = digested.filter("page_id IS NULL").join(known, "digest", "left").select(*columns)
    apart = F.when(F.col("page_id").isNull(), F.xxhash64("url", "digest"))  # rows without id are dealt by address and payload
    dealt = named.unionByName(nameless).repartition(n, "page_id", apart).sortWithinPartitions("page_id", "digest", "url")
    return cut_lineage(dealt.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(_write(folder), _INDEX))


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for name in batch.column(0).to_pylist():
            fs, path = open_folder(name)
            rows, held = [], 0
            with fs.open_input_stream(path, compression=None) as src:
                for raw in read_archive(io.BufferedReader(src, 1 << 20)):
                    f, body = parse_record(raw)
                    refers = f.get("X-Refers-To-Page")
                    page = f.get("X-Page-Id")
                    rows.append((int(page) if page else None, f["WARC-Target-URI"], int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"], int(refers) if refers else None, None if refers else body))
                    held += len(body)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_warcs(index: DataFrame) -> DataFrame:
    """Records of the archives that ``index`` names; payload is null for a revisit."""
    archives = index.select("archive").distinct()
    return archives.repartition(graph.partitions_of(index), "archive").mapInArrow(_read, _READ)


_ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM m
"""


@query("op1_warc_dictionary", _ORACLE)
def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = read_warcs(write_warcs(table(spark, sf_dir, "pages"), folder))
    response = F.col("record_type") == "response"
    # size and digest of what was read back; a revisit has no payload, so its header speaks
    return records.select(
        "page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
