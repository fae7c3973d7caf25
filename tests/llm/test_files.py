"""WARC archives, token files, packing and URL lists: exact round trips and brute force."""

import datetime
import hashlib
import io
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from counterlift.llm.packing import BestFit, pack_documents
from counterlift.llm.token_files import TokenFile, read_token_files, write_token_file, write_token_files
from counterlift.llm.url_lists import url_verdicts, validity_intervals
from counterlift.llm.warc import parse_record, read_archive, read_warcs, warc_record, write_archive, write_warcs

PAGES = "page_id long, url string, html string, digest string, size string"


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(i, f"http://h{i}.example/", big if i % 3 == 0 else f"<p>{i}</p>" * 20, "c", "c") for i in range(1, 61)]
    rows += [(100, None, None, None, None), (101, "u", "", "", ""), (102, "u\r\nX-Evil: 1", "short", "", ""), (103, "u", "short", "", ""), (104, "u", "é" * 300_000, "", "")]
    index = write_warcs(spark.createDataFrame(rows, PAGES).repartition(4), str(tmp_path / "w"))
    assert index.count() == len(rows)
    got = {r.page_id: r for r in read_warcs(index).collect()}
    assert len(got) == len(rows)
    for page_id, _, html, _, _ in rows:
        raw, r = (html or "").encode(), got[page_id]
        same = [p for p, _, h, _, _ in rows if (h or "").encode() == raw] if len(raw) >= 100 else [page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        if page_id == min(same):
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", min(same), None)


def test_every_page_gets_a_record_of_its_own(spark, tmp_path):
    """Rows without or with a repeated page_id, and addresses with odd characters."""
    big = "<p>" + "y" * 150
    rows = [(1, "http://a/", big), (None, "http://b/", big), (None, "http://b/", big), (2, "http://c\u00a0d/ e\n", "short"), (2, "http://x/", "other"), (2, "http://x/", "other"), (3, "http://y/", big), (3, "http://y/", big)]
    rows += [(None, None, "<p>" + "z" * 150), (None, None, "<p>" + "z" * 150), (None, "u", None)]
    pages = spark.createDataFrame([(*r, "", "") for r in rows], PAGES)
    index = write_warcs(pages, str(tmp_path / "w")).collect()
    assert len(index) == len(rows)
    ids, got = [], []
    for archive in {r.archive for r in index}:
        with open(archive.removeprefix("file://"), "rb") as src:
            for raw in read_archive(io.BufferedReader(src)):
                fields, body = parse_record(raw)
                ids.append(fields["WARC-Record-ID"])
                got.append(fields)
    assert len(set(ids)) == len(rows)
    assert all(f["WARC-Refers-To"] in ids for f in got if "WARC-Refers-To" in f)
    assert "http://c%C2%A0d/%20e%0A" in {f["WARC-Target-URI"] for f in got}
    back = read_warcs(write_warcs(pages, str(tmp_path / "v"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in back) == sorted(
        [(1, "response", 0, 153), (0, "revisit", 1, 153), (0, "revisit", 1, 153), (2, "response", 0, 5), (2, "response", 0, 5), (2, "response", 0, 5),
         (3, "revisit", 1, 153), (3, "revisit", 1, 153), (0, "response", 0, 153), (0, "response", 0, 153), (0, "response", 0, 0)])


def test_warc_frames_stand_alone(spark, tmp_path):
    """A single record is decompressed from its offset with the dictionary of the first frame."""
    records = [warc_record(i, "http://a.example/", "0" * 64, 50, None, f"<html>{i}</html>".encode() * 30) for i in range(200)]
    out = io.BytesIO()
    spots = list(write_archive(iter(records), out))
    assert list(read_archive(io.BytesIO(out.getvalue()))) == records
    first = spots[0][0]
    at, size = spots[150]
    assert list(read_archive(io.BytesIO(out.getvalue()[:first] + out.getvalue()[at : at + size]))) == [records[150]]
    with pytest.raises(ValueError, match="truncated"):
        list(read_archive(io.BytesIO(out.getvalue()[:-3])))


def test_warc_empty_table(spark, tmp_path):
    index = write_warcs(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert index.collect() == [] and read_warcs(index).collect() == []


def test_token_file_reads_only_the_frames_asked_for():
    rng = np.random.default_rng(1)
    docs = [(k if k else None, rng.integers(0, 50_000, n).astype(np.uint32)) for k, n in enumerate([0, 1, 600_000, 5, 700_000, 3])]
    out = io.BytesIO()
    assert write_token_file(iter(docs), out, 2) == (6, sum(len(x) for _, x in docs))
    raw = bytearray(out.getvalue())
    reader = TokenFile(io.BytesIO(raw), len(raw))
    for (a, x), (b, _, y) in zip(docs, reader.documents(), strict=True):
        assert a == b and np.array_equal(x, y)
    raw[int(reader.at[0]) + 50] ^= 1  # a fault in the first frame does not touch the last documents
    reader = TokenFile(io.BytesIO(raw), len(raw))
    assert np.array_equal(next(reader.documents(5))[2], docs[5][1])
    with pytest.raises(Exception):  # noqa: B017
        list(reader.documents(2, 3))


TEXTS = [(5, "hello world", "x"), (2, None, "x"), (9, "", "x"), (7, "ünï 漢字 " * 400, "x"), (7, "twice", "x"), (1, "a b c\n\n" * 5000, "x"), (None, "no id", "x")]
DOCS = "doc_id long, text string, ids string"


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    files = write_token_files(spark.createDataFrame(TEXTS, DOCS), str(tmp_path / "t"), path, 0)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(files).orderBy("start").collect()]
    start = 0
    order = sorted(TEXTS, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    for (doc_id, text, _), (got_id, at, ids) in zip(order, got, strict=True):
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got_id, at, ids) == (doc_id, start, want)
        start += len(want)


def test_token_files_empty_table(spark, tmp_path):
    files = write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert read_token_files(files).collect() == []


def test_best_fit_is_best_fit_with_the_fullest_closing():
    rng = random.Random(4)
    bins = BestFit(100, 5)
    open_, made = [], 0  # (space, age, bin)
    for age in range(3000):
        size = rng.randint(1, 100)
        fitting = [b for b in open_ if b[0] >= size]
        if fitting:
            space, _, which = best = min(fitting)
            open_.remove(best)
        else:
            if len(open_) >= 5:
                open_.remove(min(open_))
            space, which, made = 100, made, made + 1
        if space > size:
            open_.append((space - size, age, which))
        assert bins.add(size) == (which, 100 - space)


def test_packing_is_whole_and_gapless(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(0)
    more = [(i, "some words of prose here " * rng.randint(1, 900), "x") for i in range(20, 120)]
    rows = pack_documents(spark.createDataFrame(TEXTS + more, DOCS), path, end_id=1).collect()
    want = sorted((-1 if d is None else d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, _ in TEXTS + more)
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        by_doc.setdefault((r.doc_id, r.start if r.doc_id == 7 and r.piece else 0), []).append(r)
    ids = sorted(np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist())
    assert ids == sorted(x for _, w in want for x in w)
    single = {d: w for d, w in want if d != 7}
    for (doc_id, _), pieces in by_doc.items():
        if doc_id != 7:
            joined = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
            assert joined == single[-1 if doc_id is None else doc_id]
            assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length == 4096 for r in pieces[:-1])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in sequences.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:i]) for i in range(len(spots))]
        assert sum(n for _, n in spots) <= 4096
    assert len(sequences) <= -(-len(ids) // 4096) * 1.1 + 1


def test_packing_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json"), 1).collect() == []


def day(text):
    return datetime.date.fromisoformat(text)


ENTRIES = "list_name string, key string, action string, entry_date date"
CAPTURES = "page_id long, url string, fetched date, key string"


def test_validity_intervals(spark):
    rows = [
        ("l", "a.example", "add", day("2024-01-05")), ("l", "a.example", "add", day("2024-01-09")), ("l", "a.example", "remove", day("2024-02-01")),
        ("l", "a.example", "add", day("2024-03-01")), ("l", "b.example", "remove", day("2024-01-01")), ("l", "c.example", "add", day("2024-01-01")),
        ("l", "c.example", "remove", day("2024-01-01")), (None, "d", "add", day("2024-01-01")), ("l", "d", "hold", day("2024-01-01")), ("l", "d", "add", None),
    ]
    got = validity_intervals(spark.createDataFrame(rows + rows, ENTRIES)).collect()
    assert sorted((r.key, str(r.valid_from), str(r.valid_to)) for r in got) == [("a.example", "2024-01-05", "2024-02-01"), ("a.example", "2024-03-01", "9999-12-31")]


def test_url_verdicts_at_fetch_time(spark):
    entries = spark.createDataFrame([
        ("hosts", "bad.example", "add", day("2024-01-10")), ("hosts", "bad.example", "remove", day("2024-03-10")),
        ("domains", "sub.bad.example", "add", day("2024-02-01")), ("paths", "ok.example/spam/", "add", day("2023-01-01")),
    ], ENTRIES)
    shots = [
        (1, "http://bad.example/x", day("2024-01-09")), (2, "http://bad.example/x", day("2024-01-10")), (3, "https://u@www.BAD.example:80", day("2024-03-09")),
        (4, "http://bad.example/", day("2024-03-10")), (5, "http://a.sub.bad.example/", day("2024-02-15")), (6, "http://notbad.example/", day("2024-02-15")),
        (7, "http://ok.example/spam/page?q", day("2024-02-15")), (8, "http://ok.example/spam", day("2024-02-15")), (9, None, day("2024-02-15")),
        (10, "http://bad.example/", None), (11, "no url", day("2024-02-15")), (12, "", day("2024-02-15")), (2, "http://bad.example/x", day("2024-01-10")),
    ]
    frame = spark.createDataFrame([(*s, "clash") for s in shots], CAPTURES)
    got = url_verdicts(frame, entries).collect()
    assert len(got) == 13
    blocked = {(r.page_id, r.n_active, r.n_lists, r.first_match) for r in got if r.blocked}
    assert blocked == {
        (2, 1, 1, "hosts:bad.example"), (3, 1, 1, "hosts:bad.example"), (5, 2, 2, "domains:sub.bad.example"), (7, 1, 1, "paths:ok.example/spam/"),
    }
    assert not any(r.blocked for r in url_verdicts(frame, entries.limit(0)).collect())
    assert url_verdicts(frame.limit(0), entries).collect() == []
