"""CRF against enumeration, and the three trained operators on held-out rows and odd input."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from counterlift.llm import crf, pii
from counterlift.llm.language_id import build_filter, ngrams, predict_languages, train_languages
from counterlift.llm.textarrays import U64, Words
from counterlift.llm.toxicity import _letters, toxic_scores, train_toxicity

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_crf_equals_enumeration():
    rng = np.random.default_rng(0)
    model = crf.Chain(np.arange(5, dtype=U64), rng.standard_normal((5, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3))
    length = np.array([4, 1, 3])
    first = np.cumsum(length) - length
    scores = rng.standard_normal((8, 3))
    p, path = model.marginals(scores, first, length), model.best_path(scores, first, length)
    for a, n in zip(first, length, strict=True):
        weights = {}
        for states in itertools.product(range(3), repeat=int(n)):
            total = model.starts[states[0]] + sum(scores[a + t, s] for t, s in enumerate(states)) + sum(model.moves[x, y] for x, y in itertools.pairwise(states))
            weights[states] = np.exp(total)
        every = sum(weights.values())
        want = np.array([[sum(w for s, w in weights.items() if s[t] == k) / every for k in range(3)] for t in range(n)])
        assert np.allclose(p[a : a + n], want)
        assert tuple(path[a : a + n]) == max(weights, key=weights.get)


def brute_spans(text):
    """The base patterns as the contract states them, by the regular expressions alone."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    pieces = ["a", "Z", "@", ".", "-", "+", "%", " ", "(", ")", "1", "25", "255", "4111111111111111", "a@b.co", "1.2.3.4", "+1 (555) 123-4567", "é", "\n", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1." * 150_000, "a.b@" * 50_000, "1 " * 100_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(text)


def test_pii_keeps_base_spans_and_masks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.train_pii()
    odd = [(1, None), (2, ""), (3, "mail é a@b.co, call +1 555 123 4567."), (3, "mail a@b.co"), (None, "10.0.0.1"), (4, "x " * 100_000 + "a@b.co")]
    frame = spark.createDataFrame([(i, t, "c", "c") for i, t in odd], "doc_id long, text string, base string, spans string")
    got = pii.find_pii(frame, model).collect()
    assert len(got) == len(odd)
    for r in got:
        base = pii.joined(brute_spans(r.text or ""))
        assert r.base == base and (not base or set(base.split(",")) <= set(r.spans.split(",")))
        assert (r.masked is None) == (r.text is None) and (r.text is None or "a@b.co" not in r.masked)
    assert pii.find_pii(frame.limit(0), pii.train_pii([])).collect() == []
    for r in pii.find_pii(docs.select("doc_id", "text"), model).collect():
        assert r.base == pii.joined(brute_spans(r.text or ""))


def _overlaps(span, spans):
    return any(a < span[1] and b > span[0] for a, b, *_ in spans)


def test_pii_finds_written_out_forms_it_has_not_seen():
    """Rows of the labelled table drawn with another seed; the base patterns alone miss most of them."""
    model, rows = pii.train_pii(), pii.labelled_table(1500, seed=9)
    found = list(pii.tag(pa.array([t for t, _ in rows]), model))
    want = [(i, s) for i, (_, spans) in enumerate(rows) for s in spans]
    base = np.mean([_overlaps(s, found[i][1]) for i, s in want])
    both = np.mean([_overlaps(s, found[i][1] + found[i][2]) for i, s in want])
    wrong = [s for (_, spans), (_, b, more) in zip(rows, found, strict=True) for s in more if not _overlaps(s, spans)]
    assert base < 0.4 and both > 0.93 and len(wrong) < 0.05 * len(want)


def test_pii_reads_long_words_whole():
    a = pii.Stretches(pa.array(["x" * 100 + "1", "x" * 100 + "1@"]))
    assert a.columns[0][0] != a.columns[0][1]


def test_pii_leaves_clean_documents_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = pii.find_pii(docs, pii.train_pii()).filter("spans <> ''").collect()
    assert sum(r.base != r.spans for r in rows) <= 0.03 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train_toxicity(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect() if crc(r.doc_id) % 3 == 1}
    score = {r.doc_id: r.score for r in toxic_scores(docs.select("doc_id", "text"), model).collect()}
    assert all(0 <= s <= 1 for s in score.values())
    toxic = [score[i] for i, t in truth.items() if t == 1]
    clean = [score[i] for i, t in truth.items() if t == 0]
    assert np.mean([s < 0.7 for s in clean]) > 0.97
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = train_toxicity(docs, labels), train_toxicity(docs, turned)
    assert np.array_equal(a.known, b.known) and np.array_equal(a.weights, b.weights)


def test_toxicity_odd_input(spark):
    schema = "doc_id long, text string, score string, spans string"
    odd = [(1, None), (2, ""), (2, "!!!"), (None, "words"), (5, "word " * 200_000)]
    frame = spark.createDataFrame([(i, t, "c", "c") for i, t in odd], schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for model in (train_toxicity(frame, labels), train_toxicity(frame.limit(0), labels.limit(0))):
        got = toxic_scores(frame, model).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
        assert toxic_scores(frame.limit(0), model).collect() == []


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_languages(docs)
    got = {r.doc_id: r for r in predict_languages(docs.select("doc_id", "text"), model).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").collect() if r.lang and crc(r.doc_id) % 4 == 2]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    turned = docs.withColumn("lang", docs.lang.isNull().cast("string"))
    mixed = docs.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2").unionByName(turned.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2"))
    again = train_languages(mixed)
    assert again.languages == model.languages and np.array_equal(again.rows, model.rows)


def test_more_languages_than_a_mask_word_holds(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(12)] for _ in range(90)]
    rows = [(100 * k + i, " ".join(rng.choices(words[k], k=30)), f"l{k:02d}") for k in range(90) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_languages(docs)
    assert len(model.languages) == 90 and model.rows.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in predict_languages(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.97


def test_language_popcounts_equal_brute_force(spark):
    """Without false positives a text's counts are those of plain sets of n-grams."""
    texts = ["the cat sat on the mat", "der hund und die katze", "the und der"]
    words = Words(pa.array(texts), solid=_letters)
    owner, value = ngrams(words)
    model = build_filter(["de", "en"], value[owner < 2], np.where(owner[owner < 2] == 0, 1, 0), np.full((owner < 2).sum(), 0.1))
    held = [set(value[owner == k].tolist()) for k in (1, 0)]
    plain = np.array([[sum(v in h for v in value[owner == d].tolist()) for h in held] for d in range(3)])
    assert np.allclose(model.counts(owner, value, 3), plain, atol=0.05)


def test_languages_odd_input(spark):
    schema = "doc_id long, text string, lang string, score string"
    odd = [(1, None, "en"), (2, "", "en"), (3, "123 !", None), (None, "words of it", "en"), (5, "the word " * 100_000, "en"), (6, "漢字", "zh"), (7, "the word", "en")]
    frame = spark.createDataFrame([(*r, "c") for r in odd], schema)
    for model in (train_languages(frame), train_languages(frame.limit(0))):
        got = {r.doc_id: r for r in predict_languages(frame, model).collect()}
        assert len(got) == len(odd) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
        assert all(0 <= r.score <= 1 for r in got.values())
        assert predict_languages(frame.limit(0), model).collect() == []
