"""Toxic spans by a linear-chain CRF, and document scores from its marginals.

Fit, on a bounded sample of labelled rows: words and word beginnings that occur in toxic rows,
in different surroundings, far more often than chance allows, mark the toxic tokens; the sentences around them and as many
clean sentences train a two-state CRF over hashed word, prefix and suffix features.
Scoring tags every token of every whole text; sentences are the chains.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm import crf
from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import _MULT, U64, Words, mix, slices, string_column, gives_back

TOXIC_ROWS, CLEAN_ROWS = 1000, 4000  # the bounded training sample, by smallest hash of the id
FIT_BYTES = 16 << 20  # characters of the sample of each label that the fit reads at most
TRAIN_SENTENCES = 2500  # of each kind
CHANCE = 1e-7  # a word marks toxic tokens if chance explains its rows less often than this
REJECT = 0.7
MINING, SUSPECT = 1, 0.02  # rounds in which suspected clean sentences are added, and from which probability
PREFIXES = (4, 5, 6)
TOP = 3  # marginals that make a document's score

_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = _letters[128:] = True
_stops = np.zeros(256, bool)
_stops[[10, 33, 46, 63]] = True


class Tokens:
    """Letter runs of a slice of texts, their features and sentence chains."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts, solid=_letters)
        word = w.hashes()
        size = w.end - w.start
        heads = [np.where(size >= k, w.range_hash(w.start, np.minimum(w.end, w.start + k)), U64(0)) for k in PREFIXES]
        tail = w.range_hash(np.maximum(w.start, w.end - 4), w.end)
        self.marks = [word, *heads]
        stops = np.concatenate(([0], np.cumsum(_stops[w.raw])))
        new = np.ones(len(word), bool)
        if len(word):
            new[1:] = (w.doc[1:] != w.doc[:-1]) | (stops[w.start[1:]] != stops[w.end[:-1]])
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.append(self.first, len(word)))
        columns = [word, *heads, tail, np.zeros_like(word)]
        salts = np.arange(1, len(columns) + 1, dtype=U64) * _MULT
        self.columns = [mix(c + s) for c, s in zip(columns, salts, strict=True)]


def _surprise(bad: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """Chernoff bound of the chance that so many of the rows with a word are toxic."""
    n = bad + good
    p = np.clip(bad / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    gain = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    return np.where(p > share, np.exp(-gain), 1.0)


def _telling(mark: np.ndarray, context: np.ndarray, bad_doc: np.ndarray, share: float) -> np.ndarray:
    """Marks that occur in toxic rows, in different contexts, more often than chance allows."""
    order = np.lexsort((context, mark))
    m, c = mark[order], context[order]
    one = np.ones(len(m), bool)
    one[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
    m, toxic = m[one], bad_doc[order][one]
    value, at = np.unique(m, return_inverse=True)
    bad, good = np.bincount(at, toxic, len(value)), np.bincount(at, ~toxic, len(value))
    return value[(_surprise(bad, good, share) < CHANCE) & (bad >= 20 * good) & (value != 0)]


def _sliced(texts: list[str], toxic: np.ndarray) -> Iterator[tuple[np.ndarray, Tokens]]:
    """Labels and tokens of one slice of the texts after another."""
    at = 0
    for piece in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), "text"):
        t = Tokens(string_column(piece, "text"))
        yield toxic[at : at + piece.num_rows], t
        at += piece.num_rows


def fit(texts: list[str], toxic: np.ndarray) -> crf.Chain:
    """A CRF from labelled texts; without rows of both labels it tags nothing."""
    toxic = np.asarray(toxic, bool)
    none = crf.train([np.zeros(0, U64)], np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 2)
    if not toxic.any() or toxic.all():
        return none
    # tokens take many times the room of their text, so each pass makes those of one slice after another
    marks, contexts, bad_doc, chain_tokens, clean = [[] for _ in range(len(PREFIXES) + 1)], [], [], [], []
    for label, t in _sliced(texts, toxic):
        word = t.marks[0]
        contexts.append(mix(np.roll(word, 1)) ^ np.roll(word, -1))
        for kept, mark in zip(marks, t.marks, strict=True):
            kept.append(mark)
        bad_doc.append(label[t.words.doc])
        clean.append(~label[t.words.doc[t.first]])
        chain_tokens.append(t.length)
    # a context is the pair of neighbours: copies of a text add none
    context, bad_doc, clean = np.concatenate(contexts), np.concatenate(bad_doc), np.concatenate(clean)
    length, share = np.concatenate(chain_tokens), float(bad_doc.mean())
    is_bad = np.zeros(len(bad_doc), bool)
    for k in range(len(marks)):
        mark, marks[k] = np.concatenate(marks[k]), []
        is_bad |= np.isin(mark, _telling(mark, context, bad_doc, share))
    is_bad &= bad_doc
    del contexts, context, marks
    chain = np.repeat(np.arange(len(length)), length)
    has = np.bincount(chain, is_bad, len(length)) > 0
    if not has.any():
        return none
    rng = np.random.default_rng(0)
    pick = np.zeros(len(length), bool)
    pick[rng.permutation(np.flatnonzero(has))[:TRAIN_SENTENCES]] = True
    pick[rng.permutation(np.flatnonzero(clean & ~has))[:TRAIN_SENTENCES]] = True
    for again in range(MINING + 1):
        keep, size = np.repeat(pick, length), length[pick]
        at, columns = 0, []
        for _, t in _sliced(texts, toxic):
            n = len(t.marks[0])
            columns.append([c[keep[at : at + n]] for c in t.columns])
            at += n
        table_ = [np.concatenate(c) for c in zip(*columns, strict=True)]
        model = crf.train(table_, is_bad[keep].astype(int), np.cumsum(size) - size, size, 2, least=2, rounds=30)
        if again < MINING:  # clean sentences that it suspects join the table
            most = [np.maximum.reduceat(model.sparse_marginals(t.columns, t.first, t.length)[:, 1], t.first) for _, t in _sliced(texts, toxic) if len(t.first)]
            pick |= clean & ~has & (np.concatenate(most) > SUSPECT)
    # the table holds all sentences with toxic tokens, but few of the others
    shift = np.log(max(1.0, (clean & ~has).sum() / max(1, (pick & ~has).sum())))
    model.starts[1] -= shift
    return model.pruned()


_SCORED = "doc_id long, score double, spans string"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                t = Tokens(string_column(piece, "text"))
                p = model.sparse_marginals(t.columns, t.first, t.length)[:, 1]
                doc = t.words.doc
                order = np.lexsort((-p, doc))
                rank = np.arange(len(p)) - t.words.first[doc[order]]
                top = order[rank < TOP]
                miss = np.ones(piece.num_rows)
                np.multiply.at(miss, doc[top], 1 - p[top])
                spans: list[list[str]] = [[] for _ in range(piece.num_rows)]
                hit = np.flatnonzero(p >= 0.5)
                begin, end = t.words.code_points(t.words.start[hit]), t.words.code_points(t.words.end[hit] - 1) + 1
                for d, a, b in zip(doc[hit].tolist(), begin.tolist(), end.tolist(), strict=True):
                    spans[d].append(f"{a}:{b}")
                columns = [pa.array(1 - miss) if c == "score" else pa.array([",".join(s) for s in spans]) if c == "spans" else string_column(piece, c) for c in [*piece.schema.names, "score", "spans"]]
                yield pa.record_batch(columns, names=[*piece.schema.names, "score", "spans"])

    return run


def remainder(doc_id, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``; null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def _fit_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of the sample, rows of both labels in order of their hash until FIT_BYTES are read."""
    texts, toxic, held = [], [], {0: 0, 1: 0}
    for batch in batches:
        for text, label in zip(string_column(batch, "text").to_pylist(), string_column(batch, "toxic").to_pylist(), strict=True):
            held[label] += len(text or "")
            if held[label] <= FIT_BYTES:
                texts.append(text or "")
                toxic.append(label)
    yield pa.record_batch({"model": pa.array([pickle.dumps(fit(texts, np.array(toxic, int)))], pa.binary())})


def train_toxicity(docs: DataFrame, labels: DataFrame) -> crf.Chain:
    """Model from the labelled rows whose remainder by 3 is not 1, at most TOXIC_ROWS and CLEAN_ROWS of them
    and FIT_BYTES of text of each kind; one task fits it, and only its weights reach the driver."""
    usable = labels.filter((remainder("doc_id", 3) != 1) & F.col("toxic").isin(0, 1))
    marked = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [marked.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n).select("doc_id", "toxic") for k, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    ids = chosen[0].union(chosen[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    sample = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    ordered = sample.withColumn("h", order).repartition(1).sortWithinPartitions("h", "doc_id").select("text", "toxic")
    made = ordered.mapInArrow(gives_back(_fit_in_task), "model binary").first()
    return pickle.loads(made[0]) if made else fit([], np.zeros(0, int))


def toxic_scores(docs: DataFrame, model: crf.Chain) -> DataFrame:
    """The rows of ``docs`` with score (0 to 1) and spans (start:end in code points of the offending tokens).

    A document's score is the chance that any of its TOP most suspect tokens is toxic. Null and
    word-free texts score 0 and have no spans. Every row is scored by its text alone; other
    columns pass through, except that ones named score or spans are replaced.
    """
    d = docs.drop("score", "spans").withColumn("text", F.col("text").cast("string"))
    shared = d.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + ", score double, spans string"
    return d.mapInArrow(gives_back(_score(shared)), schema)


@query("op10_toxicity_crf")
def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxic_scores(docs.select("doc_id", "text"), train_toxicity(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "spans")
