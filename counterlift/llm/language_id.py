"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, per hashed position, one bit per language; the AND of an
n-gram's positions is the set of all languages that contain it. A text's n-grams give one
popcount per language, corrected for the filter's false positives; the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import _MULT, U64, Words, mix, slices, string_column
from counterlift.llm.toxicity import _letters, remainder
from counterlift.session import cut_lineage

TRAIN_ROWS = 3000  # per language, by smallest hash of the id: the bounded training sample
WORD = 64  # languages of one mask word
_SALTS = np.arange(1, 3, dtype=U64) * _MULT
SLOTS = 1 << 20
HASHES = 3
SIZES = (2, 3, 4)
LEAST_SHARE = 2e-5  # of a language's n-grams; a rarer n-gram is noise
DOMINANCE = 0.2  # an n-gram belongs to a language if its share there is at least this part of its largest share


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all n-grams of letters, with word borders, in bytes."""
    owners, values = [], []
    size = words.end - words.start
    for k in SIZES:
        long = size >= k
        count = np.where(long, size - k + 1, 0)
        at = np.repeat(words.start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        owners.append(np.repeat(words.doc, count))
        values.append(words.range_hash(at, at + k))
        # beginnings and ends of words count as n-grams of their own
        for begin, salt in ((words.start[long], _SALTS[0]), (words.end[long] - k, _SALTS[1])):
            owners.append(words.doc[long])
            values.append(mix(words.range_hash(begin, begin + k) + salt))
    whole = words.hashes()
    owners.append(words.doc)
    values.append(mix(whole ^ _MULT))
    return np.concatenate(owners), np.concatenate(values)


def _positions(values: np.ndarray) -> Iterator[np.ndarray]:
    step = mix(values ^ _MULT) | U64(1)
    for i in range(HASHES):
        yield ((values + U64(i) * step) & U64(SLOTS - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    languages: list[str]
    rows: np.ndarray  # bitmasks of WORD languages each, words x slots

    def masks(self, values: np.ndarray) -> np.ndarray:
        out = np.full((len(self.rows), len(values)), np.iinfo(np.uint64).max, U64)
        for p in _positions(values):
            for word, row in zip(out, self.rows, strict=True):
                word &= row.take(p)
        return out

    def false_rates(self) -> np.ndarray:
        fill = np.array([((self.rows[i // WORD] >> U64(i % WORD)) & U64(1)).mean() for i in range(len(self.languages))])
        return fill**HASHES

    def counts(self, owner: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
        """Popcounts by text and language, less the expected false positives."""
        mask = self.masks(values)
        total = np.bincount(owner, minlength=n_docs)
        rates = self.false_rates()
        out = np.zeros((n_docs, len(self.languages)))
        for i, f in enumerate(rates):
            seen = np.bincount(owner[(mask[i // WORD] & U64(1 << (i % WORD))) != 0], minlength=n_docs)
            out[:, i] = np.maximum(0, (seen - total * f) / max(1e-9, 1 - f))
        return out


def build_filter(names: list[str], value: np.ndarray, lang: np.ndarray, share: np.ndarray) -> LanguageFilter:
    """Filter from (n-gram, language, share) rows: an n-gram is held by its language and those close to it."""
    rows = np.zeros((max(1, -(-len(names) // WORD)), SLOTS), U64)
    known, at = np.unique(value, return_inverse=True)
    largest = np.zeros(len(known))
    np.maximum.at(largest, at, share)
    held = share >= DOMINANCE * largest[at]
    for i in range(len(names)):
        for p in _positions(value[held & (lang == i)]):
            np.bitwise_or.at(rows[i // WORD], p, U64(1) << U64(i % WORD))
    return LanguageFilter(names, rows)


_COUNTED = pa.schema([("gram", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each language in each slice of texts."""
    for batch in batches:
        for piece in slices(batch, "text"):
            owner, value = ngrams(Words(string_column(piece, "text"), solid=_letters))
            langs = np.array(string_column(piece, "lang").to_pylist(), object)
            for name in sorted(set(langs.tolist())):
                gram, n = np.unique(value[(langs == name)[owner]], return_counts=True)
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array([name] * len(gram), pa.string()), pa.array(n)], schema=_COUNTED)


def _has_letter(words: Words, texts: pa.Array) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    run = np.concatenate(([0], np.cumsum(ascii_letter[words.raw])))
    out = run[words.off[1:]] > run[words.off[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                texts = string_column(piece, "text")
                words = Words(texts, solid=_letters)
                owner, value = ngrams(words)
                counts = model.counts(owner, value, piece.num_rows)
                letter = _has_letter(words, texts)
                names = np.array([*model.languages, "und"], object)
                if model.languages:
                    best, total = counts.argmax(1), counts.sum(1)
                    score = np.divide(counts.max(1), total, out=np.zeros(len(total)), where=total > 0)
                else:
                    best, score = np.zeros(piece.num_rows, int), np.zeros(piece.num_rows)
                label = np.where(letter, names[best], "und")
                score = np.where(letter, score, 0.0)
                cols = [*piece.schema.names, "lang_pred", "score"]
                new = {"lang_pred": pa.array(label.tolist(), pa.string()), "score": pa.array(score)}
                yield pa.record_batch([new[c] if c in new else string_column(piece, c) for c in cols], names=cols)

    return run


def train_languages(docs: DataFrame) -> LanguageFilter:
    """Filter from rows with a language whose remainder by 4 is not 2, at most TRAIN_ROWS per language.

    Tasks count the n-grams of the sample; only those with a share of LEAST_SHARE or more reach the
    driver, at most 1 / LEAST_SHARE for each language. An id with several rows trains with all of them.
    """
    usable = docs.filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    names = sorted(r[0] for r in sizes.collect())  # the languages
    if not names:
        return build_filter(names, np.zeros(0, U64), np.zeros(0, int), np.zeros(0))
    # a threshold on the hash leaves about twice as many rows as wanted, whatever the language's size; these are ranked
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    few = usable.select("doc_id", "lang").join(F.broadcast(sizes), "lang").filter(spot * F.col("n") < 2 * TRAIN_ROWS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(spot, "doc_id"))
    ids = few.withColumn("place", place).filter(F.col("place") <= TRAIN_ROWS).select("doc_id").distinct()
    counted = usable.join(F.broadcast(ids), "doc_id").select("text", "lang").mapInArrow(_count, "gram long, lang string, n long")
    grams = cut_lineage(counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    often = grams.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= LEAST_SHARE)
    got = often.select("gram", "lang", "share").toArrow()
    where = {n: i for i, n in enumerate(names)}
    value = got.column("gram").to_numpy().astype(np.int64).view(U64)
    return build_filter(names, value, np.array([where[x] for x in got.column("lang").to_pylist()], int), got.column("share").to_numpy())


def predict_languages(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score (the winner's part of all corrected counts).

    Texts that are null or have no letter get ``und`` and score 0, as every text does when no
    language was learned. Texts are read whole, however long; an empty table gives an empty result. Ties go to the language first by name. Rows are judged one by one by
    their text alone; other columns pass through, but ones named lang_pred or score are replaced.
    """
    d = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    shared = d.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + ", lang_pred string, score double"
    return d.mapInArrow(_predict(shared), schema)


@query("op7_language_filters")
def op7_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return predict_languages(docs.select("doc_id", "text"), train_languages(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
