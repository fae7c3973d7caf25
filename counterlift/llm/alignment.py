"""Alignment of two tokenizers' tokens on the bytes of a text, with corpus-wide pair counts.

Documents are shuffled by their full text; each distinct text is tokenised and aligned once and
its id pairs are counted with the number of documents that hold it. Measures of a text are then
joined to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import gives_back, slices, string_column
from counterlift.llm.tokenize import BYTE_ALPHABET, worker_encoder
from counterlift.session import cut_lineage

MOST_COMMON = 1_000_000  # pairs that are broadcast; rarer ones are joined by a shuffle


class ByteTokens:
    """Bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        # ids as they stand in a listing of groups, by the mark that follows
        self.listed = {mark: np.array([f"{i}{mark}" for i in range(len(tokens))], object) for mark in ",|;"}

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _first(path: str):
    encoder = worker_encoder(path, glue=True, plain=True)
    vocabulary = encoder.tok.get_vocab(with_added_tokens=True)
    raw = {chr(c): b for b, c in BYTE_ALPHABET.items()} | {chr(b): b for b in range(256) if b not in BYTE_ALPHABET}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(map(raw.__getitem__, token)) if raw.keys() >= set(token) else token.encode()
    return encoder, ByteTokens(tokens)


@lru_cache(maxsize=2)
def _second(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return model, ByteTokens([bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


def align(a: np.ndarray, b: np.ndarray, first: ByteTokens, second: ByteTokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, last of its group, end) of every overlapping pair, by place, for tokens that cover the same bytes.

    Between two neighbouring token ends lies exactly one A and one B token, so the pairs are as
    many as distinct ends. Both vocabularies have a byte for every token that is used.
    """
    end_a, end_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    size = int(end_a[-1]) + 1 if len(a) else 1
    is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
    is_a[end_a] = is_b[end_b] = True
    ends = np.flatnonzero(is_a | is_b)
    # tokens that ended before a place
    i, j = np.cumsum(is_a)[ends] - is_a[ends], np.cumsum(is_b)[ends] - is_b[ends]
    return i, j, is_a[ends] & is_b[ends], ends


def listed_tokens(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, last: np.ndarray, first: ByteTokens, second: ByteTokens) -> np.ndarray:
    """The strings whose joining is ``a1,a2|b1;a3|b2,b3;``: the ids of both sides, group by group."""
    cut_a, cut_b = i[last], j[last]  # last token of each group
    before_a = np.concatenate(([0], cut_b + 1))[:-1]  # B tokens listed before a group's A tokens
    out = np.empty(len(a) + len(b), object)
    place_a = np.arange(len(a)) + np.repeat(before_a, np.diff(cut_a, prepend=-1))
    place_b = np.arange(len(b)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))
    out[place_a] = first.listed[","][a]
    out[place_b] = second.listed[","][b]
    out[place_a[cut_a]] = first.listed["|"][a[cut_a]]
    out[place_b[cut_b]] = second.listed[";"][b[cut_b]]
    return out


def aligned_rows(texts: list[str], first_path: str, second_path: str) -> list[tuple | None]:
    """(n_a, n_b, n_groups, n_links, sha256 of the groups, pairs, times) of each non-empty text; None if its tokens do not give back its bytes."""
    encoder, first = _first(first_path)
    model, second = _second(second_path)
    ids_a, ids_b = encoder.encode(texts, " "), model.encode(texts, num_threads=1)
    raw = [f" {t}".encode() for t in texts]
    whole = [k for k, (x, y, r) in enumerate(zip(ids_a, ids_b, raw, strict=True)) if first.joined(x.tolist()) == r and second.joined(y) == r]
    out: list[tuple | None] = [None] * len(texts)
    if not whole:
        return out
    # the texts one after another: groups end with a text, as tokens of both do
    a = np.concatenate([ids_a[k] for k in whole]).astype(np.int64)
    b = np.array([y for k in whole for y in ids_b[k]], np.int64)
    n_a, n_b = np.array([len(ids_a[k]) for k in whole]), np.array([len(ids_b[k]) for k in whole])
    i, j, last, ends = align(a, b, first, second)
    text_ends = np.cumsum([len(raw[k]) for k in whole])
    owner = np.searchsorted(text_ends, ends)
    n_links, n_groups = np.bincount(owner, minlength=len(whole)), np.bincount(owner[last], minlength=len(whole))
    scale = len(first.tokens) * len(second.tokens)
    pair, times = np.unique(owner * scale + a[i] * len(second.tokens) + b[j], return_counts=True)
    cut = np.searchsorted(pair, np.arange(len(whole) + 1) * scale).tolist()
    pair, times = pair % scale, times.astype(np.int32)
    tokens = listed_tokens(a, b, i, j, last, first, second)
    at = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    for m, k in enumerate(whole):
        digest = hashlib.sha256("".join(tokens[at[m] : at[m + 1]].tolist())[:-1].encode()).hexdigest()
        out[k] = (int(n_a[m]), int(n_b[m]), int(n_groups[m]), int(n_links[m]), digest, pair[cut[m] : cut[m + 1]], times[cut[m] : cut[m + 1]])
    return out


_ALIGNED = pa.schema(
    [("text_key", pa.binary()), ("n_docs", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
    + [("groups_sha256", pa.string()), ("pair", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
)


def _aligned(first_path: str, second_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                held = zip(*(string_column(part, c).to_pylist() for c in ("text_key", "n_docs")), aligned_rows(string_column(part, "text").to_pylist(), first_path, second_path), strict=True)
                rows = [(key, n, *r) for key, n, r in held if r is not None]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ALIGNED, strict=True)], schema=_ALIGNED)

    return run


def aligned_texts(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """One row per distinct text with tokens: key, number of documents, counts, and its id pairs with their times.

    pair is A's id times the size of B's vocabulary plus B's id; ``vocabulary_width`` gives that size.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''")
    distinct = texts.groupBy("text").agg(F.count("*").alias("n_docs")).withColumn("text_key", _key("text"))
    shape = "text_key binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<int>"
    return distinct.mapInArrow(gives_back(_aligned(first_path, second_path)), shape)


def _key(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def vocabulary_width(second_path: str) -> int:
    return len(_second(second_path)[1].tokens)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """a, b, count (documents that hold the pair linked), n_texts, and best: no pair of the same A id has a higher count."""
    held = aligned.select("n_docs", F.explode("pair").alias("pair"))
    counts = held.groupBy("pair").agg(F.sum("n_docs").alias("count"), F.count("*").alias("n_texts"))
    counts = counts.withColumn("a", F.expr(f"pair div {width}")).withColumn("b", F.col("pair") % width)
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # an A id has at most B's vocabulary of pairs
    return counts.join(top, "a").select("pair", "a", "b", "count", "n_texts", (F.col("count") == F.col("top")).alias("best"))


def link_measures(aligned: DataFrame, counts: DataFrame, most_common: int = MOST_COMMON) -> DataFrame:
    """text_key, n_best and count_sum: over a text's links, those whose pair is best, and the sum of the pairs' counts.

    The pairs held by most texts, at most ``most_common`` of them, are broadcast, so no pair held
    by many texts is a join key of a shuffle; the others are joined by a shuffle.
    """
    size = F.floor(F.log2("n_texts")).cast("int")
    by_size = {r.size: r.n for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    least, taken = 64, 0
    for s in sorted(by_size, reverse=True):
        taken += by_size[s]
        if taken > most_common:
            break
        least = s
    use = counts.select("pair", "count", "best", "n_texts")
    common = F.broadcast(use.filter(size >= least).drop("n_texts"))
    links = aligned.select("text_key", F.explode(F.arrays_zip("pair", "times")).alias("l")).select("text_key", "l.pair", "l.times")
    found = links.join(common, "pair", "left")
    measures = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum")]
    if taken <= most_common:
        return found.groupBy("text_key").agg(*measures)
    rare = found.filter("count IS NULL").select("text_key", "pair", "times").join(use.filter(size < least).drop("n_texts"), "pair")
    parts = [x.groupBy("text_key").agg(*measures) for x in (found.filter("count IS NOT NULL"), rare)]
    return parts[0].unionByName(parts[1]).groupBy("text_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def token_alignment(docs: DataFrame, first_path: str, second_path: str, most_common: int = MOST_COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A is a byte-level vocabulary of the tokenizers library, given a space and the text; B a
    sentencepiece model, which adds the space itself. Groups end where tokens of both end; a link is a
    pair of token occurrences that share a byte. The count of an id pair is the number of rows of
    ``docs`` whose text links it. Texts that are null or empty, or whose tokens do not give back the
    bytes (a U+2581 in the text, for one), have zeros and an empty groups_sha256. Strings of special
    tokens are plain text. A text is held whole by one task, however long. Rows that repeat are rows
    of their own; a null doc_id is kept; other columns are ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = cut_lineage(aligned_texts(d, first_path, second_path))
    counts = cut_lineage(pair_counts(aligned, vocabulary_width(second_path)))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    measures = link_measures(aligned, counts, most_common)
    texts = aligned.select("text_key", *numbers, "groups_sha256").join(measures, "text_key")
    ids = d.select("doc_id", F.when(F.col("text") != "", _key("text")).alias("text_key"))
    return ids.join(texts, "text_key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*numbers, "n_best", "count_sum"]], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
