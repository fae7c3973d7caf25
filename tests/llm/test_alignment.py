"""Token alignment against a plain comparison of all byte ranges."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from counterlift.llm.alignment import token_alignment
from counterlift.llm.tokenize import BYTE_ALPHABET

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _tokens(text):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    back = {chr(c): b for b, c in BYTE_ALPHABET.items()}
    a = tok.encode(f" {text}", add_special_tokens=False)
    first = [(i, bytes(back.get(c, ord(c)) for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    second = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        second.append((i, bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    return first, second


def _spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def _brute(rows):
    links, facts = {}, {}
    for n, (_, text) in enumerate(rows):
        if not text:
            continue
        first, second = _tokens(text)
        if b"".join(r for _, r in first) != f" {text}".encode() or b"".join(r for _, r in second) != f" {text}".encode():
            continue
        a, b = _spans(first), _spans(second)
        links[n] = [(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo < e <= hi) for side in (a, b)))
            lo = hi
        facts[n] = (len(a), len(b), len(groups), len(links[n]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(p for x in links.values() for p in set(x))
    top = defaultdict(int)
    for (a, _), c in count.items():
        top[a] = max(top[a], c)
    out = []
    for n, (doc_id, _) in enumerate(rows):
        if n not in facts:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        *numbers, sha = facts[n]
        out.append((doc_id, *numbers, sum(count[p] == top[p[0]] for p in links[n]), sum(count[p] for p in links[n]), sha))
    return sorted(out, key=repr)


ROWS = [
    (1, "The quick brown fox, naïvely, jumps over 1234 dogs."),
    (2, "The quick brown fox, naïvely, jumps over 1234 dogs."),
    (3, "  two  spaces\tand\nlines \n\n end  "),
    (4, "日本語のテキスト und Straßenbahn"),
    (5, "<|endoftext|> and <s> </s> <unk> are text"),
    (6, "a ▁ mark that is not given back"),
    (7, None),
    (8, ""),
    (9, " "),
    (10, "x" * 300),
    (None, "no id here"),
    (11, "emoji 👩‍👩‍👧 and \u0000 byte"),
    (12, "word " * 400),
    (1, "The quick brown fox, naïvely, jumps over 1234 dogs."),
]


@pytest.mark.parametrize("most_common", [1_000_000, 20, 0])
def test_equals_all_byte_ranges(spark, most_common):
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in ROWS], "doc_id long, text string, n_a string, pair int")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r[c] for c in names) for r in token_alignment(docs, A, B, most_common).collect()), key=repr)
    assert got == _brute(ROWS)


def test_empty_table(spark):
    assert token_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
