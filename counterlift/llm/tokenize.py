"""Token ids of whole texts by a public tokenizer, with a bounded cache of encoded pieces.

A text of common Latin characters is cut into the pieces of the tokenizer's own pattern; every
distinct piece is merged once per worker by the tokenizers library. Other texts are cut at lone
spaces, which no token crosses, and each distinct chunk is encoded once.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

CACHE_CHUNKS = 200_000  # encoded pieces, and chunks, that a worker keeps, about 40 MB of each

# ASCII without control characters, and Latin-1 letters: here the tokenizers' patterns need no Unicode tables
SIMPLE = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
# The patterns of the two vocabularies, on such texts; letters, the usual case, are tried first, as no other part begins with one
GLUED = re.compile(
    r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|\s+(?!\S)|\s+"
)
LOWER = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
# One word of Latin letters and ASCII marks after it: the library cuts it at that place and nowhere else
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
# White space next to white space, or at an end: a space may then belong to a run
RUN = re.compile(r"\s\s|\A\s|\s\Z")


def _byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in order, from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_ALPHABET = _byte_alphabet()
SPACE = chr(BYTE_ALPHABET[32])


@lru_cache(maxsize=4)
def load(path: str, plain: bool = False):
    """The tokenizer; ``plain`` says that strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    return tok


@lru_cache(maxsize=4)
def worker_encoder(path: str, glue: bool, plain: bool = False) -> ChunkEncoder:
    """The one encoder of this Python worker, so that its cache outlives a task."""
    return ChunkEncoder(path, glue, plain)


class Pieces(dict):
    """Ids by piece, each merged when first asked for. Those asked for since the last ``turn`` and those of the turn before are kept."""

    def __init__(self, model):
        self.model = model
        self.before: dict[str, bytes] = {}

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        if piece.isascii() and piece[-1] > " ":
            text = f"{SPACE}{piece[1:]}" if piece[0] == " " else piece
        else:
            text = piece.encode().decode("latin-1").translate(BYTE_ALPHABET)
        ids = self[piece] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids


class ChunkEncoder:
    """Ids of texts. ``glue`` says that a space belongs to the chunk after it (byte-level BPE);
    otherwise white space is dropped by the tokenizer."""

    def __init__(self, path: str, glue: bool, plain: bool = False):
        self.tok, self.glue = load(path, plain), glue
        self.model = self.tok.model
        added = [] if plain else [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.known: dict[str, bytes] = {}  # chunks that follow a space
        self.pieces = Pieces(self.model)

    def _simple(self, text: str) -> bytes:
        found = GLUED.findall(text) if self.glue else LOWER.findall(text.lower())
        return b"".join(map(self.pieces.__getitem__, found))

    def _library(self, text: str) -> bytes:
        """The library's own steps: normalise, cut into pieces, merge each piece."""
        tok = self.tok
        text = tok.normalizer.normalize_str(text) if tok.normalizer is not None else text
        pieces = tok.pre_tokenizer.pre_tokenize_str(text) if text else []
        return array("I", [t.id for piece, _ in pieces for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str, lead: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if plain:
            word, marks = plain.groups()
            ids = self.pieces[f"{lead}{word}" if self.glue else word.lower()]
            return ids + self.pieces[marks] if marks else ids
        head, line, tail = chunk.partition("\n")
        if line and head and tail:
            return self._chunk(head, lead) + (self._library("\n") if self.glue else b"") + self._chunk(tail, "")
        return self._library(lead + chunk) if chunk else b""

    def encode(self, texts: list[str], lead: str = "") -> list[np.ndarray]:
        """uint32 ids of each text after ``lead``, nothing or a space. One that holds an added token's string is left to the library as a whole."""
        whole = {i for i, t in enumerate(texts) if self.added and self.added.search(t)}
        if whole:
            ids = iter(self.encode([t for i, t in enumerate(texts) if i not in whole], lead))
            return [np.array(self.tok.encode(lead + t, add_special_tokens=False).ids, np.uint32) if i in whole else next(ids) for i, t in enumerate(texts)]
        if len(self.pieces) > CACHE_CHUNKS // 2:
            self.pieces.turn()
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        return [np.frombuffer(self._simple(lead + t) if SIMPLE.fullmatch(t) else self._odd(t, lead), np.uint32) for t in texts]

    def _odd(self, text: str, lead: str) -> bytes:
        if self.glue and RUN.search(text):
            return self._runs(lead + text)
        chunks, known = text.split(" "), self.known
        for c in set(chunks[1:]) - known.keys():
            known[c] = self._chunk(c, " ")
        return b"".join([self._chunk(chunks[0], lead), *map(known.__getitem__, chunks[1:])])

    def _runs(self, text: str) -> bytes:
        """A text with runs of white space: cut only at spaces between two other characters."""
        parts = re.split(r"(?<=\S) (?=\S)", text)
        return self._library(parts[0]) + b"".join(self._chunk(p, " ") if PLAIN.fullmatch(p) else self._library(f" {p}") for p in parts[1:])
