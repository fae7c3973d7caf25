"""Personal data: base patterns, and spans added by a linear-chain CRF over word shapes.

The CRF's chains are the stretches of a text around words that hold a digit, @, + or a written
"at" or "dot" (``[at]``, ``dot``), with three words on either side; all other words carry no personal
data by definition. It is trained on a small labelled table of written-out and spaced forms and of
look-alikes, and decoded by Viterbi.
"""

from __future__ import annotations

import copy
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm import crf
from counterlift.llm.registry import query, table
from counterlift.llm.textarrays import _MULT, U64, Words, mix, slices, string_column, gives_back

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 4000  # rows of the labelled table that a fit takes at most
AROUND = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _by_start_and_kind(span: tuple[int, int, int]) -> tuple[int, int, int]:
    return span[0], span[2], span[1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match ends at an @, so a search from one @ to the next finds it without retries."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, ordered by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=_by_start_and_kind)


_class = np.full(256, 5, np.uint8)  # marks, unless they have a class of their own
_class[48:58] = 1
_class[65:91] = 2
_class[97:123] = 3
_class[128:] = 4
for _i, _c in enumerate(b"@+.-()_:/=[]{}", 6):
    _class[_c] = _i
_hint = np.zeros(256, bool)
_hint[48:58] = _hint[64] = _hint[43] = True
_open = np.zeros(256, bool)
_open[list(b"[({<")] = True
_NAMED = 5  # words of so many bytes at most count by their letters, longer ones by their shape


def _follows(low: np.ndarray, word: bytes) -> np.ndarray:
    """Bytes after which ``word`` stands, in lower-case bytes."""
    out = np.ones(len(low), bool)
    for k, c in enumerate(word, 1):
        out[:-k] &= low[k:] == c
        out[-k:] = False
    return out


class Stretches:
    """Words near a digit, @, + or a written at or dot, with their features, as chains; ``at`` indexes them in ``words``."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts, keep_case=True)
        self.low = low = np.where((w.raw >= 65) & (w.raw < 91), w.raw + np.uint8(32), w.raw)
        hint = _hint[w.raw]
        for written in (b"at", b"dot") if len(low) else ():
            hint |= _open[w.raw] & _follows(low, written)
        hints = np.concatenate(([0], np.cumsum(hint)))
        marked = hints[w.end] > hints[w.start]
        three = np.flatnonzero(w.end - w.start == 3)
        for k, c in enumerate(b"dot"):
            three = three[low[w.start[three] + k] == c]
        marked[three] = True
        near = marked.copy()
        for k in range(1, AROUND + 1):
            if len(near) > k:
                same = w.doc[k:] == w.doc[:-k]
                near[k:] |= marked[:-k] & same
                near[:-k] |= marked[k:] & same
        self.at = at = np.flatnonzero(near)
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.append(self.first, len(at)))
        self.columns = self._features(at, new)

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        other = copy.copy(self.words)
        other.data, other._sum = data, None
        return other.range_hash(start, end)

    def _features(self, at: np.ndarray, new: np.ndarray) -> list[np.ndarray]:
        """Hashes of a word's shape, its shape without repeats, its letters if short, and those of its neighbours."""
        w = self.words
        start, end, n = w.start[at], w.end[at], len(at)
        if not n:
            return [np.zeros(0, U64) for _ in range(8)]
        kind = _class[w.raw]
        turn = np.ones(len(kind), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn[start] = True
        place = np.concatenate(([0], np.cumsum(turn)))
        shape = self._hashes(kind, start, end)
        short = self._hashes(kind[turn], place[start], place[end])
        name = np.where(end - start <= _NAMED, self._hashes(self.low, start, end), short)

        def beside(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            before, after = np.zeros(n, U64), np.zeros(n, U64)
            before[1:] = np.where(new[1:], U64(0), x[:-1])
            after[:-1] = np.where(new[1:], U64(0), x[1:])
            return before, after

        columns = [shape, short, name, *beside(shape), *beside(name), np.zeros(n, U64)]
        salts = np.arange(1, len(columns) + 1, dtype=U64) * _MULT
        return [mix(c + s) for c, s in zip(columns, salts, strict=True)]

    def spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code-point ranges of words."""
        w = self.words
        a = w.start[rows]
        return w.code_points(a), w.code_points(w.end[rows] - 1) + 1


def fit(rows: list[tuple[str, list[tuple[int, int, int]]]]) -> crf.Chain:
    """CRF trained on the stretches of texts with labelled (start, end, kind) spans."""
    s = Stretches(pa.array([t for t, _ in rows], pa.string()))
    labels = np.zeros(len(s.at), int)
    begin, end = s.spans(s.at)
    bounds = np.searchsorted(s.words.doc[s.at], np.arange(len(rows) + 1))
    for i, (_, spans) in enumerate(rows):
        lo, hi = bounds[i], bounds[i + 1]
        for a, b, kind in spans:
            labels[lo:hi][(begin[lo:hi] < b) & (end[lo:hi] > a)] = kind + 1
    return crf.train(s.columns, labels, s.first, s.length, len(KINDS) + 1)


# The labelled table: {0} to {3} stand for personal data of KINDS, <...> for a draw; the rest carries none.
_FORMS = (
    ("<name> at <name> dot <end>", "<name> [at] <name> [dot] <end>", "<name>[at]<name>.<end>", "<name>(at)<name>.<end>", "<name> (at) <name> (dot) <end>",
     "<name> AT <name> DOT <end>", "<name> @ <name>.<end>", "<name> @ <name> . <end>", "<name>@<name>.<end>", "<name>{at}<name>{dot}<end>"),
    ("<o>.<o>.<o>.<o>", "<o>[.]<o>[.]<o>[.]<o>", "<o> . <o> . <o> . <o>", "<o>(dot)<o>(dot)<o>(dot)<o>", "<o> dot <o> dot <o> dot <o>"),
    ("<f>.<f>.<f>.<f>", "<f>/<f>/<f>/<f>", "<f>_<f>_<f>_<f>", "<f> / <f> / <f> / <f>", "<f>  <f>  <f>  <f>"),
    ("+<c> <t> <t> <f>", "+<c> (<t>) <t>-<f>", "(<t>) <t>-<f>", "<t>-<t>-<f>", "<t>.<t>.<f>", "00<c> <t> <t> <f>", "(0<c>) <t> <t> <f>", "+<c>/<t>/<t><f>"),
)
_FRAMES = (
    "write to {0} please", "mail: {0}", "ask {0} or {0} today", "{0}", "from {1} at night", "host {1} is down", "{1}", "the card {2} was used", "paid with {2} now",
    "card number {2}", "call {3} today", "phone {3}", "tel. {3} or {3}", "reach {0} or {3} soon", "my number is {3} and {0}", "{3}",
)
_OTHER = (
    "on <year>-<m>-<m> it rained", "it costs <t>.<m> in all", "version <m>.<m>.<m> is out", "page <t> of <t> here", "room <f> upstairs", "order <f><f><f><f> came", "the number <f><f><f><f> was drawn",
    "see <name> at <m>:<m> there", "look at the dot there", "one dot more or less", "a dot com firm", "<name> at <name> and <name>", "meet at <m> am", "in <year> and <year>", "isbn <t>-<m>-<f>-<t>-<m>",
    "token = \"<hex>\" <name>", "id <hex> of it", "<f> people <f> times", "<m>% of <f>", "http://<name>.<end>/<t>?q=<m>", "it is <m>.<m>.<year> today", "<name>@<m> said", "<f><f><f> units", "+<m> points",
    "<t> <t> <t> steps", "<m>/<m>/<year> it was", "chapter <m>.<m> says", "a + b = <m>", "<name> <m> <name> <t>", "<f>-<f> season",
)
def labelled_table(rows: int = TRAIN_ROWS, seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) rows made of the forms above, as many with look-alikes as with personal data."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def drawn(form: str) -> str:
        def one(m: re.Match) -> str:
            what = m.group(1)
            if what == "name":
                word = "".join(rng.choices(letters, k=rng.randint(2, 10)))
                return word + rng.choice(("", "", "", f".{rng.choice(letters)}", f"{rng.randint(1, 99)}")) if rng.random() < 0.5 else rng.choice((word, word.title()))
            if what == "end":
                return rng.choice(("com", "org", "net", "de", "fr", "es", "info", "example.com"))
            if what == "hex":
                return "".join(rng.choices("0123456789abcdef", k=rng.choice((8, 16, 32, 40))))
            if what == "year":
                return str(rng.randint(1900, 2030))
            if what in "oc":
                return str(rng.randint(1, 255 if what == "o" else 99))
            return "".join(rng.choices(digits, k={"m": rng.randint(1, 2), "t": 3, "f": 4}[what]))

        return re.sub("<([a-z]+)>", one, form)

    def others() -> list[str]:
        words = ("".join(rng.choices("abcdeghilmnorstuéèñäü", k=rng.randint(1, 11))) for _ in range(rng.randint(0, 5)))
        return [rng.choice((w, w, w, w.title(), w.upper())) + rng.choice(("", "", "", "", ",", ".", "!!", " |")) for w in words]

    out = []
    for i in range(rows):
        frame = rng.choice(_FRAMES) if i % 2 else drawn(rng.choice(_OTHER))
        text, spans = "", []
        for part in re.split(r"(\{[0-3]\})", " ".join([*others(), frame, *others()])):
            if re.fullmatch(r"\{[0-3]\}", part):
                kind = int(part[1])
                form = drawn(rng.choice(_FORMS[kind]))
                spans.append((len(text), len(text) + len(form), kind))
                part = form
            text += part
        out.append((text, spans))
    return out


def _added(text: str, words: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of runs of words with one tag, without outer marks, that touch no base span."""
    runs: list[list[int]] = []
    for a, b, kind in words:
        if runs and runs[-1][2] == kind and text[runs[-1][1] : a].isspace():
            runs[-1][1] = b
        else:
            runs.append([a, b, kind])
    out = []
    for a, b, kind in runs:
        while a < b and text[a] in "\"'<[,;:!?":
            a += 1
        while a < b and text[b - 1] in "\"'>],;:!?.":
            b -= 1
        if a < b and not any(x < b and y > a for x, y, _ in base):
            out.append((a, b, kind))
    return out


def tag(texts: pa.Array, model: crf.Chain) -> Iterator[tuple[str, list, list]]:
    """(text, base spans, added spans) of each text."""
    s = Stretches(texts)
    scores = model.emissions(s.columns)
    state = model.best_path(scores, s.first, s.length) if len(s.at) else np.zeros(0, np.int8)
    hit = np.flatnonzero(state)
    begin, end = s.spans(s.at[hit])
    doc = s.words.doc[s.at[hit]]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    has = np.zeros(len(texts), bool)
    has[s.words.doc[s.at]] = True  # base spans hold a digit or an @ too
    for i, text in enumerate(texts.to_pylist()):
        text = text or ""
        base = base_spans(text) if has[i] else []
        lo, hi = bounds[i], bounds[i + 1]
        words = list(zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), (state[hit[lo:hi]] - 1).tolist(), strict=True))
        yield text, base, _added(text, words, base) if words else []


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=_by_start_and_kind))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, b, k in sorted(spans, key=_by_start_and_kind):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                base, every, clean = [], [], []
                source = string_column(piece, "text")
                for (text, b, more), was in zip(tag(source, shared.value), source.is_null().to_pylist(), strict=True):
                    base.append(joined(b))
                    every.append(joined(b + more) if more else base[-1])
                    clean.append(None if was else masked(text, b + more) if b or more else text)
                names = [*piece.schema.names, "base", "spans", "masked"]
                new = {"base": base, "spans": every, "masked": clean}
                yield pa.record_batch([pa.array(new[c], pa.string()) if c in new else string_column(piece, c) for c in names], names=names)

    return run


def train_pii(labelled: list[tuple[str, list[tuple[int, int, int]]]] | None = None) -> crf.Chain:
    """CRF from the first TRAIN_ROWS rows of a small labelled table of (text, spans); by default that of ``labelled_table``."""
    return fit((labelled_table() if labelled is None else labelled)[:TRAIN_ROWS])


def find_pii(docs: DataFrame, model: crf.Chain) -> DataFrame:
    """The rows of ``docs`` with base, spans (kind:start:end in code points, comma-joined) and masked.

    ``base`` has the base patterns' spans, ``spans`` these and the CRF's, ``masked`` the text with
    all of them replaced. A null text has no spans and stays null, an empty one has none. Every row is
    treated by itself, also repeated ones, and read whole, however long; spans that start together go by
    kind. Other columns pass through, but ones named base, spans or masked are replaced; an empty
    table gives an empty result.
    """
    d = docs.drop("base", "spans", "masked").withColumn("text", F.col("text").cast("string"))
    shared = d.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + ", base string, spans string, masked string"
    return d.mapInArrow(gives_back(_find(shared)), schema)


@query("op5_pii_crf")
def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train_pii()).drop("text", "masked")
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
