"""Personal data in texts: exact patterns, and spans that a BiLSTM-CRF adds.

The patterns (e-mail, IP address, card number, phone) are found in linear time
over the whole text and always stay. The tagger reads characters and adds what
they miss: secrets such as keys, tokens and passwords, a kind of their own, phone
numbers without a plus sign, addresses with letters that the pattern lacks. An
added span must hold a digit or an @, so text further than ``CONTEXT`` characters from any of those
decodes to nothing and only stretches about them are run through the network:
cut into overlapping windows, each character's emissions averaged over its
windows (those where it is central weigh more), and the whole stretch decoded
at once, so no span depends on where a window ended.

The tagger is trained in numpy on labelled spans: at most ``SAMPLE`` windows of
the corpus, labelled by the patterns and left out where their digits belong to
no pattern's span, so that what the patterns miss isn't taught as clean, and
``MADE`` made-up ones, of which those without a span are look-alikes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import Tagger
from .common import sliced, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")
SAMPLE = 1_000
MADE = 2_500
CONTEXT = 24
WINDOW = 64
STRIDE = 32
FEW = 3  # digits of a window outside the patterns' spans, at most, for it to be taught as labelled
SURE = 0.4
_BATCH = 2_048

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of KINDS."""
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-20:] or 0) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", _CARD, 12, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# Character classes: 0 pads, 1 to 7 are kinds of letters and the rest, then marks of their own.
_MARKS = "@.-+()_%/:,;=#'\""


def _class(code: int) -> int:
    c = chr(code)
    if c in _MARKS:
        return 8 + _MARKS.index(c)
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "z":
        return 2
    if "A" <= c <= "Z":
        return 3
    if c in " \t":
        return 4
    if c in "\r\n":
        return 5
    return 6 if code > 127 else 7


CLASSES = 8 + len(_MARKS)
_TABLE = np.array([_class(c) for c in range(128)] + [6], dtype=np.uint8)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 128)]


def stretches(text: str, context: int = CONTEXT) -> list[tuple[int, int]]:
    """Stretches of text within context of a digit or @, merged."""
    own = classes(text)
    at = np.flatnonzero((own == 1) | (own == 8))
    if not len(at):
        return []
    start, end = np.maximum(at - context, 0), np.minimum(at + context + 1, len(text))
    cut = np.flatnonzero(start[1:] > end[:-1])
    return list(zip(start[np.r_[0, cut + 1]].tolist(), end[np.r_[cut, len(at) - 1]].tolist()))


def windows(size: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of windows that cover size characters; each but the last begins a stride after the one before."""
    return [0] if size <= window else [*range(0, size - window, stride), size - window]


def tags_of(spans: list[tuple[str, int, int]], start: int, end: int) -> np.ndarray:
    """0 outside, 1 + 2k and 2 + 2k at the first and the further characters of kind k; of overlapping spans the first stays."""
    out = np.zeros(end - start, np.int64)
    for kind, s, e in spans:
        lo, hi = max(s, start) - start, min(e, end) - start
        if lo < hi and not out[lo:hi].any():
            out[lo:hi] = 2 + 2 * TAGGED.index(kind)
            if s >= start:
                out[lo] -= 1
    return out


def made_up(n: int, seed: int = 9) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts with labelled spans: forms that the patterns find and forms that they miss, and look-alikes without spans."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9))))

    def drawn(letters: str, k: int) -> str:
        own = "".join(letters[int(i)] for i in rng.integers(0, len(letters), k - 2))
        return own + digits(1) + letters[int(rng.integers(len(letters)))]

    def card() -> str:
        own = digits(15)
        return next(own + str(k) for k in range(10) if luhn(own + str(k)))

    def grouped(c: str, sep: str) -> str:
        return sep.join(c[k : k + 4] for k in range(0, 16, 4))

    makers = {
        "email": [lambda: f"{word()}.{digits(2)}@{word()}.{word()}", lambda: f"{word()}@{word()}{digits(1)}.example.com", lambda: f"mü{word()}@{word()}.de"],
        "ip": [lambda: ".".join(str(int(x)) for x in rng.integers(1, 256, 4))],
        "card": [card, lambda: grouped(card(), " "), lambda: grouped(card(), "-")],
        "phone": [lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(7)}"],
        "secret": [lambda: drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20), lambda: "AKIA" + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: drawn("0123456789abcdef", int(rng.integers(16, 41))), lambda: drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_", int(rng.integers(20, 41)))],
        "": [lambda: digits(int(rng.integers(1, 5))), lambda: f"v{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{word().upper()}{digits(2)}", lambda: f"{word()}{digits(int(rng.integers(1, 4)))}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"@{word()}", lambda: digits(12), lambda: f"{digits(1)}.{digits(2)}", lambda: f"{word()}-{digits(2)}-{word()}", lambda: f"{word()}={digits(2)}"],
    }
    named = ["", "", "password=", "passwd: ", "pwd=", "token = \"", "token: ", "secret='", "api_key=", "apikey: \"", "Authorization: ", "key="]
    out = []
    for _ in range(n):
        kind = pick([*TAGGED, "secret", "", "", ""])
        before = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        before += pick([" ", ". ", ", ", ": ", "\n"]) if before else ""
        own = pick(makers[kind])()
        close = ""
        if kind == "secret":
            name = pick(named)
            before, close = before + name, name[-1:] if name[-1:] in "'\"" else ""
        text = before + own + close + pick([" ", ". ", ", ", "\n", ""])
        if text[-1:].isspace():
            text += " ".join(word() for _ in range(int(rng.integers(0, 5))))
        out.append((text[:WINDOW], [(kind, len(before), len(before) + len(own))] if kind else []))
    return out


def sample(docs: DataFrame, size: int = SAMPLE, seed: int = 13) -> list[tuple[str, list[int]]]:
    """At most size windows of the corpus (the least by a hash of their text), each with its tags by the patterns."""
    slim = docs.select(text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                if own := stretches(text):
                    spans = base_spans(text)
                    known = classes(text) == 1
                    for _, s, e in spans:
                        known[s:e] = False
                    for s, e in own:
                        for w in windows(e - s):
                            lo, hi = s + w, min(e, s + w + WINDOW)
                            if known[lo:hi].sum() > FEW:
                                continue
                            rows.append((text[lo:hi], tags_of(spans, lo, hi).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["text", "tags"])

    few = slim.mapInArrow(run, "text string, tags array<long>").orderBy(F.xxhash64("text", F.lit(seed)), "text").limit(size).toArrow()
    return list(zip(few.column("text").to_pylist(), few.column("tags").to_pylist()))


def train(labelled: list[tuple[str, list[int]]], made: int = MADE, steps: int = 600) -> Tagger:
    rows = labelled + [(t, tags_of(s, 0, len(t)).tolist()) for t, s in made_up(made)]
    x, y = (np.zeros((len(rows), WINDOW), np.int64) for _ in "xy")
    mask = np.zeros((len(rows), WINDOW), bool)
    for k, (text, tags) in enumerate(rows):
        n = min(len(text), WINDOW)
        x[k, :n], y[k, :n], mask[k, :n] = classes(text)[:n], tags[:n], True
    tagger = Tagger.fresh(CLASSES, 1 + 2 * len(TAGGED))
    tagger.fit(x, y, mask, steps=steps)
    return tagger


def _plausible(kind: str, text: str) -> bool:
    digits = sum(c in "0123456789" for c in text)
    if kind == "email":
        left, at, right = text.partition("@")
        return bool(left and at) and "." in right.strip(".") and not re.search(r"\s", text)
    if kind == "ip":
        return [p.isascii() and p.isdigit() for p in text.split(".")] == [True] * 4
    if kind == "card":
        return 12 <= digits <= 19 and luhn(re.sub(r"[^0-9]", "", text)) and not re.search(r"[^0-9 -]", text)
    if kind == "secret":
        return len(text) >= 12 and digits > 0 and not re.search(r"[^A-Za-z0-9_+/=.-]", text) and bool(re.search(r"[A-Za-z]", text))
    return 9 <= digits <= 15 and not re.search(r"[^0-9 ().+-]", text)


def tagged(texts: list[str], tagger: Tagger, sure: float = SURE) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in each text: of a form its kind can have, mean probability of their tags at least sure."""
    parts = [(k, s, e) for k, text in enumerate(texts) for s, e in stretches(text)]
    codes: dict[int, np.ndarray] = {}
    weight = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32) + 1
    tags = 1 + 2 * len(TAGGED)
    totals = {n: (np.zeros((e - s, tags), np.float32), np.zeros((e - s, 1), np.float32)) for n, (_, s, e) in enumerate(parts)}
    waiting: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        x = np.zeros((len(waiting), WINDOW), np.int64)
        for r, (_, _, c) in enumerate(waiting):
            x[r, : len(c)] = c
        for (n, w, c), e in zip(waiting, tagger.emissions(x)):
            own = weight[: len(c), None]
            totals[n][0][w : w + len(c)] += e[: len(c)] * own
            totals[n][1][w : w + len(c)] += own
        waiting.clear()

    for n, (k, s, e) in enumerate(parts):
        if k not in codes:
            codes = {k: classes(texts[k])}
        for w in windows(e - s):
            waiting.append((n, w, codes[k][s + w : min(e, s + w + WINDOW)]))
            if len(waiting) >= _BATCH:
                flush()
    if waiting:
        flush()
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for n, (k, s, _) in enumerate(parts):
        total, weights = totals.pop(n)
        e = total / weights
        path = tagger.decode(e)
        if not path.any():
            continue
        shifted = np.exp(e - e.max(axis=1, keepdims=True))
        chance = (shifted / shifted.sum(axis=1, keepdims=True))[np.arange(len(path)), path]
        at = 0
        while at < len(path):
            if not path[at]:
                at += 1
                continue
            kind, end = (path[at] - 1) // 2, at + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            own = texts[k][s + at : s + end]
            if chance[at:end].mean() >= sure and _plausible(TAGGED[kind], own):
                out[k].append((TAGGED[kind], s + at, s + end))
            at = end
    return out


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id and arrays of (kind, start, finish), base and added; added spans overlap no base span.

    Places are code points, finish exclusive. Null texts are empty; without
    spans both arrays are empty. Repeated rows each keep a row. Other columns
    are not carried.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("finish", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            added = [[a for a in own if not any(a[1] < b[2] and b[1] < a[2] for b in known)] for own, known in zip(tagged(texts, shared.value), base)]
            rows = lambda spans: pa.array([[dict(zip(("kind", "start", "finish"), s)) for s in own] for own in spans], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows(base), rows(added)], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:bigint,finish:bigint>>"
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, base {kind}, added {kind}")
