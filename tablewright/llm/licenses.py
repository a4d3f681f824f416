"""Licence notices: an Aho-Corasick scan of whole texts, and SPDX-like expressions.

Texts are scanned as their lower-cased words, joined by single spaces, so that
line breaks and punctuation inside a phrase don't matter. One automaton holds
the notice phrases, exceptions and the identifier tag; what follows a tag in its
line is read as an expression of licence names, ``and``, ``or``, ``with`` and
brackets by a shunting-yard parser. An expression counts if it names a known
licence or anything of an identifier's shape; it adds the labels of the known
ones. Names that aren't known are reported and hold never; ``with`` holds before
a known exception only.

The same parser reads notices in prose: phrases that the automaton found are
operands (with a version and "or later" where they follow), words and brackets
between them operators, so "the Apache License, Version 2.0, or the MIT License"
is ``apache-2.0 or mit``. Expressions are evaluated against the accepted
licences: a text is permitted if all of its expressions hold.

The score is the chance that a text is under a licence of the found kinds, from
the strength of the evidence: 1 - product of (1 - weight) over distinct labels.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, text_or_empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Phrases of the base scan and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Further notice phrases and their labels.
NOTICES = {
    "apache license": "apache-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 3 clause clear": "bsd-3-clause-clear",
    "cc0": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "licensed under the mit": "mit",
    "mit license": "mit",
    "mozilla public license": "mpl-2.0",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
}
# The words of the identifier tag.
TAG = "spdx license identifier"
# How strongly a phrase, and a parsed expression, speak for a licence.
WEIGHTS = {"phrase": 0.7, "expression": 0.95}

# Licence identifiers that an expression can name, lower-case, and exceptions.
KNOWN = frozenset("0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gfdl-1.3 gpl-2.0 gpl-2.0+ gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0+ gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1 lgpl-2.1+ lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ms-pl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 postgresql psf-2.0 python-2.0 ruby unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split())
EXCEPTIONS = frozenset("autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception openjdk-assembly-exception-1.0 swift-exception".split())
# Exceptions as notices name them.
EXCEPTION_PHRASES = {
    "autoconf exception": "autoconf-exception-3.0",
    "bison exception": "bison-exception-2.2",
    "classpath exception": "classpath-exception-2.0",
    "font exception": "font-exception-2.0",
    "gcc runtime library exception": "gcc-exception-3.1",
    "linking exception": "linking-exception",
    "linux syscall note": "linux-syscall-note",
    "llvm exception": "llvm-exception",
    "llvm exceptions": "llvm-exception",
    "swift exception": "swift-exception",
}
# Labels whose phrase names a licence in prose: the name before a version, where versions matter, or the whole name.
VERSIONED = {"agpl": "agpl", "apache-2.0": "apache", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-nc-nd": "cc-by-nc-nd", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "gpl": "gpl", "lgpl": "lgpl", "mpl-2.0": "mpl"}
WHOLE = {"bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "bsd-3-clause-clear": "bsd-3-clause-clear", "cc0": "cc0-1.0", "isc": "isc", "mit": "mit"}
# Words that may stand between licences and operators in prose.
FILLERS = frozenset("a an at choice either following gnu its licence license of option terms the under your".split())
# The licences that are accepted unless others are named.
ACCEPTED = frozenset("0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc0-1.0 isc mit mit-0 ncsa postgresql psf-2.0 python-2.0 unlicense upl-1.0 x11 zlib".split())

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+_-]*")
_RANK = {"or": 1, "and": 2, "with": 3}
_AFTER_TAG = re.compile(r"spdx[^0-9a-zA-Z\x80-\U0010FFFF]+license[^0-9a-zA-Z\x80-\U0010FFFF]+identifier[^0-9a-zA-Z\x80-\U0010FFFF(\r\n]*", re.IGNORECASE)
_BLANKS = re.compile(r"[^\S\r\n]*")
_SHAPED = re.compile(r".*[0-9.-]")
_GAP = re.compile(r"[()]|[.!?;](?=\s)|\n[^\S\n]*\n")
_NUMBER = re.compile(r"v?([0-9]{1,2})$")
_LATER = re.compile(r"or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?(?: at your option)?(?= |$)")
_BREAK = ""
DEPTH = 32


@dataclass(frozen=True)
class Expression:
    """postfix: names and operators in evaluation order."""

    postfix: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        """Licences and exceptions, in the order of the text."""
        return [t for t in self.postfix if t not in _RANK]

    @property
    def licences(self) -> list[str]:
        """Names but for those that a ``with`` adds."""
        return [t for t, after in zip(self.postfix, (*self.postfix[1:], "")) if t not in _RANK and after != "with"]

    def holds(self, accepted: frozenset[str]) -> bool:
        """Whether accepted names satisfy it; ``a with e`` needs the licence a, and e to be a known exception."""
        stack: list[tuple[bool, bool]] = []  # holds, is the name of a known exception
        for t in self.postfix:
            if t in _RANK:
                (right, exception), (left, _) = stack.pop(), stack.pop()
                stack.append((left or right if t == "or" else left and (exception if t == "with" else right), False))
            else:
                stack.append((t in accepted, t in EXCEPTIONS or t in EXCEPTION_PHRASES.values()))
        return stack[0][0]


def _tokens(text: str, at: int, ends: list[int]) -> Iterator[str]:
    """Names, operators and brackets from at on, up to the line's end or anything else; their ends are added to ends."""
    while t := _TOKEN.match(text, _BLANKS.match(text, at).end()):
        at = t.end()
        ends.append(at)
        yield t[0].lower().rstrip(".")


def shunt(tokens: Iterable[str]) -> tuple[Expression | None, int]:
    """The longest expression that tokens begin with, None without one, and its number of tokens. Operators bind with, and, or; those of one kind to the left; brackets nest up to DEPTH."""
    best, size = None, 0  # names and operators written so far, operators that wait
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the last token ended an operand
    depth = 0
    for n, t in enumerate(tokens, 1):
        if t == "(":
            if operand or depth == DEPTH:
                break
            waiting.append(t)
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif t in _RANK:
            if not operand:
                break
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = False
        else:
            if operand or t == _BREAK:
                break
            out.append(t)
            operand = True
        if operand and not depth:
            best, size = (len(out), tuple(reversed(waiting))), n
    return (Expression((*out[: best[0]], *best[1])) if best else None), size


def parse_until(text: str, at: int = 0) -> tuple[Expression | None, int]:
    """The longest expression that begins at a place of text and ends in its line, None without one, and its end. Names are lower-cased."""
    ends: list[int] = []
    found, size = shunt(_tokens(text, at, ends))
    return found, ends[size - 1] if size else at


def parse(text: str, at: int = 0) -> Expression | None:
    return parse_until(text, at)[0]


def _version(words: list[str], gaps: list[str], at: int) -> tuple[str, int]:
    """A version at word at, as major.minor, and the word after it; '' and at without one."""
    first = at + (at < len(words) and words[at] in ("version", "v"))
    if first == len(words) or not (major := _NUMBER.match(words[first])):
        return "", at
    after = first + 1
    minor = "0"
    while after < len(words) and gaps[after] == "." and words[after].isdecimal():
        minor = words[after] if after == first + 1 else minor
        after += 1
    return f"{int(major[1])}.{minor}", after


def _operand(label: str, words: list[str], gaps: list[str], at: int) -> tuple[str, int]:
    """The name of a licence whose phrase ends before word at, with what follows of version, "only" and "or later", and the word after it."""
    if label in WHOLE:
        return WHOLE[label], at
    version, after = _version(words, gaps, at)
    if not version:
        return label, at
    name = f"{VERSIONED[label]}-{version}"
    if "gpl" in label:
        if later := _LATER.match(" ".join(words[after : after + 9])):
            return f"{name}-or-later", after + later[0].count(" ") + 1
        if gaps[after].startswith("+"):
            return f"{name}-or-later", after
        if words[after : after + 1] == ["only"]:
            return f"{name}-only", after + 1
    return name, after


def notice_tokens(words: list[str], gaps: list[str], found: list[tuple[int, int, str]]) -> list[str]:
    """What notices say, as tokens of expressions, with breaks where one can't go on.

    gaps: the text before each word and after the last one. found: (first
    word, words, label or exception) of phrases, leftmost first and of those
    that begin together the longest first; what overlaps an earlier one is left out.
    A sentence's end, an empty line or a word that is neither operator nor filler
    is a break.
    """
    out: list[str] = []
    at = 0

    def gap(k: int) -> None:
        out.extend(t if t in "()" else _BREAK for t in _GAP.findall(gaps[k]))

    for first, n, label in found:
        if first < at:
            continue
        reach = max(at, first - 16)
        if reach > at or not out:
            if out:
                gap(at)
            out.append(_BREAK)
        for k in range(reach, first):
            if k > at or reach == at:
                gap(k)
            if words[k] == "or" and out[-1:] == ["and"] and gaps[k] == "/":
                out[-1] = "or"
            elif words[k] in _RANK:
                out.append(words[k])
            elif words[k] not in FILLERS:
                out.append(_BREAK)
        gap(first)
        if label in VERSIONED or label in WHOLE:
            name, at = _operand(label, words, gaps, first + n)
            if out[-1] == "with":
                out[-1] = _BREAK  # no exception
        else:
            after = out[-1] == "with" and len(out) > 1 and out[-2] not in (_BREAK, "(", *_RANK)
            name, at = (label if after else _BREAK), first + n
        out.append(name)
    if out:
        gap(at)
    return out


def notices(tokens: list[str]) -> list[Expression]:
    """All expressions of tokens, one after the other."""
    out, at = [], 0
    while at < len(tokens):
        found, size = shunt(_from(tokens, at)) if tokens[at] not in _RANK and tokens[at] not in (_BREAK, ")") else (None, 0)
        if found:
            out.append(found)
        at += size or 1
    return out


def _from(tokens: list[str], at: int) -> Iterator[str]:
    while at < len(tokens):
        yield tokens[at]
        at += 1


@dataclass
class Scan:
    words: int = 0
    hits: list[tuple[int, int, str]] = field(default_factory=list)  # first word, words, base label
    more: list[tuple[int, int, str]] = field(default_factory=list)  # of the method's own phrases
    tagged: list[Expression] = field(default_factory=list)
    noticed: list[Expression] = field(default_factory=list)

    @property
    def expressions(self) -> list[Expression]:
        """Different ones, those of tags first."""
        return list(dict.fromkeys([*self.tagged, *self.noticed]))

    @property
    def unknown(self) -> set[str]:
        """Names in expressions of tags that are no known licence, nor an exception behind ``with``."""
        return {n for e in self.tagged for n in e.names if n not in KNOWN and (n in e.licences or n not in EXCEPTIONS)}

    @property
    def labels(self) -> set[str]:
        return {x for _, _, x in [*self.hits, *self.more]} | {n for e in self.tagged for n in e.licences if n in KNOWN}

    def permitted(self, accepted: frozenset[str]) -> bool | None:
        """Whether accepted licences satisfy all expressions; None without any."""
        return all(e.holds(accepted) for e in self.expressions) if self.expressions else None

    @property
    def score(self) -> float:
        by_phrase = {x for _, _, x in [*self.hits, *self.more]}
        left = 1.0
        for label in self.labels:
            left *= 1 - WEIGHTS["phrase" if label in by_phrase else "expression"]
        return 1 - left


def outermost(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """hits (first word, words, label) without those that lie within a longer one."""
    out: list[tuple[int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not out or hit[0] + hit[1] > out[-1][0] + out[-1][1] or hit[:2] == out[-1][:2]:
            out.append(hit)
    return out


class Scanner:
    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None):
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", BASE if base is None else base), ("more", NOTICES if notices is None else notices), ("exception", EXCEPTION_PHRASES), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                kinds.setdefault(f" {phrase} ", []).append((kind, label))
        for phrase, own in kinds.items():
            self.automaton.add_word(phrase, (len(phrase), phrase.count(" ") - 1, own))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> Scan:
        text = text or ""
        lowered = text.translate(_UPPER)
        words = WORD.findall(lowered)
        out = Scan(words=len(words))
        joined = f" {' '.join(words)} "
        counted = at = 0
        tagged = False
        spoken: list[tuple[int, int, str]] = []
        for end, (size, n, own) in self.automaton.iter(joined):
            start = end - size + 1
            if start >= at:
                counted, at = counted + joined.count(" ", at, start), start
                first = counted
            else:
                first = counted - joined.count(" ", start, at)
            for kind, label in own:
                if kind in ("base", "more"):
                    (out.hits if kind == "base" else out.more).append((first, n, label))
                if kind == "exception" or label in VERSIONED or label in WHOLE:
                    spoken.append((first, n, label))
            tagged |= own[0][0] == "tag"
        out.more = outermost(out.more)
        read: list[tuple[int, int]] = []  # where expressions of tags stand
        if tagged:
            for m in _AFTER_TAG.finditer(text):
                e, end = parse_until(text, m.end())
                if e and any(n in KNOWN or _SHAPED.match(n) for n in e.licences):
                    out.tagged.append(e)
                    read.append((m.end(), end))
        if spoken and read:
            starts = [m.start() for m in WORD.finditer(lowered)]
            spoken = [hit for hit in spoken if not (k := bisect_right(read, (starts[hit[0]], len(text)))) or starts[hit[0]] >= read[k - 1][1]]
        if spoken:
            spoken.sort(key=lambda hit: (hit[0], -hit[1]))
            out.noticed = notices(notice_tokens(words, WORD.split(lowered), spoken))
        return out


def scan(docs: DataFrame, accepted: frozenset[str] = ACCEPTED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions (array of their postfix forms), permitted, score, unknown (names in expressions of tags that are no known licence, sorted and comma-joined).

    Null texts are empty. Without hits the counts and the score are 0, first_word and
    last_word null, labels ''; without expressions permitted is null. A tag
    whose line ends after it, or that no expression follows with a known licence or a
    name of an identifier's shape (a digit, hyphen or dot in it), counts for nothing. Repeated rows each keep a row. Other columns
    are not carried.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in sliced(batches):
            found = [scanner(t) for t in batch.column("text").to_pylist()]
            starts = [[h[0] for h in f.hits] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f.words for f in found], pa.int64()),
                    pa.array([len(f.hits) for f in found], pa.int64()),
                    pa.array([min(s) if s else None for s in starts], pa.int64()),
                    pa.array([max(s) if s else None for s in starts], pa.int64()),
                    pa.array([",".join(sorted({h[2] for h in f.hits})) for f in found], pa.string()),
                    pa.array([",".join(sorted(f.labels)) for f in found], pa.string()),
                    pa.array([[" ".join(e.postfix) for e in f.expressions] for f in found], pa.list_(pa.string())),
                    pa.array([f.permitted(accepted) for f in found], pa.bool_()),
                    pa.array([f.score for f in found], pa.float64()),
                    pa.array([",".join(sorted(f.unknown)) for f in found], pa.string()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "permitted", "score", "unknown"],
            )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, permitted boolean, score double, unknown string")
