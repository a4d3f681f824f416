"""SQL that users of the configuration write, made to run on Spark.

Texts are read as tokens with their places, so what stands in quotes or comments
is never touched, and brackets are matched. Functions and notations that Spark
lacks are substituted: strftime with a literal format, slices s[a:b] of any
expression, string_agg without a separator, quoted names, and unordered row
numbers, which become a column of numbers that the caller provides. What is
left is Spark SQL, which Spark's own parser reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


class DialectError(ValueError):
    """SQL that can't be made to run on Spark."""


# Date format codes and Spark's letters for them.
CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%h": "MMM", "%A": "EEEE", "%a": "EEE", "%p": "a", "%f": "SSSSSS", "%g": "SSS", "%-d": "d", "%-m": "M", "%-H": "H", "%-I": "h", "%-M": "m", "%-S": "s", "%-j": "D"}
# Codes that stand for several.
WHOLE = {"%x": "%Y-%m-%d", "%X": "%H:%M:%S", "%c": "%Y-%m-%d %H:%M:%S"}

_TOKEN = re.compile(r"""(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<note>--[^\n]*|/\*.*?\*/)|(?P<space>\s+)|(?P<word>[^\W\d]\w*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<mark>::|\|\||<>|!=|<=|>=|.)""", re.S)
OPEN, CLOSE = "([", ")]"


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    def __eq__(self, other: object) -> bool:
        return self.text.lower() == other if isinstance(other, str) else self is other

    __hash__ = object.__hash__


def tokens(sql: str) -> list[Token]:
    """The tokens of sql, comments as spaces."""
    return [Token("space", " ") if m.lastgroup == "note" else Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]


def joined(parts: list[Token]) -> str:
    return "".join(t.text for t in parts)


def solid(parts: list[Token]) -> list[Token]:
    """parts without spaces."""
    return [t for t in parts if t.kind != "space"]


def closing(parts: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at at."""
    depth = 0
    for k in range(at, len(parts)):
        depth += (parts[k].text in OPEN) - (parts[k].text in CLOSE) if parts[k].kind == "mark" else 0
        if not depth:
            return k
    raise DialectError(f"a bracket isn't closed in {joined(parts)!r}")


def split(parts: list[Token], *at: str) -> list[list[Token]]:
    """parts cut at marks or words that stand outside brackets."""
    out, depth = [[]], 0
    for t in parts:
        if t.kind == "mark":
            depth += (t.text in OPEN) - (t.text in CLOSE)
        if not depth and t.kind in ("mark", "word") and t.text.lower() in at:
            out.append([])
        else:
            out[-1].append(t)
    return out


def statements(sql: str) -> list[str]:
    return [s for p in split(tokens(sql), ";") if (s := joined(p).strip())]


def unquoted(name: str) -> str:
    """A name as it is meant, without its quotes."""
    q = name[:1]
    return name[1:-1].replace(q + q, q) if q in ('"', "`") else name


def _next(parts: list[Token], at: int) -> int:
    """The next place from at on that isn't a space."""
    while at < len(parts) and parts[at].kind == "space":
        at += 1
    return at


def date_format(codes: str) -> str:
    """A date format of % codes as Spark's letters, all other text quoted."""
    out, plain = [], ""
    for whole, own in WHOLE.items():
        codes = re.sub(rf"(?<!%)((?:%%)*){whole}", lambda m, own=own: m[1] + own, codes)
    for code in re.findall(r"%-?.|%|[^%]+", codes, re.S):
        if code == "%%":
            plain += "%"
        elif not code.startswith("%"):
            plain += code
        elif code in CODES:
            out += [f"'{plain.replace(chr(39), chr(39) * 2)}'"] if plain else []
            out, plain = [*out, CODES[code]], ""
        else:
            raise DialectError(f"strftime has no code {code!r} here")
    out += [f"'{plain.replace(chr(39), chr(39) * 2)}'"] if plain else []
    return "".join(out)


def _operand(parts: list[Token]) -> int:
    """Where the expression begins that parts end with: a bracket with what calls it, a name with its qualifiers, or a literal."""
    k = len(parts) - 1
    while parts[k].kind == "space":
        k -= 1
    if parts[k].text in CLOSE:
        depth = 0
        while True:
            depth += (parts[k].text in CLOSE) - (parts[k].text in OPEN) if parts[k].kind == "mark" else 0
            if not depth:
                break
            k -= 1
        if not k or parts[k - 1].kind not in ("word", "name") and parts[k - 1].text not in CLOSE:
            return k
        return _operand(parts[:k])
    while k >= 2 and parts[k - 1] == "." and parts[k - 2].kind in ("word", "name"):
        k -= 2
    return k


def _slices(parts: list[Token]) -> list[Token]:
    out: list[Token] = []
    k = 0
    while k < len(parts):
        if parts[k] != "[" or not solid(out) or solid(out)[-1].kind == "mark" and solid(out)[-1].text not in CLOSE:
            out.append(parts[k])
            k += 1
            continue
        end = closing(parts, k)
        bounds = split(parts[k + 1 : end], ":")
        if len(bounds) != 2:
            out += parts[k : end + 1]
        else:
            start = _operand(out)
            own = joined(out[start:]).strip()
            low, high = (joined(_slices(b)).strip() or "NULL" for b in bounds)
            if low.isdigit() and high.isdigit():  # as Spark counts them
                made = f"substring({own}, {max(1, int(low))}, {int(high) - max(0, int(low) - 1)})"
            else:
                made = f"text_slice({own}, {low}, {high})"
            out = [*out[:start], Token("word", made)]
        k = end + 1
    return out


def _call(parts: list[Token], at: int, name: str) -> int | None:
    """The place of the bracket where a call of name at at opens."""
    if parts[at].kind != "word" or parts[at] != name:
        return None
    k = _next(parts, at + 1)
    return k if k < len(parts) and parts[k] == "(" else None


# Type names of the configuration's SQL and Spark's.
TYPES = {"text": "string", "varchar": "string", "integer": "int", "real": "float"}


def _typed(own: list[Token], whole: bool = False) -> list[Token]:
    """The inside of a cast, or its type alone, with Spark's name of the type."""
    k = max((j for j, t in enumerate(own) if t.kind == "word"), default=None)
    if k is None or solid(own[k + 1 :]) or not whole and not (k and "as" in [t.text.lower() for t in own[:k] if t.kind == "word"]):
        return own
    return [*own[:k], Token("word", TYPES.get(own[k].text.lower(), own[k].text)), *own[k + 1 :]]


def _calls(parts: list[Token]) -> list[Token]:
    out: list[Token] = []
    k = 0
    while k < len(parts):
        if (start := _call(parts, k, "strftime")) is not None:
            end = closing(parts, start)
            args = split(parts[start + 1 : end], ",")
            texts = [solid(a) for a in args]
            if len(args) != 2 or not any(len(t) == 1 and t[0].kind == "text" for t in texts):
                raise DialectError(f"strftime needs a literal format: {joined(parts[k : end + 1])}")
            which = 1 if len(texts[1]) == 1 and texts[1][0].kind == "text" else 0
            form = date_format(texts[which][0].text[1:-1].replace("''", "'"))
            value = joined(_calls(args[1 - which])).strip()
            out.append(Token("word", "date_format(CAST({} AS TIMESTAMP), '{}')".format(value, form.replace("\\", "\\\\").replace("'", "\\'"))))
            k = end + 1
        elif (start := _call(parts, k, "cast") or _call(parts, k, "try_cast")) is not None:
            end = closing(parts, start)
            out += [*parts[k : start + 1], *_calls(_typed(parts[start + 1 : end]))]
            k = end
        elif parts[k] == "::" and (at := _next(parts, k + 1)) < len(parts):
            out += [parts[k], *_typed(parts[at : at + 1], True)]
            k = at + 1
        elif (start := _call(parts, k, "string_agg")) is not None:
            end = closing(parts, start)
            own = parts[start + 1 : end]
            if len(split(own, ",")) == 1 and len(split(own, "order")) == 1:
                out += [*parts[k : start + 1], *_calls(own), Token("mark", ", ','")]
            else:
                out += [*parts[k : start + 1], *_calls(own)]
            k = end
        else:
            out.append(parts[k])
            k += 1
    return out


def unordered(parts: list[Token], at: int) -> int | None:
    """The place after an unordered row_number() OVER () that starts at at."""
    k, want = at, ["row_number", "(", ")", "over", "(", ")"]
    for w in want:
        k = _next(parts, k)
        if k >= len(parts) or parts[k].kind not in ("word", "mark") or parts[k] != w:
            return None
        k += 1
    return k


def with_places(sql: str, column: str) -> str:
    """sql with a column of row numbers in place of unordered row_number()."""
    return joined(_placed(tokens(sql), column))


def _placed(parts: list[Token], column: str) -> list[Token]:
    out, k = [], 0
    while k < len(parts):
        if parts[k].kind == "word" and (end := unordered(parts, k)) is not None:
            out.append(Token("word", column))
            k = end
        else:
            out.append(parts[k])
            k += 1
    return out


def adapt(sql: str) -> str:
    """sql as Spark SQL. Unordered row numbers that are left follow the rows' own numbers."""
    parts = _placed(_slices(_calls(tokens(sql))), "row_number() OVER (ORDER BY _row_number)")
    own = solid(parts)
    likes = {id(b) for a, b, c in zip(own, own[1:], [*own[2:], Token("space", "")]) if a.kind == "word" and a.text.lower() in ("like", "ilike") and c != "escape"}
    return joined([_written(t, id(t) in likes) for t in parts])


def _written(t: Token, pattern: bool = False) -> Token:
    """Names in Spark's quotes; in texts, patterns of LIKE too, backslashes stand for themselves and doubled quotes for one."""
    if pattern and t.kind == "text":
        t = Token("text", t.text.replace("\\", "\\\\"))
    if t.kind == "name" and t.text[0] == '"':
        return Token(t.kind, "`" + unquoted(t.text).replace("`", "``") + "`")
    if t.kind == "text" and ("\\" in t.text or "''" in t.text[1:-1]):
        return Token(t.kind, "'" + t.text[1:-1].replace("''", "'").replace("\\", "\\\\").replace("'", "\\'") + "'")
    return t


def outside_quotes(sql: str, change: Callable[[str], str]) -> str:
    """sql with change applied to the parts that stand in no '...' or \"...\"."""
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")", sql)
    return "".join(p if k % 2 else change(p) for k, p in enumerate(parts))


def add_functions(spark: SparkSession) -> None:
    """Functions that Spark lacks, as SQL functions of the session. Slices count from 1, or back from the end; a bound that is left out is null."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION today() RETURNS DATE RETURN current_date()")
    low = "CASE WHEN a IS NULL THEN 1 WHEN a < 0 THEN greatest(length(s) + a + 1, 1) ELSE greatest(a, 1) END"
    high = "CASE WHEN b IS NULL THEN length(s) WHEN b < 0 THEN length(s) + b + 1 ELSE b END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_slice(s STRING, a INT, b INT) RETURNS STRING RETURN substring(s, {low}, greatest({high} - {low} + 1, 0))")
