"""JSON text by path, byte for byte: look-ups that keep literals, edits that keep the rest.

A batch of texts gets one index, made by numpy over all its bytes at once: quotes that
no backslash escapes, where strings are, the brackets, commas and colons outside them,
and how deep each of these lies. A path is followed for all texts of the batch
together. What it leads to is a span of bytes, so ``1.10``, 42 digits or ``1e400`` come
back as they were written. An edit puts new bytes into one span and leaves all others.

Texts that aren't exactly one JSON value, that hold a key twice, or that are nested too
deeply to be checked, are ``document_parse_failed``; so is null.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes of errors.
NOT_FOUND, WRONG_TYPE, PARSE_FAILED, UNSUPPORTED, NO_SCALAR, IS_NULL = "document_path_not_found", "document_type_mismatch", "document_parse_failed", "document_unsupported_operation", "document_not_scalar", "document_null_value"
# End of the fixed values.
FOUND = pa.struct([("value", pa.string()), ("error", pa.string())])
_KINDS = {0x22: "string", 0x7B: "object", 0x5B: "array", 0x74: "boolean", 0x66: "boolean", 0x6E: "null"}
NUMBER = r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
OPEN, CLOSE, COMMA, COLON = (0x7B, 0x5B), (0x7D, 0x5D), 0x2C, 0x3A


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key twice")
    return found


def _no(constant: str):
    raise ValueError(constant)


def read(text: str):
    """The value, numbers as they were written; an error unless it is one JSON value."""
    return json.loads(text, parse_int=_Literal, parse_float=_Literal, parse_constant=_no, object_pairs_hook=_once)


class _Literal(str):
    """A number as it was written."""


def written(value, indent: int | None = None, level: int = 0) -> str:
    """JSON text of what :func:`read` gives, keys in their order; with ``indent``, a line
    for each entry."""
    if isinstance(value, _Literal):
        return str(value)
    if isinstance(value, (dict, list)) and value:
        many = isinstance(value, dict)
        parts = [f"{json.dumps(k, ensure_ascii=False)}:{' ' if indent else ''}{written(x, indent, level + 1)}" for k, x in value.items()] if many else [written(x, indent, level + 1) for x in value]
        begin, end = "{}" if many else "[]"
        if indent is None:
            return begin + ",".join(parts) + end
        pad = "\n" + " " * (indent * level)
        return begin + ",".join(pad + " " * indent + p for p in parts) + pad + end
    return json.dumps(value, ensure_ascii=False)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) of all places from ``low`` to ``high``, range after range."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Spans:
    """The index of some texts."""

    def __init__(self, texts: list[str | None]):
        raw, self.valid = [], np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            try:
                read(t)
                self.valid[i] = True
            except (ValueError, RecursionError, TypeError):
                pass
            raw.append(t.encode() if self.valid[i] else b"")
        self.bytes = b"\n".join([*raw, b""])
        self.data = data = np.frombuffer(self.bytes, dtype=np.uint8)
        self.begin = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
        self.stop = self.begin + np.array([len(r) for r in raw], dtype=np.int64)
        # A character is escaped if an odd number of backslashes stands before it.
        slash = data == 0x5C
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        before = np.concatenate([[0], np.arange(len(data) - 1) - plain[:-1]])
        quote = (data == 0x22) & (before % 2 == 0)
        self.quotes = np.flatnonzero(quote)
        self.slashes = np.concatenate([[0], np.cumsum(slash)])
        outside = np.cumsum(quote) % 2 == 0
        marks = np.isin(data, np.array([*OPEN, *CLOSE, COMMA, COLON], dtype=np.uint8)) & outside
        self.at = np.flatnonzero(marks)
        self.mark = data[self.at]
        opens, closes = np.isin(self.mark, OPEN), np.isin(self.mark, CLOSE)
        self.depth = np.cumsum(opens.astype(np.int64) - closes)
        self.closes = closes
        self.solid = np.flatnonzero(~np.isin(data, np.array([0x20, 0x09, 0x0A, 0x0D], dtype=np.uint8)))

    def _next_solid(self, at: np.ndarray) -> np.ndarray:
        return self.solid[np.minimum(np.searchsorted(self.solid, at), len(self.solid) - 1)] if len(self.solid) else at

    def _after_last_solid(self, at: np.ndarray) -> np.ndarray:
        """Where what ends before ``at`` ends without its white space."""
        return self.solid[np.searchsorted(self.solid, at) - 1] + 1 if len(self.solid) else at

    def roots(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._next_solid(self.begin[rows]), self._after_last_solid(self.stop[rows])

    def separators(self, start: np.ndarray, end: np.ndarray, marks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(which, index into ``at``) of the marks that stand directly in the containers."""
        low, high = np.searchsorted(self.at, start), np.searchsorted(self.at, end)
        which, place = _ranges(low + 1, high)
        own = (self.depth[place] == self.depth[low][which]) & np.isin(self.mark[place], marks)
        return which[own], place[own]

    def _ends(self, start: np.ndarray, end: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Where the values end that begin after the marks ``after`` of the containers."""
        low, high = np.searchsorted(self.at, start), np.searchsorted(self.at, end)
        which, place = _ranges(after + 1, high)
        ends = ((self.mark[place] == COMMA) & (self.depth[place] == self.depth[low][which])) | (place == (high - 1)[which])
        first = np.full(len(start), np.iinfo(np.int64).max)
        np.minimum.at(first, which[ends], self.at[place[ends]])
        return self._after_last_solid(first)

    def _keys(self, colon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The quotes around the keys before colons."""
        close = np.searchsorted(self.quotes, self.at[colon]) - 1
        return self.quotes[close - 1], self.quotes[close]

    def members(self, start: np.ndarray, end: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
        """(which, colon) of the members of objects that have this key."""
        which, colon = self.separators(start, end, (COLON,))
        first, last = self._keys(colon)
        want = np.frombuffer(key.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        escaped = self.slashes[last] > self.slashes[first]
        same = ~escaped & (last - first - 1 == len(want))
        at = np.flatnonzero(same)
        same[at] = (self.data[first[at][:, None] + 1 + np.arange(len(want))] == want).all(axis=1)
        for i in np.flatnonzero(escaped):
            same[i] = json.loads(self.bytes[first[i] : last[i] + 1]) == key
        return which[same], colon[same]

    def follow(self, rows: np.ndarray, path: list[str]) -> Walk:
        """The path from the roots of ``rows``, as far as it goes."""
        w = Walk(self, rows)
        for segment in path:
            w.step(segment)
        return w


class Walk:
    """Where a path leads in some texts: the span [start, end), the container's span, the
    key's quote (-1 in arrays), how many segments were followed, and an error."""

    def __init__(self, spans: Spans, rows: np.ndarray):
        self.spans, n = spans, len(rows)
        self.start, self.end = spans.roots(rows)
        self.above, self.above_end = self.start.copy(), self.end.copy()
        self.key, self.steps = np.full(n, -1), np.zeros(n, dtype=np.int64)
        self.error = np.full(n, None, dtype=object)
        self.error[~spans.valid[rows]] = PARSE_FAILED

    def step(self, segment: str) -> None:
        s, alive = self.spans, np.flatnonzero(self.error == None)  # noqa: E711
        head = s.data[self.start[alive]]
        self.error[alive[~np.isin(head, OPEN)]] = WRONG_TYPE
        for mark, is_object in zip(OPEN, (True, False), strict=True):
            own = alive[head == mark]
            start, end = self.start[own], self.end[own]
            after, found = np.full(len(own), -1), np.zeros(len(own), dtype=bool)
            if is_object:
                which, colon = s.members(start, end, segment)
                after[which], found[which] = colon, True
            elif re.fullmatch("[0-9]+", segment):
                which, comma = s.separators(start, end, (COMMA,))
                low = np.searchsorted(s.at, start)
                n = np.bincount(which, minlength=len(own))
                filled = s._next_solid(start + 1) < end - 1
                at = min(int(segment), 2**31)
                found = filled & (n >= at)
                first = np.cumsum(n) - n
                after = np.where(found, low if at == 0 else comma[np.minimum(first + at - 1, max(0, len(comma) - 1))] if len(comma) else low, -1)
            self.error[own[~found]] = NOT_FOUND
            own, after, start, end = own[found], after[found], start[found], end[found]
            self.above[own], self.above_end[own] = start, end
            self.key[own] = s._keys(after)[0] if is_object and len(own) else -1
            self.start[own], self.end[own] = s._next_solid(s.at[after] + 1), s._ends(start, end, after)
            self.steps[own] += 1


def _text(spans: Spans, start: int, end: int) -> str:
    return spans.bytes[start:end].decode()


def look_up(texts: list[str | None], path: list[str]) -> list[dict]:
    s = Spans(texts)
    w = s.follow(np.arange(len(texts)), path)
    return [{"value": None if e else _text(s, int(a), int(b)), "error": e} for a, b, e in zip(w.start, w.end, w.error, strict=True)]


def _nested(rest: list[str], literal: str, indent: str | None) -> str:
    """A value inside objects for the keys ``rest``; with ``indent`` a line for each entry."""
    value = read(literal)
    for key in reversed(rest):
        value = {key: value}
    return written(value, None if indent is None else 2).replace("\n", "\n" + (indent or ""))


def set_texts(texts: list[str | None], literals: list[str | None], path: list[str]) -> list[dict]:
    """Each text with the value at the path replaced, or put as a new member into the
    deepest object on the way that is there; on a line of its own if its sibling is."""
    s = Spans(texts)
    w = s.follow(np.arange(len(texts)), path)
    out = []
    for i, literal in enumerate(literals):
        error, start, end = w.error[i], int(w.start[i]), int(w.end[i])
        try:
            new = None if literal is None else written(read(literal))
        except (ValueError, RecursionError):
            new = None
        if error == PARSE_FAILED or new is None:
            out.append({"value": None, "error": PARSE_FAILED})
            continue
        begin, stop = int(s.begin[i]), int(s.stop[i])
        if error is None:
            out.append({"value": _text(s, begin, start) + new + _text(s, end, stop), "error": None})
            continue
        if s.data[start] != OPEN[0]:
            out.append({"value": None, "error": UNSUPPORTED})
            continue
        key, *rest = path[int(w.steps[i]) :]
        name = json.dumps(key, ensure_ascii=False)
        _, colons = s.separators(np.array([start]), np.array([end]), (COLON,))
        if len(colons):
            last = colons[-1:]
            at = int(s._ends(np.array([start]), np.array([end]), last)[0])
            line = s.bytes[begin : int(s._keys(last)[0][0])].rpartition(b"\n")
            indent = re.match(rb"[ \t]*", line[2])[0].decode() if line[1] else None
            piece = f",\n{indent}{name}: " if line[1] else f", {name}: "
            piece += _nested(rest, new, indent)
        else:
            at, piece = start + 1, f"{name}: {_nested(rest, new, None)}"
        out.append({"value": _text(s, begin, at) + piece + _text(s, at, stop), "error": None})
    return out


def unset_texts(texts: list[str | None], path: list[str], whole_line: bool = False) -> list[dict]:
    """Each text without the member or element at the path, and without the comma after it
    (before it, if it is the last) and the line that it had to itself. ``whole_line``:
    an element's line goes too."""
    s = Spans(texts)
    w = s.follow(np.arange(len(texts)), path)
    out = []
    for i, error in enumerate(w.error):
        if error is not None:
            out.append({"value": None, "error": error})
            continue
        begin, stop = int(s.begin[i]), int(s.stop[i])
        raw, at, end, body = s.bytes[begin:stop], int(w.key[i]), int(w.end[i]) - begin, int(w.above[i]) - begin + 1
        start = (at if at >= 0 else int(w.start[i])) - begin
        if at >= 0 or whole_line:
            line = raw.rfind(b"\n", 0, start) + 1
            if line and not raw[line:start].strip(b" \t\r\f"):
                start = line
        after = re.compile(rb"[ \t\r\n]*").match(raw, end).end()
        comma = raw.rfind(b",", body, start)
        if raw[after : after + 1] == b",":
            end = re.compile(rb"\r?\n?").match(raw, after + 1).end()
        elif comma >= 0:
            start = comma
        out.append({"value": (raw[:start] + raw[end:]).decode(), "error": None})
    return out


def append_texts(texts: list[str | None], literals: list[str | None], path: list[str]) -> list[dict]:
    """Each text with one more element at the end of the array at the path."""
    s = Spans(texts)
    w = s.follow(np.arange(len(texts)), path)
    out = []
    for i, literal in enumerate(literals):
        error, start, end = w.error[i], int(w.start[i]), int(w.end[i])
        try:
            new = None if literal is None else written(read(literal))
        except (ValueError, RecursionError):
            new = None
        error = error or (PARSE_FAILED if new is None else UNSUPPORTED if s.data[start] != OPEN[1] else None)
        if error:
            out.append({"value": None, "error": error})
            continue
        at = int(s._after_last_solid(np.array([end - 1]))[0])
        piece = new if at == start + 1 else ", " + new
        out.append({"value": _text(s, int(s.begin[i]), at) + piece + _text(s, at, int(s.stop[i])), "error": None})
    return out


# Columns: (value, error) of each text.


def get(text: Column, path: str) -> Column:
    """The value at a path as it was written."""
    from ..operators.paths import parse_path

    segments = parse_path(path)

    @F.arrow_udf("struct<value:string,error:string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(look_up(texts.to_pylist(), segments), FOUND)

    return found(text)


def get_by(text: Column, path: Column) -> Column:
    """The same with each row's own path; rows that share a path are looked up together."""
    from ..operators.paths import PathError, parse_path

    @F.arrow_udf("struct<value:string,error:string>")
    def found(texts: pa.Array, paths: pa.Array) -> pa.Array:
        texts, out = texts.to_pylist(), [None] * len(texts)
        groups: dict[str | None, list[int]] = {}
        for i, p in enumerate(paths.to_pylist()):
            groups.setdefault(p, []).append(i)
        spans = Spans(texts)
        for p, rows in groups.items():
            try:
                w = spans.follow(np.array(rows), parse_path(p or ""))
            except PathError as e:
                for i in rows:
                    out[i] = {"value": None, "error": e.code}
                continue
            for k, i in enumerate(rows):
                out[i] = {"value": None if w.error[k] else _text(spans, int(w.start[k]), int(w.end[k])), "error": w.error[k]}
        return pa.array(out, FOUND)

    return found(text, path)


def kind(literal: Column) -> Column:
    """What a literal is: null, boolean, number, string, array or object."""
    first = F.substring(literal, 1, 1)
    out = F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array")
    return out.when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(literal.isNotNull(), "number")


def scalar(text: Column, path: str) -> Column:
    """The text of the scalar at a path; numbers keep their literals."""
    from .urls import let

    def of(got: Column) -> Column:
        k = kind(got["value"])
        error = F.coalesce(got["error"], F.when(k == "null", IS_NULL).when(k.isin("object", "array"), NO_SCALAR))
        own = F.when(k == "string", F.get_json_object(F.concat(F.lit('{"v":'), got["value"], F.lit("}")), "$.v")).otherwise(got["value"])
        return F.struct(F.when(error.isNull(), own).alias("value"), error.alias("error"))

    return let(get(text, path), of)


def coerce(text: Column, kind_: str) -> Column:
    """Text as a literal of the kind string, number, bool, null or json, digit for digit."""

    @F.arrow_udf("string")
    def compact(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else written(read(t)))
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())

    word = F.lower(text)
    quoted = F.to_json(F.array(text))
    value = {
        "string": F.when(text.isNotNull(), F.substr(quoted, F.lit(2), F.length(quoted) - 2)),
        "number": F.when(text.rlike(NUMBER), text),
        "bool": F.when(word.isin("true", "yes", "on", "1"), "true").when(word.isin("false", "no", "off", "0"), "false"),
        "null": F.when(text.isNull(), "null"),
    }
    value = compact(text) if kind_ == "json" else value[kind_]
    return F.struct(value.alias("value"), F.when(value.isNull(), PARSE_FAILED).alias("error"))


def set_value(text: Column, path: str, literal: Column) -> Column:
    """The text with the value at a path replaced by a JSON literal, or added."""
    from ..operators.paths import parse_path

    segments = parse_path(path)

    @F.arrow_udf("struct<value:string,error:string>")
    def edited(texts: pa.Array, literals: pa.Array) -> pa.Array:
        return pa.array(set_texts(texts.to_pylist(), literals.to_pylist(), segments), FOUND)

    return edited(text, literal)


def unset(text: Column, path: str, whole_line: bool = False) -> Column:
    """The text without what is at a path."""
    from ..operators.paths import parse_path

    segments = parse_path(path)

    @F.arrow_udf("struct<value:string,error:string>")
    def edited(texts: pa.Array) -> pa.Array:
        return pa.array(unset_texts(texts.to_pylist(), segments, whole_line), FOUND)

    return edited(text)


def append(text: Column, path: str, literal: Column) -> Column:
    """The text with one more element in the array at a path (of the root: an empty path)."""
    from ..operators.paths import parse_path

    segments = parse_path(path) if path else []

    @F.arrow_udf("struct<value:string,error:string>")
    def edited(texts: pa.Array, literals: pa.Array) -> pa.Array:
        return pa.array(append_texts(texts.to_pylist(), literals.to_pylist(), segments), FOUND)

    return edited(text, literal)
