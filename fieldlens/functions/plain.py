"""Plain text of JSON values whose keys are known per row only.

Native expressions over such keys run unoptimized inside lambdas, some thousand steps a
row; one walk over each value, in Arrow batches of its JSON text alone, takes a
fraction of that. Formats are those of :mod:`formats`, names those of :mod:`names`.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import formats, names
from .dynamic import _Literal, _url_field
from .urls import MARK, SPACES

#: What :func:`pairs` gives: (sort key, ``name=text``) of each leaf.
PAIRS = T.ArrayType(T.StructType([T.StructField("_pair_order", T.BinaryType()), T.StructField("_pair_text", T.StringType())]))
_PAIR = pa.struct([("_pair_order", pa.binary()), ("_pair_text", pa.string())])
_ODD = re.compile(rf'[{SPACES}="\\]').search
_ODD_IN_JSON = re.compile(r'[\x00-\x1f"\\]').search
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\x0b", "\\v"))
_IN_JSON = str.maketrans({'"': '\\"', "\\": "\\\\", **{chr(i): f"\\u{i:04X}" for i in range(32)}, "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"})
_INTEGER = re.compile(r"-?[0-9]+")
_MARKS = {"usd_cents": "$", "eur_cents": "€"}
_UNITS = {"us": "μs", "minutes": " minutes", "hours": " hours", "days": " days", "percent": "%"}
#: Stands for an object whose own entries follow.
_INNER = object()


def _quoted(text: str) -> str:
    if not _ODD(text):
        return text
    for a, b in _ESCAPES:
        text = text.replace(a, b)
    return f'"{text}"'


@lru_cache(4096)
def _name(name: str) -> tuple[bytes, str]:
    """The sort key of a name, and how it is written."""
    return name.encode("utf-16-be", "surrogatepass"), f"{_quoted(name)}="


def _float(text: str) -> _Literal:
    """A number with its digits as they are, plain from 1e-5 up to 1e16 (``1.25E7`` is
    ``12500000.0``), as :func:`variants.json_numbers` has it."""
    if "E" not in text:
        return _Literal(text)
    figures, power = text.split("E")
    sign, power = "-" * figures.startswith("-"), int(power)
    figures = figures.lstrip("-").removesuffix(".0").replace(".", "")
    if 0 <= power < 16:
        return _Literal(f"{sign}{figures[: power + 1].ljust(power + 1, '0')}.{figures[power + 1 :] or '0'}")
    if -5 <= power < 0:
        return _Literal(f"{sign}0.{'0' * (-power - 1)}{figures}")
    return _Literal(f"{sign}{figures[0]}{'.' * (len(figures) > 1)}{figures[1:]}e{power}")


def _json(x) -> str:
    """Compact JSON, keys as they stand."""
    kind = type(x)
    if kind is str:
        return f'"{x.translate(_IN_JSON)}"' if _ODD_IN_JSON(x) else f'"{x}"'
    if kind is _Literal or kind is int:
        return str(x)
    if kind is dict:
        return "{" + ",".join([f"{_json(k)}:{_json(v)}" for k, v in x.items()]) + "}"
    if kind is list:
        return "[" + ",".join([_json(y) for y in x]) + "]"
    return "null" if x is None else "true" if x else "false"


def _scalar(x) -> str:
    return x if type(x) is str else _json(x)


def _leaf(x) -> str:
    """A leaf that keeps its name: arrays are joined by commas, null is empty."""
    if type(x) is list:
        return ",".join([_scalar(y) for y in x]) if x else "[]"
    return "" if x is None else _scalar(x)


def _number(x: int | float) -> str:
    if isinstance(x, int):
        return str(x)
    size = abs(x)
    if (size >= 2.0**53 or x.is_integer()) and size < 1e21:
        return str(int(x))
    digits = Decimal(repr(x))
    if 1e-6 <= size < 1e15:
        return f"{digits:f}"
    sign, figures, _ = digits.as_tuple()
    shown = "".join(map(str, figures)).rstrip("0")
    return f"{'-' * sign}{shown[0]}{'.' * (len(shown) > 1)}{shown[1:]}e{digits.adjusted()}"


def _stamp(ms: int) -> str | None:
    if not formats.FIRST_MS <= ms <= formats.LAST_MS:
        return None
    at = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    return f"{at.year:04d}-{at:%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z"


def _size(i: int) -> str | None:
    if i < 1024:
        return f"{i}B" if i >= 0 else None
    k = min((i.bit_length() - 1) // 10, 4)
    return f"{Decimal(repr(i / 1024**k)).quantize(Decimal('0.1'), ROUND_HALF_EVEN)}{'KMGT'[k - 1]}iB"


def _money(i: int, unit: int) -> str:
    return f"{abs(i) // unit}.{abs(i) % unit:0{len(str(unit)) - 1}d}"


def _readable(x, kind: str, code: str | None) -> str | None:
    """As :func:`formats.readable`: a text, or a number as the type that it fits."""
    if type(x) is str:
        if kind == "rfc3339" or (kind == "secret" and x == MARK):
            return x
        if kind not in ("epoch_ns", "sats", "msats") or not _INTEGER.fullmatch(x):
            return None
        return x + kind if kind != "epoch_ns" else _stamp(int(x) // 1_000_000) if len(x) < 40 else None
    if type(x) is not int and type(x) is not _Literal:
        return None
    n: int | float = x if type(x) is int and -(2**63) <= x < 2**63 else float(x)
    i = n if isinstance(n, int) else int(n) if n.is_integer() and -(2.0**63) <= n < 2.0**63 else None
    if kind == "percent" or kind in _UNITS or kind in ("ns", "s"):
        return _number(n) + _UNITS.get(kind, kind)
    if kind == "ms":
        if abs(n) < 1000:
            return _number(n) + "ms"
        whole, rest = f"{abs(float(n) / 1000.0):.3f}".split(".")
        return f"{'-' * (n < 0)}{whole}.{rest[0]}{rest[1:].rstrip('0')}s"
    if i is None or kind in ("secret", "rfc3339"):
        return None
    sign = "-" * (i < 0)
    if kind in _MARKS:
        return f"{sign}{_MARKS[kind]}{_money(i, 100)}"
    if kind in ("cents", "micro"):
        return f"{sign}{_money(i, 100 if kind == 'cents' else 1_000_000)} {code}"
    if kind == "jpy":
        return f"{sign}¥{abs(i):,}"
    if kind == "bytes":
        return _size(i)
    if kind in ("sats", "msats"):
        return f"{i}{kind}"
    if kind == "epoch_s" and abs(i) >= 10**15:
        return None
    return _stamp({"epoch_ms": i, "epoch_s": i * 1000}.get(kind, i // 1_000_000))


class _Walk:
    """The pairs of one value after another; ``hide``: without secrets, as
    :func:`variants.redact` has it."""

    def __init__(self, name: str, raw: bool, hide: bool, in_url: bool, secret: frozenset[str], url: frozenset[str], deepest: int):
        self.name, self.raw, self.hide, self.in_url, self.secret, self.deepest = name, raw, hide, in_url, secret, deepest
        #: Of a key: whether it is a secret's, whether it is a URL's, its meaning.
        self.known = lru_cache(4096)(lambda k: (hide and names.is_secret(k, secret), names.is_url(k, url), None if raw else names.meaning(k)))

    def _safe(self, x, in_url: bool, left: int):
        """A value as it may be shown; ``left``: levels below it that are looked at."""
        kind = type(x)
        if not self.hide:
            return x
        if kind is str:
            return _url_field(x, self.secret) if in_url else x
        if kind is dict or kind is list:
            if x and not left:
                return MARK
            if kind is list:
                return [self._safe(y, in_url, left - 1) for y in x]
            out = {}
            for k, y in x.items():
                secret, url, _ = self.known(k)
                out[k] = MARK if secret and y is not None else self._safe(y, in_url or url, left - 1)
            return out
        return x

    def _entries(self, out: list, parent: str, entries: dict, in_url: bool, left: int) -> None:
        """(parent, key, stripped name or the key, readable text or null, value) of the
        entries of objects."""
        for key, x in entries.items():
            secret, url, m = self.known(key)
            if left and type(x) is dict and x:
                if not (secret and parent):
                    out.append((parent, key, key, None, _INNER))
                    self._entries(out, f"{parent}{key}.", x, in_url or (url and parent != ""), left - 1)
                    continue
            # A column's own name was looked at when the plan was made.
            x = MARK if secret and parent and x is not None else self._safe(x, in_url or (url and parent != ""), left)
            nice = _readable(x, m[1], m[2]) if m else None
            out.append((parent, key, key if nice is None else m[0], nice, x))

    def pairs(self, value) -> list[tuple[bytes, str]]:
        found: list = []
        self._entries(found, "", {self.name: value}, self.in_url, self.deepest)
        taken = Counter([e[:3:2] for e in found]) if len({e[:3:2] for e in found}) < len(found) else {}
        out = []
        for parent, key, shown, nice, x in found:
            if x is not _INNER:
                strip = nice is not None and taken.get((parent, shown), 1) == 1
                order, name = _name(parent + (shown if strip else key))
                out.append((order, name + _quoted(nice if strip else _leaf(x))))
        out.sort()
        return out


def pairs(text: Column, name: str, raw: bool, hide: bool, in_url: bool, secret_names: frozenset[str], url_names: frozenset[str], deepest: int) -> Column:
    """:data:`PAIRS` of JSON text (null as JSON's null) that stands under ``name``."""

    @F.arrow_udf(PAIRS)
    def found(texts: pa.Array) -> pa.Array:
        walk = _Walk(name, raw, hide, in_url, secret_names, url_names, deepest)
        ends, orders, shown = [0], [], []
        for t in texts.to_pylist():
            for order, line in walk.pairs(None if t is None else json.loads(t, parse_float=_float)):
                orders.append(order)
                shown.append(line)
            ends.append(len(orders))
        rows = pa.StructArray.from_arrays([pa.array(orders, pa.binary()), pa.array(shown, pa.string())], fields=list(_PAIR))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return found(text)
