"""JSON text whose keys are known per row only: redaction and canonical text.

Numbers keep their literals, digit for digit, which variants don't. One small walk
over each value, in Arrow batches of the text column alone; texts that aren't one
JSON value, or hold a key twice, give null.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import is_secret, is_url
from .urls import MARK

DEEPEST = 256
_PARTS = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#]*)([^?#]*)(?:(\?)([^#]*))?(?:(#)(.*))?", re.S)
# Unicode's white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# End of the fixed values.


class _Literal(str):
    """A number as it was written."""


def _redact_url(text: str, secret: frozenset[str]) -> str | None:
    """The URL without its secrets; None if it is none."""
    found = None if re.search(r"[ \t\n\f\r]", text) else _PARTS.fullmatch(text)
    if not found:
        return None

    def pairs(part: str) -> str:
        decoded = lambda name: unquote_plus(name) if "%" in name or "+" in name else name
        hidden = lambda p: "=" in p and is_secret(decoded(p.split("=", 1)[0]), secret)
        return "&".join(p.split("=", 1)[0] + "=" + MARK if hidden(p) else p for p in part.split("&"))

    scheme, authority, path, q, query, h, fragment = found.groups(default="")
    # The password runs from the first colon to the last @ of the authority.
    colon, at = authority.find(":"), authority.rfind("@")
    user = authority[: colon + 1] + MARK + authority[at:] if 0 <= colon < at else authority
    return scheme + user + path + q + pairs(query) + h + pairs(fragment)


def _url_field(text: str, secret: frozenset[str]) -> str:
    for candidate in (text, text.strip(_SPACE)):
        clean = _redact_url(candidate, secret)
        if clean is not None:
            return clean
    return MARK if "@" in text or any(c in _SPACE for c in text) else text


def _walk(value, in_url: bool, secret: frozenset[str], url: frozenset[str], depth: int = 0):
    if depth >= DEEPEST:
        return MARK
    if isinstance(value, dict):
        return {k: (x if x is None else MARK) if is_secret(k, secret) else _walk(x, in_url or is_url(k, url), secret, url, depth + 1) for k, x in value.items()}
    if isinstance(value, list):
        return [_walk(x, in_url, secret, url, depth + 1) for x in value]
    return _url_field(value, secret) if in_url and isinstance(value, str) and not isinstance(value, _Literal) else value


def _written(value) -> str:
    """JSON text, keys in UTF-16 order."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return str(value) if isinstance(value, _Literal) else json.dumps(value, ensure_ascii=False)


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key twice")
    return found


def _no(constant: str):
    raise ValueError(constant)


def _read(text: str):
    return json.loads(text, parse_int=_Literal, parse_float=_Literal, parse_constant=_no, object_pairs_hook=_once)


def _each(texts: pa.Array, change) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        try:
            out.append(None if t is None else _written(change(_read(t))))
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.string())


def canonical_json_text(text: Column) -> Column:
    """The same value with sorted keys and without white space."""

    @F.arrow_udf("string")
    def canonical(texts: pa.Array) -> pa.Array:
        return _each(texts, lambda v: v)

    return canonical(text)


def redact_json_text(text: Column, secret_names: list[str] | None = None, url_names: list[str] | None = None, policy: str = "all") -> Column:
    """Canonical text without secrets; ``policy``: ``all``, ``trace_only`` or ``off``."""
    secret, url = frozenset(secret_names or ()), frozenset(url_names or ())

    def clean(v):
        if policy == "trace_only":
            return {k: _walk(x, is_url(k, url), secret, url) if k == "trace" else x for k, x in v.items()} if isinstance(v, dict) else v
        return v if policy == "off" else _walk(v, False, secret, url)

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return _each(texts, clean)

    return redacted(text)
