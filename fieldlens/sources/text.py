"""JSON lines, dotenv text, frontmatter and formats by file name, as rows and columns.

All but the values of dotenv text are native expressions. Rows in error hold a code
and a line, never the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import whole_json
from ..functions.urls import SPACES, let, trimmed

MAX_VALUE_BYTES = 1 << 20
# Endings of file names and names of formats.
ENDINGS = (("json", r"\.json\z"), ("toml", r"\.toml\z"), ("yaml", r"\.ya?ml\z"), ("ini", r"\.ini\z"), ("dotenv", r"\.env\z|(?:\A|/)\.env(?:\.[^/]*)?\z"))
FORMATS = {"json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "dotenv": "dotenv", "env": "dotenv", "ini": "ini", "toml-frontmatter": "toml-frontmatter", "yaml-frontmatter": "yaml-frontmatter", "markdown": "markdown"}
# End of the fixed values.


def detect_format(path: Column) -> Column:
    """The format that a file's name tells; null if none. Markdown is never guessed."""
    out = None
    for name, pattern in ENDINGS:
        test = F.lower(path).rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def format_by_name(name: str) -> str:
    """The format that a user names; an error if there is none."""
    found = FORMATS.get(name.lower())
    if found is None:
        raise ValueError(f"document_format_unknown: {name}")
    return found


def read_files(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """(path, format, content, error): whole files; those longer than ``most`` bytes
    are refused without being read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", detect_format(F.col("path")).alias("format"), F.decode("content", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
    large = files.where(F.col("length") > most).select("path", detect_format(F.col("path")).alias("format"), F.lit(None).cast("string").alias("content"), F.lit("document_too_large").alias("error"))
    return small.union(large)


def read_json_or_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, value, error): a text that is one JSON value is one row without a
    line; else each line that isn't blank is one, by its number from 1."""
    whole = whole_json(F.col(text_col))
    none = F.lit(None)
    first = docs.select(F.col(id_col), F.col(text_col).alias("_text"), whole.alias("_whole"))
    single = F.array(F.struct(none.cast("int").alias("line"), F.col("_whole").alias("value"), none.cast("string").alias("error")))
    blank = lambda t: trimmed(t) == ""
    empty = F.array(F.struct(none.cast("int").alias("line"), none.cast("variant").alias("value"), F.lit("json_parse_failed").alias("error")))
    numbered = F.transform(F.split("_text", "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    said = lambda x: let(whole_json(x["text"]), lambda v: F.struct(x["line"].alias("line"), v.alias("value"), F.when(v.isNull(), "jsonl_parse_failed").alias("error")))
    # Lines are parsed once, and only where there are several that aren't blank.
    lines = let(F.filter(numbered, lambda x: ~blank(x["text"])), lambda ls: F.when(F.size(ls) > 1, F.transform(ls, said)).otherwise(empty))
    rows = F.when(F.col("_whole").isNotNull(), single).when(F.col("_text").isNull(), empty).otherwise(lines)
    return first.select(id_col, F.explode(rows).alias("_r")).select(id_col, "_r.line", "_r.value", "_r.error")


def split_frontmatter(text: Column, marker: str) -> Column:
    """(front, body, error): what stands between the first line, the marker (``+++`` or
    ``---``), and the next line that is the marker but for white space at its end."""
    m = re.escape(marker)
    end = rf"[{SPACES}&&[^\n]]*"
    opened = text.rlike(rf"\A{m}{end}(?:\n|\z)")
    shape = rf"(?s)\A{m}{end}\n((?:(?!{m}{end}(?:\n|\z))[^\n]*\n)*){m}{end}(?:\n(.*))?\z"
    closed = text.rlike(shape)
    error = F.when(~opened, "frontmatter_missing").when(~closed, "frontmatter_unterminated")
    return F.struct(F.when(error.isNull(), F.regexp_extract(text, shape, 1)).alias("front"), F.when(error.isNull(), F.coalesce(F.regexp_extract(text, shape, 2), F.lit(""))).alias("body"), error.alias("error"))


_BLANK = re.compile(r"[^\S\n]*(?:#[^\n]*)?(?:\n|\Z)")
_KEY = re.compile(r"[^\S\n]*(?:export[^\S\n]+)?([^=\n]*?)[^\S\n]*=[^\S\n]*")
_QUOTED = {q: re.compile(rf"{q}((?:\\.|[^\\{q}])*){q}[^\S\n]*(?:#[^\n]*)?(?:\n|\Z)", re.S) for q in "\"'"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DOUBLE = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"'}


def parse_dotenv(text: str) -> list[tuple]:
    """(line, key, value, error) of each entry, or of the first error alone."""
    out, seen, at, line = [], set(), 0, 1
    text = text.replace("\r\n", "\n")
    while at < len(text):
        blank = _BLANK.match(text, at)
        if blank:
            at, line = blank.end(), line + text.count("\n", at, blank.end())
            continue
        head = _KEY.match(text, at)
        key = head[1] if head else ""
        if not head or not _NAME.fullmatch(key):
            return [(line, None, None, "invalid_key" if head else "missing_value")]
        if key in seen:
            return [(line, None, None, "duplicate_key")]
        quote = text[head.end() : head.end() + 1]
        if quote in _QUOTED and quote:
            found = _QUOTED[quote].match(text, head.end())
            if not found:
                return [(line, None, None, "invalid_quoted_value")]
            known = _DOUBLE if quote == '"' else {"'": "'"}
            value, end = re.sub(r"(?s)\\(.)", lambda m: known.get(m[1], m[0]), found[1]), found.end()
        else:
            end = text.find("\n", head.end()) + 1 or len(text)
            raw = text[head.end() : end].removesuffix("\n")
            raw = re.match(r"(?s)(?:\\.|(?<!\s)#|[^\\#])*\\?", raw)[0]
            value = re.sub(r"(?s)\\(.)", r"\1", raw).rstrip()
        if len(value.encode()) > MAX_VALUE_BYTES:
            return [(line, None, None, "value_too_large")]
        seen.add(key)
        out.append((line, key, value, None))
        line += text.count("\n", at, end)
        at = end
    return out


def _dotenv_entries():
    kind = pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string()), ("value", pa.string()), ("error", pa.string())]))

    @F.arrow_udf("array<struct<line:int,key:string,value:string,error:string>>")
    def entries(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("line", "key", "value", "error"), e, strict=True)) for e in parse_dotenv(t)] if t is not None else [] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    return entries


def read_dotenv(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, key, value, error): a document's entries, or its first error."""
    found = docs.select(F.col(id_col), _dotenv_entries()(F.col(text_col)).alias("_all"))
    return found.select(id_col, F.explode("_all").alias("_e")).select(id_col, "_e.line", "_e.key", "_e.value", "_e.error")


def _dotenv_text(value: Column) -> Column:
    """A value as dotenv text: quoted unless it has no white space, ``#`` or backslash."""
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(value.rlike(rf"\A[^{SPACES}#\\]+\z"), value).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def _edit_dotenv(text: Column, key: str, value: Column | None) -> Column:
    if not _NAME.fullmatch(key):
        raise ValueError(f"no name of a variable: {key}")
    read = _dotenv_entries()(text)
    entry = F.get(F.filter(read, lambda e: e["key"] == key), F.lit(0))
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))
    before = F.array_join(F.slice(lines, F.lit(1), entry["line"] - 1), "")
    rest = F.array_join(F.slice(lines, entry["line"], F.size(lines) + 1), "")
    # The entry's own text: a quoted value may span lines.
    gap = rf"[{SPACES}&&[^\n]]*"
    shape = rf"""(?s)\A({gap}(?:export{gap})?{re.escape(key)}{gap}=)({gap})("(?:\\.|[^\\"])*"|'(?:\\.|[^\\'])*'|(?:(?! #)[^\r\n])*)([^\n]*\n?)"""
    part = lambda i: F.regexp_extract(rest, shape, i)
    tail = F.substr(rest, F.length(F.regexp_extract(rest, shape, 0)) + 1)
    if value is None:
        there, absent = F.concat(before, tail), F.lit(None).cast("string")
    else:
        there = F.concat(before, part(1), _dotenv_text(value), part(4), tail)
        absent = F.concat(text, F.when((text == "") | text.endswith("\n"), "").otherwise("\n"), F.lit(f"{key}="), _dotenv_text(value), F.lit("\n"))
    out = F.when(entry.isNotNull(), there).otherwise(absent)
    bad = text.isNull() | F.exists(read, lambda e: e["error"].isNotNull()) | (F.lit(False) if value is None else value.isNull())
    return F.struct(F.when(~bad, out).alias("value"), F.when(bad, "document_parse_failed").when(out.isNull(), "document_path_not_found").alias("error"))


def set_dotenv(text: Column, key: str, value: Column) -> Column:
    """(value, error): the text with a variable's value replaced where it stands, or with
    a new line at the end; all other bytes stay, also a remark after the value."""
    return _edit_dotenv(text, key, value)


def unset_dotenv(text: Column, key: str) -> Column:
    """(value, error): the text without a variable's lines."""
    return _edit_dotenv(text, key, None)


def classify_source(spec: Column) -> Column:
    """(kind, target) of a value's source: ``env:``, ``file:``, ``file+FORMAT:``,
    ``stdin``, ``fd:N`` (from 3 on), ``prompt`` or ``literal:``; else null. Nothing is read."""
    pattern = r"(?s)\A(env|file(?:\+[a-z\-]+)?|literal):(.*)\z"
    lead, rest = F.regexp_extract(spec, pattern, 1), F.regexp_extract(spec, pattern, 2)
    fd = F.regexp_extract(spec, r"\Afd:([0-9]+)\z", 1).try_cast("int")
    kind = F.when(spec.isin("stdin", "prompt"), spec).when(fd >= 3, "fd").when((lead == "literal") | ((lead != "") & (rest != "")), lead)
    return F.struct(kind.alias("kind"), F.when(fd >= 3, fd.cast("string")).when(kind == lead, rest).alias("target"))
