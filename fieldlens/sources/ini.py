"""INI text as rows, document by document, in native expressions: nothing is shuffled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import SPACES, let, trimmed
from ..operators.paths import BAD_ARGUMENT, BAD_PATH, NOT_FOUND, PARSE_FAILED, PathError, parse_path

MAX_VALUE_BYTES = 1 << 20
UNSUPPORTED = "document_unsupported_operation"


def _read(line: Column, at: Column) -> Column:
    """What a line is: a header, an entry, or an error."""

    def parts(bare: Column) -> Column:
        quiet = (bare == "") | bare.startswith("#") | bare.startswith(";")
        is_header = bare.startswith("[")
        is_entry = ~quiet & ~is_header & F.contains(line, F.lit("="))
        name = F.when(~quiet & is_header, trimmed(F.substr(bare, F.lit(2), F.length(bare) - F.lit(2))))
        key = F.when(is_entry, trimmed(F.substring_index(line, "=", 1)))
        value = F.when(is_entry, trimmed(F.substr(line, F.instr(line, "=") + F.lit(1))))
        closed = bare.endswith("]") & (F.length(bare) > 1)
        return F.struct(name.alias("header"), key.alias("key"), value.alias("value"), closed.alias("closed"), quiet.alias("quiet"))

    def judged(p: Column) -> Column:
        error = (
            F.when(p["header"].isNotNull() & ~p["closed"], "invalid_section_header")
            .when(p["header"].isNotNull() & ((p["header"] == "") | p["header"].rlike(r"[\[\]]")), "invalid_section_name")
            .when(~p["quiet"] & p["header"].isNull() & p["key"].isNull(), "missing_value")
            .when(p["key"].isNotNull() & ((p["key"] == "") | p["key"].rlike(r"[\[\]]")), "invalid_key")
            .when(F.octet_length(p["value"]) > MAX_VALUE_BYTES, "value_too_large")
        )
        return F.struct((at + 1).alias("line"), p["header"].alias("header"), p["key"].alias("key"), p["value"].alias("value"), error.alias("error"))

    return let(let(trimmed(line), parts), judged)


def spans(heads: Column, n: Column) -> Column:
    """(name, start, count) of the lines before the first header and after each, from
    their headers (name, line); lines count from 1, ``n`` is how many there are."""

    def of(starts: Column) -> Column:
        stop = lambda i: F.coalesce(F.get(starts, i + 1)["line"], n + 1)
        return F.transform(starts, lambda s, i: F.struct(s["name"].alias("name"), (s["line"] + 1).alias("start"), (stop(i) - s["line"] - 1).alias("count")))

    first = F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("line")))
    return let(F.concat(first, heads), of)


def _first(errors: Column, code: str | Column) -> Column:
    """The first of an array of lines, with its code."""
    return F.when(F.size(errors) > 0, F.struct(F.array_min(errors).alias("line"), F.lit(code) if isinstance(code, str) else code).cast("struct<line:int,error:string>"))


def _placed(lines: Column) -> Column:
    """The entries with their sections, or the first line in error alone. Each section
    takes its lines as one slice; what repeats is looked for only where the distinct
    names are fewer than the names."""
    none = F.lit(None).cast("string")
    heads = F.transform(F.filter(lines, lambda x: x["header"].isNotNull()), lambda x: F.struct(x["header"].alias("name"), x["line"].alias("line")))
    entries = lambda s: F.filter(F.slice(lines, s["start"], s["count"]), lambda x: x["key"].isNotNull())
    names_of = lambda rows, field: F.transform(rows, lambda x: x[field])

    def repeated(rows: Column, field: str) -> Column:
        """Lines whose name an earlier line of ``rows`` has."""
        names = names_of(rows, field)
        again = lambda all_: F.filter(F.transform(rows, lambda x, i: F.when(F.array_position(all_, x[field]) <= i, x["line"])), lambda x: x.isNotNull())
        return F.when(F.size(F.array_distinct(names)) < F.size(names), let(names, again)).otherwise(F.array().cast("array<int>"))

    def checked(p: Column) -> Column:
        heads, sections = p["heads"], p["sections"]
        own = F.get(F.filter(lines, lambda x: x["error"].isNotNull()), F.lit(0))
        root = names_of(sections[0]["rows"], "key")
        taken = F.transform(F.filter(heads, lambda h: F.array_contains(root, h["name"])), lambda h: h["line"])
        keys = F.flatten(F.transform(sections, lambda s: repeated(s["rows"], "key")))
        # Of several errors in one line, the first of this order counts.
        found = F.array(
            F.when(own.isNotNull(), F.struct(own["line"].alias("line"), F.lit(0).alias("o"), own["error"].alias("error"))),
            *[F.when(e.isNotNull(), F.struct(e["line"].alias("line"), F.lit(o).alias("o"), e["error"].alias("error"))) for o, e in enumerate((_first(repeated(heads, "name"), "duplicate_section"), _first(taken, "section_is_root_key"), _first(keys, "duplicate_key")), 1)],
        )
        rows = F.flatten(F.transform(sections, lambda s: F.transform(s["rows"], lambda x: F.struct(x["line"].alias("line"), s["name"].alias("section"), x["key"].alias("key"), x["value"].alias("value"), none.alias("error")))))
        bad = let(F.array_min(found), lambda e: F.when(e.isNotNull(), F.array(F.struct(e["line"].alias("line"), none.alias("section"), none.alias("key"), none.alias("value"), e["error"].alias("error")))))
        return F.coalesce(bad, rows)

    sections = F.transform(spans(heads, F.size(lines)), lambda s: F.struct(s["name"].alias("name"), entries(s).alias("rows")))
    return let(F.struct(heads.alias("heads"), sections.alias("sections")), checked)


def entries_of(text: Column) -> Column:
    """The array of (line, section, key, value, error) of a text."""
    return let(F.transform(F.split(text, "\r?\n"), _read), _placed)


def as_variant(text: Column) -> Column:
    """(value, error): the document as one object, its sections as objects in it."""
    lines = F.transform(F.split(text, "\r?\n"), _read)
    heads = F.array_distinct(F.transform(F.filter(lines, lambda x: x["header"].isNotNull()), lambda x: x["header"]))
    pairs = lambda es, name: F.map_from_entries(F.transform(F.filter(es, lambda e: e["section"] == name), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("variant").alias("value"))))

    def of(es: Column) -> Column:
        bad = F.get(F.filter(es, lambda e: e["error"].isNotNull()), F.lit(0))["error"]
        sections = F.map_from_entries(F.transform(heads, lambda h: F.struct(h.alias("key"), F.to_variant_object(pairs(es, h)).alias("value"))))
        whole = F.when(bad.isNull(), F.to_variant_object(F.map_concat(pairs(es, F.lit("")), sections)))
        return F.struct(whole.alias("value"), bad.alias("error"))

    return let(entries_of(text), of)


def read_ini(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, section, key, value, error): a document's entries, those before the
    first header with an empty section; or, if it can't be read, one row with the
    first line in error and the error's code, never the text."""
    rows = docs.select(F.col(id_col), F.explode(entries_of(F.col(text_col))).alias("_e"))
    return rows.select(id_col, "_e.line", "_e.section", "_e.key", "_e.value", "_e.error")


# Edits that keep every line but the one they change.


def _newline(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r\n")), "\r\n").otherwise("\n")


def _ended(text: Column, newline: Column) -> Column:
    """With the end of its last line."""
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, newline))


def _edited(text: Column, section: str, key: str, value: Column | None) -> Column:
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, r"\r?\n?\z", "")
    is_header = lambda x: trimmed(bare(x)).startswith("[") & trimmed(bare(x)).endswith("]")
    name = lambda x: trimmed(F.regexp_replace(trimmed(bare(x)), r"\A\[|\]\z", ""))
    is_key = lambda x: F.contains(x, F.lit("=")) & (trimmed(F.substring_index(x, "=", 1)) == key)
    joined = lambda x: F.array_join(x, "")

    def with_lines(ls: Column) -> Column:
        heads = F.filter(F.transform(ls, lambda x, i: F.when(is_header(x), F.struct(name(x).alias("name"), (i + 1).alias("line")))), lambda h: h.isNotNull())

        def with_spans(all_: Column) -> Column:
            own = lambda s: F.slice(ls, s["start"], s["count"])
            mine = F.get(F.filter(all_, lambda s: s["name"] == section), F.lit(0))
            at = F.when(mine.isNotNull(), mine["start"] - 1 + F.array_position(F.transform(own(mine), is_key), True))
            there = mine.isNotNull() & (at >= mine["start"])
            before = lambda n: F.slice(ls, F.lit(1), F.greatest(n, F.lit(0)))
            after = lambda n: F.slice(ls, n + 1, F.size(ls) + 1)
            found = lambda changed: F.concat(joined(before(at - 1)), changed, joined(after(at)))
            if value is None:
                return F.struct(F.when(there, found(F.lit(""))).alias("value"), F.when(~there, NOT_FOUND).alias("error"))
            old = F.element_at(ls, at.cast("int"))
            # The key's own spacing stays, and the end of the line.
            changed = F.concat(F.regexp_extract(old, rf"\A[^=]*=[{SPACES}&&[^\r\n]]*", 0), value, F.regexp_extract(old, r"\r?\n?\z", 0))
            end, newline = F.size(ls), _newline(text)
            entry = F.concat(F.lit(f"{key}="), value, newline)
            last = F.when(mine.isNotNull(), mine["start"] + mine["count"] - 1)
            blank = F.size(F.array()) if section == "" else F.size(own(mine)) - F.array_max(F.concat(F.array(F.lit(0)), F.transform(own(mine), lambda x, i: F.when(trimmed(bare(x)) != "", i + 1).otherwise(0))))
            put_at = F.when(last < end, last - blank).otherwise(last)
            inside = F.concat(_ended(joined(before(put_at)), newline), entry, joined(after(put_at)))
            opened = F.concat(F.when(text == "", "").otherwise(F.concat(_ended(text, newline), newline)), F.lit(f"[{section}]"), newline, entry)
            clash = F.exists(all_, lambda s: s["name"] == key) if section == "" else F.exists(own(all_[0]), lambda x: F.contains(x, F.lit("=")) & (trimmed(F.substring_index(x, "=", 1)) == section))
            out = F.when(there, found(changed)).when(~clash & mine.isNotNull(), inside).when(~clash, opened)
            return F.struct(out.alias("value"), F.when(~there & clash, UNSUPPORTED).alias("error"))

        return let(spans(heads, F.size(ls)), with_spans)

    bad = F.exists(entries_of(text), lambda e: e["error"].isNotNull())
    refused = (lambda e: F.struct(F.lit(None).cast("string").alias("value"), F.lit(e).alias("error")))
    out = F.when(text.isNull() | bad, refused(PARSE_FAILED))
    if value is not None:
        out = out.when(value.isNull() | value.rlike(r"[\r\n]"), refused(BAD_ARGUMENT))
    return out.otherwise(let(lines, with_lines))


def _place(path: str) -> tuple[str, str]:
    segments = parse_path(path)
    if len(segments) > 2:
        raise PathError(BAD_PATH, "an INI path is a key, or a section and a key")
    if any(re.search(r"[\[\]=\r\n]", s) or s != s.strip() or s == "" for s in segments):
        raise PathError(BAD_ARGUMENT, "a name that INI can't hold")
    return ("", segments[0]) if len(segments) == 1 else (segments[0], segments[1])


def set_ini(text: Column, path: str, value: Column) -> Column:
    """(value, error): the text with one entry's value replaced, or with a new entry at
    the end of its section; all other bytes stay. A value of several lines is refused."""
    return _edited(text, *_place(path), value)


def unset_ini(text: Column, path: str) -> Column:
    """(value, error): the text without the line of one entry."""
    return _edited(text, *_place(path), None)
