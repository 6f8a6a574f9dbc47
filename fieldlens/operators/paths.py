"""Documents by path: addresses, look-ups, children, keyed lists and edits.

A dot parts the segments of a path; ``\\.``, ``\\\\`` and ``\\*`` stand for a dot, a
backslash and a star in a key, and a bare ``*`` for every child. Paths are read
while the plan is built. Documents are VARIANT columns; the functions for typed
tables use the fields themselves, so that pruning and pushdown reach the scan.

A look-up gives a struct of ``value`` and ``error``: null, or one of ``ERRORS``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants
from ..functions.json import whole_json
from ..functions.names import is_secret
from ..functions.urls import MARK, let, secret_name

# The codes of errors.
NOT_FOUND, WRONG_TYPE, NO_SLUG, AMBIGUOUS, SLUG_EXISTS = "document_path_not_found", "document_type_mismatch", "document_slug_not_found", "document_ambiguous_match", "document_slug_exists"
BAD_PATH, BAD_ARGUMENT, NO_CONTAINER, NO_SCALAR, IS_NULL, IS_SECRET, PARSE_FAILED = "document_invalid_path", "document_invalid_argument", "document_not_container", "document_not_scalar", "document_null_value", "document_secret_redacted", "document_parse_failed"
ERRORS = (NOT_FOUND, WRONG_TYPE, NO_SLUG, AMBIGUOUS, SLUG_EXISTS, BAD_PATH, BAD_ARGUMENT, NO_CONTAINER, NO_SCALAR, IS_NULL, IS_SECRET, PARSE_FAILED)
# End of the fixed values.


class PathError(ValueError):
    """A path that can't be read; ``code`` is one of ``ERRORS``."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


@dataclass(frozen=True)
class Each:
    """A segment that stands for every child."""


EACH = Each()


def parse_pattern(path: str) -> list[str | Each]:
    """The segments of a path that may hold stars."""
    if path == "":
        raise PathError(BAD_ARGUMENT, "an empty path")
    if not re.fullmatch(r"(?s)(?:[^\\]|\\[.\\*])*", path):
        raise PathError(BAD_PATH, "a backslash stands before a dot, a backslash or a star only")
    pieces, start = [], 0
    for dot in re.finditer(r"(?s)\\.|(\.)", path):
        if dot[1]:
            pieces.append(path[start : dot.start()])
            start = dot.end()
    pieces.append(path[start:])
    return [EACH if p == "*" else re.sub(r"(?s)\\(.)", r"\1", p) for p in pieces]


def parse_path(path: str) -> list[str]:
    """The segments of a path without bare stars."""
    found = parse_pattern(path)
    if EACH in found:
        raise PathError(BAD_PATH, "a bare star is a pattern; write \\* for a key")
    return found


def join_path(segments: list[str]) -> str:
    return ".".join(re.sub(r"([\\.*])", r"\\\1", s) for s in segments)


def join_path_column(segments: Column) -> Column:
    """The same of an array column."""
    return F.array_join(F.transform(segments, lambda s: F.regexp_replace(s, r"([\\.*])", r"\\$1")), ".")


def _quotable(key: str) -> bool:
    return not ("'" in key and '"' in key)


def _child(key: str) -> str:
    return _below([key])


def _below(keys: list[str]) -> str:
    """A path for the engine's own look-up; no key may have both kinds of quotes."""
    return "$" + "".join(f"['{k}']" if '"' in k else f'["{k}"]' for k in keys)


def _in_object(v: Column, key: str) -> Column:
    if _quotable(key):
        return F.try_variant_get(v, _child(key), "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def kind(v: Column) -> Column:
    """null, boolean, number, string, array or object."""
    return variants.kind(v)


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _found(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _has_slug(x: Column, field: str, slug: str, contains: bool = False) -> Column:
    own = F.try_variant_get(x, _child(field), "string") if _quotable(field) else F.try_variant_get(_in_object(x, field), "$", "string")
    if contains:
        return F.coalesce(F.contains(F.lower(own), F.lit(slug.lower())), F.lit(False)) & F.lit(slug != "")
    return F.coalesce(own == slug, F.lit(False))


def matches(v: Column, field: str, slug: str, contains: bool = False) -> Column:
    """The places of an array's elements whose ``field`` is the slug, or holds it in
    any case (an empty slug then matches nothing)."""
    test = lambda x: _has_slug(x, field, slug, contains)
    at = F.transform(_elements(v), lambda x, i: F.when(test(x), i))
    return F.filter(at, lambda i: i.isNotNull())


_AT = "struct<value:variant,error:string,name:string>"


def _step(v: Column, segment: str, keyed: str | None) -> Column:
    """One segment down from a variant: value, error and name, the segment as a path has
    it, an element's name turned into its index. What is there takes one look-up; the
    kind of ``v``, for which all of it is read, is asked for only where nothing is found."""
    own, none = F.lit(join_path([segment])), F.lit(None)
    digits = re.fullmatch("[0-9]+", segment)
    at = lambda value, error, name: F.struct(value.alias("value"), error.alias("error"), name.alias("name")).cast(_AT)
    lacking = lambda x: let(kind(x), lambda k: at(none, F.when(~k.isin("object", "array"), WRONG_TYPE).when(k.isNotNull(), NOT_FOUND), own))
    child = _in_object(v, segment)
    if digits:
        child = F.coalesce(child, F.try_variant_get(v, f"$[{min(int(segment), 2**31 - 1)}]", "variant"))
    plain = let(child, lambda x: F.when(x.isNotNull(), at(x, none, own)).otherwise(lacking(v)))
    if keyed is None or digits:
        return plain

    def among(elements: Column) -> Column:
        hits = F.filter(F.transform(elements, lambda x, i: F.when(_has_slug(x, keyed, segment), F.struct(i.alias("i"), x.alias("x")))), lambda h: h.isNotNull())
        one = lambda h: F.when(F.size(h) == 1, at(h[0]["x"], none, h[0]["i"].cast("string"))).otherwise(at(none, F.when(F.size(h) == 0, NO_SLUG).otherwise(AMBIGUOUS), own))
        return let(hits, one)

    return let(_elements(v), lambda es: F.when(es.isNotNull(), among(es)).otherwise(plain))


def get(v: Column, path: str, keyed: dict[str, str] | None = None) -> Column:
    """The value at a path. All digits are an index in an array and a key in an object;
    other segments name an element of an array by the field that ``keyed`` gives for
    the array's path. A name that two elements have is ambiguous, never the first.
    Where all segments are keys, one look-up of the engine finds the value, and the steps
    only tell the error where it finds none."""
    segments = parse_path(path)
    got = lambda o: F.struct(o["value"].alias("value"), o["error"].alias("error"))
    if not keyed and len(segments) > 0 and all(_quotable(s) and not re.fullmatch("[0-9]+", s) for s in segments):
        none = F.lit(None).cast("string")
        return let(F.try_variant_get(v, _below(segments), "variant"), lambda x: F.when(x.isNotNull(), F.struct(x.alias("value"), none.alias("error"))).otherwise(let(_stepped(v, segments, keyed), got)))
    return let(_stepped(v, segments, keyed), got)


def _stepped(v: Column, segments: list[str], keyed: dict[str, str] | None) -> Column:
    """(value, error, name) after all steps; name is the path with indexes for names."""
    out = F.struct(v.alias("value"), F.when(v.isNull(), NOT_FOUND).alias("error"), F.lit(None).cast("string").alias("name")).cast(_AT)

    def further(i: int, segment: str, field: str | None):
        def step(o: Column) -> Column:
            named = lambda x: F.struct(x["value"].alias("value"), x["error"].alias("error"), (F.concat_ws(".", o["name"], x["name"]) if i else x["name"]).alias("name"))
            # Once a step failed its error stays.
            return F.when(o["error"].isNotNull(), o).otherwise(let(_step(o["value"], segment, field), named))

        return step

    for i, segment in enumerate(segments):
        out = let(out, further(i, segment, (keyed or {}).get(join_path(segments[:i]) if i else "")))
    return out


def is_secret_path(path: str, secret_names: frozenset[str] = frozenset()) -> bool:
    """Whether any segment is a secret's name."""
    return any(is_secret(s, secret_names) for s in parse_pattern(path) if s is not EACH)


def scalar(v: Column, path: str, keyed: dict[str, str] | None = None, default: str | None = None, reveal: bool = False, secret_names: frozenset[str] = frozenset()) -> Column:
    """The text of the scalar at a path. A secret is refused unless it is to be
    revealed; the default stands for what is missing or null, never for what is
    ambiguous or no scalar."""
    if is_secret_path(path, secret_names) and not reveal:
        return F.struct(F.lit(None).cast("string").alias("value"), F.lit(IS_SECRET).alias("error"))

    def of(got: Column) -> Column:
        k = kind(got["value"])
        error = F.when(got["error"].isNotNull(), got["error"]).when(k == "null", IS_NULL).when(k.isin("object", "array"), NO_SCALAR)
        text = F.when(k == "string", F.try_variant_get(got["value"], "$", "string")).otherwise(F.to_json(got["value"]))
        if default is not None:
            missing = F.coalesce(error.isin(NOT_FOUND, NO_SLUG, IS_NULL), F.lit(False))
            return F.struct(F.when(missing, default).otherwise(F.when(error.isNull(), text)).alias("value"), F.when(~missing, error).alias("error"))
        return _found(text, error)

    return let(get(v, path, keyed), of)


def shown(v: Column, path: str, keyed: dict[str, str] | None = None, secret_names: frozenset[str] = frozenset()) -> Column:
    """The value at a path as JSON text; of a secret, a mark."""
    got = get(v, path, keyed)
    text = F.lit(f'"{MARK}"') if is_secret_path(path, secret_names) else F.to_json(got["value"])
    return F.struct(F.when(got["error"].isNull() & (kind(got["value"]) == "null"), "null").when(got["error"].isNull(), text).alias("value"), got["error"].alias("error"))


def typed(v: Column, path: str, kind_: str, keyed: dict[str, str] | None = None) -> Column:
    """The value at a path as a Spark type; a value that doesn't fit is a type mismatch."""

    def of(got: Column) -> Column:
        value = F.try_variant_get(got["value"], "$", kind_)
        return F.struct(value.alias("value"), F.coalesce(got["error"], F.when(value.isNull() & (kind(got["value"]) != "null"), WRONG_TYPE)).alias("error"))

    return let(get(v, path, keyed), of)


def values(df: DataFrame, v: str, pattern: str, keep: list[str]) -> DataFrame:
    """(keep, path, value): every value that a pattern addresses; keys of objects in
    order of their bytes. Paths that lead nowhere give no row. One expression and one
    explode: a document is looked at once, however many segments there are."""
    none = F.array().cast("array<struct<path:string,value:variant>>")

    def level(x: Column, path: Column | None, segments: list) -> Column:
        if not segments:
            return F.array(F.struct(path.alias("path"), x.alias("value")))
        segment, *rest = segments
        below = lambda name: name if path is None else F.concat(path, F.lit("."), name)
        if segment is EACH:
            name = lambda e, i: F.when(e["key"].isNull(), i.cast("string")).otherwise(join_path_column(F.array(e["key"])))
            each = F.transform(variants.entries(x), lambda e, i: level(e["value"], below(name(e, i)), rest))
            return F.coalesce(F.flatten(each), none)
        child = _in_object(x, segment)
        if re.fullmatch("[0-9]+", segment):
            child = F.coalesce(child, F.try_variant_get(x, f"$[{min(int(segment), 2**31 - 1)}]", "variant"))
        return let(child, lambda c: F.when(c.isNotNull(), level(c, below(F.lit(join_path([segment]))), rest)).otherwise(none))

    found = F.explode(level(F.col(v), None, parse_pattern(pattern)))
    return df.select(*keep, found.alias("_found")).select(*keep, "_found.path", "_found.value")


MULTILINE = "document_multiline_value"
_ROW = "array<struct<number:int,path:string,value:string,error:string>>"


def scalars(df: DataFrame, v: str, patterns: list[str], keep: list[str], reveal: bool = False, secret_names: frozenset[str] = frozenset()) -> DataFrame:
    """(keep, number, path, value, error): the scalars that many patterns address, from
    one look at each document; ``number`` is the pattern's place in the list. Patterns
    are read as one tree of prefixes: a step that several share is taken once, and each
    star walks the children of what stands there once. A value with a line feed is
    refused, for lines of a list must stay lines; so is a secret unless revealed."""
    tree: dict = {}
    for number, pattern in enumerate(patterns):
        at = tree
        for segment in parse_pattern(pattern):
            at = at.setdefault(segment, {})
        at.setdefault(None, []).append(number)
    none = F.lit(None).cast("string")

    def rows(numbers: list[int], path: Column, value: Column, error: Column) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("number"), path.alias("path"), value.alias("value"), error.alias("error")) for n in numbers]).cast(_ROW)

    def below(node: dict, rest: str = "") -> list[tuple[int, str]]:
        """The patterns that go on from here, with what follows of each."""
        own = [(n, rest) for n in node.get(None, [])]
        return [*own, *(p for k, x in node.items() if k is not None for p in below(x, f"{rest}.{'*' if k is EACH else join_path([k])}"))]

    def failed(node: dict, path: Column, error: Column) -> Column:
        return F.concat(*[rows([n], F.concat(path, F.lit(rest)), none, error) for n, rest in below(node)])

    def ends(numbers: list[int], path: Column, x: Column, secret: Column) -> Column:
        def of(k: Column) -> Column:
            text = F.when(k == "string", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
            refused = F.when(secret & F.lit(not reveal), IS_SECRET).when(k == "null", IS_NULL).when(k.isin("object", "array"), NO_SCALAR)
            one = lambda t: F.struct(F.when(~F.contains(t, F.lit("\n")), t).alias("t"), F.coalesce(refused, F.when(F.contains(t, F.lit("\n")), MULTILINE)).alias("e"))
            return let(F.when(refused.isNull(), text), one)

        return let(let(kind(x), of), lambda r: rows(numbers, path, r["t"], r["e"]))

    def each_child(inner: dict, x: Column, path: Column, joined, secret: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            name = F.when(e["key"].isNull(), i.cast("string")).otherwise(join_path_column(F.array(e["key"])))
            hidden = F.coalesce(secret_name(e["key"], sorted(secret_names)), F.lit(False))
            return walk(inner, e["value"], joined(name), secret | hidden)

        refused = failed(inner, joined(F.lit("*")), F.lit(NO_CONTAINER))
        return let(variants.entries(x), lambda es: F.when(es.isNull(), refused).otherwise(F.flatten(F.transform(es, one))))

    def one_child(segment: str, inner: dict, x: Column, name: Column, secret: Column) -> Column:
        hidden = secret | F.lit(is_secret(segment, secret_names))
        child = _in_object(x, segment)
        if re.fullmatch("[0-9]+", segment):
            child = F.coalesce(child, F.try_variant_get(x, f"$[{min(int(segment), 2**31 - 1)}]", "variant"))
        # Only where nothing is found it is asked why.
        return let(child, lambda c: F.when(c.isNotNull(), walk(inner, c, name, hidden)).otherwise(failed(inner, name, _step(x, segment, None)["error"])))

    def walk(node: dict, x: Column, path: Column, secret: Column) -> Column:
        parts = [ends(node[None], path, x, secret)] if None in node else []
        joined = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
        for segment, inner in node.items():
            if segment is EACH:
                parts.append(each_child(inner, x, path, joined, secret))
            elif segment is not None:
                parts.append(one_child(segment, inner, x, joined(F.lit(join_path([segment]))), secret))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    missing = F.concat(*[rows([n], F.lit(p), none, F.lit(NOT_FOUND)) for n, p in enumerate(patterns)])
    found = F.when(F.col(v).isNull(), missing).otherwise(walk(tree, F.col(v), F.lit(""), F.lit(False)))
    return df.select(*keep, F.explode(found).alias("_r")).select(*keep, "_r.number", "_r.path", "_r.value", "_r.error")


def children(df: DataFrame, v: str, keep: list[str], path: str | None = None) -> DataFrame:
    """(keep, name, path, error): the children at a path (of the root without one). A
    scalar has an error instead, and so has a root key that is empty: no path names it."""
    segments = parse_path(path) if path else []
    got = get(F.col(v), path) if path else _found(F.col(v), F.when(F.col(v).isNull(), NOT_FOUND))
    none = F.lit(None).cast("string")
    row = lambda name, path, error: F.struct(name.alias("name"), path.alias("path"), error.alias("error"))
    lead = F.lit(join_path(segments) + ".") if segments else F.lit("")
    bare = F.when(F.lit(not segments), "document_unaddressable_key")

    def child(name: Column) -> Column:
        nameless = (name == "") & bare.isNotNull()
        return row(name, F.when(~nameless, F.concat(lead, join_path_column(F.array(name)))), F.when(nameless, bare))

    def below(o: Column) -> Column:
        names = F.coalesce(F.map_keys(F.try_variant_get(o["value"], "$", "map<string,variant>")), F.transform(_elements(o["value"]), lambda _, i: i.cast("string")))
        refused = F.when(o["error"].isNotNull() | o["value"].isNotNull(), F.array(row(none, none, F.coalesce(o["error"], F.lit(NO_CONTAINER)))))
        return let(names, lambda ns: F.when(o["error"].isNull() & ns.isNotNull(), F.transform(ns, child)).otherwise(refused))

    # One look at each document, whether it has children or an error.
    return df.select(*keep, F.explode(let(got, below)).alias("_row")).select(*keep, "_row.name", "_row.path", "_row.error")


def resolve(v: Column, path: str, keyed: dict[str, str]) -> Column:
    """The path with each element's name in it turned into the element's index."""
    return let(_stepped(v, parse_path(path), keyed), lambda o: F.struct(F.when(o["error"].isNull(), o["name"]).alias("value"), o["error"].alias("error")))


# Values from text, and what they may replace.


def coerce(text: Column, kind_: str) -> Column:
    """Text as a variant of the kind string, number, bool, null or json."""
    as_number = F.when(text.rlike(r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), F.try_parse_json(text))
    word = F.lower(text)
    as_bool = F.when(word.isin("true", "yes", "on", "1"), F.lit(True)).when(word.isin("false", "no", "off", "0"), F.lit(False)).cast("variant")
    null = F.parse_json(F.lit("null"))
    value = {"string": text.cast("variant"), "number": as_number, "bool": as_bool, "json": whole_json(text), "null": F.when(text.isNull(), null)}[kind_]
    missing = F.lit(False) if kind_ == "null" else text.isNull()
    return _found(value, F.when(missing | value.isNull(), PARSE_FAILED))


def may_overwrite(old: Column) -> Column:
    """Whether a value without a stated type may take the place: only of nothing or a string."""
    return old.isNull() | F.coalesce(kind(old) == "string", F.lit(False))


def coerce_toward(text: Column, old: Column) -> Column:
    """Text as the kind that the present value has; a string where there is none."""
    of = kind(old)
    pick = lambda k: coerce(text, k)
    return F.when(of == "boolean", pick("bool")).when(of == "number", pick("number")).when(of.isin("array", "object"), _found(F.lit(None).cast("variant"), F.lit(WRONG_TYPE))).otherwise(pick("string"))


# Edits of typed columns.


def set_field(df: DataFrame, path: str, value: Column) -> DataFrame:
    """The table with the field at a path set; missing structs on the way are made."""
    head, *rest = parse_path(path)
    if not rest:
        return df.withColumn(head, value)
    there = head in df.columns
    if there and not isinstance(df.schema[head].dataType, T.StructType):
        raise PathError(WRONG_TYPE, f"{head} is no struct")
    return df.withColumn(head, _with(F.col(f"`{head}`") if there else None, df.schema[head].dataType if there else None, rest, value))


def _with(of: Column | None, kind_: T.StructType | None, path: list[str], value: Column) -> Column:
    head, *rest = path
    fields = kind_.fieldNames() if kind_ is not None else []
    if rest:
        inner = kind_[head].dataType if head in fields else None
        if inner is not None and not isinstance(inner, T.StructType):
            raise PathError(WRONG_TYPE, f"{head} is no struct")
        value = _with(of[head] if inner is not None else None, inner, rest, value)
    kept = [of[f].alias(f) for f in fields if f != head] if of is not None else []
    placed = [*kept, value.alias(head)] if head not in fields else [value.alias(f) if f == head else of[f].alias(f) for f in fields]
    return F.struct(*placed)


def unset_field(df: DataFrame, path: str) -> DataFrame:
    """The table without the field at a path. A struct's only field takes the struct with
    it: it becomes null."""
    head, *rest = parse_path(path)
    at: T.DataType = df.schema
    for name in (head, *rest):
        if not isinstance(at, T.StructType) or name not in at.fieldNames():
            raise PathError(NOT_FOUND, f"no field {name}")
        at = at[name].dataType
    if not rest:
        return df.drop(head)
    above: T.DataType = df.schema
    for name in (head, *rest)[:-1]:
        above = above[name].dataType
    if len(above.fields) == 1:  # a struct without fields can't be stored: null stands for it
        empty = F.lit(None).cast("void")
        return set_field(df, join_path([head, *rest[:-1]]), empty)
    return df.withColumn(head, F.col(f"`{head}`").dropFields(".".join(f"`{r}`" for r in rest)))


def unset_element(array: Column, index: int) -> Column:
    """An array without one element."""
    return F.filter(array, lambda _, i: i != index)


def add_keyed(array: Column, field: str, slug: Column, element: Column) -> Column:
    """(value, error): the array with an element more, whose ``field`` is the slug, unless
    one has it already. A null array is made."""
    exists = F.coalesce(F.exists(array, lambda x: x[field] == slug), F.lit(False))
    more = element.withField(field, slug)
    out = F.when(array.isNull(), F.array(more)).otherwise(F.array_append(array, more))
    return F.struct(F.when(~exists, out).alias("value"), F.when(exists, SLUG_EXISTS).alias("error"))


def remove_keyed(array: Column, field: str, slug: Column) -> Column:
    """(value, error): the array without its only element with this slug."""
    hits = F.size(F.filter(array, lambda x: x[field] == slug))
    error = F.when(array.isNull() | (hits == 0), NO_SLUG).when(hits > 1, AMBIGUOUS)
    return F.struct(F.when(error.isNull(), F.filter(array, lambda x: ~x[field].eqNullSafe(slug))).alias("value"), error.alias("error"))
