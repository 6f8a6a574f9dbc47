"""VARIANT values whose keys are known per row only: redaction, leaves, YAML, text
(plain text: :mod:`plain`).

Every function is one native expression. Objects and arrays are taken as one list of
(key, value) entries, keys of arrays being null, so a level of nesting adds one copy
of an expression and a plan grows with ``deepest``, never with its power; a row
evaluates only as many levels as it has. What lies deeper is hidden by redaction, and
stays JSON text elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import MARK, let, redact_url_field, secret_name

#: Levels of nesting that plans are made for; the analyzer takes several passes for each.
DEEPEST = 8
ENTRY = "array<struct<key:string,value:variant>>"


def kind(v: Column) -> Column:
    """null, boolean, number, string, array or object; null of no value."""

    def named(t: Column) -> Column:
        found = F.when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
        return found.when(t.isin("STRING", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "BINARY"), "string").when(t.isNotNull(), "number")

    # The schema of a value takes all of it: it is asked for once.
    return let(F.schema_of_variant(v), named)


def as_object(v: Column) -> Column:
    """The map of an object's entries; null of all else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def entries(v: Column) -> Column:
    """(key, value) of an object's or array's entries; null of all else."""
    return F.coalesce(F.map_entries(as_object(v)), F.transform(as_array(v), lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("value")))).cast(ENTRY)


def url_name(name: Column, url_names: list[str] | None = None) -> Column:
    found = name.endswith("_url") | name.endswith("_URL")
    return found | name.isin(*url_names) if url_names else found


def _url_texts(v: Column, in_url: Column, url_names: list[str] | None, deepest: int) -> Column:
    """The texts under names of URLs."""
    none = F.array().cast("array<string>")

    def level(x: Column, url: Column, left: int) -> Column:
        own = F.when(url & (F.schema_of_variant(x) == "STRING"), F.array(F.try_variant_get(x, "$", "string"))).otherwise(none)
        if not left:
            return own
        below = lambda e: level(e["value"], url | F.coalesce(url_name(e["key"], url_names), F.lit(False)), left - 1)
        return F.coalesce(F.flatten(F.transform(entries(x), below)), own)

    return level(v, in_url, deepest)


def redact(v: Column, in_url: Column | bool = False, secret_names: list[str] | None = None, url_names: list[str] | None = None, deepest: int = DEEPEST) -> Column:
    """Values under secret names become marks, also whole objects and arrays (null stays
    null); texts under names of URLs lose their secrets, at any depth below such a name.
    An object or array below ``deepest`` levels becomes a mark itself."""
    mark, in_url = F.lit(MARK).cast("variant"), in_url if isinstance(in_url, Column) else F.lit(in_url)

    def rebuilt(clean: Column) -> Column:
        def leaf(x: Column, url: Column) -> Column:
            text = F.when(url & (F.schema_of_variant(x) == "STRING"), F.try_variant_get(x, "$", "string"))
            return F.when(text.isNotNull(), F.try_element_at(clean, text).cast("variant")).otherwise(x)

        def level(x: Column, url: Column, left: int) -> Column:
            if not left:
                return F.when(F.size(entries(x)) > 0, mark).otherwise(leaf(x, url))

            def one(e: Column) -> Column:
                named = F.coalesce(url_name(e["key"], url_names), F.lit(False))
                hidden = F.coalesce(secret_name(e["key"], secret_names), F.lit(False)) & ~F.is_variant_null(e["value"])
                return F.struct(e["key"].alias("key"), F.when(hidden, mark).otherwise(level(e["value"], url | named, left - 1)).alias("value"))

            def built(done: Column) -> Column:
                filled = F.size(done) > 0  # an empty object or array is a leaf
                has_keys = filled & F.get(done, F.lit(0))["key"].isNotNull()
                return F.when(has_keys, F.to_variant_object(F.map_from_entries(done))).when(filled, F.to_variant_object(F.transform(done, lambda e: e["value"]))).otherwise(leaf(x, url))

            return let(F.transform(entries(x), one), built)

        return level(v, in_url, deepest)

    # The long expression that cleans a URL stands in the plan once, not at each level.
    pairs = F.transform(F.array_distinct(_url_texts(v, in_url, url_names, deepest)), lambda t: F.struct(t.alias("key"), redact_url_field(t, secret_names).alias("value")))
    return F.when(v.isNotNull(), let(F.map_from_entries(pairs), rebuilt))


def url_leaves(v: Column, deepest: int = DEEPEST) -> Column:
    """The leaves of a value as texts; null for one that is no text. Nulls are left out."""

    def level(x: Column, left: int) -> Column:
        own = F.when(F.is_variant_null(x), F.array().cast("array<string>")).otherwise(F.array(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
        return own if not left else F.coalesce(F.flatten(F.transform(entries(x), lambda e: level(e["value"], left - 1))), own)

    return level(v, deepest)


def scalar_text(v: Column) -> Column:
    """A text as it is, all else as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(json_numbers(F.to_json(v)))


_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?E-?[0-9]+'


def _shortest(token: Column) -> Column:
    """``1.25E7`` as ``12500000.0``, ``1.0E-7`` as ``1e-7``: digits as they are, plain from
    1e-5 up to 1e16."""
    sign = F.when(token.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(token, "^-", "")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(bare, "E", 1), r"\.0$", ""), r"\.", "")
    power = F.substring_index(bare, "E", -1).cast("int")
    n = F.length(digits)
    whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))
    split = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))))
    plain = F.when((power >= 0) & (power < 16), F.when(n <= power + 1, whole).otherwise(split)).when((power < 0) & (power >= -5), small)
    return F.concat(sign, F.coalesce(plain, F.concat(mantissa, F.lit("e"), power.cast("string"))))


def json_numbers(text: Column) -> Column:
    """JSON text with its numbers in plain digits where others write them so."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), lambda t: F.when(t.startswith('"'), t).otherwise(_shortest(t)))
    joined = F.transform(F.arrays_zip(F.split(text, _TOKENS, -1).alias("t"), found.alias("u")), lambda p: F.concat(p["t"], F.coalesce(p["u"], F.lit(""))))
    return F.when(text.rlike("[0-9]E-?[0-9]"), F.array_join(joined, "")).otherwise(text)


def yaml(v: Column, key_text, quoted, pad: int = 0, deepest: int = DEEPEST) -> Column:
    """What follows a key or a dash: a scalar after a space, or lines, keys in UTF-16
    order. ``key_text`` and ``quoted`` give a key and a text as YAML."""

    def level(x: Column, at: int, left: int) -> Column:
        is_text = F.schema_of_variant(x) == "STRING"
        scalar = F.concat(F.lit(" "), F.when(is_text, quoted(F.try_variant_get(x, "$", "string"))).otherwise(json_numbers(F.to_json(x))))
        if not left:
            return scalar
        lead = F.lit("  " * (at + 1))

        def one(e: Column, i: Column) -> Column:
            line = F.concat(lead, F.coalesce(F.concat(key_text(e["key"]), F.lit(":")), F.lit("-")), level(e["value"], at + 1, left - 1))
            return F.struct(F.encode(e["key"], "UTF-16BE").alias("k"), i.alias("i"), line.alias("t"))

        lines = lambda done: F.when(F.size(done) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(F.array_sort(done), lambda p: p["t"]), "\n"))).otherwise(scalar)
        return let(F.transform(entries(x), one), lines)

    return F.when(F.coalesce(F.is_variant_null(v), F.lit(True)), " null").otherwise(level(v, pad, deepest))
