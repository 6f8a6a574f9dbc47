"""Redaction, rendering and lint of typed tables.

All names are looked at while the plan is built: a table's columns become one
projection, so that pruning and pushdown work as for any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats, names, plain, urls, variants
from . import lint

FINDING = "rule_id string, severity string, pointer string, message string"


def _redacted(value: Column, kind: T.DataType, in_url: bool, secret_names: frozenset, url_names: frozenset, path: str = "", variant=None) -> Column:
    """``variant`` makes another safe form of VARIANT columns and fields of structs, of
    their value, their ``path`` and whether they stand below a URL's name."""
    again = lambda x, k, deep=in_url: _redacted(x, k, deep, secret_names, url_names)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_field(value[f.name], f, in_url, secret_names, url_names, f"{path}.", variant).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: again(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _redacted_map(value, kind, in_url, secret_names, url_names)
    if isinstance(kind, T.StringType) and in_url:
        return urls.redact_url_field(value, sorted(secret_names))
    if isinstance(kind, T.VariantType):
        return variant(value, path, in_url) if variant else variants.redact(value, in_url, sorted(secret_names), sorted(url_names))
    return value


def _redacted_map(value: Column, kind: T.MapType, in_url: bool, secret_names: frozenset, url_names: frozenset) -> Column:
    """A map's keys are looked at row by row. Values that aren't strings become
    variants if a key may be secret, so that a mark can stand among them."""
    of = kind.valueType
    inner = lambda x, deep: _redacted(x, of, deep, secret_names, url_names)
    as_url = lambda k: k.endswith("_url") | k.endswith("_URL") | k.isin(*sorted(url_names)) if url_names else k.endswith("_url") | k.endswith("_URL")
    plain = isinstance(of, T.StringType)

    def one(k: Column, x: Column) -> Column:
        if isinstance(of, T.VariantType):
            clean = variants.redact(x, F.lit(in_url) | as_url(k), sorted(secret_names), sorted(url_names))
        else:
            clean = inner(x, True) if in_url else F.when(as_url(k), inner(x, True)).otherwise(inner(x, False)) if _holds_text(of) else inner(x, in_url)
        if plain:
            return F.when(urls.secret_name(k, sorted(secret_names)) & x.isNotNull(), urls.MARK).otherwise(clean)
        wrapped = F.to_variant_object(clean) if isinstance(of, (T.StructType, T.ArrayType, T.MapType)) else clean.cast("variant")
        return F.when(urls.secret_name(k, sorted(secret_names)) & x.isNotNull(), F.lit(urls.MARK).cast("variant")).otherwise(wrapped)

    return F.transform_values(value, one)


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    return isinstance(kind, (T.StringType, T.VariantType)) if inner is None else _holds_text(inner)


def _field(value: Column, field: T.StructField, in_url: bool, secret_names: frozenset, url_names: frozenset, above: str = "", variant=None) -> Column:
    if names.is_secret(field.name, secret_names):
        return F.when(value.isNotNull(), F.lit(urls.MARK))
    return _redacted(value, field.dataType, in_url or names.is_url(field.name, url_names), secret_names, url_names, above + field.name, variant)


def redact(df: DataFrame, policy: str = "all", secret_names: list[str] | None = None, url_names: list[str] | None = None) -> DataFrame:
    """Secret columns become marks (null stays null), URL columns lose their
    secrets; so do keys of maps and of VARIANT objects at any depth. ``policy``: ``all``, ``trace_only`` (the column trace
    alone) or ``off``."""
    if policy == "off":
        return df
    s, u = frozenset(secret_names or ()), frozenset(url_names or ())
    own = lambda f: F.col(f"`{f.name}`")
    return df.select(*[(_field(own(f), f, False, s, u) if policy == "all" or f.name == "trace" else own(f)).alias(f.name) for f in df.schema])


_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\x0b", "\\v"))
_SAFE_NAME = re.compile(r"[A-Za-z0-9_.\-]+")
#: Kinds whose text never needs quotes.
_BARE = {"epoch_ms", "epoch_s", "epoch_ns", "usd_cents", "eur_cents", "jpy", "bytes", "percent", "ms", "ns", "us", "s", "sats", "msats", "secret"}


def _escaped(x: Column, pairs) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _quoted(x: Column) -> Column:
    return F.when(x.rlike(f'[{urls.SPACES}="\\\\]'), F.concat(F.lit('"'), _escaped(x, _ESCAPES), F.lit('"'))).otherwise(x)


def quoted_name(name: str) -> str:
    """A name of a field as it stands before ``=``."""
    if _SAFE_NAME.fullmatch(name) or not re.search(r'[\s="\\]', name):
        return name
    for a, b in _ESCAPES:
        name = name.replace(a, b)
    return f'"{name}"'


def _utf16(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs, and the keys of its maps, in UTF-16 order."""
    if isinstance(kind, T.StructType):
        ordered = sorted(kind, key=lambda f: _utf16(f.name))
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in ordered]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(F.encode(e["key"].cast("string"), "UTF-16BE").alias("o"), e["key"].alias("k"), canonical(e["value"], kind.valueType).alias("v")))
        return F.map_from_entries(F.transform(F.array_sort(entries), lambda e: F.struct(e["k"], e["v"])))
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON text with sorted keys; nulls are written."""
    return F.to_json(canonical(value, kind), {"ignoreNullFields": "false"})


_NESTED = (T.StructType, T.ArrayType, T.MapType)


def _scalar(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _NESTED):
        return canonical_json(value, kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return formats.number(value, kind)
    if isinstance(kind, T.VariantType):
        return variants.scalar_text(value)
    return value.cast("string")


def _text(value: Column, kind: T.DataType) -> Column:
    """A leaf: arrays are joined by commas, empty ones are ``[]``."""
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(value) == 0, "[]").otherwise(F.array_join(F.transform(value, lambda x: F.coalesce(_scalar(x, kind.elementType), F.lit("null"))), ","))
    return _scalar(value, kind)


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


class _Leaf:
    """Pairs that a row may show: the names under which they may stand, and either a
    text ``key=value`` (null: not shown) or an array of (sort key, text); ``alone``: the
    texts of the latter joined, if they are in order already."""

    def __init__(self, paths: list[str], text: Column, key: Column | None = None, many: bool = False, plain_end: str = "", alone: Column | None = None):
        self.low, self.high = min(map(_utf16, paths)), max(_utf16(p + plain_end) for p in paths)
        self.text, self.key, self.many, self.alone = text, key, many, alone

    def array(self) -> Column:
        if self.many:
            return self.text
        one = F.array(F.struct(F.encode(self.key, "UTF-16BE").alias("o"), self.text.alias("t")))
        return F.filter(one, lambda p: p["t"].isNotNull())


def _leaves(fields: list[T.StructField], get, prefix: str, present: Column | None, raw: bool) -> list[_Leaf]:
    """The leaves of a struct's fields. Whether a name is stripped is known per row:
    fields that would share a name keep their own."""
    shown = {}
    for f in fields:
        m = None if raw else names.meaning(f.name)
        nice = formats.readable(get(f), f.dataType, m[1], m[2]) if m else F.lit(None).cast("string")
        shown[f.name] = (m[0] if m else f.name, nice, bool(m))
    here = lambda text: text if present is None else F.when(present, text)
    out = []
    for f in fields:
        display, nice, has = shown[f.name]
        value, full, short = get(f), prefix + f.name, prefix + display
        clash = F.lit(False)
        for g in fields if has else ():
            d, n, h = shown[g.name]
            if g.name != f.name and d == display and h:
                clash = clash | n.isNotNull()
            if g.name != f.name and g.name == display:
                clash = clash | F.lit(not h) | n.isNull()
        if isinstance(f.dataType, T.StructType) and len(f.dataType):
            there = value.isNotNull()
            out.append(_Leaf([full], here(F.when(~there, F.lit(quoted_name(full) + "="))), F.lit(full)))
            out += _leaves(list(f.dataType), lambda x, v=value: v[x.name], full + ".", there if present is None else present & there, raw)
        elif isinstance(f.dataType, T.MapType) or f.dataType == plain.PAIRS:
            pairs = _map_pairs(value, f.dataType, full, raw) if isinstance(f.dataType, T.MapType) else value.cast("array<struct<o:binary,t:string>>")
            out.append(_Leaf([full], pairs if present is None else F.when(present, pairs).otherwise(F.array().cast("array<struct<o:binary,t:string>>")), many=True, plain_end=".\U0010ffff", alone=here(F.array_join(value["_pair_text"], " ")) if f.dataType == plain.PAIRS else None))
        else:
            text = F.lit("{}") if isinstance(f.dataType, T.StructType) else _text(value, f.dataType)
            text = F.coalesce(text if _numeric(f.dataType) else _quoted(text), F.lit(""))
            stays = F.concat(F.lit(quoted_name(full) + "="), text)
            if not has:
                out.append(_Leaf([full], here(stays), F.lit(full)))
                continue
            strip = nice.isNotNull() & ~clash
            neat = nice if names.meaning(f.name)[1] in _BARE else _quoted(nice)
            both = F.when(strip, F.concat(F.lit(quoted_name(short) + "="), neat)).otherwise(stays)
            out.append(_Leaf([full, short], here(both), F.when(strip, short).otherwise(full)))
    return out


def _map_pairs(value: Column, kind: T.MapType, path: str, raw: bool) -> Column:
    """(sort key, text) for each entry of a map, whose keys are known per row only."""
    none = F.array().cast("array<struct<o:binary,t:string>>")
    entries = F.map_entries(value)

    def meant(e: Column) -> Column:
        key, x = e["key"], e["value"]
        display, nice = key, F.lit(None).cast("string")
        if not raw and not isinstance(kind.valueType, (*_NESTED, T.VariantType)):
            display, nice = formats.readable_by_name(key, x, kind.valueType)
        text = F.coalesce(_text(x, kind.valueType), F.lit(""))
        return F.struct(key.alias("k"), display.alias("d"), nice.alias("n"), text.alias("t"))

    def written(all_: Column) -> Column:
        taken = F.transform(all_, lambda e: F.when(e["n"].isNull(), e["k"]).otherwise(e["d"]))

        def one(e: Column) -> Column:
            strip = e["n"].isNotNull() & (F.size(F.filter(taken, lambda t: t == e["d"])) == 1)
            shown = F.concat(F.lit(path + "."), F.when(strip, e["d"]).otherwise(e["k"]))
            return F.struct(F.encode(shown, "UTF-16BE").alias("o"), F.concat(_quoted(shown), F.lit("="), _quoted(F.when(strip, e["n"]).otherwise(e["t"]))).alias("t"))

        return F.transform(all_, one)

    alone = lambda text: F.array(F.struct(F.encode(F.lit(path), "UTF-16BE").alias("o"), F.lit(f"{quoted_name(path)}={text}").alias("t")))
    return F.when(value.isNull(), alone("")).when(F.size(value) == 0, alone("{}")).otherwise(F.coalesce(urls.let(F.transform(entries, meant), written), none))


def _with_pairs(df: DataFrame, raw: bool, policy: str, secret_names: list[str] | None, url_names: list[str] | None) -> DataFrame:
    """The redacted table with VARIANT values, also in structs, as their pairs of a name
    and a text, redacted where they are made."""
    s, u = frozenset(secret_names or ()), frozenset(url_names or ())

    def pairs(value: Column, path: str, in_url: bool, hide: bool) -> Column:
        return plain.pairs(F.to_json(value), path, raw, hide, in_url, s, u, variants.DEEPEST)

    def as_is(value: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.VariantType):
            return pairs(value, path, False, False)
        if isinstance(kind, T.StructType) and len(kind) and _holds_variant(kind):
            return F.when(value.isNotNull(), F.struct(*[as_is(value[f.name], f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind]))
        return value

    def one(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        if policy == "all" or (policy != "off" and f.name == "trace"):
            return _field(value, f, False, s, u, variant=lambda x, path, in_url: pairs(x, path, in_url, True))
        return as_is(value, f.dataType, f.name)

    return df.select(*[one(f).alias(f.name) for f in df.schema])


def _holds_variant(kind: T.DataType) -> bool:
    return isinstance(kind, T.VariantType) or (isinstance(kind, T.StructType) and any(_holds_variant(f.dataType) for f in kind))


def render_plain(df: DataFrame, raw: bool = False) -> Column:
    """Of a table that was redacted: one ``key=value`` line a row, formatted for
    people and sorted by path in UTF-16 order. The order is settled in the plan; only
    leaves whose place depends on the row are sorted in it."""
    leaves = sorted(_leaves(list(df.schema), lambda f: F.col(f"`{f.name}`"), "", None, raw), key=lambda x: x.low)
    groups: list[list[_Leaf]] = []
    for leaf in leaves:
        if groups and leaf.low <= max(x.high for x in groups[-1]):
            groups[-1].append(leaf)
        else:
            groups.append([leaf])
    parts = []
    for group in groups:
        if len(group) == 1 and (not group[0].many or group[0].alone is not None):
            parts.append(group[0].alone if group[0].many else group[0].text)
            continue
        pairs = F.sort_array(F.concat(*[x.array() for x in group]))
        parts.append(urls.let(pairs, lambda ps: F.when(F.size(ps) > 0, F.array_join(F.transform(ps, lambda p: p["t"]), " "))))
    return F.concat_ws(" ", *parts)


_YAML_ESCAPES = (*_ESCAPES, ("\b", "\\b"), ("\0", "\\0"), *((chr(i), f"\\u{i:04x}") for i in range(1, 32) if chr(i) not in "\b\t\n\x0b\f\r"))
_AMBIGUOUS = r"(?i)(?:true|false|null|~|\.nan|[+-]?\.inf|[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?))"


def _yaml_quoted(x: Column) -> Column:
    text = F.when(x.rlike(r"[\x00-\x1F\"\\]"), _escaped(x, _YAML_ESCAPES)).otherwise(x)
    return F.concat(F.lit('"'), text, F.lit('"'))


def yaml_name(name: str) -> str:
    """A key as YAML: quoted if it isn't safe or could be read as another type."""
    if _SAFE_NAME.fullmatch(name) and not re.fullmatch(_AMBIGUOUS, name):
        return name
    for a, b in _YAML_ESCAPES:
        name = name.replace(a, b)
    return f'"{name}"'


def _yaml_name(key: Column) -> Column:
    safe = key.rlike(rf"\A{_SAFE_NAME.pattern}\z") & ~key.rlike(rf"\A{_AMBIGUOUS}\z")
    return F.when(safe, key).otherwise(_yaml_quoted(key))


def _yaml_value(value: Column, kind: T.DataType, level: int) -> Column:
    """What follows a key or a dash at ``level``: a scalar after a space, or lines."""
    none, pad = F.lit(" null"), "  " * (level + 1)
    if isinstance(kind, T.StructType):
        return F.when(value.isNull(), none).otherwise(F.concat(F.lit("\n"), _yaml_fields(list(kind), lambda f: value[f.name], level + 1)) if len(kind) else F.lit(" {}"))
    if isinstance(kind, T.ArrayType):
        lines = F.transform(value, lambda x: F.concat(F.lit(pad + "-"), _yaml_value(x, kind.elementType, level + 1)))
        return F.when(value.isNull(), none).when(F.size(value) == 0, " []").otherwise(F.concat(F.lit("\n"), F.array_join(lines, "\n")))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(F.encode(e["key"].cast("string"), "UTF-16BE").alias("o"), F.concat(F.lit(pad), _yaml_name(e["key"].cast("string")), F.lit(":"), _yaml_value(e["value"], kind.valueType, level + 1)).alias("t"))))
        return F.when(value.isNull(), none).when(F.size(value) == 0, " {}").otherwise(F.concat(F.lit("\n"), F.array_join(F.transform(entries, lambda e: e["t"]), "\n")))
    if isinstance(kind, T.VariantType):
        return variants.yaml(value, _yaml_name, _yaml_quoted, level)
    text = _scalar(value, kind)
    return F.coalesce(F.concat(F.lit(" "), text if _numeric(kind) else _yaml_quoted(text)), none)


def _yaml_fields(fields: list[T.StructField], get, level: int) -> Column:
    lines = []
    for f in sorted(fields, key=lambda f: _utf16(f.name)):
        lines.append(F.concat(F.lit("  " * level + yaml_name(f.name) + ":"), _yaml_value(get(f), f.dataType, level)))
    return F.concat_ws("\n", *lines)


def render_yaml(df: DataFrame) -> Column:
    """Of a table that was redacted: a YAML document a row, keys in UTF-16 order,
    strings always quoted. The template is made in the plan."""
    return F.concat(F.lit("---\n"), _yaml_fields(list(df.schema), lambda f: F.col(f"`{f.name}`"), 0))


def render(df: DataFrame, form: str = "plain", raw: bool = False, policy: str = "all", secret_names: list[str] | None = None, url_names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One string column ``rendered`` (after the columns ``keep``); ``form``: plain, yaml
    or json."""
    pairs = form not in ("json", "yaml") and _holds_variant(df.schema)
    safe = _with_pairs(df, raw, policy, secret_names, url_names) if pairs else redact(df, policy, secret_names, url_names)
    if form == "json":
        line = variants.json_numbers(F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]), {"ignoreNullFields": "false"}))
    else:
        line = render_yaml(safe) if form == "yaml" else render_plain(safe, raw)
    return safe.select(*(keep or []), line.alias("rendered"))


def write_lines(df: DataFrame, path: str, form: str = "json", **options) -> None:
    """A record a line (JSON, plain) or a document (YAML), redacted, as text files."""
    render(df, form, **options).write.text(path)


def lint_schema(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Findings about the types of columns whose names say what they hold, and about
    defaults of secret columns."""
    found = []

    def walk(kind: T.StructType, at: str) -> None:
        for f in kind:
            pointer = f"{at}/{lint.pointer_token(f.name)}"
            m = names.meaning(f.name)
            whole = isinstance(f.dataType, T.IntegralType) or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0)
            text = isinstance(f.dataType, T.StringType)
            of = m[1] if m else None
            wrong = (
                (of in (*lint.INTEGERS, "bytes") and not whole)
                or (of in lint.NUMBERS and not isinstance(f.dataType, T.NumericType))
                or (of in ("rfc3339", "epoch_ns") and not text)
                or (of in ("sats", "msats") and not (whole or text))
                or (any(names.ends_with(f.name, s) for s in names.STRICT) and not text)
                or (names.ends_with(f.name, "_url") and not _holds_only_text(f.dataType))
            )
            if wrong:
                found.append(("suffix_type_mismatch", "error", pointer, f"{f.name} can't be {f.dataType.simpleString()}"))
            if names.is_secret(f.name) and {"CURRENT_DEFAULT", "EXISTS_DEFAULT"} & set(f.metadata or {}):
                found.append(("secret_schema_value_exposed", "error", pointer, f"{f.name} has a default that anybody can read"))
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, pointer)

    walk(schema, "")
    return spark.createDataFrame(found, FINDING)


def lint_columns(df: DataFrame) -> DataFrame:
    """The findings of :func:`lint_schema` about a table's columns with ``rows``, how many
    rows have a value there: one aggregate over the columns in question alone."""
    spark = df.sparkSession
    found = lint_schema(spark, df.schema)
    plain = lambda token: token.replace("~1", "/").replace("~0", "~")
    pointers = sorted({r.pointer for r in found.select("pointer").collect()})  # as many as the schema has fields
    if not pointers:
        return found.withColumn("rows", F.lit(0).cast("long"))
    at = lambda p: F.col(".".join(f"`{plain(t)}`" for t in p.split("/")[1:]))
    counts = df.agg(*[F.count(at(p)).alias(f"c{i}") for i, p in enumerate(pointers)])
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("pointer"), F.col(f"c{i}").alias("rows")) for i, p in enumerate(pointers)])).alias("p")
    return found.join(counts.select(pairs).select("p.*"), "pointer").select(*found.columns, "rows")


def _holds_only_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_holds_only_text(f.dataType) for f in kind)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    return isinstance(kind, (T.StringType, T.VariantType)) if inner is None else _holds_only_text(inner)
