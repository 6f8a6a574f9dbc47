"""Lint of a table's values: a row for each finding.

Names are looked at while the plan is built, so each leaf of the schema has only
the tests that its name and type call for, and leaves without a test cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, urls, validators, variants

# Names that call for a suffix, by category; the largest safe integer.
STEMS = {
    "duration": ("timeout", "elapsed", "duration", "ttl", "interval", "latency", "delay", "uptime"),
    "currency": ("price", "amount", "cost", "fee", "balance", "subtotal", "revenue"),
    "timestamp": ("created", "updated", "modified", "expires", "issued", "timestamp"),
    "sensitive": ("apikey", "api_key", "token", "password", "passwd", "secret", "credential", "credentials"),
}
MAX_SAFE_INTEGER = 2**53 - 1
# End of the fixed values.

INTEGERS = {"epoch_ms", "epoch_s", "usd_cents", "eur_cents", "jpy", "cents", "micro"}
NUMBERS = {"ns", "us", "ms", "s", "minutes", "hours", "days", "percent"}
STRICT = {"_rfc3339_date": validators.is_rfc3339_date, "_rfc3339_time": validators.is_rfc3339_time, "_bcp47": validators.is_bcp47, "_utc_offset": lambda x: validators.normalize_utc_offset(x).isNotNull()}
SEVERITIES = ("warning", "error")


def pointer_token(name: str) -> str:
    """A name as a token of a JSON pointer."""
    return name.replace("~", "~0").replace("/", "~1")


def has_registered_suffix(name: str) -> bool:
    """Whether a name says what its value is."""
    return names.meaning(name) is not None or any(names.ends_with(name, s) for s in (*names.STRICT, "_secret", "_url"))


def category_of(name: str) -> str | None:
    """What a name without a suffix seems to be."""
    low = name.lower()
    if low.endswith("_at"):
        return "timestamp"
    return next((c for c, stems in STEMS.items() for s in stems if low == s or low.endswith("_" + s)), None)


def whole(value: Column, kind: T.DataType) -> Column | None:
    """Whether a number is whole; None if the type isn't a number's."""
    if isinstance(kind, T.IntegralType):
        return F.lit(True)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce((F.abs(value) >= 2.0**53) & (F.abs(value) < float("inf")) | (value == F.floor(value)), F.lit(False))
    if isinstance(kind, T.DecimalType):
        return value == F.floor(value)
    return None


def exact_integer(text: Column) -> Column:
    """Whether a number's literal is an integer, exponent included: ``1.50e1`` is, ``1.5`` isn't."""
    shape = r"\A-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?\z"
    whole_part, part, power = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    digits = F.regexp_replace(F.concat(whole_part, part), r"\A0+", "")
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, r"0+\z", ""))
    scale = F.when(power == "", F.lit(0).cast("decimal(38,0)")).otherwise(F.coalesce(power.try_cast("decimal(38,0)"), F.when(power.startswith("-"), "-1" + "0" * 37).otherwise("1" + "0" * 37).cast("decimal(38,0)"))) - F.length(part)
    return F.coalesce(text.rlike(shape) & ((digits == "") | (scale + zeros >= 0)), F.lit(False))


def wrong_type(name: str, value: Column, kind: T.DataType) -> Column | None:
    """Whether a value isn't what its name's suffix says; None: the name says nothing."""
    is_text, is_number = isinstance(kind, T.StringType), isinstance(kind, T.NumericType)
    never, always = F.lit(False), F.lit(True)
    for suffix, test in STRICT.items():
        if names.ends_with(name, suffix):
            return ~test(value) if is_text else always
    if names.ends_with(name, "_url"):
        if isinstance(kind, T.VariantType):
            return F.exists(variants.url_leaves(value), lambda y: F.when(y.isNull(), True).otherwise(~urls.is_url_field(y)))
        if isinstance(kind, T.ArrayType):
            inner = wrong_type(name, F.lit(None).cast(kind.elementType), kind.elementType)
            return None if inner is None else F.exists(value, lambda x: x.isNotNull() & wrong_type(name, x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.exists(F.map_values(value), lambda x: x.isNotNull() & wrong_type(name, x, kind.valueType))
        if isinstance(kind, T.StructType):
            tests = [value[f.name].isNotNull() & wrong_type("_url", value[f.name], f.dataType) for f in kind]
            return F.greatest(*tests, never, never) if tests else never
        return ~urls.is_url_field(value) if is_text else always
    m = names.meaning(name)
    if m is None or m[1] == "secret":
        return None
    integer = whole(value, kind)
    decimal = F.coalesce(value.rlike(r"\A-?[0-9]+\z"), never) if is_text else never
    if m[1] == "bytes":
        return always if integer is None else ~(integer & (value >= 0))
    if m[1] in INTEGERS:
        return always if integer is None else ~integer
    if m[1] in NUMBERS:
        return never if is_number else always
    if m[1] == "epoch_ns":
        return ~decimal
    if m[1] in ("sats", "msats"):
        return ~decimal if integer is None else ~integer
    return ~validators.is_rfc3339(value) if is_text else always  # rfc3339


def _finding(test: Column, rule: str, severity: str, pointer: Column, message: str) -> Column:
    return F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), pointer.alias("pointer"), F.lit(message).alias("message")))


def _tests(name: str, value: Column, kind: T.DataType, pointer: Column) -> list[Column]:
    """Findings (or null) of one field."""
    out, there = [], value.isNotNull()
    wrong = wrong_type(name, value, kind)
    if wrong is not None:
        out.append(_finding(there & wrong, "suffix_type_mismatch", "error", pointer, f"{name} doesn't hold what its suffix says"))
    category = None if has_registered_suffix(name) else category_of(name)
    is_text, is_number = isinstance(kind, T.StringType), isinstance(kind, T.NumericType)
    if category and (is_number if category in ("duration", "currency") else is_text or (is_number and category == "timestamp")):
        out.append(_finding(there, "missing_suffix", "warning", pointer, f"{name} names a {category} without a suffix that says so"))
    return out


def _walk(value: Column, kind: T.DataType, pointer: Column) -> list[Column]:
    """Arrays of findings below a value."""
    out = []
    if isinstance(kind, T.StructType):
        for f in kind:
            at = F.concat(pointer, F.lit("/" + pointer_token(f.name)))
            own = _tests(f.name, value[f.name], f.dataType, at)
            if own:
                out.append(F.array(*own))
            out += _walk(value[f.name], f.dataType, at)
    elif isinstance(kind, T.ArrayType):
        at = lambda i: F.concat(pointer, F.lit("/"), i.cast("string"))
        if _walk(F.lit(None).cast(kind.elementType), kind.elementType, F.lit("")):
            out.append(F.coalesce(F.flatten(F.transform(value, lambda x, i: F.concat(*_walk(x, kind.elementType, at(i))))), F.array()))
    elif isinstance(kind, T.VariantType):
        out.append(F.coalesce(lint_variant(value, pointer), F.array()))
    elif isinstance(kind, T.LongType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        out.append(F.array(_finding(F.abs(value.cast("decimal(38,0)")) > MAX_SAFE_INTEGER, "unsafe_integer", "error", pointer, "an integer beyond 2^53 - 1")))
    return out


_FINDING = "struct<rule_id:string,severity:string,pointer:string,message:string>"
_NODE = "array<struct<pointer:string,key:string,value:variant>>"


def _nodes(v: Column, pointer: Column, deepest: int) -> Column:
    """(pointer, key, value) of all that is below a VARIANT value; ``key`` is null in arrays."""

    def level(at: Column, entries: Column, left: int) -> Column:
        def one(e: Column, i: Column) -> Column:
            token = F.coalesce(F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), i.cast("string"))
            here = F.concat(at, F.lit("/"), token)
            own = F.array(F.struct(here.alias("pointer"), e["key"].alias("key"), e["value"].alias("value"))).cast(_NODE)
            if not left:
                return own
            return F.concat(own, F.coalesce(level(here, variants.entries(e["value"]), left - 1), F.array().cast(_NODE)))

        return F.flatten(F.transform(entries, one))

    return F.coalesce(level(pointer, variants.entries(v), deepest), F.array().cast(_NODE))


def _ends(name: Column, suffix: str) -> Column:
    return name.endswith(suffix) | name.endswith(suffix.upper())


def _kind_by_name(name: Column) -> Column:
    """The suffix that says what a value is, without its underscore; null: none does.
    The same order as :func:`names.meaning` has."""
    coded = F.regexp_extract(name, r"(?s)\A.+_[A-Za-z]{3,4}_(cents|CENTS|micro|MICRO)\z", 1)
    order = [(_ends(name, s), F.lit(s[1:])) for s in (*STRICT, "_url", *names.TIMESTAMPS, *names.CURRENCIES)]
    order += [(coded != "", F.lower(coded)), *((_ends(name, s), F.lit(s[1:])) for s in (*names.NAMED, *names.UNITS, *names.SHORT))]
    out = None
    for test, kind in order:
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _category_by_name(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.endswith("_at"), "timestamp")
    for category, stems in STEMS.items():
        out = out.when(low.rlike(rf"(?:\A|_)(?:{'|'.join(stems)})\z"), category)
    return out


def lint_variant(v: Column, pointer: Column | str = "", deepest: int = variants.DEEPEST) -> Column:
    """An array of findings (rule_id, severity, pointer, message) on all that is in a
    VARIANT value, by the names of its keys, ``deepest`` levels down. Null is never one."""
    pointer = F.lit(pointer) if isinstance(pointer, str) else pointer

    def typed(n: Column) -> Column:
        x, t = n["value"], F.schema_of_variant(n["value"])
        return F.struct(
            n["pointer"].alias("pointer"),
            n["key"].alias("key"),
            x.alias("x"),
            _kind_by_name(n["key"]).alias("kind"),
            F.when(t == "STRING", F.try_variant_get(x, "$", "string")).alias("text"),
            F.when((t == "BIGINT") | t.startswith("DECIMAL") | (t == "DOUBLE"), F.try_variant_get(x, "$", "double")).alias("number"),
            ((t == "BIGINT") | t.rlike(r"\ADECIMAL\([0-9]+,0\)\z")).alias("exact"),
        )

    def wrong(n: Column) -> Column:
        yes = lambda test: F.coalesce(test, F.lit(False))
        text, number, kind = n["text"], n["number"], n["kind"]
        whole = yes(n["exact"] | (F.abs(number) >= 2.0**53) | (number == F.floor(number)))
        decimal = yes(text.rlike(r"\A-?[0-9]+\z"))
        leaf_texts = variants.url_leaves(n["x"], deepest)
        out = F.when(kind == "secret", False)
        for suffix, test in STRICT.items():
            out = out.when(kind == suffix[1:], ~yes(test(text)))
        out = out.when(kind == "url", F.exists(leaf_texts, lambda y: F.when(y.isNull(), True).otherwise(~urls.is_url_field(y))))
        out = out.when(kind == "bytes", ~(whole & (number >= 0))).when(kind.isin(*INTEGERS), ~whole).when(kind.isin(*NUMBERS), number.isNull())
        out = out.when(kind == "epoch_ns", ~decimal).when(kind.isin("sats", "msats"), F.when(number.isNull(), ~decimal).otherwise(~whole))
        return yes(out.when(kind == "rfc3339", ~yes(validators.is_rfc3339(text))))

    def found(n: Column) -> Column:
        there = ~F.is_variant_null(n["x"])
        category = F.when(n["kind"].isNull(), _category_by_name(n["key"]))
        lacks = F.when(category.isin("duration", "currency"), n["number"].isNotNull()).when(category == "timestamp", n["number"].isNotNull() | n["text"].isNotNull()).when(category == "sensitive", n["text"].isNotNull())
        unsafe = n["exact"] & (F.abs(F.try_variant_get(n["x"], "$", "decimal(38,0)")) > MAX_SAFE_INTEGER)
        one = lambda test, rule, severity, message: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), n["pointer"].alias("pointer"), message.alias("message")))
        return F.array(
            one(there & wrong(n), "suffix_type_mismatch", "error", F.concat(n["key"], F.lit(" doesn't hold what its suffix says"))),
            one(there & lacks, "missing_suffix", "warning", F.concat(n["key"], F.lit(" names a "), category, F.lit(" without a suffix that says so"))),
            one(unsafe, "unsafe_integer", "error", F.lit("an integer beyond 2^53 - 1")),
        )

    every = F.flatten(F.transform(F.transform(_nodes(v, pointer, deepest), typed), found)).cast(f"array<{_FINDING}>")
    return F.filter(every, lambda f: f.isNotNull())


#: What a property's schema must allow, by the kind that its name tells.
_INTEGER, _NUMBER, _TEXT, _EITHER = ["integer"], ["integer", "number"], ["string"], ["integer", "string"]
#: Levels of alternatives within alternatives that are looked at.
ALTERNATIVES = 4


def _expected(kind: Column) -> Column:
    """The JSON types of which a schema must allow one; null: any will do."""
    texts = lambda xs: F.array(*map(F.lit, xs))
    out = F.when(kind.isin(*INTEGERS, "bytes"), texts(_INTEGER)).when(kind.isin(*NUMBERS), texts(_NUMBER))
    strict = [s[1:] for s in STRICT]
    return out.when(kind.isin("sats", "msats"), texts(_EITHER)).when(kind.isin("epoch_ns", "rfc3339", "url", *strict), texts(_TEXT))


def _allows(schema: Column, types: Column, left: int = ALTERNATIVES) -> Column:
    """Whether a schema allows one of the types: by its ``type``, else by any of its
    ``anyOf`` or ``oneOf``, else by all of its ``allOf``; one that says nothing does."""
    of = lambda k, t: F.try_variant_get(schema, f"$.{k}", t)
    several = of("type", "array<string>")
    said = F.when(several.isNotNull(), F.arrays_overlap(several, types)).when(F.schema_of_variant(of("type", "variant")) == "STRING", F.array_contains(types, of("type", "string")))
    if not left:
        return F.coalesce(said, F.lit(True))
    some = F.coalesce(of("anyOf", "array<variant>"), of("oneOf", "array<variant>"))
    branches = F.transform(F.coalesce(some, of("allOf", "array<variant>")), lambda b: _allows(b, types, left - 1))
    by_branches = urls.let(branches, lambda r: F.when(some.isNotNull(), F.exists(r, lambda x: x)).otherwise(F.forall(r, lambda x: x)))
    return F.coalesce(F.when(of("type", "variant").isNotNull(), F.coalesce(said, F.lit(True))).otherwise(by_branches), F.lit(True))


def lint_json_schema(v: Column, deepest: int = variants.DEEPEST) -> Column:
    """An array of findings on a JSON Schema held as VARIANT: properties, at any place,
    whose types their names rule out, and defaults or examples of secret ones."""

    def properties(n: Column) -> Column:
        inside = F.when((n["key"] == "properties") & F.coalesce(variants.as_object(n["value"]).isNotNull(), F.lit(False)), F.map_entries(variants.as_object(n["value"])))
        token = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        return F.transform(inside, lambda e: F.struct(F.concat(n["pointer"], F.lit("/"), token(e["key"])).alias("pointer"), e["key"].alias("key"), e["value"].alias("value"), _kind_by_name(e["key"]).alias("kind")))

    def found(p: Column) -> Column:
        one = lambda test, rule, at, message: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit("error").alias("severity"), F.concat(p["pointer"], at).alias("pointer"), message.alias("message")))
        is_object = variants.as_object(p["value"]).isNotNull()
        types = _expected(p["kind"])
        wrong = is_object & types.isNotNull() & ~_allows(p["value"], types)
        shown = lambda x: x.isNotNull() & ~F.is_variant_null(x) & ~F.coalesce((F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") == urls.MARK), F.lit(False))
        secret = is_object & (p["kind"] == "secret")
        at = lambda k: F.try_variant_get(p["value"], f"$.{k}", "variant")
        says = lambda what: F.concat(p["key"], F.lit(f" has a {what} that anybody can read"))
        examples = F.transform(F.try_variant_get(p["value"], "$.examples", "array<variant>"), lambda x, i: one(secret & shown(x), "secret_schema_value_exposed", F.concat(F.lit("/examples/"), i.cast("string")), says("example")))
        own = F.array(
            *[one(secret & shown(at(k)), "secret_schema_value_exposed", F.lit(f"/{k}"), says(k)) for k in ("default", "example")],
            one(wrong, "suffix_type_mismatch", F.lit("/type"), F.concat(p["key"], F.lit(" doesn't allow what its suffix says"))),
        )
        return F.concat(own.cast(f"array<{_FINDING}>"), F.coalesce(examples, F.array()).cast(f"array<{_FINDING}>"))

    root = F.array(F.struct(F.lit("").alias("pointer"), F.lit(None).cast("string").alias("key"), v.alias("value"))).cast(_NODE)
    nodes = F.concat(root, _nodes(v, F.lit(""), deepest))
    every = F.flatten(F.transform(F.flatten(F.filter(F.transform(nodes, properties), lambda x: x.isNotNull())), found))
    return F.filter(every, lambda f: f.isNotNull())


def lint_values(df: DataFrame, keep: list[str], least: str = "warning") -> DataFrame:
    """(keep, rule_id, severity, pointer, message): what the table's values break;
    ``least``: warning or error. Null is never a finding."""
    found = _walk(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, F.lit(""))
    kind = "array<struct<rule_id:string,severity:string,pointer:string,message:string>>"
    every = F.concat(*[x.cast(kind) for x in found]) if found else F.array().cast(kind)
    wanted = SEVERITIES[SEVERITIES.index(least) :]
    rows = df.select(*keep, F.explode(F.filter(every, lambda x: x.isNotNull() & x["severity"].isin(*wanted))).alias("_f"))
    return rows.select(*keep, "_f.rule_id", "_f.severity", "_f.pointer", "_f.message")


def assert_clean(df: DataFrame, least: str = "warning") -> None:
    """An error that names the first findings, if there are any."""
    found = lint_values(df, [], least).head(5)
    if found:
        raise AssertionError("; ".join(f"{f.rule_id} at {f.pointer}" for f in found))


# What a letter after a backslash stands for.
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
# End of the fixed values.
_UNIT = r"\\u[0-9A-Fa-f]{4}"
_ESCAPE = rf"(?:\\u[dD][89abAB][0-9A-Fa-f]{{2}}\\u[dD][c-fC-F][0-9A-Fa-f]{{2}})|{_UNIT}|\\x[0-9A-Fa-f]{{2}}|(?s:\\.)|(?:%[0-9A-Fa-f]{{2}})+"


def decoded(text: Column) -> Column:
    """An output without its escapes: backslashes, ``\\uXXXX`` also in pairs, and percent
    signs, whatever their order, in one pass from the left."""
    code = lambda t, at: F.conv(F.substring(t, at, 4), 16, 10).cast("int")

    def one(t: Column) -> Column:
        pair = F.lit(0x10000) + (code(t, 3) - 0xD800) * 0x400 + (code(t, 9) - 0xDC00)
        # A character by its number, as UTF-32.
        by_number = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        letter = F.substring(t, 2, 1)
        named = F.element_at(F.create_map(*[F.lit(x) for p in _ESCAPED.items() for x in p]), letter)
        return (
            F.when(t.startswith("%"), F.decode(F.unhex(F.replace(t, F.lit("%"), F.lit(""))), "UTF-8"))
            .when(F.length(t) == 12, by_number(pair))
            .when(t.rlike(rf"\A{_UNIT}\z"), F.when(code(t, 3).between(0xD800, 0xDFFF), "\ufffd").otherwise(by_number(code(t, 3))))
            .when(F.length(t) == 4, by_number(F.conv(F.substring(t, 3, 2), 16, 10).cast("int")))
            .otherwise(F.coalesce(named, letter))
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(_ESCAPE), F.lit(0)), one)
    joined = F.transform(F.arrays_zip(F.split(text, _ESCAPE, -1).alias("t"), found.alias("u")), lambda p: F.concat(p["t"], F.coalesce(p["u"], F.lit(""))))
    return F.when(text.rlike(r"[\\%]"), F.array_join(joined, "")).otherwise(text)


def leaks(text: Column, canary: str) -> Column:
    """Whether an output holds a planted secret, as it is or behind escapes. An empty
    secret can't be looked for."""
    if canary == "":
        raise ValueError("the planted secret must not be empty")
    once = decoded(text)
    bare = F.regexp_replace(text, r"(?s)\\(.)", "$1")
    return F.contains(text, F.lit(canary)) | F.contains(bare, F.lit(canary)) | F.contains(once, F.lit(canary)) | F.contains(decoded(once), F.lit(canary))
