"""Registries of commands as tables, and what can be asked of calls.

``arguments``: command, argument, long (``--name``; null for a positional one), position
(from 0; null for a long one), type (``TYPES``), values (of an enum), least and most (of
an i64), default (a text), repeatable. ``combinations``: command, combination, required,
optional (arrays of argument names) and fixed (a map of argument to its allowed values);
each of a combination's arguments stands in one of the three. ``calls``: call, command,
and rest (the words after the command) or given (a map of argument to its values).

A registry is small beside its calls: it is gathered by command into arrays and maps,
and calls are joined with these rows, so that no call is shuffled where Spark broadcasts
the registry. All work on a call is one native expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import whole_json
from ..functions.urls import let

# Kinds of arguments, arguments that every command has, codes of errors.
TYPES = ("flag", "string", "enum", "i64", "f64", "uuid", "json")
CONTROL_FLAGS, CONTROL_VALUES = ("--help", "--version", "--docs"), ("--output", "--output-to", "--stdout-file", "--stderr-file")
UNKNOWN, MISSING, INVALID, TWICE, UNEXPECTED = "cli_unknown_argument", "cli_missing_argument_value", "cli_invalid_argument_value", "cli_duplicate_argument", "cli_unexpected_positional"
UNREGISTERED, AMBIGUOUS = "cli_unregistered_combination", "cli_ambiguous_combination"
# End of the fixed values.
ARGUMENT = "struct<argument:string,long:string,position:int,type:string,values:array<string>,least:bigint,most:bigint,default:string,repeatable:boolean>"
_FIELDS = ("argument", "long", "position", "type", "values", "least", "most", "default", "repeatable")
_STATE = f"struct<error:string,subject:string,ended:boolean,open:{ARGUMENT},next:int,values:array<struct<argument:string,value:string>>>"
_FLOAT = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_UUID = r"\A[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"
NO_FIXED = "map<string,array<string>>"


def _argument(row: dict[str, Column]) -> Column:
    return F.struct(*[row.get(f, F.lit(None)).alias(f) for f in _FIELDS]).cast(ARGUMENT)


def _by_command(arguments: DataFrame) -> DataFrame:
    """(_command, _longs, _positionals, _all): a command's arguments, gathered."""
    have = [f for f in _FIELDS if f in arguments.columns]
    each = arguments.select("command", _argument({f: F.col(f) for f in have}).alias("a"))
    longs = F.map_from_entries(F.collect_list(F.when(F.col("a.long").isNotNull(), F.struct(F.col("a.long").alias("key"), F.col("a").alias("value")))))
    places = F.transform(F.array_sort(F.collect_list(F.when(F.col("a.position").isNotNull(), F.struct(F.col("a.position").alias("i"), F.col("a").alias("a"))))), lambda x: x["a"])
    return each.groupBy(F.col("command").alias("_command")).agg(longs.alias("_longs"), places.alias("_positionals"), F.collect_list("a").alias("_all"))


def _fits(a: Column, value: Column) -> Column:
    """Whether a text is a value of the argument."""
    whole = F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("bigint"))
    fits = (
        F.when(a["type"] == "enum", F.array_contains(a["values"], value))
        .when(a["type"] == "i64", (whole >= F.coalesce(a["least"], whole)) & (whole <= F.coalesce(a["most"], whole)))
        .when(a["type"] == "f64", value.rlike(_FLOAT) & (F.abs(value.try_cast("double")) < float("inf")))
        .when(a["type"] == "uuid", value.rlike(_UUID))
        .when(a["type"] == "json", whole_json(value).isNotNull())
        .otherwise(True)
    )
    return F.coalesce(fits, F.lit(False))


def _takes_hyphen(a: Column, token: Column) -> Column:
    """Whether a word that begins with a hyphen is this argument's value: by its shape,
    before its range is looked at."""
    number = F.when(a["type"] == "i64", token.rlike(r"\A[+-]?[0-9]+\z") & token.try_cast("bigint").isNotNull()).when(a["type"] == "f64", token.rlike(_FLOAT))
    return F.coalesce(number.when(a["type"] == "json", whole_json(token).isNotNull()), F.lit(False))


def _state(s: Column, **changes: Column) -> Column:
    fields = ("error", "subject", "ended", "open", "next", "values")
    return F.struct(*[changes.get(f, s[f]).alias(f) for f in fields]).cast(_STATE)


def tokenize(calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """``calls`` with given (a map of argument to the array of its values; the controls
    that every command has stand under their own names, ``--help``), error and subject
    (the argument in error). One fold over the words; the first error stays. Values
    follow in the next word or after ``=``; after ``--`` all words are positional."""
    none, nothing = F.lit(None).cast(ARGUMENT), F.lit(None).cast("string")
    controls = [(n, _argument({"argument": F.lit(n), "long": F.lit(n), "type": F.lit(kind), "repeatable": F.lit(False)})) for names, kind in ((CONTROL_FLAGS, "flag"), (CONTROL_VALUES, "string")) for n in names]
    own_controls = F.create_map(*[x for n, a in controls for x in (F.lit(n), a)])

    def failed(s: Column, code: str, subject: Column) -> Column:
        return _state(s, error=F.lit(code), subject=subject)

    def pushed(s: Column, a: Column, value: Column, positional: bool = False) -> Column:
        again = ~F.coalesce(a["repeatable"], F.lit(False)) & F.exists(s["values"], lambda v: v["argument"] == a["argument"])
        name = F.coalesce(a["long"], a["argument"])
        step = F.when(F.lit(positional) & ~F.coalesce(a["repeatable"], F.lit(False)), s["next"] + 1).otherwise(s["next"])
        more = F.array_append(s["values"], F.struct(a["argument"].alias("argument"), value.alias("value")))
        return F.when(~_fits(a, value), failed(s, INVALID, name)).when(again, failed(s, TWICE, name)).otherwise(_state(s, open=none, next=step, values=more))

    def option(s: Column, token: Column, longs: Column) -> Column:
        name = F.substring_index(token, "=", 1)
        inline = F.when(F.contains(token, F.lit("=")), F.substr(token, F.length(name) + 2))

        def of(a: Column) -> Column:
            flag = a["type"] == "flag"
            return (
                F.when(a.isNull(), failed(s, UNKNOWN, name))
                .when(flag & inline.isNotNull(), failed(s, INVALID, name))
                .when(~flag & (inline == ""), failed(s, MISSING, name))
                .when(~flag & inline.isNull(), _state(s, open=a))
                .otherwise(pushed(s, a, F.coalesce(inline, F.lit("true"))))
            )

        return let(F.coalesce(F.try_element_at(longs, name), F.try_element_at(own_controls, name)), of)

    def positional(s: Column, token: Column, places: Column) -> Column:
        def of(a: Column) -> Column:
            hyphen = ~s["ended"] & token.startswith("-") & (token != "-") & ~F.coalesce(_takes_hyphen(a, token), F.lit(False))
            return F.when(hyphen, failed(s, UNKNOWN, token)).when(a.isNull(), failed(s, UNEXPECTED, token)).otherwise(pushed(s, a, token, positional=True))

        return let(F.get(places, s["next"]), of)

    def step(s: Column, token: Column) -> Column:
        waiting = s["open"].isNotNull()
        refused = waiting & token.startswith("-") & (token != "-") & ~_takes_hyphen(s["open"], token)
        return (
            F.when(s["error"].isNotNull(), s)
            .when(refused, failed(s, MISSING, s["open"]["long"]))
            .when(waiting, pushed(s, s["open"], token))
            .when(~s["ended"] & (token == "--"), _state(s, ended=F.lit(True)))
            .when(~s["ended"] & token.startswith("--"), option(s, token, F.col("_longs")))
            .otherwise(positional(s, token, F.col("_positionals")))
        )

    start = F.struct(nothing.alias("error"), nothing.alias("subject"), F.lit(False).alias("ended"), none.alias("open"), F.lit(0).alias("next"), F.array().cast("array<struct<argument:string,value:string>>").alias("values")).cast(_STATE)
    last = lambda s: F.when(s["error"].isNull() & s["open"].isNotNull(), failed(s, MISSING, s["open"]["long"])).otherwise(s)
    joined = calls.join(_by_command(arguments), F.col("command") == F.col("_command"), "left")
    out = joined.withColumn("_s", F.aggregate(F.col("rest"), start, step, last)).withColumn("_names", F.array_distinct(F.transform("_s.values", lambda v: v["argument"])))
    of = lambda n: F.transform(F.filter("_s.values", lambda v: v["argument"] == n), lambda v: v["value"])
    given = F.map_from_arrays("_names", F.transform("_names", of))
    return out.select(*[F.col(f"`{c}`") for c in calls.columns], F.when(F.col("_s.error").isNull(), given).alias("given"), F.col("_s.error").alias("error"), F.col("_s.subject").alias("subject"))


def _given(calls: DataFrame) -> DataFrame:
    """``given`` with arrays of values, without controls."""
    one = isinstance(calls.schema["given"].dataType.valueType, T.StringType)
    given = F.transform_values("given", lambda _, v: F.array(v)) if one else F.col("given")
    return calls.withColumn("given", F.map_filter(given, lambda k, _: ~k.isin(*CONTROL_FLAGS, *CONTROL_VALUES)))


def _combinations_by_command(combinations: DataFrame) -> DataFrame:
    one = F.struct("combination", F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.coalesce("optional", F.array().cast("array<string>")).alias("optional"), F.coalesce("fixed", F.create_map().cast(NO_FIXED)).alias("fixed"))
    return combinations.groupBy(F.col("command").alias("_of")).agg(F.collect_list(F.struct(F.col("combination").alias("o"), one.alias("c"))).alias("_combinations"))


def _allowed(c: Column) -> Column:
    return F.array_distinct(F.concat(c["required"], c["optional"], F.map_keys(c["fixed"])))


def match(calls: DataFrame, combinations: DataFrame, arguments: DataFrame | None = None) -> DataFrame:
    """(call, command, combination, error): the only combination that a call fits. What
    was given must be allowed and what is required given; a fixed argument has one of
    its values as given or, if it isn't, by its default. A call that is null or in error
    already fits none."""
    joined = _given(calls).join(_combinations_by_command(combinations), F.col("command") == F.col("_of"), "left")
    if arguments is None:
        joined = joined.withColumn("_all", F.array().cast(f"array<{ARGUMENT}>"))
    else:
        joined = joined.join(_by_command(arguments).select("_command", "_all"), F.col("command") == F.col("_command"), "left")
    names = F.map_keys("given")

    def fits(c: Column) -> Column:
        default = lambda k: F.get(F.filter("_all", lambda a: a["argument"] == k), F.lit(0))["default"]
        value = lambda k: F.coalesce(F.get(F.try_element_at("given", k), F.lit(0)), default(k))
        held = F.forall(F.map_entries(c["fixed"]), lambda e: F.coalesce(F.array_contains(e["value"], value(e["key"])), F.lit(False)))
        return F.coalesce((F.size(F.array_except(names, _allowed(c))) == 0) & (F.size(F.array_except(c["required"], names)) == 0) & held, F.lit(False))

    found = joined.withColumn("_fit", F.transform(F.filter("_combinations", lambda x: fits(x["c"])), lambda x: x["o"]))
    n = F.when(F.col("given").isNull() | F.col("_fit").isNull(), 0).otherwise(F.size("_fit"))
    error = F.when(n == 0, UNREGISTERED).when(n > 1, AMBIGUOUS)
    error = F.coalesce("error", error) if "error" in calls.columns else error
    return found.select("call", "command", F.when(n == 1, F.get("_fit", F.lit(0))).alias("combination"), error.alias("error"))


def select_command(argv: DataFrame, commands: DataFrame) -> DataFrame:
    """(call, command, rest): of the commands whose words begin ``argv``, the longest; null
    if none does. Joined by the words of each length that commands have."""
    words = commands.select(F.col("command").alias("_command"), F.split("command", " ").alias("_words"))
    lengths = sorted(r[0] for r in words.select(F.size("_words")).distinct().collect())  # a few small integers
    starts = F.explode_outer(F.filter(F.array(*[F.when(F.size("argv") >= n, F.slice("argv", 1, n)) for n in lengths]), lambda x: x.isNotNull()))
    tried = argv.select("call", "argv", starts.alias("_words")).join(words, "_words", "left")
    best = tried.groupBy("call", "argv").agg(F.max_by(F.struct("_command", F.size("_words").alias("n")), F.when(F.col("_command").isNotNull(), F.size("_words"))).alias("_b"))
    rest = F.slice("argv", F.coalesce("_b.n", F.lit(0)) + 1, F.greatest(F.size("argv"), F.lit(1)))
    return best.select("call", F.col("_b._command").alias("command"), rest.alias("rest"))


def project(calls: DataFrame, arguments: DataFrame, combinations: DataFrame | None = None) -> DataFrame:
    """(call, command, argument, values): every argument that a call's combination allows
    (of its command, without ``combinations``): as given, else its default, else
    ``false`` for a flag; those without a value give no row."""
    rows = _given(calls).join(_by_command(arguments).select("_command", "_all"), F.col("command") == F.col("_command"))
    wanted = F.lit(True)
    if combinations is not None:
        allowed = combinations.select(F.col("command").alias("_of"), F.col("combination").alias("_which"), _allowed(F.struct(F.coalesce("required", F.array()).alias("required"), F.coalesce("optional", F.array()).alias("optional"), F.coalesce("fixed", F.create_map().cast(NO_FIXED)).alias("fixed"))).alias("_allowed"))
        rows = rows.join(allowed, (F.col("command") == F.col("_of")) & (F.col("combination") == F.col("_which")))
        wanted = F.array_contains("_allowed", F.col("_a.argument"))
    each = rows.select("*", F.explode("_all").alias("_a")).where(wanted)
    values = F.coalesce(F.try_element_at("given", F.col("_a.argument")), F.when(F.col("_a.default").isNotNull(), F.array("_a.default")), F.when(F.col("_a.type") == "flag", F.array(F.lit("false"))))
    return each.select("call", "command", F.col("_a.argument").alias("argument"), values.alias("values")).where("values is not null")


def _with_arguments(combinations: DataFrame, arguments: DataFrame | None) -> DataFrame:
    """Combinations with _all, their command's arguments; without a table of these, all
    that any combination of the command names, without defaults."""
    if arguments is not None:
        return combinations.join(_by_command(arguments).select("_command", "_all"), F.col("command") == F.col("_command"), "left").drop("_command")
    named = combinations.select("command", F.explode(F.concat("required", "optional", F.map_keys("fixed"))).alias("argument")).distinct()
    return combinations.join(_by_command(named).select("_command", "_all"), F.col("command") == F.col("_command"), "left").drop("_command")


def overlaps(combinations: DataFrame, arguments: DataFrame | None = None) -> DataFrame:
    """(command, combination, other): pairs of combinations of one command that some call
    fits both of: every argument may be left out in both, or be given in both with a
    value in common. A fixed argument may be left out if its default is among its values."""

    def states(all_: Column, c: Column) -> Column:
        def one(a: Column) -> Column:
            fixed = F.try_element_at(c["fixed"], a["argument"])
            required, optional = F.array_contains(c["required"], a["argument"]), F.array_contains(c["optional"], a["argument"])
            absent = F.when(fixed.isNotNull(), F.coalesce(F.array_contains(fixed, a["default"]), F.lit(False))).otherwise(~required)
            return F.struct(absent.alias("absent"), (fixed.isNotNull() | required | optional).alias("explicit"), fixed.alias("values"))

        return F.transform(all_, one)

    side = lambda s: _with_arguments(combinations, arguments).select("command", F.col("combination").alias(s), states(F.col("_all"), F.struct("required", "optional", "fixed")).alias(f"{s}_states"))
    pairs = side("left").join(side("right"), "command").where("left < right")
    common = lambda x, y: F.when(x["values"].isNull() | y["values"].isNull(), True).otherwise(F.arrays_overlap(x["values"], y["values"]))
    agree = F.forall(F.arrays_zip(F.col("left_states").alias("x"), F.col("right_states").alias("y")), lambda p: (p["x"]["absent"] & p["y"]["absent"]) | (p["x"]["explicit"] & p["y"]["explicit"] & common(p["x"], p["y"])))
    return pairs.where(agree).select("command", F.col("left").alias("combination"), F.col("right").alias("other"))


def synthetic_calls(combinations: DataFrame, arguments: DataFrame) -> DataFrame:
    """(command, combination, variant, argv): a call for every choice of fixed values, with
    a value of the right kind for what is required. The choices of a combination are
    numbered 0 to their product - 1 and each number is read digit by digit, so they
    spread over tasks without a join of values with values."""
    value = F.when(F.col("a.type") == "i64", F.coalesce(F.col("a.least").cast("string"), F.lit("1"))).when(F.col("a.type") == "enum", F.get("a.values", F.lit(0)))
    for kind, sample in (("string", "value"), ("uuid", "00000000-0000-0000-0000-000000000000"), ("f64", "1.5"), ("json", "{}"), ("flag", "")):
        value = value.when(F.col("a.type") == kind, sample)
    named = F.posexplode("_all").alias("_at", "a")
    rows = _with_arguments(combinations, arguments).select("command", "combination", "required", "fixed", named)
    choices = F.coalesce(F.try_element_at("fixed", F.col("a.argument")), F.when(F.array_contains("required", F.col("a.argument")), F.array(value)))
    order = F.when(F.col("a.position").isNull(), -1).otherwise(F.col("a.position"))
    one = F.struct(order.alias("o"), F.col("a.argument").alias("argument"), F.col("a.long").alias("long"), F.col("a.type").alias("type"), choices.alias("choices"))
    gathered = rows.groupBy("command", "combination").agg(F.array_sort(F.collect_list(F.when(choices.isNotNull(), one))).alias("_parts"))
    product = F.aggregate("_parts", F.lit(1).cast("long"), lambda n, p: n * F.size(p["choices"]))
    numbered = gathered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), product - 1)).alias("variant")).where(product > 0)

    def word(s: Column, p: Column) -> Column:
        n = F.size(p["choices"]).cast("long")
        chosen = F.get(p["choices"], (s["left"] % n).cast("int"))
        words = F.when(p["long"].isNull(), F.array(chosen)).when(p["type"] == "flag", F.array(p["long"])).otherwise(F.array(p["long"], chosen))
        return F.struct(F.floor(s["left"] / n).cast("long").alias("left"), F.concat(s["argv"], words).alias("argv"))

    start = F.struct(F.col("variant").alias("left"), F.split("command", " ").alias("argv"))
    return numbered.select("command", "combination", "variant", F.aggregate("_parts", start, word, lambda s: s["argv"]).alias("argv"))


def violations(commands: DataFrame, arguments: DataFrame, combinations: DataFrame) -> DataFrame:
    """(rule, command, subject): what is wrong with a registry itself. Every rule is a
    row of its own; a command, argument or combination may break several."""
    found: list[DataFrame] = []

    def rule(name: str, rows: DataFrame, subject: str | Column) -> None:
        found.append(rows.select(F.lit(name).alias("rule"), "command", (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject")))

    def twice(name: str, rows: DataFrame, keys: list[str], subject: str) -> None:
        rule(name, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), subject)

    words = F.split("command", " ")
    rule("invalid_command_path", commands.where(F.exists(words, lambda w: (w == "") | w.startswith("-"))), "command")
    twice("duplicate_command_path", commands, ["command"], "command")
    rule("command_without_combination", commands.join(combinations, "command", "left_anti"), "command")
    rule("argument_of_unknown_command", arguments.join(commands, "command", "left_anti"), "argument")
    rule("combination_of_unknown_command", combinations.join(commands, "command", "left_anti"), "combination")

    a = arguments.select("command", _argument({f: F.col(f) for f in _FIELDS if f in arguments.columns}).alias("a")).select("command", "a", "a.*")
    own, here = F.col("a"), F.col
    is_long = here("long").isNotNull()
    simple = [
        ("invalid_argument_id", ~here("argument").rlike(r"\A[a-z][a-z0-9]*(?:_[a-z0-9]+)*\z")),
        ("reserved_long_argument", here("long").isin(*CONTROL_FLAGS, *CONTROL_VALUES)),
        ("invalid_long_argument", is_long & (~here("long").rlike(r"\A--[a-z][a-z0-9]*(?:-[a-z0-9]+)*\z") | (F.translate(F.substring(here("long"), 3, 1 << 30), "-", "_") != here("argument")))),
        ("long_or_positional", is_long == here("position").isNotNull()),
        ("unknown_type", ~here("type").isin(*TYPES) | here("type").isNull()),
        ("flag_default", (here("type") == "flag") & here("default").isNotNull()),
        ("repeatable_flag", (here("type") == "flag") & here("repeatable")),
        ("json_default", (here("type") == "json") & here("default").isNotNull()),
        ("empty_enum", (here("type") == "enum") & (F.coalesce(F.size("values"), F.lit(0)) <= 0)),
        ("duplicate_enum_value", F.size(F.array_distinct("values")) < F.size("values")),
        ("enum_values_on_non_enum", (here("type") != "enum") & (F.size("values") > 0)),
        ("range_on_non_integer", (here("type") != "i64") & (here("least").isNotNull() | here("most").isNotNull())),
        ("invalid_range", here("least") > here("most")),
        ("invalid_default", here("default").isNotNull() & ~here("type").isin("flag", "json") & ~_fits(own, here("default"))),
    ]
    for name, test in simple:
        rule(name, a.where(F.coalesce(test, F.lit(False))), "argument")
    twice("duplicate_argument_id", a, ["command", "argument"], "argument")
    twice("duplicate_long_argument", a.where(is_long), ["command", "long"], "long")
    twice("duplicate_positional_index", a.where("position is not null"), ["command", "position"], "position")
    places = a.where("position is not null").groupBy("command").agg(F.min("position").alias("_low"), F.max("position").alias("_high"), F.countDistinct("position").alias("_n"))
    rule("non_contiguous_positionals", places.where("_low <> 0 or _high <> _n - 1"), "command")
    parents = commands.select("command", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("_parent")).where("_parent <> command")
    rule("positional_with_subcommands", parents.select(F.col("_parent").alias("command")).distinct().join(places, "command", "left_semi"), "command")

    c = combinations.select("command", "combination", *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in ("required", "optional")], F.coalesce("fixed", F.create_map().cast(NO_FIXED)).alias("fixed"))
    names = F.concat("required", "optional", F.map_keys("fixed"))
    twice("duplicate_combination_id", c, ["command", "combination"], "combination")
    rule("combination_partition", c.where(F.size(F.array_distinct(names)) < F.size(names)), "combination")
    used = c.select("command", "combination", "required", "fixed", F.explode(F.array_distinct(names)).alias("argument"))
    rule("unknown_combination_argument", used.join(a, ["command", "argument"], "left_anti"), F.concat_ws(".", "combination", "argument"))
    rule("uncovered_argument", a.join(used, ["command", "argument"], "left_anti"), "argument")
    known = used.join(a, ["command", "argument"])
    where = F.concat_ws(".", "combination", "argument")
    fixed = F.try_element_at("fixed", F.col("argument"))
    rule("required_argument_default", known.where(F.array_contains("required", F.col("argument")) & here("default").isNotNull()), where)
    rule("invalid_fixed_argument", known.where(fixed.isNotNull() & ((here("type") != "enum") | F.coalesce(here("repeatable"), F.lit(False)))), where)
    rule("invalid_fixed_value", known.where(fixed.isNotNull() & (here("type") == "enum") & ((F.size(fixed) == 0) | (F.size(F.array_except(fixed, "values")) > 0))), where)
    taken = known.where("position is not null").groupBy("command", "combination").agg(F.max("position").alias("_high"), F.countDistinct("position").alias("_n"))
    rule("positional_not_prefix", taken.where("_high <> _n - 1"), "combination")
    rule("overlapping_combinations", overlaps(c, a.select("command", *_FIELDS)), F.concat_ws(",", "combination", "other"))
    return reduce(DataFrame.union, found)


def unbound(combinations: DataFrame, actions: DataFrame) -> DataFrame:
    """(command, combination, error): combinations without an action, and actions without a
    combination."""
    a = actions.select("command", "combination", F.lit(True).alias("_action"))
    c = combinations.select("command", "combination", F.lit(True).alias("_known"))
    error = F.when(F.col("_action").isNull(), "action_missing").when(F.col("_known").isNull(), "action_unknown")
    return c.join(a, ["command", "combination"], "full").select("command", "combination", error.alias("error")).where("error is not null")
