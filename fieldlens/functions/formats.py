"""Values for people, by the kind of their field. Each function returns a string,
or null where the value doesn't fit the kind (the raw value is shown then)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import names

WHOLE = T.DecimalType(20, 0)
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def integer(x: Column, kind: T.DataType) -> Column:
    """The value as a long if it is whole, else null."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return x.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when((x == F.floor(x)) & (x >= -(2.0**63)) & (x < 2.0**63), x.cast("long"))
    if isinstance(kind, T.DecimalType):
        return F.when(x == F.floor(x), x.try_cast("long"))
    return F.lit(None).cast("long")


def _whole_text(x: Column) -> Column:
    """All digits of a whole double below 1e21: two halves that are exact as longs."""
    unit = float(2**40)
    high = F.floor(x / unit).cast("decimal(38,0)")
    low = (x - F.floor(x / unit).cast("double") * unit).cast("long").cast("decimal(38,0)")
    return (high * F.lit(2**40).cast("decimal(16,0)") + low).cast("decimal(38,0)").cast("string")


def number(x: Column, kind: T.DataType) -> Column:
    """Plain decimal text: whole doubles below 1e21 lose their ``.0``, others keep the
    shortest digits that give the double back, with ``e`` below 1e-6 and from 1e21 on."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        short = x.cast("string")
        plain = F.regexp_replace(F.regexp_replace(short.cast("decimal(38,22)").cast("string"), r"0+\z", ""), r"\.\z", "")
        wide = F.regexp_replace(F.lower(short), r"\.0e", "e")
        size = F.abs(x)
        whole = F.when(size < 2.0**53, x.cast("long").cast("string")).otherwise(_whole_text(x))
        return F.when(((size >= 2.0**53) | (x == F.floor(x))) & (size < 1e21), whole).when((size < 1e15) & (size >= 1e-6), plain).otherwise(wide)
    if isinstance(kind, T.DecimalType) and kind.scale:
        return F.regexp_replace(x.cast("string"), r"\.0*\z", "")
    if isinstance(kind, T.NumericType):
        return x.cast("string")
    return F.lit(None).cast("string")


def _sign(x: Column) -> Column:
    return F.when(x < 0, "-").otherwise("")


def _parts(x: Column, unit: int) -> tuple[Column, Column]:
    size = F.abs(x.cast(WHOLE))
    rest = size % unit
    return ((size - rest) / unit).cast(WHOLE), rest.cast(WHOLE)


def _digits(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def cents(x: Column, mark: str) -> Column:
    """``$9.99``, ``-€8.50``."""
    major, minor = _parts(x, 100)
    return F.concat(_sign(x), F.lit(mark), major.cast("string"), F.lit("."), _digits(minor, 2))


def coded(x: Column, code: str | Column, unit: int) -> Column:
    """``150.50 THB``, ``0.170000 USD``."""
    major, minor = _parts(x, unit)
    return F.concat(_sign(x), major.cast("string"), F.lit("."), _digits(minor, len(str(unit)) - 1), F.lit(" "), code if isinstance(code, Column) else F.lit(code))


def yen(x: Column) -> Column:
    return F.concat(_sign(x), F.lit("¥"), F.format_number(F.abs(x.cast(WHOLE)), 0))


def size_bytes(x: Column) -> Column:
    """Binary units with one decimal, halves to even; negative sizes don't fit."""
    one = lambda k, unit: F.concat(F.bround(x.cast("double") / float(1024**k), 1).cast("string"), F.lit(unit))
    return F.when(x < 0, None).when(x < 1024, F.concat(x.cast("string"), F.lit("B"))).when(x < 1024**2, one(1, "KiB")).when(x < 1024**3, one(2, "MiB")).when(x < 1024**4, one(3, "GiB")).otherwise(one(4, "TiB"))


def epoch_ms(x: Column) -> Column:
    stamp = F.date_format(F.timestamp_millis(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(x.between(FIRST_MS, LAST_MS), stamp)


def milliseconds(x: Column, kind: T.DataType) -> Column:
    """Under a second as it is, else in seconds with up to three decimals, rounded
    from the binary value (an exact tie to even)."""
    seconds = F.abs(x.cast("double") / 1000.0)
    whole = F.floor(seconds)
    rest = seconds - whole.cast("double")
    # A thousand times the upper and the lower bits of the fraction: both exact.
    upper = F.floor(rest * float(2**26)).cast("double") / float(2**26)
    high, low = upper * 1000.0, (rest - upper) * 1000.0
    at = F.floor(high)
    over = (high - at.cast("double") - 0.5) + low
    thousandths = at + F.when((over > 0) | ((over == 0) & (at % 2 == 1)), 1).otherwise(0)
    carry = thousandths >= 1000
    digits = F.regexp_replace(_digits(F.when(carry, 0).otherwise(thousandths), 3), r"(?<=[0-9])0{1,2}\z", "")
    text = F.concat(_sign(x), number((whole + carry.cast("long")).cast("double"), T.DoubleType()), F.lit("."), digits, F.lit("s"))
    return F.when(F.abs(x) < 1000, F.concat(number(x, kind), F.lit("ms"))).otherwise(text)


def integer_text(x: Column) -> Column:
    """The text itself if it is a decimal integer, else null."""
    return F.when(x.rlike(r"\A-?[0-9]+\z"), x)


def readable(x: Column, data: T.DataType, kind: str, code: str | Column | None) -> Column:
    """The value of a field of this kind; null where it doesn't fit."""
    i, n = integer(x, data), number(x, data)
    none, is_text = F.lit(None).cast("string"), isinstance(data, T.StringType)
    if kind == "secret":
        return F.when(x.cast("string") == "***", F.lit("***")) if is_text else none
    if kind == "rfc3339":
        return x if is_text else none
    if kind == "epoch_ns":
        whole = integer_text(x).try_cast("decimal(38,0)") if is_text else i.cast("decimal(38,0)")
        return epoch_ms(F.floor(whole / 1_000_000).try_cast("long"))
    if kind in ("sats", "msats"):
        return F.concat(integer_text(x) if is_text else i.cast("string"), F.lit(kind))
    simple = {
        "epoch_ms": lambda: epoch_ms(i),
        "epoch_s": lambda: epoch_ms(F.when(F.abs(i) < 10**15, i) * 1000),
        "usd_cents": lambda: cents(i, "$"),
        "eur_cents": lambda: cents(i, "€"),
        "jpy": lambda: yen(i),
        "bytes": lambda: size_bytes(i),
        "percent": lambda: F.concat(n, F.lit("%")),
        "ms": lambda: milliseconds(x, data) if isinstance(data, T.NumericType) else none,
        "cents": lambda: coded(i, "" if code is None else code, 100),
        "micro": lambda: coded(i, "" if code is None else code, 1_000_000),
    }
    if kind in simple:
        return simple[kind]()
    unit = {"us": "μs", "minutes": " minutes", "hours": " hours", "days": " days"}.get(kind, kind)
    return F.concat(n, F.lit(unit))


def readable_by_name(name: Column, x: Column, data: T.DataType) -> tuple[Column, Column]:
    """(display name, text) of a value whose name is known per row only."""
    ends = lambda s: name.endswith(s) | name.endswith(s.upper())
    cut = lambda s: F.substr(name, F.lit(1), F.length(name) - F.lit(len(s)))
    coded_name = r"(?s)\A(.+)_([A-Za-z]{3,4})_(cents|CENTS|micro|MICRO)\z"
    part = lambda i: F.regexp_extract(name, coded_name, i)
    none = F.lit(None).cast("string")
    strict = F.lit(False)
    for s in names.STRICT:
        strict = strict | ends(s)
    display, text = F.when(strict, name), F.when(strict, none)
    for s in (*names.TIMESTAMPS, *names.CURRENCIES):
        display, text = display.when(ends(s), cut(s)), text.when(ends(s), readable(x, data, s[1:], None))
    code = F.upper(part(2))
    for kind in ("cents", "micro"):
        fits = F.lower(part(3)) == kind
        display, text = display.when(fits, part(1)), text.when(fits, readable(x, data, kind, code))
    for s in (*names.NAMED, *names.UNITS, *names.SHORT):
        display, text = display.when(ends(s), cut(s)), text.when(ends(s), readable(x, data, s[1:], None))
    return display.otherwise(name), text.otherwise(none)
