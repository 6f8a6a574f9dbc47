"""Secrets in URLs, argument lists and prose, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "***"
# White space, delimiters and trailing marks that end a URL in prose.
SPACES = r"\u0009-\u000D \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
DELIMITERS = "\"'<>`，。；！？）》】」』"
TRAILING = r".,;!)\]}，。；！）》】"
# End of the fixed values.
#: From the head of a run of scheme characters: what stands before its first letter
#: is part of the match, so that no position inside a run is tried.
IN_TEXT = rf"(?<![A-Za-z0-9+.\-])[0-9+.\-]*+[A-Za-z][A-Za-z0-9+.\-]*+://[^{SPACES}{DELIMITERS}]*[^{SPACES}{DELIMITERS}{TRAILING}]"
_URL = r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^ \t\n\f\r]*\z"
_BIG = 1 << 30


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    """Without white space at both ends; texts in ASCII alone need no pattern."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.btrim(text, F.lit("\t\n\x0b\x0c\r "))).otherwise(F.regexp_replace(text, rf"\A[{SPACES}]+|[{SPACES}]+\z", ""))


def is_url(text: Column) -> Column:
    """One URL: a scheme, ``://`` and no ASCII white space."""
    return F.contains(text, F.lit("://")) & text.rlike(_URL)


def secret_name(name: Column, secret_names: list[str] | None = None) -> Column:
    found = name.endswith("_secret") | name.endswith("_SECRET")
    return found | name.isin(*secret_names) if secret_names else found


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null if there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.substr(text, F.instr(text, mark) + F.lit(len(mark)), F.lit(_BIG)))


def _pairs(text: Column, secret_names: list[str] | None) -> Column:
    def one(pair: Column) -> Column:
        raw = F.substring_index(pair, "=", 1)
        # A bad escape stands for itself and doesn't keep others from being read.
        decoded = F.try_url_decode(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"))
        name = F.when(raw.rlike("[%+]"), F.coalesce(decoded, raw)).otherwise(raw)
        return F.when(F.contains(pair, F.lit("=")) & secret_name(name, secret_names), F.concat(raw, F.lit("=" + MARK))).otherwise(pair)

    return F.array_join(F.transform(F.split(text, "&", -1), one), "&")


def _cleaned(url: Column, secret_names: list[str] | None) -> Column:
    """Of a URL: no password, no values of secret parameters."""

    def tail(rest: Column) -> Column:
        before, fragment = F.substring_index(rest, "#", 1), _after(rest, "#")
        query = _after(before, "?")
        marked = lambda lead, x: F.when(x.isNull(), "").otherwise(F.concat(F.lit(lead), _pairs(x, secret_names)))
        return F.concat(F.substring_index(before, "?", 1), marked("?", query), marked("#", fragment))

    def whole(rest: Column) -> Column:
        # The password runs from the first colon to the last @ of the authority.
        authority = F.regexp_extract(rest, r"\A[^/?#]*", 0)
        user = F.regexp_replace(authority, r"(?s)\A([^:]*):.*@([^@]*)\z", r"$1:\*\*\*@$2")
        return F.concat(user, tail(F.substr(rest, F.length(authority) + F.lit(1), F.lit(_BIG))))

    return F.concat(F.substring_index(url, "://", 1), F.lit("://"), let(_after(url, "://"), whole))


def redact_url(url: Column, secret_names: list[str] | None = None) -> Column:
    """The password and the values of secret parameters become marks; what is no
    URL stays as it is, byte for byte."""
    return F.when((F.contains(url, F.lit("=")) | F.contains(url, F.lit("@"))) & is_url(url), _cleaned(url, secret_names)).otherwise(url)


def redact_url_field(value: Column, secret_names: list[str] | None = None) -> Column:
    """For a field that is named as a URL: URLs are redacted, trimmed if they must
    be; what is no URL but has white space or an ``@`` is hidden."""

    def other(bare: Column) -> Column:
        return F.when(is_url(bare), redact_url(bare, secret_names)).when(value.rlike(rf"[{SPACES}@]"), F.lit(MARK)).otherwise(value)

    return F.when(is_url(value), redact_url(value, secret_names)).otherwise(let(trimmed(value), other))


def is_url_field(value: Column) -> Column:
    """Whether a text is fit for a field that is named as a URL."""
    return is_url(value) | is_url(trimmed(value)) | ~value.rlike(rf"[{SPACES}@]")


def redact_urls_in_text(text: Column, secret_names: list[str] | None = None) -> Column:
    """Each URL inside prose is redacted where it stands."""

    def one(found: Column) -> Column:
        lead = F.regexp_extract(found, r"\A[0-9+.\-]*", 0)
        url = F.substr(found, F.length(lead) + F.lit(1), F.lit(_BIG))
        return F.when(found.rlike("[=@]"), F.concat(lead, let(url, lambda u: _cleaned(u, secret_names)))).otherwise(found)

    found = F.transform(F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0)), one)
    joined = F.transform(F.arrays_zip(F.split(text, IN_TEXT, -1).alias("t"), found.alias("u")), lambda p: F.concat(p["t"], F.coalesce(p["u"], F.lit(""))))
    return F.when(F.contains(text, F.lit("://")) & text.rlike("[=@]"), F.array_join(joined, "")).otherwise(text)


def redact_argv(args: Column, secret_names: list[str] | None = None) -> Column:
    """Values of secret ``--flags``, in the same or in the next argument."""

    def step(state: Column, arg: Column) -> Column:
        flag = F.substring_index(arg, "=", 1)
        bare = F.substring(flag, 3, _BIG)
        named = arg.startswith("--") & (secret_name(F.translate(bare, "-", "_"), secret_names) | secret_name(bare, secret_names))
        inline = F.contains(arg, F.lit("="))
        hidden = state["next"] & ~arg.startswith("-")
        out = F.when(hidden, F.lit(MARK)).when(named & inline, F.concat(flag, F.lit("=" + MARK))).otherwise(arg)
        return F.struct(F.array_append(state["out"], out).alias("out"), (~hidden & named & ~inline).alias("next"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("next"))
    return F.aggregate(args, start, step, lambda s: s["out"])
