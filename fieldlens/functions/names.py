"""What a field means, from the suffix of its name. All of it runs at plan time."""

from __future__ import annotations

import re

# The registered suffixes, longest first within the order of matching.
TIMESTAMPS = ("_epoch_ms", "_epoch_s", "_epoch_ns")
CURRENCIES = ("_usd_cents", "_eur_cents")
NAMED = ("_rfc3339", "_minutes", "_hours", "_days")
UNITS = ("_msats", "_sats", "_bytes", "_percent", "_secret")
SHORT = ("_jpy", "_ns", "_us", "_ms", "_s")
STRICT = ("_rfc3339_date", "_rfc3339_time", "_bcp47", "_utc_offset")
# End of the fixed values.

_CODE = re.compile(r"(?s)(.+)_([A-Za-z]{3,4})_(cents|CENTS|micro|MICRO)\Z")


def ends_with(name: str, suffix: str) -> bool:
    """Lower case or upper case as a whole, never mixed."""
    return name.endswith(suffix) or name.endswith(suffix.upper())


def is_secret(name: str, secret_names: frozenset[str] = frozenset()) -> bool:
    return ends_with(name, "_secret") or name in secret_names


def is_url(name: str, url_names: frozenset[str] = frozenset()) -> bool:
    return ends_with(name, "_url") or name in url_names


def meaning(name: str) -> tuple[str, str, str | None] | None:
    """(display name, kind, currency code) of a field that has a formatting suffix."""
    if any(ends_with(name, s) for s in STRICT):
        return None
    for s in (*TIMESTAMPS, *CURRENCIES):
        if ends_with(name, s):
            return name[: -len(s)], s[1:], None
    found = _CODE.fullmatch(name)
    if found:
        return found[1], found[3].lower(), found[2].upper()
    for s in (*NAMED, *UNITS, *SHORT):
        if ends_with(name, s):
            return name[: -len(s)], s[1:], None
    return None
