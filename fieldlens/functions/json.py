"""JSON text as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let

def whole_json(text: Column) -> Column:
    """A variant of text that is exactly one JSON value, else null.

    The parser doesn't look at what follows a value, so the text is read as the first
    of two fields: only if nothing is left over does the second follow it. Its value
    is the text's digest, which no text holds itself.
    """
    def of(d: Column) -> Column:
        both = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"z":"'), d, F.lit('"}')))
        keys = lambda w: F.map_keys(F.try_variant_get(w, "$", "map<string,variant>"))
        return let(both, lambda w: F.when((F.try_variant_get(w, "$.z", "string") == d) & (F.size(keys(w)) == 2), F.try_variant_get(w, "$.v", "variant")))

    return let(F.md5(text.cast("binary")), of)
