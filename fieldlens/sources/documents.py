"""Documents of any readable format as one VARIANT column, by the names of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import whole_json
from ..functions.urls import let
from . import ini
from .text import FORMATS, _dotenv_entries, detect_format, format_by_name

# Codes of errors, and formats that are known by name but not read here.
UNKNOWN, UNSUPPORTED, TOO_LARGE, PARSE_FAILED = "document_format_unknown", "document_format_unsupported", "document_too_large", "document_parse_failed"
UNREAD = ("toml", "yaml", "toml-frontmatter", "yaml-frontmatter", "markdown")
# End of the fixed values.
READ = ("json", "ini", "dotenv")
_GLOBS = {"json": "*.json", "ini": "*.ini", "dotenv": "{*.env,.env,.env.*}"}


def _dotenv(text: Column) -> Column:
    def of(es: Column) -> Column:
        bad = F.get(F.filter(es, lambda e: e["error"].isNotNull()), F.lit(0))["error"]
        pairs = F.map_from_entries(F.transform(es, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("variant").alias("value"))))
        return F.struct(F.when(bad.isNull(), F.to_variant_object(pairs)).alias("value"), bad.alias("error"))

    return let(_dotenv_entries()(text), of)


def load_texts(df: DataFrame, name: str, text: str, keep: list[str], form: str | None = None) -> DataFrame:
    """(keep, format, value, error): each text read by the format that its name tells, or
    all by the format that is named. A format that isn't known or isn't read, and a text
    that can't be parsed, give a code in place of a value, never the text."""
    known = F.lit(format_by_name(form)) if form else detect_format(F.col(name))
    rows = df.select(*keep, F.col(text).alias("_text"), known.alias("format"))
    # Only texts of the format go to the parser that runs in Python.
    env = rows.withColumn("_env", F.when(F.col("format") == "dotenv", F.col("_text"))) if form in (None, "dotenv", "env") else rows
    fail = lambda code: F.struct(F.lit(None).cast("variant").alias("value"), F.lit(code).alias("error"))
    as_json = let(whole_json(F.col("_text")), lambda v: F.struct(v.alias("value"), F.when(v.isNull(), "json_parse_failed").alias("error")))
    got = F.when(F.col("format").isNull(), fail(UNKNOWN)).when(F.col("format").isin(*UNREAD), fail(UNSUPPORTED)).when(F.col("_text").isNull(), fail(PARSE_FAILED))
    got = got.when(F.col("format") == "json", as_json).when(F.col("format") == "ini", ini.as_variant(F.col("_text")))
    if "_env" in env.columns:
        got = got.when(F.col("format") == "dotenv", _dotenv(F.col("_env")))
    return env.withColumn("_got", got).select(*keep, "format", "_got.value", "_got.error")


def load_documents(spark: SparkSession, path: str, formats: list[str] | None = None, most: int = 16 << 20) -> DataFrame:
    """(path, format, value, error) of files in any store that Spark reads. ``formats``:
    other files aren't listed; files of more than ``most`` bytes are refused by a filter
    that reaches the scan, so that their content is never read."""
    chosen = [FORMATS[f] for f in formats or ()]
    if set(chosen) - set(_GLOBS):
        raise ValueError(f"{UNSUPPORTED}: {sorted(set(chosen) - set(_GLOBS))}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if chosen:
        files = files.option("pathGlobFilter", "{" + ",".join(_GLOBS[f].strip("{}") for f in dict.fromkeys(chosen)) + "}")
    found = files.load(path)
    small = found.where(F.col("length") <= most).select("path", F.decode("content", "UTF-8").alias("_content"))
    large = found.where(F.col("length") > most).select("path", detect_format(F.col("path")).alias("format"), F.lit(None).cast("variant").alias("value"), F.lit(TOO_LARGE).alias("error"))
    return load_texts(small, "path", "_content", ["path"]).union(large)

