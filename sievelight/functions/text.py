"""Lines, entropy, redaction and masking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All that ends a line, and what of it is rare.
RARE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"
LINE_END = f"\r\n|[\n{RARE_ENDS}]"
TOKEN = r"[A-Za-z0-9+/=_\-]"


def lines_of(content: Column) -> Column:
    """The lines of a text without their ends; nothing after the last end."""
    parts = F.split(content, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _split_lines(content: Column) -> Column:
    """The lines of a text that is not empty, split once: its last end is cut off before.

    Spark splits at a single character without a regular expression, so the
    rare ends are looked for first.
    """
    ends = F.substring(content, -1, 1)
    last = F.when(F.endswith(content, F.lit("\r\n")), 2).when((ends == "\n") | F.contains(F.lit(RARE_ENDS), ends), 1).otherwise(0)
    body = F.substr(content, F.lit(1), F.length(content) - last)
    return F.when(body.rlike(f"[{RARE_ENDS}]"), F.split(body, LINE_END)).otherwise(F.split(body, "\n"))


def explode_lines(files: DataFrame, *more: str) -> DataFrame:
    """``path, line_no, line`` and ``more`` columns of the files; lines count from 1."""
    # an inner generator would make the optimiser split once more, to filter out empty arrays
    some = files.where(F.col("content") != "")
    rows = some.select("path", *more, F.posexplode_outer(_split_lines(F.col("content"))).alias("__pos", "line"))
    return rows.select("path", *more, (F.col("__pos") + 1).alias("line_no"), "line")


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    chars = F.split(text, "")
    size = F.length(text)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / size
    bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(size == 0, F.lit(0.0)).otherwise(bits)


def is_high_entropy(text: Column, least: float = 4.5) -> Column:
    return entropy(text) > least


def is_high_entropy_base64(text: Column, least: float = 4.0) -> Column:
    return (F.length(text) >= 16) & text.rlike(f"^{TOKEN}+$") & (entropy(text) > least)


def redact(text: Column) -> Column:
    """Quoted runs of twenty characters and more keep their first and last four."""
    return F.regexp_replace(text, f"(?<=['\"])({TOKEN}{{4}}){TOKEN}{{12,}}({TOKEN}{{4}})(?=['\"])", "$1***$2")


def content_hash(content: Column) -> Column:
    """SHA-256 of a whole text in hex."""
    return F.sha2(content, 256)


def mask_key(key: Column) -> Column:
    n = F.length(key)
    shown = F.concat(F.substring(key, 1, 4), F.repeat(F.lit("•"), (n - 8).cast("int")), F.right(key, F.lit(4)))
    return F.when(n <= 8, F.repeat(F.lit("•"), n.cast("int"))).otherwise(shown)
