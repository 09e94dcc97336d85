"""Scalar functions: safe numbers, labels, and what is parsed from structured answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the score categories.
ACCEPT, REVIEW = 0.5, 0.2


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def safe_float(c: Column, otherwise: float | None = None) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(otherwise).cast("double"))


def bounded(c: Column) -> Column:
    """NaN as 0, infinities as +-1e9."""
    return F.when(F.isnan(c), 0.0).otherwise(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c)))


def file_label(c: Column) -> Column:
    """Runs of other than word characters, "-" and "." as one "_"."""
    return F.regexp_replace(c, r"[^\w\-.]+", "_")


def collapsed(c: Column) -> Column:
    """Lower case, white space single, trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null if the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def tags(c: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def score_category(r: Column) -> Column:
    return F.when(r.isNull() | F.isnan(r), "unscored").when(r >= ACCEPT, "accept").when(r >= REVIEW, "review").otherwise("recluster")


def quality_flag(r: Column, consistent: Column) -> Column:
    """Without a score "unscored"; high needs an accepted score and no doubt about consistency."""
    return F.when(r.isNull() | F.isnan(r), "unscored").when((r >= ACCEPT) & F.coalesce(consistent, F.lit(True)), "high_quality").when(r >= REVIEW, "needs_review").otherwise("low_quality")


def int_list(answer: Column, n: Column | int) -> Column:
    """The first JSON list of whole numbers in the answer, clamped to 0..10, if it has n of them; else all single digits and tens of the text, if they are n; else null."""
    plain = F.regexp_replace(answer, "```(?:json)?", "")
    listed = F.from_json(F.regexp_extract(plain, r"(\[[\s\d,+\-]*\])", 1), "array<int>")
    loose = F.transform(F.regexp_extract_all(plain, F.lit(r"\b(10|\d)\b"), F.lit(1)), lambda x: x.cast("int"))
    found = F.when(F.size(listed) == n, listed).when(F.size(loose) == n, loose)
    return F.transform(found, lambda x: F.greatest(F.lit(0), F.least(F.lit(10), x)))


def section(answer: Column, name: str) -> Column:
    """The text after "NAME:" up to the next upper-case heading, trimmed; null if missing."""
    return F.nullif(F.trim(F.regexp_extract(answer, rf"(?s){name}\s*:\s*(.*?)(?=\n[A-Z][A-Z _]+:|\z)", 1)), F.lit(""))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def number_text(c: Column, digits: int = 6) -> Column:
    """Fixed digits; inf, -inf and nan by name; null as empty."""
    inf = float("inf")
    return F.when(c.isNull(), "").when(F.isnan(c), "nan").when(c == inf, "inf").when(c == -inf, "-inf").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def token_midpoint(start: Column, end: Column, tok: Column, length: Column | int) -> Column:
    """The position at the middle of a token's share of the window, truncated."""
    return (start + (tok + F.lit(0.5)) * (end - start) / length).cast("long")


def step_of(path: Column, name: str = "step") -> Column:
    return F.regexp_extract(path, rf"{name}[_=]?(\d+)", 1).try_cast("long")
