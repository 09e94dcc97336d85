"""Fill-in-the-middle transformation by escaped marker injection.

A delimiter that texts hardly hold is escaped, regexp_replace puts it after every unit, and what it added is the number of
units. Two cuts are drawn from a hash of the id; substring_index takes the parts between delimiters of those ranks, the
delimiters go, the escapes are undone, and the parts are put together around three markers. A text with a
marker in it, an empty text, and a share of all texts stay plain. restore() rebuilds the text from an output and its form.

One pass of built-in expressions, each linear in the text; nothing is shuffled, and rows do not depend on each other.

Defined results: a null text is the empty text, which is plain; a null id draws as the empty id; rows that repeat an id and
a text have one output; texts are read whole, and delimiters and escapes inside them come back as they were; an empty
table gives an empty table; input columns are kept, and those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

#: The delimiter, the escape, and the markers of prefix, suffix and middle.
DELIMITER, ESCAPE = "\x01", "\x02"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[A-Za-z]+|[^A-Za-z]"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def escaped(text: Column) -> Column:
    """Every escape is followed by a digit, and no delimiter is left."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def parts(marked: Column, count: Column) -> Column:
    """The first (count > 0) or last (count < 0) parts of a marked text."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count.cast("int"))


def plain_of(marked: Column) -> Column:
    return unescaped(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its parts lie between markers, which no text of these forms holds."""

    def after(text: Column, part: Column, marker: str) -> Column:
        return F.substring(text, F.char_length(part) + len(marker) + 1, F.char_length(text))

    def rebuilt(first: str, second: str) -> list[Column]:
        body = F.substring(output, len(first) + 1, F.char_length(output))
        one = F.substring_index(body, second, 1)
        rest = after(body, one, second)
        two = F.substring_index(rest, MIDDLE, 1)
        return [one, two, after(rest, two, MIDDLE)]

    psm, spm = rebuilt(PREFIX, SUFFIX), rebuilt(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, unit: str = UNIT) -> DataFrame:
    """Adds n (long), form ("plain", "psm" or "spm"), prefix_chars, middle_chars (long, null if plain) and output.

    unit: a pattern that covers the whole text; fim_percent of the texts that can be cut are, spm_percent of these
    with the suffix first."""
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    names = {k: fresh_name(docs, f"__{k}") for k in ("text", "esc", "marked", "n", "h", "low", "high", "form", "pre", "mid", "suf")}
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    out = docs.withColumns({names["text"]: F.coalesce(F.col(text_col).cast("string"), F.lit("")), names["h"]: numbers})
    out = out.withColumn(names["esc"], escaped(c["text"]))
    out = out.withColumn(names["marked"], F.regexp_replace(c["esc"], f"({ESCAPE}[01]|{unit})", "$1" + DELIMITER))
    out = out.withColumn(names["n"], (F.char_length(c["marked"]) - F.char_length(c["esc"])).cast("long"))
    cuts = [c["h"][i] % (c["n"] + 1) for i in range(2)]
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(c["text"], F.lit(marker))
    form = F.when((c["text"] == "") | held | (c["h"][2] % 100 >= fim_percent), "plain").when(c["h"][3] % 100 < spm_percent, "spm").otherwise("psm")
    out = out.withColumns({names["low"]: F.least(*cuts), names["high"]: F.greatest(*cuts), names["form"]: form})
    cut = c["form"] != "plain"
    out = out.withColumns({
        names["pre"]: F.when(cut, plain_of(parts(c["marked"], c["low"]))),
        names["mid"]: F.when(cut, plain_of(parts(parts(c["marked"], c["high"]), c["low"] - c["high"]))),
        names["suf"]: F.when(cut, plain_of(parts(c["marked"], c["high"] - c["n"] - 1))),
    })
    psm = F.concat(F.lit(PREFIX), c["pre"], F.lit(SUFFIX), c["suf"], F.lit(MIDDLE), c["mid"])
    spm = F.concat(F.lit(SUFFIX), c["suf"], F.lit(PREFIX), c["pre"], F.lit(MIDDLE), c["mid"])
    output = F.when(c["form"] == "psm", psm).when(c["form"] == "spm", spm).otherwise(c["text"])
    return out.select(*docs.columns, c["n"].alias("n"), c["form"].alias("form"), F.char_length(c["pre"]).cast("long").alias("prefix_chars"), F.char_length(c["mid"]).cast("long").alias("middle_chars"), output.alias("output"))
