"""Filter interaction audit: what each filter removes, alone and in every order of application.

One pass gives every document the set of filters that it fails, as a bit mask, so all orders are sums over the counts of
a part's masks: nothing is filtered order by order.

Whether a text repeats an earlier one is found by refining a partition. Documents are split by their number of code points,
then by the hash of one block of text after another; at every level groups of one document are dropped, so the next level
looks at fewer. The hashes of all blocks come from the one pass over the texts, as reading texts again would cost more than
the few numbers. Levels are counted on the map side, so a group of copies of any size is one row a task. The texts of
what survives are then compared in full: grouped by class and text they give the smallest id of each text. Classes of
one text (all but hash collisions) mark their documents by class, the others by class and text.

Defined results: a null text is the empty text; a null part is the empty string; a null id comes after all others, so it
fails the copy filter where a document with an id holds its text and no null id is smaller than another; rows that repeat an
id and a text are not copies of each other; labels that repeat an id count if any of them says so; documents without a label
are neither good nor toxic; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Where blocks begin, in code points; the last one runs to the end of the text.
BLOCKS = (0, 256, 4096, 65_536)
#: The most groups (up to five numbers each) that are broadcast.
MAX_GROUPS = 200_000


def standard_filters(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text fails: A too few words, B too few distinct ones, C too many capitals, D odd characters."""
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.char_length(text) * F.lit(5).cast("long"),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def block_hash(text: Column, start: int, end: int | None) -> Column:
    return F.xxhash64(F.substring(text, start + 1, (end or 2**31 - 1) - start))


KEYS = ["len", *[f"b{i}" for i in range(len(BLOCKS))]]


def measured(docs: DataFrame, filters: Callable[[Column, Column], dict[str, Column]], bits: dict[str, int], part: str, id_col: str, text_col: str) -> DataFrame:
    """id, part, mask (without copies), len, one hash a block, text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = F.lit(0)
    for name, fails in filters(F.col("text"), F.col("words")).items():
        mask = mask + F.when(fails, bits[name]).otherwise(0)
    ends = [*BLOCKS[1:], None]
    hashes = [block_hash(F.col("text"), b, e).alias(f"b{i}") for i, (b, e) in enumerate(zip(BLOCKS, ends, strict=True))]
    return rows.select("id", "part", mask.cast("int").alias("mask"), F.char_length("text").alias("len"), *hashes, "text")


def among(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of the groups: by broadcast where they are counted to be few."""
    few = groups.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, on, how)


def repeated_classes(rows: DataFrame) -> DataFrame:
    """The classes (length and all block hashes) that at least two rows share, refined level by level."""
    alive = rows
    for k in range(1, len(KEYS) + 1):
        on = KEYS[:k]
        groups = written(alive.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").select(*on), f"audit-level-{k}")
        alive = among(rows, groups, on)
    return groups


def copy_mask(bit: int) -> Column:
    later = F.coalesce(F.col("id") > F.col("first"), F.col("id").isNull() & F.col("first").isNotNull())
    return F.col("mask") + F.when(later, bit).otherwise(0)


def masks(docs: DataFrame, filters: Callable[[Column, Column], dict[str, Column]], bits: dict[str, int], copies: str, part: str, id_col: str, text_col: str) -> DataFrame:
    """id, part, mask of every document, copies of an earlier text included."""
    whole = measured(docs, filters, bits, part, id_col, text_col)
    rows = written(whole.drop("text"), "audit-rows")
    classes = repeated_classes(rows)
    texts = among(whole.select("id", *KEYS, "text"), classes, KEYS).groupBy(*KEYS, "text").agg(F.min("id").alias("first"))
    texts = written(texts, "audit-texts")
    per = written(texts.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("first").alias("first")), "audit-classes")
    out = among(rows, per.where("n = 1").select(*KEYS, "first"), KEYS, "left")
    mixed = per.where("n > 1").select(*KEYS)
    if not mixed.isEmpty():
        # different texts of one class: these are marked by their texts
        out = among(out, mixed, KEYS, "left_anti").select("id", "part", "mask", "first")
        known = texts.join(mixed, KEYS, "left_semi")
        out = out.unionByName(among(whole, mixed, KEYS).join(known, [*KEYS, "text"]).select("id", "part", "mask", "first"))
    return out.select("id", "part", copy_mask(bits[copies]).cast("int").alias("mask"))


def orders(names: list[str], bits: dict[str, int]) -> str:
    """Every step of every order as JSON: the order, the step, the filter's bit and those of the filters before it."""
    out = []
    for order in permutations(names):
        before = 0
        for i, name in enumerate(order):
            out.append({"filter_order": "".join(order), "step": i + 1, "bit": bits[name], "before": before})
            before |= bits[name]
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame, filters: Callable[[Column, Column], dict[str, Column]] = standard_filters, copies: str = "E", part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step and, as long: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    filters: name (one letter) -> whether a text fails, from the text and its words; copies: the name of the copy filter.
    All orders are listed, so keep the filters few (five give 120)."""
    names = sorted([*filters(F.lit(""), F.array(F.lit(""))), copies])
    if len(set(names)) < len(names) or len(names) > 7 or any(len(n) != 1 for n in names):
        raise ValueError("filters need different names of one letter, seven at most")
    bits = {n: 1 << i for i, n in enumerate(names)}
    said = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks(docs, filters, bits, copies, part, id_col, text_col).join(said, "id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # at most 2 ** filters cells a part
    per = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(orders(names, bits)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = per.select("part", "cells", F.inline(steps))
    factorial = 1
    for i in range(2, len(names) + 1):
        factorial *= i

    def total(cond: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("cells", cond), F.lit(0).cast("long"), lambda a, x: a + value(x))

    def hit(x: Column, by: str) -> Column:
        return x["mask"].bitwiseAND(F.col(by)) != 0

    first = lambda x: hit(x, "bit") & ~hit(x, "before")
    # of the filters that a document fails, each comes first in as many orders
    turn = lambda x: (x["n"] * F.lit(factorial) / F.bit_count(x["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~hit(x, "bit") & ~hit(x, "before")).alias("kept"), total(first).alias("removed"),
        total(lambda x: hit(x, "bit") & hit(x, "before")).alias("redundant"), total(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        total(first, lambda x: x["good"]).alias("good_lost"), total(first, lambda x: x["toxic"]).alias("toxic_lost"),
        total(lambda x: hit(x, "bit"), turn).alias("shapley"),
    )
