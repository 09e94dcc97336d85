"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table. In turns, each claims
the first free slot of its order until the table is full, so shards own almost equal numbers of
slots and a change of the shard list moves few of them. A row's slot is its key's hash modulo the
table size; its shard is one lookup in the table, which is broadcast: its size is a parameter, not
a function of the data.

Defined results: a null key hashes as the empty string, so all such rows meet in one shard; equal
keys always share a shard; an empty table gives an empty table; input columns are kept, and those
named like an output column are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

#: The largest table that may be broadcast (slots).
MAX_TABLE = 1_000_003


def _number(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[15 * part : 15 * part + 15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard index of every slot. size: a prime, best at least 100 times the number of shards."""
    if not is_prime(size) or size > MAX_TABLE or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("the table size must be a prime that holds every shard, and shard names must differ")
    at = [_number(s, 0) % size for s in shards]
    skip = [_number(s, 1) % (size - 1) + 1 for s in shards]
    slots, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            slots[at[i]] = i
            left -= 1
            if not left:
                break
    return slots


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def assign(df: DataFrame, shards: list[str], size: int = 65_537, key: str = "doc_id") -> DataFrame:
    """Adds slot and shard (both int). One broadcast lookup a row; rows are not shuffled."""
    slots = ",".join(map(str, lookup_table(shards, size)))
    at, to = fresh_name(df, "__slot"), fresh_name(df, "__shard")
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(slots), ",")).alias(at, to)).withColumn(to, F.col(to).cast("int"))
    keep = [c for c in df.columns if c not in ("slot", "shard")]
    put = df.withColumn(at, F.pmod(key_hash(df[key]), F.lit(size)).cast("int"))
    return put.join(F.broadcast(lookup), at).select(*keep, F.col(at).alias("slot"), F.col(to).alias("shard"))


def assign_groups(df: DataFrame, shards: list[str], group: str, size: int = 65_537, row_key: str = "doc_id") -> DataFrame:
    """Keeps the rows of a group together, but splits a group above half a shard's fair share into parts of that size.

    At most 2 * len(shards) groups can be so large, which bounds what is broadcast."""
    n = len(shards)
    total = df.count()
    g, many, mixed_key = (fresh_name(df, c) for c in ("__g", "__parts", "__key"))
    parts = df.groupBy(F.col(group).alias(g)).agg(F.count("*").alias(many)).where(F.col(many) * 2 * n > total)
    parts = parts.select(g, F.ceil(F.col(many) * 2 * n / F.lit(max(total, 1))).alias(many))
    mixed = df.join(F.broadcast(parts), df[group].eqNullSafe(F.col(g)), "left")
    part = F.pmod(key_hash(F.col(row_key)), F.coalesce(many, F.lit(1)))
    mixed = mixed.withColumn(mixed_key, F.concat_ws("\x1f", F.coalesce(F.col(group).cast("string"), F.lit("")), part.cast("string")))
    return assign(mixed, shards, size, mixed_key).drop(g, many, mixed_key)


def write_shards(df: DataFrame, path: str) -> None:
    """Writes assigned rows, one folder a shard; a shard's rows stay spread over the tasks that read them."""
    df.write.partitionBy("shard").parquet(path)
