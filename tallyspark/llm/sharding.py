"""Placement by a permutation-filled lookup table (dealt operator 2).

Each shard has its own order of preference over a table of prime size: it
starts at ``offset`` and walks in steps of ``skip``, both from the digest of
its name.  Shards take turns; at its turn a shard claims the first free slot of
its order, and a shard of weight ``w`` has ``w`` turns a round.  So shards own
almost equal numbers of slots, and removing one moves few slots of the others.

The table has a fixed number of slots (its size is a parameter and does not
grow with the data), so it is broadcast: a row finds its shard by one lookup of
its key's hash, in constant time and without a shuffle.  Rows are placed by a
hash of a unique key, so a hot source or bucket spreads over all shards.

A null key is placed as the empty string.  Equal keys share a shard.  Names
must be distinct and at least one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, over a hundred times the number of shards it serves.
TABLE_SIZE = 65_537


def preference(name: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's order."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def fill_table(names: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the position in ``names`` of the shard that owns it."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be distinct and at least one")
    if size < 3 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be an odd prime")
    turns = [i for i, n in enumerate(names) for _ in range((weights or {}).get(n, 1))]
    if not turns:
        raise ValueError("some shard must have a positive weight")
    at, step = map(list, zip(*(preference(n, size) for n in names)))
    owner, free = [-1] * size, size
    while free:
        for i in turns:
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + step[i]) % size
            owner[slot], at[i] = i, (slot + step[i]) % size
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its text's MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).alias("slot")


def place(df: DataFrame, key: str, names: list[str], size: int = TABLE_SIZE, column: str = "shard",
          weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with the shard of each row; a column of that name is replaced."""
    owner = fill_table(names, size, weights)
    table = df.sparkSession.createDataFrame([(s, names[i]) for s, i in enumerate(owner)], f"__slot long, `{column}` string")
    rows = df.drop(column).withColumn("__slot", slot_of(F.col(key), size))
    return rows.join(F.broadcast(table), "__slot").drop("__slot")
