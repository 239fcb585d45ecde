"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots.  Every shard prefers the slots in an
order of its own, a permutation given by two hashes of its name (first slot and
step); shards take turns claiming their next free preference until all slots
are taken, so shares differ by at most one slot, and adding or removing a shard
moves little more than its share of the rows.  Shards with a weight take that
many turns a round.

The table is made on the driver (``TABLE`` slots, whatever the data; its size
is checked) and broadcast; placing a row is a hash and one look-up, without any
shuffle.  Rows of a hot source spread over all shards, because the key is the
row's own.

Defined results: a null key is placed like the text "null"; equal keys, also in
repeated rows, are placed together; an empty table gives an empty result; all
other columns are kept by ``place``, whose new columns get names that are free.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames

#: A prime, at least a hundred times the number of shards.
TABLE = 65_537
LARGEST_TABLE = 5_000_011


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def name_hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: dict[str, int] | list[str], size: int = TABLE) -> np.ndarray:
    """The shard (a position in the sorted names) of every slot."""
    weights = dict(sorted((shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)).items()))
    if not is_prime(size) or size > LARGEST_TABLE:
        raise ValueError(f"the table needs a prime size of at most {LARGEST_TABLE}")
    if not 0 < sum(weights.values()) <= size or min(weights.values()) < 1:
        raise ValueError("each shard needs a positive weight, and all of them a slot")
    slots = np.arange(size, dtype=np.int64)
    orders = [(name_hash(n, "offset") % size + slots * (name_hash(n, "skip") % (size - 1) + 1)) % size
              for n in weights]
    at = [0] * len(orders)
    table, free = np.full(size, -1, np.int64), size
    while free:
        for shard, turns in enumerate(weights.values()):
            for _ in range(min(turns, free)):
                while table[orders[shard][at[shard]]] >= 0:
                    at[shard] += 1
                table[orders[shard][at[shard]]] = shard
                free -= 1
    return table


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def place(rows: DataFrame, key_col: str, shards: dict[str, int] | list[str],
          size: int = TABLE) -> tuple[DataFrame, str, str]:
    """``rows`` with their slot and shard; and the names of these two columns."""
    names = sorted(shards)
    table = lookup_table(shards, size)
    slot, shard = frames.fresh("slot", rows), frames.fresh("shard", rows)
    spark = rows.sparkSession
    looked_up = spark.createDataFrame(
        list(enumerate(names[i] for i in table.tolist())), f"{slot} long, {shard} string")
    placed = rows.withColumn(slot, key_hash(F.col(f"`{key_col}`")) % size)
    return placed.join(F.broadcast(looked_up), slot), slot, shard


def write_shards(rows: DataFrame, key_col: str, shards: dict[str, int] | list[str], path: str,
                 size: int = TABLE) -> None:
    """One folder of Parquet files for each shard; each task appends to the
    folders it has rows for, so no shard is gathered in one task."""
    placed, slot, shard = place(rows, key_col, shards, size)
    placed.drop(slot).write.partitionBy(shard).parquet(path)
