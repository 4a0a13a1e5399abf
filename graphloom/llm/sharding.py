"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. Shards
take turns, each claiming the first slot of its permutation that is still free,
until the table is full. A row's key is hashed to a slot, and the slot names
the shard: placement takes constant time, loads differ by little, and removing
a shard moves few rows besides its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot, the index of the shard that claimed it.

    size must be a prime, and no smaller than the number of shards, which must
    have different names. The work is about size * ln(size) steps whatever the
    data, so it is done once on the driver.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, and no less than the number of shards")
    at, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1 if size > 2 else 1)
    owner = [-1] * size
    free = size
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % size
            owner[slot] = shard
            at[shard] = (slot + step[shard]) % size
            free -= 1
            if not free:
                return owner


def slots_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard); its size is a parameter, not a property of the data."""
    owner = lookup_table(shards, size)
    return spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "slot int, shard string")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Add slot and shard to every row; columns of those names are replaced.

    Rows with equal keys, repeated rows included, go to the same shard. A null
    key is hashed as a value of its own, so such rows are placed too. An empty
    table gives an empty result. Texts and other columns are not looked at.
    """
    kept = docs.drop("slot", "shard")
    slot = F.pmod(F.xxhash64(F.coalesce(kept[key].cast("string"), F.lit("\u0000null"))), F.lit(size)).cast("int")
    placed = kept.withColumn("slot", slot).join(F.broadcast(slots_frame(docs.sparkSession, shards, size)), "slot")
    return placed.select(*[placed[c] for c in kept.columns], "slot", "shard")
