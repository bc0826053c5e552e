"""Sharding by a permutation-filled lookup table (operator 1, DataFrame operations only).

Shards take turns; at its turn a shard claims the next free slot in its own order of preference, a walk through a
prime-sized table with an offset and a step taken from its name's hash. A row's key hashes to a slot and a broadcast
join reads the slot's owner. The table has SLOTS entries whatever the data's size, so the broadcast is bounded.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import free_name, hash60

#: A prime over 100 times the number of shards: shares differ by less than one part in a hundred.
SHARDS, SLOTS = 32, 4099


def _hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The owner of each slot, as an index of names."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and differ")
    if slots < len(names) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, and no less than the shards")
    at = [_hash60(f"offset:{n}") % slots for n in names]
    step = [_hash60(f"skip:{n}") % (slots - 1) + 1 for n in names]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: the filled table as a DataFrame made from literals."""
    owners = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")
    labels = F.array(*[F.lit(n) for n in names])
    return spark.range(1, numPartitions=1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.element_at(labels, F.col("owner").cast("int") + 1).alias("shard"))


def key_of(columns: list[str]) -> Column:
    """The columns as one text; null differs from every value, and ("a", "bc") from ("ab", "c")."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


def assign(df: DataFrame, keys: list[str], names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot and shard (names with underscores in front where df has such columns already).

    Equal keys go to one shard and no row moves. Null keys count as one more value; repeated rows and an empty table
    need no special case. Where one key value holds many rows, add a column that tells them apart to keys.
    """
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    table = lookup(df.sparkSession, names, slots).toDF(slot, shard)
    placed = df.withColumn(slot, F.pmod(hash60("key:", key_of(keys)), F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(table), slot).select(*[F.col(f"`{c}`") for c in df.columns], slot, shard)


def write_shards(df: DataFrame, keys: list[str], names: list[str], path: str, files_per_shard: int = 8) -> None:
    """Write df as one folder per shard; a shard is dealt to files_per_shard tasks by the row's hash."""
    placed = assign(df, keys, names)
    shard = placed.columns[-1]
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.repartition(len(names) * files_per_shard, shard, deal).drop(placed.columns[-2]).write.partitionBy(shard).parquet(path)
