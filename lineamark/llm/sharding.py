"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a table of prime size, (offset + i * skip) mod size, from hashes of its
name. Shards take turns: each claims the next slot of its order that is free, until the table is full, so shards'
shares differ by one slot at most, and a shard that comes or goes moves few others. A key's slot is its hash
modulo the size; placement is a look into the table, which has a fixed size and is broadcast.

Keys of any type are hashed as text; a null key is the empty text. Repeated keys go to one shard. A hot key is one
key: shard by a key that spreads (the row's id), not by a source. Columns shard and slot get underscores
where the input has such names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineamark.llm.shared import free_name

SIZE = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def hashed(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> list[int]:
    """For each slot the number of its shard. size must be a prime, at least as large as the number of shards."""
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime that is not below the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names")
    start = [hashed(s, "offset") % size for s in shards]
    skip = [hashed(s, "skip") % (size - 1) + 1 for s in shards]
    at, table, left = start[:], [-1] * size, size
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + skip[k]) % size
            table[slot] = k
            at[k] = (slot + skip[k]) % size
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """A key's slot: the first 60 bits of the MD5 of its text, modulo size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def shard(df: DataFrame, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """df with slot (long) and shard (string)."""
    slot, name, own = free_name(df, "slot"), free_name(df, "shard"), free_name(df, "table_slot")
    # two bytes for each slot: the whole table is one literal of fixed size
    packed = F.lit(bytearray(b"".join(k.to_bytes(2, "big") for k in lookup_table(shards, size))))
    number = F.conv(F.hex(F.substring(packed, (2 * F.col("id") + 1).cast("int"), F.lit(2))), 16, 10).cast("int")
    names = F.element_at(F.split(F.lit("\n".join(shards)), "\n"), number + 1)
    table = df.sparkSession.range(size).select(F.col("id").alias(own), names.alias(name))
    placed = df.withColumn(slot, slot_of(F.col(key_col), size))
    return placed.join(F.broadcast(table), placed[slot] == table[own]).drop(own)


def op6_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return shard(docs).select("doc_id", "source", "slot", "shard")


#: The same in SQL; the table, made once, stands in it as text, three digits for each slot.
OP6_SQL = f"""
WITH t AS (SELECT '{"".join(f"{k:03d}" for k in lookup_table())}' AS slots),
d AS (SELECT doc_id, source, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS BIGINT) AS slot FROM documents)
SELECT doc_id, source, slot, 'shard-' || substr(slots, CAST(3 * slot + 1 AS INTEGER), 3) AS shard FROM d, t
"""
