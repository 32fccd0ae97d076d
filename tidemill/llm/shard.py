"""Sharding by a permutation-filled lookup table (consistent placement in constant time)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import as_row, columns

SHARDS, SLOTS = 48, 5003


def _number(name: str, salt: str, most: int) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16) % most


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot.

    Shard s prefers the slots offset, offset + skip, offset + 2 skip, ... modulo a prime, a permutation of all.
    Shards take turns, each claiming the first free slot of its own order, so that counts differ by one at most,
    and a shard that leaves moves few slots between those that stay.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards: at least one, all different")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots: a prime no smaller than the number of shards")
    at = [_number(s, "offset", slots) for s in shards]
    skip = [_number(s, "skip", slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for s in range(len(shards)):
            if not left:
                break
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            table[at[s]] = s
            left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text modulo the number of slots; a null key hashes as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def assign(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with ``slot`` and ``out`` (the shard's name) after its columns; no shuffle of ``docs``.

    The table has ``slots`` rows whatever the input, so it may be broadcast. Equal keys go together, null keys to one
    shard. Columns of ``docs`` that have a name of the two, in whatever case, are replaced. Rows stay one to one; an
    empty table gives an empty result.
    """
    names = ",".join(str(s) for s in lookup_table(shards, slots))
    table = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("at", "owner"))
    listed = F.array(*(F.lit(s) for s in shards))
    table = table.select(F.col("at").cast("long").alias("at"), F.element_at(listed, F.col("owner").cast("int") + 1).alias("owner"))
    placed = docs.select(as_row(docs), slot_of(docs[key], slots).alias("slot")).join(F.broadcast(table), F.col("slot") == F.col("at"))
    return placed.select(*(F.col("row").getField(c).alias(c) for c in columns(docs, ("slot", out))), "slot", F.col("owner").alias(out))
