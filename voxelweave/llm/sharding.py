"""Sharding (operator 4) through a permutation-filled lookup table.

The table has a prime number of slots.  Each shard prefers the slots in an order of its
own, ``offset + k * skip`` modulo the prime, which visits every slot once.  Shards take
turns and claim the first free slot of their order until the table is full, so shares
are equal to within one slot, and a shard that comes or goes moves few other slots.
A document's key picks a slot; one broadcast of the table (its size is fixed by the
prime, whatever the data) then places every row in constant time, without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table's slots: a prime far above the number of shards.
SLOTS = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str] | int = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> np.ndarray:
    """The shard (its place in the list) of every slot.

    ``weights`` gives a shard so many turns in each round (1 if not named).
    """
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards: at least one name, each once")
    if not is_prime(slots) or slots < len(names):
        raise ValueError(f"slots: a prime of at least {len(names)}, not {slots}")
    turns = [(weights or {}).get(n, 1) for n in names]
    if min(turns) < 0 or not sum(turns):
        raise ValueError("weights: none below zero, and not all zero")
    at, skip = [], []
    for name in names:
        seed = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(seed[:8], "big") % slots)
        skip.append(int.from_bytes(seed[8:16], "big") % (slots - 1) + 1 if slots > 1 else 1)
    owner = [-1] * slots
    left = slots
    while left:
        for shard, count in enumerate(turns):
            for _ in range(min(count, left)):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + skip[shard]) % slots
                owner[at[shard]] = shard
                left -= 1
    return np.array(owner, np.int32)


def assign(docs: DataFrame, key_col: str = "doc_id", shards: list[str] | int = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (ints); columns of these names are replaced.

    Equal keys always meet in one shard, whatever the table's other rows; a null key has
    a slot of its own like any value.  No row is dropped or copied.
    """
    owner = lookup_table(shards, slots, weights)
    frame = pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": owner})
    places = docs.sparkSession.createDataFrame(frame, "slot int, shard int")
    rest = [c for c in docs.columns if c not in ("slot", "shard")]
    hashed = F.pmod(F.xxhash64(F.lit(17), docs[key_col].cast("string")), F.lit(slots)).cast("int")
    return docs.select(*rest, hashed.alias("slot")).join(F.broadcast(places), "slot").select(*rest, "slot", "shard")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, key_col: str = "doc_id", files_per_shard: int = 1) -> str:
    """Write ``docs`` as Parquet under ``folder/shard=N``, each shard in a few files.

    Rows of a shard are dealt over ``files_per_shard`` tasks, so no shard is one task.  A null
    key is a key like any; an empty table writes no file; ``slot`` and ``shard`` are replaced.
    """
    out = assign(docs, key_col, shards)
    part = F.pmod(F.xxhash64(docs[key_col].cast("string")), F.lit(files_per_shard))
    out.repartition(shards * files_per_shard, "shard", part).write.partitionBy("shard").parquet(folder)
    return folder


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id`` with its ``slot`` and ``shard`` of SHARDS."""
    return assign(docs.select("doc_id"))
