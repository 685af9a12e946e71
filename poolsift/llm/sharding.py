"""Shard placement through a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime
size (an offset and a step, both hashed from its name).  Shards take turns;
each turn a shard claims the next free slot of its order.  Placing a row is
one hash and one lookup, and taking a shard away moves few rows of the others.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names, plain_names

TABLE_SIZE = 65_537    # prime; the broadcast table has this many rows whatever the input
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "little")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards, size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index into ``shards``.  No two shards differ by more than one slot.

    Raises for no shards, repeated names, a size that is not prime, or more shards than slots.
    """
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(size) or len(shards) > size:
        raise ValueError("the table size must be a prime of at least the number of shards")
    at = [_hash(s, "offset") % size for s in shards]
    step = [_hash(s, "step") % (size - 1) + 1 if size > 1 else 1 for s in shards]
    slots = [-1] * size
    left = size
    while True:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = i
            left -= 1
            if not left:
                return np.array(slots, dtype=np.int32)


def place(df: DataFrame, key_cols, shards=SHARDS, size: int = TABLE_SIZE,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` plus the slot and the shard's name.

    The slot is the hash of the key columns modulo the table size; equal keys
    (nulls included) get equal slots, repeated rows stay.  Columns of ``df``
    that bear the names of the new columns are replaced.
    """
    names = list(shards)
    filled = fill_table(names, size)
    lookup = df.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(filled.tolist())], "__slot int, __shard string")
    df, new = plain_names(df)
    keyed = df.withColumn("__slot", F.pmod(F.xxhash64(*[new[c] for c in key_cols]), F.lit(size)).cast("int"))
    # at most ``size`` rows, a parameter and not the data: broadcast
    out = keyed.join(F.broadcast(lookup), "__slot").withColumnsRenamed({"__slot": slot_col, "__shard": shard_col})
    return own_names(out, new, slot_col, shard_col)
