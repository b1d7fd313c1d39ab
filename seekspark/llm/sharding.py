"""Sharding by a lookup table that shards' permutations fill.

Each shard has its own permutation of the slots of a table of prime size, as its order of preference. Shards take
turns to claim their next free slot until all are claimed, so each gets the same share to within one slot (or as
its weight has it), and a change of the shards moves few slots beside those that must move.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import free_names, without

#: Slots; a prime, over a hundred times the number of shards.
SLOTS = 65537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "little")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], weights: list[int] | None = None, slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in ``shards``) of each slot. ``weights``: turns that a shard gets a round, 1 by default."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    turns = [1] * len(shards) if weights is None else weights
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("a weight from 0 is needed for each shard, one above 0 at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, and no less than that of the shards")
    start = [_number(s, "start") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    tried = [0] * len(shards)
    table = np.full(slots, -1, np.int32)
    left = slots
    # In the order of names, so that the table does not depend on the order in which shards are listed.
    order = sorted(range(len(shards)), key=shards.__getitem__)
    while left:
        for i in order:
            for _ in range(turns[i]):
                if not left:
                    return table
                slot = (start[i] + tried[i] * step[i]) % slots
                while table[slot] >= 0:
                    tried[i] += 1
                    slot = (start[i] + tried[i] * step[i]) % slots
                table[slot] = i
                left -= 1
    return table


def place(rows: DataFrame, key: list[str], shards: list[str], weights: list[int] | None = None, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (the name) to each row, by the hash of its ``key`` columns.

    The table has ``slots`` rows whatever the input's size, so it is broadcast; rows are not shuffled. Null keys
    are a value like any other; equal keys go to one shard, so the key should be unique to spread a hot group.
    Texts of any length only pass through, repeated rows stay, an empty table gives no rows. Other columns pass
    through; columns named slot or shard are replaced (and may be part of the key).
    """
    table = lookup_table(shards, weights, slots)
    of, place_ = free_names(rows, "of", "place")
    listed = [(i, shards[s]) for i, s in enumerate(table.tolist())]
    small = F.broadcast(rows.sparkSession.createDataFrame(listed, f"{of} int, shard string"))
    keyed = rows.withColumn(place_, F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int"))
    keyed = without(keyed, "slot", "shard").join(small, F.col(place_) == F.col(of))
    kept = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    return keyed.select(*[F.col(f"`{c}`") for c in kept], F.col(place_).alias("slot"), "shard")
