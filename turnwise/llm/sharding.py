"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table and shards take turns to
claim the first slot of theirs that is free, until the table is full.  A key's slot is its hash
modulo the size; the broadcast table gives its shard in constant time.  When a shard leaves, few
keys of the others move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Shards and slots of the query; slots are prime and many for each shard.
SHARDS, SLOTS = 24, 2039


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in names) of each slot.  Slots must be prime and no fewer than names."""
    if slots < len(names) or slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime and no fewer than the shards")
    if len(set(names)) != len(names) or not names:
        raise ValueError("shards need names that differ")
    start = [_number(f"{n}/offset") % slots for n in names]
    step = [_number(f"{n}/skip") % (slots - 1) + 1 for n in names]
    tried, table, free = [0] * len(names), [-1] * slots, slots
    while free:
        for i in range(len(names)):
            while True:
                slot = (start[i] + tried[i] * step[i]) % slots
                tried[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def placed(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """(key, slot, shard) of every row: the slot is the first 48 bits of the key's MD5 modulo slots.

    A null key counts as the empty string.  Repeated keys go to one shard.  The table's size is a
    parameter, not the data's, so it is safe to broadcast; no row is shuffled."""
    spark = docs.sparkSession
    names = [f"shard-{i:05d}" for i in range(shards)]
    slot, shard = fresh(docs.select(key), "slot", "shard")
    table = spark.createDataFrame(list(enumerate(lookup_table(names, slots))), f"`{slot}` long, `{shard}` int")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    return docs.select(key, F.pmod(hashed, F.lit(slots)).alias(slot)).join(F.broadcast(table), slot).select(key, slot, shard)


def sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The query in SQL: the table is filled turn by turn in a recursive query."""
    number = "('0x' || substr(md5({}), 1, 12))::bigint"
    return f"""
with recursive shard as (
  select i::bigint as shard, {number.format("printf('shard-%05d/offset', i)")} % {slots} as start, {number.format("printf('shard-%05d/skip', i)")} % {slots - 1} + 1 as step from range({shards}) t(i)),
lists as (select list(start order by shard) as starts, list(step order by shard) as steps from shard),
fill(turn, taken, slot) as (
  select 0::bigint, []::bigint[], null::bigint
  union all
  select turn + 1, list_append(taken, next), next from (
    select turn, taken, list_filter(list_transform(range({slots}), lambda j: (starts[turn % {shards} + 1] + j * steps[turn % {shards} + 1]) % {slots}), lambda s: not list_contains(taken, s))[1] as next
    from fill, lists where turn < {slots}))
select d.doc_id, f.slot, ((f.turn - 1) % {shards})::integer as shard
from documents d join fill f on f.slot = {number.format("coalesce(d.doc_id::varchar, '')")} % {slots}
"""


SQL = sql()
