"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, a permutation
`(offset + j * skip) mod size` fixed by the md5 of its name. Shards take turns; at its turn a shard
claims the first slot of its order that is still free, until the table is full. A key is placed by
one hash and one look into the table, and adding or removing a shard moves few keys. The table has
`size` rows whatever the data, so it is broadcast, and placing needs no shuffle: hot keys, copies
and skewed sources cannot load a task.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hex_number

MOST_SLOTS = 16_381


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot int, shard string), one row per slot, filled by turns.

    `size` must be prime, at least the number of shards and at most `MOST_SLOTS`, which bounds both
    the filling and the broadcast. Repeated shard names count once; their first place sets the turn.
    """
    names = list(dict.fromkeys(shards))
    if not names or any(not n for n in names):
        raise ValueError("sharding needs at least one shard, each with a name")
    if not _is_prime(size) or not len(names) <= size <= MOST_SLOTS:
        raise ValueError(f"table size must be a prime between the number of shards and {MOST_SLOTS}")
    listed = F.array(*[F.lit(n) for n in names])
    orders = F.struct(
        F.transform(listed, lambda n: (hex_number(n, 1) % size).cast("int")).alias("first"),
        F.transform(listed, lambda n: (hex_number(n, 16) % (size - 1) + 1).cast("int")).alias("skip"),
    )
    # transform() over a one-element array binds a value to a name, so it is worked out once.
    who = f"t % {len(names)}"
    wish = f"transform(array(struct(p.first[{who}] AS a, p.skip[{who}] AS b)), x -> filter(transform(free, j -> (x.a + j * x.b) % {size}), s -> owner[s] = -1)[0])"
    claim = f"transform({wish}, s -> transform(owner, (o, k) -> if(k = s, {who}, o)))[0]"
    fill = f"aggregate(free, array_repeat(-1, {size}), (owner, t) -> {claim})"
    filled = spark.range(1, numPartitions=1).select(F.array(orders).alias("orders"))
    filled = filled.selectExpr(f"transform(orders, p -> transform(array(sequence(0, {size - 1})), free -> {fill})[0])[0] AS owners")
    return filled.selectExpr("posexplode(owners) AS (slot, owner)").select("slot", F.element_at(listed, F.col("owner") + 1).alias("shard"))


def place(frame: DataFrame, key: str, shards: list[str], size: int, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Add `slot` and `shard` to every row of `frame`, by its `key` column of any simple type.

    Equal keys land in the same shard. A null key counts as the empty text. Rows are kept whole:
    repeated rows stay repeated, an empty frame gives an empty frame. Column names that exist
    already must be avoided by the caller through `slot` and `shard`.
    """
    if {slot.lower(), shard.lower()} & {c.lower() for c in frame.columns}:
        raise ValueError(f"the frame has a column {slot} or {shard} already; give other names")
    [at] = fresh(frame.withColumns({slot: F.lit(0), shard: F.lit("")}), "place")
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    table = lookup_table(frame.sparkSession, shards, size).select(F.col("slot").alias(at), F.col("shard").alias(shard))
    keyed = frame.withColumn(slot, (hex_number(text, 1) % size).cast("int"))
    return keyed.join(F.broadcast(table), keyed[slot] == table[at], "left").drop(at)
