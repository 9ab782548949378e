"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each round, joins show every group where its members are, and
members move towards the shard that holds most of the group among those with room; quotas keep a
shard's linked documents under its capacity, so that a group larger than a shard settles in several.
Documents without links then fill the shards, whose row counts end at most one apart (law "rows").

Members of a group are interchangeable, so the rounds work on one row per group and shard. Ranks are
taken over range-partitioned rows, so neither a group nor a shard is ever gathered in one task.

Null texts count as empty ones and null ids as any other; repeated rows are members of one group.
Only doc_id and the text column are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import durable, spread_join

SHARDS, ROUNDS = 24, 8
#: A shard takes members only while more than this share of its capacity is free; rounds end when fewer than this share move.
LEAST_ROOM, LEAST_MOVED = 0.005, 0.001
GROUP = ["g1", "g2"]


def ranked(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df with rank, the row's place in a total order of unique rows, as a durable table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    put = durable(put.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"), label)
    base, rows = 0, []
    for r in sorted(put.groupBy("__part").count().collect()):  # a row for each partition
        rows.append((r["__part"], base))
        base += r["count"]
    offsets = df.sparkSession.createDataFrame(rows, "__part long, __base long")
    return put.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def _per_shard(values: dict[int, int], shard: Column) -> Column:
    """The value of a shard, of a few shards' values."""
    return F.element_at(F.create_map(*[F.lit(x).cast(t) for s, v in values.items() for x, t in ((s, "int"), (v, "long"))]), shard)


def propagate(cells: DataFrame, n_shards: int, capacity: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """cells (g1, g2, shard, n) after rounds of moves towards the fullest shard of each group that has room."""
    least = max(1, int(LEAST_ROOM * capacity))
    for k in range(rounds):
        loads = {s: 0 for s in range(n_shards)} | {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = {s: max(0, capacity - v) for s, v in loads.items()}
        roomy = _per_shard(room, F.col("shard")) >= least
        # A group settles in as many of its fullest shards with room as its members need; those elsewhere are dealt to them.
        place = F.when(roomy, F.struct("n", F.xxhash64(*GROUP, "shard").alias("h"), "shard"))
        wants = cells.groupBy(*GROUP).agg(F.sort_array(F.collect_list(place), asc=False).alias("places"), F.sum(F.when(roomy, F.col("n"))).alias("there"))  # n_shards at most in a list
        wants = wants.filter(F.size("places") > 0).withColumn("homes", F.slice("places", 1, F.greatest(F.lit(1), F.ceil(F.col("there") / max(1, capacity)).cast("int"))))
        moves = cells.join(wants.select(*GROUP, "homes"), GROUP, "left").withColumn("home", F.get("homes", F.pmod(F.col("shard"), F.size("homes"))))
        settled = F.exists("homes", lambda h: h["shard"] == F.col("shard"))
        moves = moves.withColumn("to", F.col("home.shard")).withColumn("goes", F.coalesce(~settled & (F.col("n") <= F.col("home.n")), F.lit(False)))
        asked = {r["to"]: r["n"] for r in moves.filter("goes").groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if sum(min(v, room[s]) for s, v in asked.items()) <= LEAST_MOVED * total:
            break
        share = F.least(F.lit(1.0), _per_shard(room, F.col("to")) / _per_shard({s: asked.get(s, 1) for s in room}, F.col("to")))
        chance = F.pmod(F.xxhash64(*GROUP, "shard", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)  # rounds parts of a row up or down
        moves = moves.withColumn("moved", F.when(F.col("goes"), F.least("n", F.floor(F.col("n") * share + chance))).otherwise(F.lit(0)).cast("long"))
        parts = F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n"))))
        cells = durable(moves.select(*GROUP, parts.alias("p")).select(*GROUP, "p.shard", "p.n").filter("n > 0").groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")), "cells")
    return cells


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, n_copies of every row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("g1"), F.xxhash64(F.lit("g2"), t).alias("g2"))
    base = durable(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    groups = durable(base.groupBy(*GROUP).agg(F.count("*").alias("n_copies")).filter("n_copies > 1"), "groups")
    total = base.count()
    copies = spread_join(base, groups.withColumn("n", F.col("n_copies")), GROUP, total, how="left")
    all_rows = durable(copies.withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("long"))), "grouped")
    quota = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}
    linked, single = all_rows.filter("n_copies > 1"), all_rows.filter("n_copies = 1")

    start = F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")
    cells = durable(linked.groupBy(*GROUP, start.alias("shard")).agg(F.count("*").alias("n")), "cells")
    cells = propagate(cells, n_shards, total // n_shards, total, rounds)

    # Members take the places of their group's cells in order, the fullest cell first.
    placed = ranked(linked, [*GROUP, "doc_id", "row"], "members")
    first = placed.groupBy(*GROUP).agg(F.min("rank").alias("first"))
    places = cells.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("n", "shard")), asc=False).alias("places"), F.sum("n").alias("n"))  # n_shards at most in a list
    places = durable(places.join(first, GROUP), "places")
    at = F.col("rank") - F.col("first")
    upto = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("shard")), lambda acc, c: F.struct(
        (acc["sum"] + c["n"]).alias("sum"), F.when(acc["shard"].isNull() & (at < acc["sum"] + c["n"]), c["shard"]).otherwise(acc["shard"]).alias("shard")))["shard"]
    placed = spread_join(placed, places, GROUP, total).withColumn("shard", upto).drop("places", "first", "rank")
    placed = ranked(placed, ["shard", *GROUP, "doc_id", "row"], "placed")
    held = {s: 0 for s in range(n_shards)} | {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    before = {s: sum(held[x] for x in range(s)) for s in range(n_shards)}
    placed = placed.withColumn("slot", F.col("rank") - _per_shard(before, F.col("shard")))
    stays = F.col("slot") < _per_shard(quota, F.col("shard"))

    # The others fill what is left of the quotas, members of crowded shards first so that they stay together.
    columns = ["doc_id", "size", "text_crc32", "n_copies", *GROUP, "row"]
    others = placed.filter(~stays).select(*columns).union(single.select(*columns)).withColumn("alone", F.col("n_copies") == 1)
    others = ranked(others, ["alone", *GROUP, "doc_id", "row"], "others")
    ends, upto = [], 0
    for s in range(n_shards):
        upto += quota[s] - min(quota[s], held[s])
        ends.append(upto)
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    begins = {s: (ends[s - 1] if s else 0) - min(quota[s], held[s]) for s in range(n_shards)}
    others = others.withColumn("shard", shard).withColumn("slot", F.col("rank") - _per_shard(begins, F.col("shard")))
    out = ["doc_id", "size", "text_crc32", "shard", "slot", "n_copies"]
    return placed.filter(stays).select(*out).union(others.select(*out))
