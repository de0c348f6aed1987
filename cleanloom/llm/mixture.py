"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Targets: each source's weighted share of the wanted total, capped at a multiple of its size, the excess shared again among
the others until none is above its cap (solved in closed form over the sources in the order of cap over weight).
Draws: a source's documents fall into about sqrt(n) blocks by hash, a few for each output shard at least. Whole passes take
every block; the rest of the target takes blocks in a permuted order; what these leave open goes on to the later blocks,
round by round without the documents that are larger than it, until no document fits; one more is taken where that brings
the source nearer to its target. So no step orders more than about sqrt(n) rows of one source together.
Shards: the block draws of all sources are split over the output shards by a binary tree. A node draws how many blocks of
each source go left from the multivariate hypergeometric distribution, so that shards hold equally many blocks and each is a
fair draw of the mix; each source then deals its permuted blocks to the shards by these counts, without overlap. Within a
shard, the blocks of all sources follow one another in a random order, and the documents within each block in another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleanloom.llm._common import cut, joined, word_count

#: Blocks of a source for each shard at least, where it has so many documents.
BLOCKS = 8


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, rank, source_size, n_docs and target for each source of sizes (source, size).

    Sources are ranked by code point, null last, and take the weights in turn. Only this table of one row a source is
    ordered as a whole.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy(F.lit(1))
    src = src.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights) + 1)
    src = src.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.sum(c).over(by_cap) - F.col(c)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    src = src.withColumn("level", (total - before("cap")) / (F.sum("weight").over(whole) - before("weight")))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))
    src = src.withColumn("level", F.min(fits).over(whole)["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return src.select("source", "rank", "source_size", "n_docs", target.alias("target"))


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def split_over_shards(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, rank and n: how many of each source's block draws (rank, quota) go to each shard.

    A node is a row with its first shard, its number of shards and the quotas of all sources, one small struct each. Its
    blocks are gone through once: a block goes left with the chance of left places over blocks still to come, which is an exact draw.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("quota").alias("n")))).alias("quotas"))
    nodes = nodes.select(F.lit(0).alias("shard"), F.lit(shards).alias("count"), "quotas")
    for _ in range((shards - 1).bit_length()):
        n_all = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["n"])
        left_shards = F.ceil(F.col("count") / 2).cast("int")

        def one(state, q):
            def step(s, i):
                left = _uniform(F.lit(seed), F.col("shard"), F.col("count"), q["rank"], i) * s["all"] < s["places"]
                took = F.when(left, F.lit(1)).otherwise(F.lit(0)).cast("long")
                return F.struct((s["all"] - 1).alias("all"), (s["places"] - took).alias("places"), (s["took"] + took).alias("took"))

            first = F.struct(state["all"].alias("all"), state["places"].alias("places"), F.lit(0).cast("long").alias("took"))
            done = F.when(q["n"] > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(q["n"], F.lit(1))), first, step)).otherwise(first)
            return F.struct(done["all"].alias("all"), done["places"].alias("places"), F.array_append(state["left"], F.struct(q["rank"].alias("rank"), done["took"].alias("n"))).alias("left"))

        start = F.struct(n_all.alias("all"), F.floor(n_all * left_shards / F.col("count")).cast("long").alias("places"), F.filter("quotas", lambda q: F.lit(False)).alias("left"))
        nodes = nodes.withColumn("left", F.aggregate("quotas", start, one)["left"])
        right = F.zip_with("quotas", "left", lambda q, x: F.struct(q["rank"].alias("rank"), (q["n"] - x["n"]).alias("n")))
        halves = F.array(F.struct("shard", left_shards.alias("count"), F.col("left").alias("quotas")), F.struct((F.col("shard") + left_shards).alias("shard"), (F.col("count") - left_shards).alias("count"), right.alias("quotas")))
        nodes = nodes.select(F.explode(halves).alias("s")).select("s.*").where("count > 0")
    leaves = nodes.select("shard", F.explode("quotas").alias("q"))
    return leaves.select("shard", "q.rank", "q.n").where("n > 0")


def _fill(held: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """rank, block and row of the documents that fill what the whole blocks leave open of each source's rest.

    A round takes blocks in permuted order, and documents of the one that crosses in permuted order, from those that are no larger
    than the room. The next goes on with the room left; each takes a document of every source that has one that fits.
    """
    room = F.first("rest") - F.coalesce(F.sum(F.when(F.col("whole"), F.col("words"))), F.lit(0))
    rooms = blocks.groupBy("rank").agg(room.alias("room"))
    left = joined(held.select("rank", "block", "row", "size", "key"), blocks.where("not whole").select("rank", "block").join(rooms, "rank"), ["rank", "block"], "inner")
    left = cut(left.where("size > 0 and size <= room"))
    taken = left.where("false").select("rank", "block", "row")
    by_block = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_key = Window.partitionBy("rank", "block").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not left.isEmpty():
        sums = left.groupBy("rank", "block").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("before", F.sum("words").over(by_block) - F.col("words"))
        tried = joined(left, sums.select("rank", "block", "before"), ["rank", "block"], "inner")
        # later blocks begin beyond the room of the one that crosses, so that none of their documents fits
        tried = cut(tried.withColumn("taken", F.col("before") + F.sum("size").over(by_key) <= F.col("room")).drop("before"))
        taken = taken.unionByName(tried.where("taken").select("rank", "block", "row"))
        spent = tried.where("taken").groupBy("rank").agg(F.sum("size").alias("spent"))
        left = joined(tried.where("not taken").drop("taken"), spent, ["rank"], "inner").withColumn("room", F.col("room") - F.col("spent")).drop("spent")
        left = cut(left.where("size <= room"))
    return taken


def _nearest(held: DataFrame, taken: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """rank, block and row of one more document of each source that brings it nearer to its target, where there is one."""
    spent = taken.groupBy("rank").agg(F.sum("words").alias("spent"))
    rooms = joined(plan.select("rank", "rest"), spent, ["rank"], "left").select("rank", (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("room"))
    free = held.select("rank", "block", "row", "size", "key", "passes").where((F.col("size") > 0) & (F.col("passes") + 1 <= most))
    free = joined(free, rooms.where("room > 0"), ["rank"], "inner").where("size < 2 * room")
    free = joined(free, taken.where("row is not null").select("row"), ["row"], "left_anti")
    free = joined(free, taken.where("row is null").select("rank", "block"), ["rank", "block"], "left_anti")
    best = F.min(F.struct(F.abs(F.col("size") - F.col("room")).alias("off"), "key", "row", "block"))
    return free.groupBy("rank").agg(best.alias("best")).select("rank", "best.block", "best.row")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and draws for every row of docs (doc_id, text, source).

    size counts the text's words, 0 for null, however long it is. taken is copies * size; copies are at most ceil(most).
    draws lists for each copy its output shard, and where it stands there: ordered by `block`, then by `place`. A source's
    taken words differ from its target by no more than any single further document would. Rows that repeat are drawn one
    by one; a null source is a source of its own. Sources without words have target 0. An empty table gives an empty
    result. Other columns are ignored. The result depends on the rows and the seed only.
    """
    if shards < 1:
        raise ValueError("there must be one shard or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    src = cut(source_targets(rows, weights, share, most))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = src.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    n_blocks = F.least(F.col("n_docs"), F.greatest(F.ceil(F.sqrt("n_docs")), F.lit(BLOCKS * shards))).cast("long")
    plan = plan.withColumn("n_blocks", n_blocks)
    held = joined(rows.withColumn("no_source", F.col("source").isNull()).fillna({"source": ""}), plan.withColumn("no_source", F.col("source").isNull()).fillna({"source": ""}), ["source", "no_source"], "inner")
    held = held.withColumn("source", F.when(~F.col("no_source"), F.col("source"))).drop("no_source")
    held = held.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size", "source"))
    held = held.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("n_blocks")))
    blocks = held.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("upto", F.sum("words").over(order))
    blocks = cut(blocks.withColumn("whole", F.col("upto") <= F.col("rest")))
    fill = cut(joined(held.select("row", "size"), _fill(held, blocks, seed), ["row"], "inner"))
    none = F.lit(None).cast("long")
    taken = fill.select("rank", "block", "row", F.col("size").alias("words")).unionByName(blocks.where("whole").select("rank", "block", none.alias("row"), "words"))
    extra = cut(fill.select("rank", "block", "row").unionByName(_nearest(held, taken, plan, math.ceil(most))))
    part = extra.groupBy("rank", "block").agg(F.lit(True).alias("part"))
    blocks = cut(blocks.join(part, ["rank", "block"], "left"))
    extra = extra.select("row", F.lit(1).cast("long").alias("extra"))
    turns = F.col("passes") + F.when(F.col("whole") | F.col("part").isNotNull(), 1).otherwise(0)
    draws = blocks.where(turns > 0).select("rank", "block", F.explode(F.sequence(F.lit(1).cast("long"), turns)).alias("turn"))
    dealt = split_over_shards(draws.groupBy("rank").agg(F.count("*").alias("quota")), shards, seed)
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = dealt.withColumn("upto", upto).select("rank", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("place"))
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 3), "rank", "turn", "block"), "turn", "block")).cast("long")
    dealt = draws.withColumn("place", place).join(places, ["rank", "place"])
    dealt = dealt.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("turns"))
    per_block = blocks.select("rank", "block", F.when(F.col("whole"), 1).otherwise(0).cast("long").alias("more")).join(dealt, ["rank", "block"], "left")
    out = joined(held, per_block, ["rank", "block"], "inner")
    out = joined(out, extra, ["row"], "left")
    out = out.withColumn("copies", F.col("passes") + F.col("more") + F.coalesce("extra", F.lit(0)))
    block = lambda t: F.xxhash64(F.lit(seed + 4), "rank", "block", t["turn"]).alias("block")
    standing = lambda t: F.struct(t["shard"].alias("shard"), block(t), F.xxhash64(F.lit(seed + 5), "key", "row", t["turn"]).alias("place"))
    drawn = F.when(F.col("copies") > 0, F.transform(F.slice("turns", 1, F.greatest(F.col("copies"), F.lit(1)).cast("int")), standing))
    none = F.array().cast("array<struct<shard:int,block:bigint,place:bigint>>")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.coalesce(drawn, none).alias("draws"))


def shard_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy drawn, with its shard, in the shards' order: blocks in random order, shuffled within.

    Rows are dealt by ranges of shard and block, so that a shard may be larger than a task.
    """
    copies = mixed.select("*", F.explode("draws").alias("draw")).drop("draws").select("*", "draw.shard", "draw.block", "draw.place").drop("draw")
    return copies.repartitionByRange("shard", "block").sortWithinPartitions("shard", "block", "place", "doc_id").drop("block", "place")
