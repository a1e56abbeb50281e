"""Mixing sources to target weights with a low-discrepancy schedule.

Targets are filled to the weights, stopping at a multiple of each source's size. Every
source's documents, in hashed order, form one stream of tokens that is cut into blocks
of equal length. Golden-ratio points are mapped through the cumulative targets, in blocks; the
j-th point that falls to a source is its j-th slot, which takes the source's next
block, going round again when the stream is through, until the target is met. What the slots
take is what the mix takes, and their order is its order. Columns only; no Python on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights by rank of the source (code points ascending, null last), repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its size.
MOST = 3
#: Slots of the schedule, about: blocks are the total size over this, so that the schedule stays as long as inputs grow.
SLOTS = 1 << 18
#: Bins of the unit interval that bring points and cumulative weights together.
BINS = 4096
GOLDEN = 0.6180339887498949
#: Points for each block of the mix: n points leave no gap of 1.9 / n, so that with these each block's share of the interval has one.
POINTS = 3
#: Documents that one running sum goes over, about.
SHARD = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target (double) to (source, source_size), one row for each source.

    Water filling in closed form: sources in order of most * size / weight; the first k stop at
    their limit, k the least for which the common level stays within the next limit. The windows go over one
    row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("_w", F.sum("weight").over(everything))
    s = s.withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if all sources before this one stop at their limits
    s = s.withColumn("rate", (F.col("total") - F.col("spent")) / (F.col("_w") - F.col("gone")))
    common = F.min(F.when(F.col("rate") <= F.col("level"), F.struct("level", "rate"))).over(everything)
    s = s.withColumn("common", common["rate"])
    target = F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("common") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds at (long), where each document starts in its source's stream.

    Order is by shard and hash. Sums go over shards first, so that a source with most of
    the rows is spread over as many tasks as it has shards.
    """
    count = sources.select("key", (F.ceil(F.col("n") / SHARD)).cast("long").alias("shards"))
    dealt = sized.join(count, "key").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.col("shards")))
    sums = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"))
    offset = F.coalesce(F.sum("shard_size").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("shard_at", offset).drop("shard_size")
    inner = Window.partitionBy("key", "shard").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    started = dealt.withColumn("inner_at", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return started.join(sums, ["key", "shard"]).withColumn("at", F.col("shard_at") + F.col("inner_at")).drop("shard", "shards", "shard_at", "inner_at")


def schedule(sources: DataFrame, block: Column, slots: int = SLOTS) -> DataFrame:
    """(key, rank, slot, block, epoch, tokens, block_size): the slots that sources take, in the order of slot.

    slot is the number of the golden-ratio point, of `slots` points or as many as fill all targets. tokens is
    all of the block, but for a source's last slot.
    """
    spark = sources.sparkSession
    s = sources.where("target > 0 and source_size > 0").withColumn("block_size", block).withColumn("wanted", F.round("target").cast("long"))
    s = s.withColumn("wanted", F.least("wanted", MOST * F.col("source_size")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_size")).cast("long"))
    s = s.withColumn("rest", F.col("wanted") % F.col("source_size")).withColumn("epochs", F.expr("wanted div source_size"))
    # the target in blocks, each round's last one and the last of all being shorter
    s = s.withColumn("ranks", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block_size")).cast("long")).where("ranks > 0")
    s = s.withColumn("to", F.sum("ranks").over(Window.orderBy("key"))).withColumn("from", F.col("to") - F.col("ranks"))
    total = int(s.agg(F.sum("ranks").alias("n")).first()["n"] or 0)
    bin_of = lambda x: F.floor(x / F.lit(float(max(total, 1))) * BINS)
    bins = F.sequence(F.greatest(bin_of(F.col("from")) - 1, F.lit(0)), F.least(bin_of(F.col("to")) + 1, F.lit(BINS - 1)))
    place = s.select("key", "from", "to", F.explode(bins).alias("bin"))
    x = F.col("id") * F.lit(GOLDEN)
    points = spark.range(max(slots, POINTS * total)).withColumn("u", x - F.floor(x)).withColumn("bin", F.floor(F.col("u") * BINS)).withColumn("u", F.col("u") * total)
    fallen = points.join(place, "bin").where("u >= from and u < to").select("key", F.col("id").alias("slot"))
    # ranks within a source, by segments of the sequence: no task holds all slots of a source
    segment = F.expr("slot div 8192")
    fallen = fallen.withColumn("segment", segment)
    held = fallen.groupBy("key", "segment").agg(F.count("*").alias("n"))
    held = held.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = fallen.join(held, ["key", "segment"]).select("key", "slot", (F.col("first") + F.row_number().over(Window.partitionBy("key", "segment").orderBy("slot")) - 1).alias("rank"))
    full = F.least(F.col("block_size"), F.col("source_size") - F.col("block") * F.col("block_size"))
    # points beyond the target take nothing
    out = ranked.join(s.select("key", "ranks", "blocks", "block_size", "source_size", "epochs", "rest"), "key").where("rank < ranks")
    out = out.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("epoch", F.expr("rank div blocks"))
    tokens = F.when(F.col("epoch") < F.col("epochs"), full).otherwise(F.least(full, F.col("rest") - F.col("block") * F.col("block_size")))
    return out.select("key", "rank", "slot", "block", "epoch", tokens.alias("tokens"), "block_size")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, at, slots) of every row of docs (doc_id, text, source).

    slots are those at which the mix begins to take the document, one for each round through its source;
    at is its place in the source's stream, which orders documents of a slot. taken counts the words that the mix takes of the document, repeats counted; at most
    `most` times its size. A null text has size 0; a null source is the last one;
    repeated rows each have their own place in the stream; a table without words takes nothing.
    """
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    # null sources need a key that joins
    sized = sized.withColumn("key", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))))
    grouped = sized.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aimed = targets(grouped.select("source", "source_size"), weights, most)
    sources = stored(grouped.join(aimed.select("source", "target"), grouped["source"].eqNullSafe(aimed["source"])).select("key", "n", "source_size", "target"), "sources")
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    block = max(1, -(-int(total) // slots))
    plan = schedule(sources, F.lit(block).cast("long"), slots)
    placed = streams(sized, sources)
    first, last = F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")
    pieces = placed.where("size > 0").select("key", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * block) - F.col("block") * block
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    pieces = pieces.select("key", "at", "block", start.alias("start"), end.alias("end"))
    words = F.greatest(F.lit(0), F.least(F.col("end"), F.col("tokens")) - F.col("start"))
    took = pieces.join(plan.select("key", "block", "epoch", "slot", "tokens"), ["key", "block"]).withColumn("words", words).where("words > 0")
    took = took.groupBy("key", "at", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    took = took.groupBy("key", "at").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))
    # offsets are a document's own where it has words
    of = placed.join(took.withColumnRenamed("at", "_at").withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left")
    out = of.join(sources.select(F.col("key").alias("_k"), "source_size", "target"), F.col("key") == F.col("_k"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), placed["at"], F.coalesce("slots", F.array().cast("array<long>")).alias("slots"))
