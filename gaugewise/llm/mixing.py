"""Mixing sources to target weights: fixed blocks of tokens, multinomial draws a shard, pseudorandom index permutations.

DataFrame functions only. Every step is a projection, a pre-aggregation, a window over a bounded bucket or a join on
(source, block), of which no key is hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.llm.common import fresh, written

#: Words in a block.
BLOCK = 128
#: Slots in an output shard.
SHARD = 4096
#: Slots that a task numbers and permutes.
SLOTS = 1 << 18
#: The most times a source's words may be taken.
REPEATS = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rounds of the permutations.
ROUNDS = 24


def n_words(text: Column) -> Column:
    """The number of runs other than \\x20 and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of index x under a pseudorandom permutation of 0..n-1 that the key names: swap-or-not rounds.

    In each round x and its mirror image about a pseudorandom point swap or stay together, by a hash of the larger;
    so every round, and the whole, is one-to-one for any n.
    """

    def swap(acc: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), n) - acc, n)
        return F.when(F.xxhash64(F.lit("b"), r, F.greatest(acc, mirror), *key).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds target to a table of source, source_size: the sum of sizes shared by weight, none above `repeats` times its source.

    Sources are weighed in order of code points, null last. The excess is reshared by weight until none is above: with
    the sources in order of size to weight, the first ones are at their limit, and a common level serves the rest. One
    row a source; this is the only step that one task does, and it sees no documents.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last())
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").cast("binary").asc_nulls_last())
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = out.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    common = F.min(F.when(F.col("fits"), F.struct("ratio", "level"))).over(whole)["level"]
    return out.withColumn("common", common).select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.coalesce("common", F.lit(0.0))).alias("target"))


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Packs each source's words into blocks of a fixed length.

    Returns documents (doc_id, source, size, row, start: the place of its first word in the source's stream) and sources
    (source, source_size, blocks). A source's stream is its documents in order of a bucket by hash of id and text, and then of id; the
    stream's positions are sums over buckets plus sums within a bucket. With n documents in all there are about as many
    buckets as one bucket has documents at most, the square root of n, so that no task sorts a whole source.
    """
    sized = written(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    buckets = F.lit(math.isqrt(sized.count()) + 1)
    sized = sized.withColumn("bucket", F.pmod(F.col("mark"), buckets))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    documents = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    documents = documents.select("doc_id", "source", "size", "row", (F.col("before") + F.col("inner")).alias("start"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("blocks", F.ceil(F.col("source_size") / block))
    return written(documents, "mix-documents"), written(sources, "mix-sources")


def _not_above(bounds: Column, x: Column, n: int) -> Column:
    """How many of the n ascending numbers of an array are not above x, by bisection."""
    steps = [1 << b for b in reversed(range(max(n, 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(p) for p in steps]), F.lit(0), lambda so_far, p: F.when(F.get(bounds, so_far + p - 1) <= x, so_far + p).otherwise(so_far))


def drawn(shares: DataFrame, seed: int, shard: int = SHARD, draw: int | None = None) -> DataFrame:
    """The slots of the output: shard, slot, source, block, one row a slot. draw: a seed of the draw alone, else `seed`.

    shares: source, blocks, uses (how many slots the source gets in all). Each slot draws a source by a seeded hash, at
    the odds of `uses`; the counts of these draws by shard are multinomial. They number each source's slots from shard
    to shard. A source that was drawn more often than it has uses gives up its last slots, to those drawn less often,
    so that the totals hold: as many slots change as the draws stray, about the square root of all. A source's k-th
    slot is block k mod blocks under a permutation that the source, the turn and the counts that its shards drew name;
    so the draw chooses the blocks of a turn that is not whole. Slots lie in a shard in the order of the shard's own
    permutation. Slots are dealt evenly over tasks, whatever their source; prefix sums are over groups of shards and
    then within a group, so no task sorts all shards of a source.
    """
    spark = shares.sparkSession
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last())
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.where("uses > 0").select("source", "blocks", "uses", (F.row_number().over(by_name) - 1).alias("i"), F.coalesce(F.sum("uses").over(before(by_name)), F.lit(0)).alias("first"))
    n, sources = (int(x or 0) for x in shares.agg(F.sum("uses"), F.count("*")).first())
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 4096)), -(-n // SLOTS))
    firsts = F.broadcast(shares.agg(F.sort_array(F.collect_list("first")).alias("firsts")))  # one row, a number a source
    slots = spark.range(0, n, 1, parts).join(firsts)
    source = _not_above(F.col("firsts"), F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed if draw is None else draw), "id"), F.lit(max(n, 1))), sources) - 1
    counts = written(slots.select(F.floor(F.col("id") / shard).alias("shard"), source.alias("i")).groupBy("shard", "i").agg(F.count("*").alias("n")), "mix-counts")
    counts = counts.withColumn("group", F.floor(F.col("shard") / (math.isqrt(n // shard + 1) + 1)))
    in_order = before(Window.partitionBy("i").orderBy("group"))
    groups = counts.groupBy("i", "group").agg(F.sum("n").alias("n")).select("i", "group", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("ahead"))
    within = before(Window.partitionBy("i", "group").orderBy("shard"))
    counts = counts.withColumn("k", F.coalesce(F.sum("n").over(within), F.lit(0))).join(groups, ["i", "group"]).withColumn("k", F.col("k") + F.col("ahead"))
    totals = shares.join(counts.groupBy("i").agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("shard", "n")).alias("counts")), "i", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_i = before(Window.partitionBy(F.lit(0)).orderBy("i"))
    spare, lack = F.greatest(F.col("n") - F.col("uses"), F.lit(0)), F.greatest(F.col("uses") - F.col("n"), F.lit(0))
    totals = totals.select("source", "blocks", "uses", "i", F.coalesce("counts", F.lit(0)).alias("counts"), F.col("n").alias("got"), lack.alias("lack"), F.coalesce(F.sum(spare).over(by_i), F.lit(0)).alias("spare_from"), F.coalesce(F.sum(lack).over(by_i), F.lit(0)).alias("lack_from"))
    totals = written(totals, "mix-totals")  # a row a source
    runs = counts.select("shard", "i", "k", "n").join(totals.select("i", "uses", "spare_from"), "i")
    kept = runs.where("k < uses").select("shard", "i", "k", (F.least(F.col("k") + F.col("n"), "uses") - F.col("k")).alias("n"))
    lacking = F.broadcast(totals.where("lack > 0").agg(F.sort_array(F.collect_list(F.struct("lack_from", "i", "got"))).alias("lacks")))
    over = runs.where("k + n > uses").select("shard", F.explode(F.sequence(F.col("spare_from") + F.greatest("k", "uses") - F.col("uses"), F.col("spare_from") + F.col("k") + F.col("n") - 1 - F.col("uses"))).alias("j"))
    to = F.get("lacks", _not_above(F.col("lacks")["lack_from"], F.col("j"), sources) - 1)
    over = over.join(lacking).withColumn("to", to).select("shard", F.col("to.i").alias("i"), (F.col("to.got") + F.col("j") - F.col("to.lack_from")).alias("k"), F.lit(1).cast("long").alias("n"))
    slots = kept.unionByName(over).repartition(parts, "shard", "i").select("shard", "i", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("n") - 1)).alias("k")).join(totals.select("i", "source", "blocks", "counts"), "i")
    turn = F.floor(F.col("k") / F.col("blocks"))
    block = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.lit(seed), F.coalesce("source", F.lit("\0null")), turn, F.col("counts"))
    place = permuted(F.row_number().over(Window.partitionBy("shard").orderBy("i", "k")) - 1, F.count("*").over(Window.partitionBy("shard")), F.lit(seed), F.col("shard"))
    return slots.select("shard", place.alias("slot"), "source", block.alias("block"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK, draw: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of all rows of df: slots (shard, slot, source, block) and documents (doc_id, source, size, source_size, target, start, taken, row).

    Null and empty texts, and texts of white space, have size 0 and nothing is taken from them; null sources are one
    source, the last. Repeated rows are documents of their own; ties of order go by id, a hash of id and text, and the
    place in the input. A long text is as many spans of blocks. A source's words are taken in whole passes over its
    blocks and a part of one more, at most three; words taken come to its target but for a block's rounding. Which
    blocks are in that part follows from the draw of sources (its seed: `draw`, else `seed`). Runs over the same rows
    in the same files agree. An empty table gives empty ones. Other columns of df are not looked at.
    """
    documents, sources = packed(df, id_col, text_col, source_col, block)
    shares = targets(sources.select("source", "source_size")).withColumnRenamed("source", "s").join(sources.select("source", "blocks"), F.col("s").eqNullSafe(F.col("source")))
    uses = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    shares = written(shares.select("source", "source_size", "target", "blocks", uses.alias("uses")), "mix-shares")
    slots = drawn(shares, seed, draw=draw)
    times = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("times"))
    times = written(times, "mix-times")  # a row a block: Spark would take it for as small as the table of sources that it comes from
    spans = documents.where("size > 0").select("row", "source", "start", (F.col("start") + F.col("size")).alias("end"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    spans = spans.withColumn("words", F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block))
    joined = spans.join(times, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    taken = joined.groupBy(F.col("row").alias("r")).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    named = shares.select(F.col("source").alias("s"), "source_size", "target")
    out = documents.join(taken, F.col("row") == F.col("r"), "left").join(named, F.col("source").eqNullSafe(F.col("s")))
    return slots, out.select("doc_id", "source", "size", "source_size", "target", "start", F.coalesce("taken", F.lit(0)).alias("taken"), "row")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """df's rows as often as the mix takes them, whole: taken / size times, rounded up or down by a hash of the id so that sums hold.

    Rows without words are left out: the mix takes no words of theirs. The columns are those of df, which must read
    alike twice, as files do. All else is as in mix().
    """
    row, copies = fresh(df, "row"), fresh(df, "copies")
    _, documents = mix(df, id_col, text_col, source_col, seed)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("round")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    times = documents.where("taken > 0").select(F.col("row").alias(row), F.floor(F.col("taken") / F.col("size") + u).cast("int").alias(copies))
    out = df.withColumn(row, F.monotonically_increasing_id()).join(times.where(F.col(copies) > 0), row)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*df.columns)
