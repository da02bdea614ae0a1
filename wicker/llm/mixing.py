"""Mix the sources of a corpus to target weights, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.llm.common import materialize, running_totals, small, words

#: Slots are drawn by a uniform number below this.
UNIT = 1 << 53
#: Blocks of one source that the permutation can address without overflow.
MOST_BLOCKS = 1 << 31


def _uniform(*key) -> Column:
    """A whole number from 0 to UNIT - 1 that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The words that each source gives to the mix.

    ``sizes`` has ``source, source_size``. Sources in code point order, null
    last, take ``weights`` in turn and share ``share`` times all words by
    weight; a source stops at ``limit`` times its own size and what is over is
    shared again by weight among the others until none is above. That process
    ends where every target is min(limit * size, level * weight) for one level,
    which is found here from prefix sums over the sources ordered by the level
    at which each of them is full. Adds ``weight, target``.
    """
    everything = Window.partitionBy(F.lit(0))  # one row per source
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", limit * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("weight"))
    by_level = everything.orderBy("_full", "source").rowsBetween(Window.unboundedPreceding, -1)
    all_words = F.sum("source_size").over(everything) * share
    capped, weight_before = F.coalesce(F.sum("_cap").over(by_level), F.lit(0.0)), F.coalesce(F.sum("weight").over(by_level), F.lit(0))
    # The level if all before this source are full and none from here on is.
    level = (all_words - capped) / (F.sum("weight").over(everything) - weight_before)
    out = out.withColumn("_level", level)
    out = out.withColumn("_level", F.coalesce(F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(everything)["_level"], F.max("_full").over(everything)))
    return out.select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("_level") * F.col("weight")).alias("target"))


def masks(n: Column) -> tuple[Column, Column]:
    """For ``permuted``: the largest power of two in n, less one, and the shift by half its bits."""
    bits = F.length(F.bin(n)) - 1
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, F.greatest(F.lit(1), F.floor((bits + 1) / 2).cast("int"))


def permuted(index: Column, n: Column, mask: Column, half: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, evaluated at ``index``; n below 2^31.

    Each round scrambles the numbers below the largest power of two in n by
    invertible steps (odd multiple, xor of the high half), then turns the whole
    range, so that the rest comes under it in the next round.
    """
    one = F.lit(1).cast("long")

    def step(x: Column, r: Column) -> Column:
        y = (x * F.xxhash64(*seed, r).bitwiseAND(mask).bitwiseOR(one) + F.xxhash64(*seed, r + 1).bitwiseAND(mask)).bitwiseAND(mask)
        mixed = y.bitwiseXOR(F.call_function("shiftrightunsigned", y, half))
        return (F.when(x <= mask, mixed).otherwise(x) + F.pmod(F.xxhash64(*seed, r + 2), n)) % n

    return F.aggregate(F.array(*(F.lit(3 * r) for r in range(4))), index, step)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, shard_slots: int = 4096, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """What the mix takes of each document.

    The words of a source, its documents in the order of their ids, are packed
    into blocks of ``block_words``. A source with target t gets round(t / mean
    block) slots, so that all its slots together come within a block of its
    target. Output shards of ``shard_slots`` slots draw their source counts from
    a multinomial distribution with the sources' shares; a last shard holds what
    the draws left short, and draws beyond a source's slots are void. The j-th
    slot of a source takes the block at place j of a pseudorandom permutation
    that is drawn anew after each round through the source; so no block is taken
    more than ``ceil(limit)`` times, and blocks are joined by index alone.

    Returns ``id, source, size, row_hash, row_hash2, source_size, target, taken, pieces``:
    ``taken`` counts words with repeats; ``pieces`` is an array of (from, words,
    times) over the document's words, empty for a document without words. Every
    draw is a hash of its place and ``seed``, so reruns agree.

    Null texts have size 0; a null source is a source of its own; null ids come
    first. Repeated rows are documents of their own. An empty table gives no
    rows. ``block_words`` must keep each source under 2^31 blocks.
    """
    spark = docs.sparkSession
    size = F.size(words(F.col(text_col))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(*docs.columns).alias("row_hash"), F.xxhash64(F.lit(1), *docs.columns).alias("row_hash2"))
    placed = materialize(running_totals(rows, "id", ["row_hash", "row_hash2"], {"size": "start"}, within=["source"]))
    sizes = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    blocks = F.ceil(F.col("source_size") / block_words)
    sizes = sizes.withColumn("blocks", blocks)
    sizes = sizes.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # one row per source
    sizes = sizes.withColumn("rank", F.row_number().over(ranked)).withColumn("to", F.sum("slots").over(ranked))
    mask, half = masks(F.col("blocks"))
    sizes = sizes.withColumn("mask", mask).withColumn("half", half)
    sizes = materialize(sizes.withColumn("fits", F.assert_true(F.col("blocks") < MOST_BLOCKS, F.lit("a source has too many blocks: raise block_words"))))

    all_slots = sizes.agg(F.max("to")).first()[0] or 0
    shards = all_slots // shard_slots
    edge = lambda c: F.floor(c / F.lit(float(max(all_slots, 1))) * F.lit(float(UNIT)))
    spans = sizes.filter("slots > 0").select("rank", edge(F.col("to") - F.col("slots")).alias("lo"), edge(F.col("to")).alias("hi"))
    spans = spans.withColumn("bin", F.explode(F.sequence(F.shiftright("lo", 41), F.shiftright(F.col("hi") - 1, 41))))  # 4096 bins
    draws = spark.range(shards * shard_slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), _uniform(F.lit(seed), F.col("id")).alias("u"))
    drawn = draws.join(spans, (F.shiftright("u", 41) == F.col("bin")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("rank", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per output shard
    counts = drawn.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))
    own = sizes.select("rank", "slots", "blocks", "mask", "half")
    counts = counts.join(own, "rank").select("rank", "blocks", "mask", "half", "first", (F.least(F.col("first") + F.col("n"), F.col("slots")) - F.col("first")).alias("n"))
    short = own.join(drawn.groupBy("rank").agg(F.sum("n").alias("had")), "rank", "left").select("rank", "blocks", "mask", "half", F.coalesce("had", F.lit(0).cast("long")).alias("first"), (F.col("slots") - F.coalesce("had", F.lit(0).cast("long"))).alias("n"))
    tasks = all_slots // 200_000 + 1  # a row of counts is many slots: rows alone would end up in one task
    slots = counts.unionByName(short).filter("n > 0").repartition(tasks, "rank", "first").select("rank", "blocks", "mask", "half", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    slots = slots.withColumn("around", F.floor(F.col("j") / F.col("blocks"))).withColumn("place", F.col("j") % F.col("blocks"))
    taken = slots.select("rank", permuted(*map(F.col, ("place", "blocks", "mask", "half")), F.lit(seed), F.col("rank"), F.col("around")).alias("block")).groupBy("rank", "block").agg(F.count("*").alias("times"))

    known = placed.join(small(sizes.select(F.col("source").alias("_source"), "rank", "source_size", "target")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    full = known.filter("size > 0")
    reach = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    parts = full.withColumn("block", F.explode(reach))
    begin = F.greatest(F.col("block") * block_words, F.col("start"))
    end = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    parts = parts.join(taken, ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))
    piece = F.struct((begin - F.col("start")).alias("from"), (end - begin).alias("words"), F.col("times"))
    keys = ["rank", "start", "id", "source", "size", "row_hash", "row_hash2", "source_size", "target"]
    mixed = parts.groupBy(*keys).agg(F.sum((end - begin) * F.col("times")).alias("taken"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    none = known.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("pieces", F.array().cast(mixed.schema["pieces"].dataType))
    return mixed.unionByName(none.select(*mixed.columns)).drop("rank", "start")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: documents with the words that ``plan`` takes, in the columns of docs.

    A document that is taken twice is there twice; one of which only some blocks
    are taken has those words, joined by single spaces; one that is taken whole
    keeps its text as it was. Documents of which nothing is taken are left out.
    ``n_chars``, if there, is set to the length of the new text.
    """
    most = -(-options.get("limit", 2.0) // 1)
    wanted = plan(docs, id_col, text_col, source_col, **options).filter("taken > 0").select("row_hash", "row_hash2", "pieces")
    hashes = [F.xxhash64(*docs.columns).alias("row_hash"), F.xxhash64(F.lit(1), *docs.columns).alias("row_hash2")]
    texts = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), *hashes).dropDuplicates(["row_hash", "row_hash2"])
    rows = texts.join(wanted, ["row_hash", "row_hash2"]).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(int(most)))))
    rows = rows.withColumn("now", F.filter("pieces", lambda p: p["times"] >= F.col("round"))).filter(F.size("now") > 0)
    rows = rows.withColumn("words", F.when(F.size("now") < F.size("pieces"), words(F.col("text"))))
    part = F.array_join(F.flatten(F.transform("now", lambda p: F.slice("words", (p["from"] + 1).cast("int"), p["words"].cast("int")))), " ")
    rows = rows.withColumn("text", F.when(F.col("words").isNull(), F.col("text")).otherwise(part))
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
