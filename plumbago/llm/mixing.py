"""Mixing sources to target weights.

Sizes are words. Each source has a target number of words: its share, by
weight, of a multiple of all sizes, but at most `repeats` times its own size;
what is above is shared out again by weight among the sources below their
limit, until none is above.

Blocks. A source's documents are dealt by a hash of id and text into a power of
two of blocks, about DOCS_A_BLOCK documents each; the order of blocks is thus a
random permutation of the documents. The source is drawn in passes over its
blocks: whole passes, then blocks in order up to the target; the block that the
target falls into is drawn in part, its documents from the longest to the
shortest, each that still fits. (Where such a block is very large it is cut
into blocks once more, the same way, before.) No document is in a pass twice.

Splitting tree. The draws of all sources are dealt to output shards exactly: at
each node the shards are halved, and the number of each source's draws that go
left follows the multivariate hypergeometric distribution, sampled source by
source from hash-driven uniform numbers, so every shard has the mixture that a
shuffle of all draws would give it, and all quotas stay whole. A shard takes
consecutive, hence disjoint, draws of each source, and is shuffled locally by
hash. Reruns agree, since every random number is a hash of seed and place.

Everything is native: DataFrame operations and array functions.

Edge cases: null and empty texts have size 0, weigh nothing and are drawn with
their block; a null source is a source, last in order; sources without words
have target 0; equal rows (id and text) are drawn together; null ids are drawn
like others; an empty table gives an empty mix; further columns are
ignored by mix and passed on by mixed_documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.llm.common import bind, words, written

WEIGHTS, MULTIPLE, REPEATS = (5, 2, 1), 1.5, 2
DOCS_A_BLOCK, MOST_BLOCKS, SEED = 32, 1 << 16, 11


def _uniform(*what: Column) -> Column:
    """A number in (0, 1), the same for the same values."""
    return (F.shiftrightunsigned(F.xxhash64(*what), 11) + 0.5) / float(1 << 53)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and a hash that orders the documents."""
    key = F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), key.alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, multiple: float = MULTIPLE, repeats: int = REPEATS) -> DataFrame:
    """source (by code point, null last), rank, docs, source_size and target.

    Sources are ordered by what they weigh for their size: those with the
    largest ratio reach their limit first. Over that order, the sources at
    their limit are a prefix, and the level of the rest follows from sums.
    """
    each = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = each.withColumn("rank", F.row_number().over(everything) - 1)
    ranked = ranked.withColumn("weight", F.get(F.lit(list(weights)), F.col("rank") % len(weights)).cast("double"))
    limit = F.col("source_size") * float(repeats)
    order = Window.orderBy((limit / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy()) * multiple
    left = total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", F.greatest(F.lit(0.0), left / weight_left)).withColumn("full", F.col("level") * F.col("weight") >= limit)
    # The level of the first source that is not full holds for all after it.
    level = F.min_by("level", F.struct((limit / F.col("weight")).alias("l"), "rank")).over(Window.partitionBy("full"))
    return levels.select("source", "rank", "docs", "source_size", F.when(F.col("full"), limit).otherwise(level * F.col("weight")).alias("target"))


def _blocks(docs: Column) -> Column:
    """log2 of the number of blocks."""
    return F.least(F.lit(int(math.log2(MOST_BLOCKS))), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(docs, F.lit(1)) / DOCS_A_BLOCK)))).cast("int")


def _nth(key: Column, skip: Column, bits: Column) -> Column:
    """The block of a hash: the number in `bits` of its bits, after the first `skip`."""
    shifted = F.call_function("shiftrightunsigned", F.call_function("shiftleft", key, skip), 64 - bits)
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(shifted)


def _edge(rows: DataFrame) -> DataFrame:
    """Of each rank, the block that `rest` falls into: rank, block, docs and what is left of rest there."""
    summed = rows.groupBy("rank", "block").agg(F.sum("size").alias("n"), F.count("*").alias("docs"), F.first("rest").alias("rest"))
    order = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    there = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))
    return summed.where(there).select("rank", "block", "docs", (F.col("rest") - F.col("before")).alias("rest"))


def draws(sized: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is drawn. Of every document: doc_id, source, rank, size, key, block, bits and passes, how often it is
    drawn. Of every source: rank and quota, the number of blocks drawn."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = goals.select(F.col("source").alias("p_source"), "rank", _blocks(F.col("docs")).alias("bits"), whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))
    placed = sized.join(plan, sized.source.eqNullSafe(plan.p_source)).drop("p_source").withColumn("block", _nth(F.col("key"), F.lit(0), F.col("bits")))

    edge = written(_edge(placed).select(F.col("rank").alias("e_rank"), F.col("block").alias("edge"), _blocks(F.col("docs")).alias("more"), F.col("rest").alias("edge_rest")), "edges")
    at_edge = placed.drop("rest").join(edge, (F.col("rank") == F.col("e_rank")) & (F.col("block") == F.col("edge")))
    at_edge = at_edge.withColumns({"block": _nth(F.col("key"), F.col("bits"), F.col("more")), "rest": F.col("edge_rest")})
    inner = written(_edge(at_edge).select(F.col("rank").alias("i_rank"), F.col("block").alias("inner"), F.col("rest").alias("inner_rest")), "inner-edges")

    # Of the last block, the documents that fit, from the longest on. Equal rows share a key and count as one.
    last = at_edge.join(inner, (F.col("rank") == F.col("i_rank")) & (F.col("block") == F.col("inner")))
    last = last.groupBy("rank", "key").agg(F.sum("size").alias("size"), F.first("inner_rest").alias("rest"))
    last = last.groupBy("rank").agg(F.first("rest").alias("rest"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "key"))).alias("docs"))
    start = F.struct(F.col("rest").cast("double").alias("left"), F.array().cast("array<bigint>").alias("keys"))
    fit = lambda a, d: F.when(-d["minus"] <= a["left"], F.struct((a["left"] + d["minus"]).alias("left"), F.concat(a["keys"], F.array(d["key"])).alias("keys"))).otherwise(a)
    fitted = written(last.select(F.col("rank").alias("f_rank"), F.explode(F.aggregate("docs", start, fit)["keys"]).alias("f_key")), "fitted")

    known = placed.join(edge, F.col("rank") == F.col("e_rank"), "left").join(inner, F.col("rank") == F.col("i_rank"), "left")
    known = known.join(fitted, (F.col("rank") == F.col("f_rank")) & (F.col("key") == F.col("f_key")), "left")
    second = _nth(F.col("key"), F.col("bits"), F.coalesce("more", F.lit(0)))
    partly = F.when(F.col("edge").isNull() | (F.col("block") > F.col("edge")), 0).when(F.col("block") < F.col("edge"), 1)
    partly = partly.when(F.col("inner").isNull() | (second > F.col("inner")), 0).when(second < F.col("inner"), 1).otherwise(F.col("f_key").isNotNull().cast("int"))
    drawn = known.select("doc_id", "source", "rank", "size", "key", "block", "bits", (F.col("whole") + partly).cast("long").alias("passes"))
    blocks = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    quota = plan.join(edge, F.col("rank") == F.col("e_rank"), "left").select("rank", (F.col("whole") * blocks + F.coalesce(F.col("edge") + 1, F.lit(0))).cast("long").alias("quota"))
    return drawn, quota


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 10 and the product below it."""
    x = n + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    product = F.lit(1.0)
    for k in range(1, 11):
        product = product * (n + float(k))
    return series - F.log(product)


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` draws without return are good: the u-quantile, by summing chances from nine deviations below the mean."""

    def sample(s: Column) -> Column:
        k, m, n = s["k"], s["m"], s["n"]
        chance = lambda x: F.exp(_log_factorial(k) - _log_factorial(x) - _log_factorial(k - x) + _log_factorial(m) - _log_factorial(n - x) - _log_factorial(m - n + x) - _log_factorial(k + m) + _log_factorial(n) + _log_factorial(k + m - n))
        first = F.greatest(F.lit(0.0), n - m, F.floor(s["mean"] - 9 * s["sd"] - 9))
        last = F.least(k, n, F.ceil(s["mean"] + 9 * s["sd"] + 9))

        def walk(b: Column) -> Column:
            start = bind(chance(b["a"]), lambda p: F.struct(b["a"].alias("x"), p.alias("p"), p.alias("c")))

            def step(t: Column, x: Column) -> Column:
                p = t["p"] * (k - x + 1) * (n - x + 1) / (x * (m - n + x))
                return F.when(t["c"] >= s["u"], t).otherwise(F.struct(x.alias("x"), p.alias("p"), (t["c"] + p).alias("c")))

            counts = F.when(b["z"] > b["a"], F.transform(F.sequence((b["a"] + 1).cast("long"), b["z"].cast("long")), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))
            return F.aggregate(counts, start, step, lambda t: t["x"])

        return bind(F.struct(first.cast("double").alias("a"), last.cast("double").alias("z")), walk)

    k, m, n = good.cast("double"), bad.cast("double"), drawn.cast("double")
    everything = F.greatest(k + m, F.lit(1.0))
    share = n / everything
    spread = F.sqrt(F.greatest(F.lit(0.0), share * k * (m / everything) * (1 - share) * everything / F.greatest(everything - 1, F.lit(1.0))))
    return bind(F.struct(k.alias("k"), m.alias("m"), n.alias("n"), (share * k).alias("mean"), spread.alias("sd"), u.alias("u")), sample).cast("long")


def split(quota: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, rank, start, n): the draws start.. of each source that each shard takes.

    Below a node stand the counts of its sources in one array, so its size is
    the number of sources; the tree's nodes are rows.
    """
    one = lambda c: F.struct(F.col("rank").cast("int").alias("rank"), c.cast("long").alias("n"))
    tree = quota.agg(F.array_sort(F.collect_list(one(F.col("quota")))).alias("counts")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "counts")
    total = F.aggregate(F.col("counts"), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        tree = tree.withColumns({"mid": F.floor((F.col("low") + F.col("high")) / 2).cast("int"), "draws": total})
        # Shards get equal numbers of draws, the first ones one more where they don't divide.
        capacity = F.floor(F.col("draws") * (F.col("mid") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1))).cast("long")
        start = F.struct(F.col("room").alias("room"), F.col("draws").alias("rest"), F.array().cast("array<bigint>").alias("left"))

        def take(a: Column, c: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("low"), c["rank"])
            go = hypergeometric(c["n"], a["rest"] - c["n"], a["room"], u)
            return bind(go, lambda x: F.struct((a["room"] - x).alias("room"), (a["rest"] - c["n"]).alias("rest"), F.concat(a["left"], F.array(x)).alias("left")))

        tree = tree.withColumn("room", capacity).withColumn("left", F.aggregate("counts", start, take, lambda a: a["left"]))
        left = F.zip_with("counts", "left", lambda c, x: F.struct(c["rank"].alias("rank"), x.alias("n")))
        right = F.zip_with("counts", "left", lambda c, x: F.struct(c["rank"].alias("rank"), (c["n"] - x).alias("n")))
        halves = F.array(F.struct("low", F.col("mid").alias("high"), left.alias("counts")), F.struct(F.col("mid").alias("low"), "high", right.alias("counts")))
        whole = F.array(F.struct("low", "high", "counts"))
        tree = tree.select(F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(whole)).alias("t")).select("t.*")
    leaf = tree.select(F.col("low").alias("shard"), F.explode("counts").alias("c")).select("shard", "c.rank", "c.n")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mix(docs: DataFrame, shards: int | None = None, weights: tuple[int, ...] = WEIGHTS, multiple: float = MULTIPLE, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mixture, and the documents.

    Mixture: a row for each time a document is drawn: doc_id, key, source,
    size, pass_no, shard, place (a hash to order the shard by). Documents:
    doc_id, key, source, size, source_size, target.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    goals = written(targets(sized, weights, multiple, repeats), "targets")
    drawn, quota = draws(sized, goals)
    shares = split(written(quota, "quotas"), n)
    block_of = shares.select("shard", F.col("rank").alias("d_rank"), F.explode(F.when(F.col("n") > 0, F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))).alias("draw"))
    every = drawn.where("passes > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    every = every.withColumn("nth", F.col("pass_no") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) + F.col("block"))
    mixture = every.join(written(block_of, "block-shards"), (F.col("rank") == F.col("d_rank")) & (F.col("nth") == F.col("draw")))
    mixture = mixture.select("doc_id", "key", "source", "size", "pass_no", "shard", F.xxhash64(F.lit(SEED), "shard", "key", "pass_no").alias("place"))
    known = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    return mixture, sized.join(known, sized.source.eqNullSafe(known.g_source)).drop("g_source")


def taken(mixture: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (of mix) with taken, the words that the mixture takes of each, repeats counted."""
    often = mixture.groupBy(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key")).agg((F.max("pass_no") + 1).alias("passes"))
    joined = rows.join(often, rows.doc_id.eqNullSafe(often.m_id) & (rows.key == often.m_key), "left")
    return joined.withColumn("taken", F.col("size") * F.coalesce("passes", F.lit(0).cast("long"))).drop("m_id", "m_key", "passes")


def mixed_documents(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as they are drawn, shard by shard, each shard in its shuffled order."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixture, _ = mix(docs, n, id_col=id_col, text_col=text_col, source_col=source_col)
    # Equal rows are drawn together: each row of docs meets its draws once. A row travels whole, so that no name clashes.
    drawn = mixture.select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), "shard", "place").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)).alias("own"))
    out = keyed.join(drawn, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("own") == F.col("m_key")))
    return out.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "place").select("row.*")
