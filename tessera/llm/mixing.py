"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents, in hash order, form a stream of words that repeats up to REPEATS times; the
mix takes the stream up to the source's target and cuts it into blocks. The exact block quotas of
all sources are split between the halves of the output shards, again and again, each split a
multivariate-hypergeometric draw; a shard then draws its quota from the permuted blocks of each
source, disjoint from all others, and shuffles its rows locally. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, documents, whole_text
from tessera.session import settle, shuffle_partitions

#: Weights by place of the source, most uses of a document, shards (a power of two) and blocks.
WEIGHTS, REPEATS, SHARDS, BLOCKS, SEED = (1, 2, 3), 3, 64, 8192, 11
#: Sources of a run that draws as one.
CHUNK = 128
#: Sources up to which the block table may be broadcast; it has at most BLOCKS + sources rows.
BROADCAST_SOURCES = 50_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Inverse-CDF draw: how many of ``marked`` among ``total`` balls come with ``drawn`` of them.

    The smaller of marked and unmarked is counted, on the side of the cut where none is possible,
    so that the recurrence starts at zero.
    """

    def sides(s):
        m = F.least(s["q"], s["n"] - s["q"])
        low = m <= s["n"] - s["l"]
        return F.struct(s["n"].alias("n"), s["q"].alias("q"), s["l"].alias("l"), s["u"].alias("u"), m.alias("m"), low.alias("low"), F.when(low, s["l"]).otherwise(s["n"] - s["l"]).alias("d"))

    def draw(s):
        rest = s["n"] - s["d"]
        none = F.aggregate(
            F.when(s["m"] > 0, F.sequence(F.lit(0).cast("long"), s["m"] - 1)).otherwise(F.array().cast("array<bigint>")),
            F.lit(0.0),
            lambda a, i: a + F.log((rest - i) / (s["n"] - i)),
        )

        def step(a, i):
            more = a["lp"] + F.log((s["m"] - i) * (s["d"] - i) / ((i + 1) * (rest - s["m"] + i + 1)))
            go = (a["cum"] < s["u"]) & (s["d"] > i)
            return F.when(go, _let(more, lambda lp: F.struct(lp.alias("lp"), (a["cum"] + F.exp(lp)).alias("cum"), (i + 1).alias("k")))).otherwise(a)

        def walk(lp):
            start = F.struct(lp.alias("lp"), F.exp(lp).alias("cum"), F.lit(0).cast("long").alias("k"))
            steps = F.when(s["m"] > 0, F.sequence(F.lit(0).cast("long"), s["m"] - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.aggregate(steps, start, step)["k"]

        k = _let(none, walk)
        left = F.when(s["low"], k).otherwise(s["m"] - k)
        return F.when(s["m"] == s["q"], left).otherwise(s["l"] - left)

    given = F.struct(total.alias("n"), marked.alias("q"), drawn.alias("l"), u.alias("u"))
    return _let(_let(given, sides), draw)


def _draws(node: Column, first: Column, quotas: Column, left: Column) -> Column:
    """How many of each quota, of sources numbered from ``first``, go left if ``left`` of all do: one conditional draw a source."""

    def step(a, i):
        u = (F.pmod(F.xxhash64(F.lit(SEED), node, i + first), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
        q = F.element_at(quotas, i)
        return _let(
            hypergeometric(a["n"], q, a["l"], u),
            lambda k: F.struct((a["n"] - q).alias("n"), (a["l"] - k).alias("l"), F.concat(a["out"], F.array(k)).alias("out")),
        )

    start = F.struct(_sum(quotas).alias("n"), left.alias("l"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(quotas)), start, step)["out"]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, q: a + q)


def _left_quotas(node: Column, quotas: Column) -> Column:
    """Block quotas of the left half of a node's shards.

    First the runs of CHUNK sources draw how much of them goes left, then the sources of each run
    share that: the same distribution as source by source, but no array grows with all sources.
    """
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(quotas) - 1) / CHUNK).cast("int")), lambda c: F.slice(quotas, c * CHUNK + 1, F.lit(CHUNK)))

    def within(r: Column) -> Column:
        sums = F.transform(r, _sum)
        return _let(
            _draws(node + F.lit(1 << 40), F.lit(0), sums, F.floor(_sum(sums) / 2).cast("long")),
            lambda lefts: F.flatten(F.transform(F.sequence(F.lit(1), F.size(r)), lambda c: _draws(node, (c - 1) * CHUNK, F.element_at(r, c), F.element_at(lefts, c)))),
        )

    return F.when(F.size(quotas) > 0, _let(runs, within)).otherwise(F.array().cast("array<bigint>"))


def split_quotas(root: DataFrame, shards: int) -> DataFrame:
    """From one row with ``quotas`` (array<long>) to one row per shard: node (0-based) and quotas."""
    tree = root.select(F.lit(0).cast("long").alias("node"), "quotas")
    while shards > 1:
        tree = tree.withColumn("left", _left_quotas(F.col("node") + F.lit(shards).cast("long") * 1_000_003, F.col("quotas")))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        tree = tree.select(F.explode(halves).alias("h")).select("h.node", "h.quotas")
        shards //= 2
    return tree


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """Adds number, weight and target to one row per source with source_size.

    Targets fill up by weight until a source has REPEATS times its size: with sources in order of
    the level at which they are full, the first whose shared level is below its own sets the level.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*map(F.lit, WEIGHTS))
    s = totals.withColumn("number", order).withColumn("weight", F.element_at(weights, ((F.col("number") - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * REPEATS).withColumn("full", F.col("most") / F.col("weight"))
    up = Window.orderBy("full", "number").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("full", "number").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(up), F.lit(0))) / F.sum("weight").over(on)
    s = s.withColumn("share", share)
    level = F.min(F.when(F.col("share") <= F.col("full"), F.struct("full", "number", "share"))).over(everything)["share"]
    return s.withColumn("level", level).select(
        "source", "number", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def place(df: DataFrame, keep: list[str], shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """A row for each use of a document, and one without a shard for each document that isn't used.

    Columns: ``keep`` of ``df``, size, source_size, target, use (0 to REPEATS-1), shard, block (of the
    source's stream), order (sorts a shard's rows at random), and source_no, bucket, row, which together name the row of ``df``.
    Null texts have no words; null sources are one source, the last. Repeated rows are rows of their
    own. Documents without words are used as their place in the stream says and add nothing. Empty
    tables give no rows; columns of ``df`` beyond ``keep`` are ignored.
    """
    spark = df.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    carried = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep)]
    # rows without an id are dealt out by their text
    draw = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(SEED), F.col("doc_id"))).otherwise(F.xxhash64(F.lit(SEED), F.lit(SEED), whole_text()))
    sized = df.select(
        F.col("doc_id").alias("__id"), F.col("source"), words_of(whole_text()).alias("size"), draw.alias("draw"), *carried
    ).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    sums = settle(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = settle(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    total, n_sources = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    block = max(1, -(-total // blocks))
    quota = F.ceil(F.col("target") / block).cast("long")
    # which shard draws which of a source's permuted blocks
    root = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", quota.alias("q")))), lambda x: x["q"]).alias("quotas"))
    leaves = split_quotas(root, shards).select(F.col("node").alias("shard"), F.posexplode("quotas").alias("at", "q"))
    before = F.coalesce(F.sum("q").over(Window.partitionBy("at").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = leaves.select("shard", "at", "q", before.alias("b")).where("q > 0")
    taken = taken.select("shard", (F.col("at") + 1).alias("source_no"), F.explode(F.expr("sequence(b + 1, b + q)")).alias("rank"))
    permuted = sources.where(quota > 0).select(F.col("number").alias("source_no"), F.explode(F.sequence(F.lit(0).cast("long"), quota - 1)).alias("block"))
    by_hash = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(SEED), "source_no", "block"), "block")
    drawn = settle(permuted.withColumn("rank", F.row_number().over(by_hash).cast("long")).join(taken, ["source_no", "rank"]).select("source_no", "block", "shard"))
    if n_sources <= BROADCAST_SOURCES:
        drawn = F.broadcast(drawn)
    # where each document lies in its source's stream
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    joined = sums.withColumnRenamed("source", "s").join(F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources, F.col("s").eqNullSafe(F.col("source")))
    offsets = joined.select(
        F.col("s").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"), "source_size", "target", F.col("number").alias("source_no")
    )
    rows = sized.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")), "left")
    line = Window.partitionBy("source", "bucket").orderBy("draw", F.col("__id").asc_nulls_last(), "size")
    rows = rows.withColumn("row", F.row_number().over(line)).withColumn("start", F.col("offset") + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    at = lambda e: e * F.col("source_size") + F.col("start")
    uses = F.filter(F.array(*(F.lit(e) for e in range(REPEATS))), lambda e: at(e) + F.col("size") / 2 < F.col("target"))
    rows = rows.withColumn("use", F.explode_outer(uses))
    last = F.ceil(F.col("target") / block).cast("long") - 1
    rows = rows.withColumn("block", F.when(F.col("use").isNotNull(), F.least(F.floor(at(F.col("use")) / block).cast("long"), last)))
    rows = rows.join(drawn, ["source_no", "block"], "left")
    back = [F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)]
    order = F.xxhash64(F.lit(SEED + 1), "shard", "draw", "use")
    return rows.select(*back, "size", "source_size", "target", "use", "shard", "block", order.alias("order"), "source_no", "bucket", "row")


def mix(df: DataFrame, shards: int | None = None) -> DataFrame:
    """The mixed rows of ``df``, columns as they are, one partition a shard, each shuffled.

    Without a number (a power of two) there are as many shards as shuffle partitions, rounded up, so
    that a shard is as large as partitions are for the input; which rows are taken doesn't depend on it.
    """
    shards = shards or 1 << (shuffle_partitions(df.sparkSession) - 1).bit_length()
    inner = df.toDF(*(c if c in ("doc_id", "source", "text") else f"__x{i}" for i, c in enumerate(df.columns)))
    placed = place(inner, inner.columns, shards, max(BLOCKS, 16 * shards)).where(F.col("shard").isNotNull())
    out = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "order")
    return out.select(*(F.col(f"`{a}`").alias(b) for a, b in zip(inner.columns, df.columns, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    """taken is what the shards got of a document, and shards where its uses went, one entry each."""
    placed = place(documents(spark, sf_dir), ["doc_id"])
    used = F.sum(F.when(F.col("shard").isNotNull(), F.col("size")).otherwise(0))
    one = placed.groupBy("source_no", "bucket", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), used.alias("taken"),
        F.array_sort(F.collect_list("shard")).alias("shards"),
    )
    return one.select("doc_id", "size", "source_size", "target", "taken", "shards")
