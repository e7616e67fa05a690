"""Exact deduplication by content sort.

Sampled splitters cut the order of (leading bytes, digest, id) into ranges, each range is sorted
externally by whole normalised text, and equal neighbours form a run whose smallest id stays.
A text whose copies fill several ranges (a hot group) is cut by id, so no task holds it whole; its
few per-range runs are combined through a table with at most one row per splitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, documents, whole_text
from tessera.session import shuffle_partitions

#: Bytes of the normalised text that lead the sort key; keys drawn for each splitter.
LEAD, KEYS_PER_RANGE = 24, 20
_HEAD = 2 * LEAD + 64


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(whole_text(text), SPACE + "+", " ")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds __norm, __sha and __key; all keys of one text share their first _HEAD characters."""
    lead = F.rpad(F.hex(F.substring(F.encode("__norm", "UTF-8"), 1, LEAD)), 2 * LEAD, "0")
    number = F.coalesce(F.lpad(F.hex(F.col(id_col).cast("long")), 16, "0"), F.lit("Z"))
    return (
        df.withColumn("__norm", normalised(F.col(text_col)))
        .withColumn("__sha", F.sha2("__norm", 256))
        .withColumn("__key", F.concat(lead, "__sha", number))
    )


def _splitters(keyed: DataFrame, ranges: int) -> tuple[list[str], list[str]]:
    """Range bounds, and the digests of texts whose copies lie in several ranges.

    At most about KEYS_PER_RANGE keys a range come to the driver. A bound inside a text's copies is
    moved to their start, unless an earlier bound of the same text stands there already.
    """
    rows = keyed.count()
    if ranges < 2 or rows < 2:
        return [], []
    fraction = min(1.0, KEYS_PER_RANGE * ranges / rows)
    keys = sorted(r[0] for r in keyed.sample(fraction, seed=17).select("__key").collect())
    bounds: list[str] = []
    for i in range(1, ranges):
        if not keys:
            break
        key = keys[i * len(keys) // ranges]
        for bound in (key[:_HEAD], key):
            if not bounds or bound > bounds[-1]:
                bounds.append(bound)
                break
    return bounds, sorted({b[2 * LEAD : _HEAD] for b in bounds if len(b) > _HEAD})


def _range_of(key: str, bounds: list[str]) -> Column:
    """How many bounds are at most the key, by binary search over one literal."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    table = F.split(F.lit(",".join(bounds)), ",")

    def step(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = (at["lo"] < at["hi"]) & (F.get(table, mid) <= F.col(key))
        left = (at["lo"] < at["hi"]) & ~right
        return F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(left, mid).otherwise(at["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns ``keep`` (default: the id), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is replaced by one space; null
    counts as empty. The smallest id of equal texts stays, ids that are null come last. Of repeated
    rows with the same text and id exactly one stays. Empty tables give no rows. Further columns of
    ``df``, whatever their names, pass through only if listed in ``keep``.
    """
    ranges = shuffle_partitions(df.sparkSession)
    keep = [id_col] if keep is None else keep
    carried = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep) if c != text_col]
    base = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *carried)
    keyed = _keyed(base, "__id", "__text")
    bounds, hot = _splitters(keyed, ranges)
    spread = keyed.withColumn("__range", _range_of("__key", bounds)).drop("__key")
    if text_col in keep:  # the sort key itself stands for the text wherever they agree
        spread = spread.withColumn("__raw", F.when(~F.col("__text").eqNullSafe(F.col("__norm")), F.struct("__text")))
    spread = spread.drop("__text")
    runs = Window.partitionBy("__range", "__norm")
    ordered = runs.orderBy(F.col("__id").asc_nulls_last())
    out = (
        spread.repartitionById(ranges, F.col("__range"))
        .withColumn("__rank", F.row_number().over(ordered))
        .withColumn("__min", F.first("__id").over(ordered))
        .withColumn("__size", F.count(F.lit(1)).over(runs))
    )
    first = (F.col("__rank") == 1)
    if hot:
        where = F.col("__sha").isin(hot)
        best = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__range").alias("at")))
        whole = (
            keyed.where(where)
            .withColumn("__range", _range_of("__key", bounds))
            .groupBy(F.col("__sha").alias("__hot"))
            .agg(best.alias("__best"), F.count(F.lit(1)).alias("__all"))
        )
        # one row per hot text, at most one per splitter
        out = out.join(F.broadcast(whole), F.col("__sha") == F.col("__hot"), "left")
        spans = F.col("__hot").isNotNull()
        keep_id = F.when(spans, F.col("__best.id")).otherwise(F.col("__min"))
        size = F.coalesce("__all", "__size")
        kept = first & (~spans | (F.col("__range") == F.col("__best.at")))
    else:
        keep_id, size, kept = F.col("__min"), F.col("__size"), first
    text = F.when(F.col("__raw").isNotNull(), F.col("__raw.__text")).otherwise(F.col("__norm")) if text_col in keep else None
    back = [text.alias(c) if c == text_col else F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*back, keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("__sha").alias("text_sha256"))


def keep_first(df: DataFrame) -> DataFrame:
    """Drop every row whose text an earlier document has; the columns stay as they are."""
    names = df.columns
    inner = df.toDF(*(f"d{i}" for i in range(len(names))))
    at = {c: f"d{i}" for i, c in enumerate(names)}
    out = content_sort(inner, at["doc_id"], at["text"], inner.columns)
    return out.where("kept").select(*(F.col(f"d{i}").alias(c) for i, c in enumerate(names)))


def query(spark, sf_dir: str) -> DataFrame:
    return content_sort(documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
