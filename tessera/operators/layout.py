"""Lines, tables and texts of pages, from pieces of text and ruled segments that have a place.

Pieces are rows of key columns (a page, say), seq, x0, y0, x1, y1, size and text; text is null for ruled
segments, and y goes up. All steps are windows and joins within one page, so pages spread over the
cluster and no page grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import markdown_table

#: Points: pieces farther apart than NEAR on a line are words of their own, baselines within LEVEL make
#: one line, and segments within SNAP lie on one another.
NEAR, LEVEL, SNAP = 1.0, 3.0, 3.0


def _islands(df: DataFrame, by: list[str], order: list, begins: Column, name: str) -> DataFrame:
    """Numbers the runs of rows, in order, between those where ``begins`` holds."""
    upto = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(upto))


def lines(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key columns, line (from 1, downwards) and text: pieces of one baseline, left to right."""
    shown = pieces.where("text is not null")
    down = Window.partitionBy(*key).orderBy(F.desc("y0"), "x0", "seq")
    shown = shown.withColumn("__drop", F.lag("y0").over(down) - F.col("y0"))
    shown = _islands(shown, key, [F.desc("y0"), "x0", "seq"], F.col("__drop") > LEVEL, "line")
    listed = shown.groupBy(*key, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "seq", "x1", "text"))).alias("__p"))
    none = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("end"))

    def add(line: Column, p: Column) -> Column:
        gap = F.when(p["x0"] - line["end"] > NEAR, F.lit(" ")).otherwise("")
        return F.struct(F.concat(line["t"], gap, p["text"]).alias("t"), F.greatest(line["end"], p["x1"]).alias("end"))

    text = F.trim(F.regexp_replace(F.aggregate("__p", none, add)["t"], r"\s+", " "))
    return listed.select(*key, "line", text.alias("text")).where("text <> ''")


def texts(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key columns and text: the lines of each key, one below the other."""
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return lines(pieces, key).groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def _rules(pieces: DataFrame, key: list[str], at: str, begin: str, end: str) -> DataFrame:
    """key, id, at, begin, end: segments along one axis, snapped to a common place and joined where they touch."""
    rows = pieces.select(*key, F.col(at).alias("at"), F.col(begin).alias("begin"), F.col(end).alias("end"))
    before = Window.partitionBy(*key).orderBy("at")
    rows = _islands(rows.withColumn("__gap", F.col("at") - F.lag("at").over(before)), key, ["at"], F.col("__gap") > SNAP, "track")
    reach = Window.partitionBy(*key, "track").orderBy("begin", "end")
    rows = rows.withColumn("__far", F.max("end").over(reach.rowsBetween(Window.unboundedPreceding, -1)))
    rows = _islands(rows, [*key, "track"], ["begin", "end"], F.col("begin") - F.col("__far") > SNAP, "part")
    whole = rows.groupBy(*key, "track", "part").agg(F.avg("at").alias("at"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    # joined pieces of one track keep its place, so that corners meet
    return whole.withColumn("at", F.avg("at").over(Window.partitionBy(*key, "track")))


def cells(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key, x0, y0, x1, y1: the smallest rectangles whose sides are ruled.

    Where segments cross there is a corner. A corner's cell ends at the nearest corners below and to
    the right that are joined to it, and to the corner across, by segments.
    """
    ruled = pieces.where("text is null")
    flat = _rules(ruled.where("x1 - x0 >= y1 - y0"), key, "y0", "x0", "x1").select(*key, F.struct("track", "part").alias("h"), F.col("at").alias("y"), F.col("begin").alias("left"), F.col("end").alias("right"))
    tall = _rules(ruled.where("x1 - x0 < y1 - y0"), key, "x0", "y0", "y1").select(*key, F.struct("track", "part").alias("v"), F.col("at").alias("x"), F.col("begin").alias("low"), F.col("end").alias("high"))
    crossing = (F.col("x").between(F.col("left") - SNAP, F.col("right") + SNAP)) & (F.col("y").between(F.col("low") - SNAP, F.col("high") + SNAP))
    corners = flat.join(tall, key).where(crossing).select(*key, "h", "v", "x", "y")
    # the next corner on each segment is nearly always the cell's own; only the others look farther
    right = Window.partitionBy(*key, "h").orderBy("x")
    below = Window.partitionBy(*key, "v").orderBy(F.desc("y"))
    near = corners.withColumns({"rv": F.lead("v").over(right), "rx": F.lead("x").over(right), "bh": F.lead("h").over(below), "by": F.lead("y").over(below)}).where("rv is not null and bh is not null")
    across = corners.select(*key, F.col("h").alias("bh"), F.col("v").alias("rv"), F.lit(True).alias("closed"))
    near = near.join(across, [*key, "bh", "rv"], "left")
    simple = near.where("closed").select(*key, F.col("x").alias("x0"), F.col("by").alias("y0"), F.col("rx").alias("x1"), F.col("y").alias("y1"))
    odd = near.where("closed is null").select(*key, "h", "v", "x", "y")
    rights = corners.select(*key, "h", F.col("v").alias("rv"), F.col("x").alias("rx"))
    belows = corners.select(*key, "v", F.col("h").alias("bh"), F.col("y").alias("by"))
    wide = odd.join(rights, [*key, "h"]).where("rx > x").join(belows, [*key, "v"]).where("by < y").join(across, [*key, "bh", "rv"])
    size = F.struct((F.col("y") - F.col("by")).alias("a"), (F.col("rx") - F.col("x")).alias("b"))
    best = wide.groupBy(*key, "h", "v", "x", "y").agg(F.min_by(F.struct("by", "rx"), size).alias("m"))
    merged = best.select(*key, F.col("x").alias("x0"), F.col("m.by").alias("y0"), F.col("m.rx").alias("x1"), F.col("y").alias("y1"))
    return simple.unionByName(merged)


def _cut(df: DataFrame, by: list[str], begin: str, end: str, name: str) -> DataFrame:
    """Numbers groups of intervals that no gap separates."""
    order = Window.partitionBy(*by).orderBy(begin, end)
    df = df.withColumn("__far", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return _islands(df, by, [begin, end], F.col(begin) - F.col("__far") > SNAP, name).drop("__far")


def tables(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key, table (from 1, downwards) and rows, array<array<string>>: ruled tables of two cells or more.

    Tables are told apart by bands and columns of the page that no cell reaches into. A cell that spans
    others has its text in the first of their places; the rest are empty.
    """
    found = cells(pieces, key).withColumns({"top": -F.col("y1"), "bottom": -F.col("y0")})
    for i, (begin, end) in enumerate((("top", "bottom"), ("x0", "x1"), ("top", "bottom"))):
        found = _cut(found, [*key, *(f"cut{j}" for j in range(i))], begin, end, f"cut{i}")
    one = [*key, "cut0", "cut1", "cut2"]
    order = Window.partitionBy(*key).orderBy("cut0", "cut2", "cut1")
    found = found.withColumns({"table": F.dense_rank().over(order), "several": F.count(F.lit(1)).over(Window.partitionBy(*one))}).where("several > 1")
    found = found.withColumn("table", F.dense_rank().over(Window.partitionBy(*key).orderBy("table")))
    found = found.withColumns({"row": F.dense_rank().over(Window.partitionBy(*key, "table").orderBy("top")), "column": F.dense_rank().over(Window.partitionBy(*key, "table").orderBy("x0"))})
    found = found.select(*key, "table", "row", "column", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("y0").alias("cy0"), F.col("y1").alias("cy1"))
    shown = pieces.where("text is not null")
    inside = ((F.col("x0") + F.col("x1")) / 2 >= F.col("cx0")) & ((F.col("x0") + F.col("x1")) / 2 < F.col("cx1"))
    middle = F.col("y0") + F.col("size") / 4  # of a run's letters, whose foot is y0
    held = found.join(shown, key).where(inside & (middle >= F.col("cy0")) & (middle < F.col("cy1")))
    place = [*key, "table", "row", "column"]
    text = texts(held.select(*place, "seq", "x0", "y0", "x1", "y1", "size", "text"), place)
    filled = found.select(*place).distinct().join(text, place, "left").withColumn("text", F.coalesce("text", F.lit("")))
    width = F.max("column").over(Window.partitionBy(*key, "table"))
    row = filled.withColumn("__n", width).groupBy(*key, "table", "row", "__n").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("__m"))
    row = row.select(*key, "table", "row", F.transform(F.sequence(F.lit(1), "__n"), lambda c: F.coalesce(F.element_at("__m", c), F.lit(""))).alias("__r"))
    listed = F.array_sort(F.collect_list(F.struct("row", "__r")))
    return row.groupBy(*key, "table").agg(F.transform(listed, lambda r: r["__r"]).alias("rows"))


def contents(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key and text of each page that shows any: its tables as `TABLE:` texts, then its lines, set apart by `---`."""
    made = tables(pieces, key).select(*key, "table", markdown_table("rows").alias("text"))
    every = made.unionByName(texts(pieces, key).select(*key, F.lit(2147483647).alias("table"), "text"))
    parts = F.array_sort(F.collect_list(F.struct("table", "text")))
    return every.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n---\n").alias("text"))
