"""Words with boxes: visual rows, reading order, merging pages that have both native text and scanned regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Embedded pictures below this share of the page hold no text worth reading.
LEAST_REGION = 0.05


def visual_rows(words: Column) -> Column:
    """array<struct<mid, h, words>> from array<struct<text, x, y, w, h>>.

    Words are taken by their vertical centre. A word joins the current row if its centre lies within half the greater height
    of the row's first word and its own; else it opens a row. Inside a row the words are ordered from left to right.
    """
    mid = lambda w: w["y"] + w["h"] / 2
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(mid(w).alias("mid"), i.alias("i"), w.alias("w"))))
    word = "struct<x:double,i:int,text:string>"
    none = F.array().cast(f"array<struct<mid:double,h:double,words:array<{word}>>>")

    def step(rows: Column, p: Column) -> Column:
        item = F.struct(p["w"]["x"].alias("x"), p["i"].alias("i"), p["w"]["text"].alias("text"))
        last = F.get(rows, F.size(rows) - 1)
        near = F.abs(p["mid"] - last["mid"]) <= F.greatest(last["h"], p["w"]["h"]) * 0.5
        joined = F.struct(last["mid"].alias("mid"), last["h"].alias("h"), F.concat(last["words"], F.array(item)).alias("words"))
        opened = F.struct(p["mid"].alias("mid"), p["w"]["h"].alias("h"), F.array(item).alias("words"))
        return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(joined))).otherwise(F.concat(rows, F.array(opened)))

    rows = F.aggregate(placed, none, step)
    return F.transform(rows, lambda r: F.struct(r["mid"].alias("mid"), r["h"].alias("h"), F.array_sort(r["words"]).alias("words")))


def page_text(words: Column) -> Column:
    """The text of a page, one visual row per line."""
    return F.array_join(F.transform(visual_rows(words), lambda r: F.array_join(F.transform(r["words"], lambda w: w["text"]), " ")), "\n")


#: Side of the smallest grid cell, in the unit of the boxes.
CELL = 16
#: Boxes wider than CELL times two to this power go to the coarsest grid.
LEVELS = 24


def covering(points: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Pairs of ``points`` (page, px, py and more) and ``boxes`` (page, x, y, w, h and more, other names) with the point inside
    the box or on its edge.

    A box goes to the grid whose cells are just as large as it, so it covers four cells at most; a point is looked up in its
    cell of every grid in use. Both sides meet by page and cell, so a page with very many boxes is spread over tasks.
    """
    span = F.greatest(F.col("w"), F.col("h"), F.lit(CELL))
    level = F.least(F.ceil(F.log2(span / CELL)), F.lit(LEVELS)).cast("int")
    side = F.pow(F.lit(2.0), F.col("_level")) * CELL

    def cells(low, high) -> Column:
        return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))

    cut = boxes.filter("w >= 0 AND h >= 0").withColumn("_level", level)
    cut = cut.select("*", cells(F.col("x"), F.col("x") + F.col("w")).alias("_gx")).select("*", cells(F.col("y"), F.col("y") + F.col("h")).alias("_gy"))
    used = sorted(r[0] for r in cut.select("_level").distinct().collect())  # one entry per grid, LEVELS + 1 at most
    own = points.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumns({"_gx": F.floor(F.col("px") / side), "_gy": F.floor(F.col("py") / side)})
    met = own.join(cut, [*page, "_level", "_gx", "_gy"])
    return met.filter(F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h"))).drop("_level", "_gx", "_gy")


def words_outside(scanned: DataFrame, native: DataFrame, page: list[str]) -> DataFrame:
    """Scanned words whose centre lies in no native box of their page. Words and boxes without a place touch nothing."""
    centre = {"px": F.col("x") + F.col("w") / 2, "py": F.col("y") + F.col("h") / 2}
    points = scanned.withColumns(centre).select(*page, "px", "py").distinct()
    hit = covering(points, native.select(*page, "x", "y", "w", "h"), page).select(*page, "px", "py").distinct()
    return scanned.withColumns(centre).join(hit, [*page, "px", "py"], "left_anti").drop("px", "py")


def merge_pages(scanned: DataFrame, native: DataFrame, page: list[str]) -> DataFrame:
    """All words of the pages: native ones, and scanned ones outside of them, whose lines are counted on behind the native lines,
    region by region. source_type is MIXED where scanned words were added. ``scanned`` has page, region, line and the box;
    ``native`` page, line and the box."""
    last = native.groupBy(*page).agg(F.max("line").alias("_last"))
    lines = scanned.groupBy(*page, "region").agg((F.coalesce(F.max("line"), F.lit(-1)) + 1).alias("_n"))
    before = Window.partitionBy(*page).orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    added = words_outside(scanned, native, page).join(starts, [*page, "region"]).join(last, page, "left")
    added = added.withColumn("line", F.coalesce("_last", F.lit(-1)) + 1 + F.col("_before") + F.col("line")).drop("_last", "_before")
    mixed = added.select(*page).distinct().withColumn("_mixed", F.lit(True))
    both = native.withColumn("region", F.lit(None).cast(dict(scanned.dtypes)["region"])).unionByName(added)
    return both.join(mixed, page, "left").withColumn("source_type", F.when(F.col("_mixed"), "MIXED").otherwise("PDF_NATIVE")).drop("_mixed")


def embedded_regions(regions: DataFrame, page: list[str], area: Column) -> DataFrame:
    """Regions (x, y, w, h, seq) of at least LEAST_REGION of the page's area that lie in no earlier one of that size."""
    large = regions.filter((F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") * F.col("h") >= area * LEAST_REGION))
    inner = large.select(*page, F.col("seq").alias("_seq"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + F.col("w")).alias("_right"), (F.col("y") + F.col("h")).alias("_low"))
    met = covering(inner, large.select(*page, "seq", "x", "y", "w", "h"), page)
    within = met.filter((F.col("seq") < F.col("_seq")) & (F.col("x") + F.col("w") >= F.col("_right")) & (F.col("y") + F.col("h") >= F.col("_low")))
    return large.join(within.select(*page, F.col("_seq").alias("seq")).distinct(), [*page, "seq"], "left_anti")


def box_to_original(box: Column, matrix: list[float]) -> Column:
    """A box (x, y, w, h) under an affine map (a, b, c, d, e, f: x' = ax + by + c, y' = dx + ey + f), as the least upright box."""
    a, b, c, d, e, f = matrix
    corners = [(box[0] + box[2] * i, box[1] + box[3] * j) for i in (0, 1) for j in (0, 1)]
    xs, ys = F.array(*[x * a + y * b + c for x, y in corners]), F.array(*[x * d + y * e + f for x, y in corners])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def box_valid(box: Column) -> Column:
    return F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: v.between(0, 1)), F.lit(False))


def clamp_box(box: Column) -> Column:
    return F.transform(box, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
