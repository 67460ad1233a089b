"""Boxes on pages: overlaps, containment, bands, clusters of edges, and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{b}right") - F.col(f"{b}left")) * F.greatest(F.lit(0.0), F.col(f"{b}bottom") - F.col(f"{b}top"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes whose columns begin with a and b."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}right", f"{b}right") - F.greatest(f"{a}left", f"{b}left"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}bottom", f"{b}bottom") - F.greatest(f"{a}top", f"{b}top"))
    union = area(a) + area(b) - w * h
    return F.when(union == 0, 0.0).otherwise(w * h / union)


def prefixed(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(p + c) for c in boxes.columns])


def best_matches(regions: DataFrame, boxes: DataFrame, container: str, least: float = 0.0) -> DataFrame:
    """For each region, its container's box of the largest overlap, if that is at least ``least``. Boxes
    are matched by grid cell of the vertical position, so only neighbours meet."""
    cell = 200.0
    spread = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}top") / cell), F.floor(F.col(f"{p}bottom") / cell)))
    r = prefixed(regions, "r_").withColumn("cell", spread("r_"))
    b = prefixed(boxes, "b_").withColumn("cell", spread("b_"))
    pairs = r.join(b, (F.col(f"r_{container}") == F.col(f"b_{container}")) & (r["cell"] == b["cell"])).withColumn("iou", F.round(iou("r_", "b_"), 9))
    # pairs below the least can't win a region that counts; without them, few are sorted for the maximum of structs
    best = pairs.filter(F.col("iou") >= least).groupBy("r_element_id").agg(F.max(F.struct("iou", F.col("b_element_id"))).alias("m"))
    return best.select(F.col("r_element_id").alias("region_id"), F.col("m.b_element_id").alias("element_id"), F.col("m.iou").alias("iou"))


def outermost(candidates: DataFrame, container: str, path: str) -> DataFrame:
    """Candidates that lie within no other candidate of their container (a proper prefix of the path by
    segments): each looks up the paths above its own, so no pairs of siblings meet."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/"))
    above = candidates.select(container, path, F.explode(F.slice(prefixes, 1, F.greatest(F.size(prefixes) - 1, F.lit(0)))).alias("__up"))
    known = candidates.select(F.col(container).alias("__c"), F.col(path).alias("__p")).distinct()
    inside = above.join(known, (F.col(container) == F.col("__c")) & (F.col("__up") == F.col("__p"))).select(container, path).distinct()
    return candidates.join(inside, [container, path], "left_anti")


def band_texts(references: DataFrame, boxes: DataFrame, container: str, most: int = 10, cap: int = 800) -> DataFrame:
    """For each reference box, the texts of boxes that start from 100 above to 200 below its top, are 15 to
    200 high and at least a tenth of its width, and overlap it sideways: the nearest ten, by distance,
    joined with bars and cut."""
    r, b = prefixed(references, "r_"), prefixed(boxes, "b_")
    near = F.col("b_top").between(F.col("r_top") - 100, F.col("r_top") + 200)
    height = F.col("b_bottom") - F.col("b_top")
    fits = near & height.between(15, 200) & (F.col("b_right") - F.col("b_left") >= 0.1 * (F.col("r_right") - F.col("r_left"))) & (F.col("b_left") < F.col("r_right")) & (F.col("b_right") > F.col("r_left")) & (F.length(F.trim("b_text")) >= 3)
    pairs = r.join(b, (F.col(f"r_{container}") == F.col(f"b_{container}")) & fits)
    distance = F.abs(F.col("b_top") - F.col("r_top"))
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("r_element_id").orderBy(distance, "b_element_id"))).filter(F.col("n") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "b_text"))), lambda x: x["b_text"])
    return ranked.groupBy(F.col("r_element_id").alias("element_id")).agg(F.left(F.array_join(texts, " | "), F.lit(cap)).alias("band"))


def _clusters(values: Column, tolerance: float | Column) -> Column:
    """Clusters of sorted values: a new one begins where a value is over the tolerance from the last one, or
    over twice the tolerance from the cluster's first."""
    kind = "struct<first:double,last:double,sum:double,n:int>"
    none = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        # the last cluster grows beside the others: their list is written anew for each cluster, not for each value
        last = acc["last"]
        new = F.struct(x.alias("first"), x.alias("last"), x.alias("sum"), F.lit(1).alias("n"))
        grown = F.struct(last["first"].alias("first"), x.alias("last"), (last["sum"] + x).alias("sum"), (last["n"] + 1).alias("n"))
        before = F.when(last.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], last))
        apart = last.isNull() | (x - last["first"] > 2 * tolerance) | (x - last["last"] > tolerance)
        return F.when(apart, F.struct(before.alias("done"), new.alias("last"))).otherwise(F.struct(acc["done"].alias("done"), grown.alias("last")))

    all_ = lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"]))
    return F.aggregate(F.array_sort(F.transform(values, lambda v: v.cast("double"))), none, step, all_)


def edge_clusters(values: Column, tolerance: float) -> Column:
    """The means of the values' clusters."""
    return F.transform(_clusters(values, tolerance), lambda c: F.round(c["sum"] / c["n"], 6))


def grids(boxes: DataFrame, container: str, tolerance: float = 15.0) -> DataFrame:
    """Rows, columns, fill and whether a container's boxes form a grid (at least four boxes, two rows and
    two columns, and two fifths of the cells filled). One container is one page element's boxes."""
    one = boxes.groupBy(container).agg(F.collect_list(F.struct("top", "left")).alias("boxes"))
    one = one.select(container, "boxes", _clusters(F.col("boxes.top"), tolerance).alias("r"), _clusters(F.col("boxes.left"), tolerance).alias("c"))
    place = lambda of, x: F.size(F.filter(of, lambda k: k["first"] <= x))
    cells = F.size(F.array_distinct(F.transform("boxes", lambda b: F.struct(place(F.col("r"), b["top"]), place(F.col("c"), b["left"])))))
    out = one.select(container, F.size("r").cast("long").alias("n_rows"), F.size("c").cast("long").alias("n_columns"), (cells / (F.size("r") * F.size("c"))).alias("fill"), F.size("boxes").alias("n"))
    is_grid = (F.col("n") >= 4) & (F.col("n_rows") > 1) & (F.col("n_columns") > 1) & (F.col("fill") >= 0.4)
    return out.select(container, "n_rows", "n_columns", F.round("fill", 6).alias("fill"), is_grid.alias("is_grid"))


def relative_boxes(boxes: DataFrame, parents: DataFrame, container: str) -> DataFrame:
    """boxes against the upper left corner of their container's parent box (parents: one a container); boxes
    without one are left out."""
    corner = parents.select(F.col(container).alias("__c"), F.col("left").alias("__left"), F.col("top").alias("__top"))
    rows = boxes.join(corner, F.col(container) == F.col("__c"))
    moved = {c: F.col(c) - F.col("__left") for c in ("left", "right")} | {c: F.col(c) - F.col("__top") for c in ("top", "bottom")}
    return rows.withColumns(moved).drop("__c", "__left", "__top")


def stable_selector(identifier: Column) -> Column:
    """The CSS selector of a stable id; null if it is no such id."""
    return F.when(identifier.startswith("ds-"), F.concat(F.lit('[data-ds-id="'), identifier, F.lit('"]')))
