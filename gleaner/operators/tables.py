"""Tables that boxes on a page form: grids, groups of stacked tables, and discovery in a tree of regions.

A container is one element of a page with the elements in it, some of which have a box. Leaves are boxes
that contain no other box. Everything is done for all containers at once and from one reading: boxes that are
lacking come from below in a fold of a container's elements, boxes meet within a container by cells of the
plane, and a fold of its candidates lets them claim leaves one after another. All steps group by the container
first, so partitions by it last from the elements to the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.spatial import _clusters

#: Fixed values of the detection, in pixels and shares.
LEAST_TOLERANCE, MOST_TOLERANCE, TOLERANCE_SHARE, CELL_TOLERANCE = 15.0, 50.0, 0.6, 10.0
LEAST_CONFIDENCE, LEAST_FILL = 0.35, 0.15
LEAVES, ROWS, COLUMNS, CONFIDENCE, HEIGHT, WIDTH, DEPTH = 6, 2, 2, 0.5, 100.0, 200.0, 15
ALIGNED, GAP = 10.0, 50.0
PLANE = 200.0
GRID = (
    "struct<is_table:boolean,confidence:double,n_rows:int,n_columns:int,row_edges:array<double>,column_edges:array<double>,"
    "cells:array<struct<id:string,row_start:int,row_end:int,column_start:int,column_end:int>>>"
)


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _median(values: Column, otherwise: float) -> Column:
    return let(F.array_sort(F.filter(values, lambda x: x > 0)), lambda s: F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(otherwise)))


def _edges(boxes: Column, low: str, high: str, usual: float) -> Column:
    """Means of the clusters of both edges, with a tolerance by the median size."""
    size = _median(F.transform(boxes, lambda b: b[high] - b[low]), usual)
    tolerance = F.greatest(F.lit(LEAST_TOLERANCE), F.least(F.lit(MOST_TOLERANCE), size * TOLERANCE_SHARE))
    both = F.concat(F.transform(boxes, lambda b: b[low]), F.transform(boxes, lambda b: b[high]))
    return let(tolerance, lambda t: F.transform(_clusters(both, t), lambda c: c["sum"] / c["n"]))


def _place(edges: Column, ends: Column, value: Column, start: bool) -> Column:
    """The first strip between neighbouring edges that a box's first or last edge lies in, give or take; or null.
    ``ends``: the strips' ends, with the tolerance. As these ascend, the strip is found by the number of ends before."""
    strip = F.size(F.filter(ends, (lambda e: value >= e) if start else (lambda e: value > e)))

    def checked(i: Column) -> Column:
        low, high = F.get(edges, i) - CELL_TOLERANCE, F.get(ends, i)
        return F.when((value >= low) & (value < high) if start else (value > low) & (value <= high), i)

    return let(strip, checked)


def _cells(boxes: Column, rows: Column, columns: Column) -> Column:
    def cell(b: Column, r: Column, c: Column) -> Column:
        return F.struct(
            b["id"].alias("id"), _place(rows, r, b["top"], True).alias("row_start"), _place(rows, r, b["bottom"], False).alias("row_end"),
            _place(columns, c, b["left"], True).alias("column_start"), _place(columns, c, b["right"], False).alias("column_end"),
        )

    ends = lambda edges: F.transform(F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), lambda e: e + CELL_TOLERANCE)
    cells = let(F.struct(ends(rows).alias("r"), ends(columns).alias("c")), lambda e: F.transform(boxes, lambda b: cell(b, e["r"], e["c"])))
    return F.filter(cells, lambda c: (c["row_end"] >= c["row_start"]) & (c["column_end"] >= c["column_start"]))


def grid(boxes: Column) -> Column:
    """What grid an array of boxes (id, left, top, right, bottom) forms, as a struct of GRID.

    Row and column edges are means of clusters of the boxes' own edges; a box takes the cells between the
    strips of its first and its last edge. The confidence adds up that there are rows and columns, how many
    cells are filled, how even rows are, and how many rows and columns there are."""
    none = F.struct(F.lit(False).alias("is_table"), F.lit(0.0).alias("confidence"), F.lit(0).alias("n_rows"), F.lit(0).alias("n_columns"), *(F.array().cast("array<double>").alias(c) for c in ("row_edges", "column_edges")), F.lit(None).cast(GRID)["cells"].alias("cells"))

    def with_cells(edges: Column, cells: Column) -> Column:
        n, m = F.size(edges["rows"]) - 1, F.size(edges["columns"]) - 1
        taken = F.array_distinct(F.flatten(F.transform(cells, lambda c: F.flatten(F.transform(F.sequence(c["row_start"], c["row_end"]), lambda r: F.transform(F.sequence(c["column_start"], c["column_end"]), lambda k: r * m + k))))))

        def scored(taken: Column) -> Column:
            fill = F.size(taken) / F.greatest(n * m, F.lit(1))
            mean = F.size(taken) / F.greatest(n, F.lit(1))
            # how often a row is among the cells' rows: without a look at each cell for each row by an expression of its own
            by_row = let(F.transform(taken, lambda x: F.floor(x / m)), lambda rows: F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda r: (F.size(rows) - F.size(F.array_remove(rows, r.cast("long")))).cast("double")))
            spread = F.aggregate(by_row, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.greatest(n, F.lit(1))
            even = 1.0 / (1.0 + F.when(mean > 0, spread).otherwise(0.0) / F.greatest(F.lit(1.0), mean * mean))
            axes = F.when((n >= 2) & (m >= 2), 0.3).otherwise(0.2)
            filled = F.when(fill >= 0.5, 0.25).when(fill >= 0.3, 0.2).when(fill >= LEAST_FILL, 0.1).otherwise(0.0)
            more = lambda c, x: F.when(c, x).otherwise(0.0)
            whole = axes + filled + even * 0.25 + more(n >= 3, 0.1) + more(m >= 2, 0.05) + more(n >= 5, 0.05)
            enough = F.size(cells) >= 2

            def judged(total: Column) -> Column:
                valid = enough & (((n >= 2) & (m >= 1)) | ((n >= 1) & (m >= 2))) & ((total >= LEAST_CONFIDENCE) | (fill >= 0.4))
                return F.struct(valid.alias("is_table"), F.when(enough, total).otherwise(0.0).alias("confidence"), n.alias("n_rows"), m.alias("n_columns"), edges["rows"].alias("row_edges"), edges["columns"].alias("column_edges"), cells.alias("cells"))

            return let(let(whole, lambda x: F.least(F.lit(1.0), F.when(fill < LEAST_FILL, x * 0.7).otherwise(x))), judged)

        small = ((n < 2) & (m < 2)) | (n * m < 2)
        return F.when(small, none.cast(GRID)).otherwise(let(taken, scored).cast(GRID))

    edges = F.struct(_edges(boxes, "top", "bottom", 20.0).alias("rows"), _edges(boxes, "left", "right", 50.0).alias("columns"))
    whole = let(edges, lambda e: let(_cells(boxes, e["rows"], e["columns"]), lambda c: with_cells(e, c)))
    return F.when(F.size(boxes) < 4, none.cast(GRID)).otherwise(whole)


def box_array(*also: str) -> Column:
    """All boxes of a group, in order of their ids."""
    return F.array_sort(F.collect_list(F.struct(*also, F.col("id").cast("string").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")))))


def stacked_groups(candidates: DataFrame, container: str, order: str) -> DataFrame:
    """candidates (with n_columns and a box) and ``group``: within a container and a number of columns, from top
    to bottom, one goes with the one before if both edges align within 10 and the gap is at most 50."""
    w = Window.partitionBy(container, "n_columns").orderBy("top", order)
    aligned = (F.abs(F.col("left") - F.lag("left").over(w)) <= ALIGNED) & (F.abs(F.col("right") - F.lag("right").over(w)) <= ALIGNED)
    follows = aligned & (F.col("top") - F.lag("bottom").over(w) <= GAP)
    return candidates.withColumn("__new", F.when(follows, 0).otherwise(1)).withColumn("group", F.sum("__new").over(w)).drop("__new")


# -- discovery
SIDES = ("left", "top", "right", "bottom")


def _within(i: Column, o: Column) -> Column:
    """Whether a box lies in another one, give or take 5, and is smaller in one direction at least."""
    inside = (i["left"] >= o["left"] - 5) & (i["top"] >= o["top"] - 5) & (i["right"] <= o["right"] + 5) & (i["bottom"] <= o["bottom"] + 5)
    return inside & ((i["right"] - i["left"] < (o["right"] - o["left"]) * 0.95) | (i["bottom"] - i["top"] < (o["bottom"] - o["top"]) * 0.95))


def _made_from_below(elements: Column) -> Column:
    """Of a container's elements in document order, those without a box that get the one around their children's.

    They are walked from the last to the first, so an element's children have just been seen: ``open`` holds, for
    each parent that is still to come, the box around its children so far."""
    kind, open_kind = "array<struct<node:bigint,last:bigint,depth:int,id:string,left:double,top:double,right:double,bottom:double>>", "array<struct<parent:string,left:double,top:double,right:double,bottom:double>>"
    around = lambda boxes: {c: (F.array_min if c in ("left", "top") else F.array_max)(F.transform(boxes, lambda b: b[c])) for c in SIDES}

    def step(s: Column, e: Column) -> Column:
        def having_children(mine: Column) -> Column:
            bare = e["left"].isNull()
            rest = F.when(F.size(mine) == 0, s["open"]).otherwise(F.filter(s["open"], lambda o: o["parent"] != e["id"]))

            def boxed(box: Column) -> Column:
                def onto(last: Column) -> Column:
                    one = F.struct(e["parent"].alias("parent"), *(box[c].alias(c) for c in SIDES))
                    both = F.struct(e["parent"].alias("parent"), *((F.least if c in ("left", "top") else F.greatest)(box[c], last[c]).alias(c) for c in SIDES))
                    same = last["parent"] == e["parent"]
                    return F.when(box["left"].isNull() | e["parent"].isNull(), rest).when(same, F.array_append(F.slice(rest, 1, F.size(rest) - 1), both)).otherwise(F.array_append(rest, one))

                element = F.struct(*(e[c].alias(c) for c in ("node", "last", "depth", "id")), *(box[c].alias(c) for c in SIDES))
                made = F.when(bare & box["left"].isNotNull(), F.array_append(s["made"], element)).otherwise(s["made"])
                return F.struct(let(F.get(rest, F.size(rest) - 1), onto).alias("open"), made.alias("made"))

            return let(F.when(bare, F.struct(*(v.alias(c) for c, v in around(mine).items()))).otherwise(F.struct(*(e[c].alias(c) for c in SIDES))), boxed)

        return let(F.filter(s["open"], lambda o: o["parent"] == e["id"]), having_children)

    none = F.struct(F.array().cast(open_kind).alias("open"), F.array().cast(kind).alias("made"))
    return F.when(F.exists(elements, lambda e: e["left"].isNull()), F.aggregate(F.reverse(elements), none, step, lambda s: s["made"])).otherwise(F.array().cast(kind))


def with_boxes(elements: DataFrame, container: str) -> DataFrame:
    """Elements with a box, and those that get one from below (``made``)."""
    kinds = {"node": "bigint", "last": "bigint", "depth": "int", "id": "string", "parent": "string"} | dict.fromkeys(SIDES, "double")
    whole = elements.filter(F.col(container).isNotNull()).groupBy(container).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())))).alias("all"))
    names = [c for c in kinds if c != "parent"]
    own = F.transform(F.filter("all", lambda e: e["left"].isNotNull()), lambda e: F.struct(*(e[c].alias(c) for c in names), F.lit(False).alias("made")))
    made = F.transform(_made_from_below(F.col("all")), lambda e: F.struct(*(e[c].alias(c) for c in names), F.lit(True).alias("made")))
    return whole.select(container, F.inline(F.concat(own, made)))


def candidates(elements: DataFrame, container: str) -> DataFrame:
    """Elements whose leaves form a table: container, node, depth, id, their box, ``leaves`` (boxes), ``grid``.

    An inner box is looked up by the cell of its upper left corner, so only boxes around that place meet. A box
    without others in it is a leaf. Small elements whose box was made take the leaves below them in the tree."""
    large = (F.col("bottom") - F.col("top") >= HEIGHT) & (F.col("right") - F.col("left") >= WIDTH) & (F.col("depth") <= DEPTH)
    boxes = with_boxes(elements, container).withColumn("large", F.coalesce(large, F.lit(False))).withColumn("by_tree", F.col("made") & ~F.col("large") & (F.col("depth") <= DEPTH))
    boxes = boxes.filter("not made or large or by_tree")
    at = lambda c: F.floor(F.col(c) / PLANE)
    span = lambda low, high: F.sequence(F.floor((F.col(low) - 5) / PLANE), F.floor(F.greatest(F.col(low), F.col(high)) / PLANE))
    placed = boxes.withColumn("x", F.explode_outer(F.when(F.col("by_tree"), F.array(at("left"))).otherwise(span("left", "right"))))
    placed = placed.withColumn("y", F.explode_outer(F.when(F.col("by_tree"), F.array(at("top"))).otherwise(span("top", "bottom"))))
    placed = placed.withColumn("corner", F.col("x").eqNullSafe(at("left")) & F.col("y").eqNullSafe(at("top")))

    box = F.struct("id", *SIDES)
    here, everywhere = Window.partitionBy(container, "x", "y"), Window.partitionBy(container)
    inner = F.collect_list(F.when(F.col("corner") & ~F.col("made"), F.struct("node", *SIDES, "id"))).over(here)
    placed = placed.withColumn("inner", inner)
    me = {c: F.col(c) for c in SIDES}
    placed = placed.withColumn("inner", F.filter("inner", lambda i: (i["node"] != F.col("node")) & _within(i, me))).withColumn("holds", ~F.col("made") & (F.size("inner") > 0))
    placed = placed.withColumn("inner", F.when(F.col("large"), F.col("inner")).otherwise(F.slice("inner", 1, 0)))
    outer = F.struct("node", "depth", "id", *SIDES)
    known = placed.withColumn("holders", F.collect_set(F.when(F.col("holds"), F.col("node"))).over(everywhere)).withColumn("above", F.collect_list(F.when(F.col("by_tree"), F.struct("last", outer.alias("outer")))).over(everywhere))
    no_leaf = lambda node: F.array_contains(F.col("holders"), node)
    inside = F.transform(F.filter("inner", lambda i: ~no_leaf(i["node"])), lambda i: F.struct(i["id"].alias("id"), *(i[c].alias(c) for c in SIDES)))
    below = F.filter("above", lambda a: (F.col("node") > a["outer"]["node"]) & (F.col("node") <= a["last"]))
    part = lambda o, leaves: F.struct(o.alias("outer"), leaves.alias("part"))
    by_place = F.when(F.size("inner") > 0, F.array(part(outer, inside)))
    by_tree = F.when(F.col("corner") & ~F.col("made") & (F.size("above") > 0) & ~no_leaf(F.col("node")), F.transform(below, lambda a: part(a["outer"], F.array(box))))
    parts = known.select(container, F.inline(F.concat(*(F.coalesce(x, F.array().cast(_PARTS)) for x in (by_place, by_tree)))))
    parts = parts.filter(F.size("part") > 0)

    found = parts.groupBy(container, F.col("outer.node").alias("node")).agg(F.first("outer").alias("outer"), F.array_sort(F.flatten(F.collect_list("part"))).alias("leaves"))
    found = found.filter(F.size("leaves") >= LEAVES)
    # a filter on the grid would be pushed down to where the leaves are, and the grid worked out there a second time
    found = found.withColumn("grid", F.explode(F.filter(F.array(grid(F.col("leaves"))), lambda g: g["is_table"] & (g["confidence"] >= CONFIDENCE))))
    return found.select(container, "node", "outer.depth", "outer.id", *(f"outer.{c}" for c in SIDES), "leaves", "grid", F.col("grid.n_columns").alias("n_columns"))


_BOX = "id:string,left:double,top:double,right:double,bottom:double"
_PARTS = f"array<struct<outer:struct<node:bigint,depth:int,{_BOX}>,part:array<struct<{_BOX}>>>>"


def _complete(g: Column) -> Column:
    return (g["n_rows"] >= ROWS) & (g["n_columns"] >= COLUMNS) & (g["confidence"] >= CONFIDENCE)


def _taking(all_: Column) -> Column:
    """What common ancestors do to a container's candidates (from the top of the tree): nodes of those that are
    ``chosen``, of those that are ``closed`` besides, and the ``groups`` whose members are."""
    ids = lambda leaves: F.transform(leaves, lambda b: b["id"])

    def ancestor(name: Column) -> Column:
        def over(wanted: Column) -> Column:
            has_all = lambda r: (r["group"] != name) & (F.size(r["leaves"]) >= F.size(wanted)) & (F.size(F.array_except(wanted, ids(r["leaves"]))) == 0)
            return let(F.get(F.filter(all_, has_all), F.lit(0)), lambda r: F.struct(name.alias("group"), r["node"].alias("node"), _complete(r["grid"]).alias("complete")))

        members = F.filter(all_, lambda r: r["group"] == name)
        return let(members, lambda m: F.when(F.size(m) > 1, let(F.array_distinct(F.flatten(F.transform(m, lambda r: ids(r["leaves"])))), over)))

    def used(above: Column) -> Column:
        uses = lambda a: F.size(F.filter(above, lambda x: x["node"] == a["node"]))
        return let(F.filter(above, lambda a: (uses(a) < 3) & a["complete"]), lambda t: F.struct(F.transform(t, lambda a: a["node"]).alias("chosen"), F.transform(F.filter(above, lambda a: uses(a) >= 3), lambda a: a["node"]).alias("closed"), F.transform(t, lambda a: a["group"]).alias("groups")))

    names = F.array_distinct(F.transform(all_, lambda r: r["group"]))
    return let(F.filter(F.transform(names, ancestor), lambda a: a["node"].isNotNull()), used)


def discover(elements: DataFrame, container: str, checkpointed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tables of each container: container, id (of the element), depth, grid, leaves, shared (whether it stands for a
    group of stacked ones).

    elements: container, id, parent (an id or null), node and last (document order), depth, and left, top, right,
    bottom or null. Candidates of equal columns that stand upon one another are a group. A group's common
    ancestor (the highest candidate that has all its leaves) takes its place if it is a complete table and
    isn't the ancestor of three groups. The other candidates, from the top of the tree, take their leaves if
    none is taken yet; what others have left of theirs has to form a table by itself.

    Elements are read once and meet only within their container, so they are shuffled at most once: not at all if
    they are partitioned by it. Nothing is stored on the way; ``checkpointed`` is taken for older callers alone."""
    found = stacked_groups(candidates(elements, container), container, "node")

    # candidates claim leaves in turn: the state is the ids taken and the tables chosen
    one = F.struct("depth", "node", "id", "leaves", "grid", F.concat_ws("/", "n_columns", "group").alias("group"))
    rows = found.groupBy(container).agg(F.array_sort(F.collect_list(one)).alias("all"))
    ids = lambda leaves: F.transform(leaves, lambda b: b["id"])
    table = lambda r, leaves, g, shared: F.struct(r["id"].alias("id"), r["depth"].alias("depth"), g.cast(GRID).alias("grid"), leaves.alias("leaves"), F.lit(shared).alias("shared"))

    def claim(s: Column, r: Column) -> Column:
        def having_left(left: Column) -> Column:
            def take(g: Column) -> Column:
                fits = F.when(F.size(left) == F.size(r["leaves"]), _complete(g)).otherwise((F.size(left) >= LEAVES) & g["is_table"] & _complete(g))
                taken = F.struct(F.concat(s["taken"], ids(left)).alias("taken"), F.concat(s["tables"], F.array(table(r, left, g, False))).alias("tables"))
                return F.when(fits, taken).otherwise(s)

            return F.when(F.size(left) == 0, s).otherwise(let(F.when(F.size(left) == F.size(r["leaves"]), r["grid"]).otherwise(grid(left)), take))

        return let(F.filter(r["leaves"], lambda b: ~F.array_contains(s["taken"], b["id"])), having_left)

    def ended(t: Column) -> Column:
        closed = lambda r: F.array_contains(t["chosen"], r["node"]) | F.array_contains(t["closed"], r["node"]) | F.array_contains(t["groups"], r["group"])
        first = F.filter("all", lambda r: F.array_contains(t["chosen"], r["node"]))
        start = let(first, lambda f: F.struct(F.flatten(F.transform(f, lambda r: ids(r["leaves"]))).alias("taken"), F.transform(f, lambda r: table(r, r["leaves"], r["grid"], True)).alias("tables")))
        return F.aggregate(F.filter("all", lambda r: ~closed(r)), start, claim, lambda s: s["tables"])

    return rows.select(container, F.explode(let(_taking(F.col("all")), ended)).alias("t")).select(container, "t.*")


def best_of_alike(tables: DataFrame, *signature: str) -> DataFrame:
    """Of tables with the same signature (element's name and children, start of its text), the one of the highest
    confidence, then of the most leaves, then the first."""
    w = Window.partitionBy(*signature).orderBy(F.desc("confidence"), F.desc("n_leaves"), "place")
    return tables.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
