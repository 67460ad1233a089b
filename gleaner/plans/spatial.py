"""Queries of the box operators; boxes are laid out from the orders' lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import spatial as B
from gleaner.operators import tables as T
from gleaner.plans.catalog import query
from gleaner.session import table

_BOXES = """b AS (SELECT l_orderkey AS container_id, l_orderkey * 10 + l_linenumber AS element_id, 'n' || l_linenumber AS text, (l_linenumber % 3) * 100.0::DOUBLE AS left_, (l_linenumber % 3) * 100.0::DOUBLE + l_quantity * 2 AS right_,
       floor(l_linenumber / 3) * 40.0 + l_quantity % 5 AS top_, floor(l_linenumber / 3) * 40.0 + l_quantity % 5 + 20 AS bottom_ FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity))"""


def _boxes(spark, sf):
    t = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    # an order's lines are shuffled once, for their own groups and for those of orders
    t = t.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m")).withColumn("l_quantity", F.col("m.l_quantity"))
    left, top = (F.col("l_linenumber") % 3) * 100.0, F.floor(F.col("l_linenumber") / 3) * 40.0 + F.col("l_quantity") % 5
    return t.select(F.col("l_orderkey").alias("container_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("element_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("text"), left.alias("left"), (left + F.col("l_quantity") * 2).alias("right"), top.alias("top"), (top + 20).alias("bottom"))


@query("J18 S35", f"""
    WITH {_BOXES}, p AS (SELECT r.element_id AS region_id, b.element_id, greatest(0, least(r.right_ + 5, b.right_) - greatest(r.left_ + 5, b.left_)) * greatest(0, least(r.bottom_ + 3, b.bottom_) - greatest(r.top_ + 3, b.top_)) AS i,
        (r.right_ - r.left_) * 20 + (b.right_ - b.left_) * 20 AS s FROM b r JOIN b ON r.container_id = b.container_id),
    q AS (SELECT region_id, element_id, round(i / (s - i), 9) AS iou FROM p)
    SELECT region_id, element_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY iou DESC, element_id DESC) AS n FROM q) WHERE n = 1 AND iou >= 0.5""")
def region_match(spark, sf):
    b = _boxes(spark, sf)
    shifted = b.withColumns({"left": F.col("left") + 5, "right": F.col("right") + 5, "top": F.col("top") + 3, "bottom": F.col("bottom") + 3})
    return B.best_matches(shifted, b, "container_id", 0.5)


@query("J14", f"""
    WITH {_BOXES}, p AS (SELECT r.element_id, b.text, row_number() OVER (PARTITION BY r.element_id ORDER BY abs(b.top_ - r.top_), b.element_id) AS n FROM b r JOIN b ON r.container_id = b.container_id
        AND b.top_ BETWEEN r.top_ - 100 AND r.top_ + 200 AND b.right_ - b.left_ >= 0.1 * (r.right_ - r.left_) AND b.left_ < r.right_ AND b.right_ > r.left_)
    SELECT element_id, left(string_agg(text || '--', ' | ' ORDER BY n), 800) AS band FROM p WHERE n <= 10 GROUP BY element_id""")
def band_texts(spark, sf):
    b = _boxes(spark, sf).withColumn("text", F.concat("text", F.lit("--")))
    return B.band_texts(b, b, "container_id")


@query("J10", """
    WITH c AS (SELECT DISTINCT n_regionkey AS container_id, 'r/' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '/x' || n_nationkey ELSE '/x' || (n_nationkey - 1) || '/y' || n_nationkey END AS path FROM nation)
    SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.container_id = a.container_id AND starts_with(a.path, b.path || '/'))""")
def outermost_candidates(spark, sf):
    n = F.col("n_nationkey")
    path = F.concat(F.lit("r/"), F.col("n_regionkey").cast("string"), F.when(n % 2 == 0, F.concat(F.lit("/x"), n.cast("string"))).otherwise(F.concat(F.lit("/x"), (n - 1).cast("string"), F.lit("/y"), n.cast("string"))))
    return B.outermost(table(spark, sf, "nation").select(F.col("n_regionkey").alias("container_id"), path.alias("path")).distinct(), "container_id", "path")


_CLUSTERS = """list_reduce(list_transform(list_sort(list({0})), lambda x: [{{'first': x, 'last': x, 'total': x, 'n': 1}}]),
        lambda a, x: CASE WHEN x[1].first - a[-1].last > 15 OR x[1].first - a[-1].first > 30 THEN a || x
                     ELSE a[1:-2] || [{{'first': a[-1].first, 'last': x[1].last, 'total': a[-1].total + x[1].total, 'n': a[-1].n + 1}}] END)"""


@query("W9 G21", f"""
    WITH {_BOXES} SELECT container_id, list_transform({_CLUSTERS.format("left_")}, lambda c: round(c.total / c.n, 6)) AS columns FROM b GROUP BY container_id""")
def edge_clusters(spark, sf):
    b = _boxes(spark, sf).groupBy("container_id").agg(F.collect_list("left").alias("v"))
    return b.select("container_id", B.edge_clusters(F.col("v"), 15.0).alias("columns"))


@query("S36 fixed tolerance", f"""
    WITH {_BOXES}, c AS (SELECT container_id, {_CLUSTERS.format("top_")} AS r, {_CLUSTERS.format("left_")} AS c, list({{'x': left_, 'y': top_}}) AS boxes FROM b GROUP BY container_id),
    p AS (SELECT container_id, len(r) AS n_rows, len(c) AS n_columns, len(boxes) AS n, len(list_distinct(list_transform(boxes, lambda b: [len(list_filter(r, lambda k: k.first <= b.y)), len(list_filter(c, lambda k: k.first <= b.x))]))) AS cells FROM c)
    SELECT container_id, n_rows, n_columns, round(cells::DOUBLE / (n_rows * n_columns), 6) AS fill, n >= 4 AND n_rows > 1 AND n_columns > 1 AND cells::DOUBLE / (n_rows * n_columns) >= 0.4 AS is_grid FROM p""")
def table_grids(spark, sf):
    return B.grids(_boxes(spark, sf), "container_id")


@query("S35", f"""
    WITH {_BOXES} SELECT container_id, min(left_) AS "left", min(top_) AS top, max(right_) AS "right", max(bottom_) AS bottom, count(*) AS n FROM b GROUP BY container_id""")
def union_bounds(spark, sf):
    return _boxes(spark, sf).groupBy("container_id").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("n"))


@query("S39", f"""
    WITH {_BOXES}, p AS (SELECT container_id, left_ AS l, top_ AS t FROM b WHERE element_id % 10 = 1)
    SELECT element_id, CASE WHEN element_id % 4 > 0 THEN '[data-ds-id="ds-' || element_id || '"]' END AS selector, left_ - l AS "left", right_ - l AS "right", top_ - t AS top, bottom_ - t AS bottom FROM b JOIN p USING (container_id)""")
def relative_boxes(spark, sf):
    b = _boxes(spark, sf)
    name = F.concat(F.when(F.col("element_id") % 4 > 0, "ds-").otherwise("x-"), F.col("element_id").cast("string"))
    r = B.relative_boxes(b, b.filter(F.col("element_id") % 10 == 1), "container_id")
    return r.select("element_id", B.stable_selector(name).alias("selector"), "left", "right", "top", "bottom")


_BY_TOLERANCE = """list_reduce(list_transform({0}, lambda x: [{{'first': x, 'last': x, 'total': x, 'n': 1}}]),
        lambda a, x: CASE WHEN x[1].first - a[-1].last > {1} OR x[1].first - a[-1].first > 2 * {1} THEN a || x
                     ELSE a[1:-2] || [{{'first': a[-1].first, 'last': x[1].last, 'total': a[-1].total + x[1].total, 'n': a[-1].n + 1}}] END)"""
_DETECTED = f"""{_BOXES},
    m AS (SELECT container_id, list_sort(list(bottom_ - top_)) AS hs, list_sort(list_filter(list(right_ - left_), lambda x: x > 0)) AS ws, list_sort(list(top_) || list(bottom_)) AS ys, list_sort(list(left_) || list(right_)) AS xs, count(*) AS n FROM b GROUP BY container_id),
    t AS (SELECT *, greatest(15.0, least(50.0, 0.6::DOUBLE * coalesce(hs[len(hs) // 2 + 1], 20)))::DOUBLE AS rt, greatest(15.0, least(50.0, 0.6::DOUBLE * coalesce(ws[len(ws) // 2 + 1], 50)))::DOUBLE AS ct FROM m),
    g AS (SELECT container_id, n, list_transform({_BY_TOLERANCE.format("ys", "rt")}, lambda c: c.total / c.n) AS ys, list_transform({_BY_TOLERANCE.format("xs", "ct")}, lambda c: c.total / c.n) AS xs FROM t),
    s AS (SELECT *, len(ys) - 1 AS n_rows, len(xs) - 1 AS n_columns FROM g),
    p AS (SELECT container_id, element_id, n_columns,
                 list_filter(range(1, len(ys)), lambda i: top_ >= ys[i] - 10 AND top_ < ys[i + 1] + 10)[1] AS r0, list_filter(range(1, len(ys)), lambda i: bottom_ > ys[i] - 10 AND bottom_ <= ys[i + 1] + 10)[1] AS r1,
                 list_filter(range(1, len(xs)), lambda i: left_ >= xs[i] - 10 AND left_ < xs[i + 1] + 10)[1] AS c0, list_filter(range(1, len(xs)), lambda i: right_ > xs[i] - 10 AND right_ <= xs[i + 1] + 10)[1] AS c1
          FROM b JOIN s USING (container_id) WHERE n >= 4 AND NOT (n_rows < 2 AND n_columns < 2) AND n_rows * n_columns >= 2),
    k AS (SELECT * FROM p WHERE r1 >= r0 AND c1 >= c0),
    u AS (SELECT DISTINCT container_id, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT container_id, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM k)),
    f AS (SELECT container_id, sum(n) AS filled, sum(n * n) AS squares FROM (SELECT container_id, r, count(*) AS n FROM u GROUP BY ALL) GROUP BY container_id),
    a AS (SELECT s.container_id, n_rows, n_columns, n, (SELECT count(*) FROM k WHERE k.container_id = s.container_id) AS cells, coalesce(filled, 0)::DOUBLE / (n_rows * n_columns) AS fill, coalesce(filled, 0)::DOUBLE / n_rows AS mean, coalesce(squares, 0)::DOUBLE / n_rows AS squares
          FROM s LEFT JOIN f USING (container_id)),
    q AS (SELECT *, CASE WHEN n_rows >= 2 AND n_columns >= 2 THEN 0.3 ELSE 0.2 END + CASE WHEN fill >= 0.5 THEN 0.25 WHEN fill >= 0.3 THEN 0.2 WHEN fill >= 0.15 THEN 0.1 ELSE 0 END
                 + 0.25::DOUBLE / (1 + (squares - mean * mean) / greatest(1.0, mean * mean)) + CASE WHEN n_rows >= 3 THEN 0.1 ELSE 0 END + CASE WHEN n_columns >= 2 THEN 0.05 ELSE 0 END + CASE WHEN n_rows >= 5 THEN 0.05 ELSE 0 END AS score FROM a),
    d AS (SELECT container_id, n_rows, n_columns, cells, fill, CASE WHEN cells < 2 THEN 0 ELSE least(1.0, CASE WHEN fill < 0.15 THEN score * 0.7 ELSE score END) END::DOUBLE AS confidence FROM q WHERE n >= 4 AND NOT (n_rows < 2 AND n_columns < 2) AND n_rows * n_columns >= 2)"""


@query("S36", f"""
    WITH {_DETECTED}
    SELECT b.container_id, coalesce(any_value(n_rows), 0)::INT AS n_rows, coalesce(any_value(n_columns), 0)::INT AS n_columns, coalesce(any_value(cells), 0)::INT AS cells, round(coalesce(any_value(confidence), 0), 6) AS confidence,
           coalesce(any_value(cells >= 2 AND (confidence >= 0.35 OR fill >= 0.4)), false) AS is_table FROM b LEFT JOIN d USING (container_id) GROUP BY b.container_id""")
def table_detection(spark, sf):
    b = _boxes(spark, sf).withColumnRenamed("element_id", "id").groupBy("container_id").agg(T.box_array().alias("boxes"))
    g = b.select("container_id", T.grid(F.col("boxes")).alias("g"))
    return g.select("container_id", "g.n_rows", "g.n_columns", F.coalesce(F.size("g.cells"), F.lit(0)).alias("cells"), F.round("g.confidence", 6).alias("confidence"), "g.is_table").withColumn("cells", F.greatest("cells", F.lit(0)))


_STACK = """o AS (SELECT o_custkey AS container_id, o_orderkey AS node, 2 + o_orderkey % 2 AS n_columns, (o_orderkey % 3) * 6.0::DOUBLE AS l, 400.0::DOUBLE + o_orderkey % 4 * 5 AS r,
        (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 90)::DOUBLE AS t, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 90 + 30 + o_orderkey % 5 * 12)::DOUBLE AS b FROM orders)"""


@query("W10", f"""
    WITH {_STACK}, n AS (SELECT *, CASE WHEN abs(l - lag(l) OVER w) <= 10 AND abs(r - lag(r) OVER w) <= 10 AND t - lag(b) OVER w <= 50 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY container_id, n_columns ORDER BY t, node))
    SELECT container_id, node, n_columns::INT AS n_columns, CAST(sum(fresh) OVER (PARTITION BY container_id, n_columns ORDER BY t, node) AS BIGINT) AS "group" FROM n""")
def stacked_tables(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey")
    key, n = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    boxes = o.select(F.col("o_custkey").alias("container_id"), key.alias("node"), (2 + key % 2).cast("int").alias("n_columns"), ((key % 3) * 6.0).alias("left"), (400.0 + key % 4 * 5).alias("right"), (n * 90).cast("double").alias("top"))
    boxes = boxes.withColumn("bottom", F.col("top") + 30 + F.col("node") % 5 * 12)
    return T.stacked_groups(boxes, "container_id", "node").select("container_id", "node", "n_columns", F.col("group").cast("long").alias("group"))


#: Lines of the customers in one part: some 160,000 elements, so that a task's sorts stay in memory.
LINES = 50_000


@query("S37")
def table_discovery(spark, sf):
    """A customer's orders as a tree of regions: each order holds its lines, each line three cells with boxes;
    every other order has a box of its own, the others get one from below."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    parts = lines.count() // LINES + 1
    lines = lines.groupBy("l_orderkey").agg(F.collect_set(F.struct("l_linenumber")).alias("lines"))
    # orders, with numbers for their lines, are shuffled by customer once: elements are made, and meet, where they are then
    orders = table(spark, sf, "orders", "o_custkey", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").repartition(parts, "o_custkey")
    by_order, whole = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey")
    numbers = F.transform("lines", lambda x: x["l_linenumber"])
    orders = orders.withColumns({"rank": F.dense_rank().over(by_order), "n": F.row_number().over(by_order), "before": F.lag("o_orderkey").over(by_order)})
    orders = orders.withColumns({"top": F.col("rank") * 400.0 + F.array_min(numbers) * 40.0, "bottom": F.col("rank") * 400.0 + F.array_max(numbers) * 40.0 + 30})
    orders = orders.withColumns({"r_top": F.min("top").over(whole), "r_bottom": F.max("bottom").over(whole)})

    name = lambda of, *parts: F.concat_ws("/", F.lit(of), *(F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts))
    def element(key, depth, id_, parent, left, top, right, bottom):  # noqa: E306
        sides = {"left": left, "top": top, "right": right, "bottom": bottom}
        return F.array(F.struct(key.cast("long").alias("key"), F.lit(depth).alias("depth"), id_.alias("id"), parent.cast("string").alias("parent"), *(v.cast("double").alias(c) for c, v in sides.items())))

    rows = orders.select("*", F.posexplode("lines")).withColumn("line", F.col("col.l_linenumber"))
    even, top = F.col("o_orderkey") % 2 == 0, F.col("rank") * 400.0 + F.col("line") * 40.0
    first = (F.col("pos") == 0) & ~F.col("before").eqNullSafe(F.col("o_orderkey"))
    root = element(F.lit(0), 0, name("c", "o_custkey"), F.lit(None), F.lit(0.0), F.col("r_top"), F.lit(340.0), F.col("r_bottom"))
    order = element(F.col("o_orderkey"), 1, name("o", "o_orderkey"), name("c", "o_custkey"), F.when(even, -4.0), F.when(even, F.col("top") - 4), F.when(even, 344.0), F.when(even, F.col("bottom") + 4))
    cells = [element(F.col("o_orderkey"), 2, name("l", "o_orderkey", "line", k), name("o", "o_orderkey"), F.lit(k * 120.0), top, F.lit(k * 120.0 + 100), top + 30) for k in range(3)]
    some = lambda when, e: F.filter(e, lambda x: when)
    tree = rows.select("o_custkey", F.inline(F.concat(some((F.col("pos") == 0) & (F.col("n") == 1), root), some(first, order), *cells)))
    tree = tree.withColumn("node", F.row_number().over(Window.partitionBy("o_custkey").orderBy("key", "depth", "id")) - 1)
    last = F.when(F.col("depth") == 0, F.max("node").over(whole)).when(F.col("depth") == 1, F.max("node").over(Window.partitionBy("o_custkey", "key"))).otherwise(F.col("node"))
    found = T.discover(tree.withColumn("last", last).drop("key"), "o_custkey")
    return found.select("o_custkey", "id", "depth", "grid.n_rows", "grid.n_columns", F.round("grid.confidence", 6).alias("confidence"), F.size("leaves").alias("n_leaves"), "shared")


@query("W2 D7", f"""
    WITH {_DETECTED}
    SELECT container_id, signature FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY confidence DESC, n_leaves DESC, container_id) AS n
        FROM (SELECT container_id, round(any_value(confidence), 6) AS confidence, count(*) AS n_leaves, 'div:' || count(*) || '|' || left(string_agg(text, ' ' ORDER BY element_id), 200) AS signature FROM b JOIN d USING (container_id) GROUP BY container_id)) WHERE n = 1""")
def alike_tables(spark, sf):
    b = _boxes(spark, sf).withColumnRenamed("element_id", "id")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ")
    t = b.groupBy("container_id").agg(T.box_array().alias("boxes"), words.alias("words"))
    # a filter on the grid would be pushed down to where the boxes are, and the grid worked out there a second time
    t = t.select("container_id", "boxes", "words", F.explode(F.filter(F.array(T.grid(F.col("boxes"))), lambda g: g["n_rows"] > 0)).alias("g"))
    signature = F.concat(F.lit("div:"), F.size("boxes").cast("string"), F.lit("|"), F.left("words", F.lit(200)))
    t = t.select("container_id", F.col("container_id").alias("place"), F.round("g.confidence", 6).alias("confidence"), F.size("boxes").alias("n_leaves"), signature.alias("signature"))
    return T.best_of_alike(t, "signature").select("container_id", "signature")
