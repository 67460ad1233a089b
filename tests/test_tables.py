"""Tables on generated pages against plain versions that walk them one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import tables as T
from gleaner.streaming.rounds import checkpointed

BOX = "struct<id:string,left:double,top:double,right:double,bottom:double>"


def clusters(edges, tolerance):
    groups = []
    for e in sorted(edges):
        if groups and e - groups[-1][0] <= 2 * tolerance and e - groups[-1][-1] <= tolerance:
            groups[-1].append(e)
        else:
            groups.append([e])
    return [sum(g) / len(g) for g in groups]


def plain_grid(boxes):
    """boxes: (id, left, top, right, bottom) -> is_table, confidence, rows, columns, cells."""
    if len(boxes) < 4:
        return False, 0.0, 0, 0, []

    def edges(lo, hi, usual):
        sizes = sorted(b[hi] - b[lo] for b in boxes if b[hi] > b[lo])
        t = max(15.0, min(50.0, (sizes[len(sizes) // 2] if sizes else usual) * 0.6))
        return clusters([b[lo] for b in boxes] + [b[hi] for b in boxes], t)

    rows, columns = edges(2, 4, 20.0), edges(1, 3, 50.0)
    n, m = len(rows) - 1, len(columns) - 1
    if n < 2 and m < 2 or n * m < 2:
        return False, 0.0, 0, 0, []

    def place(e, v, start):
        for i in range(len(e) - 1):
            if start and e[i] - 10 <= v < e[i + 1] + 10 or not start and e[i] - 10 < v <= e[i + 1] + 10:
                return i
        return -1

    cells = []
    for b in boxes:
        c = (place(rows, b[2], True), place(rows, b[4], False), place(columns, b[1], True), place(columns, b[3], False))
        if 0 <= c[0] <= c[1] and 0 <= c[2] <= c[3]:
            cells.append((b[0], *c))
    if len(cells) < 2:
        return False, 0.0, n, m, cells
    taken = {(r, k) for _, a, b, c, d in cells for r in range(a, b + 1) for k in range(c, d + 1)}
    fill, fills = len(taken) / (n * m), [sum((r, k) in taken for k in range(m)) for r in range(n)]
    mean = sum(fills) / n
    spread = sum((f - mean) ** 2 for f in fills) / n if mean else 0.0
    score = (0.3 if n >= 2 and m >= 2 else 0.2) + (0.25 if fill >= 0.5 else 0.2 if fill >= 0.3 else 0.1 if fill >= 0.15 else 0.0) + 0.25 / (1 + spread / max(1.0, mean * mean))
    score += 0.1 * (n >= 3) + 0.05 * (m >= 2) + 0.05 * (n >= 5)
    score = min(1.0, score * 0.7 if fill < 0.15 else score)
    return score >= 0.35 or fill >= 0.4, score, n, m, cells


def got_grid(g):
    return g.is_table, round(g.confidence, 9), g.n_rows, g.n_columns, [tuple(c) for c in g.cells or []]


def rounded(g):
    return g[0], round(g[1], 9), *g[2:]


def test_grid(spark):
    rnd, cases = random.Random(4), []
    for n in range(150):
        if n % 3 == 0:
            boxes = [(f"{r}-{c}", c * 110.0 + rnd.randint(-8, 8), r * 40.0 + rnd.randint(-4, 4), c * 110 + 90.0 + rnd.randint(-8, 60), r * 40 + 30.0) for r in range(rnd.randint(1, 6)) for c in range(rnd.randint(1, 4)) if rnd.random() < 0.8]
        else:
            boxes = [(str(i), x := rnd.uniform(0, 600), y := rnd.uniform(0, 400), x + rnd.choice([0, 5, 60, 200]), y + rnd.choice([0, 8, 30, 120])) for i in range(rnd.randint(0, 14))]
        cases.append((n, sorted(boxes)))
    df = spark.createDataFrame(cases, f"n int, boxes array<{BOX}>")
    for r in df.select("n", T.grid(F.col("boxes")).alias("g")).collect():
        assert got_grid(r.g) == rounded(plain_grid(cases[r.n][1])), cases[r.n]
    assert sum(plain_grid(b)[0] for _, b in cases) > 40


def plain_groups(rows):
    out = []
    for c, m in sorted({(r[0], r[6]) for r in rows}):
        last = None
        for r in sorted((r for r in rows if (r[0], r[6]) == (c, m)), key=lambda r: (r[3], r[1])):
            if not (last and abs(r[2] - last[2]) <= 10 and abs(r[4] - last[4]) <= 10 and r[3] - last[5] <= 50):
                out.append([])
            out[-1].append((r[0], r[1]))
            last = r
    return sorted(map(sorted, out))


def test_stacked_groups(spark):
    rnd = random.Random(6)
    rows = [(c, i, float(rnd.choice([0, 8, 15, 25])), float(top := rnd.randint(0, 20) * 35), float(300 + rnd.choice([0, 9, 20])), float(top + rnd.choice([20, 60, 200])), rnd.choice([2, 3])) for c in range(12) for i in range(rnd.randint(0, 12))]
    df = spark.createDataFrame(rows, "c int, node int, left double, top double, right double, bottom double, n_columns int").repartition(3)
    groups = {}
    for r in T.stacked_groups(df, "c", "node").collect():
        groups.setdefault((r.c, r.n_columns, r.group), []).append((r.c, r.node))
    assert sorted(map(sorted, groups.values())) == plain_groups(rows)


# -- discovery
def page(rnd):
    """A tree of regions: [id, children, box or None]."""
    number = iter(range(10_000))
    new = lambda children, box: [f"e{next(number)}", children, box]

    def around(children, extra=6.0):
        boxes = [c[2] for c in children if c[2]]
        return (min(b[0] for b in boxes) - extra, min(b[1] for b in boxes) - extra, max(b[2] for b in boxes) + extra, max(b[3] for b in boxes) + extra) if boxes else None

    def table(x, y, n, m):
        rows = []
        for r in range(n):
            cells = [new([], (x + c * 100.0, y + r * 40.0, x + c * 100 + 80.0, y + r * 40 + 30.0)) for c in range(m) if rnd.random() < 0.9]
            rows.append(new(cells, around(cells, 0.0) if rnd.random() < 0.5 else None))
        return new(rows, around(rows) if rnd.random() < 0.7 else None), y + n * 40.0

    def block(x, y, depth):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            if depth < 2 and rnd.random() < 0.4:
                part, y = block(x, y, depth + 1)
            else:
                part, y = table(x, y, rnd.randint(1, 5), rnd.choice([1, 2, 3, 3]))
            parts.append(part)
            y += rnd.choice([10.0, 30.0, 80.0])
        return new(parts, around(parts, 10.0) if rnd.random() < 0.7 else None), y

    return block(0.0, 0.0, 0)[0]


def flat(root):
    rows = []

    def visit(e, parent, depth):
        row = [e[0], parent, len(rows), 0, depth, *(e[2] or (None,) * 4)]
        rows.append(row)
        for c in e[1]:
            visit(c, e[0], depth + 1)
        row[3] = len(rows) - 1

    visit(root, None, 0)
    return [tuple(r) for r in rows]


def inside(i, o):
    return i[0] >= o[0] - 5 and i[1] >= o[1] - 5 and i[2] <= o[2] + 5 and i[3] <= o[3] + 5 and (i[2] - i[0] < (o[2] - o[0]) * 0.95 or i[3] - i[1] < (o[3] - o[1]) * 0.95)


def plain_discover(root):
    rows = flat(root)
    boxes = {r[0]: r[5:9] for r in rows if r[5] is not None}
    leaves = {i: b for i, b in boxes.items() if not any(j != i and inside(c, b) for j, c in boxes.items())}
    every, made = dict(boxes), set()

    def box(e):
        if e[0] in boxes:
            for c in e[1]:
                box(c)
            return boxes[e[0]]
        below = [b for b in map(box, e[1]) if b]
        if below:
            made.add(e[0])
            every[e[0]] = (min(b[0] for b in below), min(b[1] for b in below), max(b[2] for b in below), max(b[3] for b in below))
            return every[e[0]]

    box(root)
    candidates = []

    def visit(e, depth):
        if depth > 15:
            return
        if e[0] in every:
            b = every[e[0]]
            large = b[3] - b[1] >= 100 and b[2] - b[0] >= 200
            if large or e[0] in made:
                below = lambda e: [e[0], *(x for c in e[1] for x in below(c))]
                own = [i for i in leaves if i != e[0] and inside(leaves[i], b)] if large else [i for i in below(e)[1:] if i in leaves]
                g = plain_grid(sorted((i, *leaves[i]) for i in own)) if len(own) >= 6 else (False, 0)
                if g[0] and g[1] >= 0.5:
                    candidates.append({"id": e[0], "depth": depth, "leaves": set(own), "grid": g, "box": b, "at": len(candidates)})
        for c in e[1]:
            visit(c, depth + 1)

    visit(root, 0)
    groups = plain_groups([(c["grid"][3], c["at"], *c["box"], c["grid"][3]) for c in candidates])
    by = {c["at"]: c for c in candidates}
    complete = lambda g: g[2] >= 2 and g[3] >= 2 and g[1] >= 0.5
    above = {}
    for n, group in enumerate(groups):
        mine = {at for _, at in group}
        if len(mine) > 1:
            wanted = set().union(*(by[a]["leaves"] for a in mine))
            over = sorted((c for c in candidates if c["at"] not in mine and wanted <= c["leaves"]), key=lambda c: c["depth"])
            if over:
                above[n] = over[0]["at"]
    uses = Counter(above.values())
    out, done, taken = {}, set(), set()
    for n, a in above.items():
        if uses[a] < 3 and complete(by[a]["grid"]):
            out[by[a]["id"]] = (by[a]["grid"], True)
            taken |= by[a]["leaves"]
            done |= {a, *(at for _, at in groups[n])}
    for c in sorted((c for c in candidates if c["at"] not in done and uses[c["at"]] < 3), key=lambda c: c["depth"]):
        left = c["leaves"] - taken
        if not left:
            continue
        g = c["grid"] if left == c["leaves"] else plain_grid(sorted((i, *leaves[i]) for i in left)) if len(left) >= 6 else (False, 0, 0, 0)
        if g[0] and complete(g):
            out[c["id"]] = (g, False)
            taken |= left
    return out


def test_discovery(spark):
    rnd = random.Random(12)
    pages = [page(rnd) for _ in range(40)]
    rows = [(n, *r) for n, p in enumerate(pages) for r in flat(p)]
    df = spark.createDataFrame(rows, "page int, id string, parent string, node int, last int, depth int, left double, top double, right double, bottom double").repartition(4)
    got = {}
    for r in T.discover(df, "page", checkpointed).collect():
        assert r.id not in got.setdefault(r.page, {})
        got[r.page][r.id] = (got_grid(r.grid), r.shared)
    shared = 0
    for n, p in enumerate(pages):
        want = {i: (rounded(g), s) for i, (g, s) in plain_discover(p).items()}
        assert got.get(n, {}) == want
        shared += sum(s for _, s in want.values())
    assert sum(map(len, got.values())) > 40 and shared > 3
    assert T.discover(df.limit(0), "page", checkpointed).count() == 0


def test_discovery_works_out_its_elements_once(spark):
    """What the elements come from (joins and windows, say) isn't repeated for each level and join."""
    rnd, read = random.Random(3), spark.sparkContext.accumulator(0)
    rows = [(n, *r) for n in range(3) for r in flat(page(rnd))]
    kinds = "page int, id string, parent string, node int, last int, depth int, left double, top double, right double, bottom double"

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    T.discover(spark.createDataFrame(rows, kinds).mapInArrow(counted, kinds), "page", checkpointed).collect()
    assert len(rows) <= read.value <= 2 * len(rows)


def test_discovery_shuffles_its_elements_once_and_stores_none(spark):
    """Elements, pairs of boxes and candidates with their leaves meet where a container's elements are."""
    from gleaner.plans import catalog

    rnd, stored = random.Random(5), []
    rows = [(n, *r) for n in range(3) for r in flat(page(rnd))]
    df = spark.createDataFrame(rows, "page int, id string, parent string, node int, last int, depth int, left double, top double, right double, bottom double")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    keep = lambda df: stored.append(df) or checkpointed(df)
    assert exchanges(T.discover(df, "page", keep)) == 1
    assert exchanges(T.discover(df.repartition(5, "page"), "page", keep)) == 1  # the caller's own
    assert not stored
    # lines and orders by order, and these by customer
    assert exchanges(catalog.QUERIES["table_discovery"](spark, "/root/testdata/sf0.001")) <= 3


def test_boxes_come_from_below_through_chains(spark):
    """A chain of elements without boxes, one beside it that never gets any, and a box within one that ends a chain."""
    rows = [
        ("a", None, 0, 7, 0, None), ("b", "a", 1, 4, 1, None), ("c", "b", 2, 3, 2, None), ("d", "c", 3, 3, 3, (10.0, 20.0, 30.0, 40.0)), ("e", "b", 4, 4, 2, (0.0, 30.0, 5.0, 90.0)),
        ("f", "a", 5, 5, 1, None), ("g", "a", 6, 7, 1, (50.0, 0.0, 60.0, 10.0)), ("h", "g", 7, 7, 2, (0.0, 0.0, 900.0, 900.0)),
    ]
    kinds = "page int, id string, parent string, node int, last int, depth int, left double, top double, right double, bottom double"
    df = spark.createDataFrame([(p, *r[:5], *(r[5] or (None,) * 4)) for p in (1, 2) for r in rows], kinds).repartition(3)
    got = {(r.page, r.id): (r.left, r.top, r.right, r.bottom) for r in T.with_boxes(df, "page").filter("made").collect()}
    assert got == {(p, i): b for p in (1, 2) for i, b in {"c": (10.0, 20.0, 30.0, 40.0), "b": (0.0, 20.0, 30.0, 90.0), "a": (0.0, 0.0, 60.0, 90.0)}.items()}
    assert T.with_boxes(df, "page").filter("not made").count() == 8


def test_best_of_alike(spark):
    rows = [("a", 0.6, 9, 1), ("a", 0.8, 6, 2), ("a", 0.8, 7, 3), ("a", 0.8, 7, 4), ("b", 0.5, 6, 5)]
    df = spark.createDataFrame(rows, "signature string, confidence double, n_leaves int, place int")
    assert sorted(r.place for r in T.best_of_alike(df, "signature").collect()) == [3, 5]


def test_alike_tables_work_grids_out_once(spark):
    """The grid isn't in a filter's copy as well, and an order's lines are shuffled once before it."""
    from gleaner.plans import catalog

    query = catalog.QUERIES["alike_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert sum("aggregate(" in line for line in query.optimizedPlan().toString().split("\n")) == 1
    assert query.executedPlan().toString().count("Exchange") == 2  # by order, and by signature


def test_best_matches_sort_only_pairs_that_count(spark):
    """Pairs below the least overlap are dropped before a region's best is looked for; what is found stays."""
    from gleaner.operators.spatial import best_matches

    boxes = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0), (1, 2, 2.0, 12.0, 0.0, 10.0), (1, 3, 90.0, 99.0, 0.0, 10.0), (2, 4, 0.0, 10.0, 0.0, 10.0)], "c int, element_id int, left double, right double, top double, bottom double")
    regions = spark.createDataFrame([(1, 7, 1.5, 11.5, 0.0, 10.0), (1, 8, 40.0, 50.0, 0.0, 10.0)], boxes.schema)
    found = best_matches(regions, boxes, "c", 0.5)
    assert [(r.region_id, r.element_id) for r in found.collect()] == [(7, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Aggregate [r_element_id" in line)
    assert any(">= 0.5" in line for line in plan[at:]) and not any(">= 0.5" in line for line in plan[:at])
