"""Dataflow operators on small tables against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner import sinks
from gleaner.functions import html as H
from gleaner.functions import text as X
from gleaner.operators import dedup as D
from gleaner.streaming import flows as S
from gleaner.streaming.stages import run_stages


def test_adaptive_limits_against_a_fold(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.6 else draw.choice(["a", "b", None]), draw.randrange(40_000_000), i, draw.choice([True, False, False, None] + [False] * 150)) for i in range(6000)]
    rows += [("calm", i, i, False) for i in range(25)] + [("limited", i, i, True) for i in range(9)]
    got = {r.k: (r.limit, r.events) for r in S.adaptive_limits(spark.createDataFrame(rows, "k string, at long, n long, x boolean"), "k", "at", "n", "x").collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        rate, own = S.Rate(), sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        for r in own:
            rate.step(bool(r[3]))
        expected[key] = (rate.limit, len(own))
    assert got == expected and 1 < expected["hot"][0] < 100 and expected["limited"][0] == 1


def test_adaptive_limits_of_no_events(spark):
    assert S.adaptive_limits(spark.createDataFrame([], "k string, at long, n long, x boolean"), "k", "at", "n", "x").collect() == []


def test_stages_go_on_after_a_failure(spark, tmp_path):
    items = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, whole boolean")
    runs = []

    def work(name, fails=False):
        def run(df):
            runs.append(name)
            if fails:
                raise RuntimeError(name)
            return df.withColumn("n", F.coalesce(F.col("n"), F.lit(0)) + 1 if "n" in df.columns else F.lit(1))

        return run

    with pytest.raises(RuntimeError):
        run_stages(items, [("one", F.lit(True), work("one")), ("two", F.col("whole"), work("two", True))], str(tmp_path))
    done = run_stages(items, [("one", F.lit(True), work("one")), ("two", F.col("whole"), work("two"))], str(tmp_path))
    assert sorted((r.id, r.n, r.stage) for r in done.collect()) == [(1, 2, "two"), (2, 1, "one"), (3, 1, "one")]
    assert runs == ["one", "two", "two"]


def test_stages_stop_early(spark, tmp_path):
    items = spark.createDataFrame([(1,)], "id int")
    done = run_stages(items, [("one", F.lit(True), lambda df: df), ("two", F.lit(True), lambda df: df)], str(tmp_path), stop=lambda df: df.count() == 1)
    assert done.first().stage == "one"


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    write = sinks.batch_writer(str(tmp_path / "log"))
    for rows in ([(1,), (2,)], [(2,)]):
        write(spark.createDataFrame(rows, "x int"), 0)
    write(spark.createDataFrame([(3,)], "x int"), 1)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [2, 3]


def pieces(text):
    """The chunks of a text, by plain loops."""
    if len(text) <= 2000:
        return [text]
    out, start = [""], 0
    for m in re.finditer(r"\n\s*\n|!\[[^\]]*\]\([^)]*\)|\|\s*\n(?!\|)|[.!?]\s+|\Z", text):
        if m.end() <= start:
            continue
        if len(out[-1]) >= 1500:
            out.append("")
        out[-1] += text[start : m.end()]
        start = m.end()
    if len(out) > 1 and len(out[-1]) < 500:
        out[-2:] = [out[-2] + out[-1]]
    return out


def test_chunks_break_where_plain_python_does(spark):
    draw = random.Random(5)
    units = ["word " * 9, "A sentence ends. ", "Does it? ", "\n\n", "![a](b.png)", "| a | b |\n", "\n", "x" * 700 + "! "]
    texts = ["", "short", "y" * 5000] + ["".join(draw.choice(units) for _ in range(draw.randrange(400))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.chunks(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: pieces(t) for i, t in enumerate(texts)}
    assert max(len(r.c) for r in rows) > 3


def one(spark, function, *values):
    return spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values)))).select(function(*[F.col(f"x{i}") for i in range(len(values))]).alias("y")).first().y


def test_selectors(spark):
    html = '<div class="a ad b">1</div><div class="adx">2</div><p id="q">3</p><p data-k="v">4</p><img alt="5">'
    assert one(spark, lambda c: H.replace_elements(c, {"div.ad": "$1\\", "p#q": None, 'p[data-k="v"]': "k", "img": "i"}), html) == '<span>$1\\</span><div class="adx">2</div><span>k</span><span>i</span>'
    assert one(spark, lambda c: H.element_html(c, "p"), html) == '<p id="q">3</p>'
    assert one(spark, lambda c: H.element_text(c, "p"), html) == "4"
    assert one(spark, lambda c: H.element_html(c, "table"), html) is None and one(spark, lambda c: H.element_text(c, "table"), html) is None
    with pytest.raises(ValueError):
        H.element_pattern("div > p")


def test_placeholders_of_repeated_elements_come_back(spark):
    html = "<ul>" + "".join(f"<li>{i % 3} $0 \\ </li>" for i in range(12)) + "</ul>"
    marked = one(spark, lambda c: H.with_placeholders(c, "li", "M"), html)
    assert marked.html.count("{{M_") == 12 and len(marked.elements) == 12 and marked.elements["M_11"] == "<li>2 $0 \\ </li>"
    assert one(spark, lambda c: H.restored(H.with_placeholders(c, "li", "M")["html"], H.with_placeholders(c, "li", "M")["elements"]), html) == html
    assert one(spark, lambda c: H.with_placeholders(c, "li", "M"), "none").html == "none"


def test_link_descriptors(spark):
    html = '<a href="/a#x">one</a><a href="/a">again</a><a href="/b" aria-label="label"></a><a href="/c"><img alt="alt"></a><a title="t" href="/d"> </a><a href="/e"></a><a href="https://h/f">f</a><a href="//h/g">g</a><a href="mailto:x">m</a><a>n</a><a href="#y">y</a>'
    assert [tuple(d) for d in one(spark, H.link_descriptors, html)] == [("/a", "one"), ("/b", "label"), ("/c", "alt"), ("/d", "t"), ("/e", "[no text]")]


def test_known_links_take_the_first_and_hold_scores(spark):
    ranking = spark.createDataFrame([("a", 1, 99), ("a", 2, 5), ("b", 1, -3), ("made up", 1, 5)], "url string, place int, score int")
    known = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "url string")
    assert sorted(tuple(r) for r in D.known_links(ranking, known, ["url"], "place", "score").select("url", "score").collect()) == [("a", 10), ("b", 1)]


def test_query_check(spark):
    checked = lambda t: tuple(one(spark, X.checked_query, t))
    assert checked(" a\r\nb\nc ") == ("a b c", None) and checked("\n") == ("", "blank") and checked(None) == ("", "blank")
    assert checked("x" * 1001)[1] == "too long" and checked("x" * 1000)[1] is None


def test_refilling_bucket_against_a_fold(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.randrange(3_000_000), i, draw.choice([0, 1, 1, 2, 9])) for i in range(1500)]
    got = {r.n: (r.level, r.accepted) for r in S.refilling_bucket(spark.createDataFrame(rows, "k string, at long, n long, c int"), "k", "at", "n", "c", 5, 60_000, 50_000).collect()}
    for key in {r[0] for r in rows}:
        level, last = 5 * 60_000, None
        for _, at, n, cost in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            level, last = min(5 * 60_000, level + (0 if last is None else (at - last) * 5)), at
            assert got.pop(n) == (level, level >= cost * 60_000)
            level = max(0, level - cost * 60_000)
    assert not got


def test_a_worker_goes_through_its_queue(spark, tmp_path):
    from gleaner.operators import merge as M

    rows = [(i, "ab"[i % 2], "PENDING", 0, 1 + i % 3, 0) for i in range(20)] + [(50, "a", "COMPLETED", 1, 3, 0)]
    df = spark.createDataFrame(rows, "task_id long, kind string, status string, attempts int, max_attempts int, updated_at_ms long")
    path = str(tmp_path)
    seen = []

    def process(claimed):
        ids = sorted(r.task_id for r in claimed.collect())
        seen.append(ids)
        return claimed.filter("task_id % 7 != 3").select("task_id", (F.col("task_id") % 4 != 1).alias("ok"))  # 3, 10 and 17 get no answer

    last = M.work(df, process, lambda v: sinks.read_snapshot(spark, path, v), lambda t, v: sinks.write_snapshot(t, path, v), 3, 9, 50)
    want, queue, claims = {r[0]: list(r) for r in rows}, None, []
    while pending := [r for r in want.values() if r[2] == "PENDING"]:
        queue = [r for kind in "ab" for r in sorted((p for p in pending if p[1] == kind), key=lambda r: r[0])[:3]]
        claims.append(sorted(r[0] for r in queue))
        for r in queue:
            r[3], r[5] = r[3] + 1, 9
            fails = r[0] % 7 == 3 or r[0] % 4 == 1
            r[2] = "COMPLETED" if not fails else "PENDING" if r[3] < r[4] else "FAILED"
    assert seen == claims and last == len(claims)
    assert sorted(map(tuple, sinks.read_snapshot(spark, path, last).select(df.columns).collect())) == sorted(map(tuple, want.values()))


def test_containment_against_all_kept_texts(spark):
    draw = random.Random(14)
    words = ["alpha", "beta", "gamma", "delta", "no", "of", "omega", "kappa"]
    rows = [(draw.randrange(8), i, draw.choice([None, "", "of no"]) if draw.random() < 0.1 else " ".join(draw.choices(words, k=draw.randint(1, 9)))) for i in range(300)]

    def plain(texts):
        kept = []
        share = lambda a, b: 1.0 if not a else len(a & b) / len(a)
        for n, text in texts:
            text = text or ""
            own = {w for w in text.split() if len(w) > 2}
            around = next((k for k, (_, other, size) in enumerate(kept) if share(other, own) > 0.8 and len(text) > size), None)
            if around is not None:
                kept[around] = (n, own, len(text))
            elif not any(share(own, other) > 0.8 for _, other, _ in kept):
                kept.append((n, own, len(text)))
        return [k[0] for k in kept]

    got = {}
    for r in D.containment(spark.createDataFrame(rows, "c int, n int, t string").repartition(3), "c", ["n"], "t").collect():
        got.setdefault(r.c, []).append(r.n)
    for c in range(8):
        assert sorted(got.get(c, [])) == sorted(plain([(n, t) for k, n, t in rows if k == c]))


def test_the_smallest_rows(spark):
    from gleaner.streaming.rounds import checkpointed

    draw = random.Random(1)
    values = [draw.randrange(500) for _ in range(700)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(4)
    for n in (0, 1, 37, 350, 699, 700, 5000):
        got = sorted((r.v, r.i) for r in S.smallest(rows, [F.col("v"), F.col("i")], n, checkpointed).collect())
        assert got == sorted((v, i) for i, v in enumerate(values))[:n]
    assert S.smallest(rows.limit(0), [F.col("v")], 5, checkpointed).count() == 0


def test_a_crawl_ends_in_time(spark):
    from gleaner.streaming.rounds import checkpointed

    links = spark.createDataFrame([(f"http://a/{i}", f"http://a/{i + 1}") for i in range(9)], "from_url string, to_url string")
    rounds = iter([False, True])
    got = S.crawl(spark.createDataFrame([("http://a/0",)], "url string"), links, "http://a/", 100, 9, checkpointed, lambda: next(rounds))
    assert sorted((r.url, r["round"]) for r in got.collect()) == [("http://a/0", 0), ("http://a/1", 1)]


def test_a_crawl_without_a_bound(spark):
    from gleaner.streaming.rounds import checkpointed

    links = spark.range(300).select(F.concat(F.lit("http://a/"), F.floor(F.col("id") / 20).cast("string")).alias("from_url"), F.concat(F.lit("http://a/"), F.col("id").cast("string")).alias("to_url"))
    got = S.crawl(spark.createDataFrame([("http://a/0",)], "url string"), links.unionByName(links), "http://a/", None, 9, checkpointed)
    want = {f"http://a/{n}": 0 if n == 0 else 1 if n < 20 else 2 for n in range(300)}
    assert sorted((r.url, r["round"]) for r in got.collect()) == sorted(want.items())


@pytest.mark.parametrize("each", [None, 3])
def test_a_worker_broadcasts_no_tasks(spark, tmp_path, each):
    from gleaner.operators import merge as M

    rows = [(i, "ab"[i % 2], "PENDING", 0, 2, 0) for i in range(8)]
    df = spark.createDataFrame(rows, "task_id long, kind string, status string, attempts int, max_attempts int, updated_at_ms long")
    path, plans = str(tmp_path), []

    def write(t, v):
        plans.append(t._jdf.queryExecution().executedPlan().toString())
        sinks.write_snapshot(t, path, v)

    last = M.work(df, lambda t: t.select("task_id", (F.col("task_id") % 5 != 0).alias("ok")), lambda v: sinks.read_snapshot(spark, path, v), write, each, 9, 9)
    got = {r.task_id: (r.status, r.attempts) for r in sinks.read_snapshot(spark, path, last).collect()}
    assert got == {i: ("FAILED", 2) if i % 5 == 0 else ("COMPLETED", 1) for i in range(8)}
    assert not any("Broadcast" in p for p in plans)


def test_pieces_of_a_block_change_no_level(spark):
    draw = random.Random(4)
    rows = [("k", 1_000_000 + draw.randrange(90_000), n, draw.randrange(1, 4)) for n in range(120)]
    df = spark.createDataFrame(rows, "k string, at long, n long, c int")
    levels = lambda **sizes: sorted(map(tuple, S.refilling_bucket(df, "k", "at", "n", "c", 5, 60_000, 50_000, **sizes).collect()))
    whole = levels(piece=1000)
    assert len(whole) == 120 and levels(piece=7) == whole and levels(piece=1) == whole
