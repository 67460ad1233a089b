"""Queries of scans, filters, joins, aggregations, ranks and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import analytics as A
from gleaner.operators import relational as R
from gleaner.plans.catalog import query
from gleaner.session import millis, table


@query("SC1 P1 P2 P4 P5", """
    SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
    WHERE starts_with(o_orderpriority, '1-') AND o_totalprice >= 100000 AND o_orderstatus IS NOT NULL
      AND (contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg'))""")
def filter_conjuncts(spark, sf):
    t = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return t.filter(R.all_of(R.prefix_filter(F.col("o_orderpriority"), "1-"), F.col("o_totalprice") >= 100000, F.col("o_orderstatus").isNotNull(), None, R.contains_any([F.col("o_orderpriority"), F.col("o_orderstatus")], "URG")))


@query("SC2 SC3 P8", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 77, 1000000)")
def multi_key_lookup(spark, sf):
    return R.by_keys(table(spark, sf, "customer", "c_custkey", "c_name"), "c_custkey", [1, 5, 77, 1000000])


@query("T1 T3", """
    SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'
    ORDER BY value DESC NULLS FIRST, event_id LIMIT 25 OFFSET 50""")
def filter_paginate(spark, sf):
    t = table(spark, sf, "events", "user_id", "event_id", "value", "event_type").filter("event_type = 'purchase'").drop("event_type")
    return R.page(t, R.ordered_by("value", True, "event_id"), 3, 25)


@query("P2 P3 T2", """
    SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND contains(url, 'example')
    ORDER BY url, page_id LIMIT 40 OFFSET 10""")
def prefix_scan(spark, sf):
    t = table(spark, sf, "pages", "page_id", "url").filter(R.prefix_filter(F.col("url"), "https://") & F.contains("url", F.lit("example")))
    return t.orderBy("url", "page_id").offset(10).limit(40)


@query("P6 P7", """
    SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events
    WHERE (epoch_us(ts) // 1000) >= 1704672000000 AND (epoch_us(ts) // 1000) < 1704758400000""")
def time_range(spark, sf):
    t = table(spark, sf, "events", "event_id", "ts").select("event_id", millis(F.col("ts")).alias("ts_ms"))
    return t.filter(A.between_ms(F.col("ts_ms"), 1704672000000, 1704758400000))


@query("P10 P11 SC2", """
    SELECT EXISTS (SELECT 1 FROM pages WHERE starts_with(url, 'https://')) AS has_https,
           EXISTS (SELECT 1 FROM pages WHERE starts_with(url, 'ftp://')) AS has_ftp""")
def existence(spark, sf):
    t = table(spark, sf, "pages", "url")
    some = lambda p: t.filter(F.col("url").startswith(p)).limit(1).agg((F.count("*") > 0).alias("x"))
    return some("https://").withColumnRenamed("x", "has_https").join(some("ftp://").withColumnRenamed("x", "has_ftp"))


@query("J1", """
    SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000""")
def owner_join(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").filter("o_totalprice > 300000")
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").filter("c_mktsegment = 'BUILDING'")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("J2", """
    SELECT o_orderkey, o_orderdate FROM orders o WHERE EXISTS (
        SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_quantity >= 45)""")
def exists_semi(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_quantity").filter("l_returnflag = 'R' and l_quantity >= 45")
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("J7 J8 U4", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def orphans_anti(spark, sf):
    urgent = table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_totalprice").filter("o_orderpriority = '1-URGENT' and o_totalprice > 100000")
    return table(spark, sf, "customer", "c_custkey", "c_name").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("J3", """
    SELECT c_custkey, coalesce(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderpriority IS NOT NULL))), []) AS priorities,
           count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def enrich_children(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    sources = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"), F.count("o_orderkey").alias("n"))
    c = table(spark, sf, "customer", "c_custkey")
    return c.join(sources, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("p", F.array().cast("array<string>")).alias("priorities"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("J4 J5 J17 J13", """
    SELECT o_orderkey, c_name, l_partkey, p_name, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS line
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def detail_join(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    o = o.join(table(spark, sf, "customer", "c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    o = o.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(table(spark, sf, "part", "p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left")
    w = Window.partitionBy("o_orderkey").orderBy(*[F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")])
    return o.select("o_orderkey", "c_name", "l_partkey", "p_name", F.row_number().over(w).alias("line"))


@query("J9", """
    WITH b AS (SELECT l_orderkey, sum(l_quantity) AS area, count(*) AS children FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY ALL),
         a AS (SELECT l_orderkey, sum(l_quantity) AS area, count(*) AS children FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY ALL),
         d AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey,
                      CASE WHEN b.l_orderkey IS NULL THEN 'added' WHEN a.l_orderkey IS NULL THEN 'removed'
                           WHEN abs(a.area - b.area) > 0.2 * b.area THEN 'resized' WHEN a.children <> b.children THEN 'children' END AS change
               FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey)
    SELECT * FROM d WHERE change IS NOT NULL""")
def snapshot_changes(spark, sf):
    t = table(spark, sf, "lineitem", "l_orderkey", "l_quantity", "l_shipdate")
    snap = lambda x: x.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"), F.count("*").alias("children"))
    return R.snapshot_diff(snap(t.filter("l_shipdate < timestamp'1996-01-01'")), snap(t.filter("l_shipdate >= timestamp'1994-01-01'")), "l_orderkey", "area", "children")


@query("J16", """
    WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
         v AS (SELECT user_id, ts AS since, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY value DESC) AS n FROM events WHERE event_type = 'signup') WHERE n = 1)
    SELECT e.event_id, e.user_id, e.ts, v.value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.since""")
def asof_label(spark, sf):
    t = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value")
    left = t.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), "value")
    return R.as_of(left, right, ["user_id"], "ts", "since", "value")


@query("J12 G6 G7", """
    WITH prices(event_type, in_price, out_price) AS (VALUES ('click', 0.1, 0.4), ('view', 0.3, 2.5), ('signup', 1.25, 10.0), ('purchase', 1.5, 9.0), ('error', 0.0, 0.0)),
         u AS (SELECT e.event_type, user_id % 10 AS agent, CAST(floor(value * 100) AS BIGINT) AS tokens, in_price, out_price FROM events e JOIN prices p USING (event_type))
    SELECT event_type AS model, agent, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens,
           round(sum(tokens / 1e6 * in_price + tokens / 1e6 * out_price), 6) AS cost
    FROM u GROUP BY GROUPING SETS ((), (event_type), (agent))""")
def cost_breakdown(spark, sf):
    prices = spark.createDataFrame([("click", 0.1, 0.4), ("view", 0.3, 2.5), ("signup", 1.25, 10.0), ("purchase", 1.5, 9.0), ("error", 0.0, 0.0)], "model_name string, input_per_million double, output_per_million double")
    t = table(spark, sf, "events", "event_type", "user_id", "value")
    tokens = F.floor(F.col("value") * 100).cast("long")
    usage = t.select(F.col("event_type").alias("model_name"), (F.col("user_id") % 10).alias("agent_name"), tokens.alias("prompt_tokens"), tokens.alias("output_tokens"))
    return A.llm_costs(usage, prices).select(F.col("model_name").alias("model"), F.col("agent_name").alias("agent"), "calls", F.col("prompt_tokens").alias("tokens"), F.round("cost", 6).alias("cost"))


@query("G1 G2 G8", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS sessions FROM events WHERE event_type = 'view' GROUP BY ALL""")
def daily_usage(spark, sf):
    t = table(spark, sf, "events", "ts", "event_type").filter("event_type = 'view'")
    return A.by_day(t, F.col("ts"), "sessions")


@query("G9", """
    WITH s AS (SELECT event_id, event_type AS mode, CASE WHEN value < 5 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS duration_ms,
                      CASE user_id % 4 WHEN 0 THEN 'ANSWER_COMPLETE' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'TIMEOUT' END AS finish_reason, user_id % 3 = 0 AS found FROM events)
    SELECT count(*) AS total, round(coalesce(count(*) FILTER (finish_reason = 'ANSWER_COMPLETE') / nullif(count(finish_reason), 0), 0.0), 9) AS success_rate,
           round(count(*) FILTER (found) / count(*), 9) AS found_rate,
           CAST(floor(avg(duration_ms) FILTER (mode = 'view')) AS BIGINT) AS avg_view_ms, CAST(floor(avg(duration_ms) FILTER (mode = 'click')) AS BIGINT) AS avg_click_ms FROM s""")
def session_analytics(spark, sf):
    return A.session_measures(_sessions(spark, sf), ["view", "click"])


def _sessions(spark, sf):
    t = table(spark, sf, "events", "event_id", "event_type", "value", "user_id")
    reason = F.when(F.col("user_id") % 4 == 0, "ANSWER_COMPLETE").when(F.col("user_id") % 4 == 1, "ERROR").when(F.col("user_id") % 4 == 2, "TIMEOUT")
    return t.select("event_id", F.col("event_type").alias("mode"), F.when(F.col("value") < 5, None).otherwise(F.floor(F.col("value") * 10)).cast("long").alias("duration_ms"), reason.alias("finish_reason"), (F.col("user_id") % 3 == 0).alias("answer_found"), (F.col("user_id") % 7).alias("domain"))


@query("G10", """
    WITH s AS (SELECT user_id % 7 AS domain, CASE user_id % 4 WHEN 0 THEN 'ANSWER_COMPLETE' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'TIMEOUT' END AS finish_reason FROM events)
    SELECT domain, count(*) AS sessions, round(coalesce(count(*) FILTER (finish_reason = 'ANSWER_COMPLETE') / nullif(count(finish_reason), 0), 0.0), 9) AS success_rate FROM s GROUP BY domain""")
def domain_stats(spark, sf):
    return A.domain_measures(_sessions(spark, sf))


@query("G11 X17", """
    WITH f AS (SELECT user_id AS session_id, (epoch_us(ts) // 1000) AS ms, event_type FROM events)
    SELECT session_id, count(*) AS n_events, min(ms) AS first_ms, max(ms) AS last_ms, max(ms) - min(ms) AS duration_ms,
           count(*) FILTER (event_type IN ('view', 'error')) AS urls_processed, count(*) FILTER (event_type = 'purchase') AS iterations,
           list_sort(list_distinct(list(event_type))) AS types FROM f GROUP BY session_id""")
def timeline_summary(spark, sf):
    t = table(spark, sf, "events", "user_id", "ts", "event_type").select(F.col("user_id").alias("session_id"), millis(F.col("ts")).alias("ms"), "event_type")
    return A.timeline(t, processed=("view", "error"), iteration="purchase")


@query("G12 P17", """
    SELECT o_orderpriority AS job, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS stage_f, count(*) FILTER (o_orderstatus = 'O') AS stage_o,
           count(*) FILTER (o_orderstatus = 'P') AS stage_p, count(*) FILTER (o_totalprice < 50000) AS failed FROM orders GROUP BY ALL""")
def stage_histogram(spark, sf):
    t = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    t = t.select(F.col("o_orderpriority").alias("job"), F.col("o_orderstatus").alias("stage"), F.when(F.col("o_totalprice") < 50000, "low").alias("error"))
    return A.stage_counts(t, "job", ["F", "O", "P"])


@query("G3", """
    SELECT string_agg(p_brand || ': ' || n, ', ' ORDER BY n DESC, p_brand) AS description FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""")
def graph_schema(spark, sf):
    return A.described_counts(table(spark, sf, "part", "p_brand"), "p_brand")


@query("G4 G5 G24", """
    SELECT event_type AS api_name, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def usage_summary(spark, sf):
    t = table(spark, sf, "events", "event_type", "value").select("event_type", F.bround("value").cast("long").alias("v"))
    out = t.groupingSets([[], ["event_type"]], "event_type").agg(F.sum("v").alias("tokens"), F.count("*").alias("calls"))
    return out.withColumnRenamed("event_type", "api_name")


@query("G13", """
    SELECT user_id, count(*) FILTER (event_type = 'view') AS searches, min_by(event_type, (ts, event_id)) AS first_plan, strftime(max(ts), '%Y-%m-%d') AS last_active FROM events GROUP BY user_id""")
def user_breakdown(spark, sf):
    t = table(spark, sf, "events", "user_id", "event_type", "ts", "event_id")
    return t.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("searches"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_plan"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_active"))


@query("G14 P19 G23", """
    WITH s AS (SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'PAID' ELSE 'FREE' END AS tier, CAST(floor(o_totalprice / 1000) AS BIGINT) AS max_s,
                      CAST(o_orderkey % 50 AS BIGINT) AS used, o_orderdate AS expires FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'),
         p AS (SELECT *, max(tier) OVER (PARTITION BY user_id) AS top FROM s)
    SELECT user_id, top AS tier, CAST(sum(used) AS BIGINT) AS used, CAST(sum(max_s) AS BIGINT) AS available, CAST(sum(greatest(0, max_s - used)) AS BIGINT) AS remaining
    FROM p WHERE tier = top GROUP BY ALL""")
def subscription_usage(spark, sf):
    t = table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey", "o_orderdate")
    s = t.select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("FREE").alias("tier"), F.floor(F.col("o_totalprice") / 1000).alias("max_searches"), F.lit(0).alias("rollover_searches"), (F.col("o_orderkey") % 50).alias("used_searches"), millis(F.col("o_orderdate")).alias("expires_at_ms"))
    return A.subscription_usage(s, now_ms=788918400000)


@query("G15", "SELECT DISTINCT regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS domain FROM pages ORDER BY 1")
def distinct_domains(spark, sf):
    from gleaner.functions.url import host

    return table(spark, sf, "pages", "url").select(host(F.col("url")).alias("domain")).distinct().orderBy("domain")


@query("G16 W2 W3", """
    SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1""")
def latest_per_key(spark, sf):
    t = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus").filter("o_orderstatus = 'F'").drop("o_orderstatus")
    return R.latest_per_key(t, ["o_custkey"], "o_orderdate", "o_orderkey")


@query("G17 G18", """
    SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r,
        sum(n) OVER (PARTITION BY p_brand) AS total FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1 AND n >= 2 AND total >= 3 AND n >= 0.1 * total""")
def dominant_value(spark, sf):
    return A.dominant(table(spark, sf, "part", "p_brand", "p_type"), "p_brand", "p_type", least_rows=3, least_hits=2, least_share=0.1)


@query("G21 G22", """
    SELECT p_brand, list_sort(list(p_size))[count(*) // 2 + 1] AS upper_median, round(1 / (1 + var_pop(p_size) / greatest(1, avg(p_size) * avg(p_size))), 9) AS consistency FROM part GROUP BY p_brand""")
def upper_median(spark, sf):
    return A.size_statistics(table(spark, sf, "part", "p_brand", "p_size"), "p_brand", "p_size")


@query("G25", """
    SELECT coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, '(no direction)') AS direction, count(*) AS n FROM customer GROUP BY ALL""")
def null_label(spark, sf):
    t = table(spark, sf, "customer", "c_mktsegment", "c_acctbal")
    return t.groupBy(F.coalesce(F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment")), F.lit("(no direction)")).alias("direction")).agg(F.count("*").alias("n"))


@query("G27", """
    SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS n FROM customer) WHERE n <= 2""")
def stratified_pick(spark, sf):
    t = table(spark, sf, "customer", "c_nationkey", "c_custkey").withColumn("h", F.md5(F.col("c_custkey").cast("string")))
    return R.first_per_key(t, ["c_nationkey"], [F.col("h"), F.col("c_custkey")], 2).drop("h")


@query("W4", """
    SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'assistant' AND trim(text) <> '') WHERE n <= 10""")
def session_history(spark, sf):
    t = table(spark, sf, "conversations").filter("role = 'assistant' and trim(text) <> ''").select("conv_id", "turn", "text")
    return R.first_per_key(t, ["conv_id"], [F.col("turn"), F.col("text")], 10)


@query("W5", """
    SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 50000""")
def budget_prefix(spark, sf):
    return R.budget_prefix(table(spark, sf, "documents", "source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], "n_chars", 50000)


@query("W7", """
    WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
         s AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM e)
    SELECT user_id, max(streak)::BIGINT AS worst, count(*) FILTER (streak >= 3) AS aborts FROM s GROUP BY user_id""")
def abort_streak(spark, sf):
    t = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type")
    s = R.failure_streaks(t, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")
    return s.groupBy("user_id").agg(F.max("streak").alias("worst"), F.count_if(F.col("streak") >= 3).alias("aborts"))


@query("W8", """
    SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50""")
def ring_buffer(spark, sf):
    t = table(spark, sf, "events", "event_type", "event_id", "ts")
    return R.first_per_key(t, ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).drop("ts")


@query("T6 T9 T10", """
    SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 10 ORDER BY source, doc_id""")
def top_then_reorder(spark, sf):
    t = table(spark, sf, "documents", "source", "doc_id", "n_chars")
    return R.first_per_key(t, ["source"], [F.desc("n_chars"), F.col("doc_id")], 10).orderBy("source", "doc_id")


@query("T7 T8", "SELECT event_id, CASE WHEN value < 10 THEN NULL ELSE value END AS score FROM events ORDER BY coalesce(CASE WHEN value < 10 THEN NULL ELSE value END, 10) DESC, ts, event_id LIMIT 100")
def priority_frontier(spark, sf):
    t = table(spark, sf, "events", "event_id", "value", "ts").withColumn("score", F.when(F.col("value") < 10, None).otherwise(F.col("value")))
    return t.orderBy(F.desc(F.coalesce("score", F.lit(10))), "ts", "event_id").limit(100).select("event_id", "score")


@query("U2 U3", """
    SELECT DISTINCT l_partkey AS k, src FROM (SELECT l_partkey, 'returned' AS src FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 'open' FROM lineitem WHERE l_linestatus = 'O')""")
def union_sources(spark, sf):
    t = table(spark, sf, "lineitem", "l_partkey", "l_returnflag", "l_linestatus")
    one = lambda where, name: t.filter(where).select(F.col("l_partkey").alias("k"), F.lit(name).alias("src"))
    return one("l_returnflag = 'R'", "returned").unionByName(one("l_linestatus = 'O'", "open")).distinct()


@query("G1 flagship aggregate", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    t = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter("l_shipdate <= timestamp'1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )
