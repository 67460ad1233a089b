"""Queries of merges, queues and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import merge as M
from gleaner.plans.catalog import query
from gleaner.session import millis, table


def _old_and_delta(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 4).alias("version"))
    delta = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), F.when(F.col("o_orderkey") % 5 == 0, 99).otherwise(F.col("o_orderkey") % 4).alias("version"))
    return old, delta


_OLD = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 4 AS version FROM orders WHERE o_orderkey % 3 <> 0)"
_DELTA = "delta AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 99 ELSE o_orderkey % 4 END AS version FROM orders WHERE o_orderkey % 2 = 0)"


@query("M1 M3 SK1", f"""
    WITH {_OLD}, {_DELTA}, j AS (SELECT o.o_orderkey AS ok, d.o_orderkey AS dk, o.o_orderstatus AS os, d.o_orderstatus AS ds, o.o_totalprice AS op, d.o_totalprice AS dp, o.version AS ov, d.version AS dv,
        (d.o_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR o.version = d.version)) AS take FROM old o FULL JOIN delta d ON o.o_orderkey = d.o_orderkey)
    SELECT CASE WHEN take THEN dk ELSE ok END AS o_orderkey, CASE WHEN take THEN ds ELSE os END AS o_orderstatus, CASE WHEN take THEN dp ELSE op END AS o_totalprice, CASE WHEN take THEN coalesce(ov, 0) + 1 ELSE ov END AS version FROM j""")
def merge_upsert(spark, sf):
    return M.upsert(*_old_and_delta(spark, sf), "o_orderkey")[0]


@query("M1 conflicts", f"WITH {_OLD}, {_DELTA} SELECT d.* FROM old o JOIN delta d ON o.o_orderkey = d.o_orderkey WHERE o.version <> d.version")
def merge_conflicts(spark, sf):
    return M.upsert(*_old_and_delta(spark, sf), "o_orderkey")[1]


@query("M2", f"""
    WITH {_OLD}, {_DELTA} SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey, coalesce(d.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
        coalesce(o.o_totalprice, d.o_totalprice) AS o_totalprice, coalesce(o.version, d.version) AS version FROM old o FULL JOIN delta d ON o.o_orderkey = d.o_orderkey""")
def partial_upsert(spark, sf):
    return M.update_columns(*_old_and_delta(spark, sf), "o_orderkey", ["o_orderstatus"])


@query("M4", """
    WITH o AS (SELECT DISTINCT l_orderkey AS url, l_partkey AS hash FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS url, l_partkey + (l_linenumber % 2) AS hash FROM lineitem WHERE l_returnflag = 'R')
    SELECT url, hash, true AS is_active, 9000::BIGINT AS created_at_ms FROM d
    UNION ALL SELECT url, hash, url NOT IN (SELECT url FROM d), 1000 FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.url = o.url AND d.hash = o.hash)""")
def replace_links(spark, sf):
    t = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    old = t.select(F.col("l_orderkey").alias("url"), F.col("l_partkey").alias("hash"), F.lit(True).alias("is_active"), F.lit(1000).cast("long").alias("created_at_ms")).distinct()
    return M.replace_links(old, t.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("url"), (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("hash")), "url", "hash", 9000)


@query("M5", """
    SELECT page_id, url, page_id % 3 = 0 OR url IN (SELECT url FROM pages WHERE contains(url, 'feed')) AS is_used FROM pages""")
def flag_used(spark, sf):
    t = table(spark, sf, "pages", "page_id", "url").withColumn("is_used", F.col("page_id") % 3 == 0)
    return M.flag_in(t, t.filter(F.contains("url", F.lit("feed"))).select("url"), "url", "is_used")


@query("M6", """
    SELECT l_orderkey AS source_url, l_partkey AS fact FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')
    UNION ALL SELECT o_orderkey, -o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def replace_provenance(spark, sf):
    old = table(spark, sf, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("source_url"), F.col("l_partkey").alias("fact"))
    return M.replace_provenance(old, table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_url"), (-F.col("o_custkey")).alias("fact")), "source_url")


@query("M9", """
    SELECT page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE 'old' END AS markdown, CASE WHEN page_id % 2 = 0 THEN NULL ELSE [1.0::FLOAT] END AS embedding, 10::BIGINT AS created_at_ms,
           CASE WHEN page_id % 2 = 0 THEN 77 ELSE 20 END::BIGINT AS updated_at_ms, CASE WHEN page_id % 2 = 0 THEN 4 ELSE 3 END AS version FROM pages""")
def recache_pages(spark, sf):
    p = table(spark, sf, "pages", "page_id")
    old = p.select(F.col("page_id").alias("url"), F.lit("old").alias("markdown"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(10).cast("long").alias("created_at_ms"), F.lit(20).cast("long").alias("updated_at_ms"), F.lit(3).alias("version"))
    return M.recache(old, p.filter("page_id % 2 = 0").select(F.col("page_id").alias("url"), F.lit("new").alias("markdown")), "url", 77)


_TASKS = """t AS (SELECT event_id AS task_id, CASE user_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'COMPLETED' ELSE 'FAILED' END AS status, (event_id % 4)::INT AS attempts, 3 AS max_attempts, (epoch_us(ts) // 1000) AS claimed_at_ms, (epoch_us(ts) // 1000) AS updated_at_ms FROM events)"""


def _tasks(spark, sf):
    t = table(spark, sf, "events", "event_id", "user_id", "ts")
    k = F.col("user_id") % 4
    status = F.when(k == 0, "PENDING").when(k == 1, "IN_PROGRESS").when(k == 2, "COMPLETED").otherwise("FAILED")
    return t.select(F.col("event_id").alias("task_id"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), millis(F.col("ts")).alias("claimed_at_ms"), millis(F.col("ts")).alias("updated_at_ms"))


@query("M12", f"""
    WITH {_TASKS}, c AS (SELECT task_id FROM t WHERE status = 'PENDING' ORDER BY task_id LIMIT 40)
    SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM c) THEN 'IN_PROGRESS' ELSE status END AS status, attempts + CASE WHEN task_id IN (SELECT task_id FROM c) THEN 1 ELSE 0 END AS attempts, max_attempts,
           CASE WHEN task_id IN (SELECT task_id FROM c) THEN 5 ELSE claimed_at_ms END AS claimed_at_ms, updated_at_ms FROM t""")
def queue_claim(spark, sf):
    return M.claim(_tasks(spark, sf), 40, 5)


@query("M13", f"""
    WITH {_TASKS}, r AS (SELECT * REPLACE (CASE WHEN status = 'IN_PROGRESS' AND claimed_at_ms <= 1705276800000 - 86400000 THEN 'PENDING' ELSE status END AS status,
        CASE WHEN status = 'IN_PROGRESS' AND claimed_at_ms <= 1705276800000 - 86400000 THEN NULL ELSE claimed_at_ms END AS claimed_at_ms) FROM t)
    SELECT * REPLACE (CASE WHEN status = 'IN_PROGRESS' AND attempts < max_attempts THEN 'PENDING' WHEN status = 'IN_PROGRESS' THEN 'FAILED' ELSE status END AS status) FROM r""")
def queue_retry(spark, sf):
    t = M.release_stale(_tasks(spark, sf), 1705276800000, 86_400_000)
    return t.withColumn("status", M.retry_or_fail(F.col("status"), F.col("attempts"), F.col("max_attempts"), F.col("status") == "IN_PROGRESS"))


@query("M11 P20", f"WITH {_TASKS} SELECT task_id, status FROM t WHERE NOT (status = 'COMPLETED' AND updated_at_ms < 1705276800000)")
def retention(spark, sf):
    return M.drop_finished(_tasks(spark, sf), 1705276800000).select("task_id", "status")


@query("P18 X16", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN false WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 3 = 0 THEN false ELSE (epoch_us(o_orderdate) // 1000) + (o_orderkey % 3) * 86400000 <= 852076800000 END AS due FROM orders""")
def scheduler_due(spark, sf):
    t = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    last = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(millis(F.col("o_orderdate")))
    return t.select("o_orderkey", M.due(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 3, last, 852076800000).alias("due"))


@query("P9 M10", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def soft_delete(spark, sf):
    t = table(spark, sf, "customer", "c_custkey", "c_acctbal").withColumn("deleted_at_ms", F.when(F.col("c_acctbal") < 0, 5))
    return t.filter("deleted_at_ms is null").select("c_custkey")


@query("T10", """
    WITH s AS (SELECT o_orderkey AS subscription_id, o_custkey AS user_id, (o_orderkey % 9)::INT AS max_searches, 1 AS rollover_searches, (o_orderkey % 11)::INT AS used, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (epoch_us(o_orderdate) // 1000) END AS expires FROM orders),
         h AS (SELECT *, row_number() OVER (PARTITION BY user_id, max_searches + 1 - used > 0 ORDER BY expires NULLS FIRST, subscription_id) = 1 AND max_searches + 1 - used > 0 AS hit FROM s)
    SELECT subscription_id, used + hit::INT AS used_searches FROM h""")
def consume_quota(spark, sf):
    t = table(spark, sf, "orders")
    s = t.select(F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 9).cast("int").alias("max_searches"), F.lit(1).alias("rollover_searches"), (F.col("o_orderkey") % 11).cast("int").alias("used_searches"), F.when(F.col("o_orderstatus") == "P", None).otherwise(millis(F.col("o_orderdate"))).alias("expires_at_ms"))
    return M.consume_quota(s).select("subscription_id", "used_searches")


@query("M14", """
    WITH s AS (SELECT DISTINCT md5(text) AS h, 0 AS x FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, CASE WHEN s.h IS NULL THEN 'add' WHEN 1000 - (ascii(s.h) * 10) < 450 THEN 'skip' ELSE 'replace' END AS action FROM documents LEFT JOIN s ON md5(text) = s.h""")
def ingestion_dedup(spark, sf):
    t = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("h"))
    stored = t.filter("doc_id % 3 = 0").select("h").distinct().withColumn("updated_at_ms", F.ascii("h") * 10)
    return M.ingestion_action(t, stored, "h", 1000, 450).select("doc_id", "action")


@query("T9", """
    WITH s AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'PAID' ELSE 'FREE' END AS tier, o_orderkey % 9 AS most, o_orderkey % 7 AS used FROM orders),
         u AS (SELECT user_id, bool_or(tier = 'PAID') AS paid FROM s GROUP BY user_id),
         r AS (SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN paid THEN -most ELSE 0 END, id) AS n FROM s JOIN u USING (user_id) WHERE most - used > 0 AND (tier = 'PAID') = paid)
    SELECT user_id, id AS subscription_id FROM r WHERE n = 1""")
def current_plan(spark, sf):
    key = F.col("o_orderkey")
    t = table(spark, sf, "orders", "o_orderkey", "o_custkey").select(key.alias("subscription_id"), F.col("o_custkey").alias("user_id"), F.when(key % 3 == 0, "PAID").otherwise("FREE").alias("tier"), (key % 9).alias("max_searches"), F.lit(0).alias("rollover_searches"), (key % 7).alias("used_searches"))
    return M.current_plan(t, "user_id")


@query("X13", """
    SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM orders""")
def queue_worker(spark, sf):
    """All orders as tasks of two kinds; those with a key divisible by five fail and are tried twice."""
    from gleaner import sinks
    from gleaner.streaming import rounds

    key, path = F.col("o_orderkey"), rounds.new_folder(spark, "queue")
    tasks = table(spark, sf, "orders", "o_orderkey").select(key.alias("task_id"), F.when(key % 2 == 0, "EMBEDDING").otherwise("KNOWLEDGE_GRAPH").alias("kind"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(2).alias("max_attempts"), F.lit(0).cast("long").alias("updated_at_ms"))
    last = M.work(tasks, lambda t: t.select("task_id", (F.col("task_id") % 5 != 0).alias("ok")), lambda v: sinks.read_snapshot(spark, path, v), lambda t, v: sinks.write_snapshot(t, path, v), None, 5, 4)
    return sinks.read_snapshot(spark, path, last).select("task_id", "status", "attempts")
