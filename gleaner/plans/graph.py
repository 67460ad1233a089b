"""Queries of the graph operators over a graph made of the star schema: region, nation, customer, orders
and parts as vertices r1, n1, c1, o1, p1."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import graph as G
from gleaner.plans.catalog import query
from gleaner.schemas import ENTITY_TYPES
from gleaner.session import millis, table

_EDGES = """
    e AS (SELECT 'r' || n_regionkey AS from_id, 'n' || n_nationkey AS to_id, 'HAS_NATION' AS relation_type FROM nation
          UNION SELECT 'n' || c_nationkey, 'c' || c_custkey, 'HAS_CUSTOMER' FROM customer
          UNION SELECT 'c' || o_custkey, 'o' || o_orderkey, 'PLACED' FROM orders
          UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS' FROM lineitem)"""


def _edges(spark, sf):
    t = lambda name, a, x, b, y, kind: table(spark, sf, name, x, y).select(F.concat(F.lit(a), x).alias("from_id"), F.concat(F.lit(b), y).alias("to_id"), F.lit(kind).alias("relation_type"))
    return (
        t("nation", "r", "n_regionkey", "n", "n_nationkey", "HAS_NATION").unionByName(t("customer", "n", "c_nationkey", "c", "c_custkey", "HAS_CUSTOMER"))
        .unionByName(t("orders", "c", "o_custkey", "o", "o_orderkey", "PLACED")).unionByName(t("lineitem", "o", "l_orderkey", "p", "l_partkey", "CONTAINS"))
    )


def _vertices(spark, sf):
    t = lambda name, a, x: table(spark, sf, name, x).select(F.concat(F.lit(a), x).alias("id"))
    return t("region", "r", "r_regionkey").unionByName(t("nation", "n", "n_nationkey")).unionByName(t("customer", "c", "c_custkey")).unionByName(t("orders", "o", "o_orderkey")).unionByName(t("part", "p", "p_partkey"))


@query("R9", f"""
    WITH {_EDGES}, v AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 'r' || r_regionkey FROM region),
    k AS (SELECT * FROM e WHERE from_id IN (SELECT id FROM v) AND to_id IN (SELECT id FROM v)),
    h1 AS (SELECT 1 AS hop, * FROM k WHERE from_id IN ('n1', 'c7')), f2 AS (SELECT DISTINCT to_id AS id FROM h1 WHERE to_id NOT IN ('n1', 'c7')), h2 AS (SELECT 2 AS hop, * FROM k WHERE from_id IN (SELECT id FROM f2)),
    f3 AS (SELECT DISTINCT to_id AS id FROM h2 WHERE to_id NOT IN (SELECT id FROM f2)), h3 AS (SELECT 3 AS hop, * FROM k WHERE from_id IN (SELECT id FROM f3))
    SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""")
def khop_traverse(spark, sf):
    from gleaner.streaming.rounds import checkpointed

    return G.traverse(_edges(spark, sf), _vertices(spark, sf), spark.createDataFrame([("n1",), ("c7",)], "id string"), 3, checkpoint=checkpointed)


@query("R10 as DataFrame pattern", """
    SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 250000 ORDER BY c_custkey, o_orderkey LIMIT 50""")
def graph_match(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.lit(None).cast("double").alias("price"))
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice").select((F.col("o_orderkey") + 10**12).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("ORDER").alias("type"), F.col("o_totalprice").alias("price"))
    e = table(spark, sf, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") + 10**12).alias("to_id"), F.lit("PLACED").alias("relation_type"))
    m = G.match(c.unionByName(o), e, F.col("type") == "MACHINERY", "PLACED", F.col("price") > 250000, 50)
    return m.select(F.col("a_id").alias("c_custkey"), F.col("a_name").alias("c_name"), (F.col("b_id") - 10**12).alias("o_orderkey"))


@query("G19 M7 J3", """
    WITH m AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 'product' WHEN p_size % 3 = 1 THEN 'FEATURE' ELSE 'gadget' END AS type, p_brand AS fact, 'u' || (p_partkey % 5) AS url, p_partkey AS place FROM part),
         t AS (SELECT *, CASE WHEN upper(type) IN ('PRODUCT', 'FEATURE') THEN upper(type) ELSE 'OTHER' END AS kind FROM m)
    SELECT md5(lower(trim(name)) || chr(1) || kind) AS entity_id, arg_min(name, place) AS name, kind AS type, list_sort(list_distinct(list(fact))) AS facts, list_sort(list_distinct(list(url))) AS source_urls FROM t GROUP BY lower(trim(name)), kind""")
def entity_merge(spark, sf):
    t = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_name")))
    kind = F.when(F.col("p_size") % 3 == 0, "product").when(F.col("p_size") % 3 == 1, "FEATURE").otherwise("gadget")
    m = t.select(name.alias("name"), kind.alias("type"), F.array("p_brand").alias("facts"), F.concat(F.lit("u"), (F.col("p_partkey") % 5).cast("string")).alias("source_url"), F.col("p_partkey").alias("place"))
    return G.merge_entities(m, ENTITY_TYPES)


@query("R8 J2 R12", f"""
    WITH v AS (SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 9) AS distance FROM embeddings),
         s AS (SELECT o_custkey % 500 AS vec_id, o_orderpriority AS fact, (epoch_us(o_orderdate) // 1000) AS at_ms FROM orders)
    SELECT vec_id::VARCHAR AS entity_id, distance, (SELECT list_sort(list_distinct(list(fact))) FROM s WHERE s.vec_id = v.vec_id) AS facts
    FROM v WHERE EXISTS (SELECT 1 FROM s WHERE s.vec_id = v.vec_id AND fact LIKE '1-%' AND at_ms >= 757382400000) ORDER BY distance, vec_id::VARCHAR LIMIT 10""")
def entity_search(spark, sf):
    from gleaner.functions.text import cosine_distance

    vectors = table(spark, sf, "embeddings", "vec_id", "embedding")
    q = vectors.filter("vec_id = 3").first()["embedding"]
    entities = vectors.select(F.col("vec_id").cast("string").alias("entity_id"), "embedding")
    s = table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderdate").select((F.col("o_custkey") % 500).cast("string").alias("entity_id"), F.col("o_orderpriority").alias("source_url"), F.array("o_orderpriority").alias("facts"), millis(F.col("o_orderdate")).alias("extracted_at_ms"))
    wanted = G.with_source(entities, s, "1-", 757382400000)
    best = G.top_entities(wanted, F.round(cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 9), 10)
    return G.enrich(best, s).select("entity_id", "distance", "facts")


@query("J7 M8", "SELECT p_partkey AS entity_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def orphan_entities(spark, sf):
    e = table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("entity_id"))
    return G.orphans(e, table(spark, sf, "lineitem", "l_partkey", "l_quantity").filter("l_quantity >= 49").select(F.col("l_partkey").alias("entity_id")))


@query("J6", """
    SELECT s_name AS from_name, n_name AS to_name, s_suppkey AS from_id, n_nationkey::BIGINT AS to_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey < 12""")
def edge_resolution(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    relations = s.select(F.col("s_name").alias("from_name"), F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("to_name"))
    names = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("entity_id")).unionByName(n.filter("n_nationkey < 12").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("entity_id")))
    return G.resolve_edges(relations, names)


@query("J18 ancestor", """
    WITH p AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages),
         e AS (SELECT site, min(s) AS a, max(s) AS b FROM p GROUP BY site)
    SELECT site, array_to_string(a[1:len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))], '/') AS ancestor FROM e""")
def common_ancestor(spark, sf):
    t = table(spark, sf, "pages", "url").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"), F.regexp_replace("url", "^https?://", "").alias("path"))
    return G.longest_common_path(t, "site", "path")


@query("R10", f"""
    WITH RECURSIVE {_EDGES}, k AS (SELECT * FROM e WHERE NOT (relation_type = 'CONTAINS' AND to_id NOT IN (SELECT 'p' || p_partkey FROM part))),
    w AS (SELECT from_id AS v0, to_id AS pos, 1 AS n, [from_id || to_id || relation_type] AS used FROM k WHERE from_id IN ('r1', 'r2', 'n3')
          UNION ALL SELECT v0, k.to_id, n + 1, list_append(used, k.from_id || k.to_id || k.relation_type) FROM w JOIN k ON k.from_id = w.pos WHERE n < 2 AND NOT list_contains(used, k.from_id || k.to_id || k.relation_type)),
    m AS (SELECT v0, pos AS v1, n FROM w WHERE starts_with(pos, 'c'))
    SELECT v0, v1, p.to_id AS v2, (n + 1)::INT AS edges FROM m JOIN k p ON p.from_id = m.v1 AND p.relation_type = 'PLACED'""")
def graph_patterns(spark, sf):
    """Regions or nations, one or two steps of any kind, customers, and the orders they placed."""
    from gleaner.streaming.rounds import checkpointed

    ends = [F.col("id").isin("r1", "r2", "n3"), F.col("id").startswith("c"), None]
    return G.patterns(_vertices(spark, sf), _edges(spark, sf), ends, [(None, 1, 2), ("PLACED", 1, 1)], checkpointed)


@query("R11 legs", f"""
    WITH {_EDGES} SELECT 'traversal' AS leg, to_id AS id FROM e WHERE from_id = 'n1' UNION ALL SELECT 'pattern', NULL""")
def hybrid_legs(spark, sf):
    """A traversal beside a query that fails: the failing leg is null."""
    from gleaner.streaming.rounds import checkpointed

    edges = _edges(spark, sf).distinct()
    found = G.legs(checkpointed, traversal=lambda: edges.filter("from_id = 'n1'").select(F.col("to_id").alias("id")), pattern=lambda: edges.select(F.raise_error(F.lit("no such query")).cast("string").alias("id")))
    out = None
    for name, leg in found.items():
        one = spark.createDataFrame([(name, None)], "leg string, id string") if leg is None else leg.select(F.lit(name).alias("leg"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("R12", f"""
    WITH s AS (SELECT p_partkey % 50 AS e, 'u' || (p_partkey % 7) AS url, p_brand AS fact FROM part)
    SELECT 'url' AS kind, url AS value, 1::BIGINT AS n FROM (SELECT DISTINCT url FROM s WHERE e < 10) UNION ALL SELECT 'fact', fact, count(*) FROM s WHERE e < 10 GROUP BY fact""")
def retrieval_sources(spark, sf):
    """All source URLs (once each) and all facts (as often as they occur) of some entities."""
    p = table(spark, sf, "part", "p_partkey", "p_brand").select((F.col("p_partkey") % 50).alias("entity_id"), F.concat(F.lit("u"), (F.col("p_partkey") % 7).cast("string")).alias("url"), "p_brand")
    found = p.filter("entity_id < 10").groupBy("entity_id").agg(F.collect_list("p_brand").alias("facts"), F.collect_set("url").alias("source_urls"))
    urls = G.all_source_urls(found).select(F.lit("url").alias("kind"), F.col("url").alias("value"), F.lit(1).cast("long").alias("n"))
    facts = found.select(F.explode("facts").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return urls.unionByName(facts.select(F.lit("fact").alias("kind"), "value", "n"))
