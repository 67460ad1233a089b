"""Queries of pages as trees of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import dom as T
from gleaner.operators import dom as O
from gleaner.plans.catalog import query
from gleaner.session import table

_P = ", ".join(f"'{n}'" for n in sorted(T.END_P))
_VOID = ", ".join(f"'{n}'" for n in sorted(T.VOID))
#: The nodes of pages by a recursion over their tokens, for the tags that these pages have.
_NODES = f"""
    WITH RECURSIVE raw AS (
        SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
        FROM (SELECT page_id, regexp_extract_all(html, '<!--.*?-->|<[!?][^>]*>|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<[^>]*>|[^<]+', 0, 'is') AS ts FROM pages)),
    placed AS (SELECT *, (sum(length(t)) OVER (PARTITION BY page_id ORDER BY i))::INT - length(t)::INT AS pos FROM raw),
    tok AS (
        SELECT page_id, t, pos, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k, lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS name,
               CASE WHEN NOT starts_with(t, '<') THEN 'text' WHEN starts_with(t, '</') THEN 'close' WHEN regexp_matches(t, '^(?i)<(script|style)\\b') THEN 'alone'
                    WHEN lower(regexp_extract(t, '^<([a-zA-Z][^\\s/>]*)', 1)) IN ({_VOID}) THEN 'alone' ELSE 'open' END AS kind
        FROM placed WHERE NOT regexp_matches(t, '^<[!?]')),
    steps AS (
        SELECT page_id, 0::BIGINT AS k, 0 AS made, []::INT[] AS nodes, []::VARCHAR[] AS names, NULL::INT AS node, NULL::INT AS parent, 0 AS depth, NULL::VARCHAR AS name, []::INT[] AS popped, '' AS kind, 0 AS pos, 0 AS length FROM pages
        UNION ALL
        SELECT page_id, k, made + (kind <> 'close')::INT, CASE WHEN kind = 'open' THEN list_append(nodes[:cut], made) ELSE nodes[:cut] END, CASE WHEN kind = 'open' THEN list_append(names[:cut], name) ELSE names[:cut] END,
               CASE WHEN kind <> 'close' THEN made END, CASE WHEN cut = 0 THEN -1 ELSE nodes[cut] END, cut::INT, CASE WHEN kind = 'text' THEN '#text' ELSE name END, nodes[cut + 1:], kind, pos, len
        FROM (SELECT s.page_id, t.k, s.made, s.nodes, s.names, t.name, t.kind, t.pos, length(t.t)::INT AS len,
                     CASE WHEN t.kind = 'close' AND list_contains(s.names, t.name) THEN len(s.names) - list_position(list_reverse(s.names), t.name)
                          WHEN t.kind IN ('open', 'alone') AND t.name IN ({_P}) AND list_contains(s.names, 'p') THEN list_position(s.names, 'p') - 1 ELSE len(s.names) END AS cut
              FROM steps s JOIN tok t ON t.page_id = s.page_id AND t.k = s.k + 1)),
    ends AS (SELECT page_id, popped[1] AS outermost, unnest(popped) AS node, made - (kind <> 'close')::INT - 1 AS last, pos, CASE WHEN kind = 'close' THEN pos + length ELSE pos END AS after FROM steps WHERE len(popped) > 0),
    sizes AS (SELECT page_id, max(made) AS made, any_value(length(html))::INT AS n FROM steps JOIN pages USING (page_id) GROUP BY page_id),
    nodes AS (
        SELECT s.page_id, s.node, s.parent, CASE WHEN s.kind <> 'open' THEN s.node ELSE coalesce(e.last, z.made - 1) END AS last, s.depth, s.name, s.pos AS first,
               CASE WHEN s.kind <> 'open' THEN s.pos + s.length WHEN e.node IS NULL THEN z.n WHEN e.node = e.outermost THEN e.after ELSE e.pos END AS "end", CASE WHEN s.kind IN ('open', 'alone') THEN substr(p.html, s.pos + 1, s.length) END AS tag
        FROM steps s JOIN sizes z USING (page_id) JOIN pages p USING (page_id) LEFT JOIN ends e ON e.page_id = s.page_id AND e.node = s.node WHERE s.node IS NOT NULL),
    placed_nodes AS (SELECT *, CASE WHEN name <> '#text' THEN row_number() OVER (PARTITION BY page_id, parent, name = '#text' ORDER BY node) END AS place FROM nodes)"""


def _nodes(spark, sf):
    return O.nodes(table(spark, sf, "pages", "page_id", "html"), "page_id", "html")


@query("S18 S20 nodes", f'{_NODES} SELECT page_id, node, parent, last, depth, name, first, "end", place::INT AS place FROM placed_nodes')
def page_nodes(spark, sf):
    return _nodes(spark, sf).select(F.col("key").alias("page_id"), "node", "parent", "last", "depth", "name", "first", "end", "place")


@query("S18 selectors", f"""{_NODES},
    n AS (SELECT * FROM placed_nodes WHERE name <> '#text')
    SELECT page_id, 'descendant' AS selector, node FROM n b WHERE name = 'b' AND EXISTS (SELECT 1 FROM n a WHERE a.page_id = b.page_id AND a.name = 'article' AND a.node < b.node AND b.node <= a.last)
    UNION ALL SELECT page_id, 'child', node FROM n b WHERE name = 'p' AND place % 2 = 1 AND EXISTS (SELECT 1 FROM n a WHERE a.page_id = b.page_id AND a.name = 'article' AND a.node = b.parent)
    UNION ALL SELECT page_id, 'next', node FROM n b WHERE name = 'p' AND EXISTS (SELECT 1 FROM n a WHERE a.page_id = b.page_id AND a.parent = b.parent AND a.place = b.place - 1 AND a.name = 'h1')
    UNION ALL SELECT page_id, 'later', node FROM n b WHERE name = 'footer' AND EXISTS (SELECT 1 FROM n a WHERE a.page_id = b.page_id AND a.parent = b.parent AND a.place < b.place AND a.name = 'div' AND regexp_matches(a.tag, 'class="ad"'))
    UNION ALL SELECT page_id, 'attribute', node FROM n b WHERE name = 'a' AND regexp_matches(tag, 'href="/t[^"]*"')
        AND EXISTS (SELECT 1 FROM n a WHERE a.page_id = b.page_id AND a.name = 'li' AND a.node = b.parent AND EXISTS (SELECT 1 FROM n c WHERE c.page_id = a.page_id AND c.name = 'nav' AND c.node < a.node AND a.node <= c.last))""")
def selectors(spark, sf):
    asked = {"descendant": "article b", "child": "article > p:nth-child(odd)", "next": "h1 + p", "later": "div.ad ~ footer", "attribute": "nav li > a[href^='/t']"}
    nodes, out = _nodes(spark, sf), None
    for name, selector in asked.items():
        one = O.select(nodes, selector).select(F.col("key").alias("page_id"), F.lit(name).alias("selector"), "node")
        out = one if out is None else out.unionByName(one)
    return out


@query("S18 S20 replacement", f"""{_NODES},
    hit AS (SELECT page_id, first, "end", CASE WHEN name = 'div' THEN '<span>[ad]</span>' WHEN name = 'b' THEN '<span>bold</span>' ELSE '' END AS text FROM nodes n
            WHERE name = 'nav' OR name = 'div' AND regexp_matches(tag, 'class="ad"')
               OR name = 'b' AND EXISTS (SELECT 1 FROM nodes a WHERE a.page_id = n.page_id AND a.name = 'article' AND a.node < n.node AND n.node <= a.last)),
    o AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit g WHERE g.page_id = h.page_id AND g.first < h.first AND h.first < g."end")),
    c AS (SELECT page_id, first, "end", text, lag("end", 1, 0) OVER (PARTITION BY page_id ORDER BY first) AS pos FROM o),
    j AS (SELECT page_id, string_agg(substr(html, pos + 1, first - pos) || text, '' ORDER BY first) AS head, max("end") AS pos FROM c JOIN pages USING (page_id) GROUP BY page_id)
    SELECT page_id, md5(coalesce(head, '') || substr(html, coalesce(pos, 0) + 1)) AS digest FROM pages LEFT JOIN j USING (page_id)""")
def elements_replaced(spark, sf):
    t = table(spark, sf, "pages", "page_id", "html")
    return O.replace_elements(t, "page_id", "html", {"div.ad": "[ad]", "article b": "bold", "nav": None}).select("page_id", F.md5("html").alias("digest"))


@query("S20 S18", f"""{_NODES},
    a AS (SELECT page_id, min(node) AS lo, max(node) AS hi FROM nodes WHERE name = 'li' GROUP BY page_id),
    f AS (SELECT a.page_id, md5(substr(html, first + 1, "end" - first)) AS first_item FROM a JOIN nodes n ON n.page_id = a.page_id AND n.node = a.lo JOIN pages p ON p.page_id = a.page_id),
    t AS (SELECT a.page_id, trim(regexp_replace(string_agg(replace(replace(replace(replace(substr(html, x.first + 1, x."end" - x.first), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&'), ' ' ORDER BY x.node), '\\s+', ' ', 'g')) AS last_item
          FROM a JOIN nodes n ON n.page_id = a.page_id AND n.node = a.hi JOIN nodes x ON x.page_id = a.page_id AND x.name = '#text' AND x.node BETWEEN n.node AND n.last JOIN pages p ON p.page_id = a.page_id GROUP BY a.page_id)
    SELECT page_id, first_item, coalesce(last_item, '') AS last_item FROM f LEFT JOIN t USING (page_id)""")
def element_texts(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "html")
    found = O.element_texts(_nodes(spark, sf), "li")
    first = F.substr(F.col("html"), F.col("first") + 1, F.col("end") - F.col("first"))
    return found.join(pages, F.col("key") == F.col("page_id")).select("page_id", F.md5(first).alias("first_item"), F.col("text").alias("last_item"))


@query("S16 clean-up to the end")
def pages_cleaned(spark, sf):
    """Every page with a few empty elements put in at its end, by its number."""
    t = table(spark, sf, "pages", "page_id", "html")
    extra = F.array(*[F.lit(x) for x in ("<ul><li> </li><li><ul><li></li></ul></li></ul>", "<blockquote><p> </p>x</blockquote><p id='a'></p>", "<div><span></span><p></p></div><br><br> <br>", "<td></td>&nbsp;<i>&#8203;</i>")])
    return O.cleaned(t.withColumn("html", F.concat("html", F.get(extra, (F.col("page_id") % 4).cast("int")))), "page_id", "html")


@query("S21 whole markdown")
def tree_markdown(spark, sf):
    t = table(spark, sf, "pages", "page_id", "html")
    return O.markdown(_nodes(spark, sf), t, "page_id", "html").withColumnRenamed("key", "page_id")


@query("S23", """
    SELECT n_regionkey AS page_id, 'Region ' || n_regionkey || chr(10) || '| region | name | name |' || chr(10) || '| --- | --- | --- |' || chr(10)
           || string_agg('| ' || r_name || ' | ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'k' || n_nationkey END || ' |', chr(10) ORDER BY n_nationkey) AS markdown
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey""")
def span_tables(spark, sf):
    from gleaner.functions import html as H

    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    cell = F.when(key % 2 == 0, F.concat(F.lit("<td colspan=2>"), "n_name", F.lit("</td>"))).otherwise(F.concat(F.lit("<td>"), "n_name", F.lit("</td><td>k"), key.cast("string"), F.lit("</td>")))
    rows = n.groupBy("n_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cell.alias("cell")))), lambda x: x["cell"]).alias("cells"))
    first = F.concat(F.lit('<td rowspan="'), F.size("cells").cast("string"), F.lit('">'), "r_name", F.lit("</td>"))
    body = F.array_join(F.transform("cells", lambda c, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), c, F.lit("</tr>"))), "")
    html = F.concat(F.lit("<table><caption>Region "), F.col("n_regionkey").cast("string"), F.lit("</caption><thead><tr><th>region</th><th colspan=2>name</th></tr></thead><tbody>"), body, F.lit("</tbody></table>"))
    return rows.select(F.col("n_regionkey").alias("page_id"), H.with_tables_as_markdown(html).alias("markdown"))


_LINES = "l AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL)"


def _orders(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    return table(spark, sf, "orders", "o_custkey", "o_orderkey").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))


@query("S38", f"""
    WITH {_LINES}, c AS (SELECT o_custkey, count(*) AS children, sum(n) AS icons FROM l GROUP BY o_custkey),
         m AS (SELECT o_custkey, n, count(*) AS n_rows, min(o_orderkey) AS first FROM l WHERE n >= 2 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n_rows DESC, first) AS place FROM m)
    SELECT o_custkey AS page_id, 'c' || o_custkey AS id, n_rows::INT AS n_rows, n::INT AS n_columns FROM b JOIN c USING (o_custkey) WHERE place = 1 AND children >= 3 AND icons >= 4 AND n_rows >= 3 AND n_rows >= 0.5 * children""")
def comparison_patterns(spark, sf):
    row = F.concat(F.lit("<div>Order"), F.repeat(F.lit("<svg></svg>"), F.col("n")), F.lit("</div>"))
    pages = _orders(spark, sf).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    pages = pages.select("o_custkey", F.concat(F.lit('<body><section data-ds-local="c'), F.col("o_custkey").cast("string"), F.lit('">'), "rows", F.lit("</section></body>")).alias("html"))
    return O.comparison_tables(O.nodes(pages, "o_custkey", "html")).withColumnRenamed("key", "page_id")


@query("S27", f"""
    WITH {_LINES}, t AS (SELECT *, 'Order ' || o_orderkey AS name FROM l)
    SELECT o_custkey AS page_id, '| Plan | Free | Pro | Team |' || chr(10) || string_agg(CASE WHEN n = 3 THEN name || ': Free: ✅ - Pro: ✅ - Team: ❌' ELSE name || chr(10) || '{{information icon}}' || repeat(chr(10) || '{{tick icon}}', n - 1) || chr(10) || '{{cross icon}}' END, chr(10) ORDER BY o_orderkey) AS markdown
    FROM t GROUP BY o_custkey""".replace("{{", "{").replace("}}", "}"))
def comparison_lines(spark, sf):
    row = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("\n{information icon}"), F.repeat(F.lit("\n{tick icon}"), F.col("n") - 1), F.lit("\n{cross icon}"))
    pages = _orders(spark, sf).groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    return O.linearised(pages.select("page_id", F.concat(F.lit("| Plan | Free | Pro | Team |\n"), "rows").alias("markdown")), "page_id", "markdown")
