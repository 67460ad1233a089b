"""Queries of content extraction, text functions and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as X
from gleaner.functions import url as U
from gleaner.operators import dedup as D
from gleaner.plans.catalog import query
from gleaner.session import table
from gleaner.sources import sitemap

_SKIP = ("script", "style", "noscript", "template", "svg", "head", "iframe", "object", "embed", "canvas", "meta")


def _sql_without(column: str, names=_SKIP) -> str:
    out = f"regexp_replace({column}, '<!--.*?-->', '', 'gs')"
    for n in names:
        out = f"regexp_replace({out}, '<{n}\\b[^>]*>.*?</{n}\\s*>', '', 'gis')"
    return out


def _sql_unescape(x: str) -> str:
    for a, b in H.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _sql_markdown(x: str) -> str:
    x = _sql_without(x)
    for level in range(1, 7):
        x = f"regexp_replace({x}, '<h{level}\\b[^>]*>(.*?)</h{level}\\s*>', chr(10) || chr(10) || '{'#' * level} \\1' || chr(10) || chr(10), 'gis')"
    x = f"regexp_replace({x}, '<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', '[\\2](\\1)', 'gis')"
    x = f"regexp_replace({x}, '<(?:b|strong)\\b[^>]*>(.*?)</(?:b|strong)>', '**\\1**', 'gis')"
    x = f"regexp_replace(regexp_replace({x}, '<li\\b[^>]*>', chr(10) || '* ', 'gis'), '<br\\s*/?>', chr(10), 'gis')"
    x = f"regexp_replace({x}, '</?(?:p|div|article|section|ul|ol|table|tr|nav|header|footer)\\b[^>]*>', chr(10) || chr(10), 'gis')"
    return _sql_unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


@query("S15", f"""
    SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_sql_without('html')}, '<[^>]*>'), lambda t: trim(regexp_replace({_sql_unescape('t')}, '\\s+', ' ', 'g'))), lambda t: t <> ''), chr(10)) AS text FROM pages""")
def html_text(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", H.visible_text(F.col("html")).alias("text"))


@query("S11", """
    WITH h AS (SELECT page_id, url, unnest(list_filter(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1, 'is'), lambda x: trim(x) <> '')) AS href FROM pages),
         a AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
                   WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN starts_with(href, '#') OR regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
                   ELSE rtrim(regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1), '/') || '/' || href END AS link FROM h)
    SELECT page_id, link, count(*) AS n FROM a WHERE lower(regexp_extract(link, '^(https?://[^/?#]+)', 1)) = lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) GROUP BY ALL""")
def html_links(spark, sf):
    t = table(spark, sf, "pages", "page_id", "url", "html").select("page_id", "url", F.explode(H.hrefs(F.col("html"))).alias("href"))
    t = t.select("page_id", "url", H.absolute(F.col("href"), F.col("url")).alias("link")).filter(U.base_domain(F.col("link")) == U.base_domain(F.col("url")))
    return t.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("S26 title", "SELECT page_id, 'URL: ' || url || chr(10) || 'Title: ' || trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS header FROM pages")
def page_header(spark, sf):
    t = table(spark, sf, "pages", "page_id", "url", "html")
    return t.select("page_id", F.concat(F.lit("URL: "), F.col("url"), F.lit("\nTitle: "), H.title(F.col("html"))).alias("header"))


@query("S22 S23", """
    SELECT r_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def table_md(spark, sf):
    rows = table(spark, sf, "nation").withColumn("row", F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("</td>\n<td> "), F.col("n_nationkey").cast("string"), F.lit(" </td></tr>")))
    html = rows.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda r: r["row"]), "").alias("body"))
    whole = F.concat(F.lit("<table class='x'><thead><tr><th>name</th><th>key</th></tr></thead><tbody>"), F.col("body"), F.lit("</tbody></table>"))
    return html.select("r_regionkey", H.table_markdown(whole).alias("markdown"))


@query("S24", """
    SELECT r_regionkey, '* ' || r_name || chr(10) || string_agg('  ' || n || '. ' || n_name, chr(10) ORDER BY n) AS markdown
    FROM region JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def list_md(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("<li>"), x["n_name"], F.lit("</li>"))), "").alias("items"))
    r = table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select("r_regionkey", H.list_markdown(F.concat(F.lit("<ul><li>"), F.col("r_name"), F.lit("<ol>"), F.col("items"), F.lit("</ol></li></ul>"))).alias("markdown"))


@query("S14 S16 S21 by patterns")
def html_markdown(spark, sf):
    t = table(spark, sf, "pages", "page_id", "html")
    return t.select("page_id", H.to_markdown(F.col("html")).alias("markdown"), H.link_html(F.col("html")).alias("link_html"))


@query("S25 P chunks", """
    SELECT doc_id, sum(length(text)) AS n_chars, count(*) AS docs FROM documents GROUP BY doc_id""")
def chunk_lengths(spark, sf):
    t = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.explode(X.chunks(F.col("text"))).alias("chunk"))
    return t.groupBy("doc_id").agg(F.sum(F.length("chunk")).alias("n_chars")).withColumn("docs", F.lit(1).cast("long"))


@query("S25 chunk sizes")
def text_chunks(spark, sf):
    t = table(spark, sf, "documents", "doc_id", "text")
    return t.select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("place", "chunk")).select("doc_id", "place", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("D4 S33 M14 S41", """
    SELECT min(doc_id) AS doc_id, count(*) AS copies, base64(unhex(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) AS content_hash FROM documents GROUP BY content_hash""")
def content_hash_dedup(spark, sf):
    t = table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.content_hash(X.squeezed(F.col("text"))).alias("content_hash"))
    return t.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("D5", """
    SELECT min(doc_id) AS doc_id, md5(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 100) || '|' || length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS signature FROM documents GROUP BY signature""")
def near_dup_signature(spark, sf):
    t = table(spark, sf, "documents", "doc_id", "text")
    return D.near_signature(t, "text", "doc_id").select("doc_id", F.md5(X.near_signature(F.col("text"))).alias("signature"))


@query("D6 J11 S28")
def containment_dedup(spark, sf):
    t = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return D.containment(t, "conv_id", ["turn", "role", "text"], "text").select("conv_id", "turn", "role")


@query("S28 U5", """
    WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 2)) AS a FROM benchmark)
    SELECT x.item_id AS a, y.item_id AS b, round(CASE WHEN len(x.a) = 0 THEN 1.0 ELSE len(list_intersect(x.a, y.a))::DOUBLE / len(x.a) END, 9) AS overlap FROM w x JOIN w y ON y.item_id = x.item_id + 1""")
def word_overlap(spark, sf):
    t = table(spark, sf, "benchmark")
    u = t.select((F.col("item_id") - 1).alias("k"), F.col("item_id").alias("b"), F.col("text").alias("other"))
    return t.join(u, F.col("item_id") == F.col("k")).select(F.col("item_id").alias("a"), "b", F.round(X.word_overlap(F.col("text"), F.col("other")), 9).alias("overlap"))


@query("S29 S30", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.missing') AS BIGINT) AS missing FROM events""")
def metadata_access(spark, sf):
    v = F.parse_json(X.fenced_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))))
    return table(spark, sf, "events", "event_id", "props").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "bigint").alias("missing"))


@query("S31", """
    SELECT event_id, CASE WHEN s IS NULL THEN 'CONNECTION_FAILED' WHEN s IN (401, 403) THEN 'ACCESS_RESTRICTED' WHEN s IN (404, 410) THEN 'NOT_FOUND' WHEN s = 429 THEN 'RATE_LIMITED'
           WHEN s >= 500 THEN 'WEBSITE_UNAVAILABLE' WHEN s >= 400 THEN 'CONNECTION_FAILED' ELSE 'UNKNOWN' END AS category
    FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 395 + event_id % 120 END AS s FROM events)""")
def error_categories(spark, sf):
    status = F.when(F.col("event_id") % 17 == 0, None).otherwise(395 + F.col("event_id") % 120)
    return table(spark, sf, "events", "event_id").select("event_id", X.error_category(status).alias("category"))


@query("S17", """
    WITH k AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'query:' WHEN 1 THEN 'periodic:' WHEN 2 THEN 'batch:' ELSE 'odd-' END || user_id AS key FROM events)
    SELECT event_id, CASE WHEN regexp_matches(key, '^(query|periodic|batch):') THEN string_split(key, ':')[1] ELSE 'query' END AS kind, regexp_replace(key, '^(query|periodic|batch):', '') AS id FROM k""")
def session_keys(spark, sf):
    n = F.col("event_id") % 4
    key = F.concat(F.when(n == 0, "query:").when(n == 1, "periodic:").when(n == 2, "batch:").otherwise("odd-"), F.col("user_id").cast("string"))
    kind, number = X.parse_session_key(key)
    return table(spark, sf, "events", "event_id", "user_id").select("event_id", kind.alias("kind"), number.alias("id"))


@query("SC4", """
    SELECT n_regionkey AS sitemap, list_sort(list_distinct(list('https://example.com/' || lower(n_name)))) AS links FROM nation GROUP BY ALL""")
def sitemap_links(spark, sf):
    n = table(spark, sf, "nation")
    loc = F.concat(F.lit("<url><loc> https://example.com/"), F.lower("n_name"), F.lit(" </loc></url>"))
    xml = n.groupBy(F.col("n_regionkey").alias("sitemap")).agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml"))
    return xml.select("sitemap", F.array_sort(sitemap.links(F.col("xml"))).alias("links"))


@query("SC9", """
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'TOO_LARGE' WHEN page_id % 3 = 0 THEN 'HTML' WHEN page_id % 3 = 1 THEN 'FILE' ELSE 'UNSUPPORTED' END AS route FROM pages""")
def content_routing(spark, sf):
    from gleaner.sources.routing import route

    mime = F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, "application/PDF").otherwise("video/mp4")
    return table(spark, sf, "pages", "page_id").select("page_id", route(mime, F.when(F.col("page_id") % 5 == 0, 1 << 30).otherwise(1000)).alias("route"))


@query("SC9 types", """
    SELECT page_id, ['FILE', 'FILE', 'UNSUPPORTED', 'FILE', 'UNSUPPORTED', 'FILE', 'UNSUPPORTED', 'HTML', 'UNSUPPORTED'][page_id % 9 + 1] AS route FROM pages""")
def content_types(spark, sf):
    from gleaner.sources.routing import route

    types = ("text/css", "application/ZIP; x=y", "application/rtf", "text/x-anything", "video/mp4", " application/x-sh ", "application/vnd.ms-powerpoint", "TEXT/HTML;charset=utf-8", "textual/plain")
    mime = F.get(F.array(*map(F.lit, types)), (F.col("page_id") % 9).cast("int"))
    return table(spark, sf, "pages", "page_id").select("page_id", route(mime, F.lit(1000)).alias("route"))


@query("SC11 X19 X20", """
    WITH d AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)
    SELECT source, (r // 10)::INT AS batch, count(*) AS requests, CAST(sum(n) AS BIGINT) AS chars, CASE WHEN sum(n) < 20000 THEN 'inline' ELSE 'file' END AS route FROM d GROUP BY ALL""")
def request_batches(spark, sf):
    from gleaner.sinks import request_batches as batches

    return batches(table(spark, sf, "documents", "source", "doc_id", "text"), "source", "doc_id", "text", size=10, inline_below=20000)


@query("SK4 G26 M14", """
    WITH k AS (SELECT p_name || ' ' || p_brand AS key, p_size FROM part)
    SELECT DISTINCT key FROM k WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.p_size < 10 AND c.key = k.key)""")
def cache_misses(spark, sf):
    t = table(spark, sf, "part", "p_name", "p_brand", "p_size").select(F.concat_ws(" ", "p_name", "p_brand").alias("key"), "p_size")
    return D.cache_misses(t.select("key"), t.filter("p_size < 10").select("key"), "key")


@query("S21 by patterns", f"""
    WITH a AS (SELECT page_id, {_sql_markdown('html')} AS m FROM pages)
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS markdown FROM a""")
def page_markdown(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", H.to_markdown(F.col("html")).alias("markdown"))


@query("S18 S20 by patterns", """
    SELECT page_id, md5(regexp_replace(regexp_replace(html, '<div\\b[^>]*?\\bclass="(?:[^"]*\\s)?ad(?:\\s[^"]*)?"[^>]*>.*?</div\\s*>', '<span>[ad]</span>', 'gis'), '<nav\\b[^>]*>.*?</nav\\s*>', '', 'gis')) AS replaced,
           nullif(regexp_extract(html, '<li\\b[^>]*>.*?</li\\s*>', 0, 'is'), '') AS first_item,
           trim(regexp_replace(""" + _sql_unescape("regexp_replace(list_last(regexp_extract_all(html, '<li\\b[^>]*>.*?</li\\s*>', 0, 'is')), '<[^>]*>', ' ', 'g')") + """, '\\s+', ' ', 'g')) AS last_item FROM pages""")
def element_selection(spark, sf):
    html = F.col("html")
    t = table(spark, sf, "pages", "page_id", "html")
    return t.select("page_id", F.md5(H.replace_elements(html, {"div.ad": "[ad]", "nav": None})).alias("replaced"), H.element_html(html, "li").alias("first_item"), H.element_text(html, "li").alias("last_item"))


@query("S19", """
    SELECT page_id, md5(html) AS whole, len(regexp_extract_all(html, '<li\\b[^>]*>.*?</li\\s*>', 0, 'is')) AS elements, list_last(regexp_extract_all(html, '<li\\b[^>]*>.*?</li\\s*>', 0, 'is')) AS last,
           length(html) - list_sum(list_transform(regexp_extract_all(html, '<li\\b[^>]*>.*?</li\\s*>', 0, 'is'), lambda x, i: length(x) - 23 - length((i - 1)::VARCHAR)))::BIGINT AS n_chars FROM pages""")
def placeholders(spark, sf):
    t = table(spark, sf, "pages", "page_id", "html").select("page_id", H.with_placeholders(F.col("html"), "li", "MEDIA").alias("p"))
    last = F.try_element_at(F.map_values("p.elements"), F.lit(-1))
    return t.select("page_id", F.md5(H.restored(F.col("p.html"), F.col("p.elements"))).alias("whole"), F.size("p.elements").cast("long").alias("elements"), last.alias("last"), F.length("p.html").cast("long").alias("n_chars"))


@query("S12", f"""
    WITH a AS (SELECT page_id, unnest(regexp_extract_all({_sql_without('html')}, '<a\\s[^>]*>.*?</a\\s*>', 0, 'is')) AS a, generate_subscripts(regexp_extract_all({_sql_without('html')}, '<a\\s[^>]*>.*?</a\\s*>', 0, 'is'), 1) AS n FROM pages),
         d AS (SELECT page_id, n, regexp_replace(trim({_sql_unescape("regexp_extract(a, '^[^>]*?\\shref=\"([^\"]*)\"', 1, 'is')")}), '#.*$', '') AS path, trim(regexp_replace({_sql_unescape("regexp_replace(a, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM a)
    SELECT page_id, path, arg_min(coalesce(nullif(left(text, 80), ''), '[no text]'), n) AS text FROM d WHERE starts_with(path, '/') AND NOT starts_with(path, '//') GROUP BY ALL""")
def link_descriptors(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", F.explode(H.link_descriptors(F.col("html"))).alias("d")).select("page_id", "d.*")


@query("S13", """
    WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1, 'is')) AS url FROM pages)
    SELECT page_id, url, greatest(1, least(10, length(url) - 5))::INT AS score FROM h WHERE trim(url) <> '' AND length(url) % 2 = 0""")
def ranked_links(spark, sf):
    known = table(spark, sf, "pages", "page_id", "html").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("url"))
    odd = F.length("url") % 2 == 1  # a ranking that makes up every link of odd length, and scores beyond 1..10
    ranking = known.withColumn("place", F.length("url")).select("page_id", F.when(odd, F.concat(F.lit("/made-up"), "url")).otherwise(F.col("url")).alias("url"), "place", (F.length("url") - 5).alias("score"))
    return D.known_links(ranking, known, ["page_id", "url"], "place", "score").select("page_id", "url", "score")


@query("S32", """
    WITH q AS (SELECT doc_id, trim(regexp_replace(text, '\\r\\n|\\n|\\r', ' ', 'g')) AS q FROM documents)
    SELECT doc_id, md5(q) AS query, CASE WHEN regexp_matches(q, '^\\s*$') THEN 'blank' WHEN length(q) > 1000 THEN 'too long' END AS error FROM q""")
def query_check(spark, sf):
    t = table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.checked_query(F.col("text")).alias("q"))
    return t.select("doc_id", F.md5("q.query").alias("query"), "q.error")


@query("D3", "SELECT DISTINCT text AS query FROM conversations WHERE role = 'user'")
def query_dedup(spark, sf):
    return table(spark, sf, "conversations", "role", "text").filter("role = 'user'").select(F.col("text").alias("query")).distinct()


@query("SC10", """
    SELECT d.doc_id, sha256(d.text) AS hash FROM documents d WHERE sha256(d.text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def files_by_hash(spark, sf):
    stored = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("hash"))
    asked = stored.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("hash")
    return stored.join(asked, "hash", "left_semi").select("doc_id", "hash")


@query("S40", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 128 + 128)::INT) AS p FROM embeddings),
         n AS (SELECT vec_id - 1 AS vec_id, p AS q FROM e)
    SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN true ELSE len(list_filter(list_zip(p, q), lambda z: abs(z[1] - z[2]) > 30)) > 0 END AS changed FROM e JOIN n USING (vec_id)""")
def visual_change(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 128 + 128).cast("int")).alias("pixels"))
    shape = lambda w: F.struct(w.alias("width"), F.lit(8).alias("height"), F.col("pixels"))
    before = e.select("vec_id", shape(F.when(F.col("vec_id") % 5 == 0, 9).otherwise(8)).alias("before"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), shape(F.lit(8)).alias("after"))
    return before.join(after, "vec_id").select("vec_id", X.visual_change(F.col("before"), F.col("after")).alias("changed"))
