"""Queries of the URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import url as U
from gleaner.operators import relational as R
from gleaner.plans.catalog import query
from gleaner.session import table

_DROPPED = ", ".join(f"'{p}'" for p in U.DROPPED_PARAMETERS)
#: The pages' URLs have neither escapes nor ports nor dots to resolve, which the unit tests cover.
_NORMAL = f"""
    p AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
                 list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS segments,
                 list_transform(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: [string_split(x, '=')[1], coalesce(string_split(x, '=')[2], '')]) AS params FROM pages),
    q AS (SELECT *, list_sort(list_filter(params, lambda x: lower(x[1]) NOT IN ({_DROPPED}))) AS kept FROM p),
    n AS (SELECT page_id, url, scheme, host, segments, CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: CASE WHEN x[2] = '' THEN x[1] ELSE x[1] || '=' || x[2] END), '&') ELSE '' END AS query FROM q)"""
_LOCALE = "CASE WHEN len(segments) > 1 AND regexp_matches(lower(segments[1]), '^[a-z]{2}([-_][a-z]{2,3})?$') THEN segments[2:] ELSE segments END"


@query("S1 S2 S3 S4", f"WITH {_NORMAL} SELECT page_id, scheme || '://' || host || '/' || array_to_string(segments, '/') || query AS normal FROM n")
def url_normalize(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").select("page_id", U.normalize_url(F.col("url")).alias("normal"))


@query("S5 S6 D1 G16", f"""
    WITH {_NORMAL},
    k AS (SELECT page_id, scheme || '://' || regexp_replace(host, '^www[.](.*[.].*)$', '\\1') || '/' || array_to_string({_LOCALE}, '/') || query AS dedup_key FROM n)
    SELECT dedup_key, min(page_id) AS page_id, count(*) AS claims FROM k GROUP BY dedup_key""")
def url_dedup_key(spark, sf):
    keyed = table(spark, sf, "pages", "page_id", "url").select("page_id", U.dedup_key(F.col("url")).alias("dedup_key"))
    return keyed.groupBy("dedup_key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("claims"))


@query("S8 S9 P16", """
    SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''))::INT AS depth,
           regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base FROM pages""")
def url_host(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages", "page_id", "url").select("page_id", U.host(u).alias("host"), U.path_depth(u).alias("depth"), U.base_domain(u).alias("base"))


@query("P12 P13 P14", """
    WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') AS q FROM pages)
    SELECT page_id, contains(lower(path), '/en/') OR NOT regexp_matches(path, '(?i)/[a-z]{2}(-[a-z]{2,3})?/') AS by_path,
           len(list_filter(q, lambda x: starts_with(lower(x), 'utm_source='))) = 0 OR list_contains(list_transform(q, lambda x: lower(x)), 'utm_source=feed') AS by_query FROM p""")
def lang_filter(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages", "page_id", "url").select("page_id", U.matches_path_language(u, "/en/").alias("by_path"), U.matches_query_language(u, "utm_source", "feed").alias("by_query"))


@query("P15 J15", """
    WITH r(rule_id, pattern, proxy) AS (VALUES (1, '*.example.net', 'a'), (2, 'example.com', 'b'), (3, '*.com', 'c')),
         p AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS host FROM pages),
         m AS (SELECT page_id, proxy, row_number() OVER (PARTITION BY page_id ORDER BY starts_with(pattern, '*.') , rule_id) AS n FROM p JOIN r
               ON CASE WHEN starts_with(pattern, '*.') THEN host = substr(pattern, 3) OR ends_with(host, '.' || substr(pattern, 3)) ELSE host = pattern END)
    SELECT p.page_id, coalesce(m.proxy, 'default') AS proxy FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1""")
def host_rules(spark, sf):
    rules = spark.createDataFrame([(1, "*.example.net", "a"), (2, "example.com", "b"), (3, "*.com", "c")], "rule_id int, pattern string, proxy string")
    pages = table(spark, sf, "pages", "page_id", "url").select("page_id", U.host(F.col("url")).alias("host"))
    # each host looks up the patterns that match it, so however many rules there are, it is an equal join
    matched = pages.withColumn("pattern", F.explode_outer(U.patterns_of_host(F.col("host")))).join(rules, "pattern", "left").filter("proxy is not null")
    best = matched.groupBy("page_id").agg(F.min_by("proxy", F.struct(F.col("pattern").startswith("*."), "rule_id")).alias("proxy"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.coalesce("proxy", F.lit("default")).alias("proxy"))


@query("S10 S34", """
    SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, 'https?://[^\\s<>"{}|\\\\^`\\[\\]]+'), lambda x: regexp_replace(x, '[.,)\\];:''"]+$', ''))) AS found,
           trim(regexp_replace(regexp_replace(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]*)/*$', 1), '[.][A-Za-z0-9]+$', ''), '[-_]+', ' ', 'g')) AS title FROM pages""")
def urls_in_text(spark, sf):
    t = table(spark, sf, "pages", "page_id", "url", "html")
    return t.select("page_id", U.urls_in_text(F.col("html")).alias("found"), U.title_from_url(F.col("url")).alias("title"))


@query("R T3 duration or domain order", """
    SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain FROM pages ORDER BY domain ASC NULLS LAST, page_id LIMIT 30""")
def order_by_domain(spark, sf):
    t = table(spark, sf, "pages", "page_id", "url").select("page_id", U.host(F.col("url")).alias("domain"))
    return R.page(t, R.ordered_by("domain", False, "page_id"), 1, 30)


@query("S7", r"""
    WITH u AS (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN url || '/ü %41 100%/x|y?q=a b&r=ß#f g' WHEN 1 THEN ' ' || url || '/über ' ELSE 'no scheme ' || page_id END) AS u FROM pages),
         p AS (SELECT page_id, u, regexp_extract(u, '^[^:/?#]+://[^/?#]*') AS head FROM u), r AS (SELECT *, substr(u, length(head) + 1) AS rest FROM p)
    SELECT page_id, CASE WHEN head = '' THEN replace(u, ' ', '%20') WHEN regexp_full_match(rest, '(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9\-._~!$''()*+,;:@/?&=#]|[^\x00-\x7F\p{Z}\p{Cc}])*') THEN u
           ELSE head || array_to_string(list_transform(regexp_extract_all(rest, '(?s)%[0-9A-Fa-f]{2}|.'), lambda c: CASE WHEN regexp_full_match(c, '%..|[A-Za-z0-9\-._~!$''()*+,;:@/?&=#]') THEN c ELSE url_encode(c) END), '') END AS uri FROM r""")
def lenient_uri(spark, sf):
    u, n = F.col("url"), F.col("page_id") % 3
    odd = F.when(n == 0, F.concat(u, F.lit("/ü %41 100%/x|y?q=a b&r=ß#f g"))).when(n == 1, F.concat(F.lit(" "), u, F.lit("/über "))).otherwise(F.concat(F.lit("no scheme "), F.col("page_id").cast("string")))
    return table(spark, sf, "pages", "page_id", "url").select("page_id", U.lenient_uri(odd).alias("uri"))


@query("P14", """
    WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN ' /en-us/ ' WHEN 1 THEN '?lang=' || page_id WHEN 2 THEN '/en' WHEN 3 THEN '?lang= ' WHEN 4 THEN '' ELSE url END AS pattern FROM pages)
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'path' WHEN 1 THEN 'query' END AS kind, CASE WHEN page_id % 6 = 1 THEN 'lang' END AS name, CASE WHEN page_id % 6 = 1 THEN substr(pattern, 7) END AS value,
           CASE page_id % 6 WHEN 2 THEN 'a path pattern ends with /' WHEN 3 THEN 'a query pattern has a value' WHEN 5 THEN 'a pattern starts with / or ?' END AS error FROM p""")
def pattern_check(spark, sf):
    n = F.col("page_id") % 6
    pattern = F.when(n == 0, " /en-us/ ").when(n == 1, F.concat(F.lit("?lang="), F.col("page_id").cast("string"))).when(n == 2, "/en").when(n == 3, "?lang= ").when(n == 4, "").otherwise(F.col("url"))
    return table(spark, sf, "pages", "page_id", "url").select("page_id", U.language_pattern(pattern).alias("p")).select("page_id", "p.*")
