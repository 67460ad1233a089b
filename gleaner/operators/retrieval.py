"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import stems as S
from gleaner.functions import text as X

RRF_K = 60


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, n_terms: the inverted index of the prepared texts (their first 100 000 characters)."""
    words = docs.select(id_col, X.terms(F.left(X.index_text(F.col(text_col)), F.lit(X.INDEXED_CHARACTERS))).alias("words"))
    exploded = words.select(id_col, F.size("words").alias("n_terms"), F.explode("words").alias("term"))
    return exploded.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.max("n_terms").alias("n_terms"))


def keyword_filter(words: Column, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = (), phrases: Sequence[str] = ()) -> Column:
    """Whether an array of terms has all, any and none of some terms, and some phrases of terms."""
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    has = lambda t: F.array_contains(words, t.lower())
    conditions = [has(t) for t in all_of] + [~has(t) for t in none_of] + [F.contains(spaced, F.lit(f" {p.lower()} ")) for p in phrases]
    if any_of:
        conditions.append(reduce(lambda a, b: a | b, [has(t) for t in any_of]))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def keyword_search(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str], limit: int, none_of: Sequence[str] = (), phrases: Sequence[str] = ()) -> DataFrame:
    """id and kw_score (occurrences of the terms) of the texts with all terms, best first, ties by id. Terms
    are found and counted in the prepared texts' first characters, in one pass and without an index
    (gleaner.operators.fulltext has one)."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    if not wanted:
        return docs.select(id_col, F.lit(0).cast("long").alias("kw_score")).limit(0)
    words = X.terms(F.left(X.index_text(F.col(text_col)), F.lit(X.INDEXED_CHARACTERS)))
    rows = docs.filter(F.col(text_col).isNotNull()).select(id_col, text_col, words.alias("words"))
    rows = rows.filter(keyword_filter(F.col("words"), wanted, (), none_of, phrases))
    score = F.size(F.filter("words", lambda w: w.isin(wanted))).cast("long")
    return rows.select(id_col, score.alias("kw_score")).orderBy(F.desc("kw_score"), id_col).limit(limit)


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score of the texts with any of the terms, by BM25 over all docs."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    lengths = docs.select(id_col, X.terms(F.col(text_col)).alias("words")).select(id_col, F.size("words").alias("n"), F.filter("words", lambda w: w.isin(wanted)).alias("hits"))
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean"))
    hits = lengths.select(id_col, "n", F.explode("hits").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.max("n").alias("n"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(totals))  # one row a query term; one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return scored.groupBy(id_col).agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def vector_topk(vectors: DataFrame, id_col: str, vector_col: str, query: Sequence[float], k: int, name: str = "distance") -> DataFrame:
    """The k nearest by cosine distance, exact; null and zero vectors are left out. The query is a literal,
    so one pass over the vectors and a partial top-k in each task do."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = X.cosine_distance(F.col(vector_col), q)
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(id_col, F.round(distance, 9).alias(name))
    return rows.filter(~F.isnan(name) & F.col(name).isNotNull()).orderBy(name, id_col).limit(k)


def recent_topk(chunks: DataFrame, id_col: str, vector_col: str, uploaded_col: str, query: Sequence[float], k: int, now_ms: int, max_age_ms: int | None = None) -> DataFrame:
    """The k nearest of the chunks uploaded (epoch ms) within the age, of all without one."""
    recent = chunks if max_age_ms is None else chunks.filter(F.col(uploaded_col) >= now_ms - max_age_ms)
    return vector_topk(recent, id_col, vector_col, query, k)


def rrf(keyword: DataFrame, semantic: DataFrame, id_col: str, kw_order: Sequence[Column], sem_order: Sequence[Column], limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two short ranked lists: id, rrf, kw_rank, sem_rank; ties go to the better
    keyword rank, then the better semantic one. The ranks' windows run over ``limit`` rows each."""
    a = keyword.select(id_col, F.row_number().over(Window.orderBy(*kw_order)).alias("kw_rank"))
    b = semantic.select(F.col(id_col).alias("__id"), F.row_number().over(Window.orderBy(*sem_order)).alias("sem_rank"))
    both = a.join(b, F.col(id_col) == F.col("__id"), "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.select(F.coalesce(id_col, "__id").alias(id_col), F.round(part("kw_rank") + part("sem_rank"), 12).alias("rrf"), "kw_rank", "sem_rank")
    return scored.orderBy(F.desc("rrf"), F.col("kw_rank").asc_nulls_last(), F.col("sem_rank").asc_nulls_last()).limit(limit)


def hybrid_search(docs: DataFrame, vectors: DataFrame, id_col: str, text_col: str, vector_col: str, terms: Sequence[str], query: Sequence[float], limit: int) -> DataFrame:
    """Keyword and vector legs, each cut to ``limit``, fused; a leg without terms or vector is empty."""
    keyword = keyword_search(docs, id_col, text_col, terms, limit)
    semantic = vector_topk(vectors, id_col, vector_col, query, limit) if query is not None and len(query) else vectors.select(id_col, F.lit(0.0).alias("distance")).limit(0)
    return rrf(keyword, semantic, id_col, [F.desc("kw_score"), F.col(id_col)], [F.col("distance"), F.col(id_col)], limit)


def line_search(pages: DataFrame, id_col: str, text_col: str, terms: Sequence[str], best: int = 5, context: int = 120) -> DataFrame:
    """Lines of each page that have a term (by stem), the best few for each term by number of hits and
    place, with their neighbours as context."""
    lines = pages.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("place", "line")).filter(F.trim("line") != "")
    w = Window.partitionBy(id_col).orderBy("place")
    around = F.left(F.concat_ws(" ", F.lag("line").over(w), F.col("line"), F.lead("line").over(w)), F.lit(context))
    stems = F.transform(X.terms(F.col("line")), stem)
    lines = lines.withColumns({"context": around, "stems": stems})
    asked = F.array(*[F.struct(F.lit(t).alias("keyword"), stem(F.lit(t.lower())).alias("stem")) for t in terms])
    hits = lines.select(id_col, "place", "line", "context", "stems", F.explode(asked).alias("q"))
    hits = hits.select(id_col, "place", "line", "context", F.col("q.keyword").alias("keyword"), F.size(F.filter("stems", lambda s: s == F.col("q.stem"))).alias("hits")).filter("hits > 0")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(id_col, "keyword").orderBy(F.desc("hits"), "place")))
    return ranked.filter(F.col("rank") <= best)


def stem(word: Column) -> Column:
    """A light English stem: plural, -ing, -ed, -ion and a final e go, from words of over four letters."""
    out = F.regexp_replace(word, "(?:ies)$", "y")
    out = F.regexp_replace(out, "(sses)$", "ss")
    out = F.when(out.rlike("[^s]s$"), F.regexp_replace(out, "s$", "")).otherwise(out)
    out = F.regexp_replace(out, "(?:ings?|ed|ions?)$", "")
    out = F.regexp_replace(out, "e$", "")
    return F.when(F.length(word) > 4, out).otherwise(word)


def keyword_pages(pages: DataFrame, id_col: str, text_col: str, keywords: Sequence[str], best: int = 10) -> DataFrame:
    """Pages with the most distinct keywords contained in them (any case), in page order."""
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    score = F.size(F.filter(words, lambda k: F.contains(F.lower(text_col), k))).cast("long")
    top = pages.select(id_col, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col).limit(best)
    return top.orderBy(id_col)


def cache_state(pages: DataFrame, requests: DataFrame, key: str, now_ms: int, ttl_ms: int | None) -> DataFrame:
    """requests with state: Miss, Failure (a status that isn't 2xx, whatever its age), Expired or Hit."""
    joined = requests.join(pages.select(F.col(key).alias("__k"), "http_status", "updated_at_ms"), F.col(key) == F.col("__k"), "left")
    bad = F.col("http_status").isNotNull() & ~F.col("http_status").between(200, 299)
    old = F.lit(False) if ttl_ms is None else now_ms - F.col("updated_at_ms") >= ttl_ms
    return joined.withColumn("state", F.when(F.col("__k").isNull(), "Miss").when(bad, "Failure").when(old, "Expired").otherwise("Hit")).drop("__k", "http_status", "updated_at_ms")


def stemmed_lines(pages: DataFrame, id_col: str, text_col: str, keywords: Sequence[str], best: int = 5, most: int = 120) -> DataFrame:
    """For each page and keyword the best lines: id, keyword, rank, line_no, line, context and score. Ids are unique.

    A page's lines are its own corpus: a keyword's terms, by the analyser of the page's script and language, are
    ranked by BM25 over the lines that have any term, ties by place. The context is the line with its
    neighbours, cut to ``most`` characters. Keywords without terms or hits are absent.

    Each different word of all pages is stemmed once. Those with a stem of a keyword are a few for each keyword,
    whatever the pages, and go to all tasks; lines are then asked for these words as they stand."""
    rows = pages.select(F.col(id_col).alias("id"), X.analyser(F.col(text_col)).alias("analyser"), F.split(F.col(text_col), r"\r\n|\n|\r", -1).alias("lines"))
    asked = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(k).alias("keyword")) for i, k in enumerate(dict.fromkeys(keywords))])
    wanted = pages.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, S.ANALYSERS))).alias("analyser"), asked.alias("asked")).select("analyser", F.explode("asked").alias("q"))
    wanted = wanted.select("analyser", "q.*", F.explode(S.analysed(F.col("q.keyword"), F.col("analyser"))).alias("term")).groupBy("analyser", "number", "keyword", "term").agg(F.count("*").alias("times"))

    lines = rows.select("id", "analyser", F.posexplode("lines").alias("line_no", "line")).select("id", "analyser", "line_no", S.words(F.col("line"), F.col("analyser")).alias("words"))
    vocabulary = lines.select("analyser", F.explode_outer("words").alias("word")).distinct().filter("word is not null")
    vocabulary = vocabulary.withColumn("term", F.explode(F.array(S.stem(F.col("word"), F.col("analyser")))))  # as a column, Spark would work it out for words before they are made distinct too
    known = vocabulary.join(F.broadcast(wanted.select("analyser", "term").distinct()), ["analyser", "term"])
    known = known.groupBy("analyser").agg(F.collect_list("word").alias("known"), F.map_from_entries(F.collect_list(F.struct("word", "term"))).alias("term_of"))

    # of each line its number of terms and the words asked for; then all of a page's lines in one group
    hits = F.transform(F.array_intersect("words", "known"), lambda w: F.struct(F.element_at("term_of", w).alias("term"), F.size(F.filter("words", lambda x: x == w)).alias("n")))
    counted = lines.join(F.broadcast(known), "analyser").select("id", "analyser", "line_no", F.size("words").alias("length"), hits.alias("hits"))
    some = F.col("length") > 0
    totals = [F.count(F.when(some, 1)).alias("n_lines"), F.avg(F.when(some, F.col("length"))).alias("mean")]
    page = counted.groupBy("id", "analyser").agg(*totals, F.collect_list(F.when(F.size("hits") > 0, F.struct("line_no", "length", "hits"))).alias("l"))
    found = page.select("id", "analyser", "n_lines", "mean", F.explode("l").alias("l")).select("id", "analyser", "n_lines", "mean", "l.line_no", "l.length", F.explode("l.hits").alias("h"))
    found = found.groupBy("id", "analyser", "n_lines", "mean", "line_no", "length", F.col("h.term").alias("term")).agg(F.sum("h.n").alias("tf"))
    found = found.withColumn("df", F.count("*").over(Window.partitionBy("id", "analyser", "term")))
    hits = found.join(F.broadcast(wanted), ["analyser", "term"])
    idf = F.log(1 + (F.col("n_lines") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
    scored = hits.groupBy("id", "analyser", "number", "keyword", "line_no").agg(F.round(F.sum(part), 9).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id", "analyser", "number").orderBy(F.desc("score"), "line_no"))).filter(F.col("rank") <= best)

    chosen = ranked.groupBy(F.col("id").alias("__id"), "analyser").agg(F.collect_list(F.struct("keyword", "rank", "line_no", "score")).alias("r")).drop("analyser")
    at = F.col("r.line_no")
    near = F.slice(F.col("lines"), F.greatest(at, F.lit(1)), F.when(at == 0, 2).otherwise(3))
    around = F.array_join(F.transform(near, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), " ")
    out = rows.select("id", "lines").join(chosen, F.col("id").eqNullSafe(F.col("__id"))).select("id", "lines", F.explode("r").alias("r")).select("id", "r.*", F.get("lines", at).alias("line"), around.alias("around"))
    context = F.when(F.length("around") > most, F.concat(F.lit("..."), F.left("around", F.lit(most)), F.lit("..."))).otherwise(F.col("around"))
    return out.select(F.col("id").alias(id_col), "keyword", "rank", "line_no", "line", context.alias("context"), "score")


def page_excerpts(pages: DataFrame, document: str, page: str, text: str, keywords: Sequence[str], context: int = 10, best: int = 10, most: int = 10_000) -> DataFrame:
    """For each document with a hit: preview and pages. A page's score is how many distinct keywords it has (in any
    case); its excerpt, the lines that have one, with ``context`` lines before and after. The best pages, in
    their order, fill the preview up to the first that would pass ``most`` characters."""
    wanted = F.array(*[F.lit(k.lower()) for k in dict.fromkeys(keywords)])
    lines = F.split(F.col(text), r"\r\n|\n|\r", -1)
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.exists(wanted, lambda k: F.contains(F.lower(x), k)), i)), lambda i: i.isNotNull())
    rows = pages.select(document, page, lines.alias("__lines"), hits.alias("__hits"), F.size(F.filter(wanted, lambda k: F.contains(F.lower(text), k))).alias("score")).filter("score > 0")
    # places around hits, by a fold over the hits: each adds what the one before hasn't
    none = F.array().cast("array<int>")
    around = F.aggregate("__hits", none, lambda a, i: F.concat(a, F.when(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) >= i + context, none).otherwise(F.sequence(F.greatest(i - context, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + 1), i + context))))
    excerpt = F.array_join(F.transform(F.filter(around, lambda i: i < F.size("__lines")), lambda i: F.get("__lines", i)), "\n")
    rows = rows.select(document, page, "score", excerpt.alias("excerpt"))
    top = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(document).orderBy(F.desc("score"), page))).filter(F.col("__rank") <= best)
    so_far = F.sum(F.length("excerpt")).over(Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    kept = top.withColumn("__so_far", so_far).withColumn("__in", F.col("__so_far") <= most)
    piece = F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("] ("), F.col("score").cast("string"), F.lit(" keyword matches)\n"), F.col("excerpt"), F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.when(F.col("__in"), F.struct(F.col(page).alias("page"), piece.alias("piece")))))
    return kept.groupBy(document).agg(parts.alias("p")).select(document, F.left(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(most)).alias("preview"), F.transform("p", lambda x: x["page"]).alias("pages"))
