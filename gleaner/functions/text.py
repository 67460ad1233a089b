"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_CHARACTERS = 500
INDEXED_CHARACTERS = 100_000
#: Frequent words that tell five languages apart, in the order that settles ties.
MARKERS = {
    "de": "und der die das ist nicht ein eine für mit auch auf",
    "fr": "est les des une pour dans pas avec sur sont cette nous",
    "es": "los las del una por con más como pero para son este",
    "pt": "não uma dos para com mais como mas por são tem isso",
    "it": "che non una per con sono più anche della nel dal gli",
}
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af]"


def _once(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def index_text(text: Column) -> Column:
    """What is indexed of a page: no symbols or format characters, single blanks."""
    out = F.regexp_replace(F.regexp_replace(text, r"[\p{So}\p{Sk}]", " "), r"\p{Cf}", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def query_text(text: Column) -> Column:
    """A query as it is searched for: at most QUERY_CHARACTERS, without symbols and controls."""
    out = F.regexp_replace(F.left(text, F.lit(QUERY_CHARACTERS)), r"[\p{So}\p{Sk}]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\p{C}", ""), r"\s+", " "))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct terms of at least that many characters."""
    return F.array_distinct(F.filter(terms(text), lambda t: F.length(t) >= least))


def bigrams(text: Column) -> Column:
    """Overlapping pairs of CJK characters."""
    letters = F.regexp_extract_all(text, F.lit(CJK), F.lit(0))
    return F.transform(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), lambda c, i: F.concat(c, F.element_at(letters, i + 2)))


def initial_keywords(text: Column, stop_words: list[str], most: int = 8) -> Column:
    """CJK bigrams if the text is CJK, else terms of four characters that aren't stop words."""
    plain = F.filter(keywords(text, 4), lambda t: ~t.isin(stop_words))
    return F.slice(F.when(text.rlike(CJK), F.array_distinct(bigrams(text))).otherwise(plain), 1, most)


def latin_language(text: Column, least_words: int = 10, least_hits: int = 3) -> Column:
    """The language whose marker words occur most, English below the least hits or words."""
    words = F.filter(F.split(F.lower(F.left(text, F.lit(2000))), r"\s+"), lambda w: F.length(w) >= 2)

    def choice(x: Column) -> Column:
        best = F.greatest(*(x[k] for k in MARKERS))
        out = F.when((x["n"] < least_words) | (best < least_hits), "en")
        for k in MARKERS:
            out = out.when(x[k] == best, k)
        return out

    hits = lambda w: F.struct(F.size(w).alias("n"), *(F.size(F.array_intersect(w, F.array(*map(F.lit, m.split())))).alias(k) for k, m in MARKERS.items()))
    return _once(_once(words, hits), choice)


def analyser(text: Column) -> Column:
    """cjk, a Latin language, or standard, by the most frequent script of the first 2000 characters."""
    sample = F.left(text, F.lit(2000))
    count = lambda letters: F.length(sample) - F.length(F.regexp_replace(sample, f"{letters}+", ""))
    counts = F.struct(count(CJK).alias("cjk"), count("\\p{IsLatin}").alias("latin"), count("\\p{L}").alias("letters"))

    def choice(n: Column) -> Column:
        cjk, latin = n["cjk"], n["latin"]
        other = n["letters"] - cjk - latin
        return F.when((cjk > 0) & (cjk >= latin) & (cjk >= other), "cjk").when((latin > 0) & (latin >= other), latin_language(text)).otherwise("standard")

    return _once(counts, choice)


def word_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct words of over two characters that b has too; 1.0 if a has none."""
    of = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 2))
    return F.when(F.size(of(a)) == 0, 1.0).otherwise(F.size(F.array_intersect(of(a), of(b))) / F.size(of(a)))


def content_hash(text: Column) -> Column:
    """Base64 of the SHA-256."""
    return F.base64(F.unhex(F.sha2(text, 256)))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def near_signature(text: Column) -> Column:
    """First 100 characters and the length, of the text with single blanks."""
    s = squeezed(text)
    return F.concat(F.left(s, F.lit(100)), F.lit("|"), F.length(s).cast("string"))


def rough_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def fenced_json(text: Column) -> Column:
    """The contents of the first fenced code block, else the text."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner == "", text).otherwise(inner), r"^\s+|\s+$", "")


def unit_vector(v: Column, of_zero: Column | None = None) -> Column:
    """A vector of length 1; null entries stay and don't count. A zero vector stays, or has ``of_zero`` everywhere."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))
    same = lambda x: x.cast("double") if of_zero is None else F.when(x.isNotNull(), of_zero)
    return F.get(F.transform(F.array(norm), lambda n: F.when(n == 0, F.transform(v, same)).otherwise(F.transform(v, lambda x: x.cast("double") / n))), F.lit(0))


def rounded(x: Column, places: int) -> Column:
    """A double rounded half away from zero; what rounds to zero keeps its sign, as by IEEE 754."""
    return F.get(F.transform(F.array(F.round(x, places)), lambda r: F.when(r == 0, x * 0.0).otherwise(r)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def session_key(kind: Column, number: Column) -> Column:
    """query:, periodic: or batch: and the id."""
    return F.concat(kind, F.lit(":"), number.cast("string"))


def parse_session_key(key: Column) -> tuple[Column, Column]:
    """Kind and id of a key; a key of no known form is a query's."""
    kind = F.regexp_extract(key, "^(query|periodic|batch):", 1)
    return F.when(kind == "", "query").otherwise(kind), F.when(kind == "", key).otherwise(F.regexp_replace(key, "^(query|periodic|batch):", ""))


def error_category(status: Column) -> Column:
    """The category of a failed fetch by HTTP status; null (no answer) is a failed connection."""
    return (
        F.when(status.isNull(), "CONNECTION_FAILED").when(status.isin(401, 403), "ACCESS_RESTRICTED").when(status.isin(404, 410), "NOT_FOUND")
        .when(status == 429, "RATE_LIMITED").when(status >= 500, "WEBSITE_UNAVAILABLE").when(status >= 400, "CONNECTION_FAILED").otherwise("UNKNOWN")
    )


def chunks(text: Column, target: int = 1500, least: int = 500, above: int = 2000) -> Column:
    """Pieces of a text of over ``above`` characters, cut after blank lines, images, tables' ends and
    sentences: a piece is closed at the first such place at which it has ``target`` characters, and the
    last one joins its predecessor when shorter than ``least``. Joined together they are the text."""
    units = F.regexp_extract_all(text, F.lit(r"(?s).*?(?:\n\s*\n|!\[[^\]]*\]\([^)]*\)|\|\s*\n(?!\|)|[.!?]\s+|\z)"), F.lit(0))
    units = F.filter(units, lambda u: u != "")
    nothing = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    joined = F.aggregate(units, nothing, lambda a, u: F.when((F.size(a) > 0) & (F.length(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))) < target), F.array_append(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.concat(F.try_element_at(a, F.lit(-1)), u))).otherwise(F.array_append(a, u)))
    tail = F.when((F.size(joined) > 1) & (F.length(last(joined)) < least), F.array_append(F.slice(joined, 1, F.greatest(F.size(joined) - 2, F.lit(0))), F.concat(F.try_element_at(joined, F.lit(-2)), last(joined)))).otherwise(joined)
    return F.when(F.length(text) <= above, F.array(text)).otherwise(tail)


def checked_query(text: Column, most: int = 1000) -> Column:
    """A struct of the query, line breaks as blanks and trimmed, and error: blank, too long, or null."""
    query = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\n|\r", " "))
    return F.struct(query.alias("query"), F.when(query.rlike(r"^\s*$"), "blank").when(F.length(query) > most, "too long").alias("error"))


def visual_change(before: Column, after: Column, grey_levels: int = 30) -> Column:
    """Whether two pictures (structs of width, height and pixels, an array of grey levels) differ: in size,
    or in a pixel by more than the grey levels."""
    same_size = (before["width"] == after["width"]) & (before["height"] == after["height"])
    differ = F.exists(F.zip_with(before["pixels"], after["pixels"], lambda a, b: F.abs(a - b) > grey_levels), lambda d: d)
    return F.when(same_size, differ).otherwise(True)
