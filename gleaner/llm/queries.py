"""One query for each training-data operator, and DuckDB SQL where it can express the operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import documents


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's vocabulary file; GLEANER_TOKENIZERS names another folder."""
    folder = os.environ.get("GLEANER_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.packing import best_fit_pack

    return best_fit_pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle_words=3, percent=85)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gleaner.llm.secrets import scan

    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    digest = F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", digest)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.media import media_columns

    return media_columns(documents(spark, sf_dir, "doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"), least=100)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.langid import identify

    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.chat import format_chats

    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.bpe import encode_decode

    return encode_decode(documents(spark, sf_dir, "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.lm import score_texts

    return score_texts(documents(spark, sf_dir, "doc_id", "text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), components=32)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.lexical import rank_documents

    return rank_documents(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), k=50)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.substring_dedup import remove_repeated_windows

    return remove_repeated_windows(documents(spark, sf_dir, "doc_id", "text"), window=50)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_dedup, op3_secret_scans, op4_media_columns, op5_exact_dedup, op6_suffix_dedup, op7_language_id, op8_chat_formatting, op9_bpe, op10_lm_scoring, op11_embedding_whitening, op12_lexical_search, op13_substring_dedup)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY text)""",
    "op8_chat_formatting": """
        WITH t AS (
            SELECT conv_id, part, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
            FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS part FROM conversations)),
        p AS (
            SELECT conv_id, part, place, role, text,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
                       OVER (PARTITION BY conv_id, part ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far
            FROM t),
        ends AS (SELECT conv_id, max(place) AS n_turns, max_by(so_far, place) AS rendered FROM p GROUP BY conv_id, part),
        prefixes AS (
            SELECT DISTINCT p.place, p.so_far FROM p JOIN ends e ON p.conv_id = e.conv_id AND p.place < e.n_turns)
        SELECT min(conv_id) AS conv_id, n_turns, rendered FROM ends e
        WHERE NOT EXISTS (SELECT 1 FROM prefixes x WHERE x.place = e.n_turns AND x.so_far = e.rendered)
        GROUP BY n_turns, rendered""",
    "op12_lexical_search": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
        i AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
        totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
        p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        t AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, totals GROUP BY term, n_docs),
        s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
              FROM i JOIN t USING (term) JOIN w USING (term), totals GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_substring_dedup": """
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM t WHERE len(words) >= 50),
        windows AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i : i + 49], ' ')) AS earliest FROM starts),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows WHERE earliest < doc_id),
        places AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
               sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(places, []), i)), ' ')) AS kept_sha256
        FROM t LEFT JOIN places USING (doc_id)""",
}
