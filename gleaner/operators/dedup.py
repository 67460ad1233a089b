"""Deduplication of content within the search engine: exact, by signature, and by containment."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X


def distinct_by(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key in the given order (expressions); combines before it shuffles."""
    row = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *df.columns)
    best = df.groupBy(key.alias("__key")).agg(F.min(row).alias("r"))
    return best.select(*[F.col("r")[c].alias(c) for c in df.columns])


def exact_content(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row of each text that is equal up to white space, the one with the smallest id."""
    return distinct_by(df, F.sha2(X.squeezed(F.col(text_col)), 256), [F.col(id_col)])


def near_signature(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row of each signature (first 100 characters and length), the one with the smallest id."""
    return distinct_by(df, X.near_signature(F.col(text_col)), [F.col(id_col)])


def containment(df: DataFrame, container_col: str, order_cols: list[str], text_col: str, threshold: float = 0.8) -> DataFrame:
    """Within each container, in order: a text whose words (over two characters) lie to more than the
    threshold in a kept one is dropped; a kept one that lies so in a longer new text is replaced by it.
    A text without such words lies in any other. The outcome depends on the order, so order_cols have to
    settle ties. Each container, such as the passages of one page, is folded by one Python call, in which a
    text meets only kept ones that it shares a word with."""
    columns = df.columns

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order_cols, kind="stable")
        kept: list[tuple[int, set, int]] = []
        having: dict[str, set[int]] = {}  # places in kept, by word
        bare: set[int] = set()  # places of texts without words
        for i, text in enumerate(rows[text_col].fillna("")):
            words = {w for w in text.lower().split() if len(w) > 2}
            shared = Counter(k for w in words for k in having.get(w, ()))
            within = (k for k, n in shared.items() if n / len(words) > threshold) if words else range(len(kept))[:1]
            wider = [k for k, n in shared.items() if n / len(kept[k][1]) > threshold and len(text) > kept[k][2]] + [k for k in bare if len(text) > kept[k][2]]
            if wider:
                place = min(wider)
                for w in kept[place][1]:
                    having[w].discard(place)
                bare.discard(place)
                kept[place] = (i, words, len(text))
            elif min(within, default=None) is None:
                place = len(kept)
                kept.append((i, words, len(text)))
            else:
                continue
            for w in words:
                having.setdefault(w, set()).add(place)
            if not words:
                bare.add(place)
        return rows.iloc[[k[0] for k in kept]][columns]

    return df.groupBy(container_col).applyInPandas(fold, df.schema)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The requests that the cache lacks, once each: what a costly model still has to do."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def known_links(ranking: DataFrame, known: DataFrame, keys: list[str], order: str, score: str, least: int = 1, most: int = 10) -> DataFrame:
    """A ranking's rows, the first of each key in order, of keys that are known, with the score held between
    two bounds: what a model made up is left out."""
    first = distinct_by(ranking, F.struct(*keys), [F.col(order), F.col(score)])
    return first.join(known.select(*keys), keys, "left_semi").withColumn(score, F.greatest(F.lit(least), F.least(F.lit(most), F.col(score))))
