"""The language stage of the pipeline, against a version in plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import kernels, langid


def test_language_stage_rejects_junk_and_an_unlearned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    rnd = random.Random(3)
    junk = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for n in (200, 1000, 5000)] + ["1234 !!", "", None, "x" * 3000]
    # Spanish is never learned: its rows have no label
    rows = docs.filter("lang != 'es'").unionByName(docs.filter("lang = 'es'").withColumn("lang", F.lit(None).cast("string")))
    odd = spark.createDataFrame([(10**9 + i, t, None, "src0", len(t or "")) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars int")
    rows = rows.unionByName(odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).cache()
    kept = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, rows, "").collect()}
    found, model = rows.collect(), langid.fit(rows)
    assert model.languages == ["de", "en", "fr"] and not any(i >= 10**9 for i in kept)
    bounds = np.maximum.accumulate(model.least, axis=1)
    want = {}
    for r in found:
        if r.text and any(c.isalpha() for c in r.text):
            data, offsets = kernels.flat(pa.array([r.text]))
            x = langid.features(data, offsets)
            lang = model.predict(x)[0][0]
            i, piece = model.languages.index(lang), min(13, max(4, len(data).bit_length() - 1)) - 4
            if len(data) < 16 or float(x[0] @ model.centres[i]) >= bounds[i, piece]:
                want[r.doc_id] = lang
    assert kept == want
    long_ = [r for r in found if r.text and len(r.text) >= 500]
    spanish = [r for r in long_ if r.lang is None and r.doc_id < 10**9]
    assert len(spanish) > 20 and sum(r.doc_id in kept for r in spanish) <= 0.05 * len(spanish)
    clean = [r for r in found if r.lang is not None and r.doc_id in good]
    assert sum(r.doc_id in kept for r in clean) >= 0.99 * len(clean)


def test_stages_on_odd_rows_and_an_empty_table(spark):
    """Nulls, empty and very long texts, repeated rows, rows without an id, and no rows at all."""
    plain = "The quick brown fox jumps over the lazy dog and runs away from the house by the river. "
    german = "Der schnelle braune Fuchs springt ueber den faulen Hund und laeuft vom Haus am Fluss weg. "
    rows = [(i, plain * 2 + f"number {i} of many", "en", "s", 1) for i in range(30)] + [(100 + i, german * 2 + f"Nummer {i}", "de", "s", 1) for i in range(30)]
    rows += [(200, None, "en", "s", 0), (201, "", None, None, None), (202, plain * 3000, "en", "s", 9), (203, plain * 3000, "en", "s", 9), (203, plain * 3000, "en", "s", 9), (None, "a row without an id and the house", "en", None, None), (204, "1234 !!", "en", "s", 7)]
    rows += [(205, "the house has a password=hunter2hunter22 and the river", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r.text for r in docs.collect()) if name != "language_id" else None
        docs = corpus_pipeline.checkpointed(stage(spark, docs, ""))
        found = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "language_id":
            assert {r.doc_id for r in found}.isdisjoint({200, 201, 204}) and {r.lang for r in found} == {"en", "de"}
        if name == "exact_dedup":
            assert Counter(r.text for r in found) == Counter(before.keys())
            assert [r.doc_id for r in found if len(r.text) > 10_000] == [203]
        if name == "secret_scan":
            assert sum(before.values()) == len(found) and not any("hunter22" in r.text for r in found)
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.checkpointed(stage(spark, empty, ""))
        assert empty.count() == 0
