import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long_ = "long text about nothing in particular, again and again. " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the house.", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t ", "de"), (5, "The quick brown fox jumps over the lazy dog and runs away from the house.", "en"),
        (5, "The quick brown fox jumps over the lazy dog and runs away from the house.", "en"), (None, "a row without an id", "en"), (6, long_, "en"), (7, "x" * 300, None), (8, "1234 5678 !!", "fr"),
        (9, "Ein ganz anderer Satz in deutscher Sprache, der nicht sehr lang ist.", "de"), (10, "日本語 😀 <|endoftext|> ΑΣ", None), (11, long_ + "end", "en"), (-3, "negative", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {c: df["doc_id"] for c in ("shard", "word", "slot", "bits", "n", "rep", "bucket", "target", "kept", "length", "row")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
