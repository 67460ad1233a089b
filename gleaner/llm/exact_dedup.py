"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations alone.

A text is read once for each pass and becomes its SHA-256 at once; only ids and hashes are ever
shuffled. Pass one counts how often each filter slot is hit (two slots a hash) and keeps the slots hit
at least twice, as 64-bit words. Pass two tests every row: a text that occurs twice has both of its
slots hit twice, so a row that fails the test is unique and passes straight through; only the rest is
shuffled and grouped by hash. A false positive costs a shuffled hash, never a wrong result.

The plan is the same at every size. The broadcast filter has ``bits_per_row`` bits a row and at most
``filter_bytes``; on a table with more rows than such a filter tells apart (4 million of its 64-bit words
by default), more hashes are shuffled, at worst all of them: some 50 bytes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from gleaner.llm import bloom
from gleaner.llm.common import checkpointed, fresh, text_or_empty


def flag_possible_repeats(hashes: DataFrame, rows: int, bits_per_row: int = 16, filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """hashes (with a column text_sha256) and a boolean column ``repeat``: false only if no other row has
    an equal hash."""
    bits = bloom.filter_bits(rows, bits_per_row, filter_bytes)
    key = F.col("text_sha256")
    slots = hashes.select(F.explode(F.array(*bloom.slots(key, bits))).alias("slot"))
    hit_twice = slots.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    return bloom.tested(hashes, key, bits, bloom.words_of(hit_twice), "repeat")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts form one group. Of
    equal texts the row with the largest id is kept; rows that repeat that id and text are all kept.
    A null id is smaller than any other. An empty table gives an empty result. Other columns of docs
    are neither read nor returned.
    """
    hashes = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    rows = flag_possible_repeats(hashes, docs.count(), **filter_options)
    unique = rows.filter(~F.col("repeat")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    repeats = rows.filter("repeat")
    groups = repeats.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # dealt by another key, both sides of the join below are shuffled for it, and a hot group is split
    groups = groups.repartition("keep_id").withColumnRenamed("text_sha256", "sha")
    joined = repeats.join(groups, repeats["text_sha256"] == groups["sha"])
    return unique.unionByName(joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id (of rows that tie,
    the one whose other columns sort last; columns that have no order, such as maps, count last, as JSON).

    Columns may have any names and kinds. Null texts count as empty. Groups are found on hashes. Rows
    that don't stay are then told by a filter of their ids and hashes, so a row outside any group isn't
    shuffled (but for the filter's false positives), whatever its text.
    """
    names = docs.columns
    sha, key, suspect = fresh(docs, "sha", "key", "suspect")
    gone_id, gone_sha, tied_id, tied_sha, row = fresh(docs, "gone_id", "gone_sha", "tied_id", "tied_sha", "row")
    found = checkpointed(exact_duplicates(docs, id_col, text_col, **filter_options).filter("group_size > 1"))
    gone = found.filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    # of groups whose largest id has several rows, one of these has to be chosen by the other columns
    ties = found.filter("kept").groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id")).filter("n > 1")
    tied = ties.select(F.col("doc_id").alias(tied_id), F.col("text_sha256").alias(tied_sha))
    rows = docs.withColumn(sha, F.sha2(text_or_empty(text_col), 256)).withColumn(key, F.xxhash64(F.col(id_col), sha))
    keys = gone.select(F.xxhash64(gone_id, gone_sha).alias("key")).unionByName(tied.select(F.xxhash64(tied_id, tied_sha).alias("key")))
    flagged = bloom.flag_members(rows, F.col(key), keys, suspect, filter_options.get("filter_bytes", bloom.FILTER_BYTES))
    suspects = flagged.filter(suspect).join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha)), "left_anti")
    marked = suspects.join(tied, F.col(id_col).eqNullSafe(F.col(tied_id)) & (F.col(sha) == F.col(tied_sha)), "left")
    ordered = [f.name for f in docs.schema if _orderable(f.dataType)]
    others = [F.to_json(F.struct(c)) for c in names if c not in ordered]
    chosen = marked.filter(F.col(tied_sha).isNotNull()).groupBy(tied_sha).agg(F.max_by(F.struct(*names), F.struct(*ordered, *others)).alias(row))
    parts = [flagged.filter(~F.col(suspect)).select(*names), marked.filter(F.col(tied_sha).isNull()).select(*names), chosen.select(*(F.col(row)[c].alias(c) for c in names))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
