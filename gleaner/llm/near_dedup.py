"""Near-duplicate detection with SuperMinHash.

A document is the set of its distinct word shingles. SuperMinHash gives each shingle a permutation of
the signature's slots and visits them by rank: at rank j it offers slot p(j) the value j + r(j), r(j)
uniform in [0, 1), and a slot keeps its smallest offer. A shingle's ranks in two slots always differ,
which is what lowers the variance against independent hashes, and once all slots of a document are
filled, later ranks can't win: it stops. Here all shingles of a batch advance by one rank at a time;
the permutations are x -> b + j * a modulo the prime number of slots, whose ranks in any two slots are
distributed as those of uniform permutations.

Then:
1. Documents of equal sets form a class with one representative.
2. Signatures are cut into bands; equal bands make buckets of representatives.
3. In each bucket the first representative, the hub, is compared with all others on full sets, and
   union-find joins what is similar.
4. Buckets that are still in several components are cut into tiles of a bounded number of shingles
   (the same bucket under several bands counts once). A task gets two tiles and compares, on full
   sets, every member outside their largest component with the members of a fitting size; it
   returns at most one link for each component, so pairs are never rows. Union-find over the
   components ends the search: the number of rounds doesn't depend on the size of a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import kernels as K
from gleaner.llm.bloom import flag_members
from gleaner.llm.common import checkpointed, fresh, per_batch, small_batches
from gleaner.llm.components import UnionFind, connected_components

SLOTS = 127
BLOCK = 1 << 20
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shingles in a tile of a bucket, on average; a task holds two tiles.
TILE = 1 << 18
#: Pairs of a hub that are compared with one copy of its set.
PART = 64


def super_minhash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signatures (rows of SLOTS numbers: rank and a 56-bit fraction) of the sets of distinct 64-bit values
    between the offsets. An empty set keeps FULL in all slots."""
    rows = len(offsets) - 1
    out = np.full((rows, SLOTS), FULL)
    flat = out.ravel()
    spread = K.mix(values ^ np.uint64(0x6A09E667F3BCC909))
    place = (spread % np.uint64(SLOTS)).astype(np.int64)
    step = (1 + (spread >> np.uint64(32)) % np.uint64(SLOTS - 1)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    for rank in range(SLOTS):
        fraction = K.mix(values + np.uint64((rank + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(8)
        np.minimum.at(flat, row * SLOTS + place, fraction | np.uint64(rank << 56))
        unfilled = (out == FULL).any(1)
        active = unfilled[row]
        if not active.any():
            break
        values, place, step, row = values[active], place[active], step[active], row[active]
        place = (place + step) % SLOTS
    return out


def band_shape(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that miss a pair of just the threshold with at most
    that probability."""
    for rows in range(SLOTS, 1, -1):
        if (1 - threshold**rows) ** (SLOTS // rows) <= miss:
            return SLOTS // rows, rows
    return SLOTS, 1


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    parts = signatures[:, : bands * rows].reshape(-1, bands, rows)
    for i in range(rows):
        keys = K.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = K.flat(batch.column("text"))
        counts, keys, first, second = [], [], [], []
        for a, b in K.blocks(offsets, BLOCK):
            values, at = K.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            counts.append(np.diff(at))
            keys.append(band_keys(super_minhash(values, at), bands, rows))
            for out, factor in ((first, 3), (second, 5)):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(values * np.uint64(factor) + np.uint64(factor)))))
                out.append(sums[at[1:]] - sums[at[:-1]])
        keys = np.concatenate(keys).astype(np.uint64).view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
        columns = [batch.column("doc_id"), pa.array(np.concatenate(counts)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (first, second)), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.mapInArrow(per_batch(run), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = K.flat(batch.column("text"))
        values, at = [], [np.zeros(1, np.int64)]
        for a, b in K.blocks(offsets, BLOCK):
            v, o = K.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            values.append(v)
            at.append(o[1:] + at[-1][-1])
        lists = pa.ListArray.from_arrays(np.concatenate(at).astype(np.int32), pa.array(np.concatenate(values).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["rep", "shingles"])

    return docs.mapInArrow(per_batch(run), "rep long, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets have 100 * intersection >= percent * union. b occurs a bounded number of
    times; a may occur any number of times, so its set is dealt out to one part for each PART of its pairs."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts")).withColumnRenamed("a", "hub").repartition("parts", "hub")
    dealt = pairs.join(parts, F.col("a") == F.col("hub")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    hubs = dealt.select(F.col("a").alias("x"), F.col("part").alias("x_part")).distinct()
    left = hubs.join(sets.select("rep", F.col("shingles").alias("s")), F.col("x") == F.col("rep")).drop("rep")
    right = sets.select(F.col("rep").alias("y"), F.col("shingles").alias("t"))
    both = dealt.join(right, F.col("b") == F.col("y")).join(left, (F.col("a") == F.col("x")) & (F.col("part") == F.col("x_part")))
    common = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("n"), (F.size("s") + F.size("t")).alias("total"))
    return common.filter(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b").repartition("a", "b").distinct()


def tile_links(component: np.ndarray, values: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the components of some sets (of at least one value each): for two sets with
    100 * intersection >= percent * union, a path of links joins their components."""
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    component, size, begin = component[order], size[order], offsets[:-1][order]
    at = np.concatenate(([0], np.cumsum(size)))
    codes = np.unique(values, return_inverse=True)[1][np.arange(at[-1]) + np.repeat(begin - at[:-1], size)]
    mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
    names, members = np.unique(component, return_counts=True)
    found = UnionFind()
    for i in np.flatnonzero(component != names[members.argmax()]).tolist():
        a = int(np.searchsorted(size, -(-int(size[i]) * percent // 100)))
        b = int(np.searchsorted(size, int(size[i]) * 100 // percent, side="right"))
        mine = codes[at[i] : at[i + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[codes[at[a] : at[b]]], at[a:b] - at[a], dtype=np.int64)
        mark[mine] = False
        for c in np.unique(component[a:b][100 * common >= percent * (size[i] + size[a:b] - common)]).tolist():
            found.union(c, int(component[i]))
    return [(x, root) for x in list(found.parent) if (root := found.find(x)) != x]


def _tile_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        lists = table.column("shingles").combine_chunks()
        values, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
        links = np.array(tile_links(table.column("component").to_numpy(), values, offsets, percent), np.int64).reshape(-1, 2)
        return pa.table([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    return run


def _component(df: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """df with the component of a node; a node that the table (node, component) lacks is its own."""
    table = table.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    joined = df.join(table, F.col(column) == F.col("__node"), "left")
    return joined.withColumn(name, F.coalesce("__component", column)).drop("__node", "__component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets (A-Z
    lower-cased, words outside ASCII white space); component_id is the smallest id reachable over links.
    A text with fewer words than a shingle is one shingle; null, empty and blank texts have none and are
    linked with nothing. The ids are the nodes of the graph: rows that repeat an id share its component.
    A null id is linked with nothing. An empty table gives no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    bands, rows = band_shape(percent / 100)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = checkpointed(_sketches(narrow, shingle_words, bands, rows))
    full = base.filter("n_shingles > 0 and doc_id is not null")
    classes = checkpointed(full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands", "n_shingles")).alias("m")).select("k1", "k2", F.col("m.doc_id").alias("rep"), "m.bands", "m.n_shingles"))
    table = _linked(narrow, classes, shingle_words, percent)
    keyed = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep")
    # dealt by another key first, so that the join shuffles both sides for itself and splits hot classes
    keyed = _component(keyed, table, "rep", "component").drop("rep").repartition("component", "c1", "c2")
    linked = base.drop("bands").join(keyed, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _linked(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """node and component of the representatives, without those that are their own component."""
    placed = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1")
    sizes = sizes.withColumnRenamed("bucket", "of").repartition("hub")
    members = checkpointed(placed.join(sizes, F.col("bucket") == F.col("of")).select("bucket", "n", "hub", "rep", "n_shingles"))
    candidates = members.select("rep").distinct()
    wanted = flag_members(docs.filter("doc_id is not null"), F.col("doc_id"), candidates, "__wanted").filter("__wanted").drop("__wanted")
    sets = _sets(wanted, size).join(candidates.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left_semi")
    sets = checkpointed(sets.repartition("rep"))
    # each member with its smallest hub; then with its other hubs (no more than bands), where these have
    # another smallest hub
    pairs = members.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.withColumn("first", F.col("a") == F.min("a").over(Window.partitionBy("b")))
    links = checkpointed(_similar(pairs.filter("first").select("a", "b"), sets, percent))
    parents = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    others = _component(_component(pairs.filter("not first"), parents, "a", "ca"), parents, "b", "cb").filter("ca != cb")
    links = links.unionByName(_similar(others.select("a", "b"), sets, percent))
    table = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # buckets that are still in several components
    named = _component(members.filter("n > 2").select("bucket", "rep", "n_shingles"), table, "rep", "component")
    found = F.struct(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)))
    spans = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n_shingles").alias("total"), found.alias("found"))
    spans = spans.filter("lo < hi").groupBy("found").agg(F.min("bucket").alias("of"), F.max("total").alias("total"))
    spans = spans.select("of", F.ceil(F.col("total") / TILE).alias("tiles")).repartition("tiles", "of")
    open_ = named.join(spans, F.col("bucket") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    open_ = open_.select("bucket", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "rep", "component")
    tiled = open_.join(sets.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).drop("rep", "r")
    merged = connected_components(tiled.groupBy("bucket", "one", "two").applyInArrow(_tile_links(percent), "u long, v long"))
    renamed = merged.select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = table.join(renamed, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return checkpointed(moved.unionByName(merged).distinct())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep; rows that repeat a kept id stay. Columns may
    have any names."""
    (gone,) = fresh(docs, "gone")
    found = near_duplicates(docs, id_col, text_col, shingle_words, percent).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col(gone), "left_anti")
