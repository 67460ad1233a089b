"""The knowledge graph: entities, their sources, and typed edges, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(name: Column) -> Column:
    return F.lower(F.trim(name))


def entity_id(name: Column, kind: Column) -> Column:
    """A stable id of an entity: a digest of its canonical name and type."""
    return F.md5(F.concat_ws("\u0001", canonical(name), kind))


def known_type(kind: Column, types: Sequence[str], other: str = "OTHER") -> Column:
    return F.when(F.upper(F.trim(kind)).isin(*types), F.upper(F.trim(kind))).otherwise(other)


def merge_entities(mentions: DataFrame, types: Sequence[str]) -> DataFrame:
    """mentions (name, type, facts, source_url, place) folded by canonical name and type: the first name
    wins, facts and sources are united."""
    m = mentions.withColumn("type", known_type(F.col("type"), types)).withColumn("entity_id", entity_id(F.col("name"), F.col("type")))
    return m.groupBy("entity_id").agg(
        F.min_by("name", F.struct("place", "name")).alias("name"), F.first("type").alias("type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("facts", F.array().cast("array<string>")))))).alias("facts"), F.array_sort(F.collect_set("source_url")).alias("source_urls"),
    )


def enrich(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """entities with all facts and source URLs; without a source, empty lists."""
    none = F.array().cast("array<string>")
    asked = sources.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")  # before facts are brought together
    grouped = asked.groupBy(F.col("entity_id").alias("__e")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("facts")))).alias("facts"), F.array_sort(F.collect_set("source_url")).alias("source_urls"))
    joined = entities.join(grouped, F.col("entity_id") == F.col("__e"), "left").drop("__e")
    return joined.withColumns({"facts": F.coalesce("facts", none), "source_urls": F.coalesce("source_urls", none)})


def with_source(entities: DataFrame, sources: DataFrame, prefix: str | None = None, since_ms: int | None = None) -> DataFrame:
    """Entities with a source under the prefix and (the same one) not older than since_ms."""
    s = sources
    if prefix:
        s = s.filter(F.col("source_url").startswith(prefix))
    if since_ms is not None:
        s = s.filter(F.col("extracted_at_ms") >= since_ms)
    return entities.join(s.select("entity_id"), "entity_id", "left_semi")


def orphans(entities: DataFrame, sources: DataFrame) -> DataFrame:
    return entities.join(sources.select("entity_id"), "entity_id", "left_anti")


def resolve_edges(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations (from_name, to_name, ...) whose two ends are both known names (name, entity_id)."""
    ends = lambda side: names.select(F.col("name").alias(f"__{side}"), F.col("entity_id").alias(f"{side}_id"))
    return relations.join(ends("from"), F.col("from_name") == F.col("__from")).join(ends("to"), F.col("to_name") == F.col("__to")).drop("__from", "__to")


def traverse(edges: DataFrame, vertices: DataFrame, seeds: DataFrame, hops: int, dedupe: bool = False, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """Edges (hop, from_id, to_id, relation_type) within some hops of the seeds (id), along directions.

    Each hop takes the distinct edges out of the frontier whose two ends are known; the next frontier is
    their ends that aren't in the present one. A vertex of an earlier hop may thus be expanded again and
    its edges repeat; dedupe leaves vertices out that were expanded before.

    The distinct edges are made once and checkpointed, and so is what a hop finds: the plan of a hop
    contains neither the edges' sources nor the hops before it. Ends are looked up for the edges out of
    the frontier alone."""
    known = vertices.select("id").distinct()
    frontier = seeds.select("id").distinct().join(known, "id", "left_semi")
    edges = checkpoint(edges.select("from_id", "to_id", "relation_type").distinct()) if hops else edges
    expanded, out = frontier, None
    for hop in range(1, hops + 1):
        found = edges.join(frontier.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
        found = checkpoint(found.join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.lit(hop).alias("hop"), "from_id", "to_id", "relation_type"))
        out = found if out is None else out.unionByName(found)
        frontier = found.select(F.col("to_id").alias("id")).distinct().join(expanded, "id", "left_anti")
        expanded = expanded.unionByName(frontier) if dedupe else frontier
    return out


def match(vertices: DataFrame, edges: DataFrame, start: Column | None = None, relation: str | None = None, end: Column | None = None, limit: int | None = None) -> DataFrame:
    """One step of a pattern (a)-[r]->(b): columns a_*, relation_type, b_*; start and end are conditions on
    the columns of vertices."""
    a = vertices.filter(start) if start is not None else vertices
    b = vertices.filter(end) if end is not None else vertices
    e = edges.filter(F.col("relation_type") == relation) if relation else edges
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    out = e.join(a, F.col("from_id") == F.col("a_id")).join(b, F.col("to_id") == F.col("b_id")).drop("from_id", "to_id")
    return out if limit is None else out.orderBy("a_id", "b_id", "relation_type").limit(limit)


def all_source_urls(entities: DataFrame) -> DataFrame:
    return entities.select(F.explode("source_urls").alias("url")).distinct()


def top_entities(entities: DataFrame, distance: Column, k: int) -> DataFrame:
    return entities.withColumn("distance", distance).orderBy("distance", "entity_id").limit(k)


def longest_common_path(paths: DataFrame, group: str, path: str) -> DataFrame:
    """The longest common leading part of each group's paths (their segments by /): from the smallest and
    the largest path in order, which bound all others."""
    ends = paths.groupBy(group).agg(F.min(F.split(path, "/")).alias("a"), F.max(F.split(path, "/")).alias("b"))
    places = F.sequence(F.lit(1), F.least(F.size("a"), F.size("b")))
    same = F.filter(places, lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return ends.select(group, F.array_join(F.slice("a", 1, F.size(same)), "/").alias("ancestor"))



def patterns(vertices: DataFrame, edges: DataFrame, ends: Sequence[Column | None], steps: Sequence[tuple[str | None, int, int]], checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """Matches of (v0)-[*lo..hi]->(v1)-[*lo..hi]->(v2) ...: columns v0, v1, ... (ids) and edges, how many there are
    in the match. ``ends`` has a condition on the vertices for each v, or None, and steps a relation (None: any)
    with the fewest and most edges.

    No edge is in a match twice; each way that differs in an edge is a match of its own. Edges are the distinct
    rows of from_id, to_id, relation_type whose two ends are vertices. The frontier is checkpointed after each
    edge. The pattern is walked from whichever end fewer vertices fit."""
    known = checkpoint(edges.select("from_id", "to_id", "relation_type").distinct().join(vertices.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(vertices.select(F.col("id").alias("to_id")), "to_id", "left_semi"))
    fits = [None if c is None else vertices.filter(c).select("id").distinct() for c in ends]
    sizes = [vertices.count() if f is None else f.count() for f in (fits[0], fits[-1])]
    backwards = sizes[1] < sizes[0]
    near, far = ("to_id", "from_id") if backwards else ("from_id", "to_id")
    order = list(range(len(ends)))[::-1] if backwards else list(range(len(ends)))
    walk = list(steps)[::-1] if backwards else list(steps)
    first = vertices.select("id").distinct() if fits[order[0]] is None else fits[order[0]]
    kind = "array<struct<from_id:string,to_id:string,relation_type:string>>"
    now = first.select(F.col("id").alias(f"v{order[0]}"), F.col("id").alias("__at"), F.array().cast(kind).alias("__used"))
    for place, (relation, low, high) in zip(order[1:], walk):
        usable = known.filter(F.col("relation_type") == relation) if relation else known
        here = usable.select(F.col(near).alias("__near"), F.col(far).alias("__far"), F.struct(*(F.col(c).cast("string").alias(c) for c in ("from_id", "to_id", "relation_type"))).alias("__edge"))
        reached = now if low == 0 else None
        for n in range(1, high + 1):
            longer = now.join(here, F.col("__at") == F.col("__near")).filter(~F.array_contains("__used", F.col("__edge")))
            now = checkpoint(longer.withColumns({"__at": F.col("__far"), "__used": F.array_append("__used", F.col("__edge"))}).drop("__near", "__far", "__edge"))
            if n >= low:
                reached = now if reached is None else reached.unionByName(now)
        reached = reached.withColumn(f"v{place}", F.col("__at"))
        now = reached if fits[place] is None else reached.join(fits[place].select(F.col("id").alias(f"v{place}")), f"v{place}", "left_semi")
    return now.select(*(f"v{i}" for i in range(len(ends))), F.size("__used").alias("edges"))


def legs(checkpoint: Callable[[DataFrame], DataFrame], **makes: Callable[[], DataFrame]) -> dict[str, DataFrame | None]:
    """The result of each leg of a retrieval, worked out; None for a leg that fails, which doesn't end the others."""
    out: dict[str, DataFrame | None] = {}
    for name, make in makes.items():
        try:
            out[name] = checkpoint(make())
        except Exception:  # whatever a leg raises, it alone is missing
            out[name] = None
    return out
