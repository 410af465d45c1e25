"""Groups of one entity: components, aliases, splits under conflicts, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import checkpoint, connected_components
from quillgraph.operators.edges import both_ways
from quillgraph.operators.skew import join_counted


def key_links(rows: DataFrame, entity: str, key: str) -> DataFrame:
    """``(a, b)``: each entity with the smallest one of the same key; a chain, never all pairs."""
    r = rows.select(entity, key).where(F.col(key).isNotNull()).distinct()
    first = r.groupBy(key).agg(F.min(entity).alias("a"))
    return r.join(first, key).where(F.col("a") < F.col(entity)).select("a", F.col(entity).alias("b")).distinct()


def groups_of(links: DataFrame) -> DataFrame:
    """``(node, group)`` of components of links (a, b); single nodes have none."""
    return connected_components(links, "a", "b").withColumnRenamed("component", "group")


def alias_closure(aliases: DataFrame) -> DataFrame:
    """``(old, new)`` with every alias led to its terminal survivor.

    Pointers double their reach each round. Raises ValueError if an id has two survivors or aliases form a cycle.
    """
    a = checkpoint(aliases.select("old", "new").where("old <> new").distinct())
    if not a.groupBy("old").count().where("count > 1").isEmpty():
        raise ValueError("an id has competing survivors")
    rounds = max(1, a.count()).bit_length() + 1
    for _ in range(rounds):
        n = a.select(F.col("old").alias("new"), F.col("new").alias("next"))
        stepped = checkpoint(a.join(n, "new", "left").select("old", F.coalesce("next", "new").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not stepped.where("old = to").isEmpty():
            raise ValueError("aliases form a cycle")
        a = stepped.select("old", F.col("to").alias("new"))
        if stepped.where("moved").isEmpty():
            return a
    raise ValueError("aliases form a cycle")


def repoint(edges: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """edges with a column's ids led to their survivors."""
    m = aliases.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return edges.join(m, edges[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def identity_groups(entities: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """``(entity, group)`` for all entities: those that share any identifier, through any chain, are one group."""
    links = None
    for k in keys:
        part = key_links(entities.select(entity, F.col(k).cast("string").alias("key")), entity, "key")
        links = part if links is None else links.union(part)
    found = groups_of(links)
    return entities.select(entity).distinct().join(found, F.col(entity) == F.col("node"), "left").select(entity, F.coalesce("group", entity).alias("group"))


def split_conflicts(members: DataFrame, group: str, entity: str, identities: list[str]) -> DataFrame:
    """``(group, entity, part)``: a group that holds two values of an identity is split by it.

    Identities are tried in order, each on the parts that the one before left. Members without a value follow those with the
    most members (ties: the smallest value); a part is named by its smallest member. An entity has one row. Values are counted a part
    and members labelled by joins in which large parts are dealt out, so a group may have any size. A NULL group is a group.
    """
    rows = checkpoint(members.select(F.struct(F.col(group)).alias("_g"), F.col(entity).alias("_e"), *identities).withColumn("_p", F.lit(0)))
    for k, identity in enumerate([*identities, None]):  # the last round only names the parts
        label = F.lit("") if identity is None else F.col(identity).cast("string")
        each = rows.withColumn("_v", label).groupBy("_g", "_p", "_v").agg(F.count("*").alias("n"), F.min("_e").alias("low"))
        value = F.when(F.col("_v").isNotNull(), F.struct((-F.col("n")).alias("n"), "_v"))
        parts = checkpoint(each.groupBy("_g", "_p").agg(F.sum("n").alias("n"), F.count("_v").alias("values"), F.min(value).getField("_v").alias("main"), F.min("low").alias("low")))
        if identity is None:
            named = join_counted(rows, parts.select("_g", "_p", "n", "low"), ["_g", "_p"], "n")
            return named.select(F.col(f"_g.{group}").alias(group), F.col("_e").alias(entity), F.col("low").alias("part"))
        told = join_counted(rows, parts.select("_g", "_p", "n", "values", "main"), ["_g", "_p"], "n")
        part = F.when(F.col("values") > 1, F.concat(F.lit("="), F.coalesce(label, "main"))).otherwise("")
        rows = checkpoint(told.withColumn("_p", F.struct(F.col("_p"), part.alias(f"p{k}"))).select("_g", "_e", *identities, "_p"))
    return rows


def nearest_root(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """``(node, root, dist)`` of the strictly nearest root over undirected edges (a, b); ties stay without one.

    A frontier grows by one step a round, until it is empty or ``most`` steps from the roots. A node remembers the smallest and largest root at its distance, which tells a tie.
    """
    steps = checkpoint(both_ways(edges.select("a", "b")))
    seen = checkpoint(roots.select(F.col("node"), F.col("node").alias("low"), F.col("node").alias("high"), F.lit(0).alias("dist")))
    d = 0
    while most is None or d < most:
        d += 1
        edge = seen.where(F.col("dist") == d - 1).join(steps, "node")
        new = edge.groupBy(F.col("other").alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high")).join(seen.select("node"), "node", "left_anti")
        new = checkpoint(new.withColumn("dist", F.lit(d)))
        if new.isEmpty():
            break
        seen = checkpoint(seen.union(new))
    return seen.where("low = high").select("node", F.col("low").alias("root"), "dist")


def ring_walk(edges: DataFrame, seeds: DataFrame, rings: int = 5) -> DataFrame:
    """``(node, ring)``: how many steps along edges (a, b) from the seeds a node is first met."""
    out = checkpoint(seeds.select("node").distinct().withColumn("ring", F.lit(0)))
    for k in range(1, rings + 1):
        found = out.where(F.col("ring") == k - 1).join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = checkpoint(found.join(out, "node", "left_anti").withColumn("ring", F.lit(k)))
        if new.isEmpty():
            break
        out = checkpoint(out.union(new))
    return out


def component_sizes(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``(node, component, size, kind)``: giant (the largest; ties: the smallest id), small or single."""
    found = connected_components(edges, "a", "b").withColumnRenamed("node", "_n")
    all_ = nodes.select(node).distinct().join(found, F.col(node) == F.col("_n"), "left").select(node, F.coalesce("component", node).alias("component"))
    sizes = all_.groupBy("component").agg(F.count("*").alias("size"))
    giant = sizes.where("size > 1").agg(F.min(F.struct((-F.col("size")).alias("n"), "component")).alias("g")).select("g.component")
    kind = F.when(F.col("giant").isNotNull(), "giant").when(F.col("size") > 1, "small").otherwise("single")
    return all_.join(sizes, "component").join(F.broadcast(giant.withColumn("giant", F.lit(1))), "component", "left").select(node, "component", "size", kind.alias("kind"))
