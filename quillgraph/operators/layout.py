"""Placing a graph's nodes on a map, as joins and aggregates.

Forces need every pair of nodes; here far nodes act through the centre of their grid cell, so a
step is an edge join, a cell aggregate and a join with the cells, whose number a parameter fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint
from quillgraph.operators.edges import both_ways

CELLS = 16


def noise(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on key and seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / (1 << 30)


def force_layout(nodes: DataFrame, node: str, edges: DataFrame, steps: int = 20, pull: float = 1.0, push: float = 1.0, gravity: float = 0.05) -> DataFrame:
    """``(node, x, y)`` after a number of steps from places that the node's hash gives.

    Edges (a, b, w) pull in proportion to distance and weight, cells of the map push by mass over distance, and
    gravity pulls to the middle. Repeated runs give the same places. Nodes without an edge are placed too.
    """
    placed = checkpoint(nodes.select(F.col(node).alias("node"), noise(F.col(node), "x").alias("x"), noise(F.col(node), "y").alias("y")))
    links = checkpoint(both_ways(edges.select("a", "b", F.col("w").cast("double").alias("w"))))
    for k in range(steps):
        box = placed.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if box[0] is None:
            break
        side = max(box[1] - box[0], box[3] - box[2], 1e-9)
        cx, cy = (F.least(F.floor((F.col(c) - low) / side * CELLS), F.lit(CELLS - 1)) for c, low in (("x", box[0]), ("y", box[2])))
        cells = placed.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("m"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
        masses = [tuple(r) for r in cells.select("m", "mx", "my").orderBy("mx", "my").collect()]  # CELLS x CELLS rows at most
        other = placed.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        drawn = links.join(other, "other").groupBy("node").agg(F.sum(F.col("w") * F.col("ox")).alias("wx"), F.sum(F.col("w") * F.col("oy")).alias("wy"), F.sum("w").alias("ws"))
        table = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(mx)).alias("x"), F.lit(float(my)).alias("y")) for m, mx, my in masses])

        def pushed(axis: str, table: Column = table) -> Column:
            def add(s: Column, c: Column) -> Column:
                dx, dy = F.col("x") - c["x"], F.col("y") - c["y"]
                d2 = dx * dx + dy * dy + F.lit((side / CELLS) ** 2)
                return s + c["m"] * (dx if axis == "x" else dy) / d2

            return F.aggregate(table, F.lit(0.0), add)

        n, cool = sum(m for m, _, _ in masses), 0.5 * (1 - k / steps)
        mid = {"x": (box[0] + box[1]) / 2, "y": (box[2] + box[3]) / 2}
        force = {c: pull * (F.coalesce(f"w{c}", F.lit(0.0)) - F.coalesce("ws", F.lit(0.0)) * F.col(c)) / F.greatest(F.coalesce("ws", F.lit(0.0)), F.lit(1.0)) + push * side * side / max(n, 1) * pushed(c) / 4 + gravity * (mid[c] - F.col(c)) for c in "xy"}
        placed = checkpoint(placed.join(drawn, "node", "left").select("node", *[(F.col(c) + cool * force[c]).alias(c) for c in "xy"]))
    return placed.withColumnRenamed("node", node)


def fitted(places: DataFrame, low: float = 30, high: float = 970, digits: int = 1) -> DataFrame:
    """places with x and y within low and high, proportions kept, rounded."""
    box = places.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scaled = places.join(F.broadcast(box))  # a single row
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    to = {c: F.when(span > 0, low + (F.col(c) - F.col(f"{c}0")) / span * (high - low)).otherwise((low + high) / 2) for c in "xy"}
    return scaled.select(*[c for c in places.columns if c not in "xy"], *[F.bround(to[c], digits).alias(c) for c in "xy"])


def at_neighbours(nodes: DataFrame, node: str, edges: DataFrame, places: DataFrame, jitter: float) -> DataFrame:
    """``(node, x, y)`` of nodes at the weighted middle of their placed neighbours, moved a little by their hash."""
    seen = places.select(F.col("node").alias("other"), "x", "y")
    middle = both_ways(edges.select("a", "b", "w")).join(seen, "other").groupBy("node").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "xy"])
    return nodes.select(F.col(node).alias("node")).join(middle, "node").select(F.col("node").alias(node), *[(F.col(c) + jitter * (noise(F.col("node"), c) - 0.5)).alias(c) for c in "xy"])


def owners_of_cells(places: DataFrame, group: str, size: float, reach: int = 1) -> DataFrame:
    """``(cx, cy, group, density)``: which group is densest in each cell of the map; a node counts less for cells further off."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1.0 / (1 + i * i + j * j)).alias("d")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    near = places.select(group, F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"), F.explode(steps).alias("s"))
    density = near.groupBy((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), group).agg(F.round(F.sum("s.d"), 9).alias("density"))
    best = density.groupBy("cx", "cy").agg(F.min(F.struct((-F.col("density")).alias("d"), group)).alias("b"))
    return best.select("cx", "cy", F.col(f"b.{group}").alias(group), (-F.col("b.d")).alias("density"))


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon, by the even-odd rule."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            odd = odd != crosses
    return odd


def fewer_colleague_edges(members: DataFrame, group: str, node: str, most: int = 3) -> DataFrame:
    """``(a, b)``: each node with up to ``most`` of its group's that follow it in an order by hash, in a ring.

    As many edges as nodes times ``most``: no group is ever paired up in full.
    """
    order = F.xxhash64(F.lit("ring"), F.col(node))
    ring = Window.partitionBy(group).orderBy(order, node)
    sized = members.select(group, node).distinct()
    numbered = sized.withColumn("r", F.row_number().over(ring) - 1).join(sized.groupBy(group).agg(F.count("*").alias("n")), group)
    steps = F.explode(F.sequence(F.lit(1), F.lit(most)))
    out = numbered.where("n > 1").select(group, F.col(node).alias("a"), "r", "n", steps.alias("k")).where("k < n").withColumn("r", (F.col("r") + F.col("k")) % F.col("n"))
    paired = out.join(numbered.select(group, "r", F.col(node).alias("b")), [group, "r"])
    return paired.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
