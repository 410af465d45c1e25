"""A publish program as tables: what rows ask of a graph, the graph after it, and what nothing explains any more.

A node is named by its label and id in one string (``Person:7``), an edge by (rel, src, tgt). The order is
fixed: nodes, promotions, edges, folds, then the end of evidence that was checked again. Nothing here
writes; the graph after a program is a table, so that a plan can be read before it is carried out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint
from quillgraph.operators.edges import attach
from quillgraph.operators.groups import alias_closure, repoint

EDGE = ["rel", "src", "tgt"]


@dataclass(frozen=True)
class Program:
    """What is to be published. NULL node names are no nodes; repeated rows count once.

    rows: (node, written); a row that is not written (it was never enriched) still explains a node that is there.
    edges: EDGE, as the rows ask for them. dropped: EDGE that were taken away by hand, as named before folds.
    folds: (old, new) of rows and of earlier programs. promotions: (old, new), a candidate and the node that it turned out
    to be; one to a node that no row writes waits.
    checked: (rel, owner, complete), nodes whose evidence of a relation was looked for again; one of several nodes that are folded
    into one that is not complete keeps the evidence of all. owner_end: for each checked relation, whether the owner is its src or tgt.
    claimed: EDGE, and claimed_nodes: (node), that someone wants kept. owned: relations that the graph keeps itself.
    """

    rows: DataFrame
    edges: DataFrame
    folds: DataFrame
    promotions: DataFrame
    checked: DataFrame
    owner_end: dict[str, str]
    dropped: DataFrame
    claimed: DataFrame
    claimed_nodes: DataFrame
    owned: tuple[str, ...] = ()


@dataclass(frozen=True)
class Desired:
    """A program against one graph: ``aliases`` (old, new), led to their ends; ``nodes``; ``edges`` at nodes that will be there."""

    aliases: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _flags(key: list[str], **parts: DataFrame) -> DataFrame:
    """Every key of any part, with a boolean for each part that has it: one shuffle, combined before it."""
    rows = reduce(DataFrame.union, [df.select(*key, F.lit(name).alias("_part")) for name, df in parts.items()])
    return rows.groupBy(*key).agg(*[F.bool_or(F.col("_part") == name).alias(name) for name in parts])


def _led(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges between survivors; one that a fold bends onto itself goes."""
    ends = repoint(repoint(edges.select(*EDGE), aliases, "src"), aliases, "tgt")
    return ends.select(*EDGE).where("src <> tgt").distinct()


def desired(program: Program, live_nodes: DataFrame) -> Desired:
    """What the program asks for, after promotions and folds. An edge to a node that is nowhere is not made, as it could not be.

    Raises ValueError where a node has two survivors or folds form a circle, before anything is planned.
    """
    rows = program.rows.where("node IS NOT NULL").groupBy("node").agg(F.bool_or("written").alias("written"))
    written = checkpoint(rows.where("written").select("node"))
    promoted = program.promotions.join(written.select(F.col("node").alias("new")), "new", "left_semi").select("old", "new")
    aliases = checkpoint(alias_closure(program.folds.select("old", "new").union(promoted)))
    old = aliases.select(F.col("old").alias("node"))
    nodes = checkpoint(written.join(old, "node", "left_anti"))
    there = nodes.union(live_nodes.select("node").join(old, "node", "left_anti"))
    asked = program.edges.select(*EDGE).join(program.dropped.select(*EDGE).distinct(), EDGE, "left_anti")
    met, _ = attach(_led(asked, aliases), there.withColumnRenamed("node", "src"), there.withColumnRenamed("node", "tgt"), "src", "tgt")
    return Desired(aliases, nodes, checkpoint(met.select(*EDGE)))


def published(program: Program, live_nodes: DataFrame, live_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the program, each with ``state``: created, kept, or removed.

    Removed nodes are those folded into others. An edge is removed only where its owner's evidence was looked for again in full
    and is no longer there; all others stay, explained or not.
    """
    want = desired(program, live_nodes)
    nodes = _flags(["node"], live=live_nodes, wanted=want.nodes, old=want.aliases.select(F.col("old").alias("node")))
    state = F.when(F.col("old"), "removed").when(F.col("live"), "kept").otherwise("created")
    nodes = nodes.where("wanted OR live").select("node", state.alias("state"))
    edges = _flags(EDGE, live=_led(live_edges, want.aliases), wanted=want.edges, claimed=_led(program.claimed, want.aliases)).where("live OR wanted")
    ends = [F.when(F.col("rel") == rel, F.col(end)) for rel, end in program.owner_end.items()]
    checked = repoint(program.checked, want.aliases, "owner").groupBy("rel", "owner").agg(F.bool_and("complete").alias("complete"))
    owner = F.coalesce(*ends, F.lit(None).cast("string"))
    # edges of other relations have no owner: each gets a key of its own that meets nothing, so that they are dealt out and not all in one task
    edges = edges.withColumns({"_owned": owner.isNotNull(), "owner": F.coalesce(owner, F.concat_ws(" ", "src", "tgt"))})
    edges = edges.join(checked.withColumn("_owned", F.lit(True)), ["rel", "owner", "_owned"], "left")
    gone = ~F.col("wanted") & ~F.col("claimed") & F.coalesce("complete", F.lit(False))
    return nodes, edges.select(*EDGE, F.when(gone, "removed").when(F.col("live"), "kept").otherwise("created").alias("state"))


def prune_plan(program: Program, live_nodes: DataFrame, live_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), each with ``action``: create and keep what is asked for, delete what nothing explains.

    A live node that is folded or promoted has ``fold``; what nothing but a claim explains has ``hand`` and stays; a live node whose row was not
    written is kept. Live edges are compared where folds lead them; those of owned relations are left out.
    """
    want = desired(program, live_nodes)
    nodes = _flags(["node"], live=live_nodes, wanted=want.nodes, known=program.rows.where("node IS NOT NULL"), claimed=program.claimed_nodes, old=want.aliases.select(F.col("old").alias("node")))
    action = F.when(F.col("old"), "fold").when(~F.col("live"), "create").when(F.col("wanted") | F.col("known"), "keep").when(F.col("claimed"), "hand").otherwise("delete")
    nodes = nodes.where("live OR (wanted AND NOT old)").select("node", action.alias("action"))
    edges = _flags(EDGE, live=_led(live_edges, want.aliases), wanted=want.edges, claimed=_led(program.claimed, want.aliases)).where("live OR wanted")
    if program.owned:
        edges = edges.where(~F.col("rel").isin(*program.owned))
    action = F.when(~F.col("live"), "create").when(F.col("wanted"), "keep").when(F.col("claimed"), "hand").otherwise("delete")
    return nodes, edges.select(*EDGE, action.alias("action"))
