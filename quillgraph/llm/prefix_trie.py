"""The trie of conversation prefixes: radix partitioning from the first turn on, multikey quicksort in buckets that have become small."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.operators.checkpoints import checkpoint
from quillgraph.operators.skew import join_counted

#: Turns of a bucket that one task finishes; larger ones are parted further by Spark.
LOCAL = 1 << 16
#: Turn numbers that are ordered together: so many rows of a conversation meet in one task, and repeated turn numbers.
BLOCK = 1024
#: Conversation ids whose digest text is made at once.
IDS = 4096
_NODE = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_COLUMNS = [x.split()[0] for x in _NODE.split(", ")]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def encode_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, pos, tid, size)`` of every turn: its place from 0, the number of its (role, text), and the bytes of its text.

    Turns are ordered by ``turn``, NULL first; equal ones by the digest of role and text. A NULL role or text is empty. Rows without a
    conversation id are of no conversation and go.
    """
    role_, text_ = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = checkpoint(convs.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("turn"), F.coalesce(F.expr(f"`{turn}` div {BLOCK}"), F.lit(-(1 << 63))).alias("block"),
        digest.alias("g"), F.octet_length(text_).cast("bigint").alias("size"),
    ))
    numbers = rows.groupBy("g").agg(F.count("*").alias("n")).withColumn("tid", F.monotonically_increasing_id() + 1)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("c", "block").agg(F.count("*").alias("n")).select("c", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "g")
    placed = rows.withColumn("k", F.row_number().over(within) - 1).join(blocks, ["c", "block"])
    return checkpoint(join_counted(placed, numbers, ["g"], "n").select("c", (F.col("first") + F.col("k")).alias("pos"), "tid", "size"))


def _finish(depth: int, c: list, start: list, tid: list, size: list, out: list) -> None:
    """Nodes of one bucket whose conversations share ``depth`` turns: the node of that depth first, then those below it.

    c: the conversations in order; start: where each one's further turns begin in tid, which has a 0 after them.
    """
    depths, convs, parents, counts, sizes, children, ends = [depth], [c[0]], [-1], [len(c)], [0], [0], [[]]

    def add(parent: int, members: list, nbytes: int) -> int:
        depths.append(depths[parent] + 1)
        convs.append(c[members[0]])
        parents.append(parent)
        counts.append(len(members))
        sizes.append(nbytes)
        children.append(0)
        ends.append([])
        children[parent] += 1
        return len(depths) - 1

    todo = [(list(range(len(c))), 0, 0)]
    while todo:
        members, k, node = todo.pop()
        if len(members) == 1:
            at = start[members[0]] + k
            while tid[at]:
                node = add(node, members, size[at])
                at += 1
            ends[node].append(c[members[0]])
            continue
        symbols = [tid[start[m] + k] for m in members]
        a, b, z = symbols[0], symbols[len(symbols) // 2], symbols[-1]
        pivot = max(min(a, b), min(max(a, b), z))
        less = [m for m, s in zip(members, symbols, strict=True) if s < pivot]
        same = [m for m, s in zip(members, symbols, strict=True) if s == pivot]
        more = [m for m, s in zip(members, symbols, strict=True) if s > pivot]
        todo += [(rest, k, node) for rest in (less, more) if rest]
        if pivot:
            todo.append((same, k + 1, add(node, same, size[start[same[0]] + k])))
        else:
            ends[node] += [c[m] for m in same]
    leaves, below = [0] * len(depths), [0] * len(depths)
    for i in range(len(depths) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if i:
            leaves[parents[i]] += leaves[i]
            below[parents[i]] += below[i] + (counts[i] - 1) * sizes[i]
    for i, d in enumerate(depths):
        saved = below[i] + (counts[i] - 1) * sizes[i]  # of the top: without its own, which is not known here
        digest = hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest() if ends[i] else _NO_ENDS
        out.append((d, convs[i], convs[parents[i]] if i else None, counts[i], children[i], leaves[i], saved, digest))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of the buckets whose rows come one after another, ordered by conversation and place."""
    types = [pa.int64()] * 7 + [pa.string()]
    rest: list[np.ndarray] = []

    def finish(d, b, c, tid, size) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1]))))
        tops = np.flatnonzero(np.concatenate(([True], (b[heads][1:] != b[heads][:-1]) | (d[heads][1:] != d[heads][:-1]))))
        starts, names, tid, size, out = heads.tolist(), c[heads].tolist(), tid.tolist(), size.tolist(), []
        for x, y in zip(tops.tolist(), [*tops[1:].tolist(), len(heads)], strict=True):
            _finish(int(d[heads[x]]), names[x:y], starts[x:y], tid, size, out)
        columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = [batch.column(k).to_numpy() for k in range(5)]
        rest = [np.concatenate(x) for x in zip(rest, new, strict=True)] if rest else new
        last = int(np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))[-1]) + 1 if (rest[0][0], rest[1][0]) != (rest[0][-1], rest[1][-1]) else 0
        if last:
            yield from finish(*(x[:last] for x in rest))
            rest = [x[last:] for x in rest]
    if rest:
        yield from finish(*rest)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's ids, whose texts come part by part, in order."""
    key, digest, done = None, None, []
    for batch in batches:
        for depth, conv, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key == (depth, conv):
                digest.update(b",")
            else:
                done += [(*key, digest.hexdigest())] if key else []
                key, digest = (depth, conv), hashlib.sha256()
            digest.update(ids.encode())
        if len(done) > IDS:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "ends"), x, strict=True)) for x in done])
            done = []
    done += [(*key, digest.hexdigest())] if key else []
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "ends"), x, strict=True)) for x in done])


def _ends(ended: DataFrame) -> DataFrame:
    """``(depth, conv_id, ends)``: the digest of the ids ``c`` of each node, in order; no task holds a node's ids at once."""
    part = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    parts = ended.groupBy("depth", "conv_id", F.expr(f"c div {IDS}").alias("part")).agg(part.alias("ids"))
    ordered = parts.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "part").select("depth", "conv_id", "ids")
    return ordered.mapInArrow(_digests, "depth bigint, conv_id bigint, ends string")


def trie(rows: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of turn sequences: rows ``(c, pos, tid, size)``, convs ``(c, len)``, turnless ones too. See conversation_trie.

    Each sequence gets a last turn 0. A bucket is a set of sequences with a common prefix, named by its depth and its smallest
    member. One round finds, for all large buckets at once, where their members first differ, emits the nodes up to there, and
    parts them by the turn that stands there. A bucket of one sequence is a path, whatever its length; those of ``local`` turns
    at most are finished in one task each.
    """
    spark, n = rows.sparkSession, convs.count()
    if not n:
        return spark.createDataFrame([], _NODE)
    root = convs.agg(F.min("c")).first()[0]
    total = rows.count() + n
    rows = join_counted(rows, convs.where("len > 0"), ["c"], "len").unionByName(convs.select("c", F.col("len").alias("pos"), F.lit(0).cast("bigint").alias("tid"), F.lit(0).cast("bigint").alias("size"), "len"))
    bucket = ["d", "b"]
    large = checkpoint(rows.select(F.lit(0).cast("bigint").alias("d"), F.lit(root).cast("bigint").alias("b"), F.lit(n).cast("bigint").alias("n"), F.lit(total).cast("bigint").alias("turns"), "c", "len", "pos", "tid", "size"))
    rounds, small, paths = [], [], []
    while True:
        small.append(large.where(f"n > 1 AND turns <= {local}"))
        paths.append(large.where("n = 1"))
        large = large.where(f"n > 1 AND turns > {local}")
        if large.isEmpty():
            break
        each = checkpoint(large.groupBy(*bucket, "n", "pos").agg(F.count("*").alias("k"), F.min("tid").alias("low"), F.max("tid").alias("high"), F.min("size").alias("size")))
        split = checkpoint(each.where("k < n OR low <> high OR low = 0").groupBy(*bucket).agg(F.min("pos").alias("l")))
        here = checkpoint(large.join(split, bucket).where("pos >= l"))
        at = here.where("pos = l")
        groups = checkpoint(at.groupBy(*bucket, "l", "tid").agg(F.count("*").alias("k"), F.min("c").alias("m"), F.sum(F.col("len") - F.col("l")).alias("left"), F.min("size").alias("size"), F.min("len").alias("len")))
        heirs = groups.where("tid <> 0").select(*bucket, "tid", "m", "k", "left")
        of = join_counted(at.select(*bucket, "tid", "c", "len", "l"), heirs, [*bucket, "tid"], "k").select("c", F.col("l") + 1, "m", "k", "left", F.col("len") - F.col("l")).toDF("c", "nd", "nb", "nn", "nt", "rest")
        next_ = join_counted(here.where("pos > l").select("c", "len", "pos", "tid", "size"), of, ["c"], "rest")
        large = checkpoint(next_.select(F.col("nd").alias("d"), F.col("nb").alias("b"), F.col("nn").alias("n"), F.col("nt").alias("turns"), "c", "len", "pos", "tid", "size"))
        ends = _ends(at.where("tid = 0").select(F.col("l").alias("depth"), F.col("b").alias("conv_id"), "c"))
        rounds.append((each, split, groups, ends))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    finished = union(small).select(*bucket, "c", "tid", "size", "pos").repartition(*bucket).sortWithinPartitions(*bucket, "c", "pos").drop("pos").mapInArrow(_buckets, _NODE)
    finished = checkpoint(finished)
    one = F.lit(1).cast("bigint")
    walked = union(paths).where("tid <> 0 AND pos >= d").select(
        (F.col("pos") + 1).alias("depth"), F.col("c").alias("conv_id"), F.col("c").alias("parent_conv_id"), one.alias("n_convs"), (F.col("pos") + 1 < F.col("len")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(F.col("pos") + 1 == F.col("len"), F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    result = [finished.where("parent_conv_id IS NOT NULL"), walked]
    key = ["depth", "conv_id"]
    info = ["n_children", "n_leaves", "below", "ends_sha256"]
    known = finished.where("parent_conv_id IS NULL").withColumnRenamed("saved_tokens", "below").select(*key, *info)
    for each, split, groups, ends in reversed(rounds):  # from the deepest buckets up
        groups = groups.where("tid <> 0").select((F.col("l") + 1).alias("depth"), F.col("m").alias("conv_id"), F.col("b").alias("parent_conv_id"), F.col("k").alias("n_convs"), "size", "len", "d", "l")
        alone = groups.where("n_convs = 1").select(
            *groups.columns, (F.col("len") > F.col("depth")).cast("bigint").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("bigint").alias("below"),
            F.when(F.col("len") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
        kids = checkpoint(groups.where("n_convs > 1").join(known, key).select(*alone.columns).unionByName(alone).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size") + F.col("below")))
        result.append(kids.select(*_COLUMNS))
        sums = kids.groupBy("d", F.col("parent_conv_id").alias("b")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        last = split.join(sums, bucket, "left").join(ends.select(F.col("depth").alias("l"), F.col("conv_id").alias("b"), "ends"), ["l", "b"], "left")
        # The nodes from the bucket's own to where it splits: all but the first come from this round.
        shared = each.join(split, bucket).where("pos < l").select(*bucket, "n", (F.col("pos") + 1).alias("depth"), ((F.col("n") - 1) * F.col("size")).alias("own"))
        tops = split.join(each.select(*bucket, "n").distinct(), bucket).select(*bucket, "n", F.col("d").alias("depth"), F.lit(0).cast("bigint").alias("own"))
        after = Window.partitionBy(*bucket).orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
        path = shared.unionByName(tops).withColumn("after", F.coalesce(F.sum("own").over(after), F.lit(0))).join(last, bucket)
        at_split = F.col("depth") == F.col("l")
        path = checkpoint(path.select(
            "d", "depth", F.col("b").alias("conv_id"), F.col("b").alias("parent_conv_id"), F.col("n").alias("n_convs"), "own",
            F.when(at_split, F.coalesce("children", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
            (F.col("after") + F.coalesce("below", F.lit(0))).cast("bigint").alias("below"), F.when(at_split, F.coalesce("ends", F.lit(_NO_ENDS))).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
        ))
        result.append(path.where("depth > d").withColumn("saved_tokens", F.col("own") + F.col("below")).select(*_COLUMNS))
        known = known.unionByName(path.where("depth = d").select(*key, *info))
    top = known.where("depth = 0").select(F.col("depth"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n).cast("bigint").alias("n_convs"), "n_children", "n_leaves", F.col("below").alias("saved_tokens"), "ends_sha256")
    if n == 1:
        turns = convs.first()["len"]
        digest = hashlib.sha256(str(root).encode()).hexdigest()
        top = spark.createDataFrame([(0, root, None, 1, min(turns, 1), 1, 0, _NO_ENDS if turns else digest)], _NODE)
    return union([*result, top])


def conversation_trie(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", edit: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, local: int = LOCAL) -> DataFrame:
    """One row per distinct prefix of turns (role, text) of conversations, from the empty one at depth 0.

    ``conv_id`` is the prefix's smallest conversation, ``parent_conv_id`` that of the prefix one turn shorter (root: NULL),
    ``n_convs`` the conversations that begin with it, ``n_children`` its extensions by a turn, ``n_leaves`` prefixes in its
    subtree without any, ``saved_tokens`` the bytes that sharing saves in its subtree, ``ends_sha256`` the digest of the
    conversations that end there. Turns are ordered as by encode_turns: NULL turns first, ties by digest, repeated rows are
    turns of their own; NULL roles and texts are empty; rows without an id go; ids are integers. Empty input: empty result.
    Other columns are not read. ``edit(rows, convs)`` may change the sequences before. Texts are hashed where they lie; only
    their numbers are sorted, so very long ones cost no more.
    """
    rows = encode_turns(convs, conv, turn, role, text)
    lengths = checkpoint(rows.groupBy("c").agg(F.count("*").alias("len")))
    if edit:
        rows, lengths = edit(rows, lengths)
    return trie(rows, lengths, local).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences as op12's contract rebuilds them: the first turns of a conversation come from the one whose id is the multiple of five below."""
    heads = rows.where("pos < 8 AND pmod(c, 5) = 0").select(F.col("c").alias("b"), "pos", "tid", "size")
    given = convs.select("c", "len", (F.col("c") - F.expr("pmod(c, 5)")).alias("b"), (F.crc32(F.col("c").cast("string").cast("binary")) % 9).alias("h"))
    bases = convs.select(F.col("c").alias("b"), F.col("len").alias("base")).where("pmod(b, 5) = 0")
    given = checkpoint(given.join(bases, "b", "left").withColumn("taken", F.least("h", F.coalesce("base", F.lit(0)))))
    taken = given.join(heads, "b").where("pos < h").select("c", "pos", "tid", "size")
    own = join_counted(rows, given.select("c", "h", "taken", "len"), ["c"], "len").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "size")
    lengths = given.select("c", (F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))
    return checkpoint(taken.unionByName(own)), checkpoint(lengths)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations. See conversation_trie."""
    return conversation_trie(table(spark, sf_dir, "conversations"), edit=rebuilt)
