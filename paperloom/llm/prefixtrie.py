"""Trie of conversation prefixes: whole sequences collapse first, then weighted prefixes are summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import settle

#: A conversation takes at most so many turns from the first of its FAMILY.
HEAD, FAMILY = 8, 5
#: A node: its depth and 128 bits over its turns.
NODE = ["depth", "x", "y"]


def _shared(conv_id: str) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return F.expr(f"crc32(CAST({conv_id} AS STRING)) % {HEAD + 1}")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, depth, said, size): the turns of every rebuilt conversation, from depth 1, and a row at depth 0.

    Conversation c starts with the first h turns of conversation c - c % 5 (all if fewer, none
    if that one is absent) and goes on with its own turns after its first h, if any, h =
    crc32(c) % 9; remainders are at least 0. Turns are ordered by ``turn``, NULL first, ties by role, then by the MD5 of role
    and text. ``said`` stands for role and text (MD5), ``size`` is the text's UTF-8 length.

    NULL role or text counts as empty; rows with NULL conv_id belong to no conversation.
    Families are dealt out once, as short rows: 16 bytes stand for a turn's role and text. The
    turns of one conversation are numbered in one task, by a sort that spills.
    """
    told = conversations.select(
        F.col("conv_id").cast("long").alias("own"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("own IS NOT NULL")
    short = told.select(
        F.expr(f"own - pmod(own, {FAMILY})").alias("family"),
        "own",
        "turn",
        "role",
        F.expr("unhex(md5(concat(char_length(role), ':', role, text)))").alias("said"),
        F.octet_length("text").cast("long").alias("size"),
    ).repartition("family")
    family = Window.partitionBy("family")
    placed = short.withColumn("place", F.row_number().over(Window.partitionBy("family", "own").orderBy(F.asc_nulls_first("turn"), "role", "said")))
    placed = placed.withColumn("head", F.max(F.when(F.col("own") == F.col("family"), F.col("place")).otherwise(0)).over(family))
    placed = placed.withColumn("members", F.collect_set("own").over(family))  # FAMILY ids at most
    placed = placed.withColumn("shared", _shared("own"))
    places = F.expr(
        f"""concat(
            if(place = 1, array(struct(own AS conv_id, 0 AS depth)), array()),
            if(place > shared, array(struct(own AS conv_id, CAST(place - shared + least(shared, head) AS INT) AS depth)), array()),
            if(own = family AND place <= {HEAD},
               transform(filter(members, c -> crc32(CAST(c AS STRING)) % {HEAD + 1} >= place), c -> struct(c AS conv_id, place AS depth)),
               array()))"""
    )
    spread = placed.select("family", F.inline(places), "said", "size")
    return spread.select(
        "family",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.col("said")).alias("said"),
        F.when(F.col("depth") > 0, F.col("size")).otherwise(0).alias("size"),
    )


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, size, last): the node of each turn, the node above it, and whether it ends.

    A node's 128 bits are the exclusive or of two hashes of place and turn over its turns.
    """
    along = Window.partitionBy("family", "conv_id").orderBy("depth")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = turns.withColumn("hx", F.when(F.col("depth") > 0, F.xxhash64("depth", "said")).otherwise(0))
    here = here.withColumn("hy", F.when(F.col("depth") > 0, F.xxhash64(F.lit("second"), "depth", "said")).otherwise(0))
    here = here.withColumn("x", F.bit_xor("hx").over(so_far)).withColumn("y", F.bit_xor("hy").over(so_far))
    here = here.withColumn("last", F.lead("depth").over(along).isNull())
    return here.select("conv_id", "depth", "x", "y", F.expr("x ^ hx").alias("px"), F.expr("y ^ hy").alias("py"), "size", "last")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of ``ends(depth, x, y, conv_id)``: SHA-256 of the sorted ids, comma-joined.

    Ids are hashed as they stream by in order; a node with very many ends takes no more memory.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for frame in frames:
            keys = np.stack([frame.column(c).to_numpy() for c in NODE], axis=1)
            ids = frame.column("conv_id").to_pylist()
            if not len(ids):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(keys[a].tolist())
                if own == node:
                    state.update(b",")
                else:
                    if state:
                        done.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                state.update(",".join(map(str, ids[a:b])).encode())
            yield rows(done)
        if state:
            yield rows([(*node, state.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(columns)], [*NODE, "ends_sha256"])

    sorted_ = ends.repartition("x", "y").sortWithinPartitions(*NODE, "conv_id")
    return sorted_.mapInArrow(batches, "depth long, x long, y long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns(family, conv_id, depth, said, size)``.

    A node is a distinct sequence of the first ``depth`` turns of a conversation, from the
    root (depth 0); conversations that start with it are its members. Columns: conv_id (smallest
    member), depth, parent_conv_id (the parent's conv_id, NULL for the root), n_convs, n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree,
    (n_convs - 1) times the size of the last turn) and ends_sha256 (ids of the members that
    end at the node, ascending, comma-joined). ``turns`` has a row at depth 0 for every
    conversation, so one without turns is a member of the root. No conversations give no nodes.

    Equal conversations collapse to one sequence with its weight, smallest id and ends. Those
    that are prefixes of others are dropped by an anti-join, which leaves the leaves. Each
    prefix of a sequence then adds the sequence's weight to its node. A node is counted for
    the sequence of its smallest member, so along a sequence the nodes it counts for are its last
    ones, and what they save, summed from the end, is what the sequence adds to each node above:
    no pairs of nodes are formed. Sums are built before they are shuffled; joins on a
    hot node can be split, as the other side has one row a node.
    """
    paths = settle(_paths(turns), "paths")
    ends = paths.where("last").select(*NODE, "conv_id")
    sequences = ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    proper = paths.where("NOT last").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    weighted = sequences.select("conv_id", "weight").join(leaves, "conv_id", "left").select("conv_id", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    prefixes = settle(paths.drop("last").join(weighted, "conv_id"), "prefixes")
    nodes = settle(
        prefixes.groupBy(*NODE).agg(
            F.sum("weight").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.sum("leaf").alias("n_leaves"),
            F.first("px").alias("px"),
            F.first("py").alias("py"),
            F.first("size").alias("size"),
        ),
        "nodes",
    )
    counted = nodes.select("conv_id", "depth", F.expr("(n_convs - 1) * size").alias("saves"))
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = prefixes.select("conv_id", *NODE).join(counted, ["conv_id", "depth"], "left")
    saved = along.select(*NODE, F.sum(F.coalesce("saves", F.lit(0))).over(from_end).alias("saved"))
    child = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    blank = {"saved": F.lit(None).cast("long"), "child": F.lit(None).cast("long"), "ends": F.lit(None).cast("string")}
    parts = [saved.withColumns(blank | {"saved": F.col("saved")}), child.withColumns(blank | {"child": F.lit(1).cast("long")}), _end_digests(ends).withColumns(blank | {"ends": F.col("ends_sha256")})]
    sums = None
    for part in parts:
        part = part.select(*NODE, *blank)
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("child").alias("n_children"), F.max("ends").alias("ends"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, NODE)
        .join(above, ["depth", "px", "py"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
