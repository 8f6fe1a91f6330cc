"""The prefix trie of conversations, by hashing blocks of turns first and single turns only where blocks diverge.

A prefix of d turns is named by the sum of its turns' 128-bit digests, each mixed with its place, so names come from
running sums and no conversation is held whole. Turns are put together in blocks of a fixed number. Conversations are
first grouped by whole blocks: those with one block at one prefix are one row from there on. A prefix that a single block
follows doesn't branch inside that block, and all its turns are nodes with the same members. Where different blocks
follow one prefix, siblings diverge somewhere inside, and only there the blocks (not the conversations) are grouped again
turn by turn.

Sums over subtrees need no walk along the tree. Every node is represented by its least member, and a conversation
represents the nodes of its own path from some depth on. So what the nodes of a subtree add up to is what its members
represent in all, less what the node's own representative represents above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .running import running, wrapping_sum
from .textkit import mix

#: Turns of a block.
BLOCK = 4
NODE = ["depth", "p", "r"]
NONE = hashlib.sha256(b"").hexdigest()
TURN = "struct<depth:bigint,q:bigint,s:bigint,p:bigint,r:bigint,words:bigint>"


def _numbers(df: DataFrame) -> DataFrame:
    """(conv, at, digest, words): ``at`` is the number of each turn in its conversation from 1 on, by (turn, role, digest), a null turn first."""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    counted = running(df.withColumn("one", F.lit(1).cast("long")), "conv", order, {"before": "one"}, ["conv", "digest", "words", "one"])
    return counted.select("conv", (F.col("before") + 1).alias("at"), "digest", "words")


def _mixed(digest: pd.Series, depth: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each turn that depend on its digest and place."""
    halves = np.frombuffer(b"".join(digest), dtype="<u8").reshape(-1, 2).astype(np.uint64)
    place = mix(depth.to_numpy().astype(np.uint64))
    first = mix(mix(halves[:, 0] ^ place) + halves[:, 1])
    return first.view(np.int64), mix(mix(halves[:, 1] + place) ^ first).view(np.int64)


def _with_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        p, r = _mixed(b["digest"], b["depth"]) if len(b) else (np.zeros(0, np.int64),) * 2
        yield pd.DataFrame({"conv": b["conv"], "depth": b["depth"], "words": b["words"], "x": p, "y": r})


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, words): null role and text are empty; rows without a conversation are left out."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv is not null")
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return own.select("conv", "turn", "role", F.unhex(F.md5(both)).alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(turns: DataFrame, family: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, words) of the rebuilt conversations, and (conv) of all, turnless ones too.

    Conversation c starts with the first h turns of conversation c - c % ``family`` and goes on with its own turns after
    its first h, where h is crc32 of c's decimal digits modulo ``modulus``.
    """
    placed = common.staged(_numbers(turns), "turns")
    sizes = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))
    all_ = sizes.select("conv", "n", h(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    base_n = sizes.select(F.col("conv").alias("base"), F.least("n", F.lit(modulus)).alias("base_n"))
    convs = common.staged(all_.join(base_n, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    heads = placed.where((F.col("at") < modulus) & (F.col("conv") % family == 0)).select(F.col("conv").alias("base"), "at", "digest", "words")
    first = convs.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where("at <= taken").select("conv", F.col("at").alias("depth"), "digest", "words")
    rest = placed.join(convs.select("conv", "h", "taken"), "conv").where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words")
    return first.unionByName(rest), convs.select("conv")


def _blocks(turns: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """(conv, block, turns): the turns of each block in order, each with the name (q, s) of the prefix before and (p, r) of the one up to it; block 0 is the root."""
    numbered = turns.mapInPandas(_with_numbers, "conv long, depth long, words long, x long, y long")
    named = running(numbered, "conv", [F.asc("depth")], {"q": "x", "s": "y"}, ["conv", "depth", "words", "x", "y"])
    after = lambda before, x: wrapping_sum(F.col(before), F.col(x))
    turn = F.struct("depth", "q", "s", after("q", "x").alias("p"), after("s", "y").alias("r"), "words")
    inner = named.select("conv", F.floor((F.col("depth") - 1) / size + 1).cast("long").alias("block"), turn.cast(TURN).alias("t")).groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))  # ``size`` turns at most
    root = F.expr(f"array(cast(named_struct('depth', 0L, 'q', 0L, 's', 0L, 'p', 0L, 'r', 0L, 'words', 0L) as {TURN}))")
    return inner.unionByName(convs.select("conv", F.lit(0).cast("long").alias("block"), root.alias("turns")))


def _grouped(distinct: DataFrame, sums: list[str], least: str | None) -> DataFrame:
    """Nodes of distinct blocks (block, turns, sums ...): the sums over the blocks through each node, and the least ``least``."""
    values = [*sums, *([least] if least else [])]
    start = distinct.withColumn("q", F.col("turns")[0]["q"]).withColumn("s", F.col("turns")[0]["s"])
    parent = ["block", "q", "s"]
    kids = start.groupBy(*parent).agg(F.count(F.lit(1)).alias("kids"), F.min(F.struct("turns", *values)).alias("only"))
    kids = common.staged(kids.where("kids = 1").select(*parent, "only.*"), "single blocks")
    unbranched = kids.select(F.explode("turns").alias("t"), *values)
    # siblings diverge: turn by turn, sums of blocks before the shuffle. A prefix that many blocks follow may be split, as the other side has it once
    open_ = start.join(kids.select(*parent), parent, "left_anti")
    aggregates = [F.sum(c).alias(c) for c in sums] + ([F.min(least).alias(least)] if least else [])
    refined = open_.select(F.explode("turns").alias("t"), *values).groupBy("t").agg(*aggregates)
    return unbranched.unionByName(refined).select("t.*", *values)


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, p, r, ends_sha256) of the nodes where conversations end; ids pass one by one, so none of a node's list is held."""
    n = common.partitions(ends)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for b in batches:
            out = []
            if len(b):
                key = b[NODE].to_numpy()
                cut = np.append(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))), len(b))
                ids = b["conv"].astype(str).to_numpy()
                for i, j in zip(cut[:-1], cut[1:]):
                    node, text = tuple(int(x) for x in key[i]), ",".join(ids[i:j]).encode()
                    if node == at:
                        digest.update(b"," + text)
                        continue
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(text)
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    return ends.repartition(n, *NODE).sortWithinPartitions(*NODE, "conv").mapInPandas(run, "depth long, p long, r long, ends_sha256 string")


def trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A node of depth d is a distinct sequence of the first d turns (role, text) of rebuilt conversations (see ``rebuilt``);
    the root has depth 0. Its members are the conversations that start with it; ``conv_id`` is the least of them. Subtrees
    include their top; a leaf has no children; ``saved_tokens`` adds up (members - 1) times the words of the last turn
    over the subtree; ``ends_sha256`` is the digest of the ids, ascending and comma-joined, of members that end there.

    Nulls: a null role or text counts as empty, a null turn comes first; turns that tie are in order of role and then of a
    digest of role and text, so rows that repeat are turns of their own, one after the other. Rows whose conv_id is null belong
    to no conversation and are left out. A conversation without turns after rebuilding ends at the root. An empty table
    has no nodes, nor a root; extra columns are not read. Texts are counted and digested where they are; only digests move.
    """
    common.short_batches(conversations.sparkSession)
    turns, convs = rebuilt(turns_of(conversations))
    blocks = common.staged(_blocks(turns, convs, size), "blocks")
    distinct = blocks.groupBy("block", "turns").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    nodes = common.staged(_grouped(common.staged(distinct, "distinct blocks"), ["n_convs"], "conv_id"), "nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q").alias("p"), F.col("s").alias("r")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = common.staged(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # what each conversation represents: tokens saved at its nodes, above a node and in all, and its leaf
    saved = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    above = common.staged(running(saved.withColumn("conv", F.col("conv_id")), "conv", [F.asc("depth")], {"above": "own"}, ["conv", *nodes.columns, "own", "leaf"]), "saved")
    per_conv = above.groupBy("conv").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    of_block = blocks.join(per_conv, "conv").groupBy("block", "turns").agg(F.sum("own").alias("all_saved"), F.sum("leaf").alias("n_leaves"))
    sums = _grouped(common.staged(of_block, "sums of blocks"), ["all_saved", "n_leaves"], None).select(*NODE, "all_saved", "n_leaves")

    last = blocks.select("conv", F.element_at("turns", -1).alias("t")).groupBy("conv").agg(F.max("t").alias("t")).select("conv", "t.depth", "t.p", "t.r")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("q"), F.col("r").alias("s"), F.col("conv_id").alias("parent_conv_id"))
    full = above.join(sums, NODE).join(_ends(last), NODE, "left").join(parents, ["depth", "q", "s"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
