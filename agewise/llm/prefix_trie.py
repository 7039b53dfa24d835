"""A trie of conversations: blocks of turns are grouped by their digests, and turn boundaries found inside blocks that differ from a sibling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agewise.llm.common import materialise, need
from agewise.llm.mixing import word_count

#: Turns of a block.
BLOCK = 4
#: Hexadecimal digits of a digest.
HEX = 64
#: Ids of one chunk of a list of members at most.
IDS = 4096


def turn_digests(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, place, digest, words): every turn as the SHA-256 of its role and text and the number of its words; texts go no further.

    Turns stand by ``turn_col``, null first, equal ones by role and digest; ``place`` counts from 1 and ``part`` is 1. Null roles and texts are
    empty. Rows without an id belong to no conversation.
    """
    need(turns, [conv_col, turn_col, role_col, text_col])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), word_count(text).alias("words")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    return rows.select("conv_id", F.lit(1).alias("part"), place.alias("place"), "digest", "words")


def graft(digests: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are replaced: the first h of a conversation give way to the first h of conversation
    ``conv_id - conv_id % every`` (all it has if fewer, none if it is absent), h being crc32 of the decimal id modulo ``most``. Replaced
    turns have part 0. An id's host has at most ``every`` guests, each of fewer than ``most`` turns, so the join multiplies nothing else."""
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % most
    ids = digests.select("conv_id").distinct().select("conv_id", (c - c % every).alias("host"), h.alias("h")).where(F.col("h") > 0)
    hosts = digests.where((c % every == 0) & (F.col("place") < most)).select(c.alias("host"), "place", "digest", "words")
    taken = ids.join(hosts, "host").where(F.col("place") <= F.col("h")).select("conv_id", F.lit(0).alias("part"), "place", "digest", "words")
    return digests.where(F.col("place") > h).unionByName(taken)


def _key(prefix: str, digests: list[str]) -> str:
    return hashlib.sha256((prefix + "".join(digests)).encode()).hexdigest() if digests else prefix


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted turns of whole conversations, each ended by a row without a digest, as blocks; holds one block and one batch."""
    prefix, k, digests, words = "", 0, [], []
    for part in parts:
        out = []
        for conv, digest, n in zip(part["conv_id"], part["digest"], part["words"], strict=True):
            if digest is None:
                out.append((conv, k, prefix, _key(prefix, digests), "".join(digests), words, True))
                prefix, k, digests, words = "", 0, [], []
                continue
            if len(digests) == BLOCK:
                chain = _key(prefix, digests)
                out.append((conv, k, prefix, chain, "".join(digests), words, False))
                prefix, k, digests, words = chain, k + 1, [], []
            digests.append(digest)
            words.append(int(n))
        yield pd.DataFrame(out, columns=["conv_id", "k", "prefix", "chain", "digests", "words", "last"])


def conversation_blocks(digests: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, k, prefix, chain, digests, words, last): the k-th block of ``BLOCK`` turns, with the digest of all turns before it and of
    all turns up to its end. Every conversation of ``ids`` has a last block, an empty one if it has no turns."""
    end = ids.select("conv_id", F.lit(2).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("words"))
    rows = digests.unionByName(end).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    schema = "conv_id long, k int, prefix string, chain string, digests string, words array<long>, last boolean"
    return rows.select("conv_id", "digest", "words").mapInPandas(_blocks, schema)


def _steps(blocks: DataFrame) -> DataFrame:
    """(chain, key, parent, depth, words, n, low, alone): the turn boundaries of every distinct block, the root's among them; ``alone`` if no
    other block follows the same turns, so that all who come by it pass each of its boundaries."""
    same = blocks.groupBy("prefix", "chain", "k", "digests", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    same = materialise(same, "distinct-blocks")
    siblings = same.groupBy("prefix").agg(F.count("*").alias("siblings"))

    def key(j: Column) -> Column:
        return F.when(j == F.size("words"), F.col("chain")).when(j == 0, F.col("prefix")).otherwise(F.sha2(F.concat("prefix", F.substring("digests", F.lit(1), j * HEX)), 256))

    from_ = F.when(F.col("k") == 0, 0).otherwise(1)
    each = same.join(siblings, "prefix").select("*", F.explode(F.sequence(from_, F.size("words"))).alias("j"))
    j = F.col("j")
    return each.select(
        "chain", key(j).alias("key"), F.when(j > 0, key(j - 1)).alias("parent"), (F.col("k").cast("long") * BLOCK + j).alias("depth"),
        F.coalesce(F.get("words", j - 1), F.lit(0)).alias("words"), "n", "low", (F.col("siblings") == 1).alias("alone"),
    )


def _ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of ids, sorted by node, as a hash for each node; holds a hash, never a list."""
    key, state = None, None
    for part in parts:
        out = []
        for k, chunk in zip(part["key"], part["chunk"], strict=True):
            if k == key:
                state.update(b"," + chunk.encode())
            else:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(chunk.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def member_hashes(blocks: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending ids, comma-joined, of those who end at each node. Ids meet by ranges of ``IDS``
    first, so that the task of a node that very many share reads few rows; the hash itself can only be taken in order."""
    ends = blocks.where("last").select(F.col("chain").alias("key"), "conv_id", F.expr(f"conv_id div {IDS}").alias("range"))
    chunks = ends.groupBy("key", "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("chunk"))
    return chunks.repartition("key").sortWithinPartitions("key", "range").select("key", "chunk").mapInPandas(_ends, "key string, ends_sha256 string")


def build_trie(digests: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    ``digests`` are turns as :func:`turn_digests` gives them, ``ids`` all conversations, those without turns too. A node is a distinct
    sequence of first turns, known by its smallest member and its depth. Conversations are grouped by their successive blocks; a block
    without a sibling has the same members at each of its boundaries, and only the others are taken apart turn by turn and grouped again.

    Sums over subtrees need no walk: every node belongs to its smallest member, whose nodes are one way down to its end. What lies
    below a node is all that its members own, less what the smallest one owns above it.

    An empty table has no nodes, not even a root. A conversation's turns are sorted in one task (digests, not texts).
    """
    blocks = materialise(conversation_blocks(digests, ids), "blocks")
    steps = materialise(_steps(blocks), "steps")
    known = ["key", "parent", "depth", "words"]
    apart = steps.where(~F.col("alone")).groupBy(*known).agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    nodes = steps.where("alone").select(*known, "n", "low").unionByName(apart)
    nodes = materialise(nodes, "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").na.fill(0, ["n_children"])
    nodes = materialise(nodes.select("*", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("saved")), "nodes")

    owned = nodes.groupBy(F.col("low").alias("conv_id")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    passed = blocks.select("conv_id", "chain").join(owned, "conv_id").groupBy("chain").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    below = steps.select("chain", "key", "alone").join(passed, "chain")
    below = below.where("alone").select("key", "leaf", "saved").unionByName(below.where(~F.col("alone")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")))
    below = below.select("key", F.col("leaf").alias("all_leaves"), F.col("saved").alias("all_saved"))

    above = Window.partitionBy("low").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.select("*", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("leaf", "saved")])
    parents = nodes.select(F.col("key").alias("parent"), F.col("low").alias("parent_conv_id"))
    found = placed.join(below, "key").join(member_hashes(blocks), "key", "left").join(parents, "parent", "left")
    return found.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (F.col("all_leaves") - F.col("leaf_above")).alias("n_leaves"), (F.col("all_saved") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, *, grafted: bool = False, **columns: str) -> DataFrame:
    """:func:`build_trie` of conversations given as rows (conv_id, turn, role, text); ``grafted``: after :func:`graft`. Repeated rows are turns
    of their own; other columns aren't read."""
    digests = materialise(turn_digests(turns, **columns), "digests")
    return build_trie(graft(digests) if grafted else digests, digests.select("conv_id").distinct())
