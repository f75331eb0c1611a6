"""A trie over the turns of conversations, by fixed-length blocks of turns.

Each conversation is cut into blocks of a fixed number of turns. Conversations are grouped by their successive block digests
first: a block's key is the sum of the digests of all blocks up to it, so that equal keys are equal beginnings and no
level waits for the one before. Turn boundaries are refined only inside blocks where siblings diverge: of the distinct blocks after one
beginning, a single one is a chain of turns with the block's own members, and only where there are several are their
beginnings grouped turn by turn. What a subtree holds is summed over its members, each with its own share, so that no level
waits for the one below either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_schema, batch_of, join_facts, rows_of, running_sums, written

BLOCK_TURNS = 4
#: A key is four sums of 36 bits each. A conversation may have 2^27 blocks before a sum leaves its long, which is an error.
LANES, LANE_BITS = "abcd", 36
#: Ids that are joined to one text before they are hashed.
CHUNK_IDS = 16_384


def _root() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(c) for c in LANES])


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_bytes): turns by content; role and text without their nulls. A row without conv_id belongs to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return out.where("conv_id is not null")


def numbered(turns: DataFrame) -> DataFrame:
    """digested() rows with `pos`, from 1, in place of turn: nulls first, equal turns by digest. A long conversation may lie over many ranges."""
    return running_sums(turns.withColumn("pos", F.lit(1).cast("long")), ["conv_id"], [F.asc_nulls_first("turn"), F.col("digest")], ["pos"], "trie-turns").drop("turn")


def _lanes(*of: Column) -> Column:
    return F.struct(*[F.xxhash64(F.lit(i), *of).bitwiseAND(F.lit(2**LANE_BITS - 1)).alias(c) for i, c in enumerate(LANES)])


def _plus(x: Column, y: Column, sign: int = 1) -> Column:
    return F.struct(*[(x[c] + sign * y[c]).alias(c) for c in LANES])


def blocks_of(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, block, prev, key, steps): key after the block, prev before it, steps the (key share, bytes) after each of its turns."""
    at = F.col("pos") - 1
    cut = turns.withColumn("block", F.floor(at / block_turns)).groupBy("conv_id", "block")
    rows = cut.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("own"))
    digests = F.transform("own", lambda t: t["digest"])
    step = lambda t, i: F.struct(_lanes(F.col("block"), i, F.slice(digests, F.lit(1), i + 1)).alias("share"), t["n_bytes"].alias("n_bytes"))
    rows = rows.select("conv_id", "block", F.transform("own", step).alias("steps"))
    rows = rows.select("*", *[F.element_at("steps", -1)["share"][c].alias(c) for c in LANES])
    summed = running_sums(rows, ["conv_id"], [F.col("block")], [*LANES], "trie-blocks")
    key = F.struct(*LANES)
    return summed.select("conv_id", "block", _plus(key, F.element_at("steps", -1)["share"], -1).alias("prev"), key.alias("key"), "steps")


def _refined(rows: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    """Nodes of turns from exploded blocks: a block alone after its beginning has them as they are, others are grouped by what begins alike."""
    told = [str(s) for s in by]
    alone = rows.where("alone").select(*told, *[c for c in rows.columns if c not in {*told, "alone", "block_key"}])
    return alone.unionByName(rows.where("NOT alone").groupBy(*told).agg(*sums).select(*alone.columns))


def _ends(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """(key, ends_sha256): of the members that end at a node, ids ascending. Ids meet in ranges first, so that only chunks of text are put together per node."""
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("block", "key")).alias("last")).select("conv_id", F.col("last.key").alias("key"))
    turnless = members.join(last, "conv_id", "left_anti").select("conv_id", _root().alias("key"))
    flat = [F.col(f"key.{c}").alias(c) for c in LANES]
    ids = last.unionByName(turnless).select(*flat, "conv_id").repartitionByRange(*LANES, "conv_id").sortWithinPartitions(*LANES, "conv_id")
    chunk = "a long, b long, c long, d long, first long, ids string"
    told = "a long, b long, c long, d long, ends_sha256 string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, out = None, [], []
        for batch in batches:
            for *k, conv in rows_of(batch):
                if k != key or len(own) == CHUNK_IDS:
                    if own:
                        out.append((*key, own[0], ",".join(map(str, own))))
                    key, own = k, []
                own.append(conv)
            if len(out) > 1000:
                yield batch_of(out, arrow_schema(chunk))
                out = []
        yield batch_of(out + ([(*key, own[0], ",".join(map(str, own)))] if own else []), arrow_schema(chunk))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *k, _, text in rows_of(batch):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
            yield batch_of(out, arrow_schema(told))
            out = []
        if key is not None:
            yield batch_of([(*key, state.hexdigest())], arrow_schema(told))

    chunks = ids.mapInArrow(joined, chunk)
    return chunks.repartition(*LANES).sortWithinPartitions(*LANES, "first").mapInArrow(hashed, told).select(F.struct(*LANES).alias("key"), "ends_sha256")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, *, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each node: a distinct sequence of the first d turns of a conversation; the root has none.

    turns: conv_id, turn, digest, n_bytes, see digested(). members: conv_id of all conversations, those without turns too; by default those of turns.
    Turns are ordered by `turn`, a null first, equal ones by digest; repeated rows are turns of their own. A conversation without turns is a member of
    the root. A null conv_id belongs to no conversation. Texts are compared whole, by digest. An empty table has no node, not even a root.
    Columns beside those named are ignored. Memory of a task: ranges of narrow rows; a conversation or a node with a large share of all rows
    lies over many ranges.
    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens long and ends_sha256 string.
    """
    members = turns.select("conv_id") if members is None else members.select(F.col("conv_id").cast("long").alias("conv_id"))
    members = written(members.where("conv_id is not null").distinct(), "trie-members")
    blocks = blocks_of(numbered(turns.select("conv_id", "turn", "digest", "n_bytes")), block_turns)

    distinct = written(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.first("block").alias("block"), F.first("prev").alias("prev"), F.first("steps").alias("steps")), "trie-distinct")
    single = distinct.groupBy("prev").agg(F.count(F.lit(1)).alias("siblings"), F.min("key").alias("key")).where("siblings = 1").select("key", F.lit(True).alias("alone"))
    known = distinct.join(single, "key", "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    exploded = known.select(F.col("key").alias("block_key"), "alone", "n", "m", "block", "prev", "steps", F.posexplode("steps").alias("i", "step"))
    before = F.when(F.col("i") > 0, _plus(F.col("prev"), F.element_at("steps", F.greatest(F.col("i"), F.lit(1)))["share"])).otherwise(F.col("prev"))
    turns_in = written(exploded.select("block_key", "alone", _plus(F.col("prev"), F.col("step.share")).alias("key"), before.alias("parent"), (F.col("block") * block_turns + F.col("i") + 1).alias("depth"), F.col("step.n_bytes").alias("n_bytes"), "n", "m"), "trie-inside")
    nodes = written(_refined(turns_in, ["key", "parent", "depth", "n_bytes"], F.sum("n").alias("n"), F.min("m").alias("m")).withColumn("w", (F.col("n") - 1) * F.col("n_bytes")), "trie-nodes")

    children = written(nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    leaves = nodes.join(children, "key", "left_anti").select(F.col("m").alias("conv_id"), F.lit(1).alias("leaf"), F.lit(0).alias("w"))
    shares = leaves.unionByName(nodes.where("w > 0").select(F.col("m").alias("conv_id"), F.lit(0).alias("leaf"), "w"))
    shares = written(shares.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("w").alias("share")), "trie-shares")

    # what a node's members bring: their leaves, and what the nodes whose smallest member they are save
    lengths = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    brought = join_facts(blocks.select("conv_id", "key"), shares, "conv_id", lengths).groupBy(F.col("key").alias("block_key")).agg(F.sum("leaf").alias("leaf"), F.sum("share").alias("share"))
    sums = turns_in.select("block_key", "alone", "key").join(brought, "block_key")
    sums = _refined(sums, ["key"], F.sum("leaf").alias("leaf"), F.sum("share").alias("share"))

    # of its own smallest member, a node takes only what lies at its depth or below
    own = running_sums(nodes.select("key", "parent", "depth", "n", "m", F.col("w").alias("up_to"), "w"), ["m"], [F.col("depth")], ["up_to"], "trie-own")
    ends = written(_ends(blocks, members), "trie-ends")
    smallest = written(members.agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 0").withColumn("key", _root()), "trie-root")
    whole = shares.agg(F.sum("leaf").alias("leaf"), F.sum("share").alias("saved")).withColumn("key", _root())
    told = lambda leaf, saved: [
        F.col("m").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "n", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        leaf.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    ]
    firsts = nodes.select(F.col("key").alias("parent"), F.col("m").alias("parent_conv_id")).unionByName(smallest.select(F.col("key").alias("parent"), F.col("m").alias("parent_conv_id")))
    below = own.join(sums, "key").join(children, "key", "left").join(ends, "key", "left").select("parent", *told(F.col("leaf"), F.col("share") - F.col("up_to") + F.col("w")))
    below = join_facts(below, firsts, "parent", children.select(F.col("key").alias("parent"), F.col("n_children").alias("n")))
    root = smallest.withColumn("depth", F.lit(0)).join(children, "key", "left").join(whole, "key", "left").join(ends, "key", "left")
    root = root.select(*told(F.greatest("leaf", F.lit(1)), F.coalesce("saved", F.lit(0)))).withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return root.select(*out).unionByName(below.select(*out))
