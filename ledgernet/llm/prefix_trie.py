"""Prefix trie of conversations by ROLLUP over positional turn ids.

A turn's id is 16 bytes of the SHA-256 of (role, text) and its number of words.
A conversation becomes a row of columns ``t1 .. tW``, the ids of its first turns;
``GROUP BY prior, ROLLUP(t1, .., tW)`` aggregates all its prefixes together and
``grouping_id()`` tells their depth.  A conversation that goes on continues in
the next block of columns, in which ``prior`` is the key of the node that the
block before ended in.  A node of one conversation has but a chain below it, so
such a conversation leaves the blocks; the chain's rows are written as they are.
The number of blocks follows the longest prefix that two conversations share.

Sums over subtrees take the way back: a second ROLLUP over the *nodes* of a
block, from the last block to the first, each block's top handed to the node it
hangs from.  Both aggregate partially before the shuffle, so the root or a very
common first turn is no hot task.

Defined results: null role or text is empty; null turns come first, equal turns
stand in the order of their ids; repeated rows are turns each; rows without a
``conv_id`` belong to no conversation; an empty table has no nodes; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.places import places, write_out
from ledgernet.session import scratch_table

#: Turn columns of the first blocks; the last value holds for all that follow.
WIDTHS = (8, 16, 32)
#: Conversation ids of one joined text are those that agree in all but so many
#: low bits: at most 4096, as they differ.
ID_BITS = 12
#: Rebuilding: turns are taken from the conversation at the last multiple.
SHARED, HEADS = 20, 4

_WORD = "[^\\x20\\x09-\\x0D]+"
_ROOT = "00" * 16


def _digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, id`` of every row that has a ``conv_id``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(_WORD))), 8, "0"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(_digest(content), words).alias("id"))


def words_of(turn_id: Column) -> Column:
    return F.conv(F.hex(F.substring(turn_id, 17, 4)), 16, 10).cast("long")


def numbered(ids: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1), ``id``: turns in their order."""
    alike = ids.groupBy("conv_id", "turn", "id").agg(F.count(F.lit(1)).alias("copies"))
    placed = places(alike, ["conv_id"], ["turn", "id"], {"place": "copies"})
    return write_out(placed.withColumn("place", F.col("place") + 1), "copies", "place").select("conv_id", "place", "id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conversations: conv_id, length; turns: conv_id, place, id)`` of which
    the first ``h = crc32(conv_id) % 4`` turns are those of conversation
    ``conv_id - conv_id % 20`` and the others their own after the first h."""
    turns = scratch_table(turns)
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    of = F.col("conv_id") - F.col("conv_id") % SHARED
    heads = lengths.select(F.col("conv_id").alias("of"), F.least("n", F.lit(HEADS)).alias("there"))
    plan = scratch_table(
        lengths.select("conv_id", "n", h.alias("h"), of.alias("of")).join(heads, "of", "left")
        .select("conv_id", "of", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "n"))
    first = turns.where(F.col("place") < HEADS).select(F.col("conv_id").alias("of"), "place", "id")
    taken = (plan.where("taken > 0").select("conv_id", "of", "taken").join(first, "of").where("place <= taken")
             .select("conv_id", "place", "id"))
    own = (turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place > h")
           .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id"))
    conversations = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return conversations, scratch_table(own.unionByName(taken))


def _columns(width: int) -> list[str]:
    return [f"t{k}" for k in range(1, width + 1)]


def _key(width: int, depth: Column) -> Column:
    """Key of the node that the first ``depth`` turn columns lead to."""
    none = F.unhex(F.lit(""))
    parts = [F.when(F.lit(k) <= depth, F.coalesce(c, none)).otherwise(none) for k, c in enumerate(_columns(width), 1)]
    return F.when(depth <= 0, F.col("prior")).otherwise(_digest(F.concat("prior", *parts)))


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """``prior, t1 .., step`` and the aggregates of every prefix in ``rows``.
    A prefix is as long as its last turn column that isn't null; the longer
    groupings of a shorter row are none, and go before they are aggregated."""
    names = ", ".join(_columns(width))
    step = f"{width} - bit_count(grouping_id())"
    return rows.sparkSession.sql(
        f"SELECT prior, {names}, {step} AS step, {aggregates} FROM {{rows}} GROUP BY prior, ROLLUP({names}) "
        f"HAVING {step} = 0 OR get(array({names}), {step} - 1) IS NOT NULL", rows=rows)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's id texts, joined by commas, as they stream in."""
    now, state = None, hashlib.sha256()
    for b in batches:
        keys, found = [], []
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    found.append(state.hexdigest())
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends``; only texts of up to 4096 ids are built, in many tasks, and
    one task hashes those of a key in a stream."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    return (ends.groupBy("key", F.shiftright("conv_id", ID_BITS).alias("chunk")).agg(ids.alias("ids"))
            .repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids")
            .mapInArrow(_ends, "key binary, ends string"))


def prefix_trie(conversations: DataFrame, turns: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``conversations(conv_id, length)`` and ``turns(conv_id, place, id)`` (places
    from 1 without gaps) → a row per node: ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    empty, alone = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("conv_id").cast("string"), 256)
    state = conversations.select("conv_id", "length", F.unhex(F.lit(_ROOT)).alias("prior"))
    blocks, ends, tails, above, rest = [], None, None, 0, turns
    while True:
        width = widths[min(len(blocks), len(widths) - 1)]
        depth = above + width
        columns = _columns(width)
        here = (rest.where((F.col("place") > above) & (F.col("place") <= depth)).groupBy("conv_id")
                .agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("some")))
        rows = scratch_table(state.join(here, "conv_id", "left").select(
            "prior", "conv_id", "length", *[F.get("some", F.lit(k))["id"].alias(c) for k, c in enumerate(columns)]))
        found = _rollup(rows, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(length) AS longest")
        if blocks:
            found = found.where("step > 0")
        last = F.get(F.array(*columns), F.col("step") - 1)
        nodes = scratch_table(found.select(
            "prior", *columns, "step", "conv_id", "n_convs", (F.col("step") + above).cast("long").alias("depth"),
            _key(width, F.col("step")).alias("key"), _key(width, F.col("step") - 1).alias("up"),
            (F.col("longest") == F.col("step") + above).alias("leaf"),
            ((F.col("step") == width) & (F.col("n_convs") == 1) & (F.col("longest") > depth)).alias("chain"),
            ((F.col("n_convs") - 1) * F.coalesce(words_of(last), F.lit(0))).alias("saved")))
        blocks.append((width, nodes))
        done = rows.where(F.col("length") <= depth).select(
            _key(width, (F.col("length") - above).cast("int")).alias("key"), "conv_id")
        ends = done if ends is None else ends.unionByName(done)
        goes_on = rows.where(F.col("length") > depth).select(
            "conv_id", "length", _key(width, F.lit(width)).alias("prior"))
        if goes_on.isEmpty():
            break
        goes_on = scratch_table(goes_on.join(
            nodes.where(F.col("step") == width).select(F.col("key").alias("prior"), "n_convs"), "prior"))
        chains = (rest.where(F.col("place") > depth).join(
            goes_on.where("n_convs = 1").select("conv_id", "length"), "conv_id")
            .select("conv_id", F.col("place").cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"),
                    F.lit(1).cast("long").alias("n_convs"),
                    (F.col("place") < F.col("length")).cast("long").alias("n_children"),
                    F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                    F.when(F.col("place") < F.col("length"), empty).otherwise(alone).alias("ends_sha256")))
        tails = chains if tails is None else tails.unionByName(chains)
        state = goes_on.where("n_convs > 1").select("conv_id", "length", "prior")
        if state.isEmpty():
            break
        rest = scratch_table(rest.where(F.col("place") > depth).join(state.select("conv_id"), "conv_id", "left_semi"))
        above = depth

    # subtree sums, from the last block up; a block's top belongs to the block before
    below, sums = None, None
    for width, nodes in reversed(blocks):
        own = nodes.select("prior", *_columns(width), "key", (F.col("leaf") | F.col("chain")).cast("long").alias("leaves"),
                           "saved")
        if below is not None:
            own = own.join(below, "key", "left").withColumns({
                "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
                "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
        total = _rollup(own.drop("key"), width, "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens")
        total = scratch_table(total.select(_key(width, F.col("step")).alias("key"), "step", "n_leaves", "saved_tokens"))
        below = total.where("step = 0").select("key", F.col("n_leaves").alias("more_leaves"),
                                               F.col("saved_tokens").alias("more_saved"))
        # a later block's top is a node of the block before, which has it in its own sums
        kept = total if nodes is blocks[0][1] else total.where("step > 0")
        kept = kept.select("key", "n_leaves", "saved_tokens")
        sums = kept if sums is None else sums.unionByName(kept)

    parts = [n.select("key", "up", "depth", "conv_id", "n_convs", "chain") for _, n in blocks]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    children = nodes.where("depth > 0").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    trie = (nodes.join(sums, "key").join(children, "key", "left").join(_end_digests(ends), "key", "left")
            .select("up", "depth", "conv_id", "n_convs", "n_leaves", "saved_tokens",
                    F.coalesce("children", F.col("chain").cast("long")).alias("n_children"),
                    F.coalesce("ends", empty).alias("ends_sha256")))
    trie = trie.where("depth > 0").join(parents, "up").unionByName(
        trie.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    trie = trie.select(*out)
    return trie if tails is None else trie.unionByName(tails.select(*out))


def conversation_trie(conversations: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations(conv_id, turn,
    role, text)``."""
    return prefix_trie(*rebuilt(numbered(turn_ids(conversations))), widths)
