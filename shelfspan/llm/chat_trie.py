"""Chat formatting of conversations as prefix trees: shared turns are emitted once, depth first.

Method. Conversations that share their initial turns share a path of nodes. A tree holds all conversations with one first turn; its
nodes are emitted once each, depth first, as one sequence of characters. Each node carries where it begins in the sequence, the
position id of its first character (the characters of its ancestors; ids count on by one inside the node), and the attention
intervals: where its ancestors and itself stand in the sequence, which is all that its characters may attend to besides those
before them in the node. Ancestors that stand side by side make one interval, so a chain of first children needs one only. A
conversation is its last node.

Template. A turn is `<turn role>text</turn>` and a line feed. In roles and texts every backslash becomes `\\\\` and every `<`
becomes `\\l`, so no text can hold a mark, and reading back is exact. The loss mask covers the text of assistant turns.

At scale. Path hashes are made inside each conversation. A node's place is a running sum of lengths in the order of (tree, path): rows
are dealt out by range and sorted, summed in each partition, and each partition gets the sum of those before it in its tree,
so one tree may be spread over any number of tasks. Only one line per partition and tree meets in one place, and of those only the trees
that reach over a border of two partitions have more than one. Attention comes from one pass along each conversation: every node
belongs to one of the conversations that hold it, which gives it its intervals, so rows grow with the turns and not with turns times
ancestors. Reading back looks up the nodes inside an interval by blocks of `BLOCK` characters. Path hashes are the order of the nodes,
16 bytes for a turn and each turn before it.

Defined cases: null roles and texts are empty; turns are ordered by turn number (null first), then role and text; repeated rows are
turns like any other; null is a conversation of its own; equal conversations share all nodes. Extra columns are not looked at. A
conversation's own turns meet in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspan.llm.common import checkpointed, no_nulls

ASSISTANT = "assistant"
TURN = re.compile(r"<turn ([^<>]*)>([^<]*)</turn>\n")
BLOCK = 1024
UNESCAPE = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escaped_role(text: Column) -> Column:
    return F.replace(escaped(text), F.lit(">"), F.lit("\\g"))


def unescaped(text: str) -> str:
    return UNESCAPE.sub(lambda m: {"l": "<", "g": ">"}.get(m[1], m[1]), text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in TURN.finditer(formatted)]


def _paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, starts, node, formatted, loss_from, loss_to): one row per conversation and turn, path by path hash."""
    turn = F.struct(F.col("turn"), no_nulls(F.col("role")).alias("role"), no_nulls(F.col("text")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("<turn "), escaped_role(t["role"]), F.lit(">"), escaped(t["text"]), F.lit("</turn>\n")).alias("formatted"),
            (F.length(escaped_role(t["role"])) + 7).alias("head"),
            (t["role"] == ASSISTANT).alias("learnt"),
        ),
    )
    rows = whole.select("conv_id", shown.alias("turns"))
    schema = T.StructType(
        [
            rows.schema["conv_id"],
            T.StructField("depth", T.IntegerType()),
            T.StructField("path", T.ArrayType(T.BinaryType())),
            T.StructField("position", T.LongType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss_from", T.IntegerType()),
            T.StructField("loss_to", T.IntegerType()),
            T.StructField("last", T.BooleanType()),
        ]
    )

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                names = [n.name for n in schema.fields]
                out: dict[str, list] = {n: [] for n in names}
                for conv, turns in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    path, position = [], 0
                    for k, t in enumerate(turns):
                        text = t["formatted"]
                        path = [*path, hashlib.blake2b((path[-1] if path else b"") + text.encode(), digest_size=16).digest()]
                        from_, to = (t["head"], len(text) - 8) if t["learnt"] else (0, 0)
                        values = (conv, k, path, position, text, from_, to, k == len(turns) - 1)
                        for n, v in zip(names, values):
                            out[n].append(v)
                        position += len(text)
                kinds = [some.schema.field(0).type, pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names)

    return rows.mapInArrow(chained, schema)


def packed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the conversations.

    Nodes: tree, node, start, end (in the tree's sequence), position (id of the first character), formatted, loss_from, loss_to
    (in the node; equal if nothing is learnt), attention (array of struct(start, end): ancestors, those side by side as one, then
    the node itself).
    Conversations: conv_id, tree, node (the last one), attention.
    """
    turns = checkpointed(_paths(conversations))
    nodes = turns.groupBy("path").agg(
        F.min(F.struct("conv_id")).alias("owner"), *(F.first(c).alias(c) for c in ("position", "formatted", "loss_from", "loss_to"))
    )
    laid = nodes.select(
        F.get("path", F.lit(0)).alias("tree"), "path", "owner", "position", "formatted", "loss_from", "loss_to", F.length("formatted").cast("long").alias("size")
    )
    # Depth first: a path sorts after its own beginnings and before its parent's next child.
    ordered = laid.repartitionByRange("tree", "path").sortWithinPartitions("tree", "path").withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("before", T.LongType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, total = None, 0
        for batch in batches:
            before = []
            for t, size in zip(batch.column("tree").to_pylist(), batch.column("size").to_pylist()):
                if t != tree:
                    tree, total = t, 0
                before.append(total)
                total += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "before"])

    # Written as dealt out, so that the partitions' numbers hold.
    in_part = checkpointed(ordered.mapInArrow(summed, schema))
    sums = in_part.groupBy("tree", "part").agg(F.sum("size").alias("whole"))
    # Trees in one partition, nearly all, begin at 0; a tree over many has a line for each.
    broken = sums.groupBy("tree").agg(F.collect_list(F.struct("part", "whole")).alias("parts")).where(F.size("parts") > 1)
    bases = broken.select(
        F.col("tree").alias("broken_tree"),
        F.explode(
            F.transform(
                "parts",
                lambda p: F.struct(
                    p["part"].alias("part"),
                    F.aggregate("parts", F.lit(0).cast("long"), lambda s, o: s + F.when(o["part"] < p["part"], o["whole"]).otherwise(F.lit(0))).alias("base"),
                ),
            )
        ).alias("b"),
    ).select("broken_tree", F.col("b.part").alias("broken_part"), "b.base")
    placed = in_part.join(bases, (F.col("tree") == F.col("broken_tree")) & (F.col("part") == F.col("broken_part")), "left").select(
        "tree", "path", "owner", "position", "formatted", "loss_from", "loss_to", "size", (F.coalesce("base", F.lit(0)) + F.col("before")).alias("start")
    )
    node = F.element_at("path", -1)
    placed = checkpointed(placed.withColumn("node", node).withColumn("end", F.col("start") + F.col("size")))
    seen = checkpointed(_attention(turns, placed))
    own = seen.where("owned").select(F.col("node").alias("of"), "attention")
    columns = ["tree", "node", "start", "end", "position", "formatted", "loss_from", "loss_to", "attention"]
    whole = placed.join(own, F.col("node") == F.col("of")).select(*columns)
    return whole, seen.where("last").select("conv_id", "tree", "node", "attention")


def _attention(turns: DataFrame, placed: DataFrame) -> DataFrame:
    """(conv_id, tree, node, attention, owned, last): the nodes that a conversation gives their intervals, and its last node."""
    places = placed.select(F.col("node").alias("placed"), "tree", "start", "end", F.col("owner.conv_id").alias("owner"))
    steps = turns.select("conv_id", "depth", "last", F.element_at("path", -1).alias("node")).join(places, F.col("node") == F.col("placed"))
    step = F.struct("depth", "start", "end", "node", F.col("conv_id").eqNullSafe(F.col("owner")).alias("owned"), "last")
    chains = steps.groupBy("conv_id", "tree").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [("node", T.BinaryType()), ("attention", span), ("owned", T.BooleanType()), ("last", T.BooleanType())]
    schema = T.StructType([*chains.schema.fields[:2], *(T.StructField(n, kind) for n, kind in fields)])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.binary(), pa.binary(), spans, pa.bool_(), pa.bool_()]
            rows: list[tuple] = []
            for at in range(len(batch)):
                conv, tree, steps = (batch.column(c)[at].as_py() for c in range(3))
                above: list[tuple[int, int]] = []
                for k in steps:
                    mine = (k["start"], k["end"])
                    if k["owned"] or k["last"]:
                        rows.append((conv, tree, k["node"], [{"start": a, "end": b} for a, b in (*above, mine)], k["owned"], k["last"]))
                    if above and above[-1][1] == mine[0]:
                        above[-1] = (above[-1][0], mine[1])
                    else:
                        above.append(mine)
                    if len(rows) >= 1024:
                        yield _batch(rows, kinds, schema.names)
                        rows = []
            yield _batch(rows, kinds, schema.names)

    return chains.mapInArrow(walked, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)


def read_back(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation what its attention intervals show of the sequences: conv_id, turns (array of struct(role, text)),
    learnt (texts under the loss mask, put together), formatted_chars."""

    def block(place: Column) -> Column:
        return F.floor(place / BLOCK)

    parts = conversations.select("conv_id", F.col("tree").alias("of_tree"), F.explode("attention").alias("span")).select(
        "*", F.explode(F.sequence(block(F.col("span.start")), block(F.col("span.end") - 1))).alias("of_block")
    )
    pieces = nodes.select("tree", "start", "formatted", "loss_from", "loss_to", block(F.col("start")).alias("block"))
    inside = (F.col("start") >= F.col("span.start")) & (F.col("start") < F.col("span.end"))
    match = (F.col("of_tree") == F.col("tree")) & (F.col("of_block") == F.col("block")) & inside
    piece = F.struct("start", "formatted", "loss_from", "loss_to")
    rows = parts.join(pieces, match).groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType(
        [
            rows.schema["conv_id"],
            T.StructField("turns", T.ArrayType(turn)),
            T.StructField("learnt", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, learnt, sizes = [], [], []
            for pieces in batch.column("pieces").to_pylist():
                shown = "".join(p["formatted"] for p in pieces)
                turns.append([{"role": r, "text": t} for r, t in turns_of(shown)])
                learnt.append("".join(unescaped(p["formatted"][p["loss_from"] : p["loss_to"]]) for p in pieces))
                sizes.append(len(shown))
            columns = [
                batch.column("conv_id"),
                pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                pa.array(learnt, pa.string()),
                pa.array(sizes, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turns", "learnt", "formatted_chars"])

    return rows.mapInArrow(read, schema)
