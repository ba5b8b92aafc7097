"""Chat formatting as prefix trees: what conversations share is written once.

Every turn is formatted by one template. A turn and all before it make a node, so conversations
with the same initial turns share nodes. A tree's nodes are laid out depth-first, of siblings the
one with the longest subtree first, each node's characters once; position ids count along a
node's own path, and the intervals list what a node attends to: its ancestors and itself. Since
the longest subtree follows its parent directly, a path leaves that line at most as often as the
tree can be halved, so a node has a few intervals however deep it lies.

Nothing gathers a conversation or a tree: places within a conversation and among siblings are
running sums over range partitions, and lengths of subtrees, starts and intervals double their
reach along the parents in each round, so a tree of depth ``d`` takes ``log2(d)`` rounds of joins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vitrine.session import stage

#: Marks before and behind a text, by role; any other role is named in its marks.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
ROLE = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
LEARNED = "assistant"
#: What begins a control string, and the rest of it; the escape stands between the two.
_BEGIN, _REST = r"([\[<])", r"(?=/?(?:SYS|INST|ROLE|TURN)\]|/?s>)"


def escaped(text: Column) -> Column:
    """``text`` without control strings: a backslash goes behind their first character.

    A string that has backslashes there gets one more, so that ``unescaped`` restores any text.
    """
    return F.regexp_replace(text, _BEGIN + r"(\\*)" + _REST, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _BEGIN + r"\\(\\*)" + _REST, "$1$2")


def _marks(role: Column) -> tuple[Column, Column]:
    before, behind = F.concat(F.lit(ROLE[0]), escaped(role), F.lit(ROLE[1])), F.lit(ROLE[2])
    for name, (first, last) in MARKS.items():
        before, behind = F.when(role == name, first).otherwise(before), F.when(role == name, last).otherwise(behind)
    return before, behind


def parsed(text: Column) -> tuple[Column, Column]:
    """Role and text that a formatted turn was made of."""
    inner = F.substring_index(F.substr(text, F.lit(len(ROLE[0]) + 1)), ROLE[1], 1)
    role, start, rest = unescaped(inner), F.length(inner) + len(ROLE[0]) + len(ROLE[1]), F.lit(len(ROLE[2]))
    for name, (first, last) in MARKS.items():
        own = F.startswith(text, F.lit(first))
        role, start = F.when(own, name).otherwise(role), F.when(own, len(first)).otherwise(start)
        rest = F.when(own, len(last)).otherwise(rest)
    return role, unescaped(F.substr(text, start + 1, F.length(text) - start - rest))


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _mixed(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))


Fold = tuple[str, str, Callable[[Column], Column], Callable[[Column, Column], Column]]


def in_ranges(rows: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """``rows`` dealt by ranges of ``group`` and ``order`` and stored with their range, ``_task``."""
    return stage(rows.repartitionByRange(F.col(group), *order).withColumn("_task", F.spark_partition_id()), label)


def running(ranged: DataFrame, group: str, order: list[Column], folds: list[Fold]) -> DataFrame:
    """Add what ``fold(value)`` of the rows before comes to, as ``name``, within each group.

    A fold is ``(name, value, fold, combine)``. Windows run within one range of a group; a group
    that goes on in the next range hands its totals over, one row a range, which are broadcast.
    """
    local = Window.partitionBy("_task", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_task", group).agg(*(fold(F.col(value)).alias(f"_{name}") for name, value, fold, _ in folds))
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(
        F.col("_task").alias("_at"), F.col(group).alias("_of"), F.lag("_task").over(Window.partitionBy(group).orderBy("_task")).alias("_from"),
        *(fold(F.col(f"_{name}")).over(earlier).alias(f"_{name}") for name, _, fold, _ in folds),
    ).filter("_from IS NOT NULL").drop("_from")
    own = ranged.withColumns({f"_own_{name}": fold(F.col(value)).over(local) for name, value, fold, _ in folds})
    joined = own.join(F.broadcast(handed), (F.col("_task") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_of")), "left")
    return joined.select(*ranged.columns, *(both(F.col(f"_own_{name}"), F.col(f"_{name}")).alias(name) for name, _, _, both in folds))


class Formatted:
    """``nodes``: what is laid out; ``turns``: ``conv_id, place, node`` of every turn."""

    def __init__(self, nodes: DataFrame, turns: DataFrame) -> None:
        self.nodes, self.turns = nodes, turns


def format_conversations(conversations: DataFrame) -> Formatted:
    """Lay out ``conv_id, turn, role, text`` rows as prefix trees.

    ``nodes`` has a row for each distinct run of initial turns: ``node, parent, tree`` (ids),
    ``depth``, ``text`` (its last turn, formatted), ``n_chars``, ``start`` (first character in
    the tree's sequence), ``position`` (first position id; the others follow), ``attends``
    (intervals ``[first, behind)`` of the tree's sequence that its characters see, the last one
    up to the character itself), ``loss_start, loss_chars`` (the part of the text a model learns:
    what the assistant says, without marks) and ``n_conversations``. A tree in the order of ``start``
    is the sequence to train on.

    Turns are ordered by ``turn``, nulls first, then by role and text; repeated rows are turns of
    their own. A null text or role counts as empty, rows with a null ``conv_id`` are one
    conversation, other columns are left out, and an empty table gives no rows.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    before, behind = _marks(role)
    said = escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    learned = role == LEARNED
    rows = conversations.select(
        "conv_id", "turn", F.concat(before, said, behind).alias("text"),
        F.when(learned, F.length(before)).otherwise(0).cast("long").alias("loss_start"),
        F.when(learned, F.length(said)).otherwise(0).cast("long").alias("loss_chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("text")]
    ranged = in_ranges(rows.withColumn("one", F.lit(1).cast("long")), "conv_id", order, "turns")
    placed = running(ranged, "conv_id", order, [("place", "one", F.sum, _added)])
    # a run of turns is known by the combined hashes of its turns with their places
    marked = placed.withColumns({k: F.xxhash64(F.lit(k), "place", "text") for k in ("low", "high")})
    runs = running(marked, "conv_id", order, [(f"p_{k}", k, F.bit_xor, _mixed) for k in ("low", "high")])

    def named(low: Column, high: Column) -> Column:
        return F.concat(F.lpad(F.hex(low), 16, "0"), F.lpad(F.hex(high), 16, "0"))

    own = named(F.col("p_low").bitwiseXOR(F.col("low")), F.col("p_high").bitwiseXOR(F.col("high")))
    turns = stage(
        runs.select(
            "conv_id", "place", own.alias("node"), F.when(F.col("place") > 0, named(F.col("p_low"), F.col("p_high"))).alias("parent"),
            "text", "loss_start", "loss_chars",
        ),
        "placed",
    )
    nodes = stage(
        turns.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("place").alias("depth"), F.first("text").alias("text"),
            F.first("loss_start").alias("loss_start"), F.first("loss_chars").alias("loss_chars"),
            F.count(F.lit(1)).alias("n_conversations"),
        ).withColumn("n_chars", F.length("text").cast("long")),
        "nodes",
    )
    laid = _laid_out(nodes.select("node", "parent", "depth", "n_chars"))
    return Formatted(nodes.join(laid, "node"), turns.select("conv_id", "place", "node"))


def _laid_out(nodes: DataFrame) -> DataFrame:
    """``node, tree, start, position, attends`` of every node."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    rounds = math.ceil(math.log2(deepest + 1)) if deepest else 0
    # lengths of subtrees: each round adds those of the descendants as far away as was reached
    reach = [stage(nodes.select("node", F.col("parent").alias("up"), F.col("n_chars").alias("total")), "reach")]
    for _ in range(rounds):
        now = reach[-1]
        added = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("added"))
        further = now.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        reach.append(stage(
            now.join(further, "up", "left").join(added, "node", "left")
            .select("node", F.col("upper").alias("up"), (F.col("total") + F.coalesce("added", F.lit(0))).alias("total")),
            "reach",
        ))
    totals = reach[-1].select("node", "total")
    children = nodes.filter("parent IS NOT NULL").select("node", "parent").join(totals, "node")
    order = [F.col("total").desc(), F.col("node")]
    siblings = running(in_ranges(children, "parent", order, "siblings"), "parent", order, [("shift", "total", F.sum, _added)])
    lengths = nodes.select(F.col("node").alias("parent"), F.col("n_chars").alias("above"))
    step = siblings.join(lengths, "parent").select("node", (F.col("shift") + F.col("above")).alias("step"))
    itself = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_chars").alias("behind")))
    state = stage(
        nodes.join(step, "node", "left")
        .select("node", F.col("node").alias("tree"), F.coalesce("step", F.lit(0).cast("long")).alias("start"), itself.alias("attends")),
        "layout",
    )
    for k in range(rounds):
        above = state.select(*(F.col(c).alias(f"{c}_up") for c in state.columns)).withColumnRenamed("node_up", "up")
        state = stage(
            state.join(reach[k].select("node", "up"), "node").join(above, "up", "left").select(
                "node", F.coalesce("tree_up", "tree").alias("_tree"), (F.col("start") + F.coalesce("start_up", F.lit(0))).alias("_start"),
                F.when(F.col("up").isNull(), F.col("attends")).otherwise(_chained("attends_up", "attends", "start")).alias("_attends"),
            ).toDF("node", "tree", "start", "attends"),
            "layout",
        )
    seen = F.aggregate("attends", F.lit(0).cast("long"), lambda n, i: n + i["behind"] - i["first"])
    own = F.element_at("attends", -1)["behind"]
    return state.select("node", "tree", "start", (seen - own).alias("position"), _shifted("attends", F.col("start")).alias("attends"))


def _shifted(intervals: str, by: Column) -> Column:
    return F.transform(intervals, lambda i: F.struct((i["first"] + by).alias("first"), (i["behind"] + by).alias("behind")))


def _chained(upper: str, lower: str, step: str) -> Column:
    """Intervals relative to a node: those of the part of its path above, then those below.

    ``upper`` is relative to a node that lies ``step`` before; intervals that touch become one.
    """
    above = _shifted(upper, -F.col(step))
    last, first = F.element_at(above, -1), F.element_at(lower, 1)
    bridge = F.array(F.struct(last["first"].alias("first"), first["behind"].alias("behind")))
    touching = F.concat(F.slice(above, F.lit(1), F.size(above) - 1), bridge, F.slice(lower, F.lit(2), F.size(lower)))
    return F.when(last["behind"] == first["first"], touching).otherwise(F.concat(above, F.col(lower)))


def read_back(found: Formatted) -> DataFrame:
    """``conv_id, place, role, text, learned, n_chars`` of every turn, from what was laid out.

    ``learned`` is the text under the loss mask, null where a turn has none.
    """
    role, text = parsed(F.col("text"))
    under = unescaped(F.substr("text", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    learned = F.when(F.col("loss_start") > 0, under)
    nodes = found.nodes.select("node", role.alias("role"), text.alias("said"), learned.alias("learned"), "n_chars")
    return found.turns.join(nodes, "node").select("conv_id", "place", "role", F.col("said").alias("text"), "learned", "n_chars")


def digests(turns: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, from ``read_back``.

    A conversation's turns pass through one task in order, a batch at a time, because SHA-256
    can only be computed in sequence; nothing is held but the state of the digests.
    """
    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done() -> list:
            conv, n, all_text, chars, loss, formatted = state
            return [conv, n, all_text.hexdigest(), chars, loss.hexdigest(), formatted]

        for batch in batches:
            rows = []
            for conv, role, text, learned, n_chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if learned is not None:
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += n_chars
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(done(), kinds)], names=names)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text", "learned", "n_chars")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.mapInArrow(run, schema)


def with_position_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``position_ids``, one number a character."""
    last = F.col("position") + F.col("n_chars") - 1
    return nodes.withColumn("position_ids", F.when(F.col("n_chars") > 0, F.sequence("position", last)))
