"""Chat formatting with minimum-cost role repair.

Legal conversations are paths of an automaton: an optional system turn, then user and
assistant in turn, ending after an assistant turn.  Dynamic programming finds the cheapest
way to make a turn sequence legal by merging a turn into the one before, giving it another
role, or inserting an empty turn; the repaired sequence is then rendered.

A step's costs between the automaton's states form a small matrix, and matrices multiply
(with min and plus) in any grouping.  Turns are sorted over all tasks and cut into blocks of
a bounded number of rows.  A conversation that ends up whole in a block is repaired there;
otherwise blocks are summed up as matrices, these tell each block where it begins and ends,
and every block is repaired by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vigilake.llm.common import checkpointed

ROLES = ("system", "user", "assistant")
#: States: at the start, or after a turn of a role.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
STATES = 4
#: Rows in a block.
BLOCK = 1024


@dataclass(frozen=True)
class Costs:
    """Merging joins a turn to the one before; relabelling changes its role; inserting adds an empty turn.

    An unknown or null role has to be relabelled, at a lower cost.
    """

    merge: float = 1.0
    relabel: float = 3.0
    relabel_unknown: float = 0.5
    insert: float = 2.0


#: (state before, role) -> state after, by a legal turn.
LEGAL = {(START, "system"): SYSTEM, (START, "user"): USER, (SYSTEM, "user"): USER, (USER, "assistant"): ASSISTANT, (ASSISTANT, "user"): USER}
_ROLE_OF = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}


def _moves(role: str | None, costs: Costs) -> list[tuple[float, int, int, str, str, tuple[str, ...]]]:
    """(cost, state before, state after, action, role, roles inserted before) for one turn, cheapest kinds first."""
    out = []
    for new in ROLES:
        change = 0.0 if new == role else costs.relabel if role in ROLES else costs.relabel_unknown
        act = "keep" if new == role else "relabel"
        for state in range(STATES):
            if (after := LEGAL.get((state, new))) is not None:
                out.append((change, state, after, act, new, ()))
            for (before, extra), middle in LEGAL.items():
                if before == state and (after := LEGAL.get((middle, new))) is not None:
                    out.append((change + costs.insert, state, after, act, new, (extra,)))
            if state != START and _ROLE_OF[state] == new:
                out.append((change + costs.merge, state, state, "merge", new, ()))
    return sorted(out)


def _endings(costs: Costs) -> list[tuple[float, tuple[str, ...]]]:
    """By state: cost and roles inserted to end legally; a conversation without turns is legal."""
    return [(0.0, ()), (2 * costs.insert, ("user", "assistant")), (costs.insert, ("assistant",)), (0.0, ())]


class Repairer:
    def __init__(self, costs: Costs):
        self.by_role = {r: _moves(r, costs) for r in (*ROLES, None)}
        self.endings = _endings(costs)
        self.steps = {}
        for role, moves in self.by_role.items():
            step = np.full((STATES, STATES), np.inf)
            for cost, before, after, *_ in moves:
                step[before, after] = min(step[before, after], cost)
            self.steps[role] = step

    def moves(self, role: str | None):
        return self.by_role.get(role if role in ROLES else None)

    def matrix(self, roles: list[str | None]) -> np.ndarray:
        """Least cost from each state to each over these turns."""
        total = np.full((STATES, STATES), np.inf)
        np.fill_diagonal(total, 0)
        for role in roles:
            total = (total[:, :, None] + self.steps[role if role in ROLES else None][None]).min(1)
        return total

    def repair(self, roles: list[str | None], begin: int, end: int) -> tuple[float, list[tuple[str, str, tuple[str, ...]]]]:
        """Cheapest (action, role, roles inserted before) by turn between two states; ties go to the first move in order."""
        best = [np.inf] * STATES
        best[begin] = 0.0
        back = []
        for role in roles:
            new, via = [np.inf] * STATES, [None] * STATES
            for move in self.moves(role):
                cost, before, after = move[:3]
                if best[before] + cost < new[after] - 1e-12:
                    new[after], via[after] = best[before] + cost, move
            best = new
            back.append(via)
        state, out = end, []
        for via in reversed(back):
            move = via[state]
            out.append(move[3:])
            state = move[1]
        return best[end], out[::-1]


_TURNS = "array<struct<action:string,role:string,text:string,source_turns:array<bigint>,changed:int>>"
_TURN = pa.struct([("action", pa.string()), ("role", pa.string()), ("text", pa.string()), ("source_turns", pa.list_(pa.int64())), ("changed", pa.int32())])
_RAW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _sorted_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns sorted over all partitions; a null turn comes last, and rows without a conversation stand alone.

    Equal rows are told apart by a hash of their place, so that any number of them is split.
    """
    place = F.monotonically_increasing_id()
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.lower(F.trim(F.col(role))).alias("role"), F.col(text).cast("string").alias("text"), F.xxhash64(place).alias("_tie")
    )
    keys = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("_tie")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[object, list[dict], bool]]:
    """(conversation, rows, alone) in order; alone: the whole conversation, certainly."""
    held: list[dict] = []
    key, first, cut = None, True, False
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv"] is None or row["conv"] != key):
                yield key, held, key is None or not (first or cut)
                held, first, cut = [], False, False
            elif len(held) == size:
                yield key, held, False
                held, cut = [], True
            key = row.pop("conv")
            held.append(row)
    if held:
        yield key, held, key is None


def _repaired(fixer: Repairer, rows: list[dict], begin: int, end: int | None) -> tuple[list[dict], float]:
    """Turns of a block between two states, and their cost; without ``end``, of a whole conversation."""
    roles = [t["role"] for t in rows]
    final = end is None
    if final:
        end = int(np.argmin(fixer.matrix(roles)[begin] + np.array([x for x, _ in fixer.endings])))
    cost, moves = fixer.repair(roles, begin, end)
    out: list[dict] = []
    inserted = lambda r: {"action": "insert", "role": r, "text": [], "source_turns": [], "changed": 0}
    for t, (action, new, before) in zip(rows, moves, strict=True):
        out += [inserted(r) for r in before]
        changed = int(new != t["role"])
        if action == "merge" and out and out[-1]["action"] != "insert":
            out[-1]["text"].append(t["text"] or "")
            out[-1]["source_turns"].append(t["turn"])
            out[-1]["changed"] += changed
        else:
            out.append({"action": action, "role": new, "text": [t["text"] or ""], "source_turns": [t["turn"]], "changed": changed})
    if final:
        cost += fixer.endings[end][0]
        out += [inserted(r) for r in fixer.endings[end][1]]
    for t in out:
        t["text"] = "\n".join(t["text"])
    return out, cost


def _place_blocks(fixer: Repairer):
    """applyInArrow function: the states between which each block of a conversation runs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        steps = [np.array(m).reshape(STATES, STATES) for m in table.column("m").to_pylist()]
        best = np.array([0.0] + [np.inf] * (STATES - 1))
        came = []
        for m in steps:
            ways = best[:, None] + m
            came.append(ways.argmin(0))
            best = ways.min(0)
        state = int(np.argmin(best + np.array([c for c, _ in fixer.endings])))
        begins, ends = [], []
        for via in reversed(came):
            ends.append(state)
            state = int(via[state])
            begins.append(state)
        final = [i == len(steps) - 1 for i in range(len(steps))]
        return pa.table({"block": table.column("block"), "begin": pa.array(begins[::-1], pa.int32()), "end": pa.array(ends[::-1], pa.int32()), "final": pa.array(final)})

    return run


def _joined(fixer: Repairer, kind: pa.DataType):
    """applyInArrow function: the blocks of one conversation as one row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out: list[dict] = []
        for turns in table.column("turns").to_pylist():
            if out and turns and turns[0]["action"] == "merge":
                more = turns.pop(0)
                out[-1]["text"].append(more["text"])
                out[-1]["source_turns"] += more["source_turns"]
                out[-1]["changed"] += more["changed"]
            out += [t | {"text": [t["text"]]} for t in turns]
        ending = fixer.endings[table.column("end")[-1].as_py()]
        for t in out:
            t["text"] = "\n".join(t["text"])
        out += [{"action": "insert", "role": r, "text": "", "source_turns": [], "changed": 0} for r in ending[1]]
        cost = sum(table.column("cost").to_pylist()) + ending[0]
        return pa.table({"conv": table.column("conv").slice(0, 1).cast(kind), "turns": pa.array([out], pa.list_(_TURN)), "cost": pa.array([cost], pa.float64())})

    return run


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs(), block: int = BLOCK
) -> DataFrame:
    """One row for each conversation, whatever its length: conv, turns, cost.

    ``turns``: array of (action, role, text, source_turns, changed); actions keep, relabel,
    insert; turns merged into one have their texts joined by a line feed, and ``changed`` counts
    the source turns whose role was changed.  Turns of equal number go by role, then text; null
    numbers come last.  Roles are compared without case; unknown and null ones are relabelled;
    null texts are empty.  Repeated rows are turns of their own.  A row without a conversation id
    is a conversation of its own.  An empty table gives none; other columns are not read.

    ``block`` bounds the rows that a task repairs at once and does not change the result.
    Only the finished row of a conversation of several blocks is put together in one place.
    """
    fixer = Repairer(costs)
    rows = _sorted_turns(df, conv, turn, role, text)
    kind = rows.schema["conv"].dataType
    if not isinstance(kind, (T.StringType, T.LongType, T.IntegerType)):
        raise ValueError(f"conversation ids of type {kind.simpleString()} are not supported; cast them to a string")
    arrow_kind = to_arrow_type(kind)

    def first_pass(batches):
        part = TaskContext.get().partitionId()
        held: list[tuple] = []

        def batch():
            types = [arrow_kind, pa.int64(), pa.list_(_TURN), pa.float64(), pa.list_(_RAW), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate(types)], ["conv", "block", "turns", "cost", "raw", "m"])

        size = 0
        for number, (key, turns, alone) in enumerate(_blocks(batches, block)):
            place = (part << 40) + number
            if alone:
                held.append((key, place, *_repaired(fixer, turns, START, None), None, None))
            else:
                held.append((key, place, None, None, turns, fixer.matrix([t["role"] for t in turns]).ravel().tolist()))
            size += len(turns)
            if size >= 4 * BLOCK:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    def second_pass(batches):
        for found in batches:
            for i in range(found.num_rows):
                row = found.slice(i, 1).to_pylist()[0]
                turns, cost = _repaired(fixer, row["raw"], row["begin"], row["end"])
                values = [(row["conv"], arrow_kind), (row["block"], pa.int64()), (turns, pa.list_(_TURN)), (cost, pa.float64()), (row["end"], pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["conv", "block", "turns", "cost", "end"])

    head = T.StructType().add("conv", kind)
    turn_type = rows.sparkSession.sql(f"SELECT CAST(NULL AS {_TURNS}) t").schema["t"].dataType
    raw_type = T.ArrayType(T.StructType().add("turn", "long").add("role", "string").add("text", "string"))
    made = T.StructType([*head]).add("block", "long").add("turns", turn_type).add("cost", "double")
    blocks = checkpointed(rows.mapInArrow(first_pass, T.StructType([*made]).add("raw", raw_type).add("m", T.ArrayType(T.DoubleType()))))
    apart = blocks.filter("raw IS NOT NULL").select("conv", "block", "raw", "m")
    placed = apart.select("conv", "block", "m").groupBy("conv").applyInArrow(_place_blocks(fixer), "block long, begin int, end int, final boolean")
    pieces = apart.drop("m").join(placed.drop("final"), "block").mapInArrow(second_pass, T.StructType([*made]).add("end", "integer"))
    whole = pieces.groupBy("conv").applyInArrow(_joined(fixer, arrow_kind), T.StructType([*head]).add("turns", turn_type).add("cost", "double"))
    return blocks.filter("raw IS NULL").select("conv", "turns", "cost").union(whole)


def render(repaired: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Adds ``rendered``: each turn as begin, role, line feed, text, end, line feed."""
    piece = lambda t: F.concat(F.lit(begin), t["role"], F.lit("\n"), t["text"], F.lit(f"{end}\n"))
    return repaired.withColumn("rendered", F.array_join(F.transform("turns", piece), ""))


def chat_digest(df: DataFrame) -> DataFrame:
    """One row for each conversation: counts of turns and actions, cost and the rendered text.

    Null turns, roles and texts and repeated rows are repaired as ``repair_conversations``
    says, which also breaks ties; a conversation of any length is one row.  An empty table
    gives none; other columns are not read.
    """
    done = render(repair_conversations(df))
    total = lambda value: F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + value(t))
    return done.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        total(lambda t: t["changed"]).alias("n_relabelled"),
        total(lambda t: (t["action"] == "insert").cast("int")).alias("n_inserted"),
        total(lambda t: F.greatest(F.size(t["source_turns"]) - 1, F.lit(0))).alias("n_merged"),
        "cost",
        "rendered",
    )
