"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last one being the
assistant's. For every turn, dynamic programming over that automaton chooses a role (its own or a relabel), whether it is
merged into the turn before it, and which empty turns are inserted before it, so that the total cost of the conversation
is least. Of equal costs the choice with the smaller earlier state, then the smaller role, then the merge wins. A turn is
relabelled only where merging it and answering it with an empty turn would cost more.

A turn is a min-plus matrix over the automaton's four states, and a stretch of turns is their product. So a conversation of
any length is cut at the borders of range partitions: each partition reports the products of its first and last
conversation; a scan in blocks gives the costs of all states at each border, from these each partition tells which state
at its beginning leads to which at its end, and a scan back gives the states themselves. Each partition then repairs and
renders its own turns, just as if the conversation were whole: results do not depend on where it was cut. No conversation
is ever gathered in one task, and nothing is collected to the driver.

Defined cases: turns are ordered by turn (null last), then role (null last), then a hash of the text; turns equal in all
of these are turns of their own, in any order, and may lie in several partitions; a null or unknown role fits any role at
a lower cost; a null text is empty; rows with a null conv_id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.shared import staged

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "developer": SYSTEM}
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 5.0, 0.5, 3.0
NEVER = float("inf")

#: Empty turns to insert between two states; None: no legal way.
BETWEEN: dict[tuple[int, int], tuple[int, ...] | None] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, SYSTEM): None, (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns to insert at the end.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}

OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
#: Characters of text that a range partition is meant to hold.
PART_CHARS = 16_000_000
#: Partitions whose borders are scanned together.
BLOCK = 1024
#: In place of a state at the end of a stretch: the conversation ends there.
OPEN_END = 4


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    return NAMES.index(name) if name in NAMES[1:] else ALIASES.get(name, START)


def choices(role: int) -> list[list[tuple[float, bool]]]:
    """[before][after]: (cost, merged) of a turn; after START nothing."""
    out = [[(NEVER, False)] * 4 for _ in range(4)]
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            name = 0.0 if after == role else UNKNOWN if role == START else RELABEL
            inserted = BETWEEN[(before, after)]
            options = [(name + MERGE, True)] if before == after else []
            if inserted is not None:
                options.append((name + INSERT * len(inserted), False))
            if options:
                out[before][after] = min(options, key=lambda x: (x[0], not x[1]))
    return out


CHOICES = [choices(r) for r in range(4)]


def product(roles: list[int]) -> list[list[float]]:
    """[before][after]: least cost of a stretch of turns."""
    out = [[0.0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for role in roles:
        step = CHOICES[role]
        out = [[min(row[k] + step[k][j][0] for k in range(4)) for j in range(4)] for row in out]
    return out


def ending(costs: list[float]) -> int:
    """The state in which a conversation with these costs ends."""
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(CLOSING[s]), s))


FRESH = [0.0, NEVER, NEVER, NEVER]


def steps(roles: list[int], costs: list[float]) -> tuple[list[list[int]], list[float]]:
    """For each turn the best state before, by the state after; and the costs at the end. costs: those of the states before."""
    now, back = list(costs), []
    for role in roles:
        step = CHOICES[role]
        came = [min(range(4), key=lambda k: (now[k] + step[k][j][0], k)) for j in range(4)]
        now = [now[came[j]] + step[came[j]][j][0] for j in range(4)]
        back.append(came)
    return back, now


def path(roles: list[int], costs: list[float] = FRESH, end: int = OPEN_END) -> tuple[float, int, list[tuple[int, bool]]]:
    """Cost up to the end, the state before, and (role, merged) of each turn."""
    back, now = steps(roles, costs)
    at = ending(now) if end == OPEN_END else end
    total = now[at] + (INSERT * len(CLOSING[at]) if end == OPEN_END else 0.0)
    turns = []
    for role, came in zip(reversed(roles), reversed(back)):
        turns.append((at, CHOICES[role][came[at]][at][1]))
        at = came[at]
    return total, at, turns[::-1]


def backward(roles: list[int], costs: list[float]) -> list[int]:
    """For each state at the end, and for OPEN_END, the state before the first turn on the best path to it."""
    back, now = steps(roles, costs)
    out = []
    for at in (0, 1, 2, 3, ending(now)):
        for came in reversed(back):
            at = came[at]
        out.append(at)
    return out


def rendered(turns: list[tuple[int, str]], costs: list[float] = FRESH, end: int = OPEN_END) -> list[tuple[str, str, int, str]]:
    """(new role, action, empty turns inserted, fragment) of each (role, text); a conversation's fragments in order are its rendering."""
    _, before, chosen = path([r for r, _ in turns], costs, end)
    out = []
    for k, ((role, text), (after, merged)) in enumerate(zip(turns, chosen)):
        inserted = () if merged else BETWEEN[(before, after)]
        if merged:
            head = JOINT
        else:
            empty = "".join(OPEN.format(NAMES[r]) + CLOSE for r in inserted)
            head = ("" if before == START else CLOSE) + empty + OPEN.format(NAMES[after])
        closing, tail = (), ""
        if end == OPEN_END and k == len(turns) - 1:
            closing = CLOSING[after]
            tail = CLOSE + "".join(OPEN.format(NAMES[r]) + CLOSE for r in closing)
        action = "+".join(x for x, on in (("relabel", after != role), ("merge", merged), ("insert", bool(inserted or closing))) if on) or "keep"
        out.append((NAMES[after], action, len(inserted) + len(closing), head + text + tail))
        before = after
    return out


def stretches(ids: list) -> Iterator[tuple[int, int]]:
    at = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[at]:
            yield at, k
            at = k


@dataclass(frozen=True)
class Scan:
    """A running fold over the borders of a conversation. combine joins two neighbouring elements, follow moves a state over one."""

    combine: Callable[[list[float], list[float]], list[float]]
    follow: Callable[[list[float], list[float]], list[float]]
    start: tuple[float, ...]
    back: bool = False

    def run(self, rows: DataFrame) -> DataFrame:
        """(conv, part, got): the state before each element e of (conv, part, e), in the order of the parts or against it.

        Blocks of parts are folded, then the blocks of a conversation are followed, then the parts within each block.
        """

        def ordered(table: pa.Table, by: str) -> list[dict]:
            return table.sort_by([(by, "descending" if self.back else "ascending")]).to_pylist()

        def fold(table: pa.Table) -> pa.Table:
            of = ordered(table, "part")
            return pa.Table.from_pylist([{"conv": of[0]["conv"], "block": of[0]["block"], "e": reduce(self.combine, [r["e"] for r in of])}], pa.schema([("conv", pa.string()), ("block", pa.int32()), ("e", pa.list_(pa.float64()))]))

        def follow(table: pa.Table, by: str, start: list[float]) -> pa.Table:
            of, got, now = ordered(table, by), [], start
            for r in of:
                got.append({"conv": r["conv"], by: r[by], "got": now})
                now = self.follow(now, r["e"])
            return pa.Table.from_pylist(got, pa.schema([("conv", pa.string()), (by, pa.int32()), ("got", pa.list_(pa.float64()))]))

        blocked = staged(rows.withColumn("block", F.floor(F.col("part") / BLOCK).cast("int")), "borders")
        blocks = blocked.groupBy("conv", "block").applyInArrow(fold, "conv string, block int, e array<double>")
        heads = blocks.groupBy("conv").applyInArrow(lambda t: follow(t, "block", list(self.start)), "conv string, block int, got array<double>")
        inside = blocked.join(heads.withColumnRenamed("got", "head"), ["conv", "block"])
        return inside.groupBy("conv", "block").applyInArrow(lambda t: follow(t, "part", t.column("head")[0].as_py()), "conv string, part int, got array<double>")


def times(a: list[float], b: list[float]) -> list[float]:
    """Min-plus product of two 4 x 4 matrices (by rows), and the sum of their turns at the end."""
    return [min(a[4 * i + k] + b[4 * k + j] for k in range(4)) for i in range(4) for j in range(4)] + [a[16] + b[16]]


def onward(v: list[float], m: list[float]) -> list[float]:
    """Costs of the four states, and the turns so far."""
    return [min(v[k] + m[4 * k + j] for k in range(4)) for j in range(4)] + [v[4] + m[16]]


#: Costs of all states, and the number of turns, before each stretch.
FORWARD = Scan(times, onward, (*FRESH, 0.0))
#: The state at the end of each stretch; elements as backward() gives them.
BACKWARD = Scan(lambda late, early: [early[int(x)] for x in late], lambda v, e: [e[int(v[0])]], (float(OPEN_END),), back=True)


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, ordinal, new_role, action, n_inserted and rendered (its fragment) for every row of turns.

    ordinal counts a conversation's turns from 1; its fragments in that order are its rendering.
    """
    t = turns.select(F.col(id_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    conv = F.when(F.col("c").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("c").cast("string")))
    t = t.select("*", conv.alias("conv"), F.col("t").isNull().alias("late"), F.col("r").isNull().alias("anon"), F.coalesce("r", F.lit("")).alias("name"), F.xxhash64("x").alias("h"), F.monotonically_increasing_id().alias("u"))
    within = ["late", "t", "anon", "name", "h", "u"]  # u only deals turns that are equal in all else
    chars = t.agg(F.sum(F.length("x"))).first()[0] or 0
    parts = max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    dealt = staged(t.repartitionByRange(parts, "conv", *within).withColumn("part", F.spark_partition_id()), "turns")
    keys = dealt.select("part", "conv", *within)

    def in_order(table: pa.Table) -> tuple[list[str], list[int], pa.Table]:
        table = table.sort_by([(c, "ascending") for c in ("conv", *within)]) if table.num_rows else table
        return table.column("conv").to_pylist(), [role_of(r) for r in table.column("name").to_pylist()], table

    def ends(table: pa.Table) -> pa.Table:
        ids, roles, table = in_order(table)
        spans = list(stretches(ids))
        spans = spans if len(spans) < 2 else [spans[0], spans[-1]]
        part = table.column("part")[0].as_py()
        made = [{"conv": ids[a], "part": part, "e": [x for row in product(roles[a:b]) for x in row] + [float(b - a)]} for a, b in spans]
        return pa.Table.from_pylist(made, pa.schema([("conv", pa.string()), ("part", pa.int32()), ("e", pa.list_(pa.float64()))]))

    pieces = staged(keys.groupBy("part").applyInArrow(ends, "conv string, part int, e array<double>"), "ends")
    cut = pieces.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    forward = staged(FORWARD.run(pieces.join(cut, "conv")), "forward")

    def known(table: pa.Table) -> dict[str, list[float]]:
        return {r["conv"]: r["got"] for r in table.to_pylist()}

    def ways(table: pa.Table, borders: pa.Table) -> pa.Table:
        costs, out = known(borders), []
        if costs and table.num_rows:
            ids, roles, table = in_order(table)
            out = [{"conv": ids[a], "part": table.column("part")[0].as_py(), "e": [float(x) for x in backward(roles[a:b], costs[ids[a]][:4])]} for a, b in stretches(ids) if ids[a] in costs]
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("part", pa.int32()), ("e", pa.list_(pa.float64()))]))

    at_borders = keys.join(forward.select("part").distinct(), "part", "left_semi")
    back = BACKWARD.run(at_borders.groupBy("part").cogroup(forward.groupBy("part")).applyInArrow(ways, "conv string, part int, e array<double>"))
    solved = staged(forward.join(back.withColumnRenamed("got", "end"), ["conv", "part"]).select("conv", "part", F.concat("got", "end").alias("got")), "solved")

    def repair(table: pa.Table, borders: pa.Table) -> pa.Table:
        at, out, ordinals = known(borders), [], []
        if not table.num_rows:
            return schema_.empty_table()
        ids, roles, table = in_order(table)
        texts = table.column("x").to_pylist()
        for a, b in stretches(ids):
            *costs, before, end = at.get(ids[a], [*FRESH, 0.0, float(OPEN_END)])
            out += rendered(list(zip(roles[a:b], texts[a:b])), costs, int(end))
            ordinals += range(int(before) + 1, int(before) + b - a + 1)
        new, action, inserted, made = zip(*out)
        return pa.table({"c": table.column("c"), "t": table.column("t"), "r": table.column("r"), "ordinal": pa.array(ordinals, pa.int64()), "new_role": pa.array(new, pa.string()), "action": pa.array(action, pa.string()), "n_inserted": pa.array(inserted, pa.int32()), "rendered": pa.array(made, pa.string())})

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([dealt.schema["c"], dealt.schema["t"], dealt.schema["r"], *T.StructType.fromDDL("ordinal long, new_role string, action string, n_inserted int, rendered string")])
    schema_ = to_arrow_schema(schema)
    done = dealt.groupBy("part").cogroup(solved.groupBy("part")).applyInArrow(repair, schema)
    return done.select(F.col("c").alias("conv_id"), F.col("t").alias("turn"), F.col("r").alias("role"), "ordinal", "new_role", "action", "n_inserted", "rendered")
