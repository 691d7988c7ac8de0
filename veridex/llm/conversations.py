"""Conversation structure repair: the cheapest edits after which the roles read system? (user assistant)+, or nothing.

The repair is a shortest way over the turns that are retained, kept or given another role.  Between two retained turns all
turns are deleted, at a price of prefix sums of deletions, and the two roles determine what is inserted.  So the
costs from each place on need a running minimum for each role only: of a retained turn's edit and all that follows it, less
the deletions behind it.  With these costs the edits are read off from the front, the ASCII-least initial first among those
that still lead to the least cost; initials determine the roles, so equal audits are equal repairs.

A conversation of up to ``block`` turns is one row of arrays.  A longer one is dealt out in sorted ranges of its turns, and
equal rows are counted before.  Each range knows its costs from each of the four states before it to each after it; these
are put together from the last range on, then each range reads off its edits for each state before it, and the states are
followed from the first range on.  Only the digest of a repaired conversation has to see its turns in order in one task, one
batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.shared_store import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: States: nothing yet, the system turn, a user turn last, an assistant turn last.
STATES = range(4)
#: Numbers of insertions between a state and a retained role, and between a state and the end.
BEFORE = {"s": (0, FAR, FAR, FAR), "u": (0, 0, 1, 0), "a": (1, 1, 0, 1)}
AT_END = (0, 2, 1, 0)
AFTER = {"s": 1, "u": 2, "a": 3}
ROLE = {2: "user", 3: "assistant"}
#: The state after an insertion or another role.
STEP = (2, 2, 3, 2)
BLANKS = r"\x20\x09-\x0D"
WORD = re.compile(f"[^{BLANKS}]")
FULL_STOP = re.compile(f"[.!?][{BLANKS}]*\\Z")
LEGAL = {"su", "ua", "au"}
#: Faults.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def damaged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, lost, copies, role, text): what becomes of each row; a null in a text or in a row's name is one space."""
    blank = F.lit(" ")
    text, role = (F.coalesce(F.col(c).cast("string"), blank) for c in (text_col, role_col))
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), blank) if c else F.lit(":") for c in (id_col, None, turn_col)))
    fault = F.crc32(name.cast("binary")) % 20
    return rows.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        (fault == 0).alias("lost"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )


def fault_of(text: str, seen: bool) -> int:
    return BLANK if not WORD.search(text) else DUPLICATE if seen else SOUND if FULL_STOP.search(text) else CUT


def costs_from(roles: str, faults: list[int], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each place, and after the last turn, the least costs from each state on; end has those behind the turns.

    roles has an initial a turn, any other sign for roles that can't be kept.
    """
    n = len(faults)
    out = [end] * (n + 1)
    deleted = 0  # the price of deleting all turns from here on
    least = {"s": FAR, "u": FAR, "a": FAR}
    following = end
    for at in range(n - 1, -1, -1):
        fault = faults[at]
        deleted += DELETE
        if fault in (SOUND, CUT):
            more = (TRUNCATED if fault == CUT else 0) - deleted
            for role in "sua":
                edit = KEEP if roles[at] == role else REROLE if role != "s" else FAR
                price = edit + more + following[AFTER[role]]
                if price < least[role]:
                    least[role] = price
        following = tuple(
            min(FAR, deleted + min(end[state], *(INSERT * BEFORE[role][state] + least[role] for role in "sua"))) for state in STATES
        )
        out[at] = following
    return out


def edits(roles: str, faults: list[int], costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """(the ASCII-least cheapest edits from a state on, the state after them); insertions at the end only if last."""
    audit, at, n = [], 0, len(faults)
    while at < n:
        here, fault = costs[at][state], faults[at]
        if DELETE + costs[at + 1][state] == here:
            audit.append("D")
            at += 1
            continue
        if INSERT + costs[at][STEP[state]] == here:
            audit.append("I")
            state = STEP[state]
            continue
        more, role = TRUNCATED if fault == CUT else 0, roles[at]
        keep = AFTER.get(role)
        if keep and BEFORE[role][state] == 0 and KEEP + more + costs[at + 1][keep] == here:
            audit.append("K")
            state = keep
        else:
            audit.append("R")
            state = STEP[state]
        at += 1
    if last:
        audit.append("I" * AT_END[state])
        state = 3 if AT_END[state] else state
    return "".join(audit), state


def repaired(audit: str, rows: Iterator[tuple[str, str]], state: int = 0) -> Iterator[str]:
    """The turns of a repaired conversation as role:text."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = AFTER[role[0]] if edit == "K" else STEP[state]
        yield f"{role if edit == 'K' else ROLE[state]}:{text}"


END = tuple(INSERT * n for n in AT_END)


def gaps_of(turns: list[int | None]) -> int:
    held = {t for t in turns if t is not None}
    return max(held) - min(held) + 1 - len(held) if held else 0


def repair_one(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows in order."""
    seen, faults = set(), []
    for row in zip(roles, texts, strict=True):
        faults.append(fault_of(row[1], row in seen))
        seen.add(row)
    first = "".join(role[:1] or "-" for role in roles)
    costs = costs_from(first, faults, END)
    audit, _ = edits(first, faults, costs, 0, True)
    digest = hashlib.sha256("\n".join(repaired(audit, zip(roles, texts, strict=True))).encode()).hexdigest()
    illegal = sum(first[i : i + 2] not in LEGAL for i in range(len(first) - 1))
    return gaps_of(turns), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, costs[0][0], audit, digest


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """Repairs of conversations whose rows fit an array."""
    copies = F.when(~F.col("lost"), F.array_repeat(F.struct("turn", "role", "text"), F.col("copies")))
    whole = rows.groupBy("conv").agg(F.sort_array(F.flatten(F.collect_list(copies))).alias("turns"))  # nulls come first

    def run(batches):
        for batch in batches:
            turns = batch.column(1)
            ends = turns.offsets.to_pylist()
            turn, role, text = (column.to_pylist() for column in turns.values.flatten())
            found = [repair_one(turn[a:b], role[a:b], text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            if found:
                yield _batch([batch.column(0)], found)

    return whole.mapInArrow(run, f"conv {kind}, {RESULT}")


def _batch(first: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, pa.int64() if i < len(COUNTS) else pa.string()) for i, values in enumerate(zip(*found, strict=True))]
    return pa.RecordBatch.from_arrays([*first, *columns], names=["conv", *COUNTS, "audit", "repaired_sha256"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Distinct rows in order with their number of copies and the fault of the first one: (conv, part, pos, ...).

    part is a range of rows in order, so the rows of one conversation fill as many parts as they need.
    """
    once = written(rows.filter("NOT lost").groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    classes = once.groupBy("conv", "role", "text").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    classes = written(classes.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    seen = F.col("first").isNotNull() & (place > F.col("first"))
    fault = (
        F.when(~F.col("text").rlike(f"[^{BLANKS}]"), BLANK).when(seen, DUPLICATE)
        .when(F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"), SOUND).otherwise(CUT)
    )
    marked = once.join(classes, same, "left").select("conv", "turn", "role", "text", "copies", fault.alias("fault"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    sorted_ = written(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    return sorted_.withColumn("part", F.shiftright("pos", 33)).withColumn("initial", F.rpad(F.substring("role", 1, 1), 1, "-"))


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Repairs of conversations of any length, by ranges of their turns."""
    dealt = _dealt(rows)
    lean = dealt.select("conv", "part", "pos", "initial", "fault")

    def turns(frame: pd.DataFrame) -> tuple[str, list[int]]:
        frame.sort_values("pos", inplace=True)
        return "".join(frame["initial"]), frame["fault"].tolist()

    def through(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The costs of a range from each state before it to each after it."""
        roles, faults = turns(frame)
        found = [costs_from(roles, faults, tuple(0 if q == state else FAR for q in STATES))[0] for state in STATES]
        return pd.DataFrame({"conv": [key[0]], "part": [key[1]], "costs": [[int(c) for row in found for c in row]]})

    ranges = written(lean.groupBy("conv", "part").applyInPandas(through, f"conv {kind}, part bigint, costs array<bigint>"))

    def backward(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The least costs behind each range of a conversation, from its last one on."""
        frame = frame.sort_values("part", ascending=False)
        ends, behind = [], END
        for costs in frame["costs"]:
            ends.append([int(c) for c in behind])
            behind = tuple(min(FAR, *(int(costs[4 * q + p]) + behind[q] for q in STATES)) for p in STATES)
        return pd.DataFrame({"conv": [key[0]] * len(frame), "part": frame["part"].to_numpy(), "behind": ends})

    behind = ranges.groupBy("conv").applyInPandas(backward, f"conv {kind}, part bigint, behind array<bigint>")
    behind = written(behind.select(F.col("conv").alias("c"), F.col("part").alias("p"), "behind"))
    priced = lean.join(behind, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")

    def read_off(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The edits of each turn of a range and the state after it, for each state before the range."""
        roles, faults = turns(frame)
        costs = costs_from(roles, faults, tuple(int(c) for c in frame["behind"].iloc[0]))
        letters, after = [[] for _ in faults], [[] for _ in faults]
        for state in STATES:
            for at in range(len(faults)):
                if costs[at][state] >= FAR:
                    own = "D"  # no way leads here
                else:
                    own, state = edits(roles[at], faults[at : at + 1], costs[at : at + 2], state, False)
                letters[at].append(own)
                after[at].append(state)
        return pd.DataFrame({"conv": [key[0]] * len(frame), "part": key[1], "pos": frame["pos"].to_numpy(), "letters": letters, "after": after})

    read = written(priced.groupBy("conv", "part").applyInPandas(read_off, f"conv {kind}, part bigint, pos bigint, letters array<string>, after array<int>"))

    def forward(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The state before each range of a conversation."""
        frame, starts, state = frame.sort_values("part"), [], 0
        for after in frame["after"]:
            starts.append(state)
            state = int(after[state])
        return pd.DataFrame({"conv": [key[0]] * len(frame), "part": frame["part"].to_numpy(), "start": starts})

    last = read.groupBy("conv", "part").agg(F.max_by("after", "pos").alias("after"))
    starts = written(last.groupBy("conv").applyInPandas(forward, f"conv {kind}, part bigint, start int"))
    starts = starts.select(F.col("conv").alias("c"), F.col("part").alias("p"), "start")
    chosen = read.join(starts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    chosen = chosen.select(F.col("pos").alias("at"), F.get("letters", F.col("start")).alias("edits"))
    whole = dealt.join(chosen, F.col("pos") == F.col("at")).select("conv", "pos", "turn", "role", "text", "copies", "fault", "edits")
    return whole.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_streamed, f"conv {kind}, {RESULT}")


class _Repair:
    """One conversation whose rows come in order."""

    def __init__(self):
        self.count, self.illegal, self.cost, self.audit, self.state = [0] * 4, 0, 0, [], 0
        self.digest, self.started, self.previous = hashlib.sha256(), False, None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int, edits_: str) -> None:
        initial = role[:1] or "-"
        self.illegal += (self.previous is not None and self.previous + initial not in LEGAL) + (copies - 1) * (2 * initial not in LEGAL)
        self.previous = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.count[fault] += 1
        self.count[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        self.write(edits_, iter([(role, text)]))
        self.cost += DELETE * (copies - 1) + (TRUNCATED if fault == CUT and edits_[-1] != "D" else 0)
        self.audit.append("D" * (copies - 1))

    def write(self, edits_: str, rows: Iterator[tuple[str, str]]) -> None:
        price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
        self.cost += sum(price[edit] for edit in edits_)
        self.audit.append(edits_)
        for turn in repaired(edits_, rows, self.state):
            self.digest.update((("\n" if self.started else "") + turn).encode())
            self.started, self.state = True, AFTER[turn[0]]

    def result(self) -> tuple:
        self.write("I" * AT_END[self.state], iter(()))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        counts = (gaps, self.count[BLANK], self.count[DUPLICATE], self.count[CUT], self.illegal, self.cost)
        return *counts, "".join(self.audit), self.digest.hexdigest()


def _streamed(batches):
    """One row for each conversation of rows that come sorted by conversation and place."""
    own, repair, kind = None, None, None
    for batch in batches:
        kind = batch.column(0).type
        for conv, _, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if repair is None or conv != own:
                if repair is not None:
                    yield _batch([pa.array([own], kind)], [repair.result()])
                own, repair = conv, _Repair()
            repair.add(*row)
    if repair is not None:
        yield _batch([pa.array([own], kind)], [repair.result()])


def repair_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 4096
) -> DataFrame:
    """One row for each id of rows: id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The rows are damaged first by the remainder of their names' checksum.  A null id is an id; a null turn comes first and
    is no gap; a null role or text is one space.  Rows of one turn are taken by role, then text, so repeated rows are
    neighbours, and the later ones duplicates.  A role that begins with none of s, u and a can't be kept.  An empty table
    gives no rows.  Other columns are not read, so their names can't clash.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    long = rows.groupBy(F.col(id_col).alias("own")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("own")
    long = written(long)
    all_rows = damaged(rows, id_col, turn_col, role_col, text_col)
    same = F.col("conv").eqNullSafe(F.col("own"))
    if long.isEmpty():
        found = _short(all_rows, kind)
    else:
        repairs = _long(all_rows.join(long, same, "left_semi"), kind)
        repairs = long.join(repairs, same, "left").drop("conv").withColumnRenamed("own", "conv")
        nothing = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in COUNTS}
        nothing |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
        found = _short(all_rows.join(long, same, "left_anti"), kind).unionByName(repairs.withColumns(nothing))
    return found.withColumnRenamed("conv", id_col)
