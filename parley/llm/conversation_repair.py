"""Cheapest repair of conversations, by a Viterbi search whose chunks run in parallel.

Roles of a sound conversation, by their first letters, read ``(s?(ua)+)?``. A row may be kept at no
cost (``K``), get the role user or assistant (``R``, 3), or be deleted (``D``, 4), and empty rows of
either role may be inserted anywhere (``I``, 3); blank and repeated rows must be deleted, and rows
that break off cost 3 more unless they are. The audit is the least text of edits among the cheapest.

The search knows four states: nothing yet, after a system row, after a user's, after an assistant's.
It runs from the end: the cost vector before a row follows from that after it. Rows are sorted over
all partitions and cut into lanes of bounded size, and all lanes run at once:

1. a lane that does not end its conversation starts from a speculative vector;
2. fix-up passes compare what a lane started from with what the next lane found. If they differ, the
   lane runs again from its end, until its vector differs from the stored one by a constant only;
   all before it then holds as it is. Vectors are stored less their least cost, so that constants
   vanish, and the constants are summed beside them. Passes end when nothing differs;
3. the traces run forward over the stitched costs, a lane's from the state in which the one before it
   ends; that state too is guessed first and corrected by passes.

Few passes do in practice, as a row or two of known role make the vectors equal; any number is right.

Only one byte of a row takes part in this. Texts are read twice, to be sorted, and as a stream per
conversation for the digest of what is left, so the longest conversation needs no memory.

Defined cases: nulls count as one space; conversations without id are one conversation; rows of one
turn are ordered by role and digest of the text; roles of other letters are never sound, but may be
replaced; an empty table gives no rows, a conversation of which no row is left an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from parley.session import cut

LANE_BITS = 10
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
OK, BLANK, REPEATED, CUT_OFF = range(4)
ROLES = "sua"  # anything else is 3
NEXT = np.array([2, 2, 3, 2])  # state after the role that a state asks for
ASKED = ("user", "user", "assistant", "user")
END = np.array([0, 2 * INSERT, INSERT, 0])  # states 0 and 3 may end
GUESS = END
NEVER = 200
WORD = r"[^\x20\x09-\x0D]"

# edits of a row as a byte: inserts before it, the state before them times 4, the letter times 16
LETTERS = "DKR"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the checksum of a row's place tells."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    hurt = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("k"))
    return hurt.where("k <> 0").select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("n"))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows in order over all partitions; ``mark`` tells partition and place in it."""
    text = F.col("text")
    keyed = rows.select(_key(F.col("conv_id")).alias("conv"), "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    return cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("mark", F.monotonically_increasing_id())
               .withColumn("blank", ~text.rlike(WORD))
               .withColumn("broken", ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")))


def _lanes(placed: DataFrame, bits: int) -> DataFrame:
    """``conv, lane, lanes, at, codes``: runs of at most 2**bits rows of a conversation.

    A code is a letter for role and fault. The first of equal rows is found by its place, combined
    before the shuffle, and matched on the place, so a text of many copies makes no large task.
    """
    firsts = placed.where("not blank").groupBy("conv", "role", "digest").agg(F.min("mark").alias("mark"))
    small = placed.select("conv", "mark", "role", "blank", "broken").join(
        firsts.select("mark", F.lit(True).alias("first")), "mark", "left")
    fault = (F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), REPEATED)
             .when(F.col("broken"), CUT_OFF).otherwise(OK))
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))
    role = F.when((initial == 0) | (F.col("role") == ""), 3).otherwise(initial - 1)
    coded = small.select("conv", "mark", F.substring(F.lit("ABCDEFGHIJKLMNOP"), role * 4 + fault + 1, F.lit(1)).alias("code"))
    lanes = coded.groupBy("conv", F.shiftright("mark", bits).alias("block")).agg(
        F.min("mark").alias("at"), F.array_sort(F.collect_list(F.struct("mark", "code"))).alias("rows"))
    each = Window.partitionBy("conv")
    return lanes.select(
        "conv", "at", F.array_join("rows.code", "").alias("codes"),
        F.row_number().over(each.orderBy("at")).alias("lane"), F.count("*").over(each).alias("lanes"))


class Lanes:
    """Lanes of one batch side by side."""

    def __init__(self, codes: list[str]):
        self.n = np.array([len(c) for c in codes], np.int64)
        self.codes = np.frombuffer("".join(codes).encode(), np.uint8) - 65
        self.at = np.cumsum(self.n) - self.n
        self.vector_at = self.at + np.arange(len(codes))
        self.costs = np.full((len(self.codes) + len(codes), 4), 255, np.int64)
        self.shifts = np.zeros(len(self.codes), np.int64)

    def load(self, stored: list[bytes]) -> None:
        """Costs as :meth:`dump` gives them."""
        for i, raw in enumerate(stored):
            raw = np.frombuffer(raw, np.uint8)
            n = self.n[i]
            v = self.vector_at[i]
            self.costs[v:v + n + 1] = raw[:4 * (n + 1)].reshape(-1, 4)
            self.shifts[self.at[i]:self.at[i] + n] = raw[4 * (n + 1):]

    def dump(self) -> list[bytes]:
        costs, shifts = self.costs.astype(np.uint8), self.shifts.astype(np.uint8)
        return [costs[v:v + n + 1].tobytes() + shifts[a:a + n].tobytes()
                for v, a, n in zip(self.vector_at, self.at, self.n)]

    def backward(self, ends: np.ndarray, which: np.ndarray) -> None:
        """Costs of the lanes ``which`` from their end vectors, up to where the stored ones return."""
        live, after = which, ends.astype(np.int64)
        self.costs[self.vector_at[live] + self.n[live]] = after
        back = 1
        while True:
            going = self.n[live] >= back
            live, after = live[going], after[going]
            if not len(live):
                return
            place = self.n[live] - back
            before, shift = _step(after, self.codes[self.at[live] + place])
            same = (self.costs[self.vector_at[live] + place] == before).all(axis=1)
            self.costs[self.vector_at[live] + place] = before
            self.shifts[self.at[live] + place] = shift
            live, after = live[~same], before[~same]
            back += 1

    def forward(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edits of all rows, and the state in which each lane ends, from the states they begin in."""
        edits, state = np.zeros(len(self.codes), np.uint8), entries.astype(np.int64).copy()
        for place in range(int(self.n.max(initial=0))):
            live = np.flatnonzero(self.n > place)
            v = self.vector_at[live] + place
            now, after = self.costs[v], self.costs[v + 1]
            code, shift = self.codes[self.at[live] + place], self.shifts[self.at[live] + place]
            each = np.arange(len(live))
            s = state[live]
            edit = s * 4
            while True:
                delete = DELETE + after[each, s] == now[each, s] + shift
                insert = ~delete & (INSERT + now[each, NEXT[s]] == now[each, s])
                if not insert.any():
                    break
                edit[insert] += 1
                s = np.where(insert, NEXT[s], s)
            keep_to, keep_cost = _kept(code, s)
            keep = ~delete & (keep_cost + after[each, keep_to] == now[each, s] + shift)
            edit += 16 * np.where(delete, 0, np.where(keep, 1, 2))
            state[live] = np.where(delete, s, np.where(keep, keep_to, NEXT[s]))
            edits[self.at[live] + place] = edit
        return edits, state

    def texts(self, flat: np.ndarray) -> list[bytes]:
        return [flat[a:a + n].tobytes() for a, n in zip(self.at, self.n)]


def _kept(code: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State after a row that is kept as it is, and the cost; ``NEVER`` where that may not be."""
    role, fault = code >> 2, code & 3
    fits = np.where(role == 0, state == 0, np.where(role == 1, state != 2, (role == 2) & (state == 2)))
    fits &= (fault == OK) | (fault == CUT_OFF)
    return np.where(role < 3, role + 1, 0), np.where(fits, KEEP + BROKEN * (fault == CUT_OFF), NEVER)


def _step(after: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs before a row from those after it, less their least, and that least."""
    fault = code & 3
    more = BROKEN * (fault == CUT_OFF) + NEVER * ((fault == BLANK) | (fault == REPEATED))
    before = DELETE + after
    for s in range(4):
        to, cost = _kept(code, np.full(len(code), s))
        before[:, s] = np.minimum(before[:, s], np.minimum(
            cost + after[np.arange(len(code)), to], REROLE + more + after[:, NEXT[s]]))
    user, assistant = before[:, 2].copy(), before[:, 3].copy()
    before[:, 2] = np.minimum(user, INSERT + assistant)
    before[:, 3] = np.minimum(assistant, INSERT + user)
    for s in (0, 1):
        before[:, s] = np.minimum(before[:, s], INSERT + before[:, 2])
    least = before.min(axis=1)
    return before - least[:, None], least


def _over_lanes(lanes: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """``lanes`` with columns replaced or added by ``compute``."""
    added = StructType.fromDDL(fields)
    kept = [f for f in lanes.schema.fields if f.name not in added.names]
    schema = StructType(kept + [StructField(f.name, f.dataType) for f in added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = compute(batch)
            yield pa.RecordBatch.from_arrays(
                [batch[f.name] if f.name not in found else pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return lanes.mapInArrow(run, schema)


def _first_costs(batch: pa.RecordBatch) -> dict[str, list]:
    lanes = Lanes(batch["codes"].to_pylist())
    last = np.array(batch["lane"].to_pylist()) == np.array(batch["lanes"].to_pylist())
    ends = np.where(last[:, None], END, GUESS)
    lanes.backward(ends, np.arange(len(ends)))
    return {"costs": lanes.dump(), "used": [bytes(e) for e in ends.astype(np.uint8)]}


def _again(batch: pa.RecordBatch) -> dict[str, list]:
    lanes = Lanes(batch["codes"].to_pylist())
    lanes.load(batch["costs"].to_pylist())
    used, found = batch["used"].to_pylist(), batch["found"].to_pylist()
    wrong = [i for i, (a, b) in enumerate(zip(used, found)) if b is not None and a != b]
    if wrong:
        ends = np.array([list(found[i]) for i in wrong])
        lanes.backward(ends, np.array(wrong))
    return {"costs": lanes.dump(), "used": [u if f is None else f for u, f in zip(used, found)]}


def _first_trace(batch: pa.RecordBatch) -> dict[str, list]:
    entries = np.where(np.array(batch["lane"].to_pylist()) == 1, 0, 3)
    return _trace(batch, entries)


def _trace_again(batch: pa.RecordBatch) -> dict[str, list]:
    found = [e if f is None else f for e, f in zip(batch["entry"].to_pylist(), batch["found"].to_pylist())]
    return _trace(batch, np.array(found, np.int64))


def _trace(batch: pa.RecordBatch, entries: np.ndarray) -> dict[str, list]:
    lanes = Lanes(batch["codes"].to_pylist())
    lanes.load(batch["costs"].to_pylist())
    edits, ends = lanes.forward(entries)
    first = lanes.costs[lanes.vector_at, 0] * (np.array(batch["lane"].to_pylist()) == 1)
    sums = np.add.reduceat(np.r_[lanes.shifts, 0], lanes.at) if len(lanes.at) else np.zeros(0, np.int64)
    return {"edits": lanes.texts(edits), "entry": entries.tolist(), "leaves": ends.tolist(),
            "cost": (first + sums).tolist()}


def _until_agreed(lanes: DataFrame, used: str, given: Column, neighbour: int,
                  again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fix-up passes: until each lane used what its neighbour ``lane + neighbour`` gives."""
    while True:
        gives = lanes.select("conv", (F.col("lane") - neighbour).alias("lane"), given.alias("found"))
        beside = cut(lanes.join(gives, ["conv", "lane"], "left"))
        if beside.where(F.col("found") != F.col(used)).isEmpty():
            return beside.drop("found")
        lanes = cut(again(beside).drop("found"))


def edits(rows: DataFrame, bits: int = LANE_BITS) -> tuple[DataFrame, DataFrame]:
    """(sorted rows, lanes with ``edits, cost, entry, leaves``) of the cheapest repair."""
    placed = _sorted_rows(rows)
    lanes = cut(_over_lanes(_lanes(placed, bits), "costs binary, used binary", _first_costs))
    long = lanes.where("lanes > 1")
    trace = "edits binary, entry int, leaves int, cost long"
    if long.isEmpty():
        return placed, _over_lanes(lanes, trace, _first_trace)
    long = _until_agreed(long, "used", F.substring("costs", 1, 4), 1,
                         lambda df: _over_lanes(df, "costs binary, used binary", _again))
    long = _until_agreed(cut(_over_lanes(long, trace, _first_trace)), "entry", F.col("leaves"), -1,
                         lambda df: _over_lanes(df, trace, _trace_again))
    short = _over_lanes(lanes.where("lanes = 1"), trace, _first_trace)
    return placed, short.unionByName(long)


class _Report:
    """What is said of one conversation, from its lanes and rows in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults = [0, 0, 0, 0]
        self.turns, self.low, self.high = 0, None, None
        self.illegal, self.role, self.cost, self.state = 0, None, 0, 0
        self.audit, self.hash, self.lines = [], hashlib.sha256(), 0

    def lane(self, codes: str, plan: bytes, cost: int, leaves: int) -> None:
        self.plan, self.at = plan, 0
        self.cost += cost
        self.state = leaves
        for code in codes.encode():
            role, fault = code - 65 >> 2, code - 65 & 3
            self.faults[fault] += 1
            if self.role is not None and (self.role, role) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
            self.role = role

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def insert(self, state: int, times: int) -> int:
        for _ in range(times):
            self.audit.append("I")
            self.line(ASKED[state], "")
            state = int(NEXT[state])
        return state

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        edit = self.plan[self.at]
        self.at += 1
        state = self.insert(edit >> 2 & 3, edit & 3)
        letter = LETTERS[edit >> 4]
        self.audit.append(letter)
        if letter != "D":
            self.line(role if letter == "K" else ASKED[state], text)

    def values(self) -> tuple:
        self.insert(self.state, int(END[self.state]) // INSERT)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def repaired(conversations: DataFrame, bits: int = LANE_BITS) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest repair, and the digest of the result."""
    placed, lanes = edits(damaged(conversations), bits)
    known = conversations.select("conv_id").distinct()
    schema = StructType([conversations.schema["conv_id"], *StructType.fromDDL(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string").fields])
    arrow = to_arrow_schema(schema)
    nothing = {"conv_id": F.lit(None).cast(schema["conv_id"].dataType), "turn": F.lit(None).cast("long"),
               "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"),
               "edits": F.lit(None).cast("binary"), "cost": F.lit(None).cast("long"), "leaves": F.lit(None).cast("int")}

    def kind(df: DataFrame, number: int, mark: Column, **has: Column) -> DataFrame:
        values = nothing | has
        return df.select("conv", mark.alias("mark"), F.lit(number).alias("kind"),
                         *[values[c].alias(c) for c in nothing])

    c = F.col
    stream = kind(known.withColumn("conv", _key(c("conv_id"))), 0, F.lit(-1).cast("long"), conv_id=c("conv_id"))
    stream = stream.unionByName(kind(lanes, 1, c("at"), text=c("codes"), edits=c("edits"), cost=c("cost"), leaves=c("leaves")))
    stream = stream.unionByName(kind(placed, 2, c("mark"), turn=c("turn").cast("long"), role=c("role"), text=c("text")))

    names = ["kind", *nothing]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, done = None, []
        for batch in batches:
            columns = [batch[x].to_pylist() for x in names]
            for number, conv_id, turn, role, text, plan, cost, leaves in zip(*columns):
                if number == 0:
                    if report is not None:
                        done.append(report.values())
                    report = _Report(conv_id)
                elif number == 1:
                    report.lane(text, plan, cost, leaves)
                else:
                    report.row(turn, role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if report is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(report.values(), arrow)], schema=arrow)

    return stream.repartition("conv").sortWithinPartitions("conv", "mark", "kind").mapInArrow(run, schema)
