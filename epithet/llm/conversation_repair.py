"""Conversation structure repair: the cheapest edits that give a legal order of roles.

A conversation is a string of symbols, one for each row: the role's initial and the row's fault.  A row
is a 4 x 4 matrix of costs over the states of the order of roles (min-plus algebra); equal consecutive
symbols are one run, whose matrix is a product of cached binary powers.  Costs to the end are carried
back over the runs; the edits are then unrolled forward, taking the first letter in ASCII order that
still leads to the least cost.

Rows move in two shuffles by conversation: one without texts (symbols, to the edits), one with texts
(edits, to the repaired rows).  Both are read as sorted streams, so a conversation of any length needs
the memory of its runs and edits, not of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epithet.llm.common import in_slices, stage

# Blanks, sentence ends, edit costs.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NAMES = {"u": "user", "a": "assistant"}

# States: nothing yet, after a system row, after a user row, after an assistant row.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GROWS = (("u", AFTER_U), ("u", AFTER_U), ("a", AFTER_A), ("u", AFTER_U))  # what may follow, besides s
LEGAL_END = (START, AFTER_A)
FAR = 1 << 60

# A symbol is 2 * role + truncated, or MUST_GO.
ROLES = "sua"
MUST_GO = 8


def symbol(initial: str, truncated: bool) -> int:
    return 2 * (ROLES.find(initial) if initial in ROLES and initial else 3) + truncated


def kept_state(sym: int, state: int) -> int | None:
    """State after a row of this symbol is kept, if it may be."""
    if sym == MUST_GO or sym // 2 == 3:
        return None
    initial = ROLES[sym // 2]
    if initial == "s":
        return AFTER_S if state == START else None
    letter, after = GROWS[state]
    return after if letter == initial else None


# --- min-plus algebra -------------------------------------------------------


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def _inserts() -> np.ndarray:
    """Costs of any number of inserted rows."""
    one = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(one, 0)
    for state, (_, after) in enumerate(GROWS):
        one[state, after] = INSERT
    return reduce(product, [one] * 4)


INSERTS = _inserts()
TO_END = np.minimum(INSERTS[:, list(LEGAL_END)].min(1), FAR)


def _row(sym: int) -> np.ndarray:
    """Costs of inserts and one row of this symbol."""
    edit = np.full((4, 4), FAR, np.int64)
    for state, (_, grown) in enumerate(GROWS):
        edit[state, state] = DELETE
        if sym != MUST_GO:
            more = TRUNCATED * (sym % 2)
            edit[state, grown] = min(edit[state, grown], REROLE + more)
            if (after := kept_state(sym, state)) is not None:
                edit[state, after] = min(edit[state, after], more)
    return product(INSERTS, edit)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def power(sym: int, k: int) -> np.ndarray:
    """The matrix of 2 ** k rows of a symbol, made once."""
    if (sym, k) not in _POWERS:
        _POWERS[sym, k] = product(power(sym, k - 1), power(sym, k - 1)) if k else _row(sym)
    return _POWERS[sym, k]


def back(sym: int, count: int, costs: np.ndarray) -> np.ndarray:
    """Costs to the end before ``count`` rows of a symbol, from those after them."""
    k = 0
    while count:
        if count & 1:
            costs = np.minimum((power(sym, k) + costs[None, :]).min(1), FAR)
        count >>= 1
        k += 1
    return costs


CHUNK = 4096


def _letters(runs: Sequence[tuple[int, int]]) -> tuple[int, str]:
    after = [TO_END]  # costs to the end after each run, from the last one back
    for sym, count in reversed(runs):
        after.append(back(sym, count, after[-1]))
    cost = int(after[-1][START])
    state, out = START, bytearray()
    after.reverse()
    for (sym, count), end in zip(runs, after[1:], strict=True):
        more, forced = TRUNCATED * (sym % 2), sym == MUST_GO
        while count:
            size = min(count, CHUNK)
            count -= size
            steps = [back(sym, count, end)]
            for _ in range(size):
                steps.append(back(sym, 1, steps[-1]))
            table = [s.tolist() for s in reversed(steps)]
            for here, following in zip(table, table[1:], strict=False):
                while True:
                    least, grown = here[state], GROWS[state][1]
                    if DELETE + following[state] == least:
                        out += b"D"
                    elif INSERT + here[grown] == least:
                        out += b"I"
                        state = grown
                        continue
                    elif (
                        not forced
                        and (kept := kept_state(sym, state)) is not None
                        and more + following[kept] == least
                    ):
                        out += b"K"
                        state = kept
                    else:
                        out += b"R"
                        state = grown
                    break
    while state not in LEGAL_END:
        out += b"I"
        state = GROWS[state][1]
    return cost, out.decode()


_KNOWN: dict[tuple, tuple[int, str]] = {}


def cheapest(runs: Sequence[tuple[int, int]]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of (symbol, count) runs; ASCII-least among equals.

    Those of short conversations are kept, up to a fixed number.
    """
    key = tuple(runs)
    if sum(count for _, count in key) > 32:
        return _letters(key)
    if key not in _KNOWN:
        if len(_KNOWN) >= 1 << 14:
            _KNOWN.clear()
        _KNOWN[key] = _letters(key)
    return _KNOWN[key]


# --- rows -------------------------------------------------------------------


def _named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with faults, the kind of fault from a checksum.

    Nulls are one space (the turn stays null for the order).  A dropped row stays with ``gone`` set, so
    that no conversation is lost.
    """
    kind = F.crc32(F.concat(_named("conv_id"), F.lit(":"), _named("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_named("text"), ENDS, "")).otherwise(_named("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(_named("role")).alias("role"),
        F.when(kind != 0, text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _keyed(turns: DataFrame) -> DataFrame:
    """With ``mark``, a digest of role and text: rows of one turn are ordered by role and mark."""
    spelled = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return turns.select("conv_id", "turn", "role", "text", "gone", F.unhex(F.sha2(spelled, 256)).alias("mark"))


ORDER = ("turn", "role", "mark")  # nulls first, as Spark sorts


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, fault, gone) in the order of each conversation, without texts.

    The first fault counts: blank, duplicate (role and text seen earlier), truncated.  One shuffle by
    conversation serves the search for duplicates and the order.
    """
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = _keyed(turns).select(
        "conv_id",
        *ORDER,
        "gone",
        F.substring("role", 1, 1).alias("initial"),
        (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(*ENDS)).alias("open"),
    )
    earlier = F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), "blank").when(earlier, "duplicate").when(F.col("open"), "truncated").otherwise("")
    placed = light.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions("conv_id", *ORDER)
    return placed.select("conv_id", "turn", "initial", "fault", "gone")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Reading:
    """What a conversation's rows say, one at a time."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int]] = []
        self.first = self.last = self.before = None
        self.distinct = self.illegal = 0
        self.found = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def add(self, turn: int | None, initial: str, fault: str, gone: bool) -> None:
        if gone:
            return
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault:
            self.found[fault] += 1
        sym = MUST_GO if fault in ("blank", "duplicate") else symbol(initial, fault == "truncated")
        if self.runs and self.runs[-1][0] == sym:
            self.runs[-1] = (sym, self.runs[-1][1] + 1)
        else:
            self.runs.append((sym, 1))

    def row(self) -> tuple:
        cost, audit = cheapest(self.runs)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.found.values(), self.illegal, cost, audit


def _by_conversation(
    batches: Iterator[pa.RecordBatch], names: Sequence[str], begin, fields: list[tuple[str, pa.DataType]]
) -> Iterator[pa.RecordBatch]:
    """Rows of sorted batches fed to one object a conversation; yields the row that each makes."""
    none = object()
    key, current, kind = none, None, None
    done: list[tuple] = []

    def made() -> pa.RecordBatch:
        types = [kind, *(t for _, t in fields)]
        columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *(n for n, _ in fields)])

    for batch in batches:
        kind = batch["conv_id"].type
        for conv, *values in zip(*(batch[c].to_pylist() for c in ("conv_id", *names)), strict=True):
            if key is none or conv != key:
                if current is not None:
                    done.append((key, *current.row()))
                key, current = conv, begin()
            current.add(*values)
        if done:
            yield made()
            done = []
    if current is not None:
        done = [(key, *current.row())]
        yield made()


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation its counts, the least cost of its repair and the edits (K, R, D, I in order)."""
    rows = faults(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [*((c, pa.int64()) for c in COUNTS), ("audit", pa.string())]
        return _by_conversation(batches, ("turn", "initial", "fault", "gone"), _Reading, fields)

    return rows.mapInArrow(apply, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired rows, in order within partitions.

    ``found`` is what ``audits`` gave for the same rows.
    """
    rows = _keyed(turns).where("not gone")
    kind = rows.schema["conv_id"].dataType.simpleString()
    body = rows.select("conv_id", F.lit(1).alias("kind"), *ORDER, "text", F.lit(None).cast("string").alias("audit"))
    null = F.lit(None)
    head = found.select(
        "conv_id",
        F.lit(0).alias("kind"),
        null.cast(rows.schema["turn"].dataType).alias("turn"),
        null.cast("string").alias("role"),
        null.cast("binary").alias("mark"),
        null.cast("string").alias("text"),
        "audit",
    )
    merged = head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, START, 0
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal place
            out.append((conv, place, role, text))
            place += 1

        for batch in in_slices(batches, 1024):
            columns = (batch[c].to_pylist() for c in ("conv_id", "kind", "role", "text", "audit"))
            for conv, is_row, role, text, letters in zip(*columns, strict=True):
                if not is_row:
                    audit, at, state, place = letters, 0, START, 0
                else:
                    edit = audit[at]
                    at += 1
                    if edit == "R":
                        letter, state = GROWS[state]
                        put(NAMES[letter], text)
                    elif edit == "K":
                        state = AFTER_S if role[0] == "s" else GROWS[state][1]
                        put(role, text)
                while at < len(audit) and audit[at] == "I":
                    letter, state = GROWS[state]
                    put(NAMES[letter], "")
                    at += 1
            if out:
                types = (batch["conv_id"].type, pa.int64(), pa.string(), pa.string())
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(made, ["conv_id", "place", "role", "text"])
                out.clear()

    return merged.mapInArrow(apply, f"conv_id {kind}, place bigint, role string, text string")


class _Digest:
    """Digest of a conversation's rows, a line each."""

    def __init__(self) -> None:
        self.sha, self.between = hashlib.sha256(), b""

    def add(self, role: str, text: str) -> None:
        self.sha.update(self.between + f"{role}:{text}".encode())
        self.between = b"\n"

    def row(self) -> tuple:
        return (self.sha.hexdigest(),)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows that ``repaired`` gave: one pass over each conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_conversation(batches, ("role", "text"), _Digest, [("repaired_sha256", pa.string())])

    return rows.mapInArrow(apply, f"conv_id {kind}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, audit and digest of the repair of every conversation.

    Null values are one space; rows of one turn are ordered by role and digest; equal rows that stand
    several times are duplicates; a null conv_id is a conversation of its own.  A conversation without
    rows after damage has zeros, no edits and the digest of the empty string.  Columns other than
    conv_id, turn, role and text are ignored; an empty table gives no rows.
    """
    turns = damage(conversations)
    found = stage(audits(turns), "repair-audits")
    made = digests(repaired(turns, found)).withColumnRenamed("conv_id", "__conv")
    joined = found.join(made, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
