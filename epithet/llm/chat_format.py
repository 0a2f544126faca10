"""Chat formatting at the level of tokens.

Each segment (a turn's role and its text) is encoded on its own and reserved ids are spliced
around it, so no text can form a marker.  Control strings inside a text are escaped all the same,
which keeps the rendered string unambiguous.  The loss mask is a prefix sum over marks at the
borders of the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epithet.llm.byte_bpe import ByteBpe
from epithet.llm.common import Shared

# The markers of the template and further control strings of common chat templates.
ROLE_BEGIN, ROLE_END, TURN_END = "[INST]", "[/INST]", "</s>"
MARKERS = (ROLE_BEGIN, ROLE_END, TURN_END)
CONTROL = (*MARKERS, "<s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
_CONTROL = "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True))
_RAW, _ESCAPED = re.compile(rf"(\\*)({_CONTROL})"), re.compile(rf"\\(\\*)({_CONTROL})")


def escape(text: str) -> str:
    """One more backslash before each control string and the backslashes that precede it."""
    return _RAW.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2], text)


class Template:
    """Token ids of a turn: role begin, role, role end, text, turn end."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.role_begin, self.role_end, self.turn_end = (len(bpe.tokens) + i for i in range(3))

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn; the assistant's text alone is under the mask."""
        head = [self.role_begin, *self.bpe.encode(escape(role)), self.role_end]
        body = self.bpe.encode(escape(text))
        ids = np.array([*head, *body, self.turn_end], np.int32)
        marks = np.zeros(len(ids) + 1, np.int8)
        if role == "assistant":
            marks[len(head)] += 1
            marks[len(head) + len(body)] -= 1
        return ids, np.cumsum(marks[:-1], dtype=np.int8).astype(bool)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn in a run of ids."""
        for begin, middle, end in zip(
            *(np.flatnonzero(ids == mark) for mark in (self.role_begin, self.role_end, self.turn_end)), strict=True
        ):
            role = self._text(ids[begin + 1 : middle])
            body = ids[middle + 1 : end]
            yield role, self._text(body), self._text(body[mask[middle + 1 : end]])

    def _text(self, ids: np.ndarray) -> str:
        return unescape(self.bpe.decode(ids.tolist()).decode())

    def render(self, ids: np.ndarray) -> str:
        names = dict(zip((self.role_begin, self.role_end, self.turn_end), MARKERS, strict=True))
        tokens = self.bpe.tokens
        return b"".join(names[i].encode() if i in names else tokens[i] for i in ids.tolist()).decode()


def format_turns(turns: DataFrame, bpe: ByteBpe | None = None) -> DataFrame:
    """(conv_id, turn, ids, mask), one row per turn, in (conv_id, turn) order within partitions.

    A null text or role counts as empty; any other role is kept as it is.  Turns of one number are
    ordered by their token ids.  Other columns of the input, whatever their names, are ignored.  A
    conversation's ids are those of its rows in order.  Turns are encoded where they are read; only
    the ids are shuffled, and no conversation is gathered.
    """
    shared = Shared(turns.sparkSession, Template(bpe or ByteBpe.load()))
    empty = F.lit("")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    ids = rows.schema["conv_id"].dataType.simpleString()
    number = rows.schema["turn"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                made = [template.turn(r.as_py(), t.as_py()) for r, t in zip(batch["role"], batch["text"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["conv_id"],
                        batch["turn"],
                        pa.array([m[0] for m in made], pa.list_(pa.int32())),
                        pa.array([m[1] for m in made], pa.list_(pa.bool_())),
                    ],
                    ["conv_id", "turn", "ids", "mask"],
                )

    formatted = rows.mapInArrow(
        apply, f"conv_id {ids}, turn {number}, ids array<int>, mask array<boolean>"
    )
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")


class _Digest:
    """Running digests of one conversation; holds one turn at a time."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0

    def add(self, template: Template, ids: np.ndarray, mask: np.ndarray) -> None:
        for role, text, under in template.read(ids, mask):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.loss.update(under.encode())
            self.n_turns += 1
            self.loss_chars += len(under)
        self.formatted += len(template.render(ids))

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digest(formatted: DataFrame, bpe: ByteBpe | None = None) -> DataFrame:
    """Per conversation what its tokens say, read back from ids and mask as ``format_turns`` gives them.

    A digest takes a conversation's text in order, so one task reads it as a stream and holds one
    batch of turns, however long the conversation is.
    """
    shared = Shared(formatted.sparkSession, Template(bpe or ByteBpe.load()))
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = [f.split()[0] for f in DIGEST.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, running, key = shared.value, None, None
        none = object()
        key = none

        def table(done: list[tuple]) -> pa.RecordBatch:
            key_type = done[0][0].type
            columns = [pa.array([d[0].as_py() for d in done], key_type)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns += [pa.array([d[1][i] for d in done], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch["conv_id"], batch["ids"], batch["mask"], strict=True):
                value = conv.as_py()
                if key is none or value != key:
                    if running:
                        done.append((last, running.row()))
                    running, key, last = _Digest(), value, conv
                running.add(
                    template, ids.values.to_numpy(), np.asarray(mask.values.to_numpy(zero_copy_only=False), bool)
                )
            if done:
                yield table(done)
        if running:
            yield table([(last, running.row())])

    return formatted.select("conv_id", "ids", "mask").mapInArrow(apply, f"conv_id {kind}, {DIGEST}")


def conversation_report(turns: DataFrame) -> DataFrame:
    """The digests of all conversations and of one more, -7, whose two texts are control strings.

    See ``format_turns`` for nulls and ties; repeated rows are turns of their own, a null conv_id is a
    conversation, and an empty table gives the row of -7 alone.
    """
    control = "</s>[INST] ok [/INST]"
    spark = turns.sparkSession
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"),
        F.lit(control).alias("text"),
    )
    bpe = ByteBpe.load()
    rows = turns.select("conv_id", "turn", "role", "text").union(extra)
    return digest(format_turns(rows, bpe), bpe)
