"""Chat formatting at token level: segments encoded one by one, reserved ids between them.

The template of a turn is ``### Role: text </turn>\\n``. Role heads and turn ends are single
reserved ids beyond the vocabulary; contents are encoded as ordinary text by a lossless
byte-level tokenizer, whose strings of special tokens are ordinary text as well; runs of
white space beyond ``LONG_SPACE`` characters are encoded in pieces of that length. Backslashes and control strings inside contents are escaped, so that
the formatted string can be read back as well. The loss mask covers the contents of
assistant turns; it is the prefix sum of +1 where one begins and -1 where it ends.

Rows: null texts and roles are empty; turns go by turn number (null first), then role, then
text; repeated rows are turns of their own; rows with a null conv_id form one conversation;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import importable, own_columns

#: Fixed values of the template.
HEADS = {"user": "### User: ", "assistant": "### Assistant: ", "system": "### System: "}
OTHER_HEAD, OTHER_HEAD_END = "### Role ", ": "
TURN_END = " </turn>\n"
CONTROL = re.compile(r"\\|### (?=User:|Assistant:|System:|Role )|</turn>")
#: Reserved ids, counted from the end of the vocabulary.
RESERVED = (*HEADS.values(), OTHER_HEAD, OTHER_HEAD_END, TURN_END)
#: How a byte-level vocabulary of this kind splits texts into words (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The tokenizer's pattern search fails on much longer runs of white space.
LONG_SPACE = 4096
_CUT = re.compile(r"(\s{%d})" % LONG_SPACE)
#: A conversation is written in rows of about so many ids; a turn is never cut.
CHUNK_IDS = 1 << 20
DECODED = (
    "conv_id bigint, chunk bigint, n_turns bigint, turns binary, lost binary, loss_chars bigint, formatted_chars bigint"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
FORMATTED = "conv_id bigint, chunk bigint, n_turns bigint, input_ids array<int>, loss_mask array<tinyint>, formatted string"


def tokenizer_file() -> str:
    """A lossless byte-level vocabulary of ranked tokens, as the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def escape(text: str) -> str:
    """Double every backslash and put one inside every control string."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Template:
    """Assemble conversations from token segments and read them back."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokenizer = tiktoken.Encoding("chat", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.ids = {s: self.first + i for i, s in enumerate(RESERVED)}
        self.roles = {self.ids[h]: r for r, h in HEADS.items()}

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_SPACE:
            return self.tokenizer.encode_ordinary(text)
        return [i for part in _CUT.split(text) for i in self.tokenizer.encode_ordinary(part)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, with its escapes undone."""
        return unescape(self.tokenizer.decode_bytes(ids.tolist()).decode())

    def turns(self, rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, str]:
        """input_ids, loss_mask and formatted string of (role, text) turns."""
        ids: list[int] = []
        opens, closes, strings = [], [], []
        for role, text in rows:
            head, content = HEADS.get(role), escape(text)
            if head:
                ids.append(self.ids[head])
                strings.append(head)
            else:
                name = escape(role)
                ids += [self.ids[OTHER_HEAD], *self.encode(name), self.ids[OTHER_HEAD_END]]
                strings += [OTHER_HEAD, name, OTHER_HEAD_END]
            begin = len(ids)
            ids += self.encode(content)
            if role == "assistant":
                opens.append(begin)
                closes.append(len(ids))
            ids.append(self.ids[TURN_END])
            strings += [content, TURN_END]
        steps = np.zeros(len(ids) + 1, dtype=np.int8)
        np.add.at(steps, opens, 1)
        np.add.at(steps, closes, -1)
        return np.array(ids, dtype=np.int32), np.cumsum(steps[:-1], dtype=np.int8), "".join(strings)

    def read(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn."""
        role, begin = None, 0
        for at in np.flatnonzero(ids >= self.first).tolist():
            i = int(ids[at])
            if i in self.roles:
                role = self.roles[i]
            elif i == self.ids[OTHER_HEAD_END]:
                role = self.decode(ids[begin:at])
            elif i == self.ids[TURN_END]:
                yield role, self.decode(ids[begin:at])
            begin = at + 1


@lru_cache(maxsize=1)
def template_of(path: str) -> Template:
    """The template of this worker, kept from task to task."""
    return Template(path)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Rows of a stream sorted by its first column, each with a mark where a new key begins."""
    last: object = _conversations  # equal to no key
    for batch in batches:
        for row in zip(*map(_values, batch.columns)):
            yield row[0] != last, row
            last = row[0]


def _values(column: pa.Array) -> Iterator | list:
    """Python values of a column; lists, which are never null here, as numpy arrays."""
    if pa.types.is_list(column.type):
        return (x.values.to_numpy() for x in column)
    return column.to_pylist()


def format_conversations(rows: DataFrame, tokenizer: str, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """conv_id, chunk, n_turns, input_ids, loss_mask and formatted string, in turn order.

    Turns are range-sorted by conversation and turn and streamed: a task holds one chunk,
    and a conversation with a third of all turns is spread over as many tasks. Chunk
    numbers ascend within a conversation, with gaps where it goes on in the next task.
    """
    importable(rows.sparkSession)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, conv, turns, size = template_of(tokenizer), None, [], 0
        first = chunk = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids, mask, formatted = template.turns(turns)
            lists = lambda a: pa.array([a], pa.list_(pa.from_numpy_dtype(a.dtype)))
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([chunk]), pa.array([len(turns)]), lists(ids), lists(mask),
                 pa.array([formatted], pa.string())],
                ["conv_id", "chunk", "n_turns", "input_ids", "loss_mask", "formatted"],
            )

        out: list[pa.RecordBatch] = []
        for new, (key, role, text) in _conversations(batches):
            if turns and (new or size >= chunk_ids):
                out.append(flush())
                chunk, turns, size = first if new else chunk + 1, [], 0
                if len(out) >= 500 or not new:
                    yield from _together(out)
                    out = []
            conv = key
            turns.append((role or "", text or ""))
            size += len(text or "") + 8
        if turns:
            out.append(flush())
        yield from _together(out)

    own = own_columns(rows, "conv_id", "turn", "role", "text")
    return (
        own.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(F.col("conv_id").cast("bigint"), "role", "text").mapInArrow(assemble, FORMATTED)
    )


def _together(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if batches:
        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation, computed from the written ids and masks alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and
    loss_sha256 (unescaped text under the mask), formatted_chars (code points). Chunks are
    decoded where they lie; a digest takes them in order, so the decoded texts of one
    conversation stream through one task, a chunk at a time.
    """
    importable(formatted.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = template_of(tokenizer)
        for batch in batches:
            out = []
            for conv, chunk, ids, mask, text in zip(*map(_values, batch.columns)):
                turns = [f"{role}\n{content}\n" for role, content in template.read(ids)]
                lost = template.decode(ids[mask == 1])
                out.append((conv, chunk, len(turns), "".join(turns).encode(), lost.encode(), len(lost), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _names(DECODED))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def done() -> None:
            if state:
                conv, n, turns, chars, loss, formatted_chars = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _names(DIGESTS))

        for new, (conv, n, turns, lost, lost_chars, chars) in _conversations(batches):
            if new:
                done()
                if len(out) >= 10_000:
                    yield batch_of()
                    out = []
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += n
            state[2].update(turns)
            state[3] += lost_chars
            state[4].update(lost)
            state[5] += chars
        done()
        if out:
            yield batch_of()

    return (
        formatted.select("conv_id", "chunk", "input_ids", "loss_mask", "formatted").mapInArrow(decode, DECODED)
        .repartition("conv_id").sortWithinPartitions("conv_id", "chunk").drop("chunk")
        .mapInArrow(digest, DIGESTS)
    )


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]
