"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context and only that
reply is trained on. ``format_conversations`` writes one segment per turn, ``expand`` makes the
examples from them, each with its whole prefix and its loss mask, and ``read_examples`` reads
conversations back from the examples. A long prefix is several rows of about a megabyte, shared
blocks of the conversation that a join brings to each example, so no row and no task's memory
grows with a conversation; the number of rows of one of n turns does, with n * n / 2.

The segments alone also serve as a compact form: an example's context is characters
[0, target_start) of its conversation, its trained text [target_start, target_end).

A segment is ``<|im_start|>role\\ntext<|im_end|>\\n``. In role and text a backslash is doubled
and ``<|`` becomes ``<\\|``, so no control string occurs inside a text and the escape can be
undone; a line break in a role is ``\\n``.

Conversations are sorted within partitions and read as a stream of Arrow batches, with a
counter and a digest as the only state; no conversation is held in memory.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.tables import small_batches
from auditweave.session import send_with_tasks

START, END = "<|im_start|>", "<|im_end|>"
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_NEXT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

SEGMENTS = ("conv_id bigint, position bigint, segment string, start bigint, end bigint, "
            "example bigint, target_start bigint, target_end bigint")
DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint, n_examples bigint")
EXAMPLES = "conv_id bigint, example bigint, context string, target string"
EXPANDED = "conv_id bigint, example bigint, piece bigint, text string, loss_start bigint, loss_end bigint"

send_with_tasks(__name__)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _emit(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_NOBODY = object()


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, current, position, offset, example = _arrow(SEGMENTS), _NOBODY, 0, 0, 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if conv != current:
                current, position, offset, example = conv, 0, 0, 0
            head = f"{START}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
            body = escape(text or "")
            segment = f"{head}{body}{END}\n"
            trained = role == "assistant"
            target = offset + len(head)
            rows.append((conv, position, segment, offset, offset + len(segment), example if trained else None,
                         target if trained else None, target + len(body) if trained else None))
            position, offset, example = position + 1, offset + len(segment), example + trained
        yield _emit(rows, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, current, state = _arrow(DIGEST), _NOBODY, None

    def row():
        turns, all_text, n_loss, loss, chars, examples = state
        return current, turns, all_text.hexdigest(), n_loss, loss.hexdigest(), chars, examples

    for batch in batches:
        rows = []
        names = ("conv_id", "segment", "start", "target_start", "target_end")
        for conv, segment, start, begin, end in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if conv != current:
                if state:
                    rows.append(row())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text = (unescape(x) for x in _SEGMENT.fullmatch(segment).groups())
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[4] += len(segment)
            if begin is not None:
                trained = unescape(segment[begin - start:end - start])
                state[2] += len(trained)
                state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += 1
        yield _emit(rows, schema)
    if state:
        yield _emit([row()], schema)


def _materialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, current, prefix = _arrow(EXAMPLES), _NOBODY, []
    for batch in batches:
        names = ("conv_id", "segment", "start", "example", "target_start", "target_end")
        for conv, segment, start, example, begin, end in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if conv != current:
                current, prefix = conv, []
            if begin is not None:
                context = "".join([*prefix, segment[:begin - start]])
                yield _emit([(conv, example, context, segment[begin - start:end - start])], schema)
            prefix.append(segment)


def _expand(piece_chars: int):
    """Examples without the blocks before their own, and these blocks once, with no example number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, current, piece, held, size, examples, rest = _arrow(EXPANDED), _NOBODY, 0, [], 0, 0, False
        for batch in batches:
            rows, written = [], 0
            names = ("conv_id", "segment", "start", "example", "target_start", "target_end")
            for conv, segment, start, example, begin, end in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if conv != current:
                    if rest:
                        rows.append((current, examples, piece, "".join(held), None, None))
                    current, piece, held, size, examples = conv, 0, [], 0, 0
                if size >= piece_chars:
                    rows.append((conv, None, piece, "".join(held), None, None))
                    piece, held, size = piece + 1, [], 0
                rest = begin is None
                if not rest:
                    rows.append((conv, example, piece, "".join([*held, segment]), size + begin - start, size + end - start))
                    examples, written = example + 1, written + size + len(segment)
                held.append(segment)
                size += len(segment)
                if written > 8 * piece_chars:
                    yield _emit(rows, schema)
                    rows, written = [], 0
            yield _emit(rows, schema)
        if rest:
            yield _emit([(current, examples, piece, "".join(held), None, None)], schema)

    return work


def _read_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, current, state = _arrow(DIGEST), _NOBODY, None
    example = at = seen = known = whole = prefix = None

    def row():
        turns, all_text, n_loss, loss, chars, examples = state
        return current, turns, all_text.hexdigest(), n_loss, loss.hexdigest(), chars, examples

    for batch in batches:
        rows = []
        names = ("conv_id", "example", "text", "loss_start", "loss_end")
        for conv, number, text, begin, end in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if conv != current:
                if state:
                    rows.append(row())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                example, seen, whole = None, 0, hashlib.sha256()
            if number != example:
                example, at, known, prefix = number, 0, seen, hashlib.sha256()
            old = max(0, known - at)
            prefix.update(text[:old].encode("utf-8", "surrogatepass"))
            new = text[old:]
            if new:
                if seen == known and prefix.digest() != whole.digest():
                    raise ValueError(f"example {example} of conversation {conv} does not begin like the one before it")
                whole.update(new.encode("utf-8", "surrogatepass"))
                done = 0
                while done < len(new):
                    turn = _NEXT.match(new, done)
                    if turn is None:
                        raise ValueError(f"example {example} of conversation {conv} holds no whole turn where one begins")
                    role, said = (unescape(x) for x in turn.groups())
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    done = turn.end()
            at += len(text)
            seen = max(seen, at)
            state[4] += len(text)
            if begin is not None:
                trained = unescape(text[begin:end])
                state[2] += len(trained)
                state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += 1
        yield _emit(rows, schema)
    if state:
        yield _emit([row()], schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Segments of all conversations (conv_id, turn, role, text; more columns are ignored).

    ``conv_id, position, segment, start, end`` for every turn, ``example, target_start, target_end``
    for assistant turns; offsets are code points in the formatted conversation. Turns are ordered by
    (turn, role, text), NULL first. NULL text or role: empty. NULL conv_id: one conversation. Repeated
    rows: turns like any other. A conversation without an assistant has no example. Empty table: no row.
    """
    rows = small_batches(conversations).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, SEGMENTS)


def _in_order(segments: DataFrame, sorted_already: bool) -> DataFrame:
    if sorted_already:
        return segments
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def materialise(segments: DataFrame, sorted_already: bool = False) -> DataFrame:
    """``conv_id, example, context, target``: the examples with their prefixes written out, still escaped.

    A conversation of n turns writes n * n / 2 turns, so this is for conversations of bounded length.
    """
    return _in_order(segments, sorted_already).mapInArrow(_materialise, EXAMPLES)


def read_back(segments: DataFrame, sorted_already: bool = False) -> DataFrame:
    """One row per conversation, parsed from the segments alone: turn and loss digests, unescaped.

    ``sorted_already``: the segments come straight from :func:`format_conversations`.
    """
    return _in_order(segments, sorted_already).mapInArrow(_digest, DIGEST)


def expand(segments: DataFrame, sorted_already: bool = False, piece_chars: int = 1 << 20) -> DataFrame:
    """``conv_id, example, piece, text, loss_start, loss_end``: each assistant turn with all turns before it.

    The pieces of an example, in order, are its text, still escaped; characters [loss_start, loss_end) of its
    last piece are trained on. A piece ends after the turn with which it reaches ``piece_chars``. Turns after the last reply, or
    of a conversation without one, follow in a last example with no loss.
    """
    rows = _in_order(segments, sorted_already).mapInArrow(_expand(piece_chars), EXPANDED)
    own = rows.where(F.col("example").isNotNull())
    later = own.where("piece > 0").select(F.col("conv_id").alias("__conv"), F.col("example").alias("__example"), F.col("piece").alias("__piece"))
    before = rows.where(F.col("example").isNull()).drop("example").join(later, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("piece") < F.col("__piece")))
    return own.unionByName(before.withColumnRenamed("__example", "example").drop("__conv", "__piece"))


def read_examples(examples: DataFrame) -> DataFrame:
    """One row per conversation, read from the examples of :func:`expand` alone: turn and loss digests, unescaped.

    Every example is read to its end, and one that does not begin with the whole text of the one before it is an
    error. ``formatted_chars`` counts the characters of all examples.
    """
    ordered = small_batches(examples).repartition("conv_id").sortWithinPartitions("conv_id", "example", "piece")
    return ordered.mapInArrow(_read_examples, DIGEST)
