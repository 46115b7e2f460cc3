"""Removal of repeated passages by an FM-index per shard of the text.

A window of ``length`` consecutive words is repeated when its words also start elsewhere. The
text is dealt to shards by content: each window goes where the smallest hash among its 8-word
grams sends it, so equal windows meet in one shard, and neighbouring windows mostly stay
together as one segment. Grams that occur once need no index. In each shard an FM-index is
built over its segments, and the segments are streamed against it: backward search over the
wavelet matrix gives their matching statistics, and the intervals of ``length`` words or more
that occur twice are reported. Every shard holds a bounded number of segments; a gram shared by
more segments is indexed in blocks, against each of which all its segments are streamed.

Equal segments are counted before they are dealt: an index holds two copies of a segment that
occurs twice or two thousand times.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm import fm_index, textbytes
from auditweave.llm.tables import small_batches
from auditweave.session import durable, send_with_tasks

send_with_tasks(__name__)
send_with_tasks(textbytes.__name__)
send_with_tasks(fm_index.__name__)

GRAM = 8
_SEGMENTS = "gram bigint, content bigint, windows int, doc bigint, mark bigint, start int, inner int"
_SEGMENT = ("gram", "content", "windows")


def _content(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words first .. last, from running sums of hash * base ** position."""
    back = textbytes._power(textbytes._BASE_INVERSE, len(sums))
    return textbytes.mix64((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def segments_of(texts: textbytes.Texts, length: int) -> tuple[np.ndarray, ...]:
    """Segments as arrays: text number, first word in the text, number of windows, gram, content, inner repeat.

    A segment is a run of windows with the same smallest gram, cut after length - 7 windows. It can
    repeat a window inside itself only if it holds its gram twice, which ``inner repeat`` says.
    """
    longest = length - GRAM + 1
    found = textbytes.grams(texts.hashes, GRAM)
    n = len(texts.hashes) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 6
    smallest, width = found, 1
    while 2 * width <= longest:
        smallest = np.minimum(smallest[:-width], smallest[width:])
        width *= 2
    smallest = np.minimum(smallest[:n], smallest[longest - width:longest - width + n])
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.word_bounds))[:n]
    valid = np.arange(n) + length <= texts.word_bounds[1:][owner]
    change = np.append(True, (smallest[1:] != smallest[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1]))
    since = np.flatnonzero(change)
    since = np.repeat(since, np.diff(np.append(since, n)))
    first = np.flatnonzero(valid & ((np.arange(n) - since) % longest == 0))
    if not len(first):
        return (np.empty(0, np.int64),) * 6
    run_end = np.append(np.flatnonzero(change)[1:], n)
    run_end = np.repeat(run_end, np.diff(np.append(np.flatnonzero(change), n)))[first]
    windows = np.minimum(run_end - first, longest)
    sums = np.zeros(len(texts.hashes) + 1, np.uint64)
    np.cumsum(texts.hashes * textbytes._power(textbytes._BASE, len(texts.hashes)), out=sums[1:])
    held = np.zeros(len(first), np.int64)
    for offset in range(2 * longest - 1):
        inside = offset < windows + longest - 1
        held += inside & (found[np.minimum(first + offset, len(found) - 1)] == smallest[first])
    return (owner[first], first - texts.word_bounds[owner[first]], windows, smallest[first],
            _content(sums, first, first + windows + length - 1), held > 1)


def _cut(length: int):
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("windows", pa.int32()), ("doc", pa.int64()),
                        ("mark", pa.int64()), ("start", pa.int32()), ("inner", pa.int32())])

    def run(batches):
        for batch in batches:
            docs, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            for rows, texts in textbytes.columns_of(batch, "text"):
                owner, start, windows, gram, content, inner = segments_of(texts, length)
                if len(owner):
                    columns = [gram.view(np.int64), content.view(np.int64), windows, docs[rows][owner], marks[rows][owner], start, inner.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _words(length: int):
    """The word hashes of the wanted segments of each text."""
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("windows", pa.int32()), ("copies", pa.int32()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            wanted = batch.column("wanted")
            for rows, texts in textbytes.columns_of(batch, "text"):
                out = []
                for a, b, parts in zip(texts.word_bounds[:-1], texts.word_bounds[1:], wanted[rows].to_pylist(), strict=True):
                    for part in parts:
                        at = a + part["start"]
                        to = at + part["windows"] + length - 1
                        if to <= b:
                            out.append((part["gram"], part["content"], part["windows"], part["copies"], texts.hashes[at:to].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _match(length: int):
    """One shard, or block of one: index its own segments, stream all, report repeated windows."""
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("windows", pa.int32()), ("mask", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        seen, keys, words, copies, own = set(), [], [], [], []
        for g, c, w, n, mine, data in zip(*(table.column(x).to_pylist() for x in (*_SEGMENT, "copies", "own", "words")), strict=True):
            if (g, c, w) not in seen:
                seen.add((g, c, w))
                keys.append((g, c, w))
                words.append(np.frombuffer(data, np.uint64))
                copies.append(min(n, 2))
                own.append(mine)
        held = [s for s, n, mine in zip(words, copies, own, strict=True) if mine for _ in range(n)]
        if not held:
            return schema.empty_table()
        masks = fm_index.repeated_windows(fm_index.FMIndex(held), words, np.where(own, 2, 1), length)
        some = np.flatnonzero(masks)
        columns = [*zip(*(keys[i] for i in some), strict=True)] if len(some) else [[], [], []]
        return pa.table([pa.array(x, f.type) for x, f in zip([*columns, masks[some].view(np.int64)], schema, strict=True)], schema=schema)

    return run


def _strip(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "parts")), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if parts:
                    change = np.zeros(len(words) + 1, np.int64)
                    for part in parts:
                        starts = part["start"] + np.flatnonzero(np.unpackbits(np.array([part["mask"]], np.int64).view(np.uint8), bitorder="little"))
                        np.add.at(change, starts[starts + length <= len(words)], 1)
                        np.add.at(change, starts[starts + length <= len(words)] + length, -1)
                    kept = list(compress(words, np.cumsum(change)[:-1] == 0))
                out.append((doc, len(words), len(words) - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """``doc, mark, text, doc_id``: rows of equal doc and mark have equal texts.

    mark is a 64-bit hash of the text, doc the id, or another hash of the text where there is none.
    """
    text, name = F.coalesce("text", F.lit("")), F.col("doc_id").cast("bigint")
    return small_batches(docs).select(F.coalesce(name, F.xxhash64(F.lit("no id"), text)).alias("doc"), F.xxhash64(text).alias("mark"), "text", name.alias("doc_id"))


def repeated_spans(docs: DataFrame, length: int = 35, shard_segments: int = 8_000) -> DataFrame:
    """``doc, mark, start, mask``: bit b of mask says that the window from word start + b on is repeated."""
    rows = _rows(docs)
    cut = rows.mapInArrow(_cut(length), _SEGMENTS)
    several = cut.groupBy("gram").agg(F.sum(F.col("inner") + 1).alias("n")).where("n > 1").select("gram")
    shared = durable(cut.join(several, "gram"))
    kinds = shared.groupBy(*_SEGMENT).agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"),
                                          F.min(F.struct("doc", "mark", "start")).alias("at"))
    kinds = durable(kinds.select(*_SEGMENT, "copies", "at.doc", "at.mark", "at.start"))
    shards = max(1, kinds.count() // (shard_segments // 2))
    wanted = kinds.groupBy("doc", "mark").agg(F.collect_list(F.struct(*_SEGMENT, "copies", "start")).alias("wanted"))
    texts = rows.join(wanted, ["doc", "mark"]).mapInArrow(
        _words(length), "gram bigint, content bigint, windows int, copies int, words binary")
    large = kinds.groupBy("gram").count().where(f"count > {shard_segments}").select(
        "gram", F.ceil(F.col("count") / shard_segments).cast("int").alias("blocks"))
    block = F.expr("pmod(content, blocks)")
    dealt = (
        texts.join(large, "gram", "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .withColumn("own", F.coalesce(block == F.col("block"), F.lit(True)))
        .withColumn("shard", F.when(F.col("blocks").isNull(), F.expr(f"pmod(gram, {shards})")).otherwise(F.col("gram")))
    )
    found = dealt.groupBy("shard", "block", F.col("blocks").isNull().alias("small")).applyInArrow(
        _match(length), "gram bigint, content bigint, windows int, mask bigint")
    found = durable(found.groupBy(*_SEGMENT).agg(F.expr("bit_or(mask)").alias("mask")))
    return shared.join(found, list(_SEGMENT)).select("doc", "mark", "start", "mask")


def remove_repeated(docs: DataFrame, length: int = 35, shard_segments: int = 8_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs`` (doc_id, text; more columns are ignored).

    ``kept`` (UTF-8 bytes) are the words outside all repeated windows, joined by one space. Windows are
    judged on the input: of two equal passages both go. Words are compared as they are. NULL or empty
    text: no word. NULL doc_id: a row like any other. Repeated rows repeat each other's windows. Texts
    shorter than a window stay whole. Empty table: no row.
    """
    spans = repeated_spans(docs, length, shard_segments)
    parts = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "mask")).alias("parts"))
    return _rows(docs).join(parts, ["doc", "mark"], "left").select("doc_id", "text", "parts").mapInArrow(
        _strip(length), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def removal_digest(docs: DataFrame, length: int = 35, shard_segments: int = 8_000) -> DataFrame:
    """:func:`remove_repeated` with ``kept_sha256`` in place of the words."""
    return remove_repeated(docs, length, shard_segments).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
