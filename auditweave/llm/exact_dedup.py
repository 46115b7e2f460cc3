"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of bytes b_0 ... b_(n-1) is sum b_i * B^(n-1-i) modulo a prime, in four lanes with four
bases. It composes: the fingerprint of two pieces in a row is that of the first, shifted by the length of
the second, plus that of the second. A text is therefore hashed as chunks side by side in numpy, whatever
its length, and a document that is stored as many rows is hashed row by row wherever they lie
(``fingerprints_of_parts``); only lengths and sums meet.

Equal fingerprints prove nothing, so their texts are compared, chunk by chunk: rows (fingerprint, number of
the chunk, bytes of the chunk) are grouped by all three. Copies fold together before the shuffle, so a group
of copies of any size sends one copy per task, and a chunk number with two different contents unmasks a
collision. Texts whose fingerprint cannot be shared by another are not sent at all: a bitmap of
fixed size marks the slots of shared fingerprints.

Texts are equal when they are so after A-Z became a-z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.tables import small_batches
from auditweave.session import durable, send_with_tasks

PRIME = (1 << 31) - 1
_BASES = (1_234_567_891, 987_654_323, 1_618_033_989, 1_442_695_041)
#: Bytes of a hashed chunk: 2^8 * 2^31 * 2^12 fits 64 bits with room.
_CHUNK = 1 << 12
_PIECE = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LANES = len(_BASES)
KEY = ("length", *(f"f{i}" for i in range(LANES)))
_KEY_SCHEMA = ", ".join(f"{c} bigint" for c in KEY)


def _powers(base: int, count: int) -> np.ndarray:
    """1, base, base^2, ... modulo the prime, by doubling."""
    out = np.ones(count, np.uint64)
    have = 1
    while have < count:
        step = pow(base, have, PRIME)
        take = min(have, count - have)
        out[have:have + take] = out[:take] * np.uint64(step) % np.uint64(PRIME)
        have += take
    return out


_SMALL = np.stack([_powers(b, _CHUNK) for b in _BASES])


def shifts(lengths: np.ndarray) -> np.ndarray:
    """base^length of each lane (lanes x lengths): what a fingerprint is multiplied by when bytes follow it."""
    lengths = np.asarray(lengths, np.int64)
    out = _SMALL[:, lengths % _CHUNK]
    blocks = lengths // _CHUNK
    bit = 0
    while len(blocks) and (blocks >> bit).any():
        odd = (blocks >> bit & 1).astype(bool)
        for lane, base in enumerate(_BASES):
            out[lane, odd] = out[lane, odd] * np.uint64(pow(base, _CHUNK << bit, PRIME)) % np.uint64(PRIME)
        bit += 1
    return out


def combine(first: np.ndarray, second: np.ndarray, length_of_second: int) -> np.ndarray:
    """The fingerprint (one number a lane) of two texts in a row."""
    return (first * shifts(np.array([length_of_second]))[:, 0] + second) % np.uint64(PRIME)


def fingerprints(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Lanes x texts; text i is ``data[bounds[i]:bounds[i + 1]]``, already in lower case. Works in pieces of 4 MB."""
    sizes = np.diff(bounds)
    chunks = -(-sizes // _CHUNK)
    owner = np.repeat(np.arange(len(sizes)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = bounds[:-1][owner] + number * _CHUNK
    last = np.minimum(first + _CHUNK, bounds[1:][owner])
    hashed = np.zeros((LANES, len(owner)), np.uint64)
    i = 0
    while i < len(owner):
        j = max(i + 1, int(np.searchsorted(last, first[i] + _PIECE, "right")))
        at, size = first[i], (last - first)[i:j]
        starts = first[i:j] - at
        after = np.repeat(last[i:j], size) - np.arange(at, last[j - 1]) - 1
        values = data[at:last[j - 1]].astype(np.uint64)
        for lane in range(LANES):
            hashed[lane, i:j] = np.add.reduceat(values * _SMALL[lane][after], starts) % np.uint64(PRIME)
        i = j
    # Chunks are shifted by what follows them in their text, and then simply added up.
    hashed = hashed * shifts(bounds[1:][owner] - last) % np.uint64(PRIME)
    out = np.zeros((LANES, len(sizes)), np.uint64)
    some = np.flatnonzero(chunks)
    if len(some):
        out[:, some] = np.add.reduceat(hashed, (np.cumsum(chunks) - chunks)[some], axis=1) % np.uint64(PRIME)
    return out


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("text").cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return _LOWER[np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]], bounds - bounds[0]


def _key_columns(prints: np.ndarray, sizes: np.ndarray, bits: int) -> dict[str, pa.Array]:
    kept = prints.astype(np.int64) & ((1 << bits) - 1)
    return {"length": pa.array(sizes.astype(np.int64)), **{f"f{i}": pa.array(kept[i]) for i in range(LANES)}}


def _hashed(bits: int):
    """The key and the digest of each text, next to the other columns."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _texts(batch)
            digests = [hashlib.sha256(memoryview(data[a:b])).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_sha256": pa.array(digests, pa.string()),
                                   **_key_columns(fingerprints(data, bounds), np.diff(bounds), bits)})

    return add


def _chunks(bits: int, chunk: int, marked: bytes, slots: int):
    """Rows (key, number, bytes) of the texts whose slot is marked, some 4 MB in a batch."""
    bitmap = np.unpackbits(np.frombuffer(marked, np.uint8), bitorder="little").astype(bool)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            rows = pa.array([r for r, _, _ in held], pa.int64())
            return pa.record_batch({**{c: key[c].take(rows) for c in KEY}, "number": pa.array([n for _, n, _ in held], pa.int64()),
                                    "bytes": pa.array([x for _, _, x in held], pa.binary())})

        for batch in batches:
            data, bounds = _texts(batch)
            key = _key_columns(fingerprints(data, bounds), np.diff(bounds), bits)
            held, size = [], 0
            for i in np.flatnonzero(bitmap[_slot(key, slots)]).tolist():
                for n, at in enumerate(range(bounds[i], max(bounds[i + 1], bounds[i] + 1), chunk)):
                    piece = data[at:min(at + chunk, bounds[i + 1])].tobytes()
                    held.append((i, n, piece))
                    size += len(piece)
                    if size > _PIECE:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    return cut


def _collisions(texts: DataFrame, bits: int, chunk: int, marked: bytes, slots: int) -> DataFrame:
    """The keys that texts with different contents share."""
    pieces = texts.mapInArrow(_chunks(bits, chunk, marked, slots), f"{_KEY_SCHEMA}, number bigint, bytes binary")
    contents = pieces.groupBy(*KEY, "number", "bytes").agg(F.lit(1).alias("one"))
    return contents.groupBy(*KEY, "number").agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.lit(True).alias("collides")).distinct()


def _slot(key: dict[str, pa.Array], slots: int) -> np.ndarray:
    return (key["f0"].to_numpy() * 31 + key["f1"].to_numpy()) % slots


def fingerprints_of_parts(parts: DataFrame) -> DataFrame:
    """``key, length, f0 ... f3`` of documents stored in parts: ``key, part`` (its order), ``text``.

    Every part is hashed where it lies; its sum is then shifted by the bytes of the later parts. A document
    of any size is so fingerprinted by many tasks at once. NULL parts are empty; equal (key, part) are ordered by their sums.
    """
    send_with_tasks("auditweave.llm.exact_dedup")

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _texts(batch)
            yield pa.record_batch({"key": batch.column("key"), "part": batch.column("part"), **_key_columns(fingerprints(data, bounds), np.diff(bounds), 31)})

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = shifts(batch.column("later").to_numpy())
            yield pa.record_batch({"key": batch.column("key"), "length": batch.column("length"), **{
                f"f{i}": pa.array((batch.column(f"f{i}").to_numpy().astype(np.uint64) * moved[i] % np.uint64(PRIME)).astype(np.int64)) for i in range(LANES)}})

    rows = small_batches(parts.select("key", "part", "text"))
    kind = dict(parts.dtypes)
    hashed = rows.mapInArrow(of_parts, f"key {kind['key']}, part {kind['part']}, {_KEY_SCHEMA}")
    later = Window.partitionBy("key").orderBy(F.desc("part"), *KEY).rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("later", F.coalesce(F.sum("length").over(later), F.lit(0)))
    moved = placed.mapInArrow(shifted, f"key {kind['key']}, {_KEY_SCHEMA}")
    return moved.groupBy("key").agg(F.sum("length").alias("length"), *((F.sum(f"f{i}") % PRIME).alias(f"f{i}") for i in range(LANES)))


def _marked_slots(shared: DataFrame, slots: int) -> bytes:
    """A bitmap of ``slots`` bits, whatever the number of ``shared`` keys."""
    at = ((F.col("f0") * 31 + F.col("f1")) % slots).alias("slot")
    words = shared.select(at).groupBy(F.floor(F.col("slot") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    out = bytearray(slots // 8)
    for r in words.collect():
        out[r["block"] * 4096:r["block"] * 4096 + len(r["bits"])] = r["bits"]
    return bytes(out)


def duplicates(docs: DataFrame, bits: int = 31, chunk: int = 1 << 16, slots: int = 1 << 24, heavy_share: int = 1000) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``docs`` (doc_id, text, any more).

    Of rows with equal texts the one of largest doc_id stays, and if several rows have that id, one of them.
    ``bits`` of each lane are used (fewer only to test collisions), ``chunk`` bytes are compared at a time, and
    ``slots`` is the size in bits of the bitmap that spares texts with a fingerprint of their own the comparison.

    NULL text: an empty text, so NULL and '' are equal. NULL doc_id: less than any id. Repeated rows: copies
    of each other. Empty table: no row. Rows of a group with more than 1 / ``heavy_share`` of all rows meet its
    result by broadcast (at most ``heavy_share`` such groups exist), all others by a join.
    """
    send_with_tasks("auditweave.llm.exact_dedup")
    texts = small_batches(docs.select("doc_id", "text"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.mapInArrow(_hashed(bits), f"doc_id {kind}, text_sha256 string, {_KEY_SCHEMA}")
    # The numbers tell repeated rows apart and are fixed by being written.
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    shared = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    apart = durable(_collisions(texts, bits, chunk, _marked_slots(shared, slots), slots))
    # Where texts collide their whole digests tell the classes apart.
    rows = rows.join(apart, list(KEY), "left").withColumn("class", F.when(F.col("collides"), F.col("text_sha256")).otherwise(""))
    group = [*KEY, "class"]
    groups = durable(rows.groupBy(*group).agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size")))
    heavy = groups.where(F.col("group_size") * heavy_share > rows.count())
    found = rows.join(F.broadcast(heavy), group).unionByName(
        rows.join(F.broadcast(heavy.select(*group)), group, "left_anti").join(groups.join(F.broadcast(heavy.select(*group)), group, "left_anti"), group))
    return found.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")
