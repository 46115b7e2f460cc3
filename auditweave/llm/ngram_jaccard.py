"""Jaccard join on word shingles by parity sketches.

A set's parity sketch starts at zero and flips, for each element, the bit that the element's
hash names. Elements that two sets share cancel out, so the Hamming distance of two sketches
is at most the size of the symmetric difference. Sets of sizes n and m with similarity s or
more differ in at most (1 - s) / (1 + s) * (n + m) elements.

Candidates. Sizes are cut into bands. In a band the sketch is cut into more pieces than any
linked pair has differing elements, so such a pair has equal pieces (pigeonhole). A piece is
kept as the XOR of its elements' 64-bit hashes, which is the piece of a very wide sketch in
short form. A pair that must share k of its p pieces shares one among the p - k + 1 rarest of
either set, so each set is looked up by its rarest pieces only; a set whose rarest pieces are
all its own is done. Sets near the upper end of a band are entered in the next band as well.

Links. Equal sets are one class from the start. Members of a piece are first compared with
one of them, then with another; what these links join needs no further comparison. Pieces
that still hold members of different components are compared in blocks of bounded size, by
dense sketches first, and exactly where those allow it. So the links that are returned join
exactly what all links would join, without the pairs of a group ever being written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm import textbytes
from auditweave.llm.components import components
from auditweave.llm.tables import small_batches
from auditweave.session import durable, send_with_tasks

send_with_tasks(__name__)
send_with_tasks(textbytes.__name__)

_BAND_GROWTH = 1.75
#: Percent of pieces beyond the pigeonhole's number; with them the most frequent pieces need not be looked up.
_SPARE = 12
_SIGNATURE = ("doc_id bigint, n bigint, fp bigint, band1 int, pieces1 int, limit1 int, band2 int, pieces2 int, limit2 int")
_SET = "doc_id bigint, n bigint, hashes binary, sketch binary"


class Bands:
    """Size bands for links of ``percent`` of the union or more; bands start where sets can differ at all."""

    def __init__(self, percent: int = 80):
        self.percent = percent
        starts, size = [], 1
        while size < 1 << 40:
            starts.append(size)
            size = max(size + 1, int(size * _BAND_GROWTH))
        self.starts = starts[:64]

    def largest_partner(self, n: int) -> int:
        return n * 100 // self.percent

    def differ(self, n: int, m: int) -> int:
        """The most elements by which linked sets of these sizes can differ."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    def plan(self, n: int) -> list[tuple[int, int, int]]:
        """(band, pieces, limit) for a set of n: its own band, and the next if a partner can be there."""
        band = int(np.searchsorted(self.starts, n, "right")) - 1
        found = []
        for at in (band, band + 1):
            top = self.starts[at + 1] - 1
            largest = min(self.largest_partner(n), top)
            if largest < self.starts[at]:
                continue
            limit = self.differ(n, largest)
            most = self.differ(top, top)
            if most:  # otherwise only equal sets are linked there
                found.append((at, most + 2 + most * _SPARE // 100, limit))
        return found


def shingle_sets(texts: textbytes.Texts, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word hashes of each text; a shorter text is one shingle, an empty one has none."""
    all_grams = textbytes.grams(texts.hashes, k)
    for a, b in zip(texts.word_bounds[:-1], texts.word_bounds[1:], strict=True):
        if b - a >= k:
            found = np.sort(all_grams[a:b - k + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            yield textbytes.grams(texts.hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield all_grams[:0]


def pieces_of(found: np.ndarray, band: int, pieces: int, limit: int) -> np.ndarray:
    """Keys of the pieces that hold an element; of empty pieces as well where the rest is fewer than limit + 1.

    The low six bits of a key are the band, the next is set for an empty piece. Empty pieces count as
    the most frequent of all, whatever their number of holders, since most sets do not list them.
    """
    at = ((found >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    number, content = at[first], np.bitwise_xor.reduceat(found, first)
    if len(number) <= limit:
        empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), number)
        number, content = np.append(number, empty), np.append(content, np.zeros(len(empty), np.uint64))
    key = textbytes.mix64(content ^ (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (key & ~np.uint64(127)) | np.where(content == 0, np.uint64(64), np.uint64(0)) | np.uint64(band)


def dense_sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the elements per bit, in about four bits an element; a power of two, at least 64 bits."""
    bits = 1 << max(6, int(4 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def hamming(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Distance of a sketch to others; of two lengths the longer is folded, which keeps the bound."""
    out = np.empty(len(many), np.int64)
    for size in {len(x) for x in many}:
        at = [i for i, x in enumerate(many) if len(x) == size]
        block, own, width = np.stack([many[i] for i in at]), one, size
        while width > len(own):
            width //= 2
            block = block[:, :width] ^ block[:, width:]
        while len(own) > width:
            own = own[:len(own) // 2] ^ own[len(own) // 2:]
        out[at] = np.bitwise_count((block ^ own).view(np.uint64)).sum(axis=1)
    return out


def linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _signatures(k: int, bands: Bands):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n", "fp")]
                       + [(n, pa.int32()) for n in ("band1", "pieces1", "limit1", "band2", "pieces2", "limit2")])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, texts in textbytes.columns_of(batch, "text", lower=True):
                out = []
                for found in shingle_sets(texts, k):
                    with np.errstate(over="ignore"):
                        fp = int(textbytes.mix64(found).sum(dtype=np.uint64).astype(np.int64))
                    row = [len(found), fp]
                    plan = bands.plan(len(found)) if len(found) else []
                    for band, pieces, limit in plan:
                        keys = pieces_of(found, band, pieces, limit)
                        row += [band, int(np.count_nonzero((keys & np.uint64(64)) == 0)), limit]
                    out.append(row + [None] * (8 - len(row)))
                yield _batch(schema, [ids[rows], *map(list, zip(*out, strict=True))])

    return run


def _keys(k: int, bands: Bands):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, texts in textbytes.columns_of(batch, "text", lower=True):
                keys, owners = [], []
                for doc, found in zip(ids[rows], shingle_sets(texts, k), strict=True):
                    for band in bands.plan(len(found)) if len(found) else ():
                        keys.append(pieces_of(found, *band))
                        owners.append(np.full(len(keys[-1]), doc, np.int64))
                if keys:
                    yield _batch(schema, [np.concatenate(keys).view(np.int64), np.concatenate(owners)])

    return run


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, texts in textbytes.columns_of(batch, "text", lower=True):
                found = list(shingle_sets(texts, k))
                yield _batch(schema, [ids[rows], [len(x) for x in found], [x.tobytes() for x in found],
                                      [dense_sketch(x).tobytes() for x in found]])

    return run


def _near(bands: Bands):
    """Of candidate pairs, those whose sketches are near enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)):
                distance = hamming(np.frombuffer(x, np.uint8), [np.frombuffer(y, np.uint8)])[0]
                if distance <= bands.differ(n, m):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64())).cast(schema)

    return run


def _exact(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True))
                    if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64())).cast(schema)

    return run


def _find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _partners(members: list, x: int, bands: Bands, different) -> list[int]:
    """Members after x, by size, near enough by size and sketch, for which ``different`` holds."""
    end = int(np.searchsorted([m[2] for m in members], bands.largest_partner(members[x][2]), "right"))
    others = [y for y in range(x + 1, end) if different(members[x], members[y])]
    if not others:
        return []
    near = hamming(members[x][4], [members[y][4] for y in others])
    return [y for y, distance in zip(others, near, strict=True) if distance <= bands.differ(members[x][2], members[y][2])]


def _open_members(members: list, bands: Bands, i: int, j: int) -> list[int]:
    """Members that may be linked with one of another component."""
    found = set()
    for x in range(len(members)):
        near = _partners(members, x, bands, lambda p, q: p[1] != q[1] and (i == j or p[3] != q[3]))
        found.update([x, *near] if near else [])
    return [members[x][0] for x in found]


def _links_of_block(members: list, bands: Bands, i: int, j: int) -> list[tuple[int, int]]:
    """Links that join components of one block pair, fewer than there are members."""
    parent = {m[1]: m[1] for m in members}

    def apart(p, q):
        return (i == j or p[3] != q[3]) and _find(parent, p[1]) != _find(parent, q[1])

    out = []
    for x, one in enumerate(members):
        for y in _partners(members, x, bands, apart):
            other = members[y]
            if apart(one, other) and linked(one[5], other[5], bands.percent):
                parent[_find(parent, one[1])] = _find(parent, other[1])
                out.append((one[0], other[0]))
    return out


def _blocks(bands: Bands, exact: bool):
    """Rows sorted by (key, i, j), held one block pair at a time.

    Without ``exact`` the rows have sketches, and those that may be linked are returned; with it they
    have the sets too, and links are.
    """
    if exact:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    else:
        schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("doc_id", pa.int64())])
    names = ("doc_id", "component", "n", "block", "sketch", *(["hashes"] if exact else []))

    def settle(at, members):
        if len(members) < 2:
            return []
        members.sort(key=lambda m: m[2])
        if exact:
            return _links_of_block(members, bands, *at[1:])
        return [(*at, doc) for doc in _open_members(members, bands, *at[1:])]

    def run(batches):
        current, members = None, []
        for batch in batches:
            out = []
            keys = (batch.column(c).to_pylist() for c in ("key", "i", "j"))
            rows = [batch.column(c).to_pylist() for c in names]
            rows[4] = [np.frombuffer(x, np.uint8) for x in rows[4]]
            if exact:
                rows[5] = [np.frombuffer(x, np.uint64) for x in rows[5]]
            for at, *row in zip(zip(*keys, strict=True), *rows, strict=True):
                if at != current:
                    out += settle(current, members)
                    current, members = at, []
                members.append(tuple(row))
            if out:
                yield _batch(schema, list(zip(*out, strict=True)))
        if out := settle(current, members):
            yield _batch(schema, list(zip(*out, strict=True)))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text; more columns are ignored).

    Two texts are linked when their sets of k-word shingles (A-Z lowered) share ``percent`` of their
    union or more; component_id is the smallest doc_id reached over links. A text of fewer words is one
    shingle. NULL or empty text: 0 shingles, component_id = doc_id. NULL doc_id: component_id NULL, no
    links. Repeated rows fall into one component. Empty table: no row.
    """
    bands = Bands(percent)
    docs = small_batches(docs)
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signatures = durable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
                         .mapInArrow(_signatures(k, bands), _SIGNATURE))
    plan = ("band1", "pieces1", "limit1", "band2", "pieces2", "limit2")
    classes = durable(signatures.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "fp").agg(
        F.min("doc_id").alias("rep"), *(F.max(c).alias(c) for c in plan)))
    members = _members(named.mapInArrow(_keys(k, bands), "key bigint, doc_id bigint"), classes)
    wanted = members.select("doc_id").distinct()
    sets = durable(named.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), _SET))
    groups = components(_links(members, sets, bands, block))
    found = classes.join(groups, classes.rep == groups.node, "left").select(
        "n", "fp", F.coalesce("component", "rep").alias("component_id"))
    return (
        signatures.select("doc_id", F.col("n").alias("n_shingles"), "fp")
        .join(found.withColumnRenamed("n", "n_shingles"), ["n_shingles", "fp"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                .when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    )


def _members(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, doc_id``: for one document of each class its rarest pieces, where another class has the piece too."""
    per_key, per_set = Window.partitionBy("key"), Window.partitionBy("doc_id", "band", "empty")
    shared = durable(keys.withColumn("holders", F.count("*").over(per_key)).where("holders > 1"))
    own = shared.join(classes.withColumnRenamed("rep", "doc_id"), "doc_id").withColumn("band", F.expr("cast(key & 63 as int)"))
    first = F.col("band") == F.col("band1")
    own = own.select("key", "doc_id", "holders", "band", F.expr("(key & 64) <> 0").alias("empty"),
                     F.when(first, F.col("pieces1")).otherwise(F.col("pieces2")).alias("pieces"),
                     F.when(first, F.col("limit1")).otherwise(F.col("limit2")).alias("limit"))
    # Pieces that nobody shares come first in the order by rarity; they need no row.
    rarest = (
        own.withColumn("shared", F.count("*").over(per_set))
        .withColumn("rank", F.row_number().over(per_set.orderBy("holders", "key")))
        .where("empty OR rank <= limit + 1 - (pieces - shared)").select("key", "doc_id")
    )
    return durable(rarest.withColumn("holders", F.count("*").over(per_key)).where("holders > 1").select("key", "doc_id"))


def _verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that are linked."""
    def side(end: str, *columns: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(end), *(F.col(c).alias(c[0] + end) for c in columns))

    close = (
        pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        .join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
        .where(f"100 * least(na, nb) >= {bands.percent} * greatest(na, nb)")
        .mapInArrow(_near(bands), "a bigint, b bigint")
    )
    return durable(close.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b")
                   .mapInArrow(_exact(bands.percent), "a bigint, b bigint"))


def _unsettled(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Members, with their components so far, of the pieces that hold more than one component."""
    if groups is None:
        return members.withColumn("component", F.col("doc_id"))
    known = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_keys = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return known.join(open_keys, "key")


def _links(members: DataFrame, sets: DataFrame, bands: Bands, block: int) -> DataFrame:
    """Links that join the same components as all links would."""
    links, groups = None, None
    for turn in range(2):
        rows = durable(_unsettled(members, groups))
        priority = F.col("doc_id") if turn == 0 else F.xxhash64("key", "doc_id")
        centre = rows.groupBy("key").agg(F.min_by(F.struct("doc_id", "component"), priority).alias("c"))
        pairs = rows.join(centre, "key").where("component <> c.component").select(F.col("doc_id").alias("a"), F.col("c.doc_id").alias("b"))
        new = _verified(pairs, sets, bands)
        links = new if links is None else links.unionByName(new)
        groups = durable(components(links))
    rows = _unsettled(members, groups)
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")) - 1)
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = (
        numbered.join(sizes, "key").withColumn("block", F.expr(f"cast(at div {block} as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "doc_id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    def in_blocks(rows: DataFrame, *columns: str) -> DataFrame:
        rows = rows.join(sets.select("doc_id", "n", *columns), "doc_id")
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    dealt = durable(dealt)
    at = ["key", "i", "j", "doc_id"]
    left = in_blocks(dealt, "sketch").mapInArrow(_blocks(bands, False), "key bigint, i int, j int, doc_id bigint")
    found = in_blocks(dealt.join(durable(left), at, "left_semi"), "sketch", "hashes").mapInArrow(_blocks(bands, True), "a bigint, b bigint")
    return links.unionByName(durable(found))
