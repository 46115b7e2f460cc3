"""Source divergence audit: how far the sources of a language are from each other, and in which words.

Each language has vocabularies of its own, fitted by ``CountVectorizer`` with ``minDF`` and the largest
``vocabSize`` there is, so no term is cut by rank. A vocabulary passes through the driver and is sent to
all executors; its size is therefore bounded: the terms of a language are dealt by hash to as many slices
as keep a slice near ``slice_terms`` different terms, and every slice is fitted by itself. A document has
one sparse vector per slice; the slices have no term in common, so the vectors are exact.

Group sums are taken over the entries of the sparse vectors (a dense sum would hold the whole vocabulary
per group). Pairs of sources are evaluated sparsely: terms that neither has are one constant times their
number, terms of one of them go through a histogram of its probabilities, and only terms of both are
evaluated one by one. One pass in numpy over the entries, a term's together, makes all three and sums
them before they leave the task.

All figures are integers. A count times 10^9 may need more than 64 bits and is then one of Python's; all else fits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.tables import small_batches
from auditweave.llm.textbytes import Texts
from auditweave.operators.ordering import top_rows
from auditweave.session import durable, send_with_tasks, work_folder

MAX_INTEGER = 2**31 - 1
SCALE = 1_000_000_000
#: Each byte as the term's byte, in lower case, or a space where no term goes on.
_TERM = np.full(256, 0x20, np.uint8)
_TERM[0x80:] = np.arange(0x80, 256)
_TERM[0x61:0x7B] = _TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_PIECE = 2 << 20


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows of a batch, some 2 MB of text at a time, with their terms as words."""
    column = batch.column("text").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        yield batch.slice(i, j - i), Texts(_TERM[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], False)
        i = j


def _rows_of_words(texts: Texts) -> np.ndarray:
    return np.repeat(np.arange(len(texts)), np.diff(texts.word_bounds))


def _different_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, term``: hashes of the different terms of each batch."""
    for batch in batches:
        seen: dict[str, list[np.ndarray]] = {}
        for rows, texts in _pieces(batch):
            codes = rows.column("lang").dictionary_encode()
            lang = codes.indices.to_numpy()[_rows_of_words(texts)]
            for code, name in enumerate(codes.dictionary.to_pylist()):
                seen.setdefault(name, []).append(np.unique(texts.hashes[lang == code]))
        for name, parts in seen.items():
            terms = np.unique(np.concatenate(parts)).view(np.int64)
            yield pa.record_batch({"lang": pa.array([name] * len(terms), pa.string()), "term": pa.array(terms)})


def _joined(texts: Texts, words: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
    """One text per group: its words, each with a space after it."""
    first, size = texts.first[words], (texts.last - texts.first)[words]
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(size + 1, out=ends[1:])
    data = np.full(ends[-1], 0x20, np.uint8)
    within = np.arange(ends[-1] - len(words)) - np.repeat(ends[:-1] - np.arange(len(words)), size)
    data[np.repeat(ends[:-1], size) + within] = texts.data[np.repeat(first, size) + within]
    cuts = ends[np.searchsorted(group, np.arange(groups + 1))].astype(np.int32)
    return pa.StringArray.from_buffers(groups, pa.py_buffer(cuts), pa.py_buffer(data))


def _terms_by_slice(slices: dict[str, int]):
    """Rows ``lang, source, slice, terms, again``: one for each slice in which the document has a term.

    terms has each term, again those that come once more, as often as they do; a space ends each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _pieces(batch):
                parts = np.array([slices.get(x, 1) for x in rows.column("lang").to_pylist()], np.uint64)
                row = _rows_of_words(texts)
                # The low bits choose the slice, the high ones bring equal words together.
                part = (texts.hashes & np.uint64(0xFFFFFFFF)) % parts[row]
                width = np.uint64(parts.max(initial=1))
                key = ((row.astype(np.uint64) * width + part) << np.uint64(32)) | (texts.hashes >> np.uint64(32))
                order = np.argsort(key)
                place = key[order] >> np.uint64(32)
                new = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(order) else order
                group = np.zeros(len(order), np.int64)
                group[new[1:]] = 1
                group = np.cumsum(group)
                hashes = texts.hashes[order]
                repeat = np.append(False, (hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1])) if len(order) else np.empty(0, bool)
                owner = pa.array(row[order][new])
                yield pa.record_batch({"lang": rows.column("lang").take(owner), "source": rows.column("source").take(owner),
                                       "slice": pa.array(part[order][new].astype(np.int32)),
                                       "terms": _joined(texts, order[~repeat], group[~repeat], len(new)),
                                       "again": _joined(texts, order[repeat], group[repeat], len(new))})

    return cut


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _slices(named: DataFrame, slice_terms: int) -> dict[str, int]:
    """Slices per language, by how many different terms all its texts have: languages are few, one number each comes to the driver."""
    seen = named.select("lang", "text").mapInArrow(_different_terms, "lang string, term bigint").distinct()
    counted = seen.groupBy("lang").agg(F.count("*").alias("n")).collect()
    return {r["lang"]: 1 + int(r["n"]) // slice_terms for r in counted}


def _summed_entries(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """``group, term_no, n``: the entries of the sparse vectors, a group's summed batch by batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        group, term, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        groups, code = np.unique(group, return_inverse=True)
        key = (code.astype(np.int64) << 32) | term
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
        n = np.add.reduceat(n[order], new) if len(key) else n
        return pa.record_batch({"group": pa.array(groups[key[new] >> 32]), "term_no": pa.array((key[new] & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n)})

    for batch in batches:
        indices, values = batch.column("indices"), batch.column("values")
        sizes = indices.value_lengths().to_numpy()
        held.append((np.repeat(batch.column("group").to_numpy(), sizes), indices.flatten().to_numpy().astype(np.int64),
                     values.flatten().to_numpy().astype(np.int64)))
        if sum(len(h[0]) for h in held) >= size:
            yield summed()
    if held:
        yield summed()


def group_counts(docs: DataFrame, groups: DataFrame, min_df: int, slice_terms: int, broadcast_groups: int) -> tuple[DataFrame, DataFrame]:
    """``(fit, group, term_no, n)`` of all terms kept, n > 0, and ``(fit, lang, term_no, term)``; a fit is a slice of a language.

    ``docs``: lang, source, text; ``groups``: lang, source, group. Both results are stored tables.
    """
    send_with_tasks("auditweave.llm.divergence")
    send_with_tasks("auditweave.llm.textbytes")
    spark, named = docs.sparkSession, small_batches(_named(docs))
    slices = _slices(named, slice_terms)
    fits = [(lang, part) for lang in sorted(slices) for part in range(slices[lang])]
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    cut = named.mapInArrow(_terms_by_slice(slices), "lang string, source string, slice int, terms string, again string")
    names = F.array(*(F.lit(f"{part} {lang}") for lang, part in fits)) if fits else F.array().cast("array<string>")
    # Some four keys fall to each partition, so a fit of any size is spread, and each file holds a part of one fit.
    salts = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(len(fits), 1))
    fit = (F.array_position(names, F.concat_ws(" ", "slice", "lang")) - 1).cast("int").alias("fit")
    # A source keeps to an eighth of them, so that few groups meet in a task and its sums are few.
    salt = F.pmod(F.xxhash64("source") + F.pmod(F.xxhash64("terms"), F.lit(max(1, salts // 8))), F.lit(salts))
    dealt = cut.select("source", "terms", "again", fit).repartition("fit", salt)
    dealt.write.partitionBy("fit").parquet(f"{folder}/terms")

    sums, terms = [], []
    for number, (lang, _) in enumerate(fits):
        rows = _part(spark, f"{folder}/terms", number)
        if rows is None:
            continue
        counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=MAX_INTEGER)
        try:
            model = counter.fit(rows.select(_split(F.col("terms"))))  # documents are counted once a term, so repeats are not read
        except IllegalArgumentException as error:
            if "vocabulary size should be > 0" not in str(error):
                raise
            continue  # no term of this slice is in min_df documents
        # The model's own file is the list of terms, so the vocabulary is never a Python object.
        model.write().save(f"{folder}/model-{number}")
        here = (F.lit(number).alias("fit"), F.lit(lang).alias("lang"))
        vocabulary = spark.read.parquet(f"{folder}/model-{number}/data").select(*here, F.posexplode("vocabulary").alias("term_no", "term"))
        terms.append(_written(vocabulary, f"{folder}/vocabulary-{number}"))
        vector = F.unwrap_udt("vector")
        counted = model.transform(rows.select("source", _split(F.concat("terms", "again")))).select("source", vector.alias("vector"))
        named = _with_group(counted, groups.where(F.col("lang") == lang).select("source", "group"), "source", F.xxhash64("vector.indices"), broadcast_groups)
        entries = small_batches(named).select("group", "vector.indices", "vector.values").mapInArrow(_summed_entries, "group bigint, term_no int, n bigint")
        summed = entries.groupBy("group", "term_no").agg(F.sum("n").alias("n"))
        sums.append(_written(summed.select(here[0], "group", "term_no", "n"), f"{folder}/sums-{number}"))
    return (_read(spark, "fit int, group bigint, term_no int, n bigint", sums),
            _read(spark, "fit int, lang string, term_no int, term string", terms))


def _written(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def _read(spark, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _part(spark, folder: str, number: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/fit={number}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("source string, terms string, again string").parquet(f"{folder}/fit={number}")


def _split(text: Column) -> Column:
    return F.split(F.rtrim(text), " ").alias("terms")


def _probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), exact for any count."""
    if count.max(initial=0) >= 9 * SCALE:
        return np.array([1 + SCALE * (c + 1) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)], np.int64)
    return 1 + SCALE * (count + 1) // total


def _distance(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def divergence(docs: DataFrame, min_df: int = 3, top: int = 200, slice_terms: int = 1_000_000, broadcast_groups: int = 10_000) -> DataFrame:
    """``lang, source, part, item, value, rank``: the audit of all (lang, source) groups of ``docs``.

    ``docs``: lang, source, text, any more. Terms are runs of letters A-Z (lower-cased) and of characters beyond
    ASCII; a language keeps those in ``min_df`` of its rows or more. With V terms kept, N of them in a group and n of
    one of them, its p there is 1 + floor(10^9 * (n + 1) / (N + V)); p and q differ by floor((p - q)^2 / q). Part
    ``pair``: for each other source of the language, the sum over all terms kept. Part ``term``: the ``top``
    terms that the group has more often than its language.

    NULL lang, source, text: the empty string, a value like any other. Repeated rows are documents of their
    own. Groups without a term take part with N = 0; a language that keeps no term has pairs of value 0. Ties
    are ranked by item. Empty table: no row.
    """
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")))
    groups = durable(named.distinct().withColumn("group", F.monotonically_increasing_id()))
    counts, vocabulary = group_counts(docs, groups, min_df, slice_terms, broadcast_groups)
    in_group = counts.groupBy("group").agg(F.sum("n").alias("total"))
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(in_group, "group", "left").join(kept, "lang", "left").fillna(0, ["total", "kept"])
    in_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = groups.join(in_lang, "lang").withColumn("all", F.greatest(F.expr("total + kept"), F.lit(1)))
    groups = durable(groups.withColumn("none", F.expr(f"1 + {SCALE} div all")))

    key = F.shiftleft(F.col("fit").cast("bigint"), 32).bitwiseOR(F.col("term_no").cast("bigint")).alias("key")
    totals = groups.select("group", "all", F.expr("lang_total + kept").alias("lang_all"))
    entries = _with_group(counts, totals, "group", F.col("term_no"), broadcast_groups).select(key, "group", "n", "all", "lang_all")
    dealt = entries.repartition("key").sortWithinPartitions("key")
    found = durable(dealt.mapInArrow(_evaluated(top), "kind int, a bigint, b bigint, value bigint"))
    pairs, terms = _pairs(groups, found), _terms(groups, found, vocabulary, top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(terms.select(*columns))


def _with_group(rows: DataFrame, groups: DataFrame, key: str, spread: Column, broadcast_groups: int, salts: int = 64) -> DataFrame:
    """Bring the row of its group to each row; a group with a third of all rows is never one task's work."""
    if groups.count() <= broadcast_groups:
        return rows.join(F.broadcast(groups), key)
    met = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(spread, F.lit(salts)).cast("int")).join(met, [key, "salt"]).drop("salt")


#: Kinds of rows that the pass over the entries makes.
PAIR, HISTOGRAM, TERM = 0, 1, 2
_COLUMNS = ("key", "group", "n", "all", "lang_all")


def _whole_terms(batches: Iterator[pa.RecordBatch], size: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """The sorted entries in arrays of ``size`` rows or more, a term never cut in two."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy() for c in _COLUMNS])
        if sum(len(h[0]) for h in held) < size:
            continue
        joined = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(joined[0], joined[0][-1], "left"))
        if cut:
            yield {c: v[:cut] for c, v in zip(_COLUMNS, joined, strict=True)}
        held = [[v[cut:] for v in joined]]
    if held:
        yield {c: np.concatenate(v) for c, v in zip(_COLUMNS, zip(*held, strict=True), strict=True)}


def _evaluated(top: int):
    """Sums over the terms that pairs share, histograms of p per group, and the best terms of each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty((3, 0), np.int64)
        for rows in _whole_terms(batches):
            new = np.flatnonzero(np.diff(rows["key"], prepend=-1))
            sizes = np.diff(np.append(new, len(rows["key"])))
            p, none = _probability(rows["n"], rows["all"]), _probability(np.zeros_like(rows["n"]), rows["all"])
            q = np.repeat(_probability(np.add.reduceat(rows["n"], new), rows["lang_all"][new]), sizes)
            yield _rows(PAIR, *_shared(rows["group"], p, none, new, sizes))
            yield _rows(HISTOGRAM, *_summed(rows["group"], p, np.ones_like(p)))
            above = p > q
            value = (p[above] - q[above]) ** 2 // q[above]
            best = _best(np.concatenate([best, np.stack([rows["group"][above], rows["key"][above], value])], axis=1), top)
        yield _rows(TERM, *best)

    return work


def _rows(kind: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b), "value": pa.array(value)})


def _summed(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per different (a, b), values summed."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))) if len(a) else np.empty(0, np.int64)
    return a[new], b[new], np.add.reduceat(value[order], new) if len(a) else value


def _best(rows: np.ndarray, top: int) -> np.ndarray:
    """Of (group, key, value), those whose value is among the ``top`` largest of the group, ties included."""
    rows = rows[:, np.lexsort((-rows[2], rows[0]))]
    first = np.flatnonzero(np.diff(rows[0], prepend=-1))
    sizes = np.diff(np.append(first, rows.shape[1]))
    least = rows[2][first + np.minimum(sizes, top) - 1]
    return rows[:, rows[2] >= np.repeat(least, sizes)]


def _shared(group: np.ndarray, p: np.ndarray, none: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the terms of both add to what a pair of groups was counted as, summed over the terms."""
    def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - y) * (x - y) // y

    parts = [(np.empty(0, np.int64),) * 3]
    for size in np.unique(sizes[sizes > 1]).tolist():
        of_size = starts[sizes == size]
        step = max(1, 1_000_000 // size)
        for i in range(0, len(of_size), step):
            at = of_size[i:i + step][:, None] + np.arange(size)
            g1, p1, z1 = group[at], p[at], none[at]
            for shift in range(1, size):  # each group against the one ``shift`` places on, around the end
                g2, p2, z2 = (np.roll(x, -shift, 1) for x in (g1, p1, z1))
                value = f(p1, p2) - f(p1, z2) - f(z1, p2) + f(z1, z2)
                parts.append(_summed(g1.ravel(), g2.ravel(), value.ravel()))
        if len(parts) > 64:
            parts = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
    return _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _pairs(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language."""
    def side(name: str, group: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(name), F.col("none").alias(f"none_{name}"), F.col("group").alias(group), "kept")

    pairs = side("source", "a").join(side("item", "b").drop("kept"), "lang").where("a <> b")
    neither = _distance("none_source", "none_item")
    histogram = found.where(F.col("kind") == HISTOGRAM).groupBy("a", F.col("b").alias("held")).agg(F.sum("value").alias("terms"))
    parts = [
        pairs.select("a", "b", F.expr(f"kept * ({neither})").alias("value")),
        pairs.join(histogram, "a").groupBy("a", "b").agg(F.expr(f"sum(terms * ({_distance('held', 'none_item')} - {neither}))").alias("value")),
        pairs.join(histogram.withColumnRenamed("a", "b"), "b").groupBy("a", "b").agg(
            F.expr(f"sum(terms * ({_distance('none_source', 'held')} - {neither}))").alias("value")),
        found.where(F.col("kind") == PAIR).select("a", "b", "value"),
    ]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("a", "b").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = summed.join(pairs.select("lang", "source", "item", "a", "b"), ["a", "b"])
    return named.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))


def _terms(groups: DataFrame, found: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """The terms that set a group off from its language. Only those that may be among the ``top`` are given their names."""
    rows = found.where(F.col("kind") == TERM).select(F.col("a").alias("group"), F.shiftright("b", 32).cast("int").alias("fit"),
                                                     F.col("b").bitwiseAND(F.lit(MAX_INTEGER)).cast("int").alias("term_no"), "value")
    least = top_rows(rows, ["group"], [F.desc("value")], top, "place").groupBy("group").agg(F.min("value").alias("least"))
    rows = rows.join(least, "group").where("value >= least").join(vocabulary.drop("lang"), ["fit", "term_no"])
    rows = rows.join(groups.select("group", "lang", "source"), "group").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = top_rows(rows, ["lang", "source"], [F.desc("value"), F.col("item")], top, "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))
