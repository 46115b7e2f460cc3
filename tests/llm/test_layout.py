"""Chat format, sharding, mixing, URL filter and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from helpers import awkward, empty
from pyspark.sql import functions as F

from auditweave.llm import chat_format, mixing, registered, sharding, url_filter

TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_escape_is_reversible():
    for text in ("", "<|im_end|>", "\\", "<\\|im_end|>", "a<", "<<||", "\\n", "x\\|y<|", "\n<|im_start|>user\n"):
        assert "<|" not in chat_format.escape(text) and chat_format.unescape(chat_format.escape(text)) == text


def conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "hello\nyou"), (1, 3, "user", None), (1, 4, "assistant", "ok \U0001F600"),
            (1, 5, "user", "bye"), (2, 0, "user", "nobody answers"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, None, None, None), (None, 1, "user", "lost"),
            (5, 1, "assistant", "second"), (5, 0, "user", "first"), (6, 0, "odd\nrole", "text\\n")]
    rows += [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * 50) for i in range(120)]
    return rows, spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS position", "'x' AS segment").repartition(3)


def test_read_back_equals_the_input(spark):
    rows, df = conversations(spark)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        by[r[0]].append(r)
    want = {}
    for conv, turns in by.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    segments = chat_format.format_conversations(df)
    for straight in (True, False):
        got = {r[0]: tuple(r)[1:5] for r in chat_format.read_back(segments, sorted_already=straight).collect()}
        assert got == want
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"))).count() == 0


def test_every_assistant_turn_is_an_example_after_its_prefix(spark):
    rows, df = conversations(spark)
    segments = chat_format.format_conversations(df)
    whole = defaultdict(str)
    for r in segments.orderBy("conv_id", "position").collect():
        assert r["start"] == len(whole[r["conv_id"]])
        whole[r["conv_id"]] += r["segment"]
    examples = chat_format.materialise(segments).collect()
    assert len(examples) == sum(r[2] == "assistant" for r in rows)
    for e in examples:
        assert whole[e["conv_id"]].startswith(e["context"] + e["target"]) and e["context"].endswith("assistant\n")


def test_conversations_are_read_back_from_whole_examples(spark):
    rows, df = conversations(spark)
    segments = chat_format.format_conversations(df)
    want = {r[0]: tuple(r)[1:5] for r in chat_format.read_back(segments).collect()}
    said = {(r["conv_id"], r["example"]): r["context"] + r["target"] + "<|im_end|>\n" for r in chat_format.materialise(segments).collect()}
    for piece_chars in (1 << 20, 700):
        expanded = chat_format.expand(segments, piece_chars=piece_chars)
        whole, loss = defaultdict(str), {}
        for r in expanded.orderBy("conv_id", "example", "piece").collect():
            key = r["conv_id"], r["example"]
            assert key not in loss
            whole[key] += r["text"]
            if r["loss_start"] is not None:
                loss[key] = r["text"][r["loss_start"]:r["loss_end"]]
        assert {k: whole[k] for k in loss} == said and all(whole[k].endswith(v + "<|im_end|>\n") for k, v in loss.items())
        back = {r[0]: r for r in chat_format.read_examples(expanded).collect()}
        assert {k: tuple(r)[1:5] for k, r in back.items()} == want
        assert all(back[c]["formatted_chars"] == sum(len(t) for k, t in whole.items() if k[0] == c) for c in want)
        assert sum(r["n_examples"] for r in back.values()) == len(loss) == sum(r[2] == "assistant" for r in rows)
    assert chat_format.read_examples(chat_format.expand(segments.where("false"))).count() == 0


def test_the_query_of_op7_writes_every_prefix(spark, tmp_path):
    _, df = conversations(spark)
    df.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["formatted_chars"] for r in registered.QUERIES["op7_chat_formatting"](spark, str(tmp_path)).collect()}
    segments = chat_format.format_conversations(df)
    once = {r["conv_id"]: r["formatted_chars"] for r in chat_format.read_back(segments).collect()}
    assert got[7] > 25 * once[7] and got[2] == once[2]


def test_shards_follow_the_law_and_the_mixture(spark):
    rows = [(i, f"text {i}" * (i % 7), "en", "hot" if i % 3 == 0 else f"s{i % 11}", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ranges = [sharding.assign_shards(df, shards=7, range_rows=n).collect() for n in (100_000, 50)]
    assert sorted(map(str, ranges[0])) == sorted(map(str, ranges[1]))
    by, mixture = defaultdict(list), Counter()
    for r in ranges[0]:
        by[r["shard"]].append(r["slot"])
        mixture[r["shard"], r["source"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    total = Counter(r[3] for r in rows)
    assert all(abs(mixture[s, source] - n / 7) <= 2 for source, n in total.items() for s in range(7))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in ranges[0]} == {(i, len(t) + 1, zlib.crc32(t.encode())) for i, t, *_ in rows}
    # The same by sorting in memory.
    key = {i: int(hashlib.md5(f"17:{i}:{zlib.crc32(t.encode())}".encode()).hexdigest()[:15], 16) for i, t, *_ in rows}
    ranked, seen = [], Counter()
    for i, _, _, source, _ in sorted(rows, key=lambda r: (r[3], key[r[0]], r[0])):
        seen[source] += 1
        ranked.append(((2 * seen[source] - 1) / (2.0 * total[source]), source, seen[source], i))
    want = {r[3]: p * 7 // 3000 for p, r in enumerate(sorted(ranked))}
    assert {r["doc_id"]: r["shard"] for r in ranges[0]} == want


def test_shards_of_awkward_rows(spark):
    got = sharding.assign_shards(awkward(spark), shards=5, carry=("text", "kept")).collect()
    assert len(got) == 12 and {r["size"] for r in got if r["text"] is None} == {1} and {r["kept"] for r in got} == {"x"}
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_rows_without_an_id_fall_into_many_ranges(spark):
    rows = [(None if i < 3000 else i, f"text {i}", "en", "a", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    keyed = sharding.assign_shards(df, shards=8, range_rows=100)
    by = Counter(r["shard"] for r in keyed.where("doc_id IS NULL").collect())
    assert len(by) == 8 and max(by.values()) < 450
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.mix_sources(df, temperature=1.0)
        parts = Counter(r[0] for r in mixed.where("doc_id IS NULL").select(F.spark_partition_id()).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and max(parts.values()) < 0.6 * sum(parts.values())


def test_copies_spread_like_independent_rows(spark):
    rows = [(i % 500, f"text {i % 500}", "en", "a", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    shards = defaultdict(set)
    for r in sharding.assign_shards(df, shards=8, range_rows=100, spread_copies=True).collect():
        shards[r["doc_id"]].add(r["shard"])
    # Four copies fall into 8 * (1 - (7 / 8) ** 4) = 3.31 shards on average.
    assert 3.1 < sum(map(len, shards.values())) / 500 < 3.5


def poisson(mean, point):
    p = total = math.exp(-mean)
    k = 0
    while total <= point and k < mean + 12 * math.sqrt(mean) + 30:
        k += 1
        p *= mean / k
        total += p
    return k


def test_copies_are_inverted_poisson_draws(spark):
    rows = [(i, "x" * (i % 40), "en", "big" if i % 4 else "small", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    weights = spark.createDataFrame([("big", 1.0), ("small", 30.0), ("absent", 5.0)], "source string, weight double")
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(df, weights).collect()}
    want = {}
    for i, _, _, source, _ in rows:
        draws = max(1, math.ceil(rates[source] / 32))
        points = [int(hashlib.md5(f"29:{i}:{j}".encode()).hexdigest()[:13], 16) / 2 ** 52 for j in range(1, draws + 1)]
        want[i] = sum(poisson(rates[source] / draws, u) for u in points)
    for few in (10_000, 0):
        mixed = mixing.mix_sources(df, weights, broadcast_sources=few)
        got = Counter(r["doc_id"] for r in mixed.collect())
        assert got == Counter({k: v for k, v in want.items() if v})
    mean = sum(v for k, v in want.items() if k % 4 == 0) / 500
    assert abs(mean - rates["small"]) < 4 * math.sqrt(rates["small"] / 500)


def test_large_means_are_sums_of_draws(spark):
    df = spark.createDataFrame([(i, "x", "en", "rare" if i == 0 else "rest", 1) for i in range(400)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    weights = spark.createDataFrame([("rare", 1.0)], "source string, weight double")
    n = mixing.mix_sources(df, weights).where("doc_id = 0").count()
    assert abs(n - 400) < 100


def test_mixing_of_awkward_rows(spark):
    mixed = mixing.mix_sources(awkward(spark), temperature=1.0)
    assert mixed.columns.count("copy") == 1 and {r["rate"] for r in mixed.collect()} <= {1.0}
    per = Counter((r["doc_id"], r["text"], r["copy"]) for r in mixed.where("doc_id = 8").collect())
    assert set(per.values()) <= {2}
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_entries_hold_while_they_are_listed(spark):
    changes = spark.createDataFrame([
        ("host", "a.example.com", "spam", "2024-01-10", True), ("host", "a.example.com", "spam", "2024-03-01", False),
        ("host", "a.example.com", "spam", "2024-03-01", False), ("host", "a.example.com", "spam", "2024-05-05", True),
        ("domain", "example.org", "adult", "2024-02-01", True), ("prefix", "b.example.net/x/", "spam", "2023-01-01", True),
        ("host", "ok.example.org", "allow", "2024-02-10", True), ("host", "same.day", "spam", "2024-01-01", True),
        ("host", "same.day", "spam", "2024-01-01", False), ("host", None, "spam", "2024-01-01", True)],
        "kind string, pattern string, list string, changed_on string, listed boolean")
    rows = [(1, "http://a.example.com/", "2024-01-09", True), (2, "http://A.example.com:80/p?q", "2024-01-10", False), (3, "https://u@a.example.com", "2024-02-29", False),
            (4, "http://a.example.com/", "2024-03-01", True), (5, "http://a.example.com/", "2024-12-31", False), (6, "http://www.example.org/", "2024-02-01", False),
            (7, "http://example.org/", "2024-02-02", False), (8, "http://notexample.org/", "2024-02-02", True), (9, "http://b.example.net/x/y", "2024-01-01", False),
            (10, "http://b.example.net/xy", "2024-01-01", True), (11, "http://ok.example.org/", "2024-02-09", False), (12, "http://ok.example.org/", "2024-02-10", True),
            (13, "http://same.day/", "2024-06-01", False), (14, None, "2024-06-01", True), (15, "not a url", "2024-06-01", True), (16, "http://a.example.com/", None, True),
            (None, "http://same.day/", "2024-06-01", False)]
    df = spark.createDataFrame([r[:3] for r in rows] + [rows[0][:3]], "capture_id bigint, url string, fetched_on string").selectExpr("*", "1 AS host", "2 AS kind")
    got = {r["capture_id"]: r["kept"] for r in url_filter.filter_captures(df, changes).collect()}
    assert got == {r[0]: r[3] for r in rows}
    assert url_filter.filter_captures(df.where("false"), changes).count() == 0
    assert all(r["kept"] for r in url_filter.filter_captures(df, changes.where("false")).collect())


CLASHES = ("score", "copy", "rate", "order_key", "__bad", "shard", "slot", "size", "component_id")


def test_pipeline_stages_keep_columns_of_any_name(spark):
    folder = "/root/testdata/sf0.001"
    docs = awkward(spark, [(20 + i, f"{t} " * 30, "en", "a") for i, t in enumerate(["Good plain sentences about the weather in spring.", "asdf", "A B C"])])
    docs = docs.drop(*CLASHES).selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        for r in made.collect():
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in CLASHES), name
        assert stage(spark, docs.where("false"), folder).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, folder).count() == docs.count() and last(spark, docs.where("false"), folder).count() == 0


def test_copies_of_a_document_leave_the_pipeline_apart(spark):
    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.mix(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    from auditweave.session import durable

    shards, n = defaultdict(set), Counter()
    for r in corpus_pipeline.deal_shards(spark, durable(docs), folder).collect():
        shards[r["doc_id"]].add(r["shard"])
        n[r["doc_id"]] += 1
    several = [d for d in n if n[d] > 1]
    expected = sum(8 * (1 - (7 / 8) ** n[d]) for d in several)
    assert len(several) > 20 and sum(len(shards[d]) for d in several) > 0.85 * expected


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != "sharding":
            assert made.columns == docs.columns
        out = made.cache()
        before, after = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in out.collect())
        if name in ("quality classifier", "n-gram Jaccard join", "benchmark decontamination"):
            assert 0 < sum(after.values()) < sum(before.values()) and not after - before
        if name == "sharding":
            assert before == after
        docs = out
