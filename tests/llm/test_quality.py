"""Classifier, rules, licence scan and decontamination."""

import random
import zlib
from collections import Counter

from helpers import WORD, awkward, empty

from auditweave.llm import decontamination, license_scan, quality_fm, quality_rules

SF = "/root/testdata/sf0.01"


def test_classifier_is_right_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_fm.train(docs, labels)
    scored = quality_fm.with_score(docs, model).join(labels, "doc_id").where(quality_fm.held_out())
    rows = [(r["quality"], r["score"]) for r in scored.collect()]
    assert len(rows) > 50 and sum((s >= 0.5) == (q == 1) for q, s in rows) >= 0.95 * len(rows)
    assert len(model) == 4 * (1 + quality_fm.WIDTH * (1 + quality_fm.RANK))


def test_held_out_rows_do_not_change_the_model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    small = labels.where("doc_id < 300")
    turned = small.withColumn("quality", quality_fm.F.when(quality_fm.held_out(), 1 - quality_fm.F.col("quality")).otherwise(quality_fm.F.col("quality")))
    assert quality_fm.train(docs, small) == quality_fm.train(docs, turned)
    assert [r[0] for r in spark.range(5).select(quality_fm.held_out("id")).collect()] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(5)]


def test_classifier_of_awkward_rows(spark):
    df, labels = awkward(spark), spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id bigint, quality int")
    scored = quality_fm.with_score(df, quality_fm.train(df, labels))
    rows = scored.collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows) and scored.columns.count("score") == 1
    nothing = quality_fm.train(df, labels.where("false"))
    assert {r["score"] for r in quality_fm.with_score(df, nothing).collect()} == {0.5}
    assert quality_fm.with_score(empty(spark), nothing).count() == 0


def test_pair_sum_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    machine = quality_fm.Machine()
    machine.vectors = rng.normal(size=machine.vectors.shape).astype(np.float32)
    index, value = np.array([3, 9, 40, 77]), np.array([0.5, 1.0, 2.0, 0.25])
    want = sum(machine.vectors[a] @ machine.vectors[b] * x * y for i, (a, x) in enumerate(zip(index, value, strict=True))
               for b, y in list(zip(index, value, strict=True))[i + 1:])
    assert abs(machine.raw(np.array([0, 4]), index, value)[0][0] - want) < 1e-4


def counted(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


def test_rule_statistics_equal_brute_force(spark):
    df = awkward(spark, extra=[(20, "a b c a b c x\n\na b c\n a b c\na b c\r\n", "en", "a"), (21, "x x x x x", "en", "a"), (22, "#$ <b> | %", "en", "a")])
    df = df.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    want = sorted(((r["doc_id"], *counted(r["text"])) for r in df.collect()), key=str)
    judged = quality_rules.judge(df)
    got = sorted((tuple(r) for r in judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    assert got == want
    assert not [r for r in judged.collect() if r["base_failed"] and r["kept"]]
    assert quality_rules.judge(empty(spark)).count() == 0


def test_rules_keep_good_texts_and_drop_bad_ones(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rows_of_one_id_do_not_pass_the_bound_of_the_sample(spark, monkeypatch):
    seen = []
    plain = quality_fm._train

    def counted(batches):
        rows = list(batches)
        (folder / str(sum(b.num_rows for b in rows))).touch()
        return plain(iter(rows))

    import tempfile
    from pathlib import Path

    folder = Path(tempfile.mkdtemp(prefix="run-"))
    monkeypatch.setattr(quality_fm, "_train", counted)
    docs = spark.createDataFrame([(7 if i < 3000 else i, f"text {i} of some words") for i in range(3200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [7, *range(3000, 3200)]], "doc_id bigint, quality int")
    quality_fm.train(docs, labels, max_rows=10)
    seen = sorted(int(f.name) for f in folder.iterdir())
    assert seen and max(seen) <= 10


def test_estimation_finds_planted_accuracies():
    rng, votes = random.Random(6), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        pattern = []
        for right_of_bad, right_of_good in ((0.7, 0.99), (0.6, 0.97), (0.5, 0.98)):
            if rng.random() < 0.2:
                pattern.append(quality_rules.ABSTAIN)
            else:
                right = rng.random() < (right_of_good if good else right_of_bad)
                pattern.append(quality_rules.GOOD if right == good else quality_rules.BAD)
        votes[tuple(pattern)] += 1
    prior, tables = quality_rules.estimate(sorted(votes.items()), rounds=300)
    assert abs(prior - 0.8) < 0.05 and abs(tables[0][0][quality_rules.BAD] - 0.7) < 0.08 and abs(tables[2][1][quality_rules.GOOD] - 0.98) < 0.02


def test_licence_families(spark):
    rows = [(i, f"Some words first.\n{text}\nAnd some after.") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    rows += [(100, "Licensed under the Apache license, version 2.0"), (101, "His driving licence and all rights of way are reserved for later"),
             (102, None), (103, ""), (None, "All rights reserved."), (104, "plain text of no interest"), (104, "plain text of no interest")]
    plain = [(1000 + i, f"ordinary words number {i} about the weather in spring and {i * 7} birds") for i in range(300)]
    df = spark.createDataFrame(rows + plain, "doc_id bigint, text string").selectExpr("*", "1 AS family", "2 AS gram")
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in license_scan.scan(df).collect()}
    right = sum(got.get((i, 1)) == family for i, (family, _) in enumerate(license_scan.TEMPLATES))
    assert right >= len(license_scan.TEMPLATES) - 3
    assert got[(100, 0)] == "apache-2.0" and got[(None, 0)] == "proprietary"
    assert not [k for k, f in got.items() if f != license_scan.UNKNOWN and (k[0] or 0) >= 101]


def test_licence_scan_of_awkward_rows(spark):
    assert license_scan.scan(awkward(spark)).count() == 0
    assert license_scan.scan(empty(spark)).count() == 0


ITEM = "A train leaves Springfield at 9 and drives 120 km in 3 hours while Maria waits for Peter who counts 120 birds on the roof of the old house"


def test_changed_parameters_are_caught_and_inconsistent_slots_are_not(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "short item of just six words"), (3, "too short"), (4, None), (5, "7 8 9 10 11 12 13 14 15 16 17")], "item_id bigint, text string")
    swapped = ITEM.replace("Springfield", "Shelbyville").replace("120", "250").replace("Maria", "Anna").replace("3 hours", "4 hours")
    broken = ITEM.replace("120 km", "250 km")
    rows = [(1, f"Before it. {ITEM} And after."), (2, "so: " + swapped), (3, broken), (4, "nothing of that kind is here at all"), (5, ITEM.upper()),
            (6, "we saw a short item of just six words there"), (7, "too short"), (8, None), (9, "1 2 3 4 5 6 7 8 9 0 1 2"), (10, "x 7, 8 9 10 11 12 13 14 15 16 17"), (None, ITEM), (1, f"Before it. {ITEM} And after.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS window", "2 AS shift")
    for limit in (500_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, benchmark, broadcast_windows=limit).collect()}
        # Text 3 changes one of two equal values: only the windows that hold both conflict.
        assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 2), (None, 1), (10, 5)}, limit
    kept = [r["doc_id"] for r in decontamination.clean(df, benchmark).collect()]
    assert {4, 7, 8, 9} == set(kept)
    assert [tuple(r) for r in decontamination.unsearched(benchmark).orderBy("item_id").collect()] == [(3, 2), (4, 0)]


def test_decontamination_equals_plain_windows_on_the_given_tables(spark):
    import re

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def windows(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return {tuple(words[i:i + 10]) for i in range(len(words) - 9)}

    holders = {}
    for i, t in items:
        for w in windows(t):
            holders.setdefault(w, set()).add(i)
    want = {(d, i) for d, t in docs for w in windows(t) for i in holders.get(w, ())}
    got = decontamination.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_decontamination_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one"), (None, None)], "item_id bigint, text string")
    assert decontamination.contaminated(awkward(spark), items).count() == 0
    assert decontamination.contaminated(empty(spark), items).count() == 0
    assert decontamination.clean(awkward(spark), items.where("false")).count() == 12
