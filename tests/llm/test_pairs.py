"""Parity-sketch join and substring removal against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, WORD, awkward, empty

from auditweave.llm import fm_index, ngram_jaccard, substring_dedup
from auditweave.llm.components import components


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def groups(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, holders = {d: shingles(t) for d, t in rows}, defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for other, both in Counter(y for x in s for y in holders[x] if y > d).items():
            if 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def variants(seed, bases, copies):
    """Texts that differ from a base, or from one another, by about the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((6, 9, 14, 25, 60, 140)))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 40)):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice(([], [f"x{rng.randrange(9)}"], [words[at], "extra"]))
            rows.append(" ".join(words[rng.randrange(2):]))
    return [(i, t) for i, t in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark):
    rows = variants(5, 25, 12) + [(900 + i, "shared passage of quite a few words that many texts have in common " + " ".join(
        f"own{i}x{j}" for j in range(4 + i % 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in ngram_jaccard.near_duplicates(df, block=16).collect()}
    assert got == groups(rows)


def test_near_duplicates_of_awkward_rows(spark):
    got = sorted((tuple(r) for r in ngram_jaccard.near_duplicates(awkward(spark)).collect()), key=str)
    by_id = {r[0]: r[2] for r in got}
    assert len(got) == 12 and by_id[6] == 5 and by_id[8] == 7 and by_id[2] == 2 and by_id[4] == 4 and by_id[None] is None
    assert ngram_jaccard.near_duplicates(empty(spark)).count() == 0


def test_sketch_distance_is_a_lower_bound_and_folds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)
        one = np.unique(np.append(both, rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64)))
        other = np.unique(np.append(both, rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)))
        near = ngram_jaccard.hamming(ngram_jaccard.dense_sketch(one), [ngram_jaccard.dense_sketch(other)])[0]
        assert near <= len(np.setxor1d(one, other))


def test_linked_sets_always_share_a_looked_up_piece():
    rng, bands = np.random.default_rng(2), ngram_jaccard.Bands()
    for _ in range(300):
        n = int(rng.integers(4, 300))
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        other = np.unique(np.append(one[drop:], rng.integers(0, 1 << 63, drop // 2, dtype=np.uint64)))
        if len(one) < 1 or not len(other) or not ngram_jaccard.linked(one, other, 80) or np.array_equal(one, other):
            continue
        keys = [np.concatenate([ngram_jaccard.pieces_of(s, *b) for b in bands.plan(len(s))]) for s in (one, other)]
        assert len(np.intersect1d(*keys))


@pytest.mark.parametrize("shape", ["path", "star", "mixed"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(50)],
             "mixed": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]}[shape]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert all(got.get(x, x) == find(x) for x in parent)


def test_fm_index_against_counting():
    rng = random.Random(3)
    for _ in range(120):
        length, letters = rng.choice((3, 4, 5)), rng.choice((2, 3, 6, 30))
        held = [np.array([rng.randrange(letters) * 7 + 5 for _ in range(rng.randint(length, 12))], np.uint64) for _ in range(rng.randint(1, 12))]
        asked = [*held, np.array([rng.randrange(letters + 1) * 7 + 5 for _ in range(10)], np.uint64)]
        need = np.array([2] * len(held) + [1])
        count = Counter(tuple(s[i:i + length]) for s in held for i in range(len(s) - length + 1))
        masks = fm_index.repeated_windows(fm_index.FMIndex(held), asked, need, length)
        for s, mask, n in zip(asked, masks, need, strict=True):
            assert int(mask) == sum(1 << i for i in range(len(s) - length + 1) if count[tuple(s[i:i + length])] >= n)


def removed(rows, length=35):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    count = Counter(tuple(w[i:i + length]) for _, w in texts for i in range(len(w) - length + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_segments", [8_000, 3])
def test_substring_removal_equals_brute_force(spark, shard_segments):
    rng = random.Random(8)
    passage = [f"p{i % 53}" for i in range(70)]
    rows = []
    for i in range(60):
        own = [f"o{rng.randrange(300)}" for _ in range(rng.choice((5, 40, 90, 200)))]
        at = rng.randrange(len(own))
        cut = rng.randrange(60)
        rows.append((i, " ".join(own[:at] + (passage[cut:] if i % 3 == 0 else passage[:36] if i % 3 == 1 else []) + own[at:])))
    rows += [(100, "la " * 300), (101, "a b c " * 80), (102, "la " * 34), (103, None), (104, ""), (105, rows[2][1]), (105, rows[2][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS doc", "2 AS gram", "3 AS start")
    got = sorted((tuple(r) for r in substring_dedup.removal_digest(df, shard_segments=shard_segments).collect()), key=str)
    assert got == removed(rows)


def test_substring_removal_of_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in substring_dedup.removal_digest(df).collect()), key=str)
    assert got == removed(rows)
    assert substring_dedup.removal_digest(empty(spark)).count() == 0


def test_rows_without_an_id_are_told_apart_by_their_whole_texts(spark):
    """Two texts of equal checksum, one with a passage that another row repeats."""
    import zlib

    passage = " ".join(f"w{i}" for i in range(40))
    plain = " ".join(f"v{i}" for i in range(40))
    rng = random.Random(1)

    def word():
        return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6))

    of = {zlib.crc32(t.encode()): t for t in (f"{passage} {word()}" for _ in range(150_000))}
    twin = next(t for t in (f"{plain} {word()}" for _ in range(10**6)) if zlib.crc32(t.encode()) in of)
    rows = [(None, of[zlib.crc32(twin.encode())]), (None, twin), (1, f"x {passage} y")]
    got = substring_dedup.removal_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 40, 40]


def test_rows_without_an_id_keep_their_own_words(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(None, f"{passage} a"), (None, f"{passage} a"), (None, " ".join(f"v{i}" for i in range(50))), (1, f"x {passage} y"), (None, None)]
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substring_dedup.removal_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(False, 42, 40), (True, 0, 0), (True, 41, 41), (True, 41, 41), (True, 50, 0)]
