"""Exact dedup, centroid clustering and the source divergence audit against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from auditweave.llm import centroid_clustering as cc
from auditweave.llm import divergence as dv
from auditweave.llm import exact_dedup as ed


# Exact dedup

def plain_fingerprint(data: bytes) -> list[int]:
    out = []
    for base in ed._BASES:
        h = 0
        for b in data:
            h = (h * base + b) % ed.PRIME
        out.append(h)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=50) | st.integers(0, 20_000).map(lambda n: bytes(i * 31 % 251 for i in range(n))), min_size=1, max_size=4))
def test_fingerprints_equal_horner_and_compose(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    got = ed.fingerprints(data, bounds)
    assert [got[:, i].tolist() for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]
    whole = got[:, 0]
    for i in range(1, len(texts)):
        whole = ed.combine(whole, got[:, i], len(texts[i]))
    assert whole.tolist() == plain_fingerprint(b"".join(texts))


def test_documents_in_parts_have_the_fingerprint_of_the_whole(spark):
    docs = {k: "".join(chr(97 + (i * k) % 26) for i in range(9_000 * k)) + "ÄX" for k in range(1, 5)} | {9: ""}
    parts = [(k, i // 1000, t[i:i + 1000]) for k, t in docs.items() for i in range(0, max(len(t), 1), 1000)] + [(9, 7, None)]
    rows = ed.fingerprints_of_parts(spark.createDataFrame(parts, "key bigint, part int, text string").repartition(5)).collect()
    got = {r["key"]: (r["length"], [r[f"f{i}"] for i in range(ed.LANES)]) for r in rows}
    want = {k: t.translate(LOWER).encode() for k, t in docs.items()}
    assert got == {k: (len(t), plain_fingerprint(t)) for k, t in want.items()}


def plain_duplicates(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = True
        for doc_id in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out[doc_id, keep, len(ids), stays and doc_id == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
            stays = False
    return out


@pytest.mark.parametrize("bits", [31, 1])
def test_exact_copies_also_where_fingerprints_collide(spark, bits):
    """With one bit a lane nearly all short texts of a length collide; chunks of 3 bytes compare them."""
    extra = [(100 + i, t, "en", "a") for i, t in enumerate(["abcdef", "ABCDEF", "abcdeg", "xbcdef", "ABCdeg", "äbcd", "Äbcd", "x" * 200_000, "X" * 200_000] * 3)]
    extra += [(None, "ABCDEF", "en", "a"), (300, None, None, None)]
    df = awkward(spark, extra)
    got = Counter(tuple(r) for r in ed.duplicates(df, bits=bits, chunk=3 if bits == 1 else 1 << 16, slots=1 << 17).collect())
    assert got == plain_duplicates([(r["doc_id"], r["text"]) for r in df.collect()])


def test_a_group_of_a_third_of_all_rows_meets_its_result_by_broadcast(spark):
    rows = [(i, "Same Text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = Counter(tuple(r) for r in ed.duplicates(df, heavy_share=100).collect())
    assert got == plain_duplicates(rows)
    assert ed.duplicates(empty(spark)).count() == 0


# Centroid clustering

def plain_clusters(rows, clusters=8, rounds=10, scale=1024, seed=3, width=64):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e9 else scale * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    points = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        points = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else p for c, p in enumerate(points)]
    final = [(i, *nearest(v)) for i, v in kept]
    whole, per = sum(d for _, d, _ in final), Counter()
    for _, d, c in final:
        per[c] += d

    def fits(n):
        return n if n < 1 << 63 else None

    return Counter((i, c, fits(d), fits(per[c]), fits(whole), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in final)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "0.5D AS upper", "'x' AS cluster", "1 AS vector").repartition(3)


def test_shallot_search_equals_full_search(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] * (i % 4 > 0) + rng.normal(size=64) * 0.4).tolist()) for i in range(400)]
    # Ties: many equal rows, and coarse values that lie as far from one centroid as from another.
    rows += [(500 + i, [float(x) for x in rng.integers(0, 2, 64)]) for i in range(60)] + [(700, [0.0] * 64)] * 5 + [(None, [0.25] * 64)]
    rows += [(800, None), (801, [1.0] * 63), (802, [1.0] * 63 + [None]), (803, [math.nan] * 64), (804, [math.inf] + [0.0] * 63), (805, []), (806, [1.0] * 65)]
    got = Counter(tuple(r) for r in cc.cluster(vectors(spark, rows)).collect())
    assert got == plain_clusters(rows)


def test_huge_components_few_rows_and_no_rows(spark):
    wide = [(1, [1e30] + [0.0] * 63), (2, [-1e30] + [0.5] * 63), (3, [1e5] * 64), (4, [0.1] * 64)] + [(10 + i, [i / 7] * 64) for i in range(12)]
    for rows, k in ((wide, 8), (wide[2:5], 8), (wide[3:4], 8), (wide, 1)):
        got = Counter(tuple(r) for r in cc.cluster(vectors(spark, rows), clusters=k, rounds=4).collect())
        assert got == plain_clusters(rows, clusters=k, rounds=4)
    assert cc.cluster(vectors(spark, [(1, None)])).count() == 0


def test_the_ball_spares_comparisons():
    """Bounds settle most rows of well separated groups without any distance."""
    rng = np.random.default_rng(1)
    points = [[int(v) for v in rng.integers(-5000, 5000, 64)] for _ in range(40)]
    x = np.repeat(np.array(points), 50, 0) + rng.integers(-40, 40, (2000, 64))
    state = (np.full(2000, -1, np.int32), np.full(2000, -1, np.int32), np.zeros(2000), np.zeros(2000))
    first, second, upper, lower, _ = cc.assign(x, cc.Centroids(points, None), *state)
    assert (first == np.repeat(np.arange(40), 50)).all()
    moved = [[v + 3 for v in p] for p in points]
    again = cc.assign(x, cc.Centroids(moved, points), first, second, upper, lower)
    assert (again[0] == first).all() and (again[4] == -1).all()


# Source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, min_df=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_df]
        held = {s: counts[lang, s] for g, s in groups if g == lang}
        everyone = Counter()
        for c in held.values():
            everyone.update(c)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))

        prob = {s: {t: p(c, t) for t in kept} for s, c in held.items()}
        common = {t: p(everyone, t) for t in kept}
        for s in held:
            pairs = [(-sum((prob[s][t] - prob[o][t]) ** 2 // prob[o][t] for t in kept), o.encode()) for o in held if o != s]
            terms = [(-((prob[s][t] - common[t]) ** 2 // common[t]), t.encode()) for t in kept if held[s][t] and prob[s][t] > common[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("slice_terms,top,limit", [(1_000_000, 200, 10_000), (40, 7, 0)])
def test_divergence_equals_brute_force(spark, slice_terms, top, limit):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "abcdeÄÉ漢" for b in "XyzüQ\U0001F600"]
    text = lambda n: " ".join(rng.choice(words, n, p=(w := 1 / np.arange(1, len(words) + 1)) / w.sum()))
    extra = [(200 + i, text(1 + i % 40) + ". 7-X_y", ("en", "de", "fr")[i % 3], f"s{i % 5}" if i % 2 else "hot") for i in range(150)]
    extra += [(900, "lonely words here", "xx", "only"), (901, "lonely", "yy", "a"), (902, None, "yy", "b"), (903, "1 2 3", "en", "silent")]
    df = awkward(spark, extra).withColumnsRenamed({"rate": "term_no", "label": "total", "copy": "none"}).repartition(4)
    rows = [(r["lang"], r["source"], r["text"]) for r in df.collect()]
    got = [tuple(r) for r in dv.divergence(df, slice_terms=slice_terms, top=top, broadcast_groups=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, top=top)
    assert dv.divergence(empty(spark)).count() == 0


def test_slices_are_chosen_by_all_terms(spark):
    rows = [("en", " ".join(f"{chr(97 + i)}{chr(97 + j)}" for j in range(26))) for i in range(25)] + [("en", "aa ab AA"), ("de", "ein Haus"), ("", "")]
    named = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    dv.send_with_tasks("auditweave.llm.divergence")
    assert dv._slices(named, 100) == {"en": 7, "de": 1} and dv._slices(named, 1) == {"en": 651, "de": 3}
