"""Small tables with the awkward rows every operator must answer."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that clash with names the operators add.
CLASHES = ("score", "copy", "rate", "order_key", "shard", "slot", "size", "key", "label", "window", "component_id", "n", "mark", "kept")


def awkward(spark, extra=()):
    long_text = " ".join(f"w{i * 7919 % 5000}" for i in range(30_000))
    rows = [
        (1, "Plain words of a short text that goes on for a little while so that it has some windows", "en", "a"),
        (2, None, "en", "a"), (3, "", None, "a"), (4, " \t\n ", "en", None), (5, long_text, "en", "b"), (6, long_text, "en", "b"),
        (7, "one", "en", "b"), (8, "one", "en", "b"), (8, "one", "en", "b"), (None, "no id here", "en", "a"), (None, None, None, None),
        (9, "ünï çödé ñandú 漢字 \U0001F600 words", "de", "c"), *extra,
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
