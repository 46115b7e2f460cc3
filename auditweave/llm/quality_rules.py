"""Quality rules as weak supervision.

Rules vote good or bad on a text, or abstain. The accuracies of the rules and the share of good
texts are not given; expectation-maximisation finds them from the votes alone: a text's posterior
under the current accuracies weighs its votes, and the weighed votes give new accuracies. A text
is kept by its posterior, so no single rule rejects it.

All counts are DataFrame expressions over the whole text. The estimation sees only how many texts
show each combination of votes, at most 3 to the power of the number of rules (ten) rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.tables import text_or_empty
from auditweave.session import durable

#: Pattern of the contract: white space is the space and 0x09 to 0x0D.
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
BAD, GOOD, ABSTAIN = 0, 1, 2
RULES = ("length", "symbols", "lines", "windows", "word_length", "capitals", "exclamation", "letters", "letterless", "variety")


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each text that rules look at; one row per row of ``docs``.

    n_words; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``; n_dup_lines:
    lines with a word that equal an earlier line; n_repeat_words: words in 3-word windows found twice
    or more in the text, the first included; besides n_lines, n_capitals, n_marks, n_letters, n_letterless
    (words without a letter), n_distinct.
    """
    text = F.col("__text")
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, _SPACE, "") != "")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("bigint")

    rows = docs.select("doc_id", text_or_empty().alias("__text")).select(
        "doc_id", words.alias("__words"), lines.alias("__lines"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("bigint").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), count("\\p{Lu}").alias("n_capitals"), count("!").alias("n_marks"),
        count("\\p{L}").alias("n_letters"),
        F.regexp_count(text, F.lit("(?<![^ \\t\\n\\x0B\\f\\r])[^\\p{L} \\t\\n\\x0B\\f\\r]+(?![^ \\t\\n\\x0B\\f\\r])")).cast("bigint").alias("n_letterless"))
    word = F.transform("__words", lambda w: F.xxhash64(w))
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_letters", "n_letterless",
        F.size("__words").cast("bigint").alias("n_words"), F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        word.alias("__hashes"))
    third = F.slice("__hashes", 3, F.greatest(F.size("__hashes"), F.lit(2)) - 2)
    second = F.slice("__hashes", 2, F.greatest(F.size("__hashes"), F.lit(2)) - 2)
    windows = F.filter(F.transform(F.arrays_zip(F.col("__hashes").alias("a"), second.alias("b"), third.alias("c")),
                                   lambda x: F.when(x["c"].isNotNull(), F.xxhash64(x["a"], x["b"], x["c"]))), lambda x: x.isNotNull())
    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("__hashes")).cast("bigint")).withColumn("__windows", windows).drop("__hashes")
    # Only texts that repeat a window have their windows sorted with positions.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(repeats, F.array_sort(F.transform("__windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    rows = rows.withColumn("__sorted", placed).drop("__windows")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.col("__sorted.x"), 1, F.greatest(F.size("__sorted"), F.lit(1)) - 1))
    after = F.concat(F.slice(F.col("__sorted.x"), 2, F.greatest(F.size("__sorted"), F.lit(1)) - 1), F.array(F.lit(None).cast("bigint")))
    both = F.arrays_zip(F.col("__sorted").alias("s"), before.alias("p"), after.alias("n"))
    same = F.filter(both, lambda x: F.coalesce(x["s"]["x"] == x["p"], F.lit(False)) | F.coalesce(x["s"]["x"] == x["n"], F.lit(False)))
    rows = rows.withColumn("__starts", F.sort_array(F.transform(same, lambda x: x["s"]["i"])))
    covered = F.aggregate(
        "__starts", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("__sorted", "__starts")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """Rule name to its vote over the columns of :func:`text_statistics`; short texts leave most rules silent."""
    n, some = F.col("n_words"), F.col("n_words") >= 20
    lines = F.col("n_lines")

    def share(column: str, of: Column, bad: float, good: float) -> Column:
        return _vote(some & (F.col(column) > bad * of), some & (F.col(column) <= good * of))

    return {
        "length": _vote(n < 5, n >= 50),
        "symbols": share("n_symbols", n, 0.25, 0.05),
        "lines": _vote((lines >= 4) & (F.col("n_dup_lines") > 0.3 * lines), (lines >= 4) & (F.col("n_dup_lines") == 0)),
        "windows": share("n_repeat_words", n, 0.3, 0.1),
        "word_length": _vote(some & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
                             some & (F.col("word_chars") >= 3 * n) & (F.col("word_chars") <= 11 * n)),
        "capitals": share("n_capitals", F.col("n_letters"), 0.4, 0.15),
        "exclamation": share("n_marks", n, 0.3, 0.05),
        "letters": _vote(some & (F.col("n_letters") < 0.75 * F.col("word_chars")), some & (F.col("n_letters") > 0.88 * F.col("word_chars"))),
        "letterless": share("n_letterless", n, 0.25, 0.08),
        "variety": _vote((n >= 50) & (n < 2000) & (F.col("n_distinct") < 0.2 * n), (n >= 50) & (F.col("n_distinct") > 0.35 * n)),
    }


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[list[list[float]]]]:
    """Share of good texts and, per rule, P(bad vote) and P(good vote) among bad and good texts it votes on.

    A rule that abstains says nothing, so short texts are not taken for a class of their own. Bad votes
    are rare and good ones cheap: the start takes a text with one bad vote for bad at 3 to 1, with
    more at 19 to 1, and one without for good at 9 to 1. One half is added to every count.
    """
    rules = len(counts[0][0]) if counts else len(RULES)
    weight = [(0.9, 0.25, 0.05)[min(pattern.count(BAD), 2)] for pattern, _ in counts]
    prior, tables = 0.5, [[[0.5, 0.5], [0.5, 0.5]] for _ in range(rules)]
    for _ in range(rounds):
        total = sum(n for _, n in counts)  # without texts everything stays even
        prior = (sum(w * n for w, (_, n) in zip(weight, counts, strict=True)) + 0.5) / (total + 1)
        tables = [[[0.5, 0.5], [0.5, 0.5]] for _ in range(rules)]
        for w, (pattern, n) in zip(weight, counts, strict=True):
            for r, vote in enumerate(pattern):
                if vote != ABSTAIN:
                    tables[r][0][vote] += (1 - w) * n
                    tables[r][1][vote] += w * n
        tables = [[[x / sum(row) for x in row] for row in rule] for rule in tables]
        weight = [posterior(prior, tables, pattern) for pattern, _ in counts]
    return prior, tables


def posterior(prior: float, tables: list[list[list[float]]], pattern: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior))
    odds += sum(math.log(t[1][v] / t[0][v]) for t, v in zip(tables, pattern, strict=True) if v != ABSTAIN)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of each text with ``base_failed``, ``quality`` (posterior) and ``kept``.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. kept: not
    base_failed and a posterior of one half or more.

    ``docs`` needs doc_id and text; more columns are ignored. NULL text: an empty one. Repeated rows and
    NULL ids: judged each for itself. Empty table: no row.
    """
    rules = votes()
    seen = text_statistics(docs).withColumns({f"vote_{k}": v for k, v in rules.items()})
    seen = durable(seen)
    names = [f"vote_{k}" for k in rules]
    counts = [(tuple(row[n] for n in names), row["count"]) for row in seen.groupBy(*names).count().collect()]
    prior, tables = estimate(sorted(counts))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, table in zip(names, tables, strict=True):
        gain = [math.log(table[1][v] / table[0][v]) for v in (BAD, GOOD)]
        odds = odds + F.when(F.col(name) == BAD, gain[0]).when(F.col(name) == GOOD, gain[1]).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        seen.withColumn("quality", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )
