"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose figures or persons were
exchanged has the template of the original. Windows of ``width`` tokens are
hashed and joined with the benchmark's, once as plain words in lower case and once per level of
typing that changes them: numbers and units, names inside sentences, all capitalised words. Copies in
other case or with other line breaks have the plain windows, and names at a sentence start the last. Where a
window has placeholders, equal values of the item must stand against equal values of the text; windows
whose values are those of the item always count. A text is contaminated by an item when
such windows make up ``coverage`` of the item's windows or more, or hold ``run`` tokens in a row.

Few texts have anything of a benchmark, and few places of those. Each window of the benchmark has an anchor for
each level at which it can match: up to four of its words in a row that are typed at none of the levels up to
that one. A text that matches the window holds the anchor word for word. A bitmap of fixed size of all
anchors' hashes so tells which texts are tokenised and typed, and where in them windows are made; it can let a
text through in vain, but cannot miss one.

Tokens are runs of letters and digits in lower case; a name is a capitalised word after a word, comma
or semicolon and white space, a unit is a word of the list below after a number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.tables import text_or_empty
from auditweave.session import durable

#: Symbols and names of common units.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons",
         "ounce", "ounces", "pound", "pounds", "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "second", "seconds",
         "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "degrees",
         "dollar", "dollars", "cent", "cents", "euro", "euros", "metre", "metres", "meter", "meters", "kmh", "mph", "hz", "khz", "mhz",
         "watt", "watts", "kw", "volt", "volts", "joule", "joules", "newton", "newtons")

#: In front of a name inside a sentence, and of any other capitalised word.
_NAME_MARK, _CAPITAL_MARK = "\ue000", "\ue001"
_MARKS = f"[{_NAME_MARK}{_CAPITAL_MARK}]"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"

#: What is typed in a window: nothing, numbers and units, names inside sentences too, all capitalised words too.
PLAIN, NUMBERS, NAMES, CAPITALS = 1, 2, 3, 4


def _raw_tokens(text: Column) -> Column:
    """Tokens in lower case, capitalised words marked in front; digits and letters are separate tokens."""
    # The rare letter or mark comes first in each pattern, the look behind it after that.
    capital = F.regexp_replace(text, "\\p{Lu}(?=\\p{Ll})(?<![\\p{L}\\p{M}\\p{Nd}].)", f"{_CAPITAL_MARK}$0")
    named = F.regexp_replace(capital, f"{_CAPITAL_MARK}(?<=[\\p{{Ll}}\\p{{Nd}},;]\\s{{1,40}}.)", _NAME_MARK)
    joined = F.regexp_replace(named, "[.,](?=\\p{Nd})(?<=\\p{Nd}.)", "")
    split = F.regexp_replace(joined, "\\p{Nd}(?=\\p{L})|\\p{L}(?=\\p{Nd})", "$0 ")
    kept = F.when(text.rlike("\\p{Nd}"), split).otherwise(named)
    return F.trim(F.regexp_replace(F.lower(kept), f"[^\\p{{L}}\\p{{M}}\\p{{Nd}}{_NAME_MARK}{_CAPITAL_MARK}]+", " "))


def _template(raw: Column) -> Column:
    """The same tokens with placeholders for numbers, units and all marked words."""
    numbered = F.regexp_replace(raw, "\\p{Nd}[\\p{Nd}\\p{M}]*", NUMBER)
    units = F.regexp_replace(numbered, f"{NUMBER} {_MARKS}?(?:{'|'.join(UNITS)})(?![^ ])", f"{NUMBER} {UNIT}")
    return F.regexp_replace(F.when(raw.rlike("\\p{Nd}"), units).otherwise(raw), f"{_MARKS}[^ ]*", NAME)


def _tokens(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``__plain`` tokens, ``__hashes`` of them, and ``__levels`` and ``__typed``: level and placeholder per token.

    The level of a token is the first at which it is typed, PLAIN if it never is; the last two are NULL without placeholders.
    """
    rows = df.select(*keys, _raw_tokens(text_or_empty()).alias("__raw")).withColumn("__templated", _template(F.col("__raw")))
    plain = F.split(F.translate("__raw", _NAME_MARK + _CAPITAL_MARK, ""), " ")
    typed = F.col("__templated") != F.col("__raw")
    rows = rows.select(
        *keys, F.when(F.col("__raw") != "", plain).otherwise(F.array().cast("array<string>")).alias("__plain"),
        F.when(typed, F.split("__templated", " ")).alias("__typed"), F.when(typed, F.split("__raw", " ")).alias("__marked"))

    def level(token: Column, i: Column) -> Column:
        named = F.substring(F.element_at("__marked", i + 1), 1, 1) == _NAME_MARK
        return F.when(F.substring(token, 1, 1) != "<", PLAIN).when(token != NAME, NUMBERS).when(named, NAMES).otherwise(CAPITALS)

    return rows.select(*keys, "__plain", F.transform("__plain", lambda t: F.xxhash64(t)).alias("__hashes"),
                       F.transform("__typed", level).alias("__levels"), "__typed")


#: Lengths of anchors, and the bits of the bitmap that marks them.
ANCHORS, _BITS = (4, 3, 2, 1), 1 << 18


def _anchor(words: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from a place on; a place near the end takes fewer, which no anchor does."""
    return F.xxhash64(F.lit(length), *(F.get(words, at + i) for i in range(length)))


def _window_anchors(items: DataFrame, width: int) -> DataFrame:
    """``first, anchor, length``: of each window and level a run of up to four words typed at no level up to it, and its first two.

    Windows that have none at a level cannot match at it, but for those of numbers alone at the plain one: length 0.
    """
    levels = (PLAIN, NUMBERS, NAMES, CAPITALS)

    def free(level: int) -> Column:
        return F.transform("__plain", lambda t, i: ~t.rlike("\\p{Nd}") & ~F.coalesce(F.get("__levels", i).between(NUMBERS, level), F.lit(False)))

    rows = items.select("__plain", *(free(level).alias(f"__free_{level}") for level in levels))
    rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(0), F.size("__plain") - width)))

    def longest(level: int, length: int) -> Column:
        places = F.filter(F.sequence(F.col("__from"), F.col("__from") + width - length),
                          lambda at: F.forall(F.slice(f"__free_{level}", at + 1, length), lambda x: x))
        # Long words are rare ones, and let few places of other texts through.
        best = F.array_max(F.transform(places, lambda at: F.struct(
            F.length(F.array_join(F.slice("__plain", at + 1, min(length, 2)), "")).alias("letters"), at.alias("at"))))
        first = _anchor(F.col("__plain"), best["at"], min(length, 2))
        return F.when(best.isNotNull(), F.struct(first.alias("first"), _anchor(F.col("__plain"), best["at"], length).alias("anchor"), F.lit(length).alias("length")))

    nothing = F.struct(F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("anchor"), F.lit(0).alias("length"))
    lengths = [k for k in ANCHORS if k <= width]
    found = [F.coalesce(*(longest(level, k) for k in lengths), *([nothing] if level == PLAIN else [])) for level in levels]
    return rows.select(F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("x")).select("x.*").distinct()


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _constant(bits: bytearray) -> Column:
    """A bitmap as an array of 64-bit words, which the optimiser folds into a constant."""
    words = [int.from_bytes(bits[i:i + 8], "little", signed=True) for i in range(0, len(bits), 8)]
    return F.split(F.lit(" ".join(map(str, words))), " ").cast("array<bigint>")


def _bit(bitmap: Column, slot: Column) -> Column:
    return F.bit_get(F.get(bitmap, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _slots_of(anchor: Column) -> list[Column]:
    """Three places of the bitmap: three parts of the hash."""
    return [F.shiftrightunsigned(anchor, 18 * i).bitwiseAND(F.lit(_BITS - 1)) for i in range(3)]


class Anchors:
    """The anchors of a benchmark as two bitmaps of fixed size: one bit for the first two words of each, three for all of it."""

    def __init__(self, anchors: DataFrame):
        known = anchors.where("length > 0")
        first = known.select(F.lit(0).alias("map"), "length", _slots_of(F.col("first"))[0].alias("slot"))
        whole = known.select(F.lit(1).alias("map"), "length", F.explode(F.array(*_slots_of(F.col("anchor")))).alias("slot"))
        blocks = first.unionByName(whole).groupBy("map", F.shiftright("slot", 15).alias("block")).agg(
            F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"), F.collect_set("length").alias("lengths"))
        maps = [bytearray(_BITS // 8), bytearray(_BITS // 8)]
        self.lengths = []
        # At most twice 8 rows of 4 KB, however large the benchmark is.
        for r in blocks.collect():
            self.lengths = sorted({*self.lengths, *r["lengths"]})
            maps[r["map"]][r["block"] * 4096:r["block"] * 4096 + len(r["bits"])] = r["bits"]
        self.numeric = not anchors.where("length = 0").isEmpty()
        self._firsts, self._wholes = map(_constant, maps)

    def _begin(self, words: Column, firsts: Column, wholes: Column) -> Column:
        """For each place of an array of words whether an anchor may begin there; most places end at their two words."""
        def met(at: Column, first: int, lengths: list[int]) -> Column:
            whole = _any([_all([_bit(wholes, s) for s in _slots_of(_anchor(words, at, k))]) for k in lengths])
            return F.when(_bit(firsts, _slots_of(_anchor(words, at, first))[0]), whole).otherwise(F.lit(False))

        longer = [k for k in self.lengths if k > 1]
        return F.transform(words, lambda word, at: _any([met(at, 2, longer)] * bool(longer) + [met(at, 1, [1])] * (1 in self.lengths)))

    def _with_words(self, words: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of the places of ``words``; words and bitmaps stand in the plan once, and words are made once a row."""
        return _let(self._firsts, lambda firsts: _let(self._wholes, lambda wholes: _let(words, lambda t: use(self._begin(t, firsts, wholes)))))

    def may_match(self, text: Column, width: int) -> Column:
        """Whether a text can match a window; it is split into runs of letters only."""
        met = self._with_words(F.split(F.lower(text), "[^\\p{L}\\p{M}]+"), lambda begin: F.exists(begin, lambda hit: hit))
        out = met | text.contains(_NAME_MARK) | text.contains(_CAPITAL_MARK)
        return out | text.rlike(f"(?:\\p{{Nd}}[^\\p{{L}}\\p{{Nd}}]*+){{{width}}}") if self.numeric else out

    def starts(self, width: int) -> Column:
        """Places of windows of ``width`` tokens that hold an anchor, of an array ``__plain``."""
        last = F.size("__plain") - width

        def places(hits: Column) -> Column:
            return F.filter(F.transform(hits, lambda hit, i: F.when(hit, i)), lambda i: i.isNotNull())

        held = self._with_words(F.col("__plain"), places)
        if self.numeric:
            numbers = F.transform("__plain", lambda t, i: F.forall(F.slice("__plain", i + 1, width), lambda x: x.rlike("^\\p{Nd}")))
            held = F.concat(held, places(numbers))
        near = F.flatten(F.transform(held, lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), F.least(i, last))))
        return F.when(last >= 0, F.array_distinct(near)).otherwise(F.array().cast("array<int>"))


def _windows(rows: DataFrame, keys: list[str], width: int, starts: Column) -> DataFrame:
    """``keys, at, level, window, values``: plain windows of ``width`` tokens at ``starts``, and per level those that type another token.

    values are the plain tokens.
    """
    def hashed(hashes: str, at: Column, level: int) -> Column:
        return F.struct(at.alias("at"), F.lit(level).alias("level"), F.xxhash64(F.slice(hashes, at + 1, width)).alias("window"),
                        F.slice("__plain", at + 1, width).alias("values"))

    def present(level: int) -> Column:
        return F.array_contains("__levels", level)

    def typed(level: int) -> Column:
        return F.transform("__hashes", lambda h, i: F.when(
            F.element_at("__levels", i + 1).between(NUMBERS, level), F.xxhash64(F.element_at("__typed", i + 1))).otherwise(h))

    def at_level(level: int) -> Column:
        places = F.filter("__starts", lambda at: F.array_contains(F.slice("__levels", at + 1, width), level))
        found = F.transform(places, lambda at: hashed(f"__hashes_{level}", at, level))
        return F.when(present(level), found).otherwise(F.array().cast("array<struct<at:int,level:int,window:bigint,values:array<string>>>"))

    levels = (NUMBERS, NAMES, CAPITALS)
    rows = rows.withColumn("__starts", starts).where(F.size("__starts") > 0)
    plain = F.transform("__starts", lambda at: hashed("__hashes", at, PLAIN))
    rows = rows.select("*", *(F.when(present(k), typed(k)).alias(f"__hashes_{k}") for k in levels))
    return rows.select(*keys, F.inline(F.concat(plain, *(at_level(k) for k in levels))))


def _slots(rows: DataFrame) -> DataFrame:
    """``__slots``: position, level, type and value of the placeholders."""
    slots = F.transform("__typed", lambda t, i: F.struct(
        i.alias("at"), F.element_at("__levels", i + 1).alias("level"), t.alias("kind"), F.element_at("__plain", i + 1).alias("value")))
    return rows.withColumn("__slots", F.filter(slots, lambda s: s["level"] > PLAIN))


def _within(slots: Column, at: Column, width: int, level: Column) -> Column:
    return F.transform(F.filter(slots, lambda s: (s["at"] >= at) & (s["at"] < at + width) & (s["level"] <= level)),
                       lambda s: F.struct((s["at"] - at).alias("at"), s["kind"].alias("kind"), s["value"].alias("value")))


def _searched(benchmark: DataFrame, least: int) -> DataFrame:
    items = _tokens(benchmark.select("item_id", "text"), ["item_id"])
    return items.where(F.size("__hashes") >= least)


def unsearched(benchmark: DataFrame, least: int = 5) -> DataFrame:
    """``item_id, tokens``: the items of fewer than ``least`` tokens, which ``contaminated`` does not look for."""
    items = _tokens(benchmark.select("item_id", "text"), ["item_id"])
    return items.select("item_id", F.size("__hashes").alias("tokens")).where(F.col("tokens") < least)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, least: int = 5, coverage: float = 0.3,
                 broadcast_windows: int = 100_000, run: int = 13) -> DataFrame:
    """``doc_id, item_id, item_windows, matched_windows``: the items that each row of ``docs`` gives away.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; more columns are ignored. An item of fewer than
    ``width`` tokens is one window of its own length; those of fewer than ``least`` are in ``unsearched``. A
    window of placeholders alone matches only where its values are the same. The benchmark is sent to all executors
    while it has ``broadcast_windows`` windows or fewer (some 300 bytes each), and is shuffled beyond that.

    An item counts when ``coverage`` of its windows match, or ``run`` of its tokens in a row in one alignment. A
    window is dropped if one value of the item stands against two of the text in it; a window that has the item's
    own values always counts.

    NULL or empty texts match nothing; rows with NULL ids are matched like others. Repeated rows of
    ``docs`` count as one; repeated items are one. Empty tables: no row.
    """
    items = durable(_searched(benchmark, least).withColumn("__width", F.least(F.size("__hashes"), F.lit(width))))
    widths = sorted(r["__width"] for r in items.select("__width").distinct().collect()) or [width]
    of_width = {w: items.where(F.col("__width") == w) for w in widths}
    anchors = None
    for w in widths:
        found = _window_anchors(of_width[w], w)
        anchors = found if anchors is None else anchors.unionByName(found)
    anchors = Anchors(anchors.distinct())
    text = text_or_empty()
    texts = durable(_tokens(docs.select("doc_id", "text").where(anchors.may_match(text, widths[0])), ["doc_id"]))
    matches = None
    for w in widths:
        part = _matches(texts, of_width[w], w, anchors, broadcast_windows)
        matches = part if matches is None else matches.unionByName(part)
    return _judged(_sound_windows(matches), coverage, run)


def _matches(texts: DataFrame, items: DataFrame, width: int, anchors: Anchors, broadcast_windows: int) -> DataFrame:
    """``doc_id, item_id, item_windows, width, item_at, shift, pairs``; pairs: kind, item's value, text's value."""
    known = _slots(items).withColumn("item_windows", F.size("__hashes") - width + 1)
    known = _windows(known, ["item_id", "item_windows", "__slots"], width, F.sequence(F.lit(0), F.size("__plain") - width))
    slots = _within(F.col("__slots"), F.col("at"), width, F.col("level"))
    known = known.withColumn("item_slots", slots).where((F.col("level") == PLAIN) | (F.size("item_slots") < width)).select(
        "item_id", "window", F.col("at").alias("item_at"), F.when(F.col("level") > PLAIN, F.col("item_slots")).alias("item_slots"),
        F.col("item_windows").cast("bigint"))
    found = _windows(texts, ["doc_id"], width, anchors.starts(width))
    known = durable(known)
    joined = found.join(F.broadcast(known) if known.count() <= broadcast_windows else known, "window")
    pairs = F.transform("item_slots", lambda s: F.struct(
        s["kind"].alias("kind"), s["value"].alias("ours"), F.element_at("values", s["at"] + 1).alias("theirs")))
    return joined.select("doc_id", "item_id", "item_windows", F.lit(width).alias("width"), "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"))


def _sound_windows(matches: DataFrame) -> DataFrame:
    """``doc_id, item_id, item_windows, width, shift, item_at`` of windows in which no value of the item has two values in the text.

    Two values of the item may get the same new one, and windows equal to the item's have no conflict.
    """
    pairs = F.array_distinct(F.coalesce("pairs", F.array()))
    ours = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["ours"])))
    same = ~F.exists(pairs, lambda p: p["ours"] != p["theirs"])
    return matches.where(same | (F.size(ours) == F.size(pairs))).select("doc_id", "item_id", "item_windows", "width", "shift", "item_at").distinct()


def _longest(windows: Column) -> Column:
    """How many of the positions follow each other at most."""
    ended = F.aggregate(
        F.sort_array(windows), F.struct(F.lit(-2).alias("last"), F.lit(0).alias("length"), F.lit(0).alias("most")),
        lambda a, at: F.struct(
            at.alias("last"), F.when(at == a["last"] + 1, a["length"] + 1).otherwise(1).alias("length"),
            F.greatest(a["most"], F.when(at == a["last"] + 1, a["length"] + 1).otherwise(1)).alias("most")))
    return ended["most"]


def _judged(sound: DataFrame, coverage: float, run: int) -> DataFrame:
    """The items of which enough windows are left: a share of all, or so many in a row that they hold ``run`` tokens."""
    item = ["doc_id", "item_id", "item_windows", "width"]
    lined_up = sound.groupBy(*item, "shift").agg(F.collect_set("item_at").alias("windows"))
    lined_up = lined_up.withColumn("longest", _longest(F.col("windows")))
    found = lined_up.select(*item, "longest", F.explode("windows").alias("item_at")).groupBy(*item).agg(
        F.countDistinct("item_at").alias("matched_windows"), F.max("longest").alias("longest"))
    in_a_row = F.greatest(F.lit(run) - F.col("width") + 1, F.lit(1))
    return found.where((F.col("matched_windows") >= F.ceil(coverage * F.col("item_windows"))) | (F.col("longest") >= in_a_row)).select(
        "doc_id", "item_id", "item_windows", "matched_windows")


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; rows that share a doc_id go together."""
    bad = contaminated(docs, benchmark, **parameters).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
