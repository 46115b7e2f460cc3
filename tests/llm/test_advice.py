"""Whole results of the training-data operators, by the second review."""

from auditweave.llm import decontamination, license_scan

ITEM = "A train leaves Springfield at 9 and drives 120 km in 3 hours while Maria waits for Peter who counts 120 birds on the roof of the old house"


def reported(spark, texts, items, **parameters):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    answers = []
    for limit in (500_000, 0):
        rows = decontamination.contaminated(docs, benchmark, broadcast_windows=limit, **parameters).collect()
        answers.append(sorted((r["doc_id"], r["item_id"]) for r in rows))
    assert answers[0] == answers[1]
    return answers[0]


def test_a_conflicting_slot_drops_its_windows_only(spark):
    same_new_value = ITEM.replace("at 9", "at 4").replace("3 hours", "4 hours")
    short = "Tom has 3 red apples and 5 green pears in it"
    texts = [ITEM.replace("120 km", "250 km"), same_new_value, short.replace("3", "4").replace("5", "4"), "nothing of that kind is here at all today"]
    assert reported(spark, texts, [ITEM, short]) == [(0, 0), (1, 0), (2, 1)]
    conflict = "here 7 cats met 7 dogs near the big gate"
    assert reported(spark, [conflict.replace("7 dogs", "8 dogs")], [conflict]) == []


def test_a_long_passage_of_a_long_item_is_reported(spark):
    words = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "vu", "we") for b in "abcdefghijklmnopqrst"]
    item = " ".join(words)
    texts = [f"so then {' '.join(words[40:n])} and that was all of it" for n in (53, 52, 106)]
    assert reported(spark, texts, [item]) == [(0, 0), (2, 0)]
    apart = f"{' '.join(words[:11])} here {' '.join(words[50:61])} there {' '.join(words[90:102])}"
    assert reported(spark, [apart], [item]) == []


def test_case_line_breaks_and_sentence_starts_lose_no_window(spark):
    anna = "Anna buys 5 apples. Anna eats 3."
    texts = [ITEM.upper(), ITEM.lower(), ITEM.replace(" ", "\n"), ITEM.replace("while Maria", "while\r\n   Anna").replace("120", "7"),
             "they say Anna buys 5 apples. Anna eats 3.", "Berta buys 6 apples. Berta eats 4.", "ANNA BUYS 8 APPLES. ANNA EATS 7.",
             "Berta buys 6 apples. Clara eats 4.", "Nothing Of That Kind Is Here At All Today Or Later"]
    assert reported(spark, texts, [ITEM, anna]) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)]


def test_case_loses_no_window_of_the_item(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate((ITEM, ITEM.upper(), ITEM.lower(), f"word {ITEM}", ITEM.replace(" ", "\n")))], "doc_id int, text string")
    rows = decontamination.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id int, text string")).collect()
    assert len(rows) == 5 and {r["matched_windows"] - r["item_windows"] for r in rows} == {0}


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell."""
GPL = """# plain.py
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
import os"""


def test_wrapped_notices_are_found_in_their_block(spark):
    plain = [(1000 + i, f"ordinary words number {i} about the weather\nin spring and {i * 7} birds") for i in range(300)]
    one_line = "Some words first.\nReleased under the MIT License.\nAnd some after."
    df = spark.createDataFrame([(1, MIT), (2, GPL), (None, MIT), (3, one_line)] + plain, "doc_id bigint, text string")
    got = [(r["doc_id"], r["paragraph"], r["family"]) for r in license_scan.scan(df).collect() if r["family"] != license_scan.UNKNOWN]
    assert {(1, 2, "mit"), (None, 2, "mit"), (2, 2, "gpl")} <= set(got) and (3, 1, "mit") in got
    assert len(got) == len(set(got)) and not [g for g in got if g[0] == 3 and g[1] != 1] and all((g[0] or 0) < 1000 for g in got)
