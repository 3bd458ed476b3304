"""Decontamination of near copies of short items, of slot-dense items, and of copies with a slot that differs."""

import random

from quillspark.llm import decontam


def found(spark, docs, items):
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}


def test_changed_words_in_short_items(spark):
    rnd = random.Random(7)
    noise = lambda n: " ".join(rnd.choice(["la", "mo", "ki", "tu"]) + rnd.choice("abcdefg") for _ in range(n))
    items = [" ".join(f"i{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(n)) for n in range(9, 50)]
    docs, want = [], set()
    for i, item in enumerate(items):
        w = item.split()
        for k in range(len(w)):
            want.add((len(docs), i))
            docs.append(f"{noise(20)} {' '.join([*w[:k], 'other', *w[k + 1 :]])} {noise(20)}")
    docs += [noise(200) for _ in range(20)]
    assert found(spark, docs, items) == want


def test_one_of_two_mentions_differs(spark):
    item = "we heard that old Bob sold 3 pens to his friend in the market before young Bob took 5 cups from the wooden shelf there"
    assert found(spark, [item.replace("young Bob", "young Al"), item.replace("Bob", "Al"), "nothing of it"], [item]) == {(0, 0), (1, 0)}


def test_slot_dense_items(spark):
    items = ["War And Peace Was Written By Leo Tolstoy In 1869", "3 14 15 92 65 35 89 79 32 38", "what Is The Title"]
    docs = [f"he said that {items[0]} and left", f"digits {items[1]} follow", "digits 2 71 82 81 82 84 59 4 52 35 follow", "he said that Our Own Dear Aunt Was Kissed By Ann Lee In 1870 and left"]
    assert found(spark, docs, items) == {(0, 0), (1, 1)}
