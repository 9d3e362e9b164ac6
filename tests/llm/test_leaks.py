"""Leaked passages against sets of word n-grams."""

import random
import re

import pandas as pd
import pytest

from strataform.llm import leaks


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_random(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    r = random.Random(8)
    some = ["a", "bb", "the", "zone", "é", "größer", "12", "lung", "x"]
    items = [(i, " ".join(r.choice(some) for _ in range(r.randrange(0, 40)))) for i in range(30)] + [(99, None), (None, "a " * 30), (98, "short")]
    docs = []
    for d in range(120):
        t = [r.choice(some) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.7:
            w = items[r.randrange(30)][1].split(" ")
            k = r.randrange(0, max(1, len(w) - 9))
            t[3:3] = w[k : k + r.choice([8, 9, 10, 11, 25])]
        docs.append((d, r.choice([" ", "  ", "-", ", ", "_\n"]).join(t).upper() if d % 3 else " ".join(t)))
    docs += [(500, None), (501, ""), (502, "\n \t"), (None, docs[0][1]), docs[0]]
    mine = sorted(tuple(x) for x in leaks.find_leaks(spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id bigint, text string, item_id string"), "doc_id", "text", spark.createDataFrame([(a, b, "z") for a, b in items], "item_id bigint, text string, doc_id string"), "item_id", "text").collect())
    frame = lambda rows: pd.DataFrame([(i, words(t)) for i, t in rows if i is not None], columns=["id", "words"])
    assert mine == sorted(leaks.brute_leaks(frame(docs), frame(items), 10)) and mine


def test_exactly_ten(spark):
    w = [f"w{i}" for i in range(14)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "q " + ", ".join(w[2:12]) + " q"), (2, "q " + " ".join(w[2:11]) + " q"), (3, " ".join(w[2:11]) + f" {w[11]}x"), (4, f"x{w[2]} " + " ".join(w[3:12])), (5, "pad " * 5000 + " ".join(w[4:]))], "doc_id bigint, text string")
    assert sorted(x.doc_id for x in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()) == [1, 5]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_one_edit_and_string_ids(spark):
    r = random.Random(3)
    w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 7))) for _ in range(40)]
    items = [("i1", " ".join(w[:20])), ("i2", " ".join(w[20:]))]
    passage = " ".join(w[3:13])
    cut = len(passage) // 2
    changed = [passage[:cut] + "z" + passage[cut + 1 :], passage[:cut] + passage[cut + 1 :], passage[:cut] + "z" + passage[cut:]]
    twice = passage[: cut - 9] + "z" + passage[cut - 8 : cut + 9] + "z" + passage[cut + 10 :]
    docs = [(f"d{k}", "qq rr " + t + " ss") for k, t in enumerate([passage, *changed, twice])]
    assert [edit_distance(passage, t) for t in changed] == [1, 1, 1] and edit_distance(passage, twice) == 2
    frames = [spark.createDataFrame(x, "id string, text string") for x in (docs, items)]
    found = lambda e: sorted(r[0] for r in leaks.find_leaks(frames[0].withColumnRenamed("id", "d"), "d", "text", frames[1].withColumnRenamed("id", "i"), "i", "text", 10, e).collect())
    assert found(0) == ["d0"] and found(1) == ["d0", "d1", "d2", "d3"]


def test_empty(spark):
    d, i = "doc_id bigint, text string", "item_id bigint, text string"
    full = spark.createDataFrame([(1, "a " * 50)], d)
    assert leaks.find_leaks(spark.createDataFrame([], d), "doc_id", "text", spark.createDataFrame([(1, "a " * 50)], i), "item_id", "text").count() == 0
    assert leaks.find_leaks(full, "doc_id", "text", spark.createDataFrame([], i), "item_id", "text").count() == 0
    with pytest.raises(ValueError):
        leaks.find_leaks(full, "doc_id", "text", spark.createDataFrame([], i), "item_id", "text", 3)
