"""Copies of benchmark items in another case or with names of another length."""
import re

import pytest

from enrichflow.llm import decontaminate as op
from tests.llm.test_decontaminate import ITEM


@pytest.mark.parametrize("text, found", [
    (ITEM.lower(), True),
    (ITEM.upper(), True),
    (ITEM.replace("Anna", "Mary Ann"), True),
    ("Read this. " + ITEM.replace("Anna", "Mary Ann Lee").replace("5 km", "9 miles"), True),
    (ITEM.replace("Anna walks", "Mary Ann walks").replace("then Anna", "then Carla Sue").replace("did Anna", "did Dora May"), False),
])
def test_case_and_length_of_names(spark, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, ITEM)], "item_id bigint, text string")
    assert bool(op.leaks(docs, items).count()) == found


def test_name_of_two_words_in_the_item(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, ITEM.replace("Anna", "Mary Ann"))], "item_id bigint, text string")
    assert op.leaks(docs, items).count() == 1


def leaks(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in op.leaks(docs, items).collect()}


def test_items_poor_in_literals(spark):
    items = [(1, "What is 12 + 7?"), (2, "1, 1, 2, 3, 5, 8, 13, 21, 34, 55?"), (3, "Anna Boris Carla"), (4, "Anna")]
    docs = [(1, "Say: what is 12 + 7? Nineteen."), (2, "What is 13 + 7?"), (3, "As 1 1 2 3 5 8 13 21 34 55 goes on"), (4, "1, 1, 2, 3, 5, 8, 13, 21"),
            (5, "they were anna, boris, carla."), (6, "Anna and Boris")]
    assert leaks(spark, docs, items) == {(1, 1), (3, 2), (5, 3)}


def test_very_long_runs_of_names(spark):
    names = "Anna " * 100_000
    item = "Why did " + "Anna " * 3000 + "leave the old house so early?"
    docs = [(1, names), (2, names + ITEM), (3, "Then " + item), (4, item.replace("Anna " * 3000, "Mary Ann " * 2000))]
    assert leaks(spark, docs, [(1, ITEM), (2, item)]) == {(2, 1), (3, 2), (4, 2)}


def test_a_long_part_is_enough(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("bel", "dor", "fin", "gul", "hat", "jor", "kim", "len", "mos", "nar", "pul", "ros", "sil", "tan")]
    item = " ".join(words + [w + "s" for w in words] + [w + "en" for w in words])
    part = " ".join(words[10:70])
    assert leaks(spark, [(1, f"Well, {part}, and so on."), (2, " ".join(words[10:40]))], [(1, item)]) == {(1, 1)}


def test_recall_over_the_benchmark(spark):
    """Copies of all items inside other text; no clean text is found."""
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("item_id", "text").collect()]
    around = "Some words stand here. {} More of them follow there."

    def renamed(text):
        return re.sub(r"(?<![.?!] )(?<!^)\b[A-Z][a-z]+", lambda m: "Mary Ann" if len(m[0]) % 2 else "Olga", text)

    ways = {"whole": str, "lower": str.lower, "upper": str.upper, "renamed": renamed, "renumbered": lambda t: re.sub(r"\d+", "77", t)}
    docs = [(k * 100_000 + i, around.format(way(t))) for k, way in enumerate(ways.values()) for i, t in items]
    docs += [(10**9 + i, around.format(" ".join(reversed(t.split())))) for i, t in items]
    got = leaks(spark, docs, items)
    for k, name in enumerate(ways):
        recall = sum((k * 100_000 + i, i) in got for i, _ in items) / len(items)
        print(name, recall)
        assert recall >= 0.9, name
    assert not [d for d, _ in got if d >= 10**9]
