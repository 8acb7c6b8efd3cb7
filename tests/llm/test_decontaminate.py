"""Template decontamination next to a brute-force version."""
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from enrichflow.llm import decontaminate as op
from enrichflow.llm.catalog import QUERIES
from tests.conftest import plan_of

SF = "/root/testdata/sf0.01"


def tokens(text):
    text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "\x01", text or "")
    text = re.sub(r"[^\w%$€£\x01]+|_", " ", text)
    text = re.sub(r"(?<=\d)(?=[^\W\d_])|(?<=[$€£%])(?=[^ ])|(?<=[^ ])(?=[$€£%])", " ", text)
    return text.replace("\x01", ".").split()


def template(raw):
    kind = []
    for word in raw:
        if re.fullmatch(r"\d[\d.]*", word):
            kind.append("<num>")
        elif len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind.append("<name>")
        else:
            kind.append(word.lower())
    for i, word in enumerate(raw):
        if word in "$€£" and kind[i + 1:i + 2] == ["<num>"] or i and kind[i - 1] == "<num>" and word.lower() in op.UNITS:
            kind[i] = "<unit>"
    return kind


def brute(docs, items, window=8, literals=3, share=0.5, agree=0.8):
    index, raw_items, totals = defaultdict(set), {}, {}
    for i, t in items:
        raw_items[i] = tokens(t)
        kind = template(raw_items[i])
        size = min(window, len(kind))
        at = [k for k in range(len(kind) - size + 1) if size and sum(x not in op._SLOTS for x in kind[k:k + size]) >= literals]
        at = [k for k in at if all(kind[j:j + size] != kind[k:k + size] for j in at if j < k)]
        totals[i] = len(at)
        for k in at:
            index[tuple(kind[k:k + size])].add((i, k))
    out = {}
    for d, t in docs:
        raw = tokens(t)
        kind = template(raw)
        found = defaultdict(lambda: defaultdict(set))
        for size in {len(k) for k in index}:
            for p in range(len(kind) - size + 1):
                for i, k in index.get(tuple(kind[p:p + size]), ()):
                    found[i][p - k].update([(k, size)])
        for i, diagonals in found.items():
            places, slots, good = set(), 0, 0
            for diagonal, at in diagonals.items():
                item_kind = template(raw_items[i])
                seen = defaultdict(Counter)
                for k in range(min(k for k, _ in at), max(k + s for k, s in at)):
                    if item_kind[k] in op._SLOTS and item_kind[k] == kind[k + diagonal]:
                        seen[item_kind[k], raw_items[i][k]][raw[k + diagonal]] += 1
                all_, most = sum(sum(c.values()) for c in seen.values()), sum(max(c.values()) for c in seen.values())
                if most >= agree * all_:
                    places |= {k for k, _ in at}
                    slots, good = slots + all_, good + most
            if len(places) >= share * totals[i]:
                out[d, i] = (len(places), totals[i], slots, good)
    return out


def answer(frame):
    return {(r.doc_id, r.item_id): (r.n_windows, r.total, r.slots, r.agreeing) for r in frame.collect()}


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    frame = QUERIES["op3_decontaminate"].run(spark, SF)
    assert "Python" not in plan_of(frame) and "InArrow" not in plan_of(frame)
    want = brute(docs, items)
    assert answer(frame) == want and want


ITEM = "If Anna walks 5 km in 2 hours and then Anna pays $3.50 for water, how far did Anna walk per hour today?"


@pytest.mark.parametrize("text, found", [
    (ITEM, True),
    ("Some text. " + ITEM.replace("Anna", "Boris").replace("5 km", "12,5 miles").replace("2 hours", "7 days").replace("$3.50", "€9"), True),
    (ITEM.replace("Anna walks", "Boris walks").replace("then Anna", "then Carla").replace("did Anna", "did Dora"), False),
    ("If Anna walks home and pays for water, nobody asks how far it was.", False),
])
def test_reparameterised(spark, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, ITEM)], "item_id bigint, text string")
    got = answer(op.leaks(docs, items))
    assert got == brute([(1, text)], [(9, ITEM)]) and bool(got) == found


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "x " * 20_000 + "one two three four"), (5, ITEM), (5, ITEM), (None, ITEM)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, "One two Three four", 7), (2, ITEM, 7), (2, ITEM, 7), (3, None, 7), (4, "", 7), (None, ITEM, 7), (5, "Anna", 7)],
                                  "item_id bigint, text string, doc_id int")
    assert set(answer(op.leaks(docs, items))) == {(4, 1), (5, 2)}  # the short item in lower case too
    assert op.leaks(docs.limit(0), items).count() == 0 and op.leaks(docs, items.limit(0)).count() == 0
    assert set(answer(op.leaks(docs, items, literals=2))) == {(4, 1), (5, 2)}
