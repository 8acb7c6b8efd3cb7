import html
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from enrichflow.functions.strings import fold_title, strip
from enrichflow.operators import enrich, jsonops, texts


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def test_strip_and_fold_follow_unicode(spark):
    raw = f"{SPACES}Ein{SPACES}STRASSE ß{SPACES}"
    row = spark.createDataFrame([(raw,)], "t string").select(strip(F.col("t")), fold_title(F.col("t"))).first()
    assert row[0] == raw.strip()
    assert row[1] == " ".join(raw.casefold().split())


@pytest.mark.parametrize(
    ("message", "wanted"),
    [
        ("failed with token=abc123, retry", "E: failed with token=<redacted>, retry"),
        ("Authorization: Bearer abc.def", "E: Authorization=<redacted>"),
        ("access-token abc; x", "E: access-token=<redacted>; x"),
        ("tokens are fine", "E: tokens are fine"),
        ("  ", "E: No error message"),
        ("x" * 600, "E: " + "x" * 600),
    ],
)
def test_error_detail(spark, message, wanted):
    assert one(spark, enrich.error_detail(F.lit("E"), F.lit(message))) == wanted
    assert one(spark, enrich.error_detail(F.lit("E"), F.lit(message), most=9)) == wanted[:9]


def test_blocks(spark):
    df = spark.createDataFrame(
        [([("text", " a "), ("image", "b"), ("text", " \xa0"), ("text", "c")],), ([("text", " ")],), ([],)],
        "blocks array<struct<type:string,text:string>>",
    )
    assert [r[0] for r in df.select(texts.block_text(F.col("blocks"))).collect()] == ["a\n\nc", None, None]
    profile = df.select(texts.block_profile(F.col("blocks")).alias("p")).first().p
    assert profile.types == ["text", "image", "text", "text"] and profile.text_lengths == [3, 2, 1]


GOOD = '<paper id="7"><page num="1">x &amp; y</page><page num="2"/></paper>'
ENVELOPES = [
    (GOOD, GOOD, 2, False),
    (f"﻿```xml\n{GOOD}\n```", GOOD, 2, False),
    (html.escape(GOOD), GOOD, 2, False),
    ("&lt;paper id=&#x22;7&#x22;&gt;&lt;page num=&#34;1&#34;/&gt;&lt;/paper&gt;", '<paper id="7"><page num="1"/></paper>', 1, False),
    ('<paper id="7"><page num="1">a & b</page></paper>', '<paper id="7"><page num="1">a & b</page></paper>', None, True),
    ("<paper id='7'><page num='1'>open</paper>", "<paper id='7'><page num='1'>open</paper>", None, True),
    ('<paper><page num="1">a & b</page></paper>', None, None, False),
    ('<paper id="7"></paper>', None, None, False),
    ('<paper id=" "><page num="1"/></paper>', None, None, False),
    ('<paper id="7"><page num=""/><page num="2"/></paper>', None, None, False),
    ('<papers id="7"><page num="1"/></papers>', None, None, False),
    ("plain text", None, None, False),
    (None, None, None, False),
]


def test_envelopes(spark):
    rows = spark.createDataFrame([(i, e[0]) for i, e in enumerate(ENVELOPES)], "i int, t string")
    got = {r.i: (r.envelope, r.envelope_pages, r.envelope_lenient) for r in texts.with_envelopes(rows, "t").collect()}
    assert got == {i: e[1:] for i, e in enumerate(ENVELOPES)}


def test_first_usable_block_wins(spark):
    rows = spark.createDataFrame(
        [("a", [("text", "no"), ("image", GOOD), ("text", GOOD), ("text", GOOD.replace("7", "8"))]), ("b", [("text", "no")]), ("c", [])],
        "k string, blocks array<struct<type:string,text:string>>",
    )
    got = {r.k: (r.envelope, r.error_code) for r in texts.block_envelopes(rows, "k").collect()}
    assert got == {"a": (GOOD, None), "b": (None, "INVALID_ALPHAXIV_RESPONSE"), "c": (None, "INVALID_ALPHAXIV_RESPONSE")}


def test_evidence_round_trip(spark):
    report = " a < b & \"c\" 'd'\n\nmore "
    made = one(spark, texts.evidence_xml(F.lit('https://arxiv.org/pdf/24"01.pdf'), F.lit(report)))
    root = ElementTree.fromstring(made)
    assert root.get("id") == '24"01' and root.find("page").text == report.strip()
    assert one(spark, texts.evidence_xml(F.lit("u"), F.lit(" "))) is None
    rows = spark.createDataFrame([(made,)], "t string")
    assert texts.with_envelopes(rows, "t").first().envelope == made


def test_projections(spark):
    report = "\n\n  \n\n First one. \n\nSee https://github.com/a/b. and https://github.com/a/b. or https://github.com/c/d-e)"
    a = one(spark, texts.report_analysis(F.lit("k"), F.lit(report)))
    assert a.research_problem == "First one." and a.method_summary == report.strip() and a.raw_answer is None
    assert a.code_urls == ["https://github.com/a/b.", "https://github.com/c/d-e"] and a.warnings[0].startswith("MCP_REPORT_MODE")
    raw = one(spark, texts.raw_answer_analysis(F.lit("k"), F.lit(" x ")))
    assert raw.raw_answer == "x" and raw.warnings[0].startswith("MCP_QA_RAW_MODE")
    whole = one(spark, texts.complete_answer_analysis(F.lit("k"), F.lit(" x ")))
    assert whole.raw_answer == whole.research_problem == "x" and whole.warnings == []
    for build, code in ((texts.report_analysis, "INVALID_ALPHAXIV_RESPONSE"), (texts.complete_answer_analysis, "EMPTY_QUESTION_ANSWER")):
        result = one(spark, texts.analysis_result(F.lit("k"), build(F.lit("k"), F.lit(" ")), code))
        assert (result.status, result.error_code, result.analysis) == ("FAILED", code, None)


def test_prompts(spark):
    questions = F.array(F.lit("A?"), F.lit("B?"))
    prompt = one(spark, texts.answers_prompt(F.lit("T"), F.lit("1"), questions, F.lit("R")))
    assert "1. A?\n2. B?" in prompt and prompt.endswith("Report:\nR\n")
    prompt = one(spark, texts.evidence_prompt(F.lit("k"), questions, F.lit("<paper/>")))
    assert "- A?\n- B?" in prompt and prompt.endswith("<paper/>\n")
    assert one(spark, texts.query_request(F.lit("u"), questions)).queries == ["A?", "B?"]
    assert one(spark, texts.report_request(F.lit("u"))).url == "u"


@pytest.mark.parametrize(
    ("answers", "wanted", "code"),
    [
        ({" A? ": " one ", "B?": "two", "C?": "no"}, {"A?": "one", "B?": "two"}, None),
        ({"A?": "one"}, None, "INCOMPLETE_QUESTION_ANSWERS: B?"),
        ({"A?": " ", "B?": "two"}, None, "INCOMPLETE_QUESTION_ANSWERS: A?"),
        ({}, None, "INCOMPLETE_QUESTION_ANSWERS: A?"),
    ],
)
def test_complete_answers(spark, answers, wanted, code):
    row = spark.createDataFrame([(["A?", "B?"], answers)], "q array<string>, a map<string,string>")
    got = row.select(texts.complete_answers(F.col("q"), F.col("a")).alias("c")).first().c
    assert (got.answers, got.error_code) == (wanted, code)
    if wanted:
        assert got.raw_answer == "Question: A?\nAnswer: one\n\nQuestion: B?\nAnswer: two"


def test_guard(spark):
    texts_in = [(" fine ",), (" ",), (None,), ("x <PAPER id>",), ("x </paper>",)]
    rows = spark.createDataFrame(texts_in, "t string").select(texts.guarded_answer(F.col("t")).alias("g"))
    assert [tuple(r.g) for r in rows.collect()] == [
        ("fine", None), (None, "EMPTY_QUESTION_ANSWER"), (None, "EMPTY_QUESTION_ANSWER"),
        (None, "RAW_PAPER_RETURNED_AS_ANSWER"), (None, "RAW_PAPER_RETURNED_AS_ANSWER"),
    ]


PAYLOADS = [
    ("25", 25), ("0", 0), ("-1", None), ("true", None), ("1.0", None), ('"5"', None), ("null", None),
]


def test_strict_metric(spark):
    rows = [('{"data":{"paper_group":{"metrics":{"public_total_votes":%s}}}}' % text, n) for text, n in PAYLOADS]
    rows += [('{"data":{}}', None), ("bad", None), (None, None)]
    df = spark.createDataFrame(rows, "p string, n long")
    path = ("data", "paper_group", "metrics", "public_total_votes")
    got = df.select(jsonops.strict_path_bigint(F.col("p"), path), "n").collect()
    assert all(r[0] == r[1] for r in got)


def test_json_encode(spark):
    row = [(1, float("nan"), [1.5, float("inf")], {"a": float("-inf")}, (None, "é")), (2, None, None, None, None)]
    df = spark.createDataFrame(row, "i int, d double, a array<double>, m map<string,double>, s struct<x:double,y:string>")
    whole = df.select("i", F.struct("d", "a", "m", "s").alias("v"))
    got = [r.json_str for r in jsonops.encode_json(whole, "v").orderBy("i").collect()]
    assert got == [
        '{"d":null,"a":[1.5,null],"m":{"a":null},"s":{"x":null,"y":"é"}}', '{"d":null,"a":null,"m":null,"s":null}',
    ]
    flat = spark.createDataFrame([('a"b', True, 3)], "s string, b boolean, n long")
    assert [jsonops.encode_json(flat, c).first().json_str for c in ("s", "b", "n")] == ['"a\\"b"', "true", "3"]
    assert [r.json_str for r in jsonops.encode_json(df, "d").collect()] == ["null", "null"]


def test_json_decode_round_trip(spark):
    values = ['{"a":[1,2.5,"x",null,true],"b":{}}', '"text"', "12", "null", "{bad", "", None]
    df = jsonops.decode_json(spark.createDataFrame(list(enumerate(values)), "i int, t string"), "t")
    rows = df.select("i", F.to_json("value").alias("j"), "malformed").orderBy("i").collect()
    assert [r.malformed for r in rows] == [False, False, False, False, True, True, False]
    assert rows[0].j == values[0] and rows[1].j == values[1] and rows[2].j == "12"


def test_json_profile(spark):
    docs = ['{"a":1,"b":[]}', '{"a":"x","b":[1,"y",{"c":null}]}', '{"a":1.5,"b":{"d":true}}', "bad", '{"a":2}']
    got = {(r.path, r.type): r.n for r in jsonops.json_profile(spark.createDataFrame([(d,) for d in docs], "t string"), "t").collect()}
    assert got == {
        ("$", "object"): 4, ("$.a", "integer"): 2, ("$.a", "string"): 1, ("$.a", "number"): 1, ("$.b", "array"): 2, ("$.b[]", "string"): 2,
        ("$.b[]", "integer"): 1, ("$.b[]", "object"): 1, ("$.b[].c", "any"): 1, ("$.b", "object"): 1, ("$.b.d", "boolean"): 1,
    }
    deep = ['[[[1, 1], {"x y": {"z": [[]]}}], 2]', "[]", "{}", "7"]
    frame = jsonops.json_profile(spark.createDataFrame([(d,) for d in deep], "t string"), "t")
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.type): r.n for r in frame.collect()} == {
        ("$", "array"): 2, ("$", "object"): 1, ("$", "integer"): 1, ("$[]", "integer"): 1, ("$[]", "array"): 1, ("$[]", "string"): 1,
        ("$[][]", "array"): 1, ("$[][]", "object"): 1, ("$[][][]", "integer"): 1, ('$[][]."x y"', "object"): 1, ('$[][]."x y".z', "array"): 1,
        ('$[][]."x y".z[]', "array"): 1, ('$[][]."x y".z[][]', "string"): 1,
    }
