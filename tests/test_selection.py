import random

import pytest
from pyspark.sql import functions as F

from enrichflow.operators import contracts, counts, selection
from enrichflow.schemas import ANALYSIS_RESULT, LIKES_RESULT, RECORD_SEED
from pyspark.sql import types as T

SEED = T.StructType([*RECORD_SEED.fields, T.StructField("position", T.IntegerType()), T.StructField("ord", T.IntegerType())])


def seed(title, link="https://arxiv.org/abs/2401.00001", n=0):
    return ("CVPR", 2025, title, ["A"], f"https://d/{n:03d}", "https://p", link, "Day 1", 0, n)


ROWS = [
    seed("Video  GENERATION models", n=1),
    seed("No link here", None, 2),
    seed("About graphs", n=3),
    seed("Video with a bad link", "https://evil.example/abs/2401.00001", 4),
    seed("straße VIDEO", "https://arxiv.org/abs/2401.00002", 5),
    seed("No link and off topic", None, 6),
]


def test_waterfall_and_counts(spark):
    tasks, disposed = selection.select_records(spark.createDataFrame(ROWS, SEED), ["video", "STRASSE"], [" Why? "])
    row = counts.disposition_counts(disposed).first().asDict()
    assert row == {"no_link": 2, "topic_mismatch": 1, "invalid_link": 1, "selected": 2}
    assert counts.initial_counts(disposed).first().asDict() == {"discovered": 6, "skipped": 4, "selected": 2}
    assert selection.rejected_links(disposed).first().error_code == "INVALID_ARXIV_URL"
    task = tasks.filter("title LIKE 'Video%'").first()
    assert (task.paper_key, task.arxiv_id, task.questions) == ("arxiv:2401.00001", "2401.00001", ["Why?"])
    assert set(selection.likes_tasks(tasks).columns) == {"paper_key", "title", "arxiv_url", "arxiv_id"}


def test_keyword_ignores_case_and_spacing(spark):
    seeds = spark.createDataFrame([seed("A  Big \n Model")], SEED)
    for topic, n in (("big model", 1), ("BIG   MODEL", 1), ("bigmodel", 0)):
        assert selection.select_records(seeds, [topic], ["q"])[0].count() == n


def test_limit_takes_the_first_in_order_whatever_the_input_order(spark):
    rows = [seed(f"title {c}", f"https://arxiv.org/abs/2401.{i:05d}", i) for i, c in enumerate("gfedcbaA")]
    random.Random(1).shuffle(rows)
    for parts in (1, 5):
        tasks, _ = selection.select_records(spark.createDataFrame(rows, SEED).repartition(parts), [], ["q"], 3)
        assert [t.arxiv_id for t in tasks.orderBy("ord").collect()] == ["2401.00006", "2401.00007", "2401.00005"]
    assert selection.select_records(spark.createDataFrame(rows, SEED), [], ["q"], 0)[0].count() == 8


@pytest.mark.parametrize(("topics", "questions", "limit"), [([" "], ["q"], 0), ([], [], 0), ([], [" "], 0), ([], ["q"], -1)])
def test_bad_arguments(spark, topics, questions, limit):
    with pytest.raises(ValueError):
        selection.select_records(spark.createDataFrame(ROWS, SEED), topics, questions, limit)


def test_operators_have_no_size_bounds():
    selection.check_selection([], ["q"] * 11, 10_001)


@pytest.mark.parametrize("limit", [0, 1, 5, 1500])
def test_cap_against_brute_force(spark, limit):
    data = [("hot", i) for i in range(3000)] + [(f"r{i % 7}", i) for i in range(50)]
    random.Random(2).shuffle(data)
    capped = selection.cap_new(spark.createDataFrame(data, "run_id string, ord int").repartition(6), limit)
    wanted = set()
    for run in {r for r, _ in data}:
        ords = sorted(o for r, o in data if r == run)
        wanted |= {(run, o) for o in (ords if limit == 0 else ords[:limit])}
    assert {(r.run_id, r.ord) for r in capped.filter("scheduled").collect()} == wanted
    assert capped.count() == len(data)


LIKES_CASES = [
    (("k", "1", 907, "\t907  Likes", "SUCCESS", None), []),
    (("k", "1", 12345678, "12,345,678 Likes", "SUCCESS", None), []),
    (("k", "1", 44, "44 Like", "SUCCESS", None), []),
    (("k", "1", 7, "Likes 7", "SUCCESS", None), ["LIKES_TEXT_FORM"]),
    (("k", "1", 31, "13 Likes", "SUCCESS", None), ["LIKES_TEXT_MISMATCH"]),
    (("k", "1", 31, "31 Likes", "SUCCESS", "LATE"), ["SUCCESS_WITH_ERROR"]),
    (("k", "1", None, "31 Likes", "SUCCESS", None), ["SUCCESS_WITHOUT_LIKES", "LIKES_TEXT_MISMATCH"]),
    (("k", "1", -31, "31 Likes", "SUCCESS", None), ["NEGATIVE_LIKES", "LIKES_TEXT_MISMATCH"]),
    (("k", "1", None, None, "FAILED", "E"), []),
    (("k", "1", 3, None, "FAILED", "E"), ["FAILED_WITH_LIKES"]),
    (("k", "1", None, "x", "FAILED", "E"), ["FAILED_WITH_LIKES"]),
    (("k", "1", None, None, "FAILED", " "), ["FAILED_WITHOUT_ERROR"]),
    (("k", "1", None, None, "WAITING", None), ["UNKNOWN_STATUS"]),
]


def test_likes_contract(spark):
    rows = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(LIKES_CASES)],
                                 T.StructType([T.StructField("i", T.IntegerType()), *LIKES_RESULT.fields]))
    checked = contracts.check_rows(rows, contracts.likes_violations())
    assert {r.i: r.violations for r in checked.collect()} == {i: bad for i, (_, bad) in enumerate(LIKES_CASES)}
    good, bad = contracts.split_rows(checked)
    assert good.count() == 4 and bad.count() == 9
    with pytest.raises(ValueError):
        contracts.require_clean(checked)
    assert contracts.require_clean(contracts.check_rows(good, contracts.likes_violations())).count() == 4


def test_analysis_and_identity_contracts(spark):
    analysis = ("k", "p", [], "m", [], [], [], [], {}, [], [], None)
    other = ("x", *analysis[1:])
    rows = [
        ("k", "SUCCESS", analysis, None, None, "mcp_report", []),
        ("k", "SUCCESS", other, None, None, None, []),
        ("k", "SUCCESS", None, "E", None, None, []),
        ("k", "FAILED", analysis, "E", None, None, []),
        ("k", "FAILED", None, None, None, "odd", []),
    ]
    checked = contracts.check_rows(spark.createDataFrame(rows, ANALYSIS_RESULT), contracts.analysis_violations())
    assert [r.violations for r in checked.collect()] == [
        [], ["ANALYSIS_KEY_MISMATCH"], ["SUCCESS_WITHOUT_ANALYSIS", "SUCCESS_WITH_ERROR"], ["FAILED_WITH_ANALYSIS"],
        ["UNKNOWN_MODE", "FAILED_WITHOUT_ERROR"],
    ]
    joined = spark.range(1).selectExpr(
        "named_struct('paper_key', 'k', 'arxiv_id', '1') paper", "named_struct('paper_key', 'z', 'arxiv_id', '2') likes",
        "named_struct('paper_key', 'y') analysis",
    )
    assert joined.select(contracts.identity_violations()).first()[0] == ["LIKES_KEY", "LIKES_ID", "ANALYSIS_KEY"]


def test_task_contract(spark):
    tasks, _ = selection.select_records(spark.createDataFrame(ROWS, SEED), ["video"], ["q"])
    assert {tuple(r[0]) for r in tasks.select(contracts.task_violations()).collect()} == {()}
    broken = tasks.limit(1).withColumns({"paper_key": F.lit("x"), "questions": F.array(F.lit(" ")), "title": F.lit("")})
    assert broken.select(contracts.task_violations()).first()[0] == ["BLANK_TITLE", "BLANK_QUESTION", "KEY_MISMATCH"]


def test_other_contracts(spark):
    seeds = spark.createDataFrame([seed("ok"), seed(" ", " ")], SEED)
    assert [r[0] for r in seeds.select(contracts.seed_violations()).collect()] == [[], ["BLANK_TITLE", "BLANK_ARXIV_URL"]]
    pages = spark.createDataFrame([("h", None), (None, "e"), (None, None), ("h", "e")], "html string, error_code string")
    assert [len(r[0]) for r in pages.select(contracts.page_violations()).collect()] == [0, 0, 1, 1]
    ids = spark.createDataFrame([("a-1.b_C",), ("-a",), ("a/b",), ("a" * 129,), (None,)], "r string")
    assert [r[0] for r in ids.select(contracts.run_id_ok(F.col("r"))).collect()] == [True, False, False, False, False]
    texts = spark.createDataFrame([('{"paper_key":1,"zz":2,"aa":3}',)], "j string")
    assert texts.select(contracts.unknown_fields(F.col("j"), LIKES_RESULT)).first()[0] == ["aa", "zz"]
    run = dict(conference="CVPR", year=2025, likes_strategy="alphaxiv_api", topics=[], max_papers=0, paper_questions=["q"],
               analysis_concurrency=1, analysis_request_interval_seconds=4.0, max_new_analyses_per_run=400,
               authorization_circuit_breaker=True)
    from enrichflow.schemas import RUN_INPUT

    bad = run | {"year": 2024, "max_papers": 10001, "paper_questions": [], "analysis_concurrency": 4}
    rows = spark.createDataFrame([tuple(r[n] for n in RUN_INPUT.names) for r in (run, bad)], RUN_INPUT)
    assert [r[0] for r in rows.select(contracts.run_input_violations()).collect()] == [
        [], ["UNSUPPORTED_YEAR", "MAX_PAPERS", "QUESTION_COUNT", "ANALYSIS_CONCURRENCY"]
    ]


def test_keyword_table_equals_a_loop(spark):
    import random

    from enrichflow.operators.keywords import containing

    draw = random.Random(1)
    letters = "abcdé 中🙂"
    titles = [(i, "".join(draw.choices(letters, k=draw.randrange(0, 40)))) for i in range(200)] + [(900, None), (901, "")]
    words = ["".join(draw.choices(letters, k=draw.randrange(1, 9))) for _ in range(300)] + ["a", "", None, "abcdabcd" * 3, titles[0][1]]
    frame = spark.createDataFrame(titles, "id int, title string")
    found = containing(frame, spark.createDataFrame([(w,) for w in words], "keyword string"), "id")
    want = {(i, w) for i, t in titles if t is not None for w in words if w and w in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containing(frame, spark.createDataFrame([], "keyword string"), "id").count() == 0


def test_folded_topics_keep_their_blanks(spark):
    rows = [("u1", "Deep nets", "https://arxiv.org/abs/2401.00001"), ("u2", "A deep net", "https://arxiv.org/abs/2401.00002")]
    seeds = spark.createDataFrame(rows, "detail_url string, title string, arxiv_url string")
    topics = spark.createDataFrame([(" deep",)], "topic string")
    found = {folded: {r.detail_url: r.disposition for r in selection.dispose(seeds, topics, topics_folded=folded).collect()} for folded in (True, False)}
    assert found[True] == {"u1": "topic_mismatch", "u2": "selected"}
    assert found[False] == {"u1": "selected", "u2": "selected"}


def test_keywords_of_several_buckets_meet_each_block_once(spark):
    from enrichflow.operators.keywords import containing

    draw = random.Random(2)
    titles = [(i, "".join(draw.choices("ab é", k=60))) for i in range(60)]
    words = [(t[i : i + 1 + n % 40],) for n, (_, t) in enumerate(titles) for i in (0, 7)]
    found = containing(spark.createDataFrame(titles, "id int, title string"), spark.createDataFrame(words, "keyword string"), "id", block=500, bucket=20)
    assert sorted(map(tuple, found.collect())) == sorted({(i, w) for i, t in titles for (w,) in words if w in t})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "Join" not in plan


def test_a_bucket_of_keywords_takes_little_more_than_its_bytes():
    import tracemalloc

    import pyarrow as pa

    from enrichflow.operators.keywords import _Bucket

    draw = random.Random(3)
    words = sorted({"".join(draw.choices("abcdefgh", k=5 + n % 11)) for n in range(200_000)})
    titles = [words[0] + words[-1], words[0], "", words[5] + " " + words[5]]
    tracemalloc.start()
    bucket = _Bucket(pa.array(words, pa.large_string()))
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 70 * len(words) and most < 110 * len(words)
    found = {(t, w) for title, many in bucket.found(pa.array(titles)) for t, w in zip(title.tolist(), many.to_pylist())}
    assert found == {(i, t[a:b]) for i, t in enumerate(titles) for a in range(len(t)) for b in range(a + 1, len(t) + 1)} & {(i, w) for i in range(4) for w in words}


def test_keywords_that_begin_alike_and_long_ones(spark):
    from enrichflow.operators.keywords import containing

    same = "x" * 16
    titles = [(1, same * 3 + "é" * 20), (2, same + "abc"), (3, "y" + same), (4, "é" * 19), (5, "x" * 15), (None, same)]
    words = [same, same + "a", same + "abc", same + "abcd", same * 2, "x" * 33, "x" * 17 + "é", "é" * 19, "é" * 12, "é" * 4, "x" * 15, "x" * 8, "x" * 9, "x" * 7, "a", "bc"]
    words += [same + "".join(p) for p in ("q", "qq", "qqq", "\x00", "\x00\x00")] + ["\x00", "x\x00"]
    frame = spark.createDataFrame(titles, "id int, title string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = sorted(((i, w) for i, t in titles for w in words if w in t), key=str)
    assert sorted(map(tuple, containing(frame, table, "id").collect()), key=str) == want
    assert sorted(map(tuple, containing(frame, table, "id", bucket_bytes=60).collect()), key=str) == want
