import pytest
from pyspark.sql import functions as F, types as T

from enrichflow.operators import counts, joins, texts
from enrichflow.schemas import ANALYSIS_RESULT, LIKES_RESULT, RECORD_TASK

TASK = T.StructType([*RECORD_TASK.fields, T.StructField("ord", T.IntegerType())])


def tasks(spark, *ids):
    rows = [("CVPR", 2025, f"Title {i}", [], "d", "p", f"arxiv:{i}", f"https://arxiv.org/abs/{i}", i, ["q1", "q2"], "Day 1", n)
            for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, TASK)


def analysis(key, raw="text", answers=None):
    return (key, "problem", [], "summary", [], [], [], [], answers or {}, [], [], raw)


def analyses(spark, *rows):
    full = [(k, s, a, c, None, m, q) for k, s, a, c, m, q in rows]
    return spark.createDataFrame(full, ANALYSIS_RESULT)


def ok(key, mode="structured_llm", questions=("q1", "q2"), **kw):
    return (key, "SUCCESS", analysis(key, **kw), None, mode, list(questions))


def bad(key, code="PAPER_ANALYSIS_FAILED"):
    return (key, "FAILED", None, code, None, [])


def likes(spark, *rows):
    return spark.createDataFrame(list(rows), LIKES_RESULT)


def liked(i, n=3):
    return (f"arxiv:{i}", i, n, f"{n} Likes", "SUCCESS", None)


def unliked(i):
    return (f"arxiv:{i}", i, None, None, "FAILED", "NOPE")


def test_outcomes_and_defaults(spark):
    papers = tasks(spark, "1", "2", "3", "4", "5").repartition(3)
    left = analyses(spark, ok("arxiv:1"), ok("arxiv:2"), bad("arxiv:3"), bad("arxiv:4"))
    right = likes(spark, liked("1"), unliked("2"), liked("3"), unliked("4"))
    rows = joins.join_results(papers, left, right, strict=True).orderBy("ord").collect()
    assert [r.status for r in rows] == ["COMPLETED", "PARTIAL", "PARTIAL", "FAILED", "FAILED"]
    assert [r.warnings for r in rows] == [
        [], ["NOPE"], ["PAPER_ANALYSIS_FAILED"], ["NOPE", "PAPER_ANALYSIS_FAILED"],
        ["MISSING_LIKES_RESULT", "MISSING_ANALYSIS_RESULT"],
    ]
    assert rows[4].likes.arxiv_id == "5" and rows[4].analysis is None
    run = counts.run_counts(joins.join_results(papers, left, right)).first()
    assert (run.selected, run.likes_success, run.analysis_success, run.completed, run.partial, run.failed) == (5, 2, 2, 1, 2, 2)
    assert run.run_status == "PARTIAL"


@pytest.mark.parametrize(
    ("ids", "left", "right", "code"),
    [
        (["1", "1"], [], [], "PAPER_RESULT_MISMATCH"),
        (["1"], [ok("arxiv:1"), bad("arxiv:1")], [], "ANALYSIS_RESULT_MISMATCH"),
        (["1"], [ok("arxiv:9")], [], "ANALYSIS_RESULT_MISMATCH"),
        (["1"], [], [liked("1"), liked("1")], "LIKES_RESULT_MISMATCH"),
        (["1"], [], [liked("9")], "LIKES_RESULT_MISMATCH"),
        (["1"], [], [("arxiv:1", "2", None, None, "FAILED", "E")], "LIKES_RESULT_MISMATCH"),
    ],
)
def test_strict_join_refuses(spark, ids, left, right, code):
    with pytest.raises(ValueError, match=code):
        joins.join_results(tasks(spark, *ids), analyses(spark, *left), likes(spark, *right), strict=True)


@pytest.mark.parametrize(
    ("statuses", "wanted"),
    [([], "FAILED"), (["COMPLETED"] * 2, "COMPLETED"), (["FAILED"] * 2, "FAILED"), (["COMPLETED", "FAILED"], "PARTIAL"), (["PARTIAL"], "PARTIAL")],
)
def test_run_status(spark, statuses, wanted):
    rows = spark.createDataFrame([(s, None, ("x",)) for s in statuses], "status string, analysis string, likes struct<status:string>")
    assert counts.run_counts(rows).first().run_status == wanted


def test_resume_of_analyses(spark):
    logged = analyses(
        spark, ok("arxiv:1"), ok("arxiv:2", mode="mcp_report"), ok("arxiv:3", questions=["q1"]), ok("arxiv:4", raw=" "),
        ok("arxiv:5", raw="see <PAPER id>"), bad("arxiv:6"),
    )
    papers = tasks(spark, *"1234567")
    done = joins.resume_analyses(papers, logged, "structured_llm")
    assert [r.arxiv_id for r in done.filter("done").collect()] == ["1"]
    assert done.filter("done").first().previous.analysis.raw_answer == "text"
    reported = joins.resume_analyses(papers, logged, "mcp_report")
    assert [r.arxiv_id for r in reported.filter("done").collect()] == ["2"]
    rest = joins.without_done(papers, logged, "paper_key", F.col("status") == "SUCCESS")
    assert sorted(r.arxiv_id for r in rest.collect()) == ["6", "7"]


def test_resume_of_likes(spark):
    logged = likes(spark, liked("1"), unliked("2"), ("arxiv:3", "other", 1, "1 Like", "SUCCESS", None))
    done = joins.resume_likes(tasks(spark, "1", "2", "3", "4"), logged).filter("done")
    assert [r.arxiv_id for r in done.collect()] == ["1"]


def test_completeness(spark):
    found = joins.completeness(tasks(spark, "1", "2", "3"), likes(spark, liked("1"), liked("2"), liked("2"), liked("8")), "paper_key")
    assert {(r.paper_key, r.expected, r.found) for r in found.collect()} == {
        ("arxiv:2", 1, 2), ("arxiv:3", 1, 0), ("arxiv:8", 0, 1)
    }


def test_hot_key_is_counted_before_the_shuffle(spark):
    from tests.conftest import plan_of

    many = spark.range(1000).selectExpr("concat('arxiv:', id % 2) paper_key", "cast(id % 2 AS string) arxiv_id")
    plan = plan_of(joins.integrity_report(tasks(spark, "1"), many, many))
    assert "partial_sum" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_question_answer_records(spark):
    left = analyses(spark, ok("arxiv:1", answers={"q2": "two", "q1": "one", "zz": "no"}), ok("arxiv:2"), bad("arxiv:3"), ok("arxiv:4", raw=""))
    rows = texts.qa_records(joins.join_results(tasks(spark, *"1234"), left, likes(spark))).orderBy("ord").collect()
    assert [r.answer for r in rows] == [
        "Question: q1\nAnswer: one\n\nQuestion: q2\nAnswer: two", "text", None, "summary",
    ]
    assert [r.status for r in rows] == ["SUCCESS", "SUCCESS", "FAILED", "SUCCESS"]


def test_warnings_and_histogram(spark):
    failures = spark.createDataFrame([("r", 2, "B"), ("r", 1, "A")], "run_id string, position int, error_code string")
    rejected = spark.createDataFrame([("r", 0, 5, "C"), ("r", 0, 4, "C")], "run_id string, position int, ord int, error_code string")
    rows = counts.warning_rows(failures, rejected, "run_id")
    assert [r.code for r in rows.orderBy("phase", "position", "ord").collect()] == ["A", "B", "C", "C"]
    assert [tuple(w) for w in counts.warning_summary(rows, "run_id").first().warnings] == [(0, "A", 1), (0, "B", 1), (1, "C", 2)]
    states = spark.createDataFrame([("r", "PENDING"), ("s", "FAILED")], "run_id string, state string")
    got = {(r.run_id, r.state): r.n for r in counts.state_histogram(states, ["run_id"]).collect()}
    assert len(got) == 8 and got["r", "PENDING"] == 1 and got["s", "PENDING"] == 0


def test_integrity_of_repeated_orders_equals_the_sql(spark, tmp_path):
    import duckdb

    from enrichflow.queries import CATALOG

    orders = spark.createDataFrame([(0, "F"), (1, "F"), (1, "F"), (1, "O"), (2, "P")], "o_orderkey long, o_orderstatus string")
    rows = [(0, 7, 2, "O"), (0, 1, 4, "O"), (1, 1, 2, "F"), (1, 2, 4, "O"), (1, 3, 6, "O"), (2, 7, 1, "F"), (3, 1, 2, "F"), (1, 7, 1, "F")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_linestatus string")
    connection = duckdb.connect()
    for name, frame in (("orders", orders), ("lineitem", lines)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    query = CATALOG["q_join_integrity"]
    want = connection.execute(query.sql).fetchall()
    assert sorted(map(tuple, query.run(spark, str(tmp_path)).collect())) == sorted(want)
