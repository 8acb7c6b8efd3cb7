"""Row contracts as violation codes, and unknown-field detection on raw JSON."""
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from enrichflow import fixed_values as V
from enrichflow.functions.strings import archive_key, is_blank, strip

VIOLATIONS = "violations"


def codes(*rules: tuple[str, Column]) -> Column:
    """Array of the codes whose test holds, in the given order; an unknown test counts as not holding."""
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in rules)))


def _required(*names: str, prefix: str = "") -> list[tuple[str, Column]]:
    return [(f"BLANK_{n.upper()}", is_blank(F.col(prefix + n))) for n in names]


def blank_item(items: Column) -> Column:
    return F.exists(items, lambda x: x.isNull() | (strip(x) == ""))


def seed_violations() -> Column:
    return codes(
        *_required("title", "detail_url", "pdf_url", "conference_day"),
        ("BLANK_ARXIV_URL", F.col("arxiv_url").isNotNull() & is_blank(F.col("arxiv_url"))),
        ("BLANK_AUTHOR", blank_item(F.col("authors"))),
        ("UNSUPPORTED_YEAR", ~F.coalesce(F.col("year").isin(2025, 2026), F.lit(False))),
    )


def task_violations() -> Column:
    size = F.coalesce(F.size("questions"), F.lit(0))
    return codes(
        *_required("title", "detail_url", "pdf_url", "arxiv_url", "conference_day", "paper_key", "arxiv_id"),
        ("BLANK_AUTHOR", blank_item(F.col("authors"))),
        ("BLANK_QUESTION", blank_item(F.col("questions"))),
        ("QUESTION_COUNT", size < 1),
        ("KEY_MISMATCH", ~F.col("paper_key").eqNullSafe(archive_key(F.col("arxiv_id")))),
    )


def likes_number(raw_text: Column) -> Column:
    """Number shown by a likes text, NULL when the text has another form."""
    digits = F.replace(F.regexp_extract(raw_text, r"([0-9,]+)", 1), F.lit(","), F.lit(""))
    return F.when(raw_text.rlike(V.LIKES_TEXT_PATTERN), digits.try_cast("bigint"))


def likes_violations(prefix: str = "") -> Column:
    c = {n: F.col(prefix + n) for n in ("paper_key", "status", "likes", "raw_text", "error_code")}
    good, bad = c["status"] == V.SUCCESS, c["status"] == V.FAILED
    return codes(
        ("BLANK_KEY", is_blank(c["paper_key"])),
        ("UNKNOWN_STATUS", ~F.coalesce(good | bad, F.lit(False))),
        ("NEGATIVE_LIKES", c["likes"] < 0),
        ("SUCCESS_WITHOUT_LIKES", good & (c["likes"].isNull() | c["raw_text"].isNull())),
        ("SUCCESS_WITH_ERROR", good & c["error_code"].isNotNull()),
        ("LIKES_TEXT_FORM", good & ~c["raw_text"].rlike(V.LIKES_TEXT_PATTERN)),
        ("LIKES_TEXT_MISMATCH", good & ~F.coalesce(likes_number(c["raw_text"]) == c["likes"], F.lit(False))
         & c["raw_text"].rlike(V.LIKES_TEXT_PATTERN)),
        ("FAILED_WITH_LIKES", bad & (c["likes"].isNotNull() | c["raw_text"].isNotNull())),
        ("FAILED_WITHOUT_ERROR", bad & is_blank(c["error_code"])),
    )


def analysis_violations(prefix: str = "") -> Column:
    c = {n: F.col(prefix + n) for n in ("paper_key", "status", "analysis", "error_code", "error_detail", "analysis_mode")}
    good, bad = c["status"] == V.SUCCESS, c["status"] == V.FAILED
    return codes(
        ("BLANK_KEY", is_blank(c["paper_key"])),
        ("UNKNOWN_STATUS", ~F.coalesce(good | bad, F.lit(False))),
        ("UNKNOWN_MODE", c["analysis_mode"].isNotNull() & ~c["analysis_mode"].isin(*V.ANALYSIS_MODES)),
        ("SUCCESS_WITHOUT_ANALYSIS", good & c["analysis"].isNull()),
        ("ANALYSIS_KEY_MISMATCH", good & c["analysis"].isNotNull()
         & ~c["analysis"]["paper_key"].eqNullSafe(c["paper_key"])),
        ("SUCCESS_WITH_ERROR", good & (c["error_code"].isNotNull() | c["error_detail"].isNotNull())),
        ("FAILED_WITH_ANALYSIS", bad & c["analysis"].isNotNull()),
        ("FAILED_WITHOUT_ERROR", bad & is_blank(c["error_code"])),
    )


def identity_violations() -> Column:
    """Agreement of both branches with the record they were joined to."""
    key = F.col("paper.paper_key")
    return codes(
        ("LIKES_KEY", ~F.col("likes.paper_key").eqNullSafe(key)),
        ("LIKES_ID", ~F.col("likes.arxiv_id").eqNullSafe(F.col("paper.arxiv_id"))),
        ("ANALYSIS_KEY", F.col("analysis").isNotNull() & ~F.col("analysis.paper_key").eqNullSafe(key)),
    )


def page_violations() -> Column:
    return codes(("HTML_OR_ERROR", F.col("html").isNull() == F.col("error_code").isNull()))


def run_input_violations(max_records: int = V.MAX_RECORDS, max_questions: int = V.MAX_QUESTIONS) -> Column:
    """Rules of a run request; its size bounds are parameters and bind no operator."""
    def outside(name: str, low, high) -> Column:
        return ~F.coalesce(F.col(name).between(low, high), F.lit(False))

    return codes(
        ("UNSUPPORTED_YEAR", ~F.coalesce(F.col("year").isin(2025, 2026), F.lit(False))),
        ("LIKES_STRATEGY", ~F.coalesce(F.col("likes_strategy").isin("alphaxiv_api", "shadowbot"), F.lit(False))),
        ("MAX_PAPERS", outside("max_papers", 0, max_records)),
        ("QUESTION_COUNT", ~F.size("paper_questions").between(1, max_questions)),
        ("BLANK_QUESTION", blank_item(F.col("paper_questions"))),
        ("BLANK_TOPIC", blank_item(F.col("topics"))),
        ("ANALYSIS_CONCURRENCY", outside("analysis_concurrency", 1, 3)),
        ("REQUEST_INTERVAL", outside("analysis_request_interval_seconds", 0, 300)),
        ("MAX_NEW", outside("max_new_analyses_per_run", 0, max_records)),
    )


def run_id_ok(run_id: Column) -> Column:
    return F.coalesce(run_id.rlike(V.RUN_ID_PATTERN), F.lit(False))


def require_run_ids(rows: DataFrame, run: str = "run_id") -> None:
    """Run ids become folder names, so one of another form stops the job."""
    if rows.select(run).distinct().filter(~run_id_ok(F.col(run))).first():
        raise ValueError(V.INVALID_RUN_ID)


def unknown_fields(json_text: Column, allowed: Iterable[str] | T.StructType) -> Column:
    """Sorted top-level keys of a JSON object that the shape does not declare."""
    names = allowed.names if isinstance(allowed, T.StructType) else list(allowed)
    declared = F.array(*(F.lit(n) for n in names))
    return F.array_sort(F.array_except(F.json_object_keys(json_text), declared))


def check_rows(df: DataFrame, violations: Column) -> DataFrame:
    return df.withColumn(VIOLATIONS, violations)


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, rows that break it)."""
    clean = F.size(VIOLATIONS) == 0
    return checked.filter(clean).drop(VIOLATIONS), checked.filter(~clean)


def violation_counts(checked: DataFrame, *groups: str) -> DataFrame:
    return (
        checked.select(*groups, F.explode(VIOLATIONS).alias("code"))
        .groupBy(*groups, "code")
        .agg(F.count("*").alias("n"))
    )


def require_clean(checked: DataFrame) -> DataFrame:
    """Strict mode: raise on the first broken row, else hand back the rows."""
    good, bad = split_rows(checked)
    found = bad.select(VIOLATIONS).first()
    if found:
        raise ValueError(", ".join(found[0]))
    return good
