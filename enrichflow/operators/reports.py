"""Markdown reports as string columns, run summary lines and the manifest row."""
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import numbered
from enrichflow.operators.counts import run_counts, run_status, warning_summary
from enrichflow.schemas import RUN_COUNTS


def answer_sections(questions: Column, analysis: Column) -> Column:
    """Numbered answer sections, or the raw answer / summary when no question has an answer."""
    pairs = F.transform(
        questions,
        lambda q, i: F.struct((i + 1).alias("n"), q.alias("q"), F.try_element_at(analysis["answer_by_question"], q).alias("a")),
    )
    sections = F.transform(
        F.filter(pairs, lambda p: F.coalesce(p["a"] != "", F.lit(False))),
        lambda p: F.concat(F.lit("### "), p["n"].cast("string"), F.lit(". "), p["q"], F.lit("\n\n"), p["a"]),
    )
    plain = F.coalesce(F.nullif(analysis["raw_answer"], F.lit("")), analysis["method_summary"])
    text = F.coalesce(F.nullif(F.array_join(sections, "\n\n"), F.lit("")), plain, F.lit(""))
    return F.when(analysis.isNull(), F.lit("Unavailable")).otherwise(text)


def markdown(paper: Column, status: Column, likes: Column, warnings: Column, answers: Column) -> Column:
    """The report layout shared by final and interim reports."""
    return F.concat(
        F.lit("# "), paper["title"],
        F.lit("\n\n- arXiv: "), paper["arxiv_id"],
        F.lit("\n- Status: "), status,
        F.lit("\n- Likes: "), likes,
        F.lit("\n- Warnings: "), warnings,
        F.lit("\n\n## Questions\n\n"), F.coalesce(numbered(paper["questions"]), F.lit("")),
        F.lit("\n\n## Answers\n\n"), answers,
        F.lit("\n"),
    )


def shown_likes(likes: Column) -> Column:
    return F.coalesce(likes.cast("string"), F.lit("FAILED"))


def final_report(paper: Column, likes: Column, analysis: Column, status: Column, warnings: Column) -> Column:
    listed = F.coalesce(F.nullif(F.array_join(warnings, ", "), F.lit("")), F.lit("None"))
    return markdown(paper, status, shown_likes(likes["likes"]), listed, answer_sections(paper["questions"], analysis))


def interim_report(paper: Column, analysis: Column, error_code: Column) -> Column:
    """Report of an analysis whose metric branch has not landed."""
    done = analysis.isNotNull()
    return markdown(
        paper,
        F.when(done, F.lit("ANALYSIS_COMPLETED")).otherwise(F.lit("ANALYSIS_FAILED")),
        F.lit("Pending"),
        F.when(done, F.lit("Likes collection pending")).otherwise(F.coalesce(error_code, F.lit(V.ANALYSIS_ERROR))),
        answer_sections(paper["questions"], analysis),
    )


def report_name(archive_id: Column) -> Column:
    return F.concat(F.replace(archive_id, F.lit("/"), F.lit("__")), F.lit(".md"))


def final_reports(results: DataFrame) -> DataFrame:
    """(run columns, paper_key, file_name, body) per joined result."""
    carried = [c for c in results.columns if c in ("run_id", "batch", "ord")]
    body = final_report(F.col("paper"), F.col("likes"), F.col("analysis"), F.col("status"), F.col("warnings"))
    return results.select(
        *carried, "paper.paper_key", report_name(F.col("paper.arxiv_id")).alias("file_name"), body.alias("body")
    )


def interim_reports(tasks: DataFrame, analyses: DataFrame) -> DataFrame:
    """(run columns, paper_key, file_name, body) per analysis row, before metrics are joined."""
    payload = F.struct("title", "arxiv_id", "questions")
    carried = [c for c in tasks.columns if c in ("run_id", "ord")]
    papers = tasks.select("paper_key", *carried, payload.alias("paper"))
    keys = [c for c in ("run_id", "paper_key") if c in tasks.columns and c in analyses.columns]
    found = analyses.select(*keys, "analysis", "error_code")
    body = interim_report(F.col("paper"), F.col("analysis"), F.col("error_code"))
    return papers.join(found, keys).select(
        *carried, "paper_key", report_name(F.col("paper.arxiv_id")).alias("file_name"), body.alias("body")
    )


def summary_lines(results: DataFrame, manifest: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, section, order columns, text): header lines from the manifest, then a line per record.

    Order is in the columns; a sorted write by (run, section, ord) gives the document.
    """
    order = [c for c in results.columns if c in ("batch", "ord")]
    head = F.array(
        F.concat(F.lit("# "), F.col("input.conference"), F.lit(" "), F.col("input.year").cast("string"),
                 F.lit(" Research Summary")),
        F.lit(""),
        F.concat(F.lit("Run status: "), F.col("status")),
        F.lit(""),
        F.concat(
            F.lit("Selected: "), F.col("counts.selected").cast("string"),
            F.lit("; Completed: "), F.col("counts.completed").cast("string"),
            F.lit("; Partial: "), F.col("counts.partial").cast("string"),
            F.lit("; Failed: "), F.col("counts.failed").cast("string"), F.lit("."),
        ),
        F.lit(""),
        F.lit("| arXiv ID | Status | Likes |"),
        F.lit("|---|---|---:|"),
    )
    nothing = [F.lit(None).cast(results.schema[c].dataType).alias(c) for c in order]
    top = manifest.select(run, F.posexplode(head).alias("section", "text"), *nothing)
    line = F.concat(
        F.lit("| "), F.col("paper.arxiv_id"), F.lit(" | "), F.col("status"), F.lit(" | "),
        shown_likes(F.col("likes.likes")), F.lit(" |"),
    )
    body = results.select(run, F.lit(8).alias("section"), line.alias("text"), *order)
    return top.unionByName(body)


def manifest_rows(
    results: DataFrame,
    initial: DataFrame,
    warnings: DataFrame,
    run_input: Column,
    started_at: datetime,
    finished_at: datetime,
    page_count: Column | int = 0,
    run: str = "run_id",
) -> DataFrame:
    """One manifest row per run of ``initial`` (run, discovered, skipped, selected).

    ``counts.selected`` is the number of stored rows; the number first selected stays in
    ``selected_at_start``. Warnings are (phase, code, n) structs; the full list is its own table.
    """
    stored = run_counts(results, run).drop("run_status")
    summary = warning_summary(warnings, run)
    joined = (
        initial.withColumnRenamed("selected", "selected_at_start")
        .join(stored, run, "left")
        .join(summary, run, "left")
        .na.fill(0, [n for n in RUN_COUNTS.names if n not in ("discovered", "skipped")])
    )
    status = run_status(F.col("selected"), F.col("completed"), F.col("failed"))
    pages = page_count if isinstance(page_count, Column) else F.lit(page_count)
    return joined.select(
        run,
        status.alias("status"),
        run_input.alias("input"),
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(finished_at).cast("timestamp").alias("finished_at"),
        pages.cast("bigint").alias("discovered_page_count"),
        F.struct(*RUN_COUNTS.names).alias("counts"),
        "selected_at_start",
        "warnings",
    )
