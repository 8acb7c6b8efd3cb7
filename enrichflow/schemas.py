"""Declared row shapes. Nothing is inferred for domain rows."""
from pyspark.sql import types as T

TEXT, INT, LONG, REAL, FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
TEXTS = T.ArrayType(TEXT)


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAGE = row(page_id=LONG, position=INT, url=TEXT, html=TEXT, error_code=TEXT)

RECORD_SEED = row(
    conference=TEXT, year=INT, title=TEXT, authors=TEXTS, detail_url=TEXT, pdf_url=TEXT, arxiv_url=TEXT,
    conference_day=TEXT,
)

RECORD_TASK = row(
    conference=TEXT, year=INT, title=TEXT, authors=TEXTS, detail_url=TEXT, pdf_url=TEXT, paper_key=TEXT,
    arxiv_url=TEXT, arxiv_id=TEXT, questions=TEXTS, conference_day=TEXT,
)

LIKES_TASK = row(paper_key=TEXT, title=TEXT, arxiv_url=TEXT, arxiv_id=TEXT)

LIKES_RESULT = row(paper_key=TEXT, arxiv_id=TEXT, likes=LONG, raw_text=TEXT, status=TEXT, error_code=TEXT)

ANALYSIS = row(
    paper_key=TEXT, research_problem=TEXT, main_contributions=TEXTS, method_summary=TEXT, datasets=TEXTS,
    key_results=TEXTS, limitations=TEXTS, code_urls=TEXTS, answer_by_question=T.MapType(TEXT, TEXT),
    source_references=TEXTS, warnings=TEXTS, raw_answer=TEXT,
)

ANALYSIS_RESULT = row(
    paper_key=TEXT, status=TEXT, analysis=ANALYSIS, error_code=TEXT, error_detail=TEXT, analysis_mode=TEXT,
    questions=TEXTS,
)

JOINED_RESULT = row(paper=RECORD_TASK, likes=LIKES_RESULT, analysis=ANALYSIS, status=TEXT, warnings=TEXTS)

QA_RECORD = row(paper_key=TEXT, arxiv_id=TEXT, title=TEXT, questions=TEXTS, answer=TEXT, status=TEXT)

RUN_COUNTS = row(
    discovered=LONG, skipped=LONG, selected=LONG, likes_success=LONG, likes_failed=LONG, analysis_success=LONG,
    analysis_failed=LONG, completed=LONG, partial=LONG, failed=LONG,
)

RUN_INPUT = row(
    conference=TEXT, year=INT, likes_strategy=TEXT, topics=TEXTS, max_papers=INT, paper_questions=TEXTS,
    analysis_concurrency=INT, analysis_request_interval_seconds=REAL, max_new_analyses_per_run=INT,
    authorization_circuit_breaker=FLAG,
)

TASK_EVENT = row(
    run_id=TEXT, seq=LONG, kind=TEXT, paper_key=TEXT, title=TEXT, arxiv_url=TEXT, arxiv_id=TEXT, likes=LONG,
    raw_text=TEXT, error_code=TEXT,
)

LINKS = T.ArrayType(row(href=TEXT, text=TEXT))
RAW_RECORDS = T.ArrayType(row(title=TEXT, detail_href=TEXT, authors=TEXTS, links=LINKS))
