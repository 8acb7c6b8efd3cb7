"""Values that outputs and stored tables must carry exactly. No logic here."""

# --- fixed values: hosts, path shapes and identifier patterns ---
CATALOGUE_HOSTS = ("openaccess.thecvf.com",)
ARCHIVE_HOSTS = ("arxiv.org", "export.arxiv.org")
ARCHIVE_PATH_HEADS = ("abs", "pdf")
ARCHIVE_ID_PATTERN = r"(?:[0-9]{4}\.[0-9]{4,5}|[A-Za-z][A-Za-z0-9.-]*/[0-9]{7})(?:v[0-9]+)?"
ARCHIVE_VERSION_PATTERN = r"v[0-9]+$"
ARCHIVE_KEY_PREFIX = "arxiv:"
COLLECTION_YEAR_PATTERN = r"/CVPR(2025|2026)(?:\?|/|$)"
DAY_LINK_PATTERN = r"^Day\s+[0-9]+:\s+[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CODE_URL_PATTERN = r"https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"
RUN_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
LIKES_TEXT_PATTERN = r"^\s*[0-9,]+\s+Likes?\s*$"
LOCAL_HOST_NAMES = ("localhost", "host.docker.internal")

# --- fixed values: markup of a record listing ---
RECORD_TAG = "dt"
RECORD_CLASS = "ptitle"
AUTHOR_FORM_CLASS = "authsearch"
AUTHOR_FIELD = "query_author"
REQUIRED_LINK_LABEL = "pdf"
OPTIONAL_LINK_LABEL = "arxiv"

# --- fixed values: states ---
RUN_COMPLETED, RUN_PARTIAL, RUN_FAILED = "COMPLETED", "PARTIAL", "FAILED"
SUCCESS, FAILED = "SUCCESS", "FAILED"
COMPLETED, PARTIAL = "COMPLETED", "PARTIAL"
TASK_STATES = ("PENDING", "CLAIMED", "SUCCESS", "FAILED")
ANALYSIS_MODES = ("mcp_qa_raw", "mcp_report", "structured_llm")
REPORT_MODE = "mcp_report"

# --- fixed values: result codes ---
INVALID_CATALOGUE_URL = "INVALID_CVF_URL"
INVALID_ARCHIVE_URL = "INVALID_ARXIV_URL"
INVALID_RECORD = "INVALID_PAPER_RECORD"
NO_DAY_LINKS = "NO_CONFERENCE_DAYS"
EMPTY_RECORD_LIST = "EMPTY_PAPER_LIST"
UNSUPPORTED_YEAR = "UNSUPPORTED_CONFERENCE_YEAR"
PAGE_UNAVAILABLE = "DAY_PAGE_UNAVAILABLE"
MISSING_ANALYSIS = "MISSING_ANALYSIS_RESULT"
MISSING_LIKES = "MISSING_LIKES_RESULT"
RECORD_MISMATCH = "PAPER_RESULT_MISMATCH"
ANALYSIS_MISMATCH = "ANALYSIS_RESULT_MISMATCH"
LIKES_MISMATCH = "LIKES_RESULT_MISMATCH"
ANALYSIS_ERROR = "PAPER_ANALYSIS_FAILED"
LIKES_NOT_FOUND = "ALPHAXIV_LIKES_NOT_FOUND"
LIKES_UNAVAILABLE = "ALPHAXIV_LIKES_UNAVAILABLE"
INVALID_RESPONSE = "INVALID_ALPHAXIV_RESPONSE"
EVIDENCE_UNAVAILABLE = "ALPHAXIV_EVIDENCE_UNAVAILABLE"
EMPTY_ANSWER = "EMPTY_QUESTION_ANSWER"
RAW_SOURCE_ANSWER = "RAW_PAPER_RETURNED_AS_ANSWER"
INCOMPLETE_ANSWERS = "INCOMPLETE_QUESTION_ANSWERS"
DEFERRED_BY_LIMIT = "ANALYSIS_DEFERRED_RUN_LIMIT"
DEFERRED_BY_CUTOFF = "ANALYSIS_DEFERRED_AUTHORIZATION_CIRCUIT_OPEN"
SKIPPED_NO_MODEL_ACCESS = "ANALYSIS_SKIPPED_NO_LLM_CREDENTIALS"
INVALID_RUN_ID = "INVALID_RUN_ID"

# --- fixed values: what error texts must not show ---
SECRET_PATTERN = r"(?i)\b(authorization|bearer|access[_-]?token|token)\b(?:\s*[:=]\s*|\s+)(?:(?:bearer|basic|token)\s+)?[^\s,;]+"

# --- fixed values: texts that mark an authorization failure ---
AUTH_FAILURE_MARKS = ("http 401", "invalid authorization", "unauthorized")

# --- fixed values: warnings stored with an analysis ---
REPORT_MODE_WARNING = (
    "MCP_REPORT_MODE: alphaXiv AI report used directly; custom questions "
    "were not separately synthesized by an external LLM."
)
RAW_MODE_WARNING = (
    "MCP_QA_RAW_MODE: questions and the complete alphaXiv answer are "
    "preserved without a second LLM call."
)
EVIDENCE_SOURCE = "alphaxiv_report_fallback"

# --- fixed values: where the metric sits in a metadata response ---
METRIC_PATH = ("data", "paper_group", "metrics", "public_total_votes")

# --- fixed values: limits and defaults ---
MAX_ERROR_DETAIL = 500
MAX_RECORDS = 10_000
MAX_QUESTIONS = 10

# --- fixed values: names of the logs and the report table of a run ---
ANALYSIS_LOG = "analysis-checkpoint.jsonl"
LIKES_LOG = "likes-checkpoint.jsonl"
REPORTS = "reports"
