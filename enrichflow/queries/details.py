"""Queries on the gates, forms and rule sets that the other queries leave at their plain settings."""
from pyspark.sql import functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import archive_key, escape_markup
from enrichflow.functions.urls import private_endpoint, resolve_secure
from enrichflow.operators import contracts, counts, extract, selection, taskstate, texts
from enrichflow.operators.texts import evidence_xml
from enrichflow.queries import tables
from enrichflow.queries.joining import CUT
from enrichflow.queries.registry import query
from enrichflow.queries.reporting import task_offers
from enrichflow.queries.selecting import SEEDS_SQL, TOPICS, seeds
from enrichflow.queries.tables import QUESTIONS, table
from enrichflow.sources.scans import scan_pages
from enrichflow.sources.scratch import written

AUTHORITIES = ("openaccess.thecvf.com", "OpenAccess.TheCVF.com:443", "openaccess.thecvf.com:8443", "me@openaccess.thecvf.com",
               "openaccess.thecvf.com.example", "openaccess.thecvf.com:0443")


def _placed(authority):
    """The page's URL with another authority; all else stays."""
    return F.regexp_replace("url", "//[^/?#]+", F.concat(F.lit("//"), authority))


@query(
    f"""
WITH p AS (SELECT page_id, regexp_replace(url, '//[^/?#]+', '//' || {list(AUTHORITIES)}[CAST(page_id % 6 AS INTEGER) + 1]) AS base,
                  page_id % 6 IN (0, 1, 5) AND url LIKE 'https://%' AS passes, page_id % 5 AS kind FROM pages),
h AS (SELECT *, 'https://' || {list(AUTHORITIES)}[CAST(page_id % 6 AS INTEGER) + 1] AS front FROM p)
SELECT page_id, CASE WHEN passes THEN CASE kind WHEN 0 THEN front || '/rooted/x?y=1' WHEN 1 THEN 'https://openaccess.thecvf.com/other'
                                             WHEN 4 THEN regexp_replace(base, '#.*$', '') END END AS resolved
FROM h"""
)
def q_gated_links(spark, sf_dir):
    """Real page URLs under allowed and refused authorities, joined with links of five forms; fragments go."""
    kinds = F.array(*(F.lit(h) for h in ("/rooted/x?y=1#part", "//openaccess.thecvf.com/other#x", "http://openaccess.thecvf.com/plain",
                                         "https://elsewhere.example/x", "")))
    authority = F.get(F.array(*(F.lit(a) for a in AUTHORITIES)), (F.col("page_id") % 6).cast("int"))
    href = F.get(kinds, (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", resolve_secure(_placed(authority), href).alias("resolved"))


def day_index(spark, sf_dir):
    """Pages on the catalogue's host whose one-word links are called days, by the parity of the page."""
    day = F.when(F.col("page_id") % 2 == 0, F.lit("Day  1: 2026-06-01")).otherwise(F.lit("Day 2:\t2026-06-02"))
    html = F.regexp_replace("html", F.lit('">[A-Za-z]+</a>'), F.concat(F.lit('">'), day, F.lit("</a>")))
    placed = _placed(F.lit(V.CATALOGUE_HOSTS[0]))
    pages = scan_pages(spark, f"{sf_dir}/pages.parquet").filter(F.col("url").startswith("https://"))
    return pages.withColumns({"url": placed, "html": html})


@query(
    """
WITH links AS (
  SELECT page_id, i AS ord, hrefs[i] AS href FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs,
           regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS names FROM pages WHERE url LIKE 'https://%') p,
    unnest(range(1, len(hrefs) + 1)) AS u(i)
  WHERE regexp_matches(names[i], '^[A-Za-z]+$'))
SELECT 'https://openaccess.thecvf.com' || href AS resolved, min(page_id) AS page_id,
       CASE WHEN min(page_id) % 2 = 0 THEN 'Day  1: 2026-06-01' ELSE 'Day 2:' || chr(9) || '2026-06-02' END AS text
FROM links GROUP BY href"""
)
def q_day_pages(spark, sf_dir):
    """Day links of all pages, first in page order; strict mode raises for a refused link or none at all."""
    return extract.day_pages(day_index(spark, sf_dir), strict=True).select("resolved", "page_id", "text")


def listing_table(spark, sf_dir):
    """A listing page per document: its text is the title; links, authors and year vary with its number."""
    n, link = F.col("doc_id"), '<a href="{}">{}</a>'
    number = n.cast("string")
    author = [F.concat(F.lit('<input type="hidden" name="query_author" value="'), a, F.lit('">')) for a in (F.col("lang"), F.col("source"), F.col("lang"))]
    form = F.concat(F.lit('<dd><form class="authsearch">'), *author, F.lit("</form></dd>"))
    first = F.concat(F.lit('<a href="/old/'), number, F.lit('.pdf">PDF</a>'))
    last = F.concat(F.lit('<a href="/new/'), number, F.lit('.pdf">pdf</a>'))
    archive = F.concat(F.lit('<a href="http://arxiv.org/abs/2401.'), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit('v2">arXiv</a>'))
    html = F.concat(
        F.lit('<html><body><dl><dt class="ptitle"><br><a href="/paper/'), number, F.lit('.html">'), escape_markup(F.col("text")), F.lit("</a></dt>"),
        F.when(n % 7 == 6, F.lit('<dd><form class="other"><input name="query_author" value="x"></form></dd>')).otherwise(form), F.lit("<dd>"),
        F.when(n % 3 != 0, first).otherwise(""), F.when(n % 3 == 1, last).otherwise(""), F.when(n % 2 == 0, archive).otherwise(""),
        F.lit("</dd></dl></body></html>"))
    year = F.get(F.array(F.lit("2025?day=1"), F.lit("2026"), F.lit("2026/"), F.lit("2024"), F.lit("20261")), (n % 5).cast("int"))
    return table(spark, sf_dir, "documents").select(
        n.alias("page_id"), n.alias("position"), F.concat(F.lit("https://openaccess.thecvf.com/CVPR"), year).alias("url"), html.alias("html"),
        F.lit(None).cast("string").alias("error_code"))


_SPACES = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+")
LISTED_SQL = f"""
listed AS (
  SELECT doc_id AS page_id, CASE doc_id % 5 WHEN 0 THEN 2025 WHEN 1 THEN 2026 WHEN 2 THEN 2026 END AS year,
         trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS title,
         CASE WHEN doc_id % 7 = 6 THEN CAST([] AS VARCHAR[]) WHEN lang = source THEN [lang] ELSE [lang, source] END AS authors,
         'https://openaccess.thecvf.com/paper/' || doc_id || '.html' AS detail_url,
         CASE doc_id % 3 WHEN 1 THEN 'https://openaccess.thecvf.com/new/' || doc_id || '.pdf'
                         WHEN 2 THEN 'https://openaccess.thecvf.com/old/' || doc_id || '.pdf' END AS pdf_url,
         CASE WHEN doc_id % 2 = 0 THEN 'https://arxiv.org/abs/2401.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v2' END AS arxiv_url
  FROM documents)"""


@query(
    "WITH" + LISTED_SQL + """
SELECT page_id, CAST(year AS INTEGER) AS year, md5(title) AS title, array_to_string(authors, '|') AS authors, detail_url, pdf_url, arxiv_url,
       title <> '' AND pdf_url IS NOT NULL AS valid
FROM listed WHERE year IS NOT NULL"""
)
def q_listing(spark, sf_dir):
    """Records in the catalogue's own markup: class, author form, required and optional link, year of the collection."""
    records = extract.listed_records(extract.parse_listings(listing_table(spark, sf_dir)))
    return records.select("page_id", "year", F.md5("title").alias("title"), F.array_join("authors", "|").alias("authors"), "detail_url", "pdf_url",
                          "arxiv_url", "valid")


@query(
    "WITH" + LISTED_SQL + """
SELECT page_id, 'INVALID_PAPER_RECORD' AS code FROM listed WHERE year IS NOT NULL AND (pdf_url IS NULL OR title = '')
UNION ALL SELECT page_id, 'UNSUPPORTED_CONFERENCE_YEAR' FROM listed WHERE year IS NULL"""
)
def q_listing_rejects(spark, sf_dir):
    """Records without the required link, and pages whose URL names no supported year."""
    parsed = written(extract.parse_listings(listing_table(spark, sf_dir)))  # both halves read it
    bad = extract.quarantined(extract.listed_records(parsed)).select("page_id", F.col("error_code").alias("code"))
    return bad.unionByName(extract.page_failures(parsed).select("page_id", F.col("error_code").alias("code")))


def rule_rows(spark, sf_dir):
    """Rows for all rule sets; each rule is broken for the documents of one remainder."""
    n, text = F.col("doc_id"), F.col("text")
    key = archive_key(n.cast("string"))

    def unless(remainder, good, bad):
        return F.when(n % 11 == remainder, bad).otherwise(good)

    status = F.when(n % 2 == 0, V.SUCCESS).otherwise(V.FAILED)
    analysis = texts.complete_answer_analysis(unless(5, key, F.lit("arxiv:other")), text)
    paper = F.struct(key.alias("paper_key"), n.cast("string").alias("arxiv_id"))
    likes = F.struct(unless(1, key, F.lit(" ")).alias("paper_key"), unless(2, n.cast("string"), F.lit("x")).alias("arxiv_id"))
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.alias("title"), unless(0, F.lit("https://a.example"), F.lit(" ")).alias("detail_url"), F.lit("u").alias("pdf_url"),
        F.lit("Day 1").alias("conference_day"), unless(1, F.lit("u"), F.lit(" ")).alias("arxiv_url"),
        unless(2, F.array("source"), F.array("source", F.lit(""))).alias("authors"), unless(3, F.lit(2026), F.lit(2024)).alias("year"),
        unless(4, key, F.lit("arxiv:other")).alias("paper_key"), n.cast("string").alias("arxiv_id"),
        unless(6, F.array("lang"), F.array().cast("array<string>")).alias("questions"), unless(7, status, F.lit("MAYBE")).alias("status"),
        F.when(n % 2 == 0, analysis).alias("analysis"), F.when(n % 2 == 1, F.lit("CODE")).alias("error_code"), nothing.alias("error_detail"),
        unless(8, F.lit("mcp_report"), F.lit("other")).alias("analysis_mode"), paper.alias("paper"), likes.alias("likes"),
        unless(9, text, nothing).alias("html"), unless(10, F.lit("shadowbot"), F.lit("none")).alias("likes_strategy"),
        (n % 3 - 1).cast("int").alias("max_papers"), F.array("lang").alias("paper_questions"), F.array(text).alias("topics"),
        (n % 5).cast("int").alias("analysis_concurrency"), (n % 500).cast("double").alias("analysis_request_interval_seconds"),
        F.lit(0).alias("max_new_analyses_per_run"))


RULE_SETS = {
    "seed": contracts.seed_violations, "task": contracts.task_violations, "analysis": contracts.analysis_violations,
    "identity": contracts.identity_violations, "page": contracts.page_violations, "run_input": contracts.run_input_violations,
}


@query(
    """
WITH d AS (SELECT doc_id, doc_id % 11 AS r, doc_id % 2 = 0 AS even FROM documents),
k AS (SELECT *, CASE WHEN r = 4 THEN 'arxiv:other' ELSE 'arxiv:' || doc_id END AS key,
             CASE WHEN r = 5 THEN 'arxiv:other' ELSE 'arxiv:' || doc_id END AS akey FROM d),
v AS (
  SELECT 'seed' AS rules, CASE r WHEN 0 THEN 'BLANK_DETAIL_URL' WHEN 1 THEN 'BLANK_ARXIV_URL' WHEN 2 THEN 'BLANK_AUTHOR'
                                 WHEN 3 THEN 'UNSUPPORTED_YEAR' END AS code FROM k
  UNION ALL SELECT 'task', CASE r WHEN 0 THEN 'BLANK_DETAIL_URL' WHEN 1 THEN 'BLANK_ARXIV_URL' WHEN 2 THEN 'BLANK_AUTHOR'
                                  WHEN 4 THEN 'KEY_MISMATCH' WHEN 6 THEN 'QUESTION_COUNT' END FROM k
  UNION ALL SELECT 'analysis', CASE WHEN r = 7 THEN 'UNKNOWN_STATUS' WHEN r = 8 THEN 'UNKNOWN_MODE'
                                    WHEN even AND key <> akey THEN 'ANALYSIS_KEY_MISMATCH' END FROM k
  UNION ALL SELECT 'identity', CASE r WHEN 1 THEN 'LIKES_KEY' WHEN 2 THEN 'LIKES_ID' END FROM k
  UNION ALL SELECT 'identity', CASE WHEN even AND r = 5 THEN 'ANALYSIS_KEY' END FROM k
  UNION ALL SELECT 'page', CASE WHEN (r = 9) = even THEN 'HTML_OR_ERROR' END FROM k
  UNION ALL SELECT 'run_input', CASE WHEN r = 3 THEN 'UNSUPPORTED_YEAR' END FROM k
  UNION ALL SELECT 'run_input', CASE WHEN r = 10 THEN 'LIKES_STRATEGY' END FROM k
  UNION ALL SELECT 'run_input', CASE WHEN doc_id % 3 = 0 THEN 'MAX_PAPERS' END FROM k
  UNION ALL SELECT 'run_input', CASE WHEN doc_id % 5 NOT BETWEEN 1 AND 3 THEN 'ANALYSIS_CONCURRENCY' END FROM k
  UNION ALL SELECT 'run_input', CASE WHEN doc_id % 500 > 300 THEN 'REQUEST_INTERVAL' END FROM k)
SELECT rules, code, count(*) AS n FROM v WHERE code IS NOT NULL GROUP BY ALL"""
)
def q_rule_sets(spark, sf_dir):
    """Violations per rule set, from one pass over the rows."""
    found = F.array(*(F.struct(F.lit(name).alias("rules"), rules().alias("codes")) for name, rules in RULE_SETS.items()))
    each = rule_rows(spark, sf_dir).select(F.explode(found).alias("f")).select("f.rules", F.explode("f.codes").alias("code"))
    return each.groupBy("rules", "code").agg(F.count("*").alias("n"))


@query(
    "WITH" + SEEDS_SQL + """
SELECT count(*) AS discovered, count(*) FILTER (disposition <> 'selected') AS skipped,
       least(25, count(*) FILTER (disposition = 'selected')) AS selected
FROM disposed"""
)
def q_limited_counts(spark, sf_dir):
    """Counters at the start of a run whose limit takes 25 records."""
    tasks, disposed = selection.select_records(seeds(spark, sf_dir), TOPICS, QUESTIONS, 25)
    return counts.initial_counts(disposed, tasks=tasks)


@query(
    """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL),
u AS (SELECT *, role = 'assistant' AND regexp_matches(text, '[^\\s\\x{85}\\x{A0}\\x{3000}]') AS usable FROM t)
SELECT conv_id, md5(arg_min(text, turn) FILTER (usable)) AS text,
       CASE WHEN count(*) FILTER (usable) = 0 THEN 'INVALID_ALPHAXIV_RESPONSE' END AS error_code
FROM u GROUP BY conv_id"""
)
def q_first_block(spark, sf_dir):
    """A conversation as content blocks in turn order; the assistant's turns are envelopes, the users' are images or broken ones."""
    wrapped = evidence_xml(F.lit("https://arxiv.org/abs/1.pdf"), F.col("text"))
    block = (F.when(F.col("role") == "assistant", F.struct(F.lit("text").alias("type"), wrapped.alias("text")))
             .when(F.col("turn") % 2 == 0, F.struct(F.lit("image").alias("type"), wrapped.alias("text")))
             .otherwise(F.struct(F.lit("text").alias("type"), F.concat(F.lit("<paper>"), escape_markup(F.col("text"))).alias("text"))))
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("t"))
    found = texts.block_envelopes(turns.select("conv_id", F.transform("t", lambda x: x["block"]).alias("blocks")), "conv_id")
    page = F.from_xml("envelope", "_id STRING, page ARRAY<STRUCT<_num: STRING, _VALUE: STRING>>", {"ignoreSurroundingSpaces": "false"})
    plain = F.regexp_extract("envelope", r'(?s)<page num="1">(.*)</page></paper>$', 1)
    same = F.col("conv_id"), F.md5(_unescaped(plain)).alias("text"), F.col("error_code")
    return found.withColumn("_id", page["_id"]).select(*same)


def _unescaped(text):
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@query(
    """
WITH t AS (SELECT doc_id, source, text || chr(10) || chr(10) || 'Code: https://github.com/' || source || '/r.' || (doc_id % 9) || ', https://github.com/' || lang
                  || '/x and https://github.com/' || source || '/r.' || (doc_id % 9) || '/tree' AS answer, lang FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'https://github.com/' || source || '/r.' || (doc_id % 9) || '|https://github.com/' || lang || '/x' AS code_urls,
       md5(trim(answer, chr(10) || chr(9) || chr(13) || ' ')) AS raw_answer, 1 AS n_warnings
FROM t"""
)
def q_raw_answer(spark, sf_dir):
    """A combined answer kept as it came, with the distinct code URLs in it."""
    repository = F.concat(F.lit("https://github.com/"), F.col("source"), F.lit("/r."), (F.col("doc_id") % 9).cast("string"))
    answer = F.concat("text", F.lit("\n\nCode: "), repository, F.lit(", https://github.com/"), "lang", F.lit("/x and "), repository, F.lit("/tree"))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", answer.alias("answer"))
    made = rows.select("doc_id", texts.raw_answer_analysis(tables.document_key(), F.col("answer")).alias("a"))
    return made.select("doc_id", F.array_join("a.code_urls", "|").alias("code_urls"), F.md5("a.raw_answer").alias("raw_answer"),
                       F.size("a.warnings").alias("n_warnings"))


@query(
    """
SELECT doc_id, md5('arxiv:' || doc_id || chr(10) || chr(10) || 'Questions:' || chr(10) || '- ' || lang || chr(10) || '- ' || source || chr(10) || chr(10) || 'XML:'
           || chr(10) || text || chr(10)) AS tail, 'https://arxiv.org/abs/' || doc_id AS paper, lang || '|' || source AS queries,
       'https://arxiv.org/abs/' || doc_id AS url
FROM documents WHERE text IS NOT NULL"""
)
def q_evidence_prompt(spark, sf_dir):
    """The prompt over an envelope, below its fixed instruction, and the two requests for a document."""
    url = F.concat(F.lit("https://arxiv.org/abs/"), F.col("doc_id").cast("string"))
    asked = F.array("lang", "source")
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(
        "doc_id", texts.evidence_prompt(tables.document_key(), asked, F.col("text")).alias("prompt"), texts.query_request(url, asked).alias("q"),
        texts.report_request(url).alias("r"))
    tail = F.substring(F.col("prompt"), F.locate("\npaper_key: ", F.col("prompt")) + len("\npaper_key: "), F.length("prompt"))
    return rows.select("doc_id", F.md5(tail).alias("tail"), "q.paper", F.array_join("q.queries", "|").alias("queries"), "r.url")


@query(
    f"""
WITH u AS (SELECT page_id, url, page_id % 4 AS kind, {{'a': '10.0.0.7:8000', 'b': 'localhost', 'c': '172.32.0.1', 'd': '127.0.0.1:90'}} AS h FROM pages),
p AS (SELECT *, CASE kind WHEN 0 THEN h.a WHEN 1 THEN h.b WHEN 2 THEN h.c ELSE h.d END AS host,
             regexp_matches(url, '^http://[^/?#]+/?$') AS bare FROM u)
SELECT page_id, CASE WHEN page_id % 3 = 0 AND kind <> 2 OR page_id % 3 <> 0 AND bare AND kind <> 2 THEN 'http://' || host END AS endpoint
FROM p"""
)
def q_page_endpoint(spark, sf_dir):
    """Page URLs moved to private hosts: a path, query or fragment refuses them; for a third of the pages only the origin is kept."""
    hosts = F.array(*(F.lit(h) for h in ("10.0.0.7:8000", "localhost", "172.32.0.1", "127.0.0.1:90")))
    moved = _placed(F.get(hosts, (F.col("page_id") % 4).cast("int")))
    origin = F.concat(F.lit("http://"), F.regexp_extract(moved, "//([^/?#]+)", 1), F.lit("/"))
    url = F.when(F.col("page_id") % 3 == 0, origin).otherwise(moved)
    found = table(spark, sf_dir, "pages").select("page_id", private_endpoint(url, allow_ipv6=False).alias("e"))
    return found.select("page_id", "e.endpoint")


@query(
    f"""
WITH offers AS (
  SELECT 'run' || (user_id % 4) AS run_id, 'arxiv:' || user_id AS paper_key, event_id,
         'user ' || user_id || CASE WHEN user_id % 4 = 1 AND CAST(json_extract(props, '$.k') AS BIGINT) >= 90 THEN ' changed' ELSE '' END AS title,
         ts < TIMESTAMP '{CUT}' AS early
  FROM events WHERE event_type = 'view'),
stored AS (SELECT run_id, paper_key, arg_min(title, event_id) AS title FROM offers WHERE early GROUP BY ALL),
new AS (SELECT run_id, paper_key, title, min(event_id) AS seq FROM offers WHERE NOT early GROUP BY ALL),
j AS (SELECT new.*, s.title IS NOT NULL AS known,
             new.title <> coalesce(s.title, first_value(new.title) OVER (PARTITION BY new.run_id, new.paper_key ORDER BY new.seq)) AS clash
      FROM new LEFT JOIN stored s USING (run_id, paper_key)),
refused AS (SELECT DISTINCT run_id FROM j WHERE clash)
SELECT run_id, paper_key, title, seq, 'PENDING' AS state FROM j
WHERE NOT known AND NOT clash AND run_id NOT IN (SELECT run_id FROM refused)"""
)
def q_task_pending(spark, sf_dir):
    """Rows to add after a batch; a run with a conflicting offer has its whole batch refused."""
    return taskstate.pending_rows(task_offers(spark, sf_dir, ("run1",))).select("run_id", "paper_key", "title", "seq", "state")
