"""Queries on enrichment, text, XML and JSON work."""
from pyspark.sql import functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import escape_markup
from enrichflow.operators import enrich, jsonops, texts
from enrichflow.plans import flow
from enrichflow.queries import tables
from enrichflow.queries.registry import query
from enrichflow.queries.tables import prop_number, table, text_table
from enrichflow.sources.scratch import folder

SHORT = 200


def measure_text():
    """Function factory for the enrichment query: text measures, failing on short texts."""

    def call(task: dict) -> dict:
        text = task["text"]
        if len(text) < SHORT:
            raise ValueError(f"too short: token={task['paper_key']}")
        lines = text.count("\n") + 1
        return {"research_problem": f"{len(text)} characters", "method_summary": f"{lines} lines"}

    return call


@query(
    f"""
SELECT 'arxiv:' || doc_id AS paper_key, CASE WHEN length(text) < {SHORT} THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CASE WHEN length(text) >= {SHORT} THEN length(text) || ' characters' END AS problem,
       CASE WHEN length(text) >= {SHORT} THEN (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines' END AS summary,
       CASE WHEN length(text) < {SHORT} THEN 'PAPER_ANALYSIS_FAILED' END AS error_code,
       CASE WHEN length(text) < {SHORT} THEN 'ValueError: too short: token=<redacted>' END AS error_detail
FROM documents"""
)
def q_enrich(spark, sf_dir):
    tasks = text_table(spark, sf_dir, "documents").select(
        tables.document_key().alias("paper_key"), "text", F.array(F.lit("How long?")).alias("questions")
    )
    found = enrich.enrich_rows(tasks, measure_text, "structured_llm")
    return found.select(
        "paper_key",
        "status",
        F.col("analysis.research_problem").alias("problem"),
        F.col("analysis.method_summary").alias("summary"),
        "error_code",
        "error_detail",
    )


@query(
    """
WITH r AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT *, k <> 0 AND event_type NOT IN ('error', 'signup', 'view') AS good FROM r)
SELECT event_id, CASE WHEN good THEN k END AS likes,
       CASE WHEN good THEN k || CASE WHEN k = 1 THEN ' Like' ELSE ' Likes' END END AS raw_text,
       CASE WHEN good THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       CASE WHEN good THEN NULL WHEN event_type <> 'view' AND k = 0 THEN 'ALPHAXIV_LIKES_NOT_FOUND'
            ELSE 'ALPHAXIV_LIKES_UNAVAILABLE' END AS error_code
FROM g"""
)
def q_metric_text(spark, sf_dir):
    """Responses by event: views have none, errors status 500, signups a text value, 0 is not found."""
    kind, number = F.col("event_type"), F.col("k")
    shown = F.when(kind == "signup", F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number.cast("string"))
    payload = F.concat(F.lit('{"data":{"paper_group":{"metrics":{"public_total_votes":'), shown, F.lit("}}}}"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", prop_number().alias("k"))
    responses = events.filter(kind != "view").select(
        F.col("event_id").alias("arxiv_id"),
        F.when(number == 0, 404).when(kind == "error", 500).otherwise(200).alias("http_status"),
        payload.alias("payload"),
    )
    tasks = events.select(F.col("event_id").alias("arxiv_id"), F.col("event_id").alias("paper_key"))
    found = enrich.metric_results(tasks, responses)
    return found.select(F.col("paper_key").alias("event_id"), "likes", "raw_text", "status", "error_code")


@query(
    """
WITH f AS (SELECT user_id, min(event_id) AS first FROM events
           WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50 GROUP BY 1)
SELECT event_id, coalesce(event_id > first, FALSE) AS deferred FROM events LEFT JOIN f USING (user_id)"""
)
def q_auth_cutoff(spark, sf_dir):
    detail = F.when(
        F.col("event_type") == "error",
        F.when(prop_number() >= 50, "RuntimeError: HTTP 401 Unauthorized").otherwise("RuntimeError: HTTP 429"),
    )
    attempts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), detail.alias("error_detail")
    )
    return enrich.cut_off(attempts).select(F.col("ord").alias("event_id"), "deferred")


WAVE = 20


def refusing():
    """Function factory: longest words are counted; a text with a certain remainder of its length is refused."""

    def call(task: dict) -> dict:
        if len(task["title"]) % 97 == 0:
            raise RuntimeError("HTTP 401")
        return {"research_problem": str(max(map(len, task["title"].split(" "))))}

    return call


@query(
    f"""
WITH t AS (SELECT source AS run_id, doc_id, text, length(text) % 97 = 0 AS refused,
                  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {WAVE} AS wave FROM documents),
s AS (SELECT *, coalesce(min(CASE WHEN refused THEN wave END) OVER (PARTITION BY run_id), 1000000000) AS stop FROM t)
SELECT run_id, 'arxiv:' || doc_id AS paper_key, CASE WHEN wave > stop OR refused THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CASE WHEN wave > stop THEN 'ANALYSIS_DEFERRED_AUTHORIZATION_CIRCUIT_OPEN' WHEN refused THEN 'PAPER_ANALYSIS_FAILED' END AS error_code,
       CASE WHEN wave <= stop AND NOT refused THEN
         CAST(list_max(list_transform(string_split(text, ' '), lambda w: length(w))) AS VARCHAR) END AS problem
FROM s"""
)
def q_enrich_waves(spark, sf_dir):
    """All documents of each source in waves; a refused call closes its run after the wave."""
    tasks = tables.record_tasks(spark, sf_dir)
    made = flow.analyse(tasks, folder(spark), refusing, "structured_llm", wave=WAVE)
    return made.results.select("run_id", "paper_key", "status", "error_code", F.col("analysis.research_problem").alias("problem"))


@query(
    f"""
SELECT doc_id, md5(clean) AS clean, clean <> text AS changed, md5(detail) AS detail,
       left(detail, 500) AS short_detail
FROM (SELECT *, 'Error: ' || trim(clean, chr(10) || chr(9) || ' ') AS detail FROM (
  SELECT doc_id, text, regexp_replace(text, '{V.SECRET_PATTERN}', '\\1=<redacted>', 'g') AS clean FROM documents))"""
)
def q_redact(spark, sf_dir):
    text = F.col("text")
    return (
        text_table(spark, sf_dir, "documents")
        .select("doc_id", "text", enrich.redact(text).alias("clean"))
        .select(
            "doc_id",
            F.md5("clean").alias("clean"),
            (F.col("clean") != text).alias("changed"),
            F.md5(enrich.error_detail(F.lit("Error"), text)).alias("detail"),
            enrich.error_detail(F.lit("Error"), text, V.MAX_ERROR_DETAIL).alias("short_detail"),
        )
    )


@query(
    """
WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS lines FROM conversations),
b AS (SELECT *, [CASE WHEN role = 'user' OR i % 2 = 1 THEN 'text' ELSE 'image' END FOR x, i IN lines] AS types FROM t)
SELECT conv_id, turn,
       md5(nullif(array_to_string([trim(x) FOR x, i IN lines IF types[i] = 'text' AND trim(x) <> ''], chr(10) || chr(10)), '')) AS body,
       array_to_string(types, ',') AS types,
       array_to_string([CAST(length(x) AS VARCHAR) FOR x, i IN lines IF types[i] = 'text'], ',') AS lengths
FROM b"""
)
def q_blocks(spark, sf_dir):
    """Each turn as blocks: its lines, every second line of other roles being an image block."""
    as_text = lambda i: (F.col("role") == "user") | (i % 2 == 0)
    blocks = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(F.when(as_text(i), "text").otherwise("image").alias("type"), line.alias("text")),
    )
    turns = text_table(spark, sf_dir, "conversations").select("conv_id", "turn", blocks.alias("blocks"))
    profiled = turns.withColumn("profile", texts.block_profile(F.col("blocks")))
    return profiled.select(
        "conv_id",
        "turn",
        F.md5(texts.block_text(F.col("blocks"))).alias("body"),
        F.array_join("profile.types", ",").alias("types"),
        F.array_join(F.transform("profile.text_lengths", lambda n: n.cast("string")), ",").alias("lengths"),
    )


def _escaped(sql: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        sql = f"replace({sql}, '{raw}', '{entity}')"
    return sql


_XML_SQL = (
    """'<paper id="' || doc_id || '" source="alphaxiv_report_fallback"><page num="1">' || """
    + _escaped("trim(text, chr(10) || chr(9) || ' ')")
    + " || '</page></paper>'"
)


@query(
    f"""
WITH e AS (SELECT doc_id, lang, {_XML_SQL} AS xml FROM documents)
SELECT doc_id, CASE WHEN lang <> 'es' THEN md5(CASE WHEN lang = 'de' THEN replace(xml, '<page num', '<page & num') ELSE xml END) END AS envelope,
       CASE WHEN lang IN ('en', 'fr') THEN CAST(doc_id AS VARCHAR) END AS envelope_id,
       CASE WHEN lang IN ('en', 'fr') THEN 1 END AS envelope_pages, lang = 'de' AS envelope_lenient
FROM e"""
)
def q_xml(spark, sf_dir):
    """English: envelope after a preamble. French: escaped. German: broken XML. Spanish: no end tag."""
    xml = texts.evidence_xml(F.concat(F.lit("https://arxiv.org/abs/"), F.col("doc_id")), F.col("text"))
    sent = text_table(spark, sf_dir, "documents").select("doc_id", "lang", xml.alias("xml"))
    answer = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Found:\n"), "xml", F.lit("\nend")))
        .when(F.col("lang") == "fr", escape_markup(F.col("xml")))
        .when(F.col("lang") == "de", F.replace(F.col("xml"), F.lit("<page num"), F.lit("<page & num")))
        .otherwise(F.replace(F.col("xml"), F.lit("</paper>"), F.lit("")))
    )
    found = texts.with_envelopes(sent.select("doc_id", answer.alias("answer")), "answer")
    return found.select(
        "doc_id", F.md5("envelope").alias("envelope"), "envelope_id", "envelope_pages", "envelope_lenient"
    )


@query(
    """
WITH k AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS a, min(turn) FILTER (role = 'user') AS u
           FROM conversations GROUP BY conv_id)
SELECT k.conv_id, coalesce(x.text, y.text) AS text, CASE WHEN x.text IS NOT NULL THEN 'primary'
       WHEN y.text IS NOT NULL THEN 'fallback' END AS source,
       CASE WHEN coalesce(x.text, y.text) IS NULL THEN 'ALPHAXIV_EVIDENCE_UNAVAILABLE' END AS error_code
FROM k LEFT JOIN conversations x ON k.conv_id = x.conv_id AND x.turn = k.a
       LEFT JOIN conversations y ON k.conv_id = y.conv_id AND y.turn = k.u"""
)
def q_fallback(spark, sf_dir):
    """First assistant turn, else the first user turn."""
    turns = text_table(spark, sf_dir, "conversations")

    def first(role: str):
        return (
            turns.filter(F.col("role") == role)
            .groupBy("conv_id")
            .agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("turn"))
        )

    keys = turns.select("conv_id").distinct()
    return enrich.with_fallback(keys, first("assistant"), first("user"), "conv_id", "text")


_WORDS = "[A-Z][a-z]+tion[a-z]*"


@query(
    f"""
SELECT doc_id, md5(list_filter([trim(p) FOR p IN string_split(trim(text, chr(10) || ' '), chr(10))], lambda p: p <> '')[1]) AS problem,
       md5(replace(trim(text, chr(10) || ' '), chr(10), chr(10) || chr(10))) AS summary,
       array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_WORDS}'))), ' ') AS found
FROM documents"""
)
def q_projection(spark, sf_dir):
    """Report projection; the code-URL extraction runs with a word pattern the texts contain."""
    report = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    made = text_table(spark, sf_dir, "documents").select(
        "doc_id", "text", texts.report_analysis(tables.document_key(), report).alias("a")
    )
    return made.select(
        "doc_id",
        F.md5("a.research_problem").alias("problem"),
        F.md5("a.method_summary").alias("summary"),
        F.array_join(F.array_sort(texts.code_urls(F.col("text"), _WORDS)), " ").alias("found"),
    )


@query(
    f"""
SELECT conv_id, turn, CAST(length(list) AS INTEGER) AS questions,
       md5('{texts.ANSWERS_TASK}' || chr(10) || chr(10) || 'Title: ' || role || chr(10) || 'arXiv: ' || conv_id || chr(10) || chr(10)
           || 'Questions:' || chr(10) || array_to_string([i || '. ' || x FOR x, i IN list], chr(10)) || chr(10) || chr(10)
           || 'Report:' || chr(10) || text || chr(10)) AS prompt
FROM (SELECT *, string_split(text, chr(10)) AS list FROM conversations)"""
)
def q_prompts(spark, sf_dir):
    """Prompt per turn: its lines are the questions, the whole text is the report."""
    asked = text_table(spark, sf_dir, "conversations").withColumn("questions", F.split("text", "\n"))
    prompt = texts.answers_prompt(F.col("role"), F.col("conv_id").cast("string"), F.col("questions"), F.col("text"))
    return asked.select("conv_id", "turn", F.size("questions").alias("questions"), F.md5(prompt).alias("prompt"))


@query(
    """
WITH p AS (
  SELECT u.conv_id, u.turn, u.text AS q, trim(a.text, chr(10) || chr(9) || ' ') AS a
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')
SELECT conv_id, turn, CASE WHEN a IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       md5('Question: ' || q || chr(10) || 'Answer: ' || a) AS answer,
       CASE WHEN a IS NULL THEN md5('INCOMPLETE_QUESTION_ANSWERS: ' || q) END AS error_code FROM p"""
)
def q_qa(spark, sf_dir):
    """User turn and the assistant turn after it as question and answer map."""
    turns = text_table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    paired = asked.join(replies, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.array("q").alias("questions"), F.create_map("q", F.coalesce("a", F.lit(" "))).alias("answers")
    )
    checked = paired.withColumn("c", texts.complete_answers(F.col("questions"), F.col("answers")))
    analysis = F.struct(
        F.col("c.answers").alias("answer_by_question"),
        F.col("c.raw_answer").alias("raw_answer"),
        F.lit("").alias("method_summary"),
    )
    answer = texts.qa_answer(F.col("questions"), F.when(F.col("c.error_code").isNull(), analysis))
    return checked.withColumn("answer", answer).select(
        "conv_id",
        "turn",
        F.when(F.col("answer").isNotNull(), V.SUCCESS).otherwise(V.FAILED).alias("status"),
        F.md5("answer").alias("answer"),
        F.md5("c.error_code").alias("error_code"),
    )


@query(
    """
SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'EMPTY_QUESTION_ANSWER' WHEN role = 'user' THEN 'RAW_PAPER_RETURNED_AS_ANSWER' END AS error_code,
       CASE WHEN turn > 0 AND role <> 'user' THEN md5(trim(text, chr(10) || chr(9) || ' ')) END AS answer
FROM conversations"""
)
def q_answer_guard(spark, sf_dir):
    """First turns come back blank, user turns echo the source."""
    sent = F.when(F.col("turn") == 0, F.lit(" \n")).when(
        F.col("role") == "user", F.concat(F.col("text"), F.lit("</Paper>"))
    ).otherwise(F.concat(F.lit("\n"), F.col("text")))
    guarded = text_table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.guarded_answer(sent).alias("g"))
    return guarded.select("conv_id", "turn", "g.error_code", F.md5("g.answer").alias("answer"))


@query(
    """
SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","value":'
       || CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(value AS VARCHAR) END
       || ',"seen":[' || user_id || ',null]}' AS json_str
FROM events"""
)
def q_json_encode(spark, sf_dir):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    data = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"),
        value.alias("value"),
        F.array(F.col("user_id"), F.lit(None)).alias("seen"),
    )
    events = table(spark, sf_dir, "events").select("event_id", data.alias("data"))
    return jsonops.encode_json(events, "data").drop("data")


@query(
    """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       event_type = 'error' AS malformed FROM events"""
)
def q_json_decode(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", F.replace(F.col("props"), F.lit("}"), F.lit(""))).otherwise(F.col("props"))
    decoded = jsonops.decode_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return decoded.select("event_id", F.try_variant_get("value", "$.k", "bigint").alias("k"), "malformed")


@query(
    """
WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
a AS (SELECT sum(n) AS n FROM t)
SELECT path, type, CAST(n AS BIGINT) AS n FROM (
  SELECT '$.k' AS path, 'integer' AS type, n FROM a
  UNION ALL SELECT '$', 'object', n FROM a
  UNION ALL SELECT '$.value', 'number', n FROM t WHERE event_type = 'view'
  UNION ALL SELECT '$.value', 'string', n FROM t WHERE event_type = 'click'
  UNION ALL SELECT '$.value', 'array', n FROM t WHERE event_type = 'purchase'
  UNION ALL SELECT '$.value[]', 'integer', n FROM t WHERE event_type = 'purchase'
  UNION ALL SELECT '$.value[]', 'boolean', n FROM t WHERE event_type = 'purchase'
  UNION ALL SELECT '$.value', 'object', n FROM t WHERE event_type = 'error'
  UNION ALL SELECT '$.value.list', 'array', n FROM t WHERE event_type = 'error'
  UNION ALL SELECT '$.value.list[]', 'string', n FROM t WHERE event_type = 'error'
  UNION ALL SELECT '$.value', 'any', n FROM t WHERE event_type = 'signup')"""
)
def q_json_profile(spark, sf_dir):
    kind = F.col("event_type")
    value = (
        F.when(kind == "view", F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .when(kind == "click", F.lit('"x"'))
        .when(kind == "purchase", F.lit("[1, 2, true]"))
        .when(kind == "error", F.lit('{"list": []}'))
        .otherwise(F.lit("null"))
    )
    text = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "value": '), value, F.lit("}"))
    return jsonops.json_profile(table(spark, sf_dir, "events").select(text.alias("text")), "text")
