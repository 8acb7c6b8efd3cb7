"""Queries over the page table."""
from pyspark.sql import functions as F

from enrichflow.functions.markup import RecordShape
from enrichflow.functions.urls import IdShape, canonical_id, private_endpoint, secure_link, url_pieces
from enrichflow.operators import extract
from enrichflow.operators.selection import waterfall
from enrichflow.queries.registry import query
from enrichflow.queries.tables import listing_pages, table
from enrichflow.sources.scans import scan_pages

LANGUAGE_IDS = IdShape(
    hosts=None,
    heads=("en", "fr", "de", "es"),
    suffixes=tuple((head, ".html") for head in ("en", "fr", "de", "es")),
    pattern=r"[0-9]+",
    max_segments=1,
)
NAVIGATION = extract.Listing(
    shape=RecordShape(tag="li", css_class=None), hosts=None, required_label=None, year_pattern=None
)

LINKS_SQL = """
links AS (
  SELECT page_id, url, CAST(i - 1 AS INTEGER) AS ord, hrefs[i] AS href, trim(texts[i]) AS text
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs,
               regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages) p,
       unnest(range(1, len(hrefs) + 1)) AS u(i)
)"""
RESOLVED_SQL = LINKS_SQL + """,
resolved AS (
  SELECT *, CASE WHEN url LIKE 'https://%'
                 THEN regexp_extract(url, '^(https://[^/?#]+)', 1) || href END AS resolved
  FROM links
)"""
RECORDS_SQL = LINKS_SQL + """,
listed AS (
  SELECT *, url LIKE '%/es/%' AS emptied, url LIKE '%?page=2%' AS unfetched, url NOT LIKE 'https://%' AS refused,
         href NOT LIKE '/t%' AS valid
  FROM links
),
records AS (
  SELECT page_id, page_id AS position, ord, text AS title,
         CASE WHEN valid THEN regexp_extract(url, '^(https://[^/?#]+)', 1) || href END AS detail_url, valid
  FROM listed WHERE NOT emptied AND NOT unfetched AND NOT refused
),
failures AS (
  SELECT page_id, url, CASE WHEN url LIKE '%?page=2%' THEN 'DAY_PAGE_UNAVAILABLE'
                            WHEN url NOT LIKE 'https://%' THEN 'INVALID_CVF_URL'
                            WHEN url LIKE '%/es/%' THEN 'EMPTY_PAPER_LIST' END AS error_code
  FROM pages
)"""


@query("WITH" + LINKS_SQL + " SELECT page_id, ord, href, text FROM links")
def q_page_links(spark, sf_dir):
    pages = scan_pages(spark, f"{sf_dir}/pages.parquet")
    return extract.page_links(pages).select("page_id", "ord", "href", "text")


@query("WITH" + RESOLVED_SQL + " SELECT page_id, ord, resolved FROM resolved")
def q_link_resolve(spark, sf_dir):
    links = extract.page_links(scan_pages(spark, f"{sf_dir}/pages.parquet"))
    return extract.resolve_links(links, hosts=None).select("page_id", "ord", "resolved")


@query(
    "WITH" + RESOLVED_SQL + """
SELECT resolved, page_id, ord, text FROM (
  SELECT *, row_number() OVER (PARTITION BY resolved ORDER BY page_id, ord) AS n
  FROM resolved WHERE resolved IS NOT NULL AND regexp_matches(text, '^[A-Za-z]+$')
) WHERE n = 1"""
)
def q_link_first(spark, sf_dir):
    links = extract.page_links(scan_pages(spark, f"{sf_dir}/pages.parquet"))
    first = extract.first_links(links, hosts=None, text_pattern="^[A-Za-z]+$")
    return first.select("resolved", "page_id", "ord", "text")


@query(
    """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN url NOT LIKE 'https://%' THEN 'not_https' WHEN url LIKE '%#%' THEN 'has_fragment'
              WHEN url LIKE '%?%' THEN 'has_query' ELSE 'ok' END AS reason FROM pages)
GROUP BY reason"""
)
def q_url_gate(spark, sf_dir):
    parts = table(spark, sf_dir, "pages").select(url_pieces(F.col("url")).alias("u"))
    reason = waterfall(
        [
            ("not_https", F.col("u.scheme") != "https"),
            ("has_fragment", F.col("u.fragment") != ""),
            ("has_query", F.col("u.query") != ""),
        ],
        "ok",
    )
    return parts.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    """
SELECT page_id, nullif(regexp_extract(url, '^https://[^/?#]+/(en|fr|de|es)/([0-9]+)(\\.html)?/?$', 2), '') AS canonical,
       nullif(regexp_replace(regexp_extract(url, '^https?(://[^/?#]+/(?:en|fr|de|es)/[0-9]+(?:\\.html)?/?)$', 1),
              '^:', 'https:'), '') AS link
FROM pages"""
)
def q_canonical_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        canonical_id(F.col("url"), LANGUAGE_IDS).alias("canonical"),
        secure_link(F.col("url"), LANGUAGE_IDS).alias("link"),
    )


_FIRST = "list_value('10.', '172.', '192.168.', '127.', '8.', '[fd00::')[CAST(page_id % 6 AS INTEGER) + 1]"


@query(
    f"""
WITH e AS (
  SELECT page_id, page_id % 6 AS kind, {_FIRST} AS first, page_id % 256 AS b, (page_id * 7) % 256 AS c,
         lower(to_hex(page_id % 65536)) AS h
  FROM pages),
u AS (
  SELECT page_id, kind, b,
         CASE kind WHEN 5 THEN '[fd00::' || CASE WHEN h = '0' THEN '' ELSE h END || ']'
                   WHEN 2 THEN first || b || '.' || c ELSE first || b || '.' || c || '.1' END AS host,
         CASE kind WHEN 0 THEN 'private_10' WHEN 1 THEN CASE WHEN b BETWEEN 16 AND 31 THEN 'private_172' END
                   WHEN 2 THEN 'private_192' WHEN 3 THEN 'loopback' WHEN 5 THEN 'private_v6' END AS class
  FROM e)
SELECT page_id, CASE WHEN class IS NOT NULL THEN 'http://' || host || ':8000' END AS endpoint, class FROM u"""
)
def q_private_endpoint(spark, sf_dir):
    page = F.col("page_id")
    b, c = (page % 256).cast("string"), ((page * 7) % 256).cast("string")
    tail = F.concat(b, F.lit("."), c)
    host = (
        F.when(page % 6 == 0, F.concat(F.lit("10."), tail, F.lit(".1")))
        .when(page % 6 == 1, F.concat(F.lit("172."), tail, F.lit(".1")))
        .when(page % 6 == 2, F.concat(F.lit("192.168."), tail))
        .when(page % 6 == 3, F.concat(F.lit("127."), tail, F.lit(".1")))
        .when(page % 6 == 4, F.concat(F.lit("8."), tail, F.lit(".1")))
        .otherwise(F.concat(F.lit("[FD00::"), F.hex(page % 65536), F.lit("]")))
    )
    named = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("http://"), host, F.lit(":8000/")).alias("url")
    )
    found = named.select("page_id", private_endpoint(F.col("url")).alias("e"))
    return found.select("page_id", "e.endpoint", "e.class")


@query("WITH" + RECORDS_SQL + " SELECT page_id, ord, title, detail_url, valid FROM records")
def q_records(spark, sf_dir):
    parsed = extract.parse_listings(listing_pages(spark, sf_dir), NAVIGATION)
    return extract.listed_records(parsed, NAVIGATION).select("page_id", "ord", "title", "detail_url", "valid")


@query(
    "WITH" + RECORDS_SQL + " SELECT page_id, ord, title, detail_url, 'INVALID_PAPER_RECORD' AS error_code"
    " FROM records WHERE NOT valid"
)
def q_quarantine(spark, sf_dir):
    parsed = extract.parse_listings(listing_pages(spark, sf_dir), NAVIGATION)
    return extract.quarantined(extract.listed_records(parsed, NAVIGATION)).drop("position")


@query("WITH" + RECORDS_SQL + " SELECT page_id, url, error_code FROM failures WHERE error_code IS NOT NULL")
def q_empty_pages(spark, sf_dir):
    parsed = extract.parse_listings(listing_pages(spark, sf_dir), NAVIGATION)
    return extract.page_failures(parsed).drop("position")


@query(
    "WITH" + RECORDS_SQL + """
SELECT detail_url, page_id, ord, title, CAST(copies AS BIGINT) AS copies FROM (
  SELECT *, row_number() OVER (PARTITION BY detail_url ORDER BY position, ord) AS n,
         count(*) OVER (PARTITION BY detail_url) AS copies
  FROM records WHERE valid) WHERE n = 1"""
)
def q_unique_records(spark, sf_dir):
    parsed = extract.parse_listings(listing_pages(spark, sf_dir), NAVIGATION)
    unique = extract.unique_records(extract.listed_records(parsed, NAVIGATION))
    return unique.select("detail_url", "page_id", "ord", "title", "copies")


@query(
    "WITH" + RECORDS_SQL + """,
c AS (SELECT (SELECT count(*) FROM records) AS raw_count,
             (SELECT count(DISTINCT detail_url) FROM records WHERE valid) AS unique_count,
             (SELECT count(*) FROM records WHERE valid) AS usable,
             (SELECT count(*) FROM failures WHERE error_code IS NOT NULL) AS failed_page_count,
             (SELECT count(*) FROM records WHERE NOT valid) AS rejected_count)
SELECT raw_count, unique_count, usable - unique_count AS duplicate_count, failed_page_count, rejected_count,
       CASE WHEN failed_page_count > 0 OR rejected_count > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status
FROM c"""
)
def q_discovery_counts(spark, sf_dir):
    parsed = extract.parse_listings(listing_pages(spark, sf_dir), NAVIGATION)
    return extract.discovery_counts(parsed, extract.listed_records(parsed, NAVIGATION))
