"""Page table to links, listing records, failures and discovery counters."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from enrichflow import fixed_values as V
from enrichflow.functions import markup
from enrichflow.functions.strings import is_blank, once, squeeze, strip
from enrichflow.functions.urls import (
    ARCHIVE,
    IdShape,
    collection_year,
    is_secure,
    resolve_secure,
    secure_link,
)
from enrichflow.operators.keyed import first_per_key


def page_links(pages: DataFrame, parser: str = "auto") -> DataFrame:
    """Every closed anchor with an href: (page_id, position, url, ord, href, text) in page order."""
    found = markup.with_links(pages.select("page_id", "position", "url", "html"), parser=parser)
    return found.select("page_id", "position", "url", F.posexplode("links").alias("ord", "link")).select(
        "page_id", "position", "url", "ord", "link.href", "link.text"
    )


def resolve_links(links: DataFrame, hosts: tuple[str, ...] | None = V.CATALOGUE_HOSTS) -> DataFrame:
    """Adds the gated absolute URL of each link, NULL when the page or the link is refused."""
    return links.withColumn("resolved", once(resolve_secure(F.col("url"), F.col("href"), hosts)))


def first_links(
    links: DataFrame,
    hosts: tuple[str, ...] | None = V.CATALOGUE_HOSTS,
    text_pattern: str | None = V.DAY_LINK_PATTERN,
) -> DataFrame:
    """Links whose text has the wanted form, one row per resolved URL, first in page order."""
    wanted = links if text_pattern is None else links.filter(F.col("text").rlike(text_pattern))
    resolved = resolve_links(wanted, hosts).filter(F.col("resolved").isNotNull())
    slim = resolved.select("resolved", "position", "ord", "page_id", "text")
    return first_per_key(slim, ["resolved"], ["position", "ord"])


def day_pages(index: DataFrame, hosts: tuple[str, ...] | None = V.CATALOGUE_HOSTS, strict: bool = True) -> DataFrame:
    """Day-page URLs of index pages. Strict mode raises when a day link is refused or none is left."""
    links = page_links(index)
    if strict:
        day = resolve_links(links.filter(F.col("text").rlike(V.DAY_LINK_PATTERN)), hosts)
        seen, refused = day.agg(F.count("*"), F.count_if(F.col("resolved").isNull())).first()
        if refused:
            raise ValueError(V.INVALID_CATALOGUE_URL)
        if not seen:
            raise ValueError(V.NO_DAY_LINKS)
    return first_links(links, hosts)


@dataclass(frozen=True)
class Listing:
    """How a listing page is read: markup, trusted hosts, identifier links and required labels."""

    shape: markup.RecordShape = markup.LISTING
    hosts: tuple[str, ...] | None = V.CATALOGUE_HOSTS
    ids: IdShape = ARCHIVE
    required_label: str | None = V.REQUIRED_LINK_LABEL
    optional_label: str = V.OPTIONAL_LINK_LABEL
    year_pattern: str | None = V.COLLECTION_YEAR_PATTERN


CATALOGUE = Listing()


def parse_listings(pages: DataFrame, listing: Listing = CATALOGUE, parser: str = "auto") -> DataFrame:
    """One row per page: raw records, year, and the page's failure code if any.

    A page fails when it was not fetched, its URL is refused, it lists no record, or its URL names
    no supported year. No shuffle and no anti join: the page's own row decides.
    """
    base = pages.select("page_id", "position", "url", "html", "error_code")
    found = markup.with_records(base, listing.shape, into="records", parser=parser)
    year = collection_year(F.col("url"), listing.year_pattern) if listing.year_pattern else F.lit(0)
    failure = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(~is_secure(F.col("url"), listing.hosts), F.lit(V.INVALID_CATALOGUE_URL))
        .when(F.coalesce(F.size("records") < 1, F.lit(True)), F.lit(V.EMPTY_RECORD_LIST))
        .when(year.isNull(), F.lit(V.UNSUPPORTED_YEAR))
    )
    return found.select(
        "page_id", "position", "url", year.cast("int").alias("year"), "records", once(failure).alias("failure")
    )


def listed_records(parsed: DataFrame, listing: Listing = CATALOGUE, conference: str = "CVPR") -> DataFrame:
    """Normalised records of readable pages with their order and whether they are ``valid``.

    A record needs a title, no blank author, a detail link and the required link that pass the gate.
    Of links with one label the last counts, authors keep their first order.
    """
    rows = parsed.filter(F.col("failure").isNull()).select(
        "page_id", "position", "url", "year", F.posexplode("records").alias("ord", "r")
    )
    linked = rows.select(
        "page_id",
        "position",
        "ord",
        F.lit(conference).alias("conference"),
        "year",
        squeeze(F.col("r.title")).alias("title"),
        F.transform(F.array_distinct("r.authors"), strip).alias("authors"),
        resolve_secure(F.col("url"), F.col("r.detail_href"), listing.hosts).alias("detail_url"),
        (
            F.lit(None).cast("string")
            if listing.required_label is None
            else resolve_secure(F.col("url"), _label_href(F.col("r.links"), listing.required_label), listing.hosts)
        ).alias("pdf_url"),
        secure_link(_label_href(F.col("r.links"), listing.optional_label), listing.ids).alias("arxiv_url"),
        F.concat(F.lit("Day "), (F.col("position") + 1).cast("string")).alias("conference_day"),
    )
    usable = (F.col("title") != "") & F.col("detail_url").isNotNull() & ~F.exists("authors", lambda a: a == "")
    if listing.required_label is not None:
        usable = usable & F.col("pdf_url").isNotNull()
    return linked.withColumn("valid", once(usable))


def _label_href(links: Column, label: str) -> Column:
    """Href of the last link with this label, compared without case."""
    named = F.filter(links, lambda x: F.lower(x["text"]) == label)
    return F.try_element_at(named, F.lit(-1))["href"]


def quarantined(records: DataFrame) -> DataFrame:
    """Records that could not be used, with what is known about them."""
    return records.filter(~F.col("valid")).select(
        "page_id",
        "position",
        "ord",
        F.when(~is_blank(F.col("title")), F.col("title")).alias("title"),
        "detail_url",
        F.lit(V.INVALID_RECORD).alias("error_code"),
    )


def unique_records(records: DataFrame, copies: str = "copies") -> DataFrame:
    """Usable records, first per detail URL in page order, with the number of copies seen."""
    return first_per_key(
        records.filter("valid").drop("valid"), ["detail_url"], ["position", "ord"], copies=copies
    )


def page_failures(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("failure").isNotNull()).select(
        "page_id", "position", "url", F.col("failure").alias("error_code")
    )


def discovery_counts(parsed: DataFrame, records: DataFrame) -> DataFrame:
    """One row: raw, unique, duplicate, failed pages, rejected records and the resulting status.

    Records collapse to (detail URL, copies) before their shuffle; both sides then meet as sums.
    """
    zero = F.lit(0).cast("bigint")
    names = ("raw_count", "unique_count", "duplicate_count", "failed_page_count", "rejected_count")

    def tally(df: DataFrame, **given: Column) -> DataFrame:
        return df.agg(*(F.coalesce(F.sum(given.get(n, zero)), zero).cast("bigint").alias(n) for n in names))

    copies = records.groupBy(F.when(F.col("valid"), F.col("detail_url")).alias("detail_url")).agg(
        F.count("*").alias("n")
    )
    good = F.col("detail_url").isNotNull()
    per_record = tally(
        copies,
        raw_count=F.col("n"),
        unique_count=good.cast("bigint"),
        duplicate_count=F.when(good, F.col("n") - 1),
        rejected_count=F.when(~good, F.col("n")),
    )
    per_page = tally(parsed, failed_page_count=F.col("failure").isNotNull().cast("bigint"))
    totals = per_page.unionByName(per_record).agg(*(F.sum(n).alias(n) for n in names))
    partial = (F.col("failed_page_count") > 0) | (F.col("rejected_count") > 0)
    return totals.withColumn("status", F.when(partial, V.RUN_PARTIAL).otherwise(V.RUN_COMPLETED))
