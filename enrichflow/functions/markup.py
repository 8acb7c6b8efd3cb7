"""Links and listing records out of raw HTML.

Regular markup is taken apart with JVM regexes inside the page scan. A page goes to the stdlib
parser (one Arrow batch of such pages at a time) only when its markup is irregular or when an
extracted field holds an entity outside the common ones; all other pages send NULL to Python.
"""
import html as html_lib
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import bind, strip
from enrichflow.schemas import LINKS, RAW_RECORDS, TEXT

_ATTRS = (
    r"(?:\s++[^\s\"'<>=/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>=`]++))?+)*+\s*+/?+"
)
# Runs are possessive: a run of many tags is then a loop, where a group that may give back recurses once per tag.
_TAGS = r"(?:<[A-Za-z/!?](?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>)++"
# Stands behind the page while hidden blocks are cut: a block that is never closed ends there, so each is scanned once.
_END = "\u0001"
_HIDDEN = rf"(?s)<!--.*?(?:-->|{_END})|<((?i:script|style))\b[^>{_END}]*+(?:{_END}|>.*?(?:</(?i:\1)\s*+>|{_END}))"
_ODD_BLOCKS = r"<(?i:!--|!\[CDATA\[|(?:script|style|textarea|xmp|plaintext|iframe|noembed|noframes)\b|title[^<>]*+(?:<|>[^<]*+<(?!/title)))"
_OPEN_TAG = r"<[A-Za-z/!?][^<>]*+<"  # a tag that meets the next one before it ends
_ANCHOR_START = r"(?=<[aA][\s/>])"
_ODD_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos|nbsp|ndash|mdash|hellip|laquo|raquo|copy|#39|#34|#x27|#160);)#?[A-Za-z0-9]"
_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&#160;", "\xa0"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&copy;", "©"), ("&amp;", "&"),
)


@dataclass(frozen=True)
class RecordShape:
    """Which markup opens a record and where its authors sit. ``css_class=None`` takes any tag."""

    tag: str = V.RECORD_TAG
    css_class: str | None = V.RECORD_CLASS
    form_class: str = V.AUTHOR_FORM_CLASS
    author_field: str = V.AUTHOR_FIELD


LISTING = RecordShape()


def decode_entities(text: Column) -> Column:
    decoded = text
    for entity, char in _ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(text.contains("&"), decoded).otherwise(text)


def has_odd_entity(text: Column) -> Column:
    return text.rlike(_ODD_ENTITY)


@F.pandas_udf(TEXT)
def _unescape_rest(texts: pd.Series) -> pd.Series:
    return texts.map(html_lib.unescape, na_action="ignore").astype(object)


def unescape(text: Column) -> Column:
    """Full entity decoding; only rows with an uncommon entity visit Python."""
    odd = has_odd_entity(text)
    return F.coalesce(_unescape_rest(F.when(odd, text)), decode_entities(text))


def _visible(html: Column) -> Column:
    """The page without hidden blocks. The end mark is left unless a block is open or the page holds one itself."""
    marked = F.concat(html, F.lit(_END))
    cut = F.when(html.rlike("<(?:!--|[sS])"), F.regexp_replace(marked, _HIDDEN, "<!>")).otherwise(marked)
    return F.when(html.contains(_END), "").otherwise(cut)


def _odd_blocks(marked: Column) -> Column:
    """Open or left-over comments, raw-text elements and tags: markup the regexes do not follow."""
    return ~marked.endswith(_END) | marked.rlike(_ODD_BLOCKS) | marked.rlike(_OPEN_TAG)


def _with_seen(pages, html: str, parser: str):
    """Adds ``_seen``, what the regexes read. With ``parser='auto'`` that is nothing of an odd page, which is parsed anyway."""
    marked = pages.withColumn("_marked", _visible(F.col(html)))
    marked = marked.withColumn("_block", _odd_blocks(F.col("_marked")))
    seen = F.replace("_marked", F.lit(_END), F.lit(""))
    return marked.withColumn("_seen", F.when(F.col("_block"), "").otherwise(seen) if parser == "auto" else seen)


def _odd_tags(html: Column, tags: str) -> Column:
    """Some of these tags is quoted in a way the attribute pattern does not cover."""
    seen = F.regexp_count(html, F.lit(rf"<(?i:{tags})(?=[\s/>])"))
    return seen != F.regexp_count(html, F.lit(rf"<(?i:{tags}){_ATTRS}>"))


def _attribute(attrs: Column, name: str) -> Column:
    """Raw value of one attribute, NULL when it is absent or has no value."""
    pattern = rf"(?i)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+)"

    def bare(value: Column) -> Column:
        quoted = value.startswith('"') | value.startswith("'")
        inner = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.when(value != "", inner)

    return bind(bare, value=F.regexp_extract(attrs, pattern, 1))


def _anchors(html: Column, glue: str) -> Column:
    """Raw (href, text, odd) per anchor start; href is NULL for an anchor that is no link.

    ``glue`` stands where tags split the text; ``odd`` marks an anchor to leave to the parser.
    """
    starts = F.filter(F.split(html, _ANCHOR_START), lambda c: c.rlike(r"^<[aA][\s/>]"))

    def fields(closed: Column, sound: Column) -> Column:
        attrs = F.regexp_extract(closed, rf"^<[aA]({_ATTRS})>", 1)
        return bind(
            lambda a, body: F.struct(
                F.when(closed != "", _attribute(a, "href")).alias("href"),
                F.when(body.contains("<"), F.regexp_replace(body, _TAGS, glue)).otherwise(body).alias("text"),
                (~sound | a.rlike(r"(?i)\shref\b.*\shref\b")).alias("odd"),
            ),
            a=attrs,
            body=F.regexp_extract(closed, rf"(?s)^<[aA]{_ATTRS}>(.*)</[aA]\s*>$", 1),
        )

    return F.transform(
        starts,
        lambda c: bind(
            fields,
            closed=F.regexp_extract(c, rf"^<[aA]{_ATTRS}>{_upto('[aA]')}</[aA]\s*>", 0),
            sound=c.rlike(rf"^<[aA]{_ATTRS}>"),
        ),
    )


def _tidy(anchors: Column) -> Column:
    return F.transform(
        F.filter(anchors, lambda x: x["href"].isNotNull()),
        lambda x: F.struct(
            decode_entities(x["href"]).alias("href"), strip(decode_entities(x["text"])).alias("text")
        ),
    )


def _odd_anchors(anchors: Column) -> Column:
    return F.exists(
        anchors,
        lambda x: x["odd"]
        | F.coalesce(has_odd_entity(x["href"]) | has_odd_entity(x["text"]), F.lit(False)),
    )


def _upto(tag: str) -> str:
    """Everything before the end tag, or all; whole runs of text are taken at once, not character by character."""
    return rf"[^<]*+(?:<(?!/{tag}\s*>)[^<]*+)*+"


def _class_pattern(css_class: str) -> str:
    return (
        rf"\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{css_class}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{css_class}(?:\s[^']*)?'"
        rf"|{css_class}(?=[\s/>]))"
    )


def _raw_records(html: Column, shape: RecordShape) -> Column:
    opener = rf"<(?i:{shape.tag})(?=[\s/>])"
    if shape.css_class is not None:
        opener += rf"(?=[^<>]*{_class_pattern(shape.css_class)})"
    segments = F.filter(F.split(html, f"(?={opener})"), lambda s: s.rlike(f"^{opener}"))
    form = rf"(?s)<(?i:form)(?=[^<>]*{_class_pattern(shape.form_class)})[^<>]*+>.*?(?=</(?i:form)|<(?i:form)[\s/>]|$)"

    def authors(segment: Column) -> Column:
        inputs = F.flatten(
            F.transform(
                F.regexp_extract_all(segment, F.lit(form), F.lit(0)),
                lambda f: F.regexp_extract_all(f, F.lit(rf"(?i)<input({_ATTRS})>"), F.lit(1)),
            )
        )
        named = F.filter(inputs, lambda a: F.coalesce(_attribute(a, "name") == shape.author_field, F.lit(False)))
        return F.filter(F.transform(named, lambda a: _attribute(a, "value")), lambda v: F.length(v) > 0)

    def record(segment: Column) -> Column:
        return bind(
            lambda head: F.struct(
                F.regexp_replace(head, _TAGS, "").alias("title"),
                _attribute(F.regexp_extract(head, rf"(?is)^.*<a({_ATTRS})>", 1), "href").alias("detail_href"),
                F.when(segment.contains(shape.form_class), authors(segment))
                .otherwise(F.array().cast("array<string>"))
                .alias("authors"),
                _anchors(segment, "").alias("links"),
            ),
            head=F.regexp_extract(segment, rf"^<[^>]*>({_upto(f'(?i:{shape.tag})')})", 1),
        )

    return F.transform(segments, record)


def _records_odd(records: Column) -> Column:
    return F.exists(
        records,
        lambda r: has_odd_entity(r["title"])
        | F.coalesce(has_odd_entity(r["detail_href"]), F.lit(False))
        | F.exists(r["authors"], has_odd_entity)
        | _odd_anchors(r["links"]),
    )


def _tidy_records(records: Column) -> Column:
    return F.transform(
        records,
        lambda r: F.struct(
            decode_entities(r["title"]).alias("title"),
            decode_entities(r["detail_href"]).alias("detail_href"),
            F.transform(r["authors"], decode_entities).alias("authors"),
            _tidy(r["links"]).alias("links"),
        ),
    )


@dataclass
class _Tokens(HTMLParser):
    """Flattens a page to (kind, name-or-text, attributes) tokens."""

    found: list = field(default_factory=list)

    def __post_init__(self):
        super().__init__()

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.found.append(("close", tag, None))

    def handle_data(self, data):
        self.found.append(("text", data, None))


def _tokens(page: str) -> list:
    reader = _Tokens()
    reader.feed(page)
    return reader.found


def _token_links(tokens: list, glue: str) -> list[dict]:
    links, start = [], None
    for at, (kind, name, attrs) in enumerate(tokens):
        if name == "a" and kind == "open":
            start = at if attrs.get("href") is not None else None
        elif name == "a" and kind == "close" and start is not None:
            words = [t for k, t, _ in tokens[start:at] if k == "text"]
            links.append({"href": tokens[start][2]["href"], "text": glue.join(words).strip()})
            start = None
    return links


def _token_records(tokens: list, shape: RecordShape) -> list[dict]:
    def classes(attrs: dict) -> list[str]:
        return (attrs.get("class") or "").split()

    opens = [
        at
        for at, (kind, name, attrs) in enumerate(tokens)
        if kind == "open" and name == shape.tag and (shape.css_class is None or shape.css_class in classes(attrs))
    ]
    records = []
    for first, after in zip(opens, opens[1:] + [len(tokens)]):
        part = tokens[first:after]
        stop = next((i for i, t in enumerate(part) if t[:2] == ("close", shape.tag)), len(part))
        hrefs = [t[2].get("href") for t in part[:stop] if t[:2] == ("open", "a")]
        authors, in_form = [], False
        for kind, name, attrs in part:
            if name == "form" and kind != "text":
                in_form = kind == "open" and shape.form_class in classes(attrs)
            elif in_form and (kind, name) == ("open", "input") and attrs.get("name") == shape.author_field:
                authors += [attrs["value"]] if attrs.get("value") else []
        records.append(
            {
                "title": "".join(t[1] for t in part[:stop] if t[0] == "text"),
                "detail_href": hrefs[-1] if hrefs else None,
                "authors": authors,
                "links": _token_links(part, ""),
            }
        )
    return records


def _parser(kind, read):
    """Page parser as a column function.

    It is declared non-deterministic so that Catalyst evaluates it once: a deterministic one is copied
    into every expression above it, such as the size filter inferred for an explode.
    """

    @F.pandas_udf(kind)
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: read(_tokens(page)), na_action="ignore").astype(object)

    return parse.asNondeterministic()


def with_links(pages, html: str = "html", into: str = "links", parser: str = "auto"):
    """Replace the html column by an array of (href, text) in page order.

    ``parser='auto'`` mixes both ways page by page; ``'regex'`` and ``'stdlib'`` force one.
    """
    parsed = _parser(LINKS, lambda tokens: _token_links(tokens, " "))
    if parser == "stdlib":
        return pages.withColumn(into, parsed(html)).drop(html)
    raw = _with_seen(pages, html, parser).withColumn("_raw", _anchors(F.col("_seen"), " "))
    if parser == "auto":
        odd = F.col("_block") | _odd_anchors(F.col("_raw"))
        raw = raw.withColumn("_odd", F.when(odd, F.col(html)))
        links = F.coalesce(parsed("_odd"), _tidy(F.col("_raw")))
    else:
        links = _tidy(F.col("_raw"))
    return raw.withColumn(into, links).drop(html, "_marked", "_block", "_seen", "_raw", "_odd")


def with_records(pages, shape: RecordShape = LISTING, html: str = "html", into: str = "records", parser: str = "auto"):
    """Replace the html column by the array of raw records it lists."""
    parsed = _parser(RAW_RECORDS, lambda tokens: _token_records(tokens, shape))
    if parser == "stdlib":
        return pages.withColumn(into, parsed(html)).drop(html)
    raw = _with_seen(pages, html, parser).withColumn("_raw", _raw_records(F.col("_seen"), shape))
    if parser == "auto":
        odd = (
            F.col("_block")
            | _odd_tags(F.col("_seen"), f"form|input|{shape.tag}")
            | _records_odd(F.col("_raw"))
        )
        raw = raw.withColumn("_odd", F.when(odd, F.col(html)))
        records = F.coalesce(parsed("_odd"), _tidy_records(F.col("_raw")))
    else:
        records = _tidy_records(F.col("_raw"))
    return raw.withColumn(into, records).drop(html, "_marked", "_block", "_seen", "_raw", "_odd")
