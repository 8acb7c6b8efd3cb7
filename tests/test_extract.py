import pytest
from pyspark.sql import functions as F

from enrichflow.functions import markup
from enrichflow.operators import extract
from enrichflow.plans import flow
from enrichflow.schemas import PAGE

HOST = "https://openaccess.thecvf.com"


def record(title="A  new\n method", detail="/content/a.html", extra="", authors=("Ann B", "Cy D", "Ann B"), pdf="/papers/a.pdf"):
    inputs = "".join(f'<form class="authsearch"><input type="hidden" name="query_author" value="{a}"></form>' for a in authors)
    head = f'<a href="{detail}">{title}</a>' if detail else title
    link = f'[<a href="{pdf}">PDF</a>]' if pdf else ""
    return f'<dt class="ptitle"><br>{head}</dt><dd>{inputs}</dd><dd>{link}{extra}<div class="bib">x</div></dd>'


ARXIV = '[<a href="http://arxiv.org/abs/2503.00001v2">arXiv</a>]'
DAY = [f"{HOST}/CVPR2025?day=2025-06-1{i}" for i in (3, 4, 5)]

TRICKY = [
    '<a href="/1">one</a> <a href="/2"><b>t</b>wo</a><a href="/3">never closed <a href="/4">four</a>',
    "<a>no href</a><a href>empty</a><a href=''>blank</a><A HREF=/5 >five</A >",
    '<!-- <a href="/hidden">x</a> --><script>var s = \'<a href="/js">x</a>\';</script><a href="/6">six</a>',
    '<a href="/7?a=1&amp;b=2">A &amp; B &lt;c&gt;</a><a href="/8">caf&eacute; &#233;</a>',
    '<a title="a > b" href="/9">nine</a><a class=x data-href="/no" href="/10">ten</a>',
    "<a href=/11/a=b>odd</a><a href=\"/12\" href='/13'>twice</a>",
    '<a href="/14">x<!-- c -->y<br>z</a><abbr><a href="/15">\xa0pad </a></abbr>',
    "plain text, a < b and no tags",
    "<!-- open comment <a href='/16'>x</a>",
    '<textarea><a href="/17">x</a></textarea><a href="/18">y</a>',
]
LISTINGS = [
    record() + record("Second &amp; last", "/content/b.html", ARXIV, ("Eve",)),
    record(detail=None) + record(pdf=None),
    '<dt class="other">no</dt><dt class="x ptitle y"><a href="/p">T<i>i</i>tle</a></dt><a href="/p.pdf">pdf</a>',
    '<dt class=ptitle>No end <a href="/q">here</a>' + record(),
    "<html><body></body></html>",
    record("caf&eacute;", authors=("J&ouml;rg",)),
]


def frame(spark, pages):
    rows = [(i, i, url, html, code) for i, (url, html, code) in enumerate(pages)]
    return spark.createDataFrame(rows, PAGE)


def test_links_agree_with_the_standard_parser(spark):
    pages = spark.createDataFrame(list(enumerate(TRICKY)), "id int, html string")
    auto = {r.id: r.links for r in markup.with_links(pages).collect()}
    slow = {r.id: r.links for r in markup.with_links(pages, parser="stdlib").collect()}
    assert auto == slow
    assert [tuple(x) for x in auto[0]] == [("/1", "one"), ("/2", "t wo"), ("/4", "four")]
    assert [tuple(x) for x in auto[3]] == [("/7?a=1&b=2", "A & B <c>"), ("/8", "café é")]


def test_records_agree_with_the_standard_parser(spark):
    pages = spark.createDataFrame(list(enumerate(LISTINGS)), "id int, html string")
    auto = {r.id: r.records for r in markup.with_records(pages).collect()}
    slow = {r.id: r.records for r in markup.with_records(pages, parser="stdlib").collect()}
    assert auto == slow
    assert [r.title for r in auto[0]] == ["A  new\n method", "Second & last"]
    assert auto[0][0].authors == ["Ann B", "Cy D", "Ann B"]


def test_day_links(spark):
    index = "".join(f'<a href="/CVPR2025?day=2025-06-1{i}">Day {i - 2}: 2025-06-1{i}</a>' for i in (3, 4, 5, 3))
    index += '<a href="/all">All papers</a>'
    found = extract.day_pages(frame(spark, [(f"{HOST}/CVPR2025", index, None)]))
    assert [r.resolved for r in found.orderBy("ord").collect()] == DAY
    bad = index.replace("/CVPR2025?day=2025-06-14", "https://openaccess.thecvf.com.evil.example/x")
    with pytest.raises(ValueError, match="^INVALID_CVF_URL$"):
        extract.day_pages(frame(spark, [(f"{HOST}/CVPR2025", bad, None)]))
    with pytest.raises(ValueError, match="^NO_CONFERENCE_DAYS$"):
        extract.day_pages(frame(spark, [(f"{HOST}/CVPR2025", "<p>nothing</p>", None)]))


def test_fields_of_a_record(spark):
    found = flow.discover(frame(spark, [(DAY[0], LISTINGS[0], None)]))
    first, second = found.unique.orderBy("ord").collect()
    assert first.title == "A new method"
    assert first.authors == ["Ann B", "Cy D"]
    assert first.detail_url == f"{HOST}/content/a.html"
    assert first.pdf_url == f"{HOST}/papers/a.pdf"
    assert first.arxiv_url is None and first.year == 2025 and first.conference_day == "Day 1"
    assert second.arxiv_url == "https://arxiv.org/abs/2503.00001v2"


def test_discovery_of_several_pages(spark, tmp_path):
    pages = [
        (DAY[0], LISTINGS[0], None),
        (DAY[1], record("Copy", "/content/a.html") + record("New", "/content/c.html") + record(detail=None), None),
        (DAY[2], None, "DAY_PAGE_UNAVAILABLE"),
        (f"{HOST}/CVPR2025?day=2025-06-16", LISTINGS[4], None),
        (f"{HOST}/CVPR2019?day=1", LISTINGS[0], None),
        ("https://evil.example/CVPR2025", LISTINGS[0], None),
    ]
    shuffled = frame(spark, pages).orderBy(F.rand(3)).repartition(5)
    found = flow.discover(shuffled, store=str(tmp_path / "parsed"))
    assert {r.title for r in found.unique.collect()} == {"A new method", "Second & last", "New"}
    assert [(r.title, r.detail_url, r.error_code) for r in found.rejected.collect()] == [
        ("A new method", None, "INVALID_PAPER_RECORD")
    ]
    assert [r.error_code for r in found.failures.orderBy("position").collect()] == [
        "DAY_PAGE_UNAVAILABLE", "EMPTY_PAPER_LIST", "UNSUPPORTED_CONFERENCE_YEAR", "INVALID_CVF_URL",
    ]
    counts = found.counts.first().asDict()
    assert counts == {
        "raw_count": 5, "unique_count": 3, "duplicate_count": 1, "failed_page_count": 4, "rejected_count": 1,
        "status": "PARTIAL",
    }


def test_blank_author_is_quarantined_and_the_page_kept(spark):
    pages = frame(spark, [(DAY[0], record(authors=("Ann", " ")) + record(detail="/content/z.html"), None)])
    found = flow.discover(pages)
    assert found.unique.count() == 1 and found.rejected.count() == 1


def test_clean_discovery_is_completed(spark):
    row = flow.discover(frame(spark, [(DAY[0], LISTINGS[0], None)])).counts.first()
    assert (row.status, row.raw_count, row.unique_count) == ("COMPLETED", 2, 2)
    empty = flow.discover(frame(spark, [])).counts.first()
    assert (empty.raw_count, empty.failed_page_count, empty.status) == (0, 0, "COMPLETED")


@pytest.mark.parametrize("piece", ["<br>", "<!-- open ", "<script>x", "<script ", "<title", "<dt class='ptitle' ", "<a href=x>", "</a>", "<form class='authsearch'>", '<a x="<'])
def test_pages_of_one_piece_are_parsed_in_one_pass(spark, piece):
    start = '<dt class="ptitle"><a href="/one">first'
    page = start + piece * 100_000 + " last</a></dt>"
    pages = spark.createDataFrame([(page,)], "html string")
    for parse, column in ((markup.with_links, "links"), (markup.with_records, "records")):
        got, plain = (parse(pages, parser=p).select(column).first()[0] for p in ("auto", "stdlib"))
        assert got == plain


def test_listing_rejects_parse_a_page_once(spark):
    from enrichflow.queries import CATALOG
    from tests.conftest import plan_of

    plan = plan_of(CATALOG["q_listing_rejects"].run(spark, "/root/testdata/sf0.001"))
    assert "ArrowEvalPython" not in plan and "documents.parquet" not in plan


def test_an_open_title_keeps_its_last_line_end(spark):
    pages = spark.createDataFrame([('<dt class="ptitle"><a href="/a">x</a> y\n',), ('<dt class="ptitle">z</DT ><a href="/b">b < c</A >\n',)], "html string")
    got, plain = (markup.with_records(pages, parser=p).collect() for p in ("regex", "stdlib"))
    assert got == plain and got[0].records[0].title == "x y\n"


def test_whole_pages_are_not_translated_by_character(spark):
    from enrichflow.queries import CATALOG
    from tests.conftest import plan_of

    assert "translate(_marked" not in plan_of(CATALOG["q_listing"].run(spark, "/root/testdata/sf0.001")).replace("#", "").lower()
