"""URL parts, rules and the classifier."""
import re

import duckdb
import pytest

from enrichflow.llm import url_filter as op
from enrichflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.1"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parts(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(url):
    host, path = parts(url)
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in QUERIES["op9_url_filter"].run(spark, SF).collect()}
    assert len(got) == len(rows)
    for page, url in rows:
        host, path, rule, verdict = ruled(url)
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert {r.verdict for r in got.values() if r.rule is None} <= {"allow", "block"}


@pytest.mark.parametrize("url", [None, "", "no scheme.com/x", "://", "http://WWW.Example.COM/en/a?b#c", "https://notexample.com/en/", "a://b://net/es/", "x://é.NET/fr/",
                                 "http://example.com", "http://example.com?/en/", "http://sub.example.com/en/" + "p" * 100_000, "http://example.com/EN/", "http://net/fr/\n"])
def test_parts_and_rules(spark, url):
    pages = spark.createDataFrame([(1, url, "z")], "page_id bigint, url string, verdict string")
    got = op.judged(pages, [op.Rule(*r) for r in RULES]).first()
    host, path, rule, verdict = ruled(url)
    assert (got.host, got.path, got.rule) == (host, path, rule) and got.verdict == (verdict or got.verdict)


def test_classifier_generalises(spark):
    bad = [(f"http://cheap-pills{i}.shop/buy/{i}", 1) for i in range(40)]
    good = [(f"http://news{i}.org/story/{i}", 0) for i in range(40)]
    model = op.fit(spark.createDataFrame(bad[:30] + good[:30] + [(None, 1), ("x://y", None)], "url string, label int"))
    score = model.scores([op._text(*parts(u)) for u, _ in bad[30:] + good[30:]])
    assert (score[:10] > 0.5).all() and (score[10:] < 0.5).all()


def test_odd_tables(spark):
    pages = spark.createDataFrame([(None, "a://b.org/"), (1, "a://b.org/"), (1, "a://b.org/")], "page_id bigint, url string")
    rules = [op.Rule("block", "z", "/")]
    assert [r.verdict for r in op.judged(pages, rules).collect()] == ["allow"] * 3
    labelled = spark.createDataFrame([("a://b.org/", 1)], "url string, label int")
    assert [r.verdict for r in op.judged(pages, rules, labelled).collect()] == ["block"] * 3
    assert op.judged(pages.limit(0), rules).count() == 0
    tied = [op.Rule("allow", "org", "/bb/"), op.Rule("block", "b.org", "/b"), op.Rule("allow", "b.org", "/b")]
    one = spark.createDataFrame([(1, "a://b.org/bb/")], "page_id bigint, url string")
    assert op.judged(one, tied).first().rule == "b.org/b" and op.judged(one, tied).first().verdict == "block"
