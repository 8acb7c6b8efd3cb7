from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from enrichflow.functions import urls
from tests.conftest import plan_of

BASE = "https://site.example/a/b?x=1#f"
HREFS = [
    "", "c", "./c", "../c", "../../c", "../../../c", "/d/../e", "//other.example/z", "?q=2", "#g", "a//b", " /sp",
    "https://site.example/a/../b", "https:x", "c/", "..", ".", "/x?", "/d//e", "c;p?", "https://SITE.example:443/Z",
    "é ö", "/tab\there", "a?b=c/../d", "x#y?z",
]


def values(spark, column_of, *rows):
    """Results of a column function for rows of text arguments, in row order."""
    names = [f"c{i}" for i in range(len(rows[0]))]
    schema = ", ".join(["i int", *(f"{n} string" for n in names)])
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
    made = df.select("i", column_of(*(F.col(n) for n in names)).alias("v")).orderBy("i")
    return [r.v for r in made.collect()]


def check(spark, column_of, cases):
    rows = [case[:-1] for case in cases]
    assert dict(zip(rows, values(spark, column_of, *rows))) == {case[:-1]: case[-1] for case in cases}


def test_join_matches_the_standard_rules(spark):
    rows = spark.createDataFrame([(h,) for h in HREFS], "h string").select(
        "h", urls.join_url(F.lit(BASE), F.col("h")).alias("got")
    )
    for row in rows.collect():
        wanted = urlsplit(urljoin(BASE, row.h))._replace(fragment="").geturl()
        assert row.got == wanted, row.h


GATE = [
    ("https://a.example/x", "/y", "https://a.example/y"),
    ("http://a.example/x", "/y", None),
    ("https://a.example/x", "https://a.example.evil.example/y", None),
    ("https://a.example/x", "https://u@a.example/y", None),
    ("https://a.example/x", "https://a.example:444/y", None),
    ("https://a.example/x", "https://a.example:443/y#z", "https://a.example:443/y"),
    ("https://a.example/x", "https://a.example:99999/y", None),
    ("https://a.example/x", "mailto:me", None),
    ("https://a.example/x", None, None),
]


def test_gate(spark):
    check(spark, lambda b, h: urls.resolve_secure(b, h, ("a.example",)), GATE)


# One clause of the rule at a time: kept in the first column of paths, broken in the second.
ID_CLAUSES = {
    "identifier": (["/abs/0704.1234", "/abs/1812.98765", "/abs/q-bio/0512345", "/abs/cond-mat.soft/0512345"],
                   ["/abs/0704.123", "/abs/1812.987654", "/abs/12.98765", "/abs/q-bio/512345", "/abs/9q/0512345", "/abs/"]),
    "version": (["/abs/0704.1234v12", "/abs/q-bio/0512345v1"], ["/abs/0704.1234v", "/abs/0704.1234w1", "/abs/0704.1234v1v2"]),
    "file ending": (["/pdf/1812.98765.pdf", "/pdf/q-bio/0512345v2.pdf"], ["/pdf/1812.98765.ps", "/pdf/1812.98765.pdf.pdf"]),
    "head": (["/pdf/0704.1234"], ["/ABS/0704.1234", "/0704.1234", "/html/0704.1234"]),
    "segments": (["/abs/q-bio/0512345"], ["/abs/a/q-bio/0512345"]),
    "empty segments": (["//abs/0704.1234", "/abs/0704.1234/", "/abs//q-bio///0512345/"], ["//", "/abs//", "///pdf/"]),
    "decoding": (["/abs/%30704.1234", "/pdf/q%2Dbio/0512345"], ["/abs/q-bio%2F0512345", "/abs/%2E/0704.1234", "/abs/q-bio%5C0512345", "/abs/%/0704.1234"]),
    "nothing behind": (["/abs/0704.1234"], ["/abs/0704.1234?", "/abs/0704.1234?a", "/abs/0704.1234#a"][1:]),
}
ID_HOSTS = (["export.arxiv.org", "ARXIV.ORG"], ["arxiv.org:444", "a:b@export.arxiv.org", "xarxiv.org", "arxiv.org.", "www.arxiv.org"])


def named(path):
    """Identifier of a good path, by plain text work."""
    tail = "/".join([p for p in path.split("/") if p][1:]).replace("%30", "0").replace("%2D", "-").removesuffix(".pdf")
    return tail.rstrip("0123456789")[:-1] if tail.rstrip("0123456789").endswith("v") else tail


CANONICAL_ID = [
    *((f"https://arxiv.org{path}", named(path)) for good, _ in ID_CLAUSES.values() for path in good),
    *((f"https://arxiv.org{path}", None) for _, bad in ID_CLAUSES.values() for path in bad),
    *((f"https://{host}/abs/0704.1234", "0704.1234") for host in ID_HOSTS[0]),
    *((f"https://{host}/abs/0704.1234", None) for host in ID_HOSTS[1]),
    ("ftp://arxiv.org/abs/0704.1234", None), (None, None),
]


def test_canonical_id(spark):
    check(spark, urls.canonical_id, CANONICAL_ID)


SECURE_LINK = [
    ("http://arxiv.org/abs/2401.00001v2", "https://arxiv.org/abs/2401.00001v2"),
    ("https://ARXIV.org:8443/abs/2401.00001", "https://arxiv.org/abs/2401.00001"),
    ("ftp://arxiv.org/abs/2401.00001", None),
    ("http://arxiv.org/list", None),
    (None, None),
]


def test_secure_link(spark):
    check(spark, urls.secure_link, SECURE_LINK)


PRIVATE_ENDPOINT = [
    ("http://localhost:8000/", "http://localhost:8000"),
    ("http://HOST.docker.internal:8000", "http://host.docker.internal:8000"),
    ("http://127.8.9.1", "http://127.8.9.1"),
    ("http://10.0.0.1:80", "http://10.0.0.1:80"),
    ("http://172.31.255.255", "http://172.31.255.255"),
    ("http://172.32.0.1", None),
    ("http://192.168.3.4", "http://192.168.3.4"),
    ("http://[::1]:8000/", "http://[::1]:8000"),
    ("http://[FD00:0:0::1]", "http://[fd00::1]"),
    ("http://[2001:db8::1]", None),
    ("https://127.0.0.1", None),
    ("http://9.9.9.9", None),
    ("http://010.0.0.1", None),
    ("http://name.example", None),
    ("http://t@127.0.0.1", None),
    ("http://127.0.0.1/?t=1", None),
    ("http://127.0.0.1/#t", None),
    ("http://127.0.0.1/path", None),
    ("http://127.0.0.1:70000", None),
]


def test_private_endpoint(spark):
    got = values(spark, urls.private_endpoint, *(case[:-1] for case in PRIVATE_ENDPOINT))
    assert [e.endpoint for e in got] == [case[-1] for case in PRIVATE_ENDPOINT]


def test_endpoint_plan_without_ipv6_has_no_python(spark):
    rows = spark.range(3).select(urls.private_endpoint(F.lit("http://10.0.0.1"), allow_ipv6=False).alias("e"))
    assert "Python" not in plan_of(rows)


def test_key_segment(spark):
    check(spark, urls.key_segment, [("a/b c~d*é+", "a%2Fb%20c~d%2A%C3%A9%2B")])


def test_year(spark):
    check(spark, urls.collection_year, [("https://h/CVPR2025?day=x", 2025), ("https://h/CVPR2024/", None)])
