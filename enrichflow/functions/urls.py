"""URL splitting, joining, gating and identifier parsing as JVM column expressions.

URLs are split with one RFC 3986 pattern rather than ``try_parse_url``: that function gives NULL
for a URL holding a space and keeps ports above 65535.
"""
import ipaddress
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import bind
from enrichflow.schemas import TEXT

_SHAPE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HAS_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_DOTTED = r"(?:^|/)\.\.?(?:/|$)"


def url_pieces(url: Column) -> Column:
    """Struct of the URL parts; absent parts are empty, ``port`` is NULL when it is not a port."""

    def outer(text: Column) -> Column:
        piece = [F.regexp_extract(text, _SHAPE, i) for i in range(1, 6)]
        return F.struct(
            text.alias("text"),
            F.lower(piece[0]).alias("scheme"),
            piece[1].alias("authority"),
            piece[2].alias("path"),
            piece[3].alias("query"),
            piece[4].alias("fragment"),
        )

    def inner(u: Column, spot: Column) -> Column:
        name = F.when(spot.startswith("["), F.regexp_extract(spot, r"^\[([^\]]*)\]", 1)).otherwise(
            F.substring_index(spot, ":", 1)
        )
        tail = F.regexp_extract(spot, r"(?s)^(?:\[[^\]]*\]|[^:]*)(.*)$", 1)
        digits = F.substring(tail, 2, 2**31 - 1)
        is_port = tail.rlike("^(:[0-9]*)?$") & ((digits == "") | (digits.try_cast("bigint") <= 65535))
        return F.struct(
            *(u[n].alias(n) for n in ("text", "scheme", "authority", "path", "query", "fragment")),
            F.lower(name).alias("host"),
            F.when(is_port, digits).alias("port"),
            u["authority"].contains("@").alias("has_user"),
        )

    text = F.translate(F.ltrim(url, F.lit("".join(map(chr, range(33))))), "\t\r\n", "")
    parts = bind(outer, text=text)
    with_spot = bind(
        lambda u: F.struct(u.alias("u"), F.substring_index(u["authority"], "@", -1).alias("spot")), u=parts
    )
    return bind(lambda w: inner(w["u"], w["spot"]), w=with_spot)


def _known_host(u: Column, hosts: tuple[str, ...] | None) -> Column:
    return u["host"].isin(*hosts) if hosts is not None else u["host"] != ""


def _passes(u: Column, hosts: tuple[str, ...] | None, scheme: Column | None = None) -> Column:
    secure = (u["scheme"] if scheme is None else scheme) == "https"
    return secure & _known_host(u, hosts) & ~u["has_user"] & F.coalesce(u["port"].rlike("^(0*443)?$"), F.lit(False))


def is_secure(url: Column, hosts: tuple[str, ...] | None) -> Column:
    """https, allow-listed host (None allows any), no user info, default port."""
    return F.coalesce(bind(lambda u: _passes(u, hosts), u=url_pieces(url)), F.lit(False))


def _fold_dots(segments: Column) -> Column:
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), tail)


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def join_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from ``base``, without fragment or empty query."""
    return bind(_joined, b=url_pieces(base), h=url_pieces(href))


def _joined(b: Column, h: Column) -> Column:
    same_scheme = (h["scheme"] == "") | (h["scheme"] == b["scheme"])
    own_authority = h["text"].rlike(_HAS_AUTHORITY)
    path, query = h["path"], h["query"]

    def relative(glued: Column) -> Column:
        pieces = F.split(glued, "/")
        inner = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), lambda s: s != "")
        packed = F.concat(F.array(F.lit("")), inner, F.array(F.element_at(pieces, -1)))
        messy = glued.contains("//") | glued.rlike(_DOTTED)
        return F.when(messy, _rooted(_fold_dots(packed))).otherwise(glued)

    from_root = F.when(path.rlike(_DOTTED), _rooted(_fold_dots(F.split(path, "/")))).otherwise(path)
    beside = bind(relative, glued=_rooted(F.concat(F.regexp_extract(b["path"], r"(?s)^(.*/)", 1), path)))
    target = (
        F.when(own_authority, path)
        .when(path == "", b["path"])
        .when(path.startswith("/"), from_root)
        .otherwise(beside)
    )
    asked = F.when(~own_authority & (path == "") & (query == ""), b["query"]).otherwise(query)
    front = F.concat(
        F.when(h["scheme"] == "", b["scheme"]).otherwise(h["scheme"]),
        F.lit("://"),
        F.when(own_authority, h["authority"]).otherwise(b["authority"]),
    )
    whole = bind(
        lambda t, q: F.concat(
            F.when(t == "", t).otherwise(_rooted(t)),
            F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)),
        ),
        t=target,
        q=asked,
    )
    return F.when(same_scheme | own_authority, F.concat(front, whole))


def resolve_secure(base: Column, href: Column, hosts: tuple[str, ...] | None = V.CATALOGUE_HOSTS) -> Column:
    """Joined URL when both the page and the result pass the gate, else NULL.

    A link without an authority of its own keeps the page's, so the parts already split decide.
    """

    def gated(b: Column, h: Column) -> Column:
        scheme = F.when(h["scheme"] == "", b["scheme"]).otherwise(h["scheme"])
        good = ~h["text"].rlike(_HAS_AUTHORITY) | _passes(h, hosts, scheme)
        return F.when(_passes(b, hosts) & good, _joined(b, h))

    return bind(gated, b=url_pieces(base), h=url_pieces(href))


@dataclass(frozen=True)
class IdShape:
    """Where an identifier sits in a URL: ``/<head>/<identifier>`` on one of the hosts."""

    hosts: tuple[str, ...] | None = V.ARCHIVE_HOSTS
    heads: tuple[str, ...] = V.ARCHIVE_PATH_HEADS
    suffixes: tuple[tuple[str, str], ...] = (("pdf", ".pdf"),)
    pattern: str = V.ARCHIVE_ID_PATTERN
    version: str = V.ARCHIVE_VERSION_PATTERN
    max_segments: int = 2


ARCHIVE = IdShape()


def _named_id(u: Column, shape: IdShape) -> Column:
    """Identifier in the path of split URL parts that have neither query nor fragment."""

    def decode(path: Column) -> Column:
        raw = F.filter(F.split(path, "/"), lambda s: s != "")
        plain = F.transform(
            raw, lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
        )
        return F.when(path.contains("%"), plain).otherwise(raw)

    def name(parts: Column, head: Column) -> Column:
        rest = F.array_join(F.slice(parts, 2, shape.max_segments + 1), "/")
        for owner, suffix in shape.suffixes:
            cut = F.regexp_replace(rest, re.escape(suffix) + "$", "")
            rest = F.when(head == owner, cut).otherwise(rest)
        unsafe = F.exists(parts, lambda s: s.contains("/") | s.contains("\\") | s.isin(".", ".."))
        fits = ~unsafe & head.isin(*shape.heads) & F.size(parts).between(2, shape.max_segments + 1)
        return bind(
            lambda found: F.when(
                fits & found.rlike(f"^(?:{shape.pattern})$"), F.regexp_replace(found, shape.version, "")
            ),
            found=rest,
        )

    named = bind(lambda parts: name(parts, F.try_element_at(parts, F.lit(1))), parts=decode(u["path"]))
    return F.when((u["query"] == "") & (u["fragment"] == ""), named)


def canonical_id(url: Column, shape: IdShape = ARCHIVE) -> Column:
    """Version-free identifier named by the URL, NULL when the URL does not name one."""
    return bind(lambda u: F.when(_passes(u, shape.hosts), _named_id(u, shape)), u=url_pieces(url))


def secure_link(href: Column, shape: IdShape = ARCHIVE) -> Column:
    """https form without port when the link names an identifier, else NULL."""

    def rebuild(u: Column) -> Column:
        allowed = u["scheme"].isin("http", "https") & ~u["has_user"] & _known_host(u, shape.hosts)
        good = allowed & _named_id(u, shape).isNotNull()
        return F.when(good, F.concat(F.lit("https://"), u["host"], u["path"]))

    return bind(rebuild, u=url_pieces(href))


def collection_year(url: Column, pattern: str = V.COLLECTION_YEAR_PATTERN) -> Column:
    return F.regexp_extract(url, pattern, 1).try_cast("int")


def key_segment(value: Column) -> Column:
    """Percent-encode a value as one path segment (no safe characters but ``-._~``)."""
    encoded = F.url_encode(value)
    return F.replace(
        F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


@F.pandas_udf(TEXT)
def _private_ipv6(hosts: pd.Series) -> pd.Series:
    """Compressed form of loopback and unique-local IPv6 addresses, NULL for the rest."""
    local = ipaddress.ip_network("fc00::/7")

    def check(text: str | None) -> str | None:
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return address.compressed if address.is_loopback or address in local else None

    return hosts.map(check, na_action="ignore").astype(object)


def private_endpoint(url: Column, allow_ipv6: bool = True) -> Column:
    """Struct (endpoint, class): normalised URL of a local or private http endpoint, NULL when refused.

    Alias the result before taking a field. Names and IPv4 stay in the JVM. Only IPv6 hosts are sent to a Python worker; with
    ``allow_ipv6=False`` the plan has no Python node and IPv6 hosts are refused.
    """
    host = bind(lambda u: u["host"], u=url_pieces(url))
    v6 = _private_ipv6(F.when(host.contains(":"), host)) if allow_ipv6 else F.lit(None).cast("string")
    return bind(_endpoint, u=url_pieces(url), v6=v6)


def _endpoint(u: Column, v6: Column) -> Column:
    octet = [F.split_part(u["host"], F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    address = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]

    def v4_class(number: Column) -> Column:
        def inside(first: str, size: int) -> Column:
            start = int(ipaddress.IPv4Address(first))
            return number.between(start, start + size - 1)

        return (
            F.when(inside("127.0.0.0", 2**24), F.lit("loopback"))
            .when(inside("10.0.0.0", 2**24), F.lit("private_10"))
            .when(inside("172.16.0.0", 2**20), F.lit("private_172"))
            .when(inside("192.168.0.0", 2**16), F.lit("private_192"))
        )

    kind = (
        F.when(u["host"].isin(*V.LOCAL_HOST_NAMES), F.lit("local_name"))
        .when(u["host"].rlike(_IPV4), bind(v4_class, number=address))
        .when(v6.isNotNull(), F.lit("private_v6"))
    )
    plain = (
        (u["scheme"] == "http")
        & ~u["has_user"]
        & u["port"].isNotNull()
        & (u["query"] == "")
        & (u["fragment"] == "")
        & u["path"].isin("", "/")
    )
    host = F.when(v6.isNotNull(), F.concat(F.lit("["), v6, F.lit("]"))).otherwise(u["host"])
    port = F.when(u["port"] == "", u["port"]).otherwise(
        F.concat(F.lit(":"), u["port"].try_cast("int").cast("string"))
    )
    return bind(
        lambda found: F.struct(
            F.when(found.isNotNull(), F.concat(F.lit("http://"), host, port)).alias("endpoint"),
            found.alias("class"),
        ),
        found=F.when(plain, kind),
    )
