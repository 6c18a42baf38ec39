"""URL functions as column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .steps import bound

# Results depend on them.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "source", "timestamp", "_", "t", "v", "rnd", "random")
TARGET_TERMS = (
    "数据产品", "数据商品", "产品目录", "产品详情", "数据集", "数据接口", "数据服务", "数据组件", "组件", "应用场景", "数据场景", "解决方案", "场景案例", "数据需求",
    "product", "catalog", "dataset", "component", "scenario", "solution", "demand",
)
DETAIL_WORDS = ("detail", "info", "view")
DETAIL_TERMS = ("detail", "info", "view", "product/", "goods/", "dataset/", "component/", "scene/", "scenario/", "solution/", "demand/", "productdetail", "product-detail")
LISTING_TERMS = ("list", "catalog", "product", "goods", "dataset", "component", "scene", "scenario", "demand", "产品", "商品", "场景")
EXIT_TERMS = ("login", "logout", "register", "javascript:", "mailto:")
BINARY = r"\.(?:jpg|jpeg|png|gif|svg|css|woff2?|ttf|mp4|mp3|zip|rar|7z|xlsx?|csv)(?:\?|$)"
BINARY_OR_DOC = r"\.(?:jpg|jpeg|png|gif|svg|css|woff2?|ttf|mp4|mp3|zip|rar|7z|xlsx?|csv|docx?)(?:\?|$)"
PAGER = r"(?:page|current|pageno|pageindex)=\d+"
ID_KEYS = ("productId", "goodsId", "resourceId", "sceneId", "id", "code")
ROLE_BONUS = {"entry": 8.0, "sitemap": 7.0, "listing": 5.0, "api": 5.0, "detail": 4.0}
SECOND_LEVEL = ("com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn")

# Marks of pages that are rendered on a server, and of those rendered in a browser.
SERVER_MARKS = ("window.__NUXT__", "__NEXT_DATA__")
APP_MARKS = ('id="app"', "id='app'", 'id="root"', "id='root'", 'id="main"', "id='main'", "webpack", "vite")
HEAD, LITTLE_TEXT = 300_000, 800
# Networks that no public host lies in: first and last address.
CLOSED = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)
# The same for the second family; inside the ninth some are public again.
CLOSED_V6 = (
    ("::", "::1"), ("64:ff9b:1::", "64:ff9b:1:ffff:ffff:ffff:ffff:ffff"), ("100::", "100::ffff:ffff:ffff:ffff"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff"), ("2002::", "2002:ffff:ffff:ffff:ffff:ffff:ffff:ffff"),
    ("3fff::", "3fff:fff:ffff:ffff:ffff:ffff:ffff:ffff"), ("fc00::", "fdff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("fe80::", "febf:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("2001::", "2001:1ff:ffff:ffff:ffff:ffff:ffff:ffff"),
)
OPEN_V6 = (
    ("2001:1::1", "2001:1::2"), ("2001:3::", "2001:3:ffff:ffff:ffff:ffff:ffff:ffff"), ("2001:4:112::", "2001:4:112:ffff:ffff:ffff:ffff:ffff"),
    ("2001:20::", "2001:2f:ffff:ffff:ffff:ffff:ffff:ffff"), ("2001:30::", "2001:3f:ffff:ffff:ffff:ffff:ffff:ffff"),
)

PARTS = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.replace(F.trim(url), F.lit(" "), F.lit("")), PARTS, k)


def encoded(value: Column) -> Column:
    """Form encoding that leaves ~ and encodes *."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def decoded(value: Column) -> Column:
    """Form decoding; a per cent sign without two hexadecimal digits behind it stays."""
    return F.try_url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


@F.pandas_udf(StringType())
def ascii_form(host: pd.Series) -> pd.Series:
    def one(h):
        try:
            return None if h is None else h.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return ""

    return host.map(one)


def ascii_host(name: Column) -> Column:
    """A host in its ASCII form, for which Spark has no function. Only hosts beyond ASCII go to Python; '' if there is none."""
    return F.coalesce(ascii_form(F.when(name.rlike(r"[^\x00-\x7F]"), name)), F.lower(name))


def query_pairs(url: Column) -> Column:
    """Decoded (key, value) pairs of the query, in their order."""
    pairs = F.filter(F.split(part(url, 5), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))


def canonical_url(url: Column) -> Column:
    """Canonical http(s) URL: lower-case scheme, ASCII host, no default port, single slashes, sorted query without tracking
    parameters, fragment only if it is a route. Anything else gives ''."""
    scheme, port, name = F.lower(part(url, 1)), part(url, 3), ascii_host(part(url, 2))
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.concat(name, F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise(""))
    path = F.regexp_replace(part(url, 4), "/{2,}", "/")
    pairs = F.array_sort(F.filter(query_pairs(url), lambda p: ~F.lower(p.k).isin(*TRACKING)))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p.k), F.lit("="), encoded(p.v))), "&")
    route = part(url, 6)
    out = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(route.rlike("^!?/"), F.concat(F.lit("#"), route)).otherwise(""))
    return F.when(url.isNotNull(), F.when((scheme != "") & (name != ""), out).otherwise(""))


def resolved(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page: absolute, //host, /path, ?query, #fragment or relative to the folder."""
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    out = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )
    steps = F.split(F.regexp_extract(out, r"^https?://[^/?#]+/([^?#]*)", 1), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))))
    dotted = F.concat(F.regexp_extract(out, r"^(https?://[^/?#]+/)", 1), F.array_join(walked, "/"), F.regexp_extract(out, r"^https?://[^/?#]+/[^?#]*(.*)$", 1))
    return F.when(out.rlike(r"^https?://[^?#]*/\.\.?(/|$|\?|#)"), dotted).otherwise(out)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def family(host_name: Column) -> Column:
    """The last two labels of a host, three under a shared second level."""
    labels = F.split(host_name, r"\.")
    two = F.substring_index(host_name, ".", -2)
    return F.when((F.size(labels) > 2) & two.isin(*SECOND_LEVEL), F.substring_index(host_name, ".", -3)).otherwise(two)


def host_allowed(host_name: Column, allowed) -> Column:
    """Whether a host is one of the allowed names or lies below one."""
    labels = F.split(host_name, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.exists(ends, lambda e: e.isin(*allowed))


def address(dotted: Column) -> Column:
    """Number of a dotted quad."""
    steps = F.split(dotted, r"\.")
    return sum((steps[k].try_cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))


def public_literal(host_name: Column) -> Column:
    """False for empty names, localhost and addresses that are not public, in either family, by number and in any spelling; names are not looked up. An address in
    brackets or with colons that is none counts as not public."""
    return F.coalesce(bound(F.regexp_replace(F.lower(F.trim(host_name)), r"^\[|\]$", ""), lambda bare: bound(F.struct(bare.alias("bare"), digits_of_v6(bare).alias("six")), public_address)), F.lit(False))


def public_address(named: Column) -> Column:
    """Whether a host (bare, six: its 32 digits, if it is an address of the second family) is public."""
    bare, six = named["bare"], named["six"]
    mapped = F.coalesce(F.substring(six, 1, 24) == "0" * 20 + "ffff", F.lit(False))
    quad = bare.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") | mapped
    four = F.when(mapped, F.conv(F.substring(six, 25, 8), 16, 10).cast("long")).otherwise(address(bare))
    low = lambda v: sum(int(x) << (24 - 8 * k) for k, x in enumerate(v.split(".")))
    high = lambda v: ipaddress.ip_address(v).exploded.replace(":", "")

    def within(value: Column, ranges, number) -> Column:
        out = F.lit(False)
        for first, last in ranges:
            out = out | value.between(number(first), number(last))
        return out

    closed = bound(four, lambda n: within(n, CLOSED, low))
    inside = within(six, CLOSED_V6, high) & ~within(six, OPEN_V6, high)
    return ~bare.isin("", "localhost") & ~(quad & closed) & ~(F.contains(bare, F.lit(":")) & (six.isNull() | ~mapped & inside))


def digits_of_v6(bare: Column) -> Column:
    """The 32 hexadecimal digits of an address of the second family, null for anything else; the last two groups may be a dotted quad, a zone is left out."""
    text = F.regexp_replace(bare, "%.*$", "")
    tail = address(F.regexp_extract(text, r"((?:\d{1,3}\.){3}\d{1,3})$", 1))
    dotted = F.concat_ws(":", F.lower(F.hex(F.shiftright(tail, 16))), F.lower(F.hex(tail.bitwiseAND(65535))))
    text = F.when(text.rlike(r":(?:\d{1,3}\.){3}\d{1,3}$"), F.concat(F.regexp_extract(text, "^(.*:)[^:]*$", 1), dotted)).otherwise(text)
    some = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")

    def spread(text: Column) -> Column:
        halves = F.split(text, "::", -1)
        cut = F.struct(text.alias("text"), F.size(halves).alias("n"), some(F.get(halves, 0)).alias("left"), some(F.coalesce(F.get(halves, 1), F.lit(""))).alias("right"))
        return bound(cut, padded)

    def padded(cut: Column) -> Column:
        text, gap = cut["text"], 8 - F.size(cut["left"]) - F.size(cut["right"])
        every = F.concat(cut["left"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), cut["right"])
        fits = text.rlike("^[0-9a-f:]+$") & F.contains(text, F.lit(":")) & ~text.rlike(":::|::.*::|^:[^:]|[^:]:$") & F.when(cut["n"] == 2, gap >= 1).otherwise(gap == 0)
        return F.when(fits & F.forall(every, lambda g: F.length(g) <= 4), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return bound(text, spread)


def page_url(endpoint: Column, page: Column, marker: str = "_page") -> Column:
    """An endpoint's URL for one page, so that each page has a state of its own."""
    base = F.regexp_replace(endpoint, "#.*$", "")
    return F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit(f"{marker}="), page.cast("string"))


def page_number(url: Column, marker: str = "_page") -> Column:
    """The page that ``page_url`` wrote into a URL; null without one."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{marker}=(\d+)", 1), F.lit("")).cast("long")


def detail_url(template: Column, external: Column, otherwise: Column) -> Column:
    """The URL of a record's detail page, where there are a template and an id."""
    return F.when((template != "") & (external != ""), F.replace(template, F.lit("{id}"), external)).otherwise(otherwise)


def looks_like_app(html: Column, url: Column, mime: Column) -> Column:
    """Whether a page is an application that shows its records only in a browser."""
    head = F.substring(html, 1, HEAD)
    visible = F.trim(F.regexp_replace(F.regexp_replace(head, "<[^>]+>", " "), r"\s+", " "))
    page = F.contains(mime, F.lit("html")) | F.lower(F.ltrim(html)).startswith("<!doctype html")
    scripts = F.regexp_count(head, F.lit(r"(?i)<script\b"))
    shell = any_of(head, SERVER_MARKS) | any_of(head, APP_MARKS) & (F.length(visible) < LITTLE_TEXT)
    return page & (url.rlike("#!?/") | (scripts >= 2) & shell)


def any_of(value: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(value, F.lit(t))
    return out


def link_relevance(url: Column, anchor: Column) -> Column:
    text = F.lower(F.concat(url, F.lit(" "), anchor))
    score = F.lit(0.0)
    for t in TARGET_TERMS:
        score = score + F.when(F.contains(text, F.lit(t)), 1.5).otherwise(0.0)
    score = score + F.when(any_of(text, DETAIL_TERMS), 2.0).otherwise(0.0) + F.when(text.rlike(PAGER), 1.0).otherwise(0.0)
    return score - F.when(text.rlike(BINARY), 10.0).otherwise(0.0) - F.when(any_of(text, EXIT_TERMS), 10.0).otherwise(0.0)


def page_role(url: Column, anchor: Column, mime: Column) -> Column:
    v = F.lower(F.concat(url, F.lit(" "), anchor))
    return (
        F.when(F.contains(mime, F.lit("json")) | F.contains(v, F.lit("/api/")), "api")
        .when(F.contains(v, F.lit("sitemap")) | v.endswith(".xml"), "sitemap")
        .when(F.contains(mime, F.lit("pdf")) | v.rlike(r"\.pdf(?:\?|$)"), "document")
        .when(any_of(v, DETAIL_WORDS), "detail")
        .when(any_of(v, LISTING_TERMS), "listing")
        .otherwise("unknown")
    )


def queue_score(url: Column, anchor: Column, role: Column, depth: Column) -> Column:
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_BONUS.items() for x in kv])[role], F.lit(0.0))
    return link_relevance(url, anchor) + bonus - depth * 0.15


def admitted(url: Column, anchor: Column, score: Column, depth: Column, parent_role: Column, max_depth: int = 8) -> Column:
    """Whether a link joins the queue."""
    more = parent_role.isin("listing", "sitemap", "api") & ((score > -0.1) | anchor.isin("下一页", "下页", "末页", "更多") | anchor.rlike(r"^\d+$"))
    fine = (depth <= max_depth) & (url != "") & ~F.lower(F.concat(url, F.lit(" "), anchor)).rlike(BINARY_OR_DOC)
    return fine & F.when(depth <= 1, score > -5.0).otherwise(more | (score >= 1.0))


def due_days(role: Column, changed: Column) -> Column:
    return F.when(role.isin("entry", "listing", "api", "sitemap", "unknown"), 1).when(changed, 2).when(role == "detail", 7).otherwise(14)


def external_id(url: Column) -> Column:
    """The first identifying query parameter, else a hex-like last path step."""
    pairs = query_pairs(url)

    def first(key: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: (p.k == key) & (p.v != "")), F.lit(1)).v

    named = [first(k) for k in ID_KEYS]
    tail = F.regexp_extract(F.regexp_replace(part(url, 4), "/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(*named, F.when(tail.rlike(r"^[0-9a-fA-F_-]{6,80}$"), tail).otherwise(""))
