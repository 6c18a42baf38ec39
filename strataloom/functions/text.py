"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Results depend on them.
COUNTERS = r"(?i)(?:访问量|浏览量|阅读量|点击量|当前时间|系统时间)\s*[:：]?\s*\d+"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
EMAIL = r"(?<![A-Za-z0-9_.+-])([A-Za-z0-9_.+-]{1,2})[A-Za-z0-9_.+-]{0,62}@([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![A-Za-z0-9_.-])"
MOBILE = r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"
IDENTITY = r"(?<!\d)(\d{6})\d{8}(\d{3}[0-9Xx])(?!\d)"
TOTAL = r"共\s*[0-9,，]+\s*(?:条|个)"
CATALOGUE_WORDS = r"(?i)数据产品|数据商品|产品|商品|数据集|数据服务|数据组件|组件|场景|需求|数商|catalog|product|dataset|component|scenario|demand"
COUNTED_ROUTES = ("product", "goods", "catalog", "dataset", "scenario", "component", "demand", "market")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition, for which Spark has no built-in function. Only texts beyond ASCII go to Python."""
    return F.coalesce(composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def squeezed(text: Column) -> Column:
    """One blank for each run of white space (of any script), none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """NFKC, counters removed, white space squeezed."""
    return squeezed(F.regexp_replace(nfkc(text), COUNTERS, ""))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def snippet(text: Column, limit: int) -> Column:
    """The start of a normalised text, with a mark where it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def key_fold(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^0-9a-z一-鿿]", "")


def redact(text: Column) -> Column:
    """Masks e-mail addresses, mobile numbers and identity numbers."""
    text = F.regexp_replace(text, EMAIL, "$1***@$2")
    return F.regexp_replace(F.regexp_replace(text, MOBILE, "$1****$2"), IDENTITY, "$1********$2")


def redact_fields(value: Column, kind: DataType) -> Column:
    """The same through nested structs, arrays and map values; keys, numbers and all else stay."""
    if isinstance(kind, StringType):
        return redact(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redact_fields(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: redact_fields(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[redact_fields(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def declared_total(text: Column, url: Column, role: Column) -> Column:
    """The total that a listing states, if a word of the catalogue stands within 80 characters; else null."""
    counts = role.isin("listing", "api")
    for route in COUNTED_ROUTES:
        counts = counts | F.contains(F.lower(url), F.lit(route))
    hit = F.regexp_extract(text, TOTAL, 0)
    at = F.instr(text, hit)
    near = F.substring(text, F.greatest(at - 80, F.lit(1)), F.length(hit) + F.least(at - 1, F.lit(80)) + 80)
    total = F.regexp_replace(F.regexp_extract(hit, r"([0-9,，]+)", 1), "[,，]", "").try_cast("long")
    return F.when(counts & (hit != "") & near.rlike(CATALOGUE_WORDS), total)


@F.pandas_udf(StringType())
def read_bytes(body: pd.Series, declared: pd.Series) -> pd.Series:
    """Text of bytes in the first charset that reads them whole: the declared one, UTF-8, GB18030, GBK; else UTF-8 with replacements."""

    def one(raw, name):
        if raw is None:
            return None
        for charset in (name, "utf-8", "gb18030", "gbk"):
            try:
                if charset:
                    return raw.decode(charset.strip())
            except (UnicodeError, LookupError, ValueError):
                continue
        return raw.decode("utf-8", "replace")

    return pd.Series([one(*r) for r in zip(body, declared, strict=True)], dtype=object)


def decoded(body: Column, declared: Column) -> Column:
    """Text of a response body, whatever its bytes: in the declared charset, UTF-8, GB18030, GBK, or UTF-8 with replacements, the first that reads it whole. Only
    bodies that are no UTF-8 or declared as something else reach Python."""
    plain = F.when(F.coalesce(F.lower(F.trim(declared)), F.lit("")).isin("", "utf-8", "utf8", "us-ascii", "ascii"), F.try_validate_utf8(body.cast("string")))
    odd = F.when(plain.isNull(), body)
    return F.coalesce(plain, read_bytes(odd, declared))


JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def redact_json(text: Column) -> Column:
    """Masks string values in free JSON; keys, numbers and the rest of the text stay as they are. A text that is no JSON is masked as plain text."""
    literals, between = F.regexp_extract_all(text, F.lit(JSON_STRING), F.lit(0)), F.split(text, JSON_STRING, -1)

    def masked(literal: Column) -> Column:
        inner = F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]
        told = F.to_json(F.array(redact(inner)))
        hit = redact(inner)
        return F.when(inner.isNull() | (hit == inner), literal).otherwise(F.substring(told, F.lit(2), F.length(told) - 2))

    shown = F.zip_with(literals, F.slice(between, F.lit(2), F.size(literals)), lambda s, after: F.when(after.rlike(r"^\s*:"), s).otherwise(masked(s)))
    pieces = F.flatten(F.zip_with(between, shown, lambda b, s: F.array(b, F.coalesce(s, F.lit("")))))
    return F.when(F.try_parse_json(text).isNull(), redact(text)).otherwise(F.array_join(pieces, ""))


def unescaped(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def stripped(html: Column) -> Column:
    """Visible text: scripts, styles and tags removed, entities decoded, squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1>|<!--.*?-->", " ")
    return squeezed(unescaped(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def element(html: Column, tag: str) -> Column:
    """Text of the first element of that name."""
    return squeezed(unescaped(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)<[^>]*>", " ")))


def parse_datetime(text: Column) -> Column:
    """The first y-m-d wins and drops the time of day; else a fixed list of patterns; null if none fits. Zone UTC."""
    y, m, d = (F.regexp_extract(text, r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})", k) for k in (1, 2, 3))
    first = F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d"))
    rest = [F.try_to_timestamp(text, F.lit(p)) for p in ("yyyyMMddHHmmss", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy")]
    return F.when(y != "", first).otherwise(F.coalesce(*rest))


def period(text: Column) -> Column:
    """First and last of all dates in a text; the end is null if there is one date only."""
    dates = F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2}[-/.年]\d{1,2}(?:[-/.月]\d{1,2})?)"), 1)
    return F.struct(F.try_element_at(dates, F.lit(1)).alias("start"), F.when(F.size(dates) > 1, F.element_at(dates, -1)).alias("end"))
