"""Scalar functions on strings, identities and numbers: Column -> Column."""

from __future__ import annotations

import functools
import json
import operator
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a style's name and the weight's name they stand for.
WEIGHTS = {
    "hairline": "Hairline", "thin": "Thin", "extralight": "ExtraLight", "ultralight": "UltraLight", "light": "Light", "regular": "Regular", "normal": "Regular", "book": "Book",
    "medium": "Medium", "semibold": "SemiBold", "demibold": "DemiBold", "bold": "Bold", "extrabold": "ExtraBold", "ultrabold": "UltraBold", "black": "Black", "heavy": "Heavy",
}


def md5_identity(raw: Column) -> Column:
    """32 hex digits in lower case, else null."""
    clean = F.lower(F.trim(raw))
    return F.when(clean.rlike("^[0-9a-f]{32}$"), clean)


def fallback_identity(*parts: Column) -> Column:
    """32 hex digits from the parts; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def glyph_name(cp: Column, gid: Column) -> Column:
    wide = F.hex(cp)
    return (
        F.when(cp.isNull() | (cp <= 0), F.concat(F.lit("gid_"), gid.cast("string"))).when(cp == 32, "space")
        .when(cp <= 0xFFFF, F.concat(F.lit("uni"), F.lpad(wide, 4, "0"))).otherwise(F.concat(F.lit("u"), F.lpad(wide, 6, "0")))
    )


def safe_glyph_name(cp: Column, gid: Column) -> Column:
    """As glyph_name; without a code point the id with everything but letters, digits, "_" and "-" as "_"."""
    clean = F.regexp_replace(gid.cast("string"), r"[^\p{L}\p{N}_-]", "_")
    return F.when(cp > 0, glyph_name(cp, gid)).when(clean == "", "gid").otherwise(F.concat(F.lit("gid_"), clean))


def forced_names(raw: Column) -> Column:
    """array<string> of the names in a list with ";" between, in lower case; each once, empty ones left out."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def page_signature(layout: Column, image: Column) -> Column:
    """Digest of a page's sorted layout keys and the first 200 characters of its image. Keys have to be plain ASCII."""
    keys = F.transform(F.array_sort(F.json_object_keys(layout)), lambda k: F.concat(F.lit('"'), k, F.lit('"')))
    return F.sha2(F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]"), F.substring(F.coalesce(image, F.lit("")), 1, 200)), 256)


def url_code(url: Column, host: Column, prefix: str) -> Column:
    """First rule that a URL breaks, or 'ok'. host: the only one allowed."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "bad_format").when(F.length(url) > 2048, "too_long")
        .when(F.coalesce(part("PROTOCOL"), F.lit("")) != "https", "bad_scheme").when(part("USERINFO").isNotNull(), "userinfo")
        .when(part("AUTHORITY").contains(":"), "port").when(F.coalesce(part("HOST"), F.lit("")) != host, "bad_host")
        .when(part("PATH").contains(".."), "traversal").when(~F.startswith(part("PATH"), F.lit(prefix)), "bad_path").otherwise("ok")
    )


def observation_key(md5: Column, gid: Column, size: Column, x: Column, y: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", md5, gid.cast("string"), size.cast("string"), F.format_string("%.2f", x), F.format_string("%.2f", y)), 256), 1, 24)


def weight_of(name: Column) -> Column:
    """The name of the weight that the first fitting token stands for; null if none does."""
    tokens = F.split(F.lower(name), r"[\s_\-/]+")
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.element_at(table, F.get(F.filter(tokens, lambda t: t.isin(*WEIGHTS)), F.lit(0)))


# Fragments of an error code and their class, the first that fits.
ERROR_CLASSES = (
    ("DISCOVERY_EMPTY", ("DISCOVERY_EMPTY",)), ("NO_GLYPHS_FROZEN", ("NO_GLYPHS_FROZEN",)), ("VALIDATION_FAILED", ("VALIDATION",)), ("VIETNAMESE_PENDING", ("VIETNAMESE",)),
    ("NETWORK", ("NETWORK", "DNS", "TIMEOUT", "CONNECT", "SOCKET", "SSL", "LIVE_")),
)


def error_class(code: Column) -> Column:
    """Class of an error code; UNKNOWN for null."""
    m, out = F.upper(code), F
    for name, parts in ERROR_CLASSES:
        out = out.when(functools.reduce(operator.or_, [m.contains(w) for w in parts]), name)
    return out.otherwise("UNKNOWN")


def number(raw: Column) -> Column:
    """A finite double, else null."""
    d = raw.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def seconds(ms: Column) -> Column:
    return F.bround(ms.try_cast("double") / 1000, 3)


def flag(raw: Column) -> Column:
    """False for null, '', 0, false, no and off."""
    return ~F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin("", "0", "false", "no", "off")


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


@F.pandas_udf(T.StringType())
def _decomposed(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: unicodedata.normalize("NFKD", x).casefold(), na_action="ignore")


def normalized(raw: Column) -> Column:
    """NFKD, case folded, white space as single spaces, trimmed. Spark has no normaliser, so a pandas UDF makes the form."""
    return F.trim(F.regexp_replace(_folded(raw), r"(?U)\s+", " "))


def slug(raw: Column, most: int = 60) -> Column:
    """ASCII letters and digits joined by hyphens, at most `most` long; 'unnamed' if nothing is left or raw is null."""
    ascii_only = F.regexp_replace(_decomposed(raw), r"[^\x00-\x7F]", "")
    s = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed"))


def postscript_name(raw: Column) -> Column:
    """ASCII letters, digits and single hyphens; 'Custom' if nothing is left."""
    s = F.regexp_replace(_decomposed(raw), "[^A-Za-z0-9-]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", ""), F.lit("")), F.lit("Custom"))


def short_digest(value: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def options_key(options: Column) -> Column:
    """Digest of a map<string, boolean> as JSON with sorted keys."""
    items = F.array_sort(F.map_entries(options))
    one = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.coalesce(e["value"].cast("string"), F.lit("null")))
    return short_digest(F.concat(F.lit("{"), F.concat_ws(",", F.transform(items, one)), F.lit("}")))


def listed(raw: Column, separators: str) -> Column:
    """Distinct trimmed lower-case parts that aren't empty, sorted."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), f"[{separators}]"), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def clean_title(raw: Column, site: str, most: int = 120) -> Column:
    """The first part of a title that isn't the site's name, cut at the first separator, in order of rank, that it has."""
    text = F.trim(F.regexp_replace(raw, r"\s+", " "))
    ok = lambda x: (x != "") & (F.lower(x) != site.lower())
    first = lambda sep: F.get(F.filter(F.transform(F.split(text, f"\\Q{sep}\\E"), lambda x: F.trim(x)), ok), F.lit(0))
    out = F
    for sep in ("|", "\u2013", "\u2014", " - "):
        out = out.when(text.contains(sep), first(sep))
    return F.nullif(F.substring(out.otherwise(F.when(ok(text), text)), 1, most), F.lit(""))


def timestamp(raw: Column) -> Column:
    """ISO text as a timestamp in the session's zone (UTC) where it has none; null if it is none."""
    return raw.try_cast("timestamp")


def _without(value, pattern, count):
    if isinstance(value, dict):
        kept = {k: v for k, v in value.items() if not pattern.search(k)}
        count[0] += len(value) - len(kept)
        return {k: _without(v, pattern, count) for k, v in kept.items()}
    return [_without(v, pattern, count) for v in value] if isinstance(value, list) else value


# Parts of names that hold secrets.
SECRET = "token|cookie|secret|password|authorization"


@F.pandas_udf(T.StructType().add("json", "string").add("dropped", "integer"))
def redacted(raw: pd.Series) -> pd.DataFrame:
    """JSON without secret keys at any depth, and how many were dropped; null and 0 for what is no JSON."""
    pattern, out = re.compile(SECRET, re.IGNORECASE), []
    for x in raw:
        count = [0]
        try:
            out.append((json.dumps(_without(json.loads(x), pattern, count), sort_keys=True, separators=(",", ":"), ensure_ascii=False), count[0]))
        except (TypeError, ValueError):
            out.append((None, 0))
    return pd.DataFrame(out, columns=["json", "dropped"])
