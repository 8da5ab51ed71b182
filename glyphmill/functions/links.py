"""Links of landed pages: stable ids, and what a redirect leads to."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_id(kind: Column, value: Column) -> Column:
    """kind:value; null where either is null."""
    return F.concat(kind, F.lit(":"), value)


def redirect(location: Column, current: Column, host: str) -> Column:
    """struct<target, code>: a Location resolved against the current URL, and the first rule that it breaks.

    bad_redirect (null or blank), bad_scheme (not https), bad_format (userinfo, or no URL), bad_host, else ok; target is null for all
    but ok. Resolving relative references has no function in Spark, hence a pandas UDF over both strings.
    """
    kind = T.StructType().add("target", "string").add("code", "string")

    def judged(where: str | None, base: str | None) -> tuple[str | None, str]:
        if where is None or not where.strip():
            return None, "bad_redirect"
        try:
            target = urljoin(base or "", where.strip())
            parts = urlsplit(target)
            named = (parts.hostname or "").lower()
        except ValueError:
            return None, "bad_format"
        if parts.scheme.lower() != "https":
            return None, "bad_scheme"
        if parts.username is not None or parts.password is not None:
            return None, "bad_format"
        return (target, "ok") if named == host else (None, "bad_host")

    @F.pandas_udf(kind)
    def run(where: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judged(a, b) for a, b in zip(where, base)], columns=["target", "code"], dtype=object)

    return run(location, current)
