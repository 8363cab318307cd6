"""Column expressions on URLs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def slug_of(url: Column) -> Column:
    """The last part of the path, slashes at the end aside; a query string stays."""
    return F.regexp_extract(url, r"([^/]*)/*$", 1)


def normal(url: Column) -> Column:
    """Without fragment and slashes at the end."""
    return F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), "/+$", "")


def netloc(url: Column) -> Column:
    """Host and port as written; empty where there is none. Host names are compared as strings."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def is_absolute(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


@F.pandas_udf(StringType())
def _joined(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(base: str | None, href: str | None) -> str | None:
        if base is None or href is None:
            return None
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    for base, href in parts:
        yield pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def resolve(base: Column, href: Column) -> Column:
    """A link against its page by RFC 3986; null if either is null or the link is malformed.

    Absolute http links without dot segments, nearly all of them, are their own result and never leave the JVM.
    """
    plain = href.rlike(r"^https?://[^/?#\[\]]+(/[^?#]*)?([?#].*)?$") & ~href.rlike(r"/\.\.?(/|$|[?#])")
    return F.when(plain, href).otherwise(_joined(base, F.when(~plain, href)))
