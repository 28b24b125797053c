"""Links that point at a quotation inside a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Bounds of a quotation, characters that pages don't show, and files that no browser searches.
LONGEST, SHORTEST = 300, 12
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\ufeff]")
UNSEARCHED = (".pdf", ".xml", ".xsd", ".xbrl", ".zip", ".jpg", ".png", ".gif")


def _coded(part: str) -> str:
    return quote(part, safe="").replace("-", "%2D")


def fragment_link(url: str | None, passage: str | None) -> dict:
    """The URL with a text directive for the passage, a status and the kind (exact, range or truncated); no link unless the status is ok.

    The page's own query and fragment stay; a directive that the URL already has is replaced.
    """
    text = " ".join(INVISIBLE.sub("", (passage or "").replace("\u00a0", " ")).split())
    parts = urlsplit(url.strip()) if url and url.strip() else None
    checks = (
        ("unsupported_missing_url", parts is None),
        ("unsupported_non_absolute_url", parts is not None and (parts.scheme.lower() not in ("http", "https") or not parts.netloc)),
        ("unsupported_document_format", parts is not None and parts.path.lower().endswith(UNSEARCHED)),
        ("unsupported_empty_quote", not text),
        ("unsupported_quote_too_short", len(text) < SHORTEST),
    )
    status = next((name for name, holds in checks if holds), "ok")
    if status != "ok":
        return {"link": "", "status": status, "kind": ""}
    if len(text) <= LONGEST:
        directive, kind = _coded(text), "exact"
    else:
        # whole words only, from both ends
        first, last = text[: LONGEST // 2].rpartition(" ")[0].strip(), text[-(LONGEST // 2) :].partition(" ")[2].strip()
        first, last = first or text[: LONGEST // 2], last or text[-(LONGEST // 2) :]
        directive, kind = f"{_coded(first)},{_coded(last)}", "range"
    own = parts.fragment.split(":~:", 1)[0]
    return {"link": urlunsplit((*parts[:4], f"{own}:~:text={directive}")), "status": status, "kind": kind}


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("link", "status", "kind")]))
def text_fragment(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for urls, quotes in batches:
        yield pd.DataFrame([fragment_link(u, q) for u, q in zip(urls, quotes, strict=True)], columns=["link", "status", "kind"])
