"""Readable text of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def readable(html: Column) -> Column:
    """The page without scripts, styles, comments and tags, white space folded."""
    body = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
