"""Outline entries and edition pages to articles."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx

#: Navigation labels, the footer's wording and the dateline's form.
NAVIGATION = ("下一项", "上一项", "章节菜单", "主菜单")
MARK = "downloaded by calibre from"
FOOTER = rf"(?is)(?:This(?U:\s+)article(?U:\s+)was(?U:\s+))?{MARK}.*$"
PROMOTION = r"(?is)Subscribers to The Economist can sign up.*$"
DATELINE = r"(?U)\d{1,2}\s*[月⽉]\s*\d{1,2},?\s*\d{4}\s+\d{1,2}:\d{2}\s*[上下]午[ \t]*(?:\|[^\n]*)?"


def ranges(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_key, ordinal, title, section, start_page, end_page): leaves up to
    the next larger start of any entry, else past the last page."""
    later = Window.partitionBy("document_key").orderBy("start_page").rangeBetween(1, Window.unboundedFollowing)
    ends = outline.withColumn("next", F.min("start_page").over(later)).filter("is_leaf")
    out = ends.join(pages.select("document_key", "total_pages"), "document_key")
    return out.select("document_key", "ordinal", "title", "section", "start_page", F.coalesce("next", F.col("total_pages") + 1).alias("end_page"))


def is_navigation(line: Column) -> Column:
    any_of = "|".join(NAVIGATION)
    return line.rlike(any_of) & (tx.strip(F.regexp_replace(line, rf"{any_of}|\|", "")) == "")


def cleaned(raw: Column, folded: Column) -> Column:
    """The body without footer, promotion, datelines, navigation and end squares.

    ``folded`` is ``raw`` under NFKC, which decides about navigation lines only."""
    cut = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, FOOTER, ""), PROMOTION, ""), DATELINE, "")
    body = F.zip_with(tx.lines(cut(raw)), tx.lines(cut(folded)), lambda a, b: F.struct(a.alias("a"), tx.strip(F.replace(F.coalesce(b, a), F.lit("■"), F.lit(""))).alias("b")))
    kept = F.filter(body, lambda x: x["a"].isNotNull() & ~is_navigation(x["b"]))
    out = F.array_join(F.transform(kept, lambda x: F.regexp_replace(F.replace(x["a"], F.lit("■"), F.lit("")), r"(?U)\s+$", "")), "\n")
    return F.regexp_replace(tx.strip(out), r"\n{3,}", "\n\n")


def navigates(line: str) -> bool:
    """Labels and bars, and nothing else."""
    rest = unicodedata.normalize("NFKC", line)
    bare = re.sub("|".join(NAVIGATION), "", rest)
    return bare != rest and not bare.replace("|", "").strip()


@F.pandas_udf(T.StringType())
def source_url(raw: pd.Series) -> pd.Series:
    """The address behind the footer's mark, put together again where it wraps.

    The block that counts starts at the first line with text behind the mark and
    ends at an empty line or at one that only navigates (as NFKC folds it)."""

    def one(text: str | None) -> str:
        at = re.search(MARK, text or "", re.I)
        block = ""
        for line in map(str.strip, text[at.end() :].lstrip().splitlines() if at else ()):
            if not line or navigates(line):
                break
            block += line
        found = re.search(r"https?://\S+", block)
        return found[0] if found else ""

    return raw.map(one)


def edition_articles(outline: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """One article a leaf: its pages' text in order, cleaned; empty bodies go.

    ``texts``: (document_key, page_number, raw_text). Leaves are dealt to their pages, so the join is by page.
    """
    spans = ranges(outline, pages).select("*", F.explode(F.sequence("start_page", F.greatest(F.col("end_page") - 1, "start_page"))).alias("page_number"))
    met = spans.join(texts, ["document_key", "page_number"]).groupBy("document_key", "ordinal", "title", "section", "start_page", "end_page")
    raw = met.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "raw_text"))), lambda x: x["raw_text"]), "\n").alias("raw"))
    out = raw.withColumn("url", source_url("raw")).withColumn("folded", tx.folded(F.col("raw"))).withColumn("body_text", cleaned(F.col("raw"), F.col("folded"))).filter("body_text != ''")
    order = F.row_number().over(Window.partitionBy("document_key").orderBy("start_page", "ordinal"))
    return out.select("document_key", order.alias("article_order"), "title", "section", "start_page", "end_page", "body_text", "url")
