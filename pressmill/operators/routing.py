"""Which of three paths parses a document, and what is kept of a parse for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTES = ("outline", "layout", "markdown")


def is_outline_edition(producer: Column, title: Column, leaves: Column, sample: Column) -> Column:
    """Made by the converter, with three leaves or more, and named or linked as an edition."""
    named = F.lower(title).contains("economist") | F.lower(sample).contains("economist.com")
    return F.coalesce(F.lower(producer).contains("calibre") & (leaves >= 3) & F.coalesce(named, F.lit(False)), F.lit(False))


def is_layout_edition(producer: Column, sample: Column) -> Column:
    """Its name and contents are in the first pages, and no converter made it."""
    made = F.lower(F.coalesce(producer, F.lit(""))).contains("calibre")
    return F.coalesce(F.lower(sample).contains("bloomberg businessweek") & sample.contains("Contents") & ~made, F.lit(False))


def routed(files: DataFrame) -> DataFrame:
    """``files`` (producer, title, leaves, outline_sample, layout_sample) with a ``route``.

    Unreadable files have nulls there, and go the last way."""
    outline = is_outline_edition(F.col("producer"), F.col("title"), F.col("leaves"), F.col("outline_sample"))
    layout = is_layout_edition(F.col("producer"), F.col("layout_sample"))
    return files.withColumn("route", F.when(outline, ROUTES[0]).when(layout, ROUTES[1]).otherwise(ROUTES[2]))


def parsed(files: DataFrame, ways: dict) -> DataFrame:
    """Each file by its route's function of the routed rows; results by name as one table."""
    told, out = routed(files), None
    for name in ROUTES:
        part = ways[name](told.filter(F.col("route") == name)).withColumn("route", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def page_articles(articles: DataFrame) -> DataFrame:
    """The older, flat form of stitched articles: one row with its first page."""
    return articles.select("document_key", "article_order", "title", "body_text", F.coalesce(F.array_min("pages"), F.lit(0)).alias("page_number"))


def debug_text(articles: DataFrame, contents: DataFrame, least: float = 0.6) -> DataFrame:
    """(document_key, debug_text, suspicious): articles in order, with a warning in
    front where there are under ``least`` of the entries its contents list.

    ``articles``: (document_key, article_order, title, section, start_page, end_page,
    body_text); ``contents``: (document_key, entries)."""
    head = F.concat(F.lit("<!-- ARTICLE: "), "title", F.lit(" | section="), "section", F.lit(" | pages="), F.col("start_page").cast("string"), F.lit("-"), (F.col("end_page") - 1).cast("string"), F.lit(" -->\n"), "body_text", F.lit("\n"))
    texts = articles.groupBy("document_key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_order", head.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    met = texts.join(contents, "document_key", "left")
    few = F.coalesce((F.col("entries") > 0) & (F.col("n") < least * F.col("entries")), F.lit(False))
    warning = F.concat(F.lit("<!-- WARNING: "), F.col("n").cast("string"), F.lit(" articles from "), F.col("entries").cast("string"), F.lit(" Contents entries; titles may be missing -->\n"))
    return met.select("document_key", F.when(few, F.concat(warning, F.col("text"))).otherwise(F.col("text")).alias("debug_text"), few.alias("suspicious"))
