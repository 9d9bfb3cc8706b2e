"""Page markdown to fragments, continuation decisions and stitched articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

PAGE = ["document_key", "page_number"]
REASONS = {
    "unknown": "unknown fragment source order",
    "self": "cannot match a fragment to itself",
    "used": "fragment already matched by an earlier accepted pair",
    "pair": "fragments are not a valid continuation pair",
    "ok": "accepted continuation pair",
}


def fragments(pages: DataFrame) -> DataFrame:
    """(document_key, page_number, source_order, title, body_text, continued_to_page, continued_from_page).

    A heading opens a section of its page; bylines and other lines join the open
    one, lines before the first heading belong to none.  Sections without a body
    and teasers go before source_order counts what is left of the document.
    """
    line = tx.strip(F.col("line"))
    rows = pages.select(*PAGE, F.posexplode(tx.lines(F.col("markdown_text"))).alias("pos", "line")).select(*PAGE, "pos", line.alias("line")).filter("line != ''")
    bare = tx.strip(F.regexp_replace("line", "^#+", ""))
    marked = rows.withColumn("heading", F.when(F.col("line").startswith("#"), bare))
    kind = F.when(F.col("heading").isNull(), "body").when(F.col("heading") == "", "none").when(tx.is_byline_heading(F.col("heading")), "byline").when(tx.is_noise_heading(F.col("heading")), "none").otherwise("open")
    typed = marked.withColumn("kind", kind).filter("kind != 'none'")
    so_far = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sections = typed.withColumn("section", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(so_far)).filter("section > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("kind") != "open", F.struct("pos", F.coalesce("heading", "line").alias("line")))))
    whole = sections.groupBy(*PAGE, "section").agg(F.max(F.when(F.col("kind") == "open", F.col("heading"))).alias("title"), F.transform(body, lambda x: x["line"]).alias("body"))
    kept = whole.filter((F.size("body") > 0) & ~tx.is_teaser(F.col("body"))).withColumn("body_text", F.array_join("body", "\n"))
    order = F.row_number().over(Window.partitionBy("document_key").orderBy("page_number", "section"))
    return kept.select("document_key", "page_number", order.alias("source_order"), "title", "body_text", tx.continued_to_page(F.col("body_text")).alias("continued_to_page"), tx.continued_from_page(F.col("body_text")).alias("continued_from_page"))


def candidates(frags: DataFrame) -> DataFrame:
    """Only fragments with a continuation mark are shown to a matcher."""
    return frags.filter("continued_to_page != '' or continued_from_page != ''")


def decisions(matches: DataFrame, frags: DataFrame) -> DataFrame:
    """(document_key, seq, front, back, decision_status, decision_reason) of each raw match.

    ``matches``: (document_key, seq, front, back).  What is decidable a pair comes
    from joins; use-once is a fold over a document's pairs, by built-in functions.
    """
    side = lambda name: frags.select("document_key", F.col("source_order").alias(name), F.col("continued_to_page" if name == "front" else "continued_from_page").alias(f"{name}_mark"))
    known = matches.join(side("front"), ["document_key", "front"], "left").join(side("back"), ["document_key", "back"], "left")
    fault = F.when(F.col("front_mark").isNull() | F.col("back_mark").isNull(), "unknown").when(F.col("front") == F.col("back"), "self")
    weak = (F.col("front_mark") == "") | (F.col("back_mark") == "")
    pair = F.struct("seq", "front", "back", F.coalesce(fault, F.lit("")).alias("fault"), F.coalesce(weak, F.lit(False)).alias("weak"))
    listed = known.groupBy("document_key").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<string>").alias("said"))

    def step(acc: Column, p: Column) -> Column:
        met = F.array_contains(acc["used"], p["front"]) | F.array_contains(acc["used"], p["back"])
        said = F.when(p["fault"] != "", p["fault"]).when(met, "used").when(p["weak"], "pair").otherwise("ok")
        used = F.when(said == "ok", F.concat(acc["used"], F.array(p["front"].cast("long"), p["back"].cast("long")))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["said"], F.array(said)).alias("said"))

    # Of each document the decisions in order, carried by one aggregate.
    told = listed.withColumn("said", F.aggregate("pairs", start, step)["said"]).select("document_key", F.explode(F.arrays_zip("pairs", "said")).alias("x"))
    said = F.col("x.said")
    reasons = F.create_map(*[F.lit(v) for kv in REASONS.items() for v in kv])
    return told.select("document_key", F.col("x.pairs.seq").cast("long").alias("seq"), F.col("x.pairs.front").cast("long").alias("front"), F.col("x.pairs.back").cast("long").alias("back"), F.when(said == "ok", "accepted").when(said == "used", "ignored").otherwise("invalid").alias("decision_status"), reasons[said].alias("decision_reason"))


def stitch(frags: DataFrame, decided: DataFrame) -> DataFrame:
    """Articles: accepted fronts with their backs, all other fragments alone."""
    pairs = decided.filter("decision_status = 'accepted'").select("document_key", "front", "back")
    alone = frags.join(pairs.select("document_key", F.col("back").alias("source_order")), ["document_key", "source_order"], "left_anti")
    back = frags.select("document_key", F.col("source_order").alias("back"), F.col("body_text").alias("back_body"))
    met = alone.join(pairs.withColumnRenamed("front", "source_order"), ["document_key", "source_order"], "left").join(back, ["document_key", "back"], "left")
    two = F.col("back").isNotNull()
    role = lambda order, name, i: F.struct(order.cast("int").alias("source_order"), F.lit(name).alias("fragment_role"), F.lit(i).alias("sequence_index"))
    sources = F.when(two, F.array(role(F.col("source_order"), "front", 1), role(F.col("back"), "back", 2))).otherwise(F.array(role(F.col("source_order"), "standalone", 1)))
    order = F.row_number().over(Window.partitionBy("document_key").orderBy("source_order"))
    return met.select("document_key", order.alias("article_order"), F.col("source_order").alias("primary_source_order"), F.when(two, 2).otherwise(1).alias("source_fragment_count"), "title", F.when(two, tx.merged_body(F.col("body_text"), F.col("back_body"))).otherwise(F.col("body_text")).alias("body_text"), sources.alias("source_fragments"))


def matched_by(frags: DataFrame, matcher) -> DataFrame:
    """(document_key, seq, front, back) from an injected matcher, a call a document.

    ``matcher``: list of fragments (dicts) -> pairs; if it raises, there are none.
    """
    key = dict(frags.dtypes)["document_key"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("source_order")
        try:
            pairs = [(int(a), int(b)) for a, b in matcher(rows.to_dict("records"))]
        except Exception:  # noqa: BLE001  a matcher that fails leaves fragments unmerged
            pairs = []
        if not pairs:
            return pd.DataFrame()
        return pd.DataFrame({"document_key": [rows["document_key"].iloc[0]] * len(pairs), "seq": range(len(pairs)), "front": [p[0] for p in pairs], "back": [p[1] for p in pairs]})

    return candidates(frags).groupBy("document_key").applyInPandas(run, f"document_key {key}, seq long, front long, back long")


def page_markers(frags_or_pages: DataFrame) -> DataFrame:
    """One markdown a document, each page under a marker with its number."""
    part = F.concat(F.lit("<!-- PDF_PAGE_NUMBER: "), F.col("page_number").cast("string"), F.lit(" -->\n"), F.coalesce("markdown_text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("page_number", part.alias("text"))))
    return frags_or_pages.groupBy("document_key").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("markdown_text"))

