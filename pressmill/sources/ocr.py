"""Pages through a layout service in batches, with a resumable state table.

Clients are injected: ``make()`` gives one inside a task, with ``submit(names) ->
batch id`` and ``result(batch id) -> {name: markdown or None}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mail import batches_of

STATE = "document_key string, page_number int, file_name string, batch_id string, state string, markdown_text string"
LOCAL = r"(?i)^(?![a-z][a-z0-9+.-]*://)[^\s]+\.(?:png|jpe?g|gif|webp|bmp)$"


def page_files(documents: DataFrame) -> DataFrame:
    """(document_key, page_number, file_name) from (document_key, total_pages): pages from 1."""
    pages = documents.filter("total_pages > 0").select("document_key", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_number"))
    return pages.withColumn("file_name", F.format_string("page-%04d.pdf", "page_number"))


def unfinished(files: DataFrame, state: DataFrame) -> DataFrame:
    """(document_key, file_names): what each document still lacks, in order."""
    named = files.groupBy("document_key").agg(F.sort_array(F.collect_set("file_name")).alias("every"))
    done = state.filter("state = 'done'").groupBy("document_key").agg(F.collect_set("file_name").alias("ready"))
    left = F.array_except("every", F.coalesce("ready", F.array().cast("array<string>")))
    return named.join(done, "document_key", "left").select("document_key", left.alias("file_names")).filter(F.size("file_names") > 0)


def batch_ids(state: DataFrame) -> DataFrame:
    """(document_key, batch_ids): the batches of a document, each at its first page."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "batch_id"))), lambda x: x["batch_id"])
    return state.filter("batch_id is not null").groupBy("document_key").agg(F.array_distinct(listed).alias("batch_ids"))


def submitted(files: DataFrame, state: DataFrame, make: Callable, size: int = 30) -> DataFrame:
    """State rows of pages sent now: those without a row, at most ``size`` a batch."""
    rest = batches_of(files.join(state.select("document_key", "page_number"), ["document_key", "page_number"], "left_anti"), ["page_number"], size)
    kind = dict(files.dtypes)["document_key"]

    def send(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("page_number")
        return batch.assign(batch_id=make().submit(batch["file_name"].tolist()))[["document_key", "page_number", "file_name", "batch_id"]]

    sent = rest.groupBy("document_key", "batch").applyInPandas(send, f"document_key {kind}, page_number int, file_name string, batch_id string")
    return sent.select("*", F.lit("submitted").alias("state"), F.lit(None).cast("string").alias("markdown_text"))


def polled(state: DataFrame, make: Callable) -> DataFrame:
    """``state`` after one look at each open batch: pages with a text are done."""
    kind = dict(state.dtypes)["document_key"]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            rows = [(k, b, name, text) for k, b in frame.itertuples(index=False) for name, text in client.result(b).items() if text is not None]
            yield pd.DataFrame(rows, columns=["k", "b", "name", "text"])

    found = state.filter("state = 'submitted'").select("document_key", "batch_id").distinct().mapInPandas(look, f"k {kind}, b string, name string, text string")
    met = state.join(found, (F.col("document_key") == F.col("k")) & (F.col("batch_id") == F.col("b")) & (F.col("file_name") == F.col("name")), "left")
    new = F.col("text").isNotNull() & (F.col("state") == "submitted")
    return met.select("document_key", "page_number", "file_name", "batch_id", F.when(new, "done").otherwise(F.col("state")).alias("state"), F.when(new, F.col("text")).otherwise(F.col("markdown_text")).alias("markdown_text"))


def resumed(files: DataFrame, state: DataFrame, make: Callable, stored: Callable, polls: int = 10, size: int = 30) -> DataFrame:
    """Send what was never sent, then poll until all is done or ``polls`` are over.

    Each state is written by ``stored``: a run that dies goes on where it was."""
    state = stored(state.unionByName(submitted(files, state, make, size)))
    for _ in range(polls):
        if state.filter("state != 'done'").isEmpty():
            break
        state = stored(polled(state, make))
    return state


def layout_blocks(spark: SparkSession, folder: str, each: bool = False) -> DataFrame:
    """(file, block_index, type, text_level, page_idx, bbox, text, img_path) of the first
    content list by name in ``folder`` and below; none: no rows.  What is no object is dropped.

    ``each``: of every folder in ``folder``, whose name is its ``document_key``, instead."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_content_list.json").option("recursiveFileLookup", "true").load(folder)
    if each:
        root = re.escape(folder.rstrip("/").removeprefix("file://"))
        named = files.withColumn("document_key", F.regexp_extract("path", rf"{root}/([^/]+)/", 1)).filter("document_key != ''")
        first = named.groupBy("document_key").agg(F.min("path").alias("first"))
        first = named.join(first, "document_key").filter("path = first").select("document_key", "path", F.decode("content", "UTF-8").alias("j"))
    else:
        first = files.orderBy("path").limit(1).select("path", F.decode("content", "UTF-8").alias("j"))
    key = ["document_key"] if each else []
    block = "struct<type:string,text_level:int,page_idx:int,bbox:array<double>,text:string,img_path:string>"
    items = first.select(*key, F.col("path").alias("file"), F.posexplode(F.from_json("j", "array<string>")).alias("block_index", "item")).filter(F.ltrim("item").startswith("{"))
    b = items.select(*key, "file", "block_index", F.from_json("item", block).alias("b"))
    text = lambda c: F.coalesce(f"b.{c}", F.lit("")).alias(c)
    return b.select(*key, "file", "block_index", text("type"), F.coalesce("b.text_level", F.lit(0)).alias("text_level"), F.coalesce("b.page_idx", F.lit(0)).alias("page_idx"), F.coalesce("b.bbox", F.array().cast("array<double>")).alias("bbox"), text("text"), text("img_path"))


def relative_path(value: Column, page_dir: Column, merged_dir: Column) -> Column:
    """A page's local image path as seen from the merged file's folder.

    Addresses stay; paths that are there already stay; ``.`` and ``..`` are folded."""
    plain = F.regexp_replace(F.trim(value), r"^[\"']+|[\"']+$", "")
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(page_dir, F.lit("/"), plain))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    full = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))
    inside = F.concat(merged_dir, F.lit("/"))
    seen = F.when(full.startswith(inside), F.substring(full, F.length(inside) + 1, F.length(full))).otherwise(full)
    return F.when(~plain.rlike(LOCAL), value).when(plain.startswith("page-markdown/"), plain).otherwise(seen)


def with_relative_images(markdown: Column, page_dir: Column, merged_dir: Column) -> Column:
    """Image marks and bare image lines of a page point from the merged file's folder."""
    mark = r"^(.*?!\[[^\]]*\]\()([^)]+)(\).*)$"

    def line(x: Column) -> Column:
        one = F.concat(F.regexp_extract(x, mark, 1), relative_path(F.regexp_extract(x, mark, 2), page_dir, merged_dir), F.regexp_extract(x, mark, 3))
        bare = F.concat(F.regexp_extract(x, r"^\s*", 0), relative_path(F.trim(x), page_dir, merged_dir), F.regexp_extract(x, r"\s*$", 0))
        return F.when(x.rlike(mark), one).when(F.trim(x).rlike(LOCAL), bare).otherwise(x)

    return F.array_join(F.transform(F.split(markdown, "\r\n|\r|\n"), line), "\n")
