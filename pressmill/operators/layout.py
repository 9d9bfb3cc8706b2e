"""Layout blocks to articles: page kinds, boundaries, assembly.

Blocks: (document_key, block_index, type, text_level, page_idx, bbox struct<x0,y0,x1,y1>, text, img_path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.storage import stored

#: Section labels, rubrics and first characters that are no titles.
SECTION_WORDS = ("remarks", "in context", "in view", "pursuits", "exit strategy", "contents", "contributors", "cover")
RUBRICS = ("contributors", "pursuits", "in context", "pursuits picks", "pricing the stockpile")
NOT_TITLES = "●○\"“”("
MASTHEAD = "bloomberg businessweek"
HEADERS, RUNNING = ("header", "page_header"), ("header", "page_header", "footer", "page_footer")
#: Block numbers of a bin.
BIN = 4096
HEADLINE, QUOTE, PARAGRAPH, NEAR, SAME_SIZE, CONTENTS_PAGES = 30, 15, 120, 2, 40, 12


def with_keys(blocks: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    b = blocks.withColumn("text", text).withColumn("key", tx.title_key(F.col("text"))).withColumn("said", tx.strip(F.col("text")))
    byline = F.substring("said", 1, 1).isin("●", "○") & F.substring("key", 1, 6).contains("by")
    return b.withColumn("byline", byline).withColumn("height", F.col("bbox.y1") - F.col("bbox.y0"))


def running_sections(keyed: DataFrame) -> DataFrame:
    """(document_key, key): running heads that at least two pages show."""
    heads = keyed.filter(F.col("type").isin(*RUNNING) & (F.col("said") != "") & (F.col("key") != "") & (F.col("key") != MASTHEAD))
    return heads.groupBy("document_key", "key").agg(F.count_distinct("page_idx").alias("n")).filter("n >= 2").select("document_key", "key")


def page_kinds(keyed: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_key, page_idx, kind, section) of every page that has blocks.

    Running heads alone meet the sections and go to their pages as rows of their own,
    so that texts are shuffled once."""
    shown = keyed.filter(F.col("type").isin(*RUNNING)).join(sections, ["document_key", "key"], "left_semi")
    rows = keyed.select("document_key", "page_idx", "type", "key", "byline", F.struct("block_index", "text").alias("block"))
    rows = rows.unionByName(shown.select("document_key", "page_idx", F.struct("block_index", "said").alias("shown")), allowMissingColumns=True)
    page = rows.groupBy("document_key", "page_idx").agg(
        F.bool_or(F.col("type") == "page_number").alias("folio"),
        F.bool_or("byline").alias("byline"),
        F.min("shown").alias("running"),
        F.bool_or(F.col("type").isin(*HEADERS) & (F.col("key") == "advertisement")).alias("advertorial"),
        F.array_join(F.transform(F.array_sort(F.collect_list("block")), lambda x: x["text"]), " ").alias("page_text"),
    )
    section = F.coalesce("running.said", F.lit(""))
    ad = F.col("advertorial") | (~F.col("folio") & (F.col("page_text").rlike(tx.AD_TOKENS) | ((section == "") & ~F.col("byline"))))
    return page.select("document_key", "page_idx", F.when(ad, "ad").otherwise("editorial").alias("kind"), F.when(ad, "").otherwise(section).alias("section"))


def pull_quotes(keyed: DataFrame) -> DataFrame:
    """(document_key, block_index) of headings that a long paragraph nearby contains.

    Headings, which are short, are dealt to the pages within reach, so that the join is by page."""
    reach = F.explode(F.sequence(F.col("page_idx") - NEAR, F.col("page_idx") + NEAR)).alias("page_idx")
    head = keyed.filter((F.coalesce("text_level", F.lit(0)) != 0) & (F.length("key") >= QUOTE)).select("document_key", reach, "block_index", F.col("key").alias("needle"))
    body = keyed.filter(F.col("type").isin("text", "paragraph") & (F.coalesce("text_level", F.lit(0)) == 0) & (F.length("text") > PARAGRAPH))
    near = body.select("document_key", "page_idx", F.col("key").alias("hay"))
    return head.join(near, ["document_key", "page_idx"]).filter(F.col("hay").contains(F.col("needle"))).select("document_key", "block_index").distinct()


def boundaries(keyed: DataFrame, kinds: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_key, title, page_idx, block_index): the topmost headline of a page,
    lines of one headline joined with the head that opened it."""
    ok = (F.coalesce("text_level", F.lit(0)) != 0) & (F.col("height") >= HEADLINE) & (F.col("said") != "") & ~F.col("said").rlike(r"^\p{Nd}+$")
    ok = ok & ~F.substring("said", 1, 1).isin(*NOT_TITLES) & ~F.col("key").isin(*RUBRICS)
    rows = keyed.filter(ok).join(kinds.filter("kind = 'editorial'").select("document_key", "page_idx"), ["document_key", "page_idx"], "left_semi")
    rows = rows.join(sections, ["document_key", "key"], "left_anti").join(pull_quotes(keyed), ["document_key", "block_index"], "left_anti")
    top = rows.groupBy("document_key", "page_idx").agg(F.min(F.struct(F.col("bbox.y0").alias("y"), "block_index", "height", "said")).alias("x"))
    heads = top.select("document_key", "page_idx", "x.block_index", "x.height", tx.demirror(F.col("x.said")).alias("title"), F.lit(False).alias("byline"))
    lines = keyed.filter("byline").select("document_key", "page_idx", "block_index", "height", F.lit("").alias("title"), F.lit(True).alias("byline"))
    return split_headlines(heads.unionByName(lines))


def split_headlines(rows: DataFrame) -> DataFrame:
    """(document_key, title, page_idx, block_index): headlines, of which those that go on
    from the one before (no byline between, a page on at most, of like height) are joined.

    ``rows``: (document_key, page_idx, block_index, height, title, byline).  A fold over a
    document's rows in order, by built-in functions: the heads that are done, the open
    one, and whether a byline has parted it from what follows."""
    head = "struct<block_index: int, page_idx: int, height: double, title: string>"
    row = F.struct("block_index", "byline", F.col("page_idx").cast("int").alias("page_idx"), F.col("height").cast("double").alias("height"), "title")
    listed = rows.groupBy("document_key").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast(f"array<{head}>").alias("done"), F.lit(None).cast(head).alias("open"), F.lit(True).alias("parted"))

    def step(acc: Column, r: Column) -> Column:
        last = acc["open"]
        parted = acc["parted"] | last.isNull() | (r["block_index"] > last["block_index"])
        goes_on = ~acc["parted"] & last.isNotNull() & (r["page_idx"] - last["page_idx"]).between(0, 1) & (F.abs(r["height"] - last["height"]) < SAME_SIZE)
        new = F.struct(r["block_index"].cast("int").alias("block_index"), r["page_idx"].alias("page_idx"), r["height"].alias("height"), r["title"].alias("title"))
        longer = F.struct(last["block_index"].alias("block_index"), last["page_idx"].alias("page_idx"), last["height"].alias("height"), F.concat(last["title"], F.lit(" "), r["title"]).alias("title"))
        done = F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        state = lambda d, o, p: F.struct(d.alias("done"), o.cast(head).alias("open"), p.alias("parted"))
        # Bylines count from the open head's own place.
        return F.when(r["byline"], state(acc["done"], last, parted)).when(F.coalesce(goes_on, F.lit(False)), state(acc["done"], longer, acc["parted"])).otherwise(state(done, new, F.lit(False)))

    every = F.aggregate("rows", start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return listed.select("document_key", F.explode(every).alias("x")).select("document_key", "x.title", "x.page_idx", "x.block_index")


def owners(blocks: DataFrame, heads: DataFrame, size: int = BIN) -> DataFrame:
    """``blocks`` with ``head``, their own if one begins there, and ``owner``, the last
    that begins at or before them; blocks before a document's first head go.

    ``heads``: (document_key, block_index, head struct), each at a block.  A range join
    by bins of ``size`` numbers: within a bin, where heads are rows before their blocks,
    the last head so far, before it the last of the bins before, so that a document of
    any length is many tasks' work and blocks are shuffled once."""
    binned = lambda df: df.withColumn("bin", F.floor(F.col("block_index") / size))
    rows = binned(blocks)
    marks = binned(heads).filter("document_key is not null").select("document_key", "bin", "block_index", F.struct("block_index", "head").alias("mark"))
    inside = Window.partitionBy("document_key", "bin").orderBy("block_index", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("there", F.lit(True)).unionByName(marks, allowMissingColumns=True).withColumn("near", F.last("mark", ignorenulls=True).over(inside))
    own = F.when(F.col("near.block_index") == F.col("block_index"), F.col("near.head"))
    inner = both.filter("there").withColumn("head", own).withColumn("near", F.col("near.head")).drop("mark", "there")
    # A row a bin that has heads; each bin is reached from the next ones up to the next such.
    tops = binned(heads).groupBy("document_key", "bin").agg(F.max_by("head", "block_index").alias("before"))
    tops = tops.withColumn("until", F.lead("bin").over(Window.partitionBy("document_key").orderBy("bin")))
    used = rows.select("document_key", "bin").distinct()
    first = used.join(tops.withColumnRenamed("bin", "top"), "document_key").filter((F.col("top") < F.col("bin")) & (F.coalesce(F.col("until") >= F.col("bin"), F.lit(True)))).select("document_key", "bin", "before")
    met = inner.join(first, ["document_key", "bin"], "left").withColumn("owner", F.coalesce("near", "before"))
    return met.filter("owner is not null").drop("bin", "near", "before")


def assemble(keyed: DataFrame, bounds: DataFrame, kinds: DataFrame) -> DataFrame:
    """Articles: each block goes to the last boundary before it."""
    heads = bounds.select("document_key", "block_index", F.struct("title", "page_idx", "block_index").alias("head"))
    owned = owners(keyed, heads).join(kinds, ["document_key", "page_idx"], "left").withColumn("live", F.col("head").isNull() & (F.col("kind") == "editorial"))
    part = F.when(F.col("live") & F.col("type").isin("text", "paragraph"), F.struct("block_index", tx.repair_dropcap(F.col("said")).alias("part")))
    image = F.when(F.col("live") & F.col("type").isin("image", "chart") & (F.coalesce("img_path", F.lit("")) != ""), F.struct("block_index", F.concat(F.lit("![](images/"), F.element_at(F.split("img_path", "/"), -1), F.lit(")")).alias("part")))
    listed = lambda c, by: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["part"]), lambda x: x != ""), by)
    whole = owned.groupBy("document_key", "owner").agg(
        tx.trim_end_marker(listed(part, "\n\n")).alias("body"), listed(image, "\n").alias("images"),
        F.max(F.when(F.col("live"), F.col("page_idx"))).alias("last"), F.max(F.when(F.col("head").isNotNull(), F.coalesce("section", F.lit("")))).alias("section"))
    following = F.lead("owner.page_idx").over(Window.partitionBy("document_key").orderBy("owner.block_index"))
    ended = whole.withColumn("next_page", following)
    body = F.when(F.col("images") != "", F.concat("body", F.lit("\n\n"), "images")).otherwise(F.col("body"))
    end = F.coalesce(F.col("next_page") + 1, F.greatest(F.coalesce("last", F.col("owner.page_idx")), F.col("owner.page_idx")) + 2)
    out = ended.select("document_key", F.col("owner.title").alias("title"), F.coalesce("section", F.lit("")).alias("section"), (F.col("owner.page_idx") + 1).alias("start_page"), end.alias("end_page"), body.alias("body_text"))
    return out.filter(tx.strip(F.col("body_text")) != "")


def articles(blocks: DataFrame) -> DataFrame:
    keyed = stored(with_keys(blocks).drop("said"), "layout-blocks").withColumn("said", tx.strip(F.col("text")))  # read by every branch below
    sections = running_sections(keyed)
    kinds = page_kinds(keyed, sections)
    return assemble(keyed, boundaries(keyed, kinds, sections), kinds)


def contents(blocks: DataFrame) -> DataFrame:
    """(document_key, title, folio) of the contents pages, the first of each title.

    A title and its page stand on one line, or the page follows on a line of its own."""
    rows = blocks.filter((F.col("page_idx") < CONTENTS_PAGES) & F.col("type").isin("text", "paragraph", "title"))
    line = rows.select("document_key", "block_index", F.posexplode(tx.lines(F.col("text"))).alias("pos", "raw")).select("document_key", "block_index", "pos", tx.strip(F.col("raw")).alias("line")).filter("line != ''")
    joined, bare = r"(?U)^(.*\S)\s+(\d{1,3})$", r"(?U)^\d{1,3}$"
    w = Window.partitionBy("document_key", "block_index").orderBy("pos")
    open_title = F.when(~F.col("line").rlike(joined) & ~F.col("line").rlike(bare) & ~F.col("lkey").isin(*SECTION_WORDS), F.col("line")).otherwise("")
    # A bare page uses the line above it; a bare page that is itself a title needs one above that isn't used.
    typed = line.withColumn("lkey", tx.title_key(F.col("line"))).withColumn("open", open_title).withColumn("above", F.coalesce(F.lag("open").over(w), F.lit("")))
    title = F.when(F.col("line").rlike(bare) & (F.col("above") != ""), F.col("above")).when(F.col("line").rlike(joined), tx.match(F.col("line"), joined))
    folio = F.when(F.col("line").rlike(bare), F.col("line")).otherwise(tx.match(F.col("line"), joined, 2))
    found = typed.select("document_key", "block_index", "pos", title.alias("title"), folio.alias("folio")).filter("title is not null").withColumn("tkey", tx.title_key(F.col("title")))
    found = found.filter((F.col("tkey") != "") & ~F.col("tkey").isin(*SECTION_WORDS))
    first = found.groupBy("document_key", "tkey").agg(F.min(F.struct("block_index", "pos", "title", "folio")).alias("x"))
    return first.select("document_key", "x.title", F.col("x.folio").cast("int").alias("folio"))


def is_routed(signal: Column) -> Column:
    """A sniffer's verdict; a failed one counts as no."""
    return F.coalesce(signal, F.lit(False))
