"""Segmentation, stitching and text functions on small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pressmill.functions import dates, text as tx
from pressmill.operators import layout, outline, segment


def pages(spark, *texts):
    return spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "document_key string, page_number int, markdown_text string")


def frags(spark, *texts):
    return segment.fragments(pages(spark, *texts)).orderBy("source_order").collect()


def test_markers(spark):
    one = frags(spark, "# Big Oil Explores\n\nText here\n\nPlease turn to page a7\n")
    assert [(r.continued_to_page, r.continued_from_page) for r in one] == [("A7", "")]
    assert frags(spark, "# Big Oil\n\nContinued from PageOne Friday after")[0].continued_from_page == "PageOne"
    assert frags(spark, "# Big Oil\n\nCONTINUED FROM PAGE A1 more")[0].continued_from_page == "PAGEA1"
    solid, hollow = frags(spark, "# A\n\nbody goes on ► 5\n\n# B\n\n◄ 4 body here"), frags(spark, "# A\n\nbody ▷ 5")
    assert [(r.continued_to_page, r.continued_from_page) for r in solid] == [("5", ""), ("", "4")] and hollow[0].continued_to_page == ""


def test_headings(spark):
    got = frags(spark, "lost line\n# Title\n\nsubtitle\n\n# BY COLLIN EATON\n\nbody\n\n# SPORTS\n\nstill body\n\n# ***\n\n# Next\n\nbody\n\n# Empty\n")
    assert [(r.title, r.body_text) for r in got] == [("Title", "subtitle\nBY COLLIN EATON\nbody\nstill body"), ("Next", "body")]


def test_teasers_and_pages(spark):
    teaser = "# In War's Grip\n\nA long way home ................. A1\n\nNot so fast ............ B2\n\n# Real\n\nreal body"
    got = frags(spark, teaser, "# Second\n\nmore", "text without heading")
    assert [(r.page_number, r.source_order, r.title) for r in got] == [(1, 1, "Real"), (2, 2, "Second")]


def test_decisions_and_stitching(spark):
    rows = [("d", i, 1, f"t{i}", b, to, fr) for i, b, to, fr in ((1, "front\nPlease turn to page A7", "A7", ""), (2, "Continued from page A1 back", "", "A1"), (3, "alone", "", ""), (4, "front two ► 9", "9", ""), (5, "◄ 4 rest", "", "4"))]
    f = spark.createDataFrame(rows, "document_key string, source_order int, page_number int, title string, body_text string, continued_to_page string, continued_from_page string")
    raw = [("d", n, a, b) for n, (a, b) in enumerate([(1, 9), (2, 2), (3, 5), (1, 2), (1, 5), (4, 5)])]
    decided = segment.decisions(spark.createDataFrame(raw, "document_key string, seq long, front long, back long"), f)
    assert [r.decision_status for r in decided.orderBy("seq").collect()] == ["invalid", "invalid", "invalid", "accepted", "ignored", "accepted"]
    got = segment.stitch(f, decided).orderBy("article_order").collect()
    assert [(r.article_order, r.primary_source_order, r.source_fragment_count, r.body_text) for r in got] == [(1, 1, 2, "front\nback"), (2, 3, 1, "alone"), (3, 4, 2, "front two\nrest")]
    assert [s.fragment_role for s in got[0].source_fragments] == ["front", "back"]


def test_failing_matcher_merges_nothing(spark):
    f = segment.fragments(pages(spark, "# A\n\nx\nPlease turn to page A7\n# B\n\nContinued from page A1 y"))

    def bad(_):
        raise RuntimeError

    assert segment.matched_by(f, bad).count() == 0
    assert [(r.front, r.back) for r in segment.matched_by(f, lambda rows: [(1, 2)]).collect()] == [(1, 2)]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_clean_text(spark):
    t = "a ![](img/one.png) b\n\nimg/two.JPG\n![x](https://e.x/far.png)\n![](img/one.png)"
    assert one(spark, tx.image_paths(F.col("t")), t=t) == ["img/one.png", "img/two.JPG"]
    assert one(spark, tx.clean_text(F.col("t")), t="line\n\n img/a.png \n ![](b.webp) rest ") == "line\nrest"


def test_titles(spark):
    assert one(spark, tx.demirror(F.col("t")), t="Big News Big News today") == "Big News today"
    assert one(spark, tx.repair_dropcap(F.col("t")), t="B ut Jassy") == "But Jassy" and one(spark, tx.repair_dropcap(F.col("t")), t="A dog") == "A dog"
    assert one(spark, tx.trim_end_marker(F.col("t")), t="end. <BW> —With help") == "end."
    assert one(spark, tx.title_key(F.col("t")), t="  Ｔhe A.I.  Issue! ") == "the a i issue"


@pytest.mark.parametrize(
    ("name", "date", "source"),
    [("WSJ-2026-05-06.pdf", "2026-05-06", "WSJ"), ("The Economist USA - May 2, 2026.pdf", "2026-05-02", "经济学人"), ("Bloomberg Businessweek June 2026.pdf", "2026-06-01", "彭博商业周刊"), ("FT-5-6.pdf", "2026-05-06", "FT"), ("X-2026-13-40.pdf", "", "X-2026-13-40"), ("plain.pdf", "", "plain"), ("TE-2026-05-02-PDF-WEB.pdf", "2026-05-02", "经济学人")],
)
def test_filenames(spark, name, date, source):
    assert one(spark, dates.filename_date(F.col("n"), F.lit(None).cast("string"), 2026), n=name) == date
    assert one(spark, dates.source_name(F.col("n")), n=name) == source


def test_mail_date_gives_the_year(spark):
    assert one(spark, dates.filename_date(F.col("n"), F.lit("1735660800000"), 1999), n="FT-1-2.pdf") == "2025-01-02"


def test_outline_ranges(spark):
    rows = [("d", i, t, "", s, leaf) for i, (t, s, leaf) in enumerate([("Leaders", 16, False), ("The World Cup paradox", 17, True), ("Behind the wheel", 36, True), ("Letters", 40, False), ("Premier League", 41, True)])]
    got = outline.ranges(spark.createDataFrame(rows, "document_key string, ordinal int, title string, section string, start_page int, is_leaf boolean"), spark.createDataFrame([("d", 47)], "document_key string, total_pages int"))
    assert sorted((r.start_page, r.end_page) for r in got.collect()) == [(17, 36), (36, 40), (41, 48)]


def test_edition_text(spark):
    raw = "主菜单 | 下一项\nTitle\n5月 2, 2026 10:30 上午 | City\nBody goes on. ■\n\n\n\nEnd\nThis article was downloaded by calibre from https://e.x/a\nb/c\n\n主菜单"
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.select(outline.cleaned(F.col("raw"), tx.nfkc("raw")).alias("b"), outline.source_url("raw").alias("u")).first()
    assert got.u == "https://e.x/ab/c" and "calibre" not in got.b and "主菜单" not in got.b and "■" not in got.b and "上午" not in got.b and "\n\n\n" not in got.b


def blocks(spark, rows):
    full = [("d", i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(k, i, t, lv, p, {"x0": 0, "y0": y, "x1": 9, "y1": y + h}, s, img) for k, i, t, lv, p, y, h, s, img in full], "document_key string, block_index int, type string, text_level int, page_idx int, bbox struct<x0:int,y0:int,x1:int,y1:int>, text string, img_path string")


def test_layout(spark):
    folio = lambda p: ("page_number", 0, p, 0, 5, "1", "")
    long = "It was a long road for all of them, and they said so: nobody expected the river to rise that fast, not even those who had lived beside it for years."
    rows = [
        ("header", 0, 0, 0, 5, "The AI Issue", ""), folio(0), ("title", 1, 0, 10, 99, "Meta Goes Big", ""), ("header", 0, 1, 0, 5, "The AI Issue", ""), folio(1), ("title", 1, 1, 10, 102, "on the Bayou", ""),
        ("text", 0, 1, 200, 20, "B ut it works. <BW> —With help", ""), ("image", 0, 1, 300, 20, "", "x/pic.jpg"),
        folio(2), ("text", 0, 2, 0, 20, "● By A. Writer", ""), ("title", 1, 2, 50, 60, "Second Story", ""), ("title", 1, 2, 120, 60, "nobody expected the river to rise", ""), ("text", 0, 2, 200, 20, long, ""),
        ("text", 0, 3, 0, 20, "Learn more at x", ""), ("header", 0, 4, 0, 5, "ADVERTISEMENT", ""), folio(4), ("title", 1, 4, 50, 60, "Buy now", ""),
    ]
    b = blocks(spark, rows)
    keyed = layout.with_keys(b)
    kinds = {r.page_idx: r.kind for r in layout.page_kinds(keyed, layout.running_sections(keyed)).collect()}
    assert kinds == {0: "editorial", 1: "editorial", 2: "editorial", 3: "ad", 4: "ad"}
    assert [r.block_index for r in layout.pull_quotes(keyed).collect()] == [11]
    got = sorted(layout.articles(b).collect(), key=lambda r: r.start_page)
    assert [(r.title, r.section, r.start_page, r.end_page) for r in got] == [("Meta Goes Big on the Bayou", "The AI Issue", 1, 3), ("Second Story", "", 3, 4)]
    assert got[0].body_text.startswith("But it works.") and got[0].body_text.endswith("![](images/pic.jpg)")


def test_contents(spark):
    b = blocks(spark, [("text", 0, 1, 0, 5, "Remarks\nSalmon Farming, Now on Land 21\nA Title\n34\nsalmon farming now on land 99", ""), ("text", 0, 12, 0, 5, "Too Late 50", "")])
    assert sorted((r.title, r.folio) for r in layout.contents(b).collect()) == [("A Title", 34), ("Salmon Farming, Now on Land", 21)]


def test_lines_are_python_s(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\r\n\x0c\x1c\x85 ") for _ in range(12)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.lines(F.col("t")).alias("l"), "t").collect()
    assert all([x for x in r.l if x] == [x for x in r.t.splitlines() if x] for r in got)
    assert re.sub("x", "", "x") == ""


def test_strip_takes_every_space_and_lines_may_be_parted_by_any_end(spark):
    rows = [(c, f"{chr(c)}{chr(c)} x{chr(c)}y {chr(c)}") for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(rows, "c int, t string")
    assert df.filter(tx.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    kept = lambda c: F.array_join(F.filter(F.transform(c, lambda x: tx.strip(x)), lambda x: x != ""), "|")
    assert df.filter(kept(tx.parts(F.col("t"))) != kept(tx.lines(F.col("t")))).count() == 0
    assert one(spark, tx.clean_text(F.col("t")), t="a\r\n\r\nb\x0bc\u2028") == "a\nb\nc"


def test_texts_without_images_meet_no_pattern_of_images(spark):
    """Patterns that run over every character of every line made most of C1's time."""
    text = spark.range(1).select(F.lit("a").alias("t"))
    plan = text.select(tx.clean_text(F.col("t")).alias("c"), tx.image_paths(F.col("t")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert "(?U)^" not in plan and "CASE WHEN contains(" in plan.replace("Contains", "contains")


def test_texts_of_blocks_are_shuffled_once_a_step(spark):
    """Joins with sections and heads carried all texts, and each paragraph went to five pages."""
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    blocks = spark.createDataFrame([], f"document_key long, block_index int, type string, text_level int, page_idx int, bbox {box}, text string, img_path string")
    keyed = layout.with_keys(blocks)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "LeftOuter" not in plan(layout.page_kinds(keyed, layout.running_sections(keyed)))
    heads = blocks.select("document_key", "block_index", F.struct("block_index").alias("head"))
    assert plan(layout.owners(blocks, heads)).count("LeftOuter") == 1
    dealt = [line for line in plan(layout.pull_quotes(keyed)).splitlines() if "explode(sequence" in line]
    assert dealt and all("hay" not in line for line in dealt)


def test_owners_begin_at_their_own_block_whatever_the_bins(spark):
    blocks = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(12)], "document_key long, block_index int")
    heads = spark.createDataFrame([(1, 2), (1, 3), (2, 7)], "document_key long, block_index int").withColumn("head", F.struct("block_index"))
    want = {(d, i): max((h for e, h in ((1, 2), (1, 3), (2, 7)) if e == d and h <= i), default=None) for d in (1, 2) for i in range(12)}
    for size in (1, 4, 100):
        got = layout.owners(blocks, heads, size).collect()
        assert {(r.document_key, r.block_index): r.owner.block_index for r in got} == {k: v for k, v in want.items() if v is not None}
        assert {(r.document_key, r.block_index) for r in got if r["head"]} == {(1, 2), (1, 3), (2, 7)}
