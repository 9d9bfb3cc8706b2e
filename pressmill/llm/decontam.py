"""Benchmark decontamination: a prefix-filtered set join, all in SQL.

An item of at least ``window`` words is cut into windows of that many
consecutive words; a shorter one is a single window.  A window occurs in a
document where all its words stand in order.  So every occurrence holds the
window's rarest word: ordered by rarity, that one token is the prefix that
containment of the whole set needs.  Rarity is counted over the corpus itself.

Document words meet the index of prefix tokens; a match at word p of a token
that stands at place k of its window can only be the occurrence at p - k, which
must lie inside the document (positional and length bound), and is verified
word by word.  A document word inside any occurrence is hit.

The index is broadcast only if it takes at most ``broadcast`` bytes, judged by the
benchmark's words and their lengths; beyond it, positions and candidates are joined by shuffles, and only
candidates meet their texts again.  A token that is frequent even though it is
the rarest of its window makes a skewed join there, which Spark splits at run time
(an inner join, ``spark.sql.adaptive.skewJoin``).  Either way a document is one output row and
never a group: hot documents, sources and copies need no care.

Nulls: a null document text has no words; a null item text has none either and
is never found; null ids are kept, a null item_id is listed as ''.  Repeated
items are counted each.  Other columns are ignored (``clean`` keeps them); empty
tables give no rows, or no hits.  Texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Words of a window; bytes of an index, as estimated, that is broadcast.
WINDOW, BROADCAST = 13, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OCCURRENCE = "array<struct<s:int,e:int>>"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and nothing else."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # then lower() touches A-Z only
    # Cutting at the gaps is many times faster than searching for the words.
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), GAP), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, groups): distinct windows with the groups of items that hold them;
    a group is the items of one word sequence, (gid, items)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    groups = items.groupBy(F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("gid")).agg(F.first("w").alias("w"), F.collect_list("item").alias("items"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, F.least(F.size("w"), F.lit(window))))
    windows = groups.select("gid", F.explode(F.array_distinct(cut)).alias("seq")).groupBy("seq").agg(F.collect_set("gid").alias("gids"))
    return windows, groups.select("gid", "items")


def prefix_index(windows: DataFrame, texts: DataFrame, small: bool) -> DataFrame:
    """(token, place, seq, gids): each window under its rarest word in ``texts``."""
    tokens = windows.select(F.explode("seq").alias("token")).distinct()
    seen = texts.select(F.explode("w").alias("token"))
    seen = seen.join(F.broadcast(tokens) if small else tokens, "token", "left_semi")
    rarity = seen.groupBy("token").agg(F.count("*").alias("n"))
    places = windows.select("seq", "gids", F.posexplode("seq").alias("place", "token")).join(rarity, "token", "left")
    first = Window.partitionBy("seq").orderBy(F.coalesce("n", F.lit(0).cast("long")), "token", "place")
    return places.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("token", "place", "seq", "gids")


def covered(spans: Column) -> Column:
    """Words inside any of the [s, e) spans."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast: int = BROADCAST, id_col: str = "doc_id", text_col: str = "text", id_kind: str = "long") -> tuple[DataFrame, DataFrame]:
    """(found, groups): found has a row a document, (rid, doc_id, n_words, spans, gids)."""
    windows, groups = item_windows(benchmark, window)
    # A window has up to ``window`` words, each with some 24 bytes beside its letters.
    held = benchmark.agg((F.lit(window) * F.sum(F.octet_length("text") + 24 * F.size(words(F.col("text"))))).alias("bytes")).first()[0] or 0
    small = held <= broadcast
    texts = docs.select(F.col(id_col).cast(id_kind).alias("doc_id"), words(F.col(text_col)).alias("w"))
    index = prefix_index(windows, texts.select("w"), small)
    rows = texts.withColumn("rid", F.monotonically_increasing_id())
    inside = (F.col("pos") >= F.col("place")) & (F.col("pos") - F.col("place") + F.size("seq") <= F.size("w"))
    same = F.slice("w", F.col("pos") - F.col("place") + 1, F.size("seq")) == F.col("seq")
    span = F.struct((F.col("pos") - F.col("place")).alias("s"), (F.col("pos") - F.col("place") + F.size("seq")).alias("e"))
    if small:
        # A document's row travels with its words: the empty word marks it.
        marked = rows.select("rid", "doc_id", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos1", "word")).withColumn("pos", F.col("pos1") - 1)
        home = index.select(F.col("token"), "place", "seq", "gids").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(0).alias("place"), F.lit(None).cast("array<string>").alias("seq"), F.lit(None).cast("array<string>").alias("gids")))
        met = marked.join(F.broadcast(home), (F.col("word") == F.col("token")) & ((F.col("word") == "") | (inside & same)))
        hits = met.select("rid", "doc_id", F.size("w").alias("n_words"), F.when(F.col("word") != "", span).alias("span"), "gids")
        found = hits.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.collect_list("span").alias("spans"), F.array_distinct(F.flatten(F.collect_list("gids"))).alias("gids"))
        return found, groups
    rows = common.stored(rows, "document-words")
    at = rows.select("rid", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "token"))
    narrow = index.select("token", "place", F.size("seq").alias("len"), F.xxhash64("seq").alias("wid"))
    maybe = at.join(narrow, "token").filter((F.col("pos") >= F.col("place")) & (F.col("pos") - F.col("place") + F.col("len") <= F.col("n_words"))).select("rid", "pos", "place", "wid")
    named = index.select("seq", "gids", F.xxhash64("seq").alias("wid"))
    met = maybe.join(named, "wid").join(rows.select("rid", "w"), "rid").filter(same)
    spans = met.select("rid", span.alias("span"), "gids").groupBy("rid").agg(F.collect_list("span").alias("spans"), F.array_distinct(F.flatten(F.collect_list("gids"))).alias("gids"))
    base = rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"))
    return base.join(spans, "rid", "left").select("rid", "doc_id", "n_words", F.coalesce("spans", F.array().cast(OCCURRENCE)).alias("spans"), F.coalesce("gids", F.array().cast("array<string>")).alias("gids")), groups


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast: int = BROADCAST, share: int = 20, id_col: str = "doc_id", text_col: str = "text", id_kind: str = "long") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row a document.

    contaminated: some word is hit, and ``share`` times the hit words reach all words.
    """
    found, groups = occurrences(docs, benchmark, window, broadcast, id_col, text_col, id_kind)
    row = found.select("rid", "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.explode_outer("gids").alias("gid"))
    listed = row.join(groups, "gid", "left").groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.sort_array(F.flatten(F.collect_list("items"))).alias("items"))
    return listed.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast: int = BROADCAST, share: int = 20, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, columns as they are.

    The verdict depends on the text alone, so it comes back by 128 bits of hashes of it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__text_key", F.concat_ws(":", F.xxhash64(text).cast("string"), F.xxhash64(F.lit("more"), text).cast("string")))
    verdict = contamination(keyed, benchmark, window, broadcast, share, "__text_key", text_col, "string")
    bad = verdict.filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return keyed.join(bad, F.col("__text_key") == F.col("__bad"), "left_anti").drop("__text_key")


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as t from (select item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
spots as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as t from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
occ as (select distinct rid, i, spots.n as n, item from spots join win on spots.t = win.t and spots.n = win.n),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from occ)) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from occ) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (rid) left join its using (rid)
"""
