"""Document dedup in arrival order, and article identity across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.storage import discard, stored


def greedy_dedup(rows: DataFrame) -> DataFrame:
    """(seq, kept_seq): which row each one reuses; a kept row reuses itself.

    ``rows``: (seq, content_hash, issue_key), issue_key null where there is none.
    In order of seq a row is kept unless a kept one has its hash or its issue; a
    dropped row blocks nobody.  A null hash equals no other.  Rounds: an undecided row that comes first among
    the undecided of both its groups is kept, and decides its groups' other rows.
    Each round takes two minima and joins by key; it is written out, so lineage
    doesn't grow.  The rounds end when all are decided, at most as many as the
    longest chain of alternating conflicts.  Of rows that share hash and issue only
    the first takes part: it decides all of them, so copies are one row.
    """
    own = F.coalesce(F.col("content_hash").cast("string"), F.concat(F.lit("\x00"), F.col("seq").cast("string")))
    rows = rows.select("seq", own.alias("content_hash"), "issue_key")
    left = stored(rows.groupBy("content_hash", "issue_key").agg(F.min("seq").alias("seq")).select("seq", "content_hash", "issue_key"), "dedup-left")
    kept = None
    while True:
        by_hash = left.groupBy("content_hash").agg(F.min("seq").alias("h"))
        by_issue = left.filter("issue_key is not null").groupBy("issue_key").agg(F.min("seq").alias("i"))
        first = left.join(by_hash, "content_hash").join(by_issue, "issue_key", "left").filter((F.col("seq") == F.col("h")) & (F.col("i").isNull() | (F.col("seq") == F.col("i"))))
        new = stored(first.select("seq", "content_hash", "issue_key"), "dedup-kept")
        kept = new if kept is None else kept.unionByName(new)
        rest = left.join(new.select("content_hash"), "content_hash", "left_anti").join(new.filter("issue_key is not null").select("issue_key"), "issue_key", "left_anti")
        before, left = left, stored(rest.select("seq", "content_hash", "issue_key"), "dedup-left")
        discard(before)
        if left.isEmpty():
            break
    same_hash = kept.select(F.col("content_hash"), F.col("seq").alias("by_hash"))
    same_issue = kept.filter("issue_key is not null").select(F.col("issue_key"), F.col("seq").alias("by_issue"))
    met = rows.select("seq", "content_hash", "issue_key").join(same_hash, "content_hash", "left").join(same_issue, "issue_key", "left")
    # A row looks back only: its own hash first, then its issue.
    earlier = lambda c: F.when(F.col(c) <= F.col("seq"), F.col(c))
    return met.select("seq", F.coalesce(earlier("by_hash"), earlier("by_issue")).alias("kept_seq"))


def article_keys(articles: DataFrame, threshold: float = 0.9, opening: int = 160) -> DataFrame:
    """(article_id, article_key): an earlier run's key where title or opening agree.

    ``articles``: (document_key, run_seq, article_id, title, body_text, pages), ids unique
    in a run.  Candidates share a page where pages are known, the best score wins, the
    newest on a tie.  What is compared doesn't depend on keys, so all runs are matched at
    once, and keys are then passed on along the matches.

    An article with an equal text in an earlier run needs no comparison: texts are grouped,
    one row a text and run, and each run is told of the one before; copies are no pairs.
    For the others candidates come from an index by document, page (where known) and length:
    texts whose ratio reaches the threshold are at most (2 - t) / t times as long, so they lie in
    the same or a neighbouring class of lengths.  Of those go on the ones that share enough
    sequences of three characters, and enough characters, bounds of the ratio too; difflib sees
    the rest."""
    new_key = F.sha2(F.concat_ws("|", F.col("document_key").cast("string"), F.col("run_seq").cast("string"), F.col("article_id").cast("string")).cast("binary"), 256)
    named = articles.select("document_key", "run_seq", "article_id", tx.identity_text("title").alias("t"), tx.identity_text(F.substring("body_text", 1, opening)).alias("o"), F.array_distinct(F.filter(F.coalesce("pages", F.array().cast("array<int>")), lambda p: p > 0)).alias("pages"), new_key.alias("node"))
    named = stored(named, "identity-articles")
    same = stored(_equal_texts(named), "identity-equal")
    rest = named.join(same.select("node"), "node", "left_anti")
    pairs = stored(_near_texts(named, threshold, rest), "identity-pairs")
    said = pairs.select("text", "old_text").distinct()
    said = said.withColumn("score", F.when(F.col("text") == F.col("old_text"), 1.0).otherwise(tx.similarity("text", "old_text"))).filter(F.col("score") >= threshold)
    best = pairs.join(said, ["text", "old_text"]).groupBy("node").agg(F.max_by("old", F.struct("score", "place")).alias("up")).unionByName(same)
    up = stored(named.select("node").join(best, "node", "left").select("node", F.coalesce("up", "node").alias("up")), "identity-up")
    while True:  # as many rounds as the logarithm of the runs
        above = up.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        after = stored(up.join(above, F.col("up") == F.col("mid")).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "identity-up")
        discard(up)
        up = after
        if up.filter("moved").isEmpty():
            break
    return named.select("article_id", "node").join(up, "node").select("article_id", F.col("up").alias("article_key"))


def _texts(named: DataFrame) -> DataFrame:
    """A row each title and opening that isn't empty."""
    both = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("text")) for c in ("t", "o")])
    return named.select("document_key", "run_seq", "article_id", "node", "pages", F.explode(both).alias("x")).select("document_key", "run_seq", "article_id", "node", "pages", "x.*").filter("text != ''")


def _of_new(texts: DataFrame) -> DataFrame:
    return texts.withColumn("page", F.explode(F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.array(F.lit(-1)))))


def _of_old(texts: DataFrame) -> DataFrame:
    """One row a text, page and run, for its last article.

    Who knows no page is compared with all; so every older text is under -1 as well."""
    rows = texts.withColumn("page", F.explode(F.concat("pages", F.array(F.lit(-1)))))
    return rows.groupBy("document_key", "kind", "page", "text", "run_seq").agg(F.max(F.struct("run_seq", "article_id", "node")).alias("x"))


def _equal_texts(named: DataFrame) -> DataFrame:
    """(node, up): the newest article of earlier runs that has the same title or opening."""
    texts = _texts(named)
    keys = ["document_key", "kind", "page", "text"]
    before = _of_old(texts).withColumn("x", F.lag("x").over(Window.partitionBy(*keys).orderBy("run_seq"))).filter("x is not null")
    met = _of_new(texts).select(*keys, "run_seq", "node").join(before, [*keys, "run_seq"])
    return met.groupBy("node").agg(F.max("x").alias("x")).select("node", F.col("x.node").alias("up"))


def _near_texts(named: DataFrame, threshold: float, rest: DataFrame | None = None) -> DataFrame:
    """(node, old, text, old_text, place): titles and openings of earlier runs that a difflib
    ratio of ``threshold`` is possible with, for the articles of ``rest`` (all, if not given);
    ``place`` orders the older ones. Texts that occur many times in a run meet once."""
    base = (2 - threshold) / threshold
    n = F.length("text")
    sized = lambda df: df.withColumns({"n": n, "class": F.floor(F.log(n) / F.log(F.lit(base))).cast("int") if base > 1 else n})
    key, text = ["document_key", "kind", "page", "class"], ["document_key", "kind", "page", "text", "run_seq"]
    rest = named if rest is None else rest
    first = named.groupBy("document_key").agg(F.min("run_seq").alias("first"))
    asked = stored(_of_new(_texts(rest.join(first, "document_key").filter(F.col("run_seq") > F.col("first")))).select(*text, "node"), "identity-asked")
    if asked.isEmpty():  # then no older text is read either
        return asked.select("node", F.col("node").alias("old"), "text", F.col("text").alias("old_text"), F.struct("run_seq", F.col("node").alias("article_id")).alias("place"))
    new = sized(asked.select(*text).distinct())
    old = sized(_of_old(_texts(named))).withColumn("class", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])))
    old = old.join(new.select(*key).distinct(), key, "left_semi")
    new, old = [df.withColumn("bits", tx.gram_bits("text")) for df in (new, old)]
    old = old.select(*key, F.col("run_seq").alias("old_run"), F.col("text").alias("old_text"), F.col("n").alias("old_n"), F.col("bits").alias("old_bits"), "x")
    # m characters matched in at most (n + old_n - 2 m + 1) blocks hold m less two a block sequences
    # of three; a text lacks no more of the other's than the rest. Bits that meet hide some.
    both = F.col("n") + F.col("old_n")
    kept = threshold * both / 2 - 2 * ((1 - threshold) * both + 1)
    lacks = lambda a, b: sum((F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(tx.GRAM_WORDS)), F.lit(0))
    like = (lacks("bits", "old_bits") <= F.col("n") - 2 - kept + 1e-6) & (lacks("old_bits", "bits") <= F.col("old_n") - 2 - kept + 1e-6)
    met = new.join(old, key).filter((F.col("old_run") < F.col("run_seq")) & (2.0 * F.least("n", "old_n") >= threshold * both - 1e-6) & like)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split("text", "")), F.lit(0), lambda n, c: n + F.least(times(F.col("text"), c), times(F.col("old_text"), c)))
    met = met.filter((F.col("text") == F.col("old_text")) | (2.0 * shared >= threshold * both - 1e-6)).select(*text, "old_text", "x")
    near = asked.join(met, text).groupBy("node", "text", "old_text").agg(F.max("x").alias("x"))
    return near.select("node", F.col("x.node").alias("old"), "text", "old_text", F.struct("x.run_seq", "x.article_id").alias("place"))
