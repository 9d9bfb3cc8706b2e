"""Folds and joins in the JVM against plain loops."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.operators import identity, layout, segment

ARTICLES = "document_key string, run_seq int, article_id string, title string, body_text string, pages array<int>"


def flat(text):
    return "".join((text or "").casefold().split())


def plain_keys(rows, threshold=0.9):
    """Runs in turn, every article against all of earlier runs, the newest first."""

    def ratio(a, b):
        return SequenceMatcher(a=a, b=b).ratio() if a and b else 0.0

    out = {}
    for document in sorted({r[0] for r in rows}):
        past = []
        mine = [r for r in rows if r[0] == document]
        for run in sorted({r[1] for r in mine}):
            now = []
            for _, _, key, title, body, pages in sorted((r for r in mine if r[1] == run), key=lambda r: r[2]):
                pages = {p for p in pages or () if p is not None and p > 0}
                best, found = 0.0, key
                for t, o, k, theirs in reversed(past):
                    if pages and not pages & theirs:
                        continue
                    score = max(ratio(flat(title), t), ratio(flat(body[:160]), o))
                    if score >= threshold and score > best:
                        best, found = score, k
                now.append((flat(title), flat(body[:160]), found, pages))
                out[key] = found
            past += now
    return out


def changed(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice(["", "x", " ", "É"]) + text[i + rng.randint(0, 1) :]
    return text


def runs_of(rng, documents, articles, runs):
    rows = []
    for d in range(documents):
        first = [("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 12, 40, 230]))), "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 30, 400]))), rng.choice([None, [], [1], [1, 2], [3, 0, -1]])) for _ in range(articles)]
        for run in range(1, runs + 1):
            for i, (title, body, pages) in enumerate(first):
                if rng.random() < 0.85:
                    wear = rng.choice([0, 0, 1, 2, 5])
                    rows.append((f"d{d}", run, f"d{d}-{run}-{i:04d}", changed(rng, title, wear), changed(rng, body, wear), pages))
            first += [(first[0][0], "", [1])] if run == 1 else []  # a title twice in a run
    return rows


def groups(keys):
    by = {}
    for article, key in keys.items():
        by.setdefault(key, set()).add(article)
    return sorted(map(sorted, by.values()))


def test_identity_equals_the_plain_loop(spark):
    rows = runs_of(random.Random(6), 4, 9, 5) + [("e", 1, "e1", None, "", None), ("e", 2, "e2", "", "", None), ("e", 2, "e3", None, "", [1])]
    for threshold in (0.9, 0.6):
        got = {r.article_id: r.article_key for r in identity.article_keys(spark.createDataFrame(rows, ARTICLES).repartition(3), threshold).collect()}
        assert groups(got) == groups(plain_keys(rows, threshold)) and len(got) == len(rows)
    assert len(groups(got)) < len(rows) / 2


def test_identity_of_many_runs(spark):
    """400 articles in 12 runs: what is compared is a small part of all pairs."""
    rng = random.Random(2)
    title = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(40)) for _ in range(400)]
    rows = [("d", run, f"{run:02d}-{i:04d}", changed(rng, title[i], 1 if rng.random() < 0.3 else 0), "", [i % 40 + 1]) for run in range(1, 13) for i in range(400)]
    frame = spark.createDataFrame(rows, ARTICLES)
    began = time.time()
    got = {r.article_id: r.article_key for r in identity.article_keys(frame).collect()}
    assert time.time() - began < 120
    assert all(got[f"12-{i:04d}"] == got[f"01-{i:04d}"] for i in range(400)) and len(set(got.values())) == 400


def test_copies_are_no_pairs(spark, monkeypatch):
    """Equal texts were paired one by one; near ones meet once, however often they occur."""
    rng, kept, write = random.Random(9), {}, identity.stored

    def noted(df, label):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(identity, "stored", noted)
    title = "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    equal = [("d", run, f"{run}-{i:02d}", f"{title}{run}{i % 2}", "the same body of all", [1, 2]) for run in (1, 2, 3) for i in range(20)]
    near = [("d", run, f"{run}-{i:02d}", f"{title}{run}", "", [1, 2]) for run in (1, 2, 3) for i in range(20)]
    for rows, pairs in ((equal, 0), (near, 40 * 1 + 20)):
        got = {r.article_id: r.article_key for r in identity.article_keys(spark.createDataFrame(rows, ARTICLES)).collect()}
        assert groups(got) == groups(plain_keys(rows)) and kept["identity-pairs"].count() == pairs


def plain_headlines(rows):
    kept, parted = [], True
    for block, byline, page, height, title in sorted(rows):
        if byline:
            parted = parted or not kept or block > kept[-1][0]
        elif kept and not parted and 0 <= page - kept[-1][1] <= 1 and abs(height - kept[-1][2]) < 40:
            kept[-1][3] += f" {title}"
        else:
            kept.append([block, page, height, title])
            parted = False
    return [(t, p, b) for b, p, _, t in kept]


def test_headlines_equal_the_plain_loop(spark):
    rng, rows = random.Random(1), []
    for d in range(60):
        page = 0
        for i in range(rng.randint(0, 14)):
            page += rng.choice([0, 0, 1, 2])
            rows.append((f"d{d}", page, i * 3 + rng.randint(0, 2), float(rng.choice([20, 50, 61, 100])), f"t{i}", rng.random() < 0.3))
    got = layout.split_headlines(spark.createDataFrame(rows, "document_key string, page_idx int, block_index int, height double, title string, byline boolean").repartition(3))
    by = {}
    for r in got.collect():
        by.setdefault(r.document_key, []).append((r.title, r.page_idx, r.block_index))
    for d in {r[0] for r in rows}:
        want = plain_headlines([(r[2], r[5], r[1], r[3], r[4]) for r in rows if r[0] == d])
        assert sorted(by.get(d, []), key=lambda x: x[2]) == want


def test_owners_do_not_depend_on_bins(spark):
    rng = random.Random(4)
    blocks = [(d, i) for d in "abc" for i in range(0, 300, rng.choice([1, 2, 7]))]
    heads = [(d, i) for d, i in blocks if rng.random() < (0.02 if d == "a" else 0.2) and d != "c"]
    frame = spark.createDataFrame(blocks, "document_key string, block_index int").repartition(4)
    marks = spark.createDataFrame(heads, "document_key string, block_index int").withColumn("head", F.struct("block_index"))
    want = sorted((d, i, max(h for e, h in heads if e == d and h <= i)) for d, i in blocks if any(e == d and h <= i for e, h in heads))
    for size in (1, 5, 64, 4096):
        assert sorted((r.document_key, r.block_index, r.owner.block_index) for r in layout.owners(frame, marks, size).collect()) == want


def test_no_python_in_ordered_folds(spark):
    frags = spark.createDataFrame([("d", 1, "A2", ""), ("d", 2, "", "A1")], "document_key string, source_order int, continued_to_page string, continued_from_page string")
    pairs = spark.createDataFrame([("d", 0, 1, 2), ("d", 1, 2, 1)], "document_key string, seq long, front long, back long")
    heads = spark.createDataFrame([("d", 0, 1, 3.0, "t", False)], "document_key string, page_idx int, block_index int, height double, title string, byline boolean")
    for df in (segment.decisions(pairs, frags), layout.split_headlines(heads), layout.owners(heads, heads.select("document_key", "block_index", F.struct("title").alias("head")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    assert [r.decision_status for r in segment.decisions(pairs, frags).orderBy("seq").collect()] == ["accepted", "ignored"]


def test_similarity_of_empty_texts(spark):
    rows = spark.createDataFrame([("", "a"), ("abcd", "abce"), ("a", "")], "a string, b string")
    assert [round(r[0], 3) for r in rows.select(tx.similarity("a", "b")).collect()] == [0.0, 0.75, 0.0]


def test_texts_without_common_sequences_are_no_pairs(spark):
    """Anagrams share all their characters, but not their order: difflib never sees them."""
    rng = random.Random(5)
    rows = [("d", run, f"{run}", "".join(rng.sample("abcdefghijklmnopqrstuvwxyz" * 3, 78)), "", []) for run in (1, 2)]
    named = spark.createDataFrame([(*r[:3], f"n{r[1]}", r[3], r[4], r[5]) for r in rows], "document_key string, run_seq int, article_id string, node string, t string, o string, pages array<int>")
    assert identity._near_texts(named, 0.9).count() == 0 and identity._near_texts(named, 0.1).count() == 1
