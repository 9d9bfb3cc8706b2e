import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressmill.llm import ann, attention, chunk_ids, common, langid, lm_score, toxicity

SCHEMA = "doc_id long, text string, lang string, score string, held_out string, hits string"
SYLLABLES = {"en": ["the", "ing", "wh", "ou", "th"], "de": ["sch", "ung", "ei", "ß", "ich"], "fr": ["eau", "oi", "ç", "que", "é"]}


def made(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, made(lang := rng.choice(["en", "de", "fr"]), rng.randint(3, 80), rng), lang, "", "", "") for i in range(400)]
    rows += [(401, None, "en", "", "", ""), (402, "123 !? ½ ² Ⅻ", "en", "", "", ""), (403, "", None, "", "", ""), (None, made("fr", 30, rng), None, "", "", ""), (5, rows[5][1], rows[5][2], "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.predict(docs, common.held_out("doc_id", 3, 1)).collect()
    assert len(got) == len(rows)
    told = {r.doc_id: r for r in got}
    assert [told[i].lang_pred for i in (401, 402, 403)] == ["und"] * 3 and told[402].score == 0 and told[None].lang_pred == "fr"
    held = [(told[i].lang_pred, lang) for i, _, lang, *_ in rows if i is not None and i < 401 and told[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.predict(docs.withColumn("lang", F.lit(None).cast("string")), common.held_out("doc_id", 3, 1))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.predict(spark.createDataFrame([], SCHEMA), common.held_out("doc_id", 3, 1)).count() == 0


def test_rare_and_long_languages_are_learned(spark):
    rng = random.Random(10)
    rows = [(i, made("en", 60, rng), "en", "", "", "") for i in range(200)]
    spot = spark.range(1000, 1100).filter(F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(1_000_000)) < 250_000).first()[0]
    rows += [(spot, made("de", 300, rng), "de", "", "", ""), (2000, made("fr", 25_000, rng), "fr", "", "", "")]
    assert len(rows[-1][1]) > langid.LONGEST
    rows += [(3000, made("de", 60, rng), None, "", "", ""), (3001, made("fr", 60, rng), None, "", "", "")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect()}
    assert got[3000] == "de" and got[3001] == "fr" and got[0] == "en"


def test_more_than_512_languages_are_learned(spark):
    rows = [(i, " ".join([chr(0x4E00 + i) * 3] * 5), f"l{i}", "", "", "") for i in range(520)]
    got = langid.predict(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect()
    assert all(r.lang_pred == f"l{r.doc_id}" for r in got) and len(got) == 520


def test_kneser_ney_sums_to_one():
    rng = random.Random(2)
    counts = Counter(made("de", 500, rng).split())
    model = langid.train_models({"de": counts})
    letters = sorted({c for w in counts for c in w})
    for head in ("", "sch", "u", "zz"):
        total = 0.0
        for word in [*(head + c for c in letters), head]:  # a letter more, or the end
            _, at, _ = langid.symbols([word], model.order)
            codes = langid.symbols([word], model.order)[0]
            p, context = model.floor[0], np.full(len(at), 7, np.uint64)
            for n in range(1, model.order + 1):
                context = langid.gram_hashes(codes, at - 1, n - 1) if n > 1 else context
                p = langid._found(model.grams[n - 1], model.probs[n - 1], langid.gram_hashes(codes, at, n), 0.0)[:, 0] + langid._found(model.contexts[n - 1], model.weights[n - 1], context, 1.0)[:, 0] * p
            total += p[len(head)]
        assert 0.9 < total <= 1 + 1e-5, head  # the rest is for unknown letters


def test_toxicity(spark):
    rng = random.Random(3)
    insults = ["horrible", "dumbo", "nitwit", "blockhead"]
    rows, labels = [], []
    for i in range(900):
        words = made(rng.choice(["en", "de", "fr"]), rng.randint(20, 120), rng).split()
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), "", "", "", ""))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None, "", "", "", ""), (1001, "", "", "", "", ""), (None, "dumbo nitwit", "", "", "", ""), (6, rows[6][1], "", "", "", "")], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    held = lambda c: common.held_out(c, 4, 2)
    got = toxicity.score(docs, marks, held).collect()
    assert len(got) == 904
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in test) > 0.97 * len(test)
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {0.0}
    kept = toxicity.drop_toxic(docs, marks, held)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert {r.score for r in toxicity.score(docs, marks.filter("toxic = 0"), held).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), marks, held).count() == 0


def test_windows_gain_only_where_told():
    model = toxicity.dictionaries([made("en", 60, random.Random(i)).split() for i in range(60)], [[*made("en", 60, random.Random(99 + i)).split(), "blockhead", "nitwit"] for i in range(60)])
    hits = model.hits(["blockhead", "nitwit,", "theing"], model.compressors())
    assert hits[0, 0] == 1 and hits[2, 0] == 0 and (hits[0] >= hits[2]).all()


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 24))
    x = (centers[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 24))).astype(np.float32)
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    rows += [(2000, None, ""), (2020, [0.0] * 24, ""), (2040, [float("nan")] * 24, ""), (2060, [None, *[1.0] * 23], ""), (2080, [1.0] * 7, ""), (None, [1.0] * 24, ""), (40, x[40].tolist(), "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = ann.neighbours(table, F.col("vec_id") % 20 == 0, part=200, chunk=16, block=100).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    right = 0
    for q, rows_ in found.items():
        rows_.sort()
        assert [r for r, *_ in rows_] == list(range(1, 21)) and q not in [v for _, v, _ in rows_]
        for _, v, s in rows_:
            assert s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), rel=1e-12)
        assert [(-s, v) for _, v, s in rows_] == sorted((-s, v) for _, v, s in rows_)
        exact = x.astype(float) @ x[q].astype(float)
        exact[q] = -np.inf
        right += len({v for _, v, _ in rows_} & set(np.argsort(-exact)[:20].tolist()))
    assert right >= 0.9 * 20 * len(found)
    few = ann.neighbours(table.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    table = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = ann.neighbours(table, F.col("vec_id") % 20 == 0).filter("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def brute_neighbours(ids, x, q, own, k=20):
    score = x.astype(float) @ q.astype(float)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != own]
    return ids[order[:k]].tolist()


def test_quantised_residuals_prune_and_keep_recall(spark):
    """One list of 4,000 vectors: only codes choose the 200 that are rescored."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((4000, 32)).astype(np.float32)
    index = ann.train(x, 8)
    cell, codes = ann.encode(index, x)
    order = np.argsort(cell, kind="stable")
    ids, cell, codes, xs = np.arange(4000)[order], cell[order], codes[order], x[order]
    q = xs[:40]
    row, at, score = ann.adc_pool(index, cell, codes, np.ones(4000, np.int64), q, [np.arange(8)] * 40, 200)
    assert (np.bincount(row) == 200).all()
    near = np.stack([index.centroids[c] + np.concatenate([index.books[s, v] for s, v in enumerate(code)])[:32] for c, code in zip(cell, codes)]) @ q.T
    assert score == pytest.approx(near[at, row], rel=1e-3, abs=1e-3)  # the table's score is that of the decoded vector
    for i in range(40):
        assert near[at[row == i], i].min() >= np.sort(near[:, i])[-201] - 1e-3
    got = ann.best_exact(xs.astype(float), [np.array([i]) for i in ids], q.astype(float), row, at, 21)
    right = sum(len(set(got[1][got[0] == i]) & {ids[i], *brute_neighbours(ids, xs, q[i], ids[i])}) for i in range(40))
    assert right >= 0.9 * 21 * 40
    few = ann.adc_pool(index, cell, codes, np.ones(4000, np.int64), q, [np.array([cell[0]])] * 40, 200)
    assert (cell[few[1]] == cell[0]).all()


@pytest.mark.parametrize("kind", ["wide", "other queries", "large numbers"])
def test_recall_on_other_rows(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 256 if kind == "wide" else 32)).astype(np.float32)
    if kind == "other queries":  # they point where other rows hardly vary
        x[:, 16:] *= 0.05
        x[::20] = np.where(np.arange(32) < 16, 0.01, rng.standard_normal((150, 32)))
    x *= np.float32(1e25 if kind == "large numbers" else 1)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.neighbours(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x, right = x.astype(float), 0
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        right += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
    assert right >= 0.95 * 20 * 150


def test_lists_are_packed_into_parts():
    assert ann.packed({0: 3, 1: 3, 2: 5, 3: 25, 4: 1}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 1), 3: (2, 3), 4: (5, 1)}
    assert ann.packed({7: 10, 9: 0, 11: 11}, 10) == {7: (0, 1), 9: (1, 1), 11: (1, 2)}


@pytest.mark.parametrize("noise", [0.0, 1e-6])
def test_copies_and_near_copies_are_found_in_order(spark, noise):
    """More copies, or near copies of few codes, than the pool."""
    rng = np.random.default_rng(8)
    base = np.pad(rng.standard_normal((400, 8)), ((0, 0), (0, 8)))
    x = np.concatenate([base, base[0] * 3 + noise * rng.standard_normal((1300, 16))])
    ids = rng.permutation(len(x)).astype(np.int64)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(table, F.col("vec_id") % 50 == 0, part=300, chunk=8, block=150).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    at = {int(v): n for n, v in enumerate(ids)}
    copies = [i for i in range(400, len(x)) if ids[i] % 50 == 0]
    assert len(copies) > 10
    found = [([got[ids[i]][n] for n in range(1, 21)], brute_neighbours(ids, x, x[i], ids[i])) for i in copies]
    if not noise:
        assert all(a == b for a, b in found)  # ties by id
    for (a, b), i in zip(found, copies):  # codes can't tell near copies apart: as near as makes no difference
        assert sorted(x[[at[v] for v in a]] @ x[i]) == pytest.approx(sorted(x[[at[v] for v in b]] @ x[i]), rel=1e-5)


def test_an_id_with_several_vectors_counts_once(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    rows = [(i % 30, v.tolist()) for i, v in enumerate(x)] + [(4, x[4].tolist())]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    best = {j: max(float(x[a] @ x[b]) for a in (0, 30) for b in (j, j + 30)) for j in range(1, 30)}
    assert len({r.vec_id for r in got}) == len(got) == 20 and all(r.score == pytest.approx(best[r.vec_id]) for r in got)
    assert len({r.vec_id for r in got} & set(sorted(best, key=lambda j: -best[j])[:20])) >= 18


def test_many_ties_go_to_the_smaller_id(spark):
    table = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(700)], "vec_id long, embedding array<double>")
    got = ann.neighbours(table, F.col("vec_id") % 20 == 0).filter("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 5)
    rng = random.Random(5)
    texts = [made(rng.choice(["en", "de", "fr"]), rng.randint(0, 60), rng) for _ in range(150)] + [None, "", "UPPER upper É é", "\x00 odd one"]
    rows = [(i, t, "", "", "", "") for i, t in enumerate(texts)] + [(None, "upper", "", "", "", ""), (3, texts[3], "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = common.held_out("doc_id", 7, 2)
    got = lm_score.score(docs, held, hot=10).collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r.held_out for r in got}
    counts = Counter()
    for i, t, *_ in rows:
        if not out[i]:
            counts.update([*lm_score.words_of(t or ""), None])
    whole = counts.total() + len(counts) + 1
    want = {}
    for i, t, *_ in rows:
        tokens = [*lm_score.words_of(t or ""), None]
        want[i] = (len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 1) / whole) for w in tokens))
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == counts.total()
        assert r.base_score == pytest.approx(want[r.doc_id][2]) and r.score < 0
    assert lm_score.score(docs.limit(0), held).count() == 0


def test_the_model_learns_from_all_training_rows(spark, monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 150)
    rows = [(0, "alpha beta " * 7000, "", "", "", ""), (2, "alpha beta alpha beta", "", "", "", ""), (13, "alpha alpha beta beta", "", "", "", "")]
    held = F.col("doc_id") > 0
    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(rows, SCHEMA), held).collect()}
    assert got[2] > got[13] + 0.5  # told by one training text of 77,000 characters alone


def test_counts_and_windows_grow_with_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 50, n) for n in rng.integers(1, 170, 300)]
    encoded = spark.createDataFrame([(i, bytearray(t.astype("<u4").tobytes())) for i, t in enumerate(texts)], "rid long, ids binary").repartition(3)
    rows = lm_score.counts_and_windows(encoded, 50, 1.0)
    counted = {r.cell: r.n for r in rows.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    assert counted == Counter(np.concatenate(texts).tolist())
    n, b = sum(-(-len(t) // attention.BLOCK) for t in texts), attention.BLOCK
    made_ = np.concatenate(list(lm_score.window_batches(rows.filter("mix is not null"), 50)))
    assert len(made_) == n and (np.sort(made_[:, 2 * b :][made_[:, 2 * b :] < 50]) == np.sort(np.concatenate(texts))).all()
    assert 0.35 * n < lm_score.counts_and_windows(encoded, 50, 0.5).filter("mix is not null").count() < 0.65 * n
    (small, few), (large, many) = attention.share_and_steps(10**7), attention.share_and_steps(10**9)
    assert few < many / 50 and small >= 1 / attention.SPREAD and large >= 1 / attention.SPREAD
    monkeypatch.setattr(attention, "STEPS", 2)
    assert lm_score.fit(encoded, n, 50).size == 50


def test_words_are_counted_without_objects():
    every = "".join(map(chr, range(128)))
    texts = [f" {every}Ab{c}aB{c}É é\u00a0x\u2003y " for c in every] + [None, "", " \n", "A a\x1fA", "\x85 a"]
    got = lm_score.counted(pa.array(texts, pa.string())).to_pylist()
    assert {x["values"].encode(): x["counts"] for x in got} == Counter(w for t in texts for w in lm_score.words_of(t or ""))
    assert lm_score.counted(pa.array([], pa.string())).to_pylist() == []


def test_stretches_train_as_their_windows_do():
    """Keys are fetched once a block, not once a window that sees it; the gradients stay the same."""
    rng = np.random.default_rng(12)
    lengths = np.append(rng.integers(1, 900, 12), [1, attention.BLOCK, attention.BLOCK + 1, 3000])
    ids = rng.integers(0, 200, lengths.sum())
    tree = attention.huffman(np.bincount(ids, minlength=200) + 1.0)
    t = attention.start_tables(200, tree, rng)
    for name in "qkvr":
        t[name][:, : attention.WIDTH] *= 5
    t["u"] += 0.3 * rng.standard_normal(t["u"].shape).astype(np.float32)
    rows = attention.windows(ids, lengths, 200)
    x, y = attention.stretches(ids, lengths, 200)
    pairs = np.concatenate([x[:, :-1], x[:, 1:], y], axis=2).reshape(-1, 3 * attention.BLOCK)
    assert (pairs[(y < 200).any(2).reshape(-1)] == rows).all()
    keys = np.take(t["k"], x.reshape(len(x), -1), axis=0)
    seen = attention.overlapped(keys)
    assert np.shares_memory(seen, keys) and (seen.reshape(-1, 2 * attention.BLOCK, keys.shape[2]) == t["k"][pairs[:, : 2 * attention.BLOCK]]).all()
    b, target = attention.BLOCK, rows[:, 2 * attention.BLOCK :].reshape(-1)
    hidden, kept = attention.attend(t, rows[:, :b], rows[:, b : 2 * b])
    each, together = attention.gradients(t, tree, rows[:, b : 2 * b], hidden, kept, target, target < 200), attention.stretch_gradients(t, tree, x, y)
    for name in t:
        a, c = (np.zeros((len(t[name]), *g.shape[1:])) for g in (each[name][1], together[name][1]))
        a[each[name][0]], c[together[name][0]] = each[name][1], together[name][1]
        assert np.abs(a).max() > 1e-5 and c == pytest.approx(a, rel=1e-3, abs=1e-6), name


def test_every_window_trains_the_model(spark, monkeypatch):
    """Each text has ids of its own, so that a window left out leaves rows as they began."""
    monkeypatch.setattr(attention, "STEPS", 1)
    texts, each = 500, attention.BLOCK
    ids = np.arange(texts * each).reshape(texts, each)
    encoded = spark.createDataFrame([(i, bytearray(t.astype("<u4").tobytes())) for i, t in enumerate(ids)], "rid long, ids binary").repartition(3)
    model = lm_score.fit(encoded, texts, ids.size)
    start = attention.start_tables(ids.size, attention.huffman(np.full(ids.size, 2.0)), np.random.default_rng(11))
    inputs = np.delete(ids, -1, axis=1).reshape(-1)  # a text's last id is a target alone
    assert (model.tables["r"][inputs] != start["r"][inputs]).any(1).all()
    assert (model.tables["u"][:, :-1] != 0).any(1).all()  # every node of the tree was met
    drawn = np.concatenate(list(attention.drawn(np.arange(1000), 11, np.random.default_rng(1))))
    assert set(drawn.tolist()) == set(range(1000))


def plain_log10(model, ids):
    """One text, position by position, from the definition."""
    t, size, b = model.tables, model.size, attention.BLOCK
    seq, total = [size, *ids[:-1]], 0.0
    for i, target in enumerate(ids):
        keys = seq[max(0, (i // b - 1) * b) : i + 1]
        w = np.array([t["q"][seq[i], :-1] @ t["k"][k, :-1] + t["far"][len(keys) - 1 - j] for j, k in enumerate(keys)], float)
        w = np.exp(w - w.max())
        h = np.append(np.tanh(t["r"][seq[i]] + (w / w.sum()) @ np.array([t["v"][k, :-1] for k in keys])), 1)
        for node, turn in zip(model.tree.nodes[:, target], model.tree.turns[:, target], strict=True):
            if turn:
                total -= math.log10(1 + math.exp(-turn * (h @ t["u"][node])))
    return total


def test_attention_is_a_distribution_and_scores_each_once():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 170, 40)
    ids = rng.integers(0, 50, lengths.sum())
    model = attention.train(ids, lengths, 60, steps=30)
    together = attention.log10_probabilities(model, ids, lengths, step=3)
    starts = np.cumsum(lengths) - lengths
    assert together == pytest.approx([plain_log10(model, ids[a : a + n].tolist()) for a, n in zip(starts, lengths, strict=True)], rel=1e-4)
    for head in ([], [3], list(range(40))):  # P(next | head) sums to one
        texts = [[*head, x] for x in range(60)]
        each = attention.log10_probabilities(model, np.array(sum(texts, [])), np.full(60, len(head) + 1))
        base = attention.log10_probabilities(model, np.array(head), np.array([len(head)]))[0] if head else 0.0
        assert (10 ** (each - base)).sum() == pytest.approx(1, abs=1e-3)


def test_the_tree_is_one_of_least_cost():
    counts = np.array([50.0, 1, 1, 7, 20, 3])
    tree = attention.huffman(counts)
    assert (2.0 ** -tree.depth).sum() == 1 and (counts * tree.depth).sum() == 50 + 20 * 2 + 7 * 3 + 3 * 4 + 2 * 5
    model = attention.Model(tree, attention.start_tables(6, tree, np.random.default_rng(0)))
    assert 10 ** attention.log10_probabilities(model, np.arange(6), np.ones(6, int)) == pytest.approx(counts / counts.sum(), rel=1e-4)  # it starts from the counts
    assert len(attention.huffman(np.ones(1)).nodes) == 0


def test_the_model_learns():
    rng = np.random.default_rng(16)
    ids = np.tile(rng.permutation(40), 200)
    model = attention.train(ids, np.array([len(ids)]), 41, steps=150)
    assert attention.log10_probabilities(model, ids[:400], np.array([400]))[0] > -0.3 * 400 * math.log10(40)


def test_gradients_are_right():
    rng = np.random.default_rng(7)
    tree = attention.huffman(rng.integers(1, 9, 9).astype(float))
    t = {k: v.astype(float) for k, v in attention.start_tables(9, tree, rng).items()}
    t["u"] += rng.standard_normal(t["u"].shape)
    for x in "qkv":
        t[x][:, :-1] += 0.5 * rng.standard_normal(t[x][:, :-1].shape)
    before, now = rng.integers(0, 11, (2, attention.BLOCK)), rng.integers(0, 10, (2, attention.BLOCK))
    before[0] = 10
    target = rng.integers(0, 9, 2 * attention.BLOCK)

    def loss():
        hidden, kept = attention.attend(t, before, now)
        return -attention.tree_log(tree, t["u"], hidden, target).astype(float).mean(), hidden, kept

    _, hidden, kept = loss()
    g = attention.gradients(t, tree, now, hidden, kept, target, target < 9)
    for name in t:
        rows, grad = g[name]
        whole = np.zeros((len(t[name]), *grad.shape[1:]))
        whole[rows] = grad
        live = [i for i in np.ndindex(whole.shape) if whole[i] != 0]
        for i in (live[j] for j in rng.choice(len(live), 5)):
            old = t[name][i]
            t[name][i] = old + 1e-2
            up = loss()[0]
            t[name][i] = old - 1e-2
            down = loss()[0]
            t[name][i] = old
            assert (up - down) / 2e-2 == pytest.approx(whole[i], abs=5e-4, rel=0.05), name
