import random

import numpy as np
import pytest

import corpus_pipeline
from pressmill.llm import chunk_ids, queries

from .test_text_search import base_spans, brute_components, brute_contamination


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["an", "be", "co", "du", "é", "fi"]) for _ in range(rng.randint(2, 5)))
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(i, some(20)) for i in range(8)]
    docs, labels = [], []
    for i in range(160):
        text, toxic = some(rng.randint(30, 90)) + ".", i % 8 == 0
        if toxic:
            text += " nitwit blockhead nitwit dumbo"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(200 + i, docs[i * 3 + 1][1] + (" more" if i % 2 else ""), "en", "s", 1) for i in range(20)]
    docs += [(300 + i, f"{some(10)} {items[i % 8][1]} {some(10)}", "en", "s", 1) for i in range(10)]
    docs += [(400 + i, f"{some(40)} password = abcdef{i}99", "en", "s", 1) for i in range(5)] + [(500, None, None, None, None), (501, "", "", "", 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_stages(spark, tables):
    d, rows, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, out = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if i else {r[0]: r[1] for r in rows}
        docs = stage(spark, docs, d)
        path = f"{d}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = out["toxicity"]
    gone = before.keys() - {r.doc_id for r in after}
    toxic = set(range(0, 160, 8))
    assert toxic | {200 + i for i in range(20) if i * 3 + 1 in toxic} == gone
    before, after = out["near_duplicates"]
    groups = {}
    for k, _, c in brute_components(list(before.items())):
        groups.setdefault(c, set()).add(k)
    kept = [r.doc_id for r in after]
    assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups.values())
    before, after = out["decontamination"]
    assert {r.doc_id for r in after} == {k for k, t in before.items() if not brute_contamination(t, items)[4]}
    before, after = out["secrets"]
    assert len(after) == len(before)
    for r in after:
        assert not base_spans(r.text or "") and (r.text == before[r.doc_id] or base_spans(before[r.doc_id]))
    before, after = out["packing"]
    library = chunk_ids.load("word_bpe_49k.json")
    want = {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in before.items()}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


EXTRA = ("score", "predicted", "hits", "held_out", "key", "rules", "row", "secret_spans", "fp", "w", "rid", "spans", "gids", "component_id", "fingerprint", "known")


@pytest.mark.parametrize("rows", [0, 3])
def test_stages_on_odd_tables(spark, tables, rows):
    """Empty tables; null ids, texts and labels; columns with the names of the stages' own."""
    d, *_ = tables
    some = [(None, None), (None, ""), (7, "one alone")][:rows]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * len(EXTRA)) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        path = f"{d}/odd-{rows}-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
    assert docs.count() == min(rows, 2)  # the null and the empty text are near copies


def test_run_and_names(spark, tables):
    d, *_ = tables
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 14))
    assert np.all([k in queries.queries() for k in queries.oracle_sql()])
