import hashlib
import random
import zlib

import numpy as np
import pytest

from pressmill.llm import periodic

SCHEMA = "doc_id long, text string, runs string, n_words string, best string, collapsed string"


def plain_runs(words, least=6, times=4):
    """Every (start, length, period), straight from the definition."""
    stretches = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                stretches.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in stretches.items())


def plain_words(doc_id, text):
    words, space = [], " \t\n\v\f\r"
    for c in space:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    return words


def plain_row(doc_id, text):
    words = plain_words(doc_id, text or "")
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    left = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], told, left)


def repetitive(rng):
    words = []
    while rng.random() < 0.85:
        block = [rng.choice("a b c d e é".split()[: rng.choice([1, 2, 6])]) for _ in range(rng.randint(1, 6))]
        words += block * rng.choice([1, 1, 2, 4, 5, 7]) + block[: rng.randint(0, len(block))]
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (4, 2), (9, 3)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(500):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        number = {w: i for i, w in enumerate("abcdeé")}
        words = np.array([number[w] for d in docs for w in d], np.int64)
        of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = [(s, e - s, q) for s, e, q in zip(*(x.tolist() for x in periodic.runs(words, of, least, times)), strict=True)]
        begin = np.cumsum([0] + [len(d) for d in docs]).tolist()
        assert got == [(s + begin[k], n, q) for k, d in enumerate(docs) for s, n, q in plain_runs(d, least, times)]


def test_masked_words_join_no_run():
    assert periodic.gram() == 5 and periodic.gram(4, 2) == 2
    words = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 8, 7, 6, 5, 4], np.int64)
    assert periodic.repeated(words, np.zeros(14, int), 5).tolist() == [False] + [True] * 8 + [False] * 5
    assert not periodic.repeated(words, np.arange(14), 5).any()


def test_rows_against_the_definition(spark):
    rng = random.Random(8)
    texts = [rng.choice([" ", "\n", " \t ", "\x0b", " "]).join(repetitive(rng)) for _ in range(300)]
    rows = [(rng.choice([i, i, -i, 7]), t) for i, t in enumerate(texts)]
    rows += [(None, None), (None, "x " * 9), (5, None), (5, ""), (5, " \n "), (10**12, "one two " * 1_000), (3, "x x x x x x"), (3, "x x x x x x")]
    rows += [(100_000 + i, " ".join(str(rng.randint(0, 30)) for _ in range(400))) for i in range(60)]
    frame = spark.createDataFrame([(i, t, *["x"] * 4) for i, t in rows], SCHEMA).repartition(3)
    found = periodic.find(frame, rewrite=periodic.planted)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(map(repr, map(tuple, periodic.digest(found).collect())))
    assert got == sorted(repr(plain_row(i, t)) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    assert periodic.digest(periodic.find(frame.limit(0))).count() == 0


def test_ties_of_strength_go_to_the_first_run(spark):
    text = "a b " * 4 + "c " + "d e " * 4 + "f f f f f f"
    row = periodic.digest(periodic.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 17, 6, 1, 6000)
    row = periodic.digest(periodic.find(spark.createDataFrame([(1, text[:33])], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.period) == (2, 0, 2)
