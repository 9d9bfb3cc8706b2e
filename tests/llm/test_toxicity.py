"""What the toxicity model must not depend on, and its lengths by hand."""

import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import zstandard

from pressmill.llm import common, toxicity

WORDS = ["".join(random.Random(i).choice("abcdeghilmnorstuv") for _ in range(3 + i % 7)) for i in range(900)]
BAD = ["horrible", "dumbo", "nitwit", "blockhead", "schnook"]


def documents(n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 4) if i % 5 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


_TRAIN = """
import hashlib, sys
from tests.llm.test_toxicity import documents
from pressmill.llm import toxicity
rows = [(t, toxicity.words_of(x)) for _, x, t in documents()]
m = toxicity.dictionaries([w for t, w in rows if not t], [w for t, w in rows if t])
m = toxicity.calibrate(m, [w for _, w in rows], __import__("numpy").array([t == 1 for t, _ in rows]))
print(hashlib.sha256(m.ordinary + b"|" + m.toxic + repr([x.tolist() if hasattr(x, "tolist") else x for x in m.weights]).encode()).hexdigest())
"""


def test_training_does_not_depend_on_the_hash_seed():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = {subprocess.run([sys.executable, "-c", _TRAIN], cwd=root, env=os.environ | {"PYTHONHASHSEED": seed}, capture_output=True, text=True, check=True).stdout for seed in ("1", "2", "77")}
    assert len(said) == 1 and len(said.pop().strip()) == 64


def digest(model):
    return hashlib.sha256(model.ordinary + b"|" + model.toxic + repr([np.asarray(x).tolist() for x in model.weights]).encode()).hexdigest()


def test_training_does_not_depend_on_order_or_partitions(spark):
    rows = documents()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    held = lambda c: common.held_out(c, 4, 2)
    made = []
    for seed, parts in ((1, 1), (2, 5), (3, 13)):
        mixed = random.Random(seed).sample(rows, len(rows))
        docs = spark.createDataFrame([(i, x) for i, x, _ in mixed], "doc_id long, text string").repartition(parts)
        made.append(digest(toxicity.fit(docs, labels.repartition(parts), held)))
    assert len(set(made)) == 1


def test_hits_are_compression_lengths(spark):
    """Every window's gain from two plain compressions, nothing remembered."""
    rows = documents(300)
    train = [(t, toxicity.words_of(x)) for _, x, t in rows]
    model = toxicity.dictionaries([w for t, w in train if not t], [w for t, w in train if t])
    model = toxicity.calibrate(model, [w for _, w in train], np.array([t == 1 for t, _ in train]))
    carrier = (b"(the carrier of a window:", b"and what follows it)")

    def length(dictionary, data):
        held = zstandard.ZstdCompressionDict(dictionary + carrier[0] + carrier[1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(16, min_match=3, source_size=128, dict_size=len(dictionary + carrier[0] + carrier[1]), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress(carrier[0] + data + carrier[1]))

    odd = [(900, "nitwit, (dumbo) " * 4000, 0), (900, "Blockhead!", 0), (901, "!!! ...", 0), (901, None, 0), (902, "x" * 3000 + " nitwit", 0)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows[:40] + odd], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "", r.hits, r.score, r.predicted) for r in toxicity.with_scores(docs, model).collect())
    gains: dict[str, int] = {}
    for i, text, hits, score, predicted in got:
        want = 0
        for word in text.lower().split():
            piece = f" {word.strip('!\"#$%&()*+,-./:;<=>?@[]^_`{|}~' + chr(39) + chr(92))} ".encode()
            if word not in gains:
                gains[word] = length(model.ordinary, piece) - length(model.ordinary + model.toxic, piece)
            want += gains[word] >= 4
        assert hits == want and predicted == int(score >= 0.3) and (hits > 0 or score == 0), i
    assert len(got) == len(rows[:40] + odd) and sum(r[2] > 0 for r in got) > 8


def test_a_score_at_the_cut_is_toxic(spark):
    rows = documents(300)
    train = [(t, toxicity.words_of(x)) for _, x, t in rows]
    model = toxicity.calibrate(toxicity.dictionaries([w for t, w in train if not t], [w for t, w in train if t]), [w for _, w in train], np.array([t == 1 for t, _ in train]))
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows[:50]], "doc_id long, text string")
    one = max(r.score for r in toxicity.with_scores(docs, model).collect())
    assert one > 0 and {r.predicted for r in toxicity.with_scores(docs, model, cut=one).collect() if r.score == one} == {1}
