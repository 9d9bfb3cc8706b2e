import random
import zlib

import numpy as np
import pytest

from pressmill.llm import chunk_ids, packing, token_count, token_files

random.seed(3)
ALPHABET = "abAB \n\t.,'’éÉ\xa0　\x1c1２<|>!?sßİ́가\r\x85"
TEXTS = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 40))) for _ in range(2000)]
TEXTS += ["a<|endoftext|> b<|startoftext|>c", "x  <|endoftext|>", "don't you'll  we've", "A.\nB c\n\nd", "", " ", "\n", "word " * 3000]
SCHEMA = "doc_id long, text string, n_tokens string, start string"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    encoder = chunk_ids.ChunkEncoder(name)
    for text in TEXTS:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(chunk_ids, "TABLE_ENTRIES", 10)
    encoder = chunk_ids.ChunkEncoder("word_bpe_49k.json")
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.table) <= 10 and len(encoder.table.stems) <= 10


def test_counts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (5, TEXTS[5], "x", "y")]
    got = token_count.count_tokens(spark.createDataFrame(rows, SCHEMA), limit=10).collect()
    library = chunk_ids.load("word_bpe_49k.json")
    want = sorted((i if i is not None else -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 10) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_count.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_tokens_are_proven():
    library = chunk_ids.load("word_bpe_49k.json")
    for text in random.sample(sorted(token_count.whole_tokens()), 300):
        assert len(library.encode(text, add_special_tokens=False)) == 1


def test_packing_covers_every_id_once(spark):
    texts = TEXTS[:300] + ["some words. " * 5000, None, "no end " * 9000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a. b.", "", ""), (7, texts[7], "", "")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    library = chunk_ids.load("word_bpe_49k.json")
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    pieces = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for i, at in pieces.items():
        times = 2 if i == 7 else 1
        assert sorted(at) == sorted(list(range(len(ids[i]))) * times)
    assert set(pieces) == set(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * sum(map(len, ids.values()))
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuts_are_the_best():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.choice([4, 7, 16])
        positions, weights = [0], [0]
        for _ in range(rng.randint(1, 25)):
            positions.append(positions[-1] + rng.randint(1, size))
            weights.append(rng.choice([0, 0, 3, 9]))
        cost, _ = packing.best_cuts(positions, weights, size)
        plain = [0]
        for j in range(1, len(positions)):
            plain.append(weights[j] + min(plain[i] + size - (positions[j] - positions[i]) for i in range(j) if positions[j] - positions[i] <= size))
        assert cost == plain


@pytest.mark.parametrize("unit", [1, 8])
def test_shards_round_trip(unit):
    rng = np.random.default_rng(2)
    for docs in (0, 1, 5, 300):
        ids = [rng.integers(0, rng.choice([1, 2, 300, 50257, 1 << 31]), rng.integers(1, 900)).astype("<u4").tobytes() for _ in range(docs)]
        keys = [None if i % 7 == 3 else i * 10**12 - 5 for i in range(docs)]
        content = token_files.write_shard(keys, ids, unit, block=512)
        found, lengths, stream = token_files.read_shard(content)
        assert found == keys and lengths.tolist() == [len(x) // 4 for x in ids] and stream.tobytes() == b"".join(ids)
        index, foot = token_files.shard_index(content)
        if len(index) > 1:  # one block alone
            assert token_files.read_block(content, index[1], foot["unit"]).tobytes() == stream[512:1024].tobytes()
    with pytest.raises(ValueError):
        token_files.read_shard(content[:100] + b"\x00\x01" + content[102:])


def test_token_files(spark, tmp_path):
    rows = [(i * 3 % 1000, t, "x", "y") for i, t in enumerate(TEXTS[:400])] + [(None, "first of all", "", ""), (4, None, "", ""), (3, TEXTS[1], "", "")]
    path = str(tmp_path / "ids")
    token_files.write_token_files(spark.createDataFrame(rows, SCHEMA), path, shard=2000)
    got = token_files.read_token_files(spark, path, with_ids=True).collect()
    library = chunk_ids.load("byte_bpe_50k.json")
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at, left = 0, [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows]
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        left.remove((r.doc_id, r.ids))
        at += r.n_tokens
    assert not left
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_subword_ids_spell_the_words():
    from pressmill.llm import subwords

    name = "byte_bpe_multi_50k.tiktoken"
    texts = [[], [b"hello", b"there,", b"<|endoftext|>", "é".encode(), "北京".encode(), b"hello"], [b"x" * 5000, "\xa0y\xa0".encode(), b"1", "\x85".encode()], ["é".encode() * 300, b"\x00\x1c"]]
    table = subwords.Words(name, {b"hello": -1.5})
    at, lengths = table.rows(texts)
    ids, n = table.ids(at, lengths, 60_000)
    pieces = np.split(ids, np.cumsum(n)[:-1])
    for words, piece in zip(texts, pieces, strict=True):
        assert piece[-1] == 60_000 and subwords.encoding(name).decode_bytes(piece[:-1].tolist()) == b"".join(b" " + w for w in words)
    plain = subwords.encoding(name)
    assert pieces[1][:-1].tolist() == sum((plain.encode_ordinary(f" {w.decode()}") for w in texts[1]), [])
    assert np.isnan(table.values[at]).sum() == len(at) - 2 and table.values[at[0]] == -1.5
    again = subwords.Words(name, {})
    again.rows(texts[::-1])
    assert again.ids(*again.rows(texts), 60_000)[0].tolist() == ids.tolist()
