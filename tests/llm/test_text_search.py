import hashlib
import random
import re

import pytest
import xxhash

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pressmill.llm import decontam, secret_scan, simhash, trigrams

SCHEMA = "doc_id long, text string, rules string, key string, spans string, w string, rid string, fp string, secret_spans string, known string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], SCHEMA)


def base_spans(text):
    out = []
    found = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)  # letters in either case, ASCII only
    for kind, regex, ok in ((0, found, lambda m: len(m[2]) >= 6), (1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (2, re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        out += [(m.start(), kind, m.end()) for m in regex.finditer(low if kind == 0 else text) if ok(m)]
    names = ("assign", "access", "hex")
    return [f"{names[k]}:{a}:{b}" for a, k, b in sorted(out)]


def secret_texts():
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "ToKeN", "api_key", "APIKEY", ": ", "=", "'", '"', " ", "AKIA", "ABCDEF0123456789", "deadbeef0123456789abcdef", "é", "İ", "𝒳", "\n", "x", "abcdef", "=", "ſecret", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    return texts + ["password=token:abcdefgh", "token: = abcdef", "", "AKIAAKIA" + "Z" * 20, "é" * 50_000 + "secret=abcdef1", "AKIA" + "0" * 15]


@pytest.mark.parametrize("broadcast", [secret_scan.BROADCAST, 0])
def test_secrets_match_plain_search(spark, broadcast):
    rows = list(enumerate(secret_texts())) + [(None, None), (None, "token=abcdefg"), (3, "token=abcdefg"), (3, "token=abcdefg")]
    rows += [(5000, "secret=abcdefg é AKIA " * 3000), (5001, "f" * 30 + " dead " * 9000)]
    found = secret_scan.find(frame(spark, rows), broadcast=broadcast)
    assert found.columns == [c for c in frame(spark, []).columns if c != "secret_spans"] + ["secret_spans"]
    got = secret_scan.digest(found).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256) for r in got) == want
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert (kinds.count("assign"), kinds.count("access"), kinds.count("hex")) == (r.n_assign, r.n_access, r.n_hex)
    assert any("forge:" in r.spans for r in got) and any("pem:" in r.spans for r in got)
    assert secret_scan.find(frame(spark, [])).count() == 0


REGEXES = [
    "abc(def)?ghi", "(abc|xyz)+q", "a.cdef", "(?:ab|cd){2}e", "[abc]xyz", "[a-z]bcd", "x*abcd", "(?i)HeLLo [0-9]", "é?abcd", "abc|.", "(abc){0}", "(?=bar)bar", "a{3}", "(a|b){2,5}cd+e", "^(foo|bar|)baz$",
    "(a|b)(c|d)(e|f)(g|h)(i|j)(k|l)(m|n)z+", "[^a]bcd?e", r"\d{4}-ab\w", "(?:(?:one|two)-){1,3}end", "k[\u212a]abc", "([ab]|xyz)*tail", "a{0,1}b{2,2}c{3,}", "(?>abc|abd)e", "x++yz{2,3}?",
]


@pytest.mark.parametrize("regex", [*REGEXES, *(r.regex for r in secret_scan.RULES)])
def test_matches_satisfy_the_derived_query(regex):
    asked = trigrams.query(regex)

    @settings(max_examples=60, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(regex), st.text(max_size=3), st.text(max_size=3))
    def holds(match, before, after):
        low = "".join(c.lower() if c.isascii() else c for c in before + match + after)
        assert not asked or any(all(t in low for t in alternative) for alternative in asked)

    holds()


def test_derived_queries():
    sets = lambda *words: {trigrams.trigrams(w) for w in words}
    assert trigrams.query(secret_scan.BASE[2].regex) == [] and trigrams.query("abc|.") == []
    assert set(trigrams.query(secret_scan.BASE[0].regex)) == sets("password", "passwd", "secret", "token", "apikey", "api_key")
    assert set(trigrams.query(r"gh[op]_[a-z]+")) == sets("gho_", "ghp_")
    assert set(trigrams.query("(abc|xyz)+q")) == {frozenset({"abc", "bcq"}), frozenset({"xyz", "yzq"})}
    assert trigrams.query("abcd") == [frozenset({"abc", "bcd"})]


def test_postings_are_those_of_the_texts(spark):
    wanted = secret_scan.asked_for(secret_scan.RULES)
    texts = secret_texts()[:100]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {(r.trigram, r.key) for r in secret_scan.postings(rows).collect()}
    low = ["".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    assert {x for x in got if texts[x[1]].isascii()} == {(i, k) for k, t in enumerate(low) for i, w in enumerate(wanted) if w in t and texts[k].isascii()}
    assert {(i, k) for k, t in enumerate(low) for i, w in enumerate(wanted) if w in t} <= got


def test_a_rule_of_ones_own(spark):
    rules = (secret_scan.Rule("id", "ID-[0-9]{3}"), secret_scan.Rule("any", "[xyz]+", 0, 3))
    got = secret_scan.find(frame(spark, [(1, "ID-123 xyzzy ID-12"), (2, None)]), rules).collect()
    assert [[(s.kind, s.start, s.end) for s in r.secret_spans] for r in sorted(got, key=lambda r: r.doc_id)] == [[("id", 0, 6), ("any", 7, 12)], []]


def test_redaction_keeps_the_rest(spark):
    rows = list(enumerate(secret_texts())) + [(900, "é secret=abcdef token=abcdefg! " * 1500)]
    found = secret_scan.find(frame(spark, rows), spans_col="__s")
    texts = {r.doc_id: r for r in secret_scan.redact(found, spans_col="__s").collect()}
    spans = {r.doc_id: r["__s"] for r in found.collect()}
    assert secret_scan.redact(found, spans_col="__s").columns == frame(spark, []).columns
    for i, t in rows:
        new = texts[i].text
        if not base_spans(t) and not any(x in t for x in ("ghp_", "-----BEGIN")):
            assert new == t
        assert not base_spans(new)
        merged = []
        for a, b in sorted((s.start, s.end) for s in spans[i]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want, at = "", 0
        for a, b in merged:
            want, at = want + t[at:a] + "[SECRET]", b
        assert new == want + t[at:]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(text, items):
    w, hit, names = words(text), set(), []
    for item, t in items:
        v, there = words(t), False
        n = min(13, len(v))
        for a in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[a : a + n]:
                    hit |= set(range(p, p + n))
                    there = True
        if there:
            names.append(str(item) if item is not None else "")
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [decontam.BROADCAST, 0])
def test_contamination_matches_brute_force(spark, limit):
    rng = random.Random(6)
    vocabulary = ["the", "of", "É", "é", "a1", "Zeta", "rare", "x", "straße", "9"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for i in range(25)] + [(90, "the of the of the of the of the of the of the"), (91, None), (None, "only here"), (92, "only here"), (7, "again")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{some(20)}, {t}! {some(rng.randint(0, 300))}") for i, (_, t) in enumerate(items)]
    docs += [(None, None), (3, "ONLY  here"), (3, "ONLY  here"), (200, "the of " * 2000), (201, "")]
    got = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast=limit).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(tuple(r)) for r in got) == sorted(key((i, *brute_contamination(t, items))) for i, t in docs)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(frame(spark, []), none).count() == 0
    assert [r.n_hit for r in decontam.contamination(frame(spark, [(1, "a b")]), none).collect()] == [0]
    assert decontam.clean(frame(spark, [(1, "a b"), (None, None)]), none).count() == 2


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k if k is not None else -1, f"{fps[i]:016x}", least.get(root(i), -1)) for i, (k, _) in enumerate(rows))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(4))
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([2, 5, 60, 400]))]
        for _ in range(rng.choice([1, 4, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = word()
            rows.append((rng.randrange(10**6), " ".join(text).upper() if rng.random() < 0.3 else "\n".join(text)))
    rows += [(5, ""), (6, " \t"), (7, None), (None, None), (8, "one two"), (8, "one two"), (None, "alone here now and then")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in got) == brute_components(rows)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("big", [simhash.BIG, 30])
def test_links_lose_no_connection(monkeypatch, big):
    import numpy as np

    monkeypatch.setattr(simhash, "BIG", big)

    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for seed in list(fps)[:20]:
        for _ in range(60):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    some = rng.getrandbits(64) & ~((1 << 43) - 1)
    fps |= {some | rng.getrandbits(43) for _ in range(400)}  # unrelated ones with one key
    fps |= {x ^ 0b11 ^ (0b11 << 22) for x in list(fps)[:50]}  # two bits of one segment, two of another
    fps = np.array(sorted(fps), np.uint64)
    keys, values = [], []
    for low, bits in simhash.SEGMENTS:
        for b in range(bits):
            rest = ((1 << bits) - 1) & ~(1 << b)
            keys.append(((fps >> np.uint64(low)) & np.uint64(rest)).astype(np.int64) | ((low + b) << 22))
            values.append(fps)
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    u, v = simhash.links_of(keys[order], values[order])
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        assert (a ^ b).bit_count() <= 4
        parent[root(a)] = root(b)
    for i in range(len(fps)):
        near = fps[np.bitwise_count(fps ^ fps[i]) <= 4]
        assert {root(int(x)) for x in near} == {root(int(fps[i]))}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "quite another text that stands alone"), (4, "same id but another text altogether"), (None, text), (9, text), (9, text)]
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == 3 and sum(t.startswith("w0") for t in texts) == 1
