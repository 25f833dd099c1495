"""Secret scans, phrase collocations and hard negatives against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import collocations, hard_negatives, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
OWN = "doc_id bigint, text string, lang string, spans string, found string, _key string, a string, n string, score string, word string, h string, id string"
REST = ("s", "f", "k", "a", "n", "sc", "w", "h", "i")


def base_spans(text):
    found = [(m.start(), m.end(), 0, "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), m.end(), 1, "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), m.end(), 2, "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{kind}:{a}:{b}" for a, b, _, kind in sorted(found, key=lambda x: (x[0], x[2]))]


def secret_texts():
    rng = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "AKIA", "A1B2", "deadbeef", "0123", "abc", "\n", "é", "𝔘", "token=", "secretoken", "12345678", "AKIAAKIAAKIA", "_", "\x00", "ſecret=123456"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(1500)] + [None, "", "a" * 300_000, "token=token = abcdefgh", "é" * 50_000 + "password: hunter22", "x" * 400_000 + " AKIA" + "Z9" * 10]


def test_secret_scan_is_regex_scan(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i // 2, t, None, *REST) for i, t in enumerate(texts)], OWN).repartition(3)
    got = collections.Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.digest(secrets.scan(docs)).collect())
    want = collections.Counter()
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        count = collections.Counter(s.split(":")[0] for s in spans)
        want[(i // 2, count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert got == want
    assert secrets.scan(docs.limit(0)).count() == 0


def test_more_secrets_and_redaction(spark):
    text = "é ghp_" + "a1B2" * 9 + " and -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-ab eyJhbGciOi.eyJzdWIiOi." + "x" * 20 + " fine"
    docs = spark.createDataFrame([(1, text, "en", *REST), (None, None, None, *REST)], OWN)
    found = {r["doc_id"]: [f["kind"] for f in r["found"]] for r in secrets.scan(docs).collect()}
    assert found == {1: ["github", "pem", "slack", "jwt"], None: []}
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert out[1]["text"] == "é [github] and [pem] [slack] [jwt] fine" and out[1]["lang"] == "en" and out[None]["text"] is None


def test_minimised_automaton_accepts_the_same():
    rng = random.Random(1)
    patterns = ["ab*c", "(?:a|bc){2,3}", "[^a]b?c"]
    dfa = secrets.compile_rules(patterns, unanchored=False)
    assert len(dfa.table) < 20
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        state = 0
        for byte in word.encode():
            state = dfa.table[state, dfa.classes[byte]]
        assert dfa.accepts[state] == tuple(k for k, p in enumerate(patterns) if re.fullmatch(p, word)), word


def collocations_of(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 6):
                count[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        held = {q for p, c in candidates.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if (q := p[i:j]) != p and f[q] <= c}
        rows = []
        for p, a in candidates.items():
            if p not in held:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), left, right, n))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right, n) in enumerate(rows[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard", [collocations.SHARD, 7])
def test_collocations_are_counted_exactly(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "CHUNK", 101)
    rng = random.Random(5)
    words = ["New", "york", "the", "of", "a", "b", "ünder", "𝔘x", "x\x0by", "Z,"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"]), *REST) for i in range(150)]
    rows += [(None, None, None, *REST), (1, "", "en", *REST), rows[3], rows[3], (9, "a " * 3000, "long", *REST), (9, "x" * 100_000, "en", *REST)]
    docs = spark.createDataFrame(rows, OWN).repartition(4)
    got = sorted(tuple(r) for r in collocations.mine(docs, least=9, top=60).collect())
    assert got == collocations_of(rows, 9, 60) and len({r[0] for r in got}) == 4
    assert len({len(r[2].split()) for r in got}) > 2
    if shard > 7:
        assert collocations.mine(docs.limit(0)).collect() == []


def test_score_passes_64_bits():
    assert collocations.lowest_cut(10**12, 10**15, [(1, 10**12, 10**12), (2, 10**13, 10**12)])[0] == 1000 * 10**27 // 10**25


def test_trie_holds_what_it_was_built_from():
    rng = np.random.default_rng(2)
    phrases = sorted({(rng.choice(["x", "y"]), *rng.integers(1, 60, rng.integers(1, 6)).tolist()) for _ in range(4000)})
    trie = collocations.Trie.build([p[0] for p in phrases], [np.array(p[1:]) for p in phrases], np.arange(len(phrases)))
    text = rng.integers(0, 65, 3000)
    uniq, idx = np.unique(text, return_inverse=True)
    for lang in ("x", "y", "z"):
        seen = set()
        for k, (pos, state) in enumerate(trie.advance(lang, uniq, idx.astype(np.uint16), len(text)), 1):
            seen |= {(int(p), k, int(trie.ids[f])) for p, f in zip(pos, trie.phrase[state]) if f >= 0}
        number = {p: i for i, p in enumerate(phrases)}
        want = {(i, k, number[q]) for i in range(len(text)) for k in range(1, 6) if (q := (lang, *text[i : i + k].tolist())) in number and len(q) == k + 1}
        assert seen == want


def negatives_of(rows, chosen, width):
    used = []
    for vec_id, label, v in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            used.append((vec_id, label, [int(np.floor(256 * float(x))) for x in v] + [0] * (width - len(v))))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for anchor in {(a, lab, tuple(v)) for a, lab, v in used if chosen(a)}:
        scored = sorted(((-dot(anchor[2], v), last(i), i, lab) for i, lab, v in used if i != anchor[0]), key=lambda s: s[:2])
        for p in [s for s in scored if s[3] == anchor[1]][:5]:
            good = [s for s in scored if s[3] != anchor[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(anchor[0], p[2], r + 1, s[2], -p[0], -s[0]) for r, s in enumerate(good)]
    return collections.Counter(out)


@pytest.mark.parametrize("cells", [hard_negatives.BLOCK_CELLS, 300])
def test_hard_negatives_are_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 20))
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in np.round(centre[i % 3] + rng.normal(size=20) * 0.4, 2)]) for i in range(300)]
    same = rows[10][2]
    rows += [(300 + i, i % 4, same) for i in range(60)] + [rows[0], rows[20], (20, 1, rows[21][2])]
    rows += [(400, None, same), (410, 1, None), (420, 1, [None, *same[1:]]), (430, 1, [float("nan"), *same[1:]]), (440, 1, [float("inf"), *same[1:]]), (450, 2, []), (460, 2, same[:5]), (None, 1, same), (470, 3, [0.0] * 20)]
    data = spark.createDataFrame([(*r, "c", "d") for r in rows], "vec_id bigint, label int, embedding array<double>, code string, rest string").repartition(5)
    got = collections.Counter(tuple(r) for r in hard_negatives.mine(data, F.col("vec_id") % 10 == 0).collect())
    assert got == negatives_of(rows, lambda i: i is not None and i % 10 == 0, 20)
    assert hard_negatives.mine(data.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_hard_negatives_of_large_components(spark):
    rows = [(i, i % 2, [1e6 * (i + 1), 2e9, -3.0]) for i in range(12)]
    data = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = collections.Counter(tuple(r) for r in hard_negatives.mine(data, F.col("vec_id") == 4).collect())
    want = negatives_of(rows, lambda i: i == 4, 3)
    most = 2**63 - 1
    assert {tuple(k[:1]) for k in got} == {tuple(k[:1]) for k in want} == {(4,)}
    assert all(k[4] == k[5] == most for k in got) and {k[3] for k in got} == {1, 3, 5, 7, 9}  # all are as large as a number gets: by id


def test_intervals_hold_and_rule_out():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(500, 64)) / 8)
    code, align, rest = hard_negatives.encode_rows(v)
    block = hard_negatives.Anchors(np.arange(30), np.zeros(30, np.int64), v[:30])
    low, high = block.interval(slice(0, 30), code, align, rest)
    exact = v[:30] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high > 20000).mean() < 0.4  # few pairs are left to score
