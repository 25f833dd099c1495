"""Text operators against brute force and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, graph, html_text, jaccard_join, language, line_dedup, mixing, quality_model, quality_rules, token_counts, url_filter
from tapeloom.llm.common import numbered
from tapeloom.llm.queries import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The columns of documents, and more whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept string, component_id string, a string, b string, _key string, lines string, size string, copy2 string, line string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioubdkmnst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    """Texts with nulls, empties, ties, repeats, near copies and one very long text."""
    rng = random.Random(7)
    base = [sentence(rng, n) for n in (60, 80, 120, 200)]
    line = sentence(rng, 12)
    texts = [None, "", " \n\t\n ", "Word", "One two", *base, base[0], base[1] + " tail", base[2].replace(" ", "\t", 3), base[3].upper()]
    words = base[3].split()
    for k in range(6):
        w = list(words)
        w[10 + 20 * k] = "changed"
        texts.append(" ".join(w))
    texts += [f"{line}\n{sentence(rng, 20)}", f"{sentence(rng, 20)}\n{line} more\n{line}", line.replace(line.split()[4], "other"), f"x\n{line}\ny", " ".join(line.split()[1:])]
    texts.append("\n".join(sentence(rng, 40) for _ in range(300)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "Word"), (None, base[0]), (None, None), (5, base[0]), (5, "another text under the same id, of a few words")]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(t or ""), 1, "k", "c", "a", "b", "key", "l", "s", "c2", "li") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


# url filter


def test_url_parts_and_rules(spark):
    urls = ["https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://xexample.org/es/", "no scheme/com/de/", None, "", "ftp://b.com", "http://a.com/de/9", "http://a.com/DE/9", "http://M.a.com/fr/#x", "http://q?x://com/de/", "a://b://c/d"]
    schema = "page_id bigint, url string, host string, rule string, label string"
    pages = spark.createDataFrame([(i, u, "h", "r", "l") for i, u in enumerate(urls)], schema)
    got = {r["page_id"]: r for r in rows(url_filter.judge(pages, RULES, url_filter.UrlModel(None)))}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = re.split("[/?#]", rest)[0] if rest is not None else ""
        path = re.split("[?#]", rest[len(host) :])[0] if rest is not None else ""
        host = host.translate(LOWER)
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.text)
        assert got[i]["verdict"] == (best.verdict if best else "allow")


def test_url_model_learns_and_runs_no_python(spark):
    rows_ = [(f"http://{w}{i}.com/{w}/{i}", int(w == "casino")) for w in ("casino", "garden") for i in range(40)]
    model = url_filter.fit(spark.createDataFrame(rows_, "url string, label int"))
    pages = spark.createDataFrame([(1, "http://casino99.net/casino/1"), (2, "http://garden99.net/garden/1"), (3, None)], "page_id bigint, url string")
    out = url_filter.judge(pages, RULES, model)
    got = {r["page_id"]: r["verdict"] for r in rows(out)}
    assert got[1] == "block" and got[2] == "allow" and got[3] in ("allow", "block")
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    # the score is the logistic of the coefficients at the hashed n-grams
    from pyspark.ml.feature import HashingTF

    t = HashingTF(numFeatures=url_filter.BUCKETS)
    at = set()
    for mark, s in (("h", "^casino99.net$"), ("p", "^/casino/1$")):
        for n in url_filter.GRAMS:
            at |= {t.indexOf(mark + s[i : i + n]) for i in range(max(1, len(s) - n + 1))}
    margin = model.fitted.intercept + sum(model.fitted.coefficients[i] for i in at)
    p = next(r["p_block"] for r in rows(out) if r["page_id"] == 1)
    assert p == pytest.approx(1 / (1 + np.exp(-margin)))


def test_url_filter_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert rows(url_filter.judge(pages, RULES, url_filter.fit(url_filter.labelled_by(pages, RULES)))) == []


# quality rules


def brute_counts(t):
    w = WORD.findall(t or "")
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for d in (0, 1, 2)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_counts_equal_brute_force():
    rng = random.Random(3)
    texts = [None, "", "é ü\x85 x y", "a b c a b c", "a a a a", "x\n\nx\n x\n", "#*$%&|<> ##", *("".join(rng.choice("ab c\n\t#é") for _ in range(200)) for _ in range(50))]
    for t in texts:
        assert tuple(quality_rules.statistics(t.encode() if t is not None else None)[0]) == brute_counts(t)


def test_trees_are_monotone_flat_and_right():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] - 0.8 * x[:, 1] + 0.3 * rng.normal(size=600)) > 0).astype(float)
    trees = quality_rules.grow(x, y, monotone=(0, -1, 0))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(x[:50], 60, axis=0)
    grid[:, 1] = np.tile(np.linspace(-3, 3, 60), 50)
    assert (np.diff(trees.margin(grid).reshape(50, 60), axis=1) <= 1e-12).all()

    def walk(row):
        total = trees.start
        for at in trees.root:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert trees.margin(x[:40]) == pytest.approx([walk(r) for r in x[:40]])


def test_quality_rules_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (4, None, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    trees = quality_rules.fit(docs, labels)
    got = rows(quality_rules.judge(docs, trees))
    want = collections.Counter((r["doc_id"], *brute_counts(r["text"])) for r in rows(docs))
    assert collections.Counter((r["doc_id"], *[r[c] for c in quality_rules.COUNTS]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    kept = quality_rules.keep(docs, trees)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    free = quality_rules.fit(none, labels)
    assert rows(quality_rules.judge(none, free)) == [] and quality_rules.keep(none, free).columns == none.columns
    assert quality_rules.fit(docs, labels.limit(0)).probability(np.zeros((1, 9)))[0] > 0.5  # no labels: only the base rules reject


# language


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(60):
        s = rng.normal(size=(6, 3)).astype(np.float32) * 4
        got = language.viterbi(s, 2.0)

        def total(path):
            return sum(float(s[t, p]) for t, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

        assert total(got) == pytest.approx(max(total(p) for p in itertools.product(range(3), repeat=6)))


def test_language_spans_scripts_and_awkward_rows(spark, docs, none):
    rng = random.Random(2)

    def make(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))

    sets = {"aa": "abcde", "bb": "klmno", "ru": "абвгд"}
    rows_ = [(i, make(sets[k], 60), k) for i, k in enumerate(sorted(sets) * 40)]
    train = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["aa", "bb", "ru"]
    mixed = make("abcde", 30) + " " + make("klmno", 20) + ". " + make("абвгд", 25)
    probe = spark.createDataFrame([(1, mixed, None), (2, None, "aa"), (3, "12 34 !", None), (4, "", None), (5, "абв", "aa"), (5, "абв", "aa")], "doc_id bigint, text string, lang string")
    got = collections.defaultdict(list)
    for r in rows(language.identify(probe, model)):
        got[r["doc_id"]].append(r)
    assert [s["lang"] for s in got[1][0]["spans"]] == ["aa", "bb", "ru"] and got[1][0]["lang_pred"] == "aa"
    parts = [mixed[s["start"] : s["end"]] for s in got[1][0]["spans"]]
    assert len(parts[0].split()) in (29, 30, 31) and parts[2].split()[-1] == mixed.split()[-1]
    assert all((got[k][0]["lang_pred"], got[k][0]["score"]) == ("und", 0.0) for k in (2, 3, 4))
    assert [r["lang_pred"] for r in got[5]] == ["ru", "ru"]
    held = [r for r in rows(language.identify(train, model)) if r["held_out"]]
    want = {i: k for i, _, k in rows_}
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) == len(held)
    assert all(r["lang_pred"] == "und" for r in rows(language.identify(docs, language.fit(none))))
    assert rows(language.identify(none, model)) == [] and language.identify(docs, model).count() == docs.count()


# jaccard


def sets_of(t, n=3):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(items, percent=90, roots=False):
    """items: (id, text); the component of each distinct set, by all pairs: its smallest id, or (``roots``) a number of its own."""
    sets = sorted({sets_of(t) for _, t in items if sets_of(t)}, key=lambda s: sorted(s))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    place = {s: find(k) for k, s in enumerate(sets)}
    for i, t in items:
        if sets_of(t) and i is not None:
            k = place[sets_of(t)]
            least[k] = min(least.get(k, i), i)
    return place if roots else {s: least.get(k) for s, k in place.items()}


def check_components(df):
    items = [(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))]
    want = brute_components(items)
    expected = collections.Counter((i, len(sets_of(t)), want[sets_of(t)] if sets_of(t) else i) for i, t in items)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.classes(df)))
    assert got == expected


def test_jaccard_on_awkward_rows(docs, none):
    check_components(docs)
    assert rows(jaccard_join.classes(none)) == [] and rows(jaccard_join.keep_one(none)) == []


def test_jaccard_finds_chains_and_crowds(spark):
    rng = random.Random(11)
    common = sentence(rng, 25)
    texts = []
    for _ in range(40):  # short texts around one passage share signatures without being similar
        texts.append(f"{sentence(rng, rng.randint(3, 8))} {common} {sentence(rng, rng.randint(3, 8))}")
    for size in (12, 30, 60, 150, 400):  # chains: each text changes a little against the one before
        w = sentence(rng, size).split()
        for _ in range(12):
            w = list(w)
            w[rng.randrange(size)] = "new" + str(rng.randrange(10**6))
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i * 3 % 1009, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    check_components(df)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 9, 10, 11, 19, 20, 21, 38, 57, 100, 333, 1000, 3001):
        for _ in range(6):
            base = np.unique(rng.integers(0, 2**63, size + 400, dtype=np.uint64))
            x = base[:size]
            # the most different pairs that are still similar: swap, or grow
            swap = next(d for d in range(size, -1, -1) if 100 * (size - d) >= 90 * (size + d))
            grow = next(g for g in range(400, -1, -1) if 100 * size >= 90 * (size + g)) if size <= 3500 else 0
            for y in (np.concatenate([x[swap:], base[size : size + swap]]) if swap <= 400 else x, base[: size + grow]):
                assert set(jaccard_join.signatures(x).tolist()) & set(jaccard_join.signatures(y).tolist()), (size, swap, grow)


def test_similar_sets_share_a_signature_at_80_percent():
    rng = np.random.default_rng(5)
    for size in (1, 2, 4, 5, 9, 10, 30, 54, 100, 333, 1000):
        for _ in range(6):
            base = np.unique(rng.integers(0, 2**63, size + 400, dtype=np.uint64))
            x = base[:size]
            swap = next(d for d in range(size, -1, -1) if 100 * (size - d) >= 80 * (size + d))
            grow = next(g for g in range(400, -1, -1) if 100 * size >= 80 * (size + g))
            for y in (np.concatenate([x[swap:], base[size : size + swap]]), base[: size + grow]):
                assert set(jaccard_join.signatures(x, percent=80).tolist()) & set(jaccard_join.signatures(y, percent=80).tolist()), (size, swap, grow)


@pytest.mark.parametrize("percent", [50, 80])
def test_similar_sets_share_enough_of_their_prefixes(spark, percent):
    rng = np.random.default_rng(6)
    required = {r["id"]: r["r"] for r in rows(spark.range(1, 1500).select("id", jaccard_join._required(F.col("id"), percent).alias("r")))}
    for size in (1, 2, 4, 5, 9, 10, 19, 20, 21, 54, 100, 333, 650, 1000):
        for _ in range(20):
            base = np.unique(rng.integers(0, 2**63, size * 2 + 2, dtype=np.uint64))
            rng.shuffle(base)
            x = base[:size]
            swap = next(d for d in range(size, -1, -1) if 100 * (size - d) >= percent * (size + d))
            grow = next(g for g in range(size, -1, -1) if 100 * size >= percent * (size + g) and size + g < 1500)
            for y in (np.concatenate([x[swap:], base[size : size + swap]]), base[: size + grow]):
                shared = len(np.intersect1d(jaccard_join.prefix(x, percent), jaccard_join.prefix(y, percent)))
                assert shared >= max(required[len(x)], required[len(y)]), (size, swap, grow)


def test_sets_without_a_partner_make_no_signatures(spark, monkeypatch):
    # at 80 percent the signatures of all sets took most of the disk
    signed, original = [], jaccard_join._signatures
    monkeypatch.setattr(jaccard_join, "_signatures", lambda sets, percent: signed.extend(r["a"] for r in sets.select("a").collect()) or original(sets, percent))
    texts = [" ".join(f"w{k}x{i}" for i in range(100)) for k in range(50)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = rows(jaccard_join.classes(docs, 5, 80))
    assert len(signed) == 2 and {r["doc_id"] for r in found if r["component_id"] == 0} == {0, 50}
    assert all(r["component_id"] == r["doc_id"] for r in found if r["doc_id"] < 50) and len(found) == 51


def test_keep_one_keeps_one_of_each(docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute_components([(r["doc_id"], r["text"]) for r in rows(docs)], roots=True)
    groups = collections.Counter(want[sets_of(r["text"])] for r in rows(kept) if sets_of(r["text"]))
    assert set(groups) == set(want.values()) and max(groups.values()) == 1
    assert sum(1 for r in rows(kept) if not sets_of(r["text"])) == sum(1 for r in rows(docs) if not sets_of(r["text"]))


def test_components_of_links(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 30)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in rows(graph.components(spark.createDataFrame(edges, "u bigint, v bigint")))}
    assert got == {x: find(x) for x in up}
    assert rows(graph.components(spark.createDataFrame([], "u bigint, v bigint"))) == []


# token counts


def test_tokens_of_lines(spark, docs, none):
    got = rows(token_counts.count_sections(docs))
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    encoder, _ = token_counts._encoding(open(token_counts.RANKS, "rb").read(), token_counts.PATTERN)
    for r in rows(docs):
        if r["doc_id"] in (None, 3, 5):
            continue
        text = r["text"] or ""
        ids = encoder.encode_ordinary(text)
        assert encoder.decode(ids) == text
        lines = text.splitlines(True) if "\x0b" not in text else None
        own = sorted((x for x in by[r["doc_id"]]), key=lambda x: -1 if x["section"] is None else x["section"])
        assert {x["doc_tokens"] for x in own} == {len(ids)} and sum(x["n_tokens"] for x in own) == len(ids)
        assert sum(x["n_bytes"] for x in own) == len(text.encode())
        if text:
            assert [x["n_bytes"] for x in own] == [len(x.encode()) for x in lines]
        else:
            assert [x["section"] for x in own] == [None]
    assert rows(token_counts.count_sections(none)) == []


def test_attribution_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        ends = np.cumsum([rng.randint(1, 6) for _ in range(rng.randint(0, 12))])
        cuts = sorted(rng.sample(range(0, 60), 6))
        sections = np.array([(cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[3], cuts[4])])
        tokens, crossing = token_counts.attribute(ends, sections)
        want, cross = [0] * 3, [0] * 3
        for k, e in enumerate(ends):
            s = ends[k - 1] if k else 0
            share = [min(e, b) - max(s, a) for a, b in sections]
            hit = [i for i in range(3) if share[i] > 0]
            if hit:
                i = max(hit, key=lambda i: (share[i], -i))
                want[i] += 1
                cross[i] += len(hit) > 1
        assert tokens.tolist() == want and crossing.tolist() == cross


# html


PAGES = {
    "plain": ("<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>T &amp; t</h1><p>First <b>bold<br><p>Second, long enough. Really.</p></article><footer>&copy; x</footer>", "T & t First bold Second, long enough. Really."),
    "parts": ("<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies, all of them, you know.</div><main><article><h1>Head</h1><p>Body text, with points. And more.</p><div class=\"ad\">Buy, buy, buy. Now!</div><ul><li>One</li><li>Two</li></ul><form><p>Your name, please.</p></form><section id='comments'><p>Nice post, thanks. Really, thanks a lot.</p></section></article><aside>Other, things. Here.</aside></main></body>", "Head Body text, with points. And more. One Two"),
    "div": ("<body><div id='menu'><a>a</a> <a>b</a></div><div class='content'><h2>Title</h2><p>Long text in a div, with points. It goes on, and on.</p><p>Short.</p></div><div class='footer'>Imprint</div></body>", "Title Long text in a div, with points. It goes on, and on. Short."),
    "script": ("<article><p>a<script>if (a<b) { x('</p>') }</script> b &lt;c&gt; &#8217; &nbsp; d</p><!-- no --><style>p{}</style></article>", "a b <c> \u2019 d"),
    "empty": ("", ""), "null": (None, ""), "junk": ("<<<>< /", None), "bare": ("just text here, nothing else.", "just text here, nothing else."), "menu": ("<nav><a>x</a></nav>", ""),
    "long": ("<article>" + "<p>word, word.</p>" * 3000 + "</article>", " ".join(["word, word."] * 3000)), "deep": ("<div>" * 3000 + "<p>deep text, here.</p>", "deep text, here."),
}


def test_html_text(spark):
    df = spark.createDataFrame([(k, f"http://{k}", h, "t", "n") for k, (h, _) in PAGES.items()] + [(None, None, PAGES["plain"][0], "t", "n")], "page_id string, url string, html string, text string, n_chars string")
    got = {r["page_id"]: r for r in rows(html_text.extract(df))}
    for k, (_, want) in PAGES.items():
        if want is not None:
            assert got[k]["text"] == want, k
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[None]["text"] == PAGES["plain"][1]
    assert rows(html_text.extract(df.limit(0))) == []


# decontamination


def brute_hits(text, items, n=13):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w = pattern.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, t in items:
        v = pattern.findall((t or "").translate(LOWER))
        m = min(n, len(v))
        for i in range(len(v) - m + 1) if m and name is not None else []:
            for k in range(len(w) - m + 1):
                if w[k : k + m] == v[i : i + m]:
                    hit |= set(range(k, k + m))
                    names.add(str(name))
    n_hit = len(hit)
    return len(w), n_hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w)


@pytest.fixture(scope="module")
def bench(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in rows(docs.where("doc_id is not null and text is not null"))}
    words = texts[8].split()
    long = max(texts.values(), key=len).split()
    items = [(1, " ".join(words[20:40])), (2, " ".join(words[30:50]).upper()), (10, " ".join(long[500:513])), (11, "Word"), (12, None), (13, " ... "), (None, texts[5]), (1, " ".join(words[20:40])), (14, "not there at all, in none of the texts, for sure, of thirteen words or more")]
    return items, spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, n_words string, doc_id bigint")


@pytest.mark.parametrize("most", [2_000_000, 20])
def test_hits_equal_brute_force(docs, none, bench, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_WORDS", most)  # 20: more than one broadcast set
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 500)
    items, table = bench
    found = decontaminate.digest(decontaminate.hits(docs, table))
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(found))
    assert got == collections.Counter((r["doc_id"], *brute_hits(r["text"], items)) for r in rows(docs))
    assert rows(decontaminate.hits(none, table)) == []
    assert {r["n_hit"] for r in rows(decontaminate.digest(decontaminate.hits(docs, table.limit(0))))} == {0}


def test_decontaminate_removes_documents_or_spans(docs, bench):
    items, table = bench
    bad = sum(brute_hits(r["text"], items)[-1] for r in rows(docs))
    kept = decontaminate.decontaminate(docs, table)
    assert bad and kept.columns == docs.columns and kept.count() == docs.count() - bad
    cut = decontaminate.decontaminate(docs, table, remove="spans")
    assert cut.count() == docs.count() and not any(brute_hits(r["text"], items)[-1] for r in rows(cut) if r["text"] != "Word")


# quality classifier


def test_classifier_on_held_out(spark, docs, none):
    rng = random.Random(8)
    rows_ = [(i, sentence(rng, 80) if i % 3 else " ".join(w + "$$$" for w in sentence(rng, 80).split())) for i in range(240)]
    texts = spark.createDataFrame(rows_, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows_] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality_model.fit(texts, labels)
    got = rows(quality_model.score(texts, model))
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 > 0) == int(r["score"] >= 0.7) for r in held)
    # labels of held-out documents change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_model.fit(texts, flipped).weights, model.weights)
    assert quality_model.score(docs, model).count() == docs.count() and all(0 <= r["score"] <= 1 for r in rows(quality_model.score(docs, model)))
    blank = quality_model.fit(none, labels)
    assert {r["score"] for r in rows(quality_model.score(docs, blank))} == {0.5} and rows(quality_model.score(none, model)) == []
    # the score is a sparse dot product
    at, x = quality_model.combined(*quality_model.Hasher()(rows_[0][1].encode()))
    assert model.score(quality_model.Hasher(), rows_[0][1].encode()) == pytest.approx(1 / (1 + np.exp(-(model.weights[at] @ x))))


# mixing


def test_mix_on_awkward_rows(docs, none):
    plan = rows(mixing.plan_mix(docs))
    sizes = collections.Counter()
    for r in rows(docs):
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    assert collections.Counter((r["doc_id"], r["size"]) for r in plan) == collections.Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in rows(docs))
    for r in plan:
        source = next(s for s in sizes if sizes[s] == r["source_size"])
        assert r["target"] == pytest.approx(target[source]) and r["taken"] in (r["size"] * int(r["rate"]), r["size"] * (int(r["rate"]) + 1)) and r["taken"] <= 3 * r["size"]
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    assert collections.Counter(r["doc_id"] for r in rows(mixed)) == +collections.Counter({k: sum(r["copies"] for r in plan if r["doc_id"] == k) for k in {r["doc_id"] for r in plan}})
    assert collections.Counter(map(str, rows(mixing.plan_mix(docs.repartition(2))))) == collections.Counter(map(str, plan))
    assert rows(mixing.plan_mix(none)) == [] and rows(mixing.mix(none)) == []


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(5)
    rows_ = [(i, "w " * rng.randint(1, 40), "big" if i % 3 else f"s{i % 5}") for i in range(6000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows_, "doc_id bigint, text string, source string"))
    for r in plan.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect():
        assert r["k"] == pytest.approx(r["t"], rel=0.15)


def test_numbered_is_the_order(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(97)] + [(None,)], "s string").repartition(5)
    got = {r["s"]: r["p"] for r in rows(numbered(df, "s", "p"))}
    assert got == {**{f"n{i:03d}": i for i in range(97)}, None: 97}


# line dedup


def brute_lines(items):
    """Numbers of the lines to remove, by comparing every line with all earlier ones; items: (id, text)."""
    earlier, out = [], collections.defaultdict(list)
    for place, text in items:
        for k, line in enumerate((text or "").split("\n")):
            w = line.encode().split()
            if not w:
                continue
            if any(v == w or len(v) >= 4 and len(w) >= 4 and line_dedup.within_one(v, w) for v in earlier):
                out[place].append(k)
            earlier.append(w)
    return out


def test_within_one_is_the_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for a in itertools.product(b"ab", repeat=4):
        for n in (3, 4, 5):
            for b in itertools.product(b"ab", repeat=n):
                assert line_dedup.within_one(list(a), list(b)) == (distance(a, b) <= 1)


def test_lines_on_awkward_rows(spark, docs, none):
    unique = {}
    for r in sorted(rows(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))), key=lambda r: (*key(r), r["h"])):
        unique[(r["doc_id"], r["h"])] = r["text"]
    want = brute_lines(list(unique.items()))
    got = {(r["doc_id"], r["_key"]): r["lines"] for r in rows(line_dedup.removed_lines(docs))}
    assert got == dict(want) and len(got) > 8
    clean = line_dedup.dedup(docs)
    assert clean.columns == docs.columns
    expected = collections.Counter()
    for r in rows(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))):
        gone = want.get((r["doc_id"], r["h"]), [])
        text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone) if gone else r["text"]
        if not gone or WORD.search(text):
            expected[(r["doc_id"], text)] += 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows(clean)) == expected
    report = rows(line_dedup.report(docs))
    assert len(report) == docs.count() and {r["n_lines"] for r in report if r["doc_id"] == 0} == {0}
    assert rows(line_dedup.removed_lines(none)) == [] and rows(line_dedup.dedup(none)) == []


def test_lines_with_edits_everywhere(spark):
    rng = random.Random(6)
    lines = []
    for n in (3, 4, 5, 6, 7, 8, 9, 10, 15, 16, 40):
        w = sentence(rng, n).split()
        for _ in range(10):
            v = list(w)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(v))
                v[k : k + 1] = rng.choice([[], ["new"], [v[k], "new"], [v[k], v[k]]])
            lines.append(" ".join(v))
    rng.shuffle(lines)
    items = [(i, t) for i, t in enumerate(lines)]
    got = {r["doc_id"]: r["lines"] for r in rows(line_dedup.removed_lines(spark.createDataFrame(items, "doc_id bigint, text string").repartition(3)))}
    assert got == dict(brute_lines(items)) and 5 < len(got) < len(items)


def test_equal_short_lines_go(spark):
    rng = random.Random(12)
    words = ["Les.", "One two", "a b c"]
    items = [(i, "\n".join([rng.choice(words), "", sentence(rng, 10), f"own{i}", rng.choice(words)])) for i in range(9)]
    items += [(20, items[4][1]), (21, "Les.\n" + items[5][1] + "\n  \none  two"), (None, "a b\tc\n \n")]
    seen, want, left = set(), {}, {}
    for i, text in items:
        gone = []
        for k, line in enumerate(text.split("\n")):
            w = tuple(line.split())
            if w in seen:
                gone.append(k)
            if w:
                seen.add(w)
        if gone:
            want[i] = gone
        left[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    df = spark.createDataFrame(items, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: r["lines"] for r in rows(line_dedup.removed_lines(df))} == want
    # line 1 of the copies is empty: the exact copy leaves no document, whatever short lines it holds
    assert {r["doc_id"]: r["text"] for r in rows(line_dedup.dedup(df))} == {i: t for i, t in left.items() if t.strip()} and 20 not in {i for i, t in left.items() if t.strip()}


# pipeline


def test_exact_copies_with_short_headings_leave_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(13)
    texts = [f"Chapter {i}\n{sentence(rng, 40)}\n{sentence(rng, 30)}\nThe end" for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id bigint, text string").repartition(3)
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_copies):
        docs = stage(spark, docs, "")
        assert sorted(r["doc_id"] for r in rows(docs)) == list(range(6))


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and 0 < after.count() <= n, name
        docs, n = after, after.count()
    assert corpus_pipeline.run(spark, sf).count() == n


def test_near_copy_stage_equals_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(21)
    texts = []
    for size in (14, 30, 58, 120, 310):
        base = sentence(rng, size).split()
        texts.append(" ".join(base))
        for k in range(10):  # a run of changed words: similarities on both sides of 0.8
            w, run = list(base), rng.randint(1, max(1, size // 12))
            at = rng.randrange(size - run)
            w[at : at + run] = [f"new{size}x{k}x{i}" for i in range(run)]
            texts.append(" ".join(w))
    exact = [f"word{i}" for i in range(58)]  # 54 windows; two changed words change six: 48 of 60
    texts += [" ".join(exact), " ".join([*exact[:20], "p", "q", *exact[22:]])]
    items = [(i * 37 % 1009, t) for i, t in enumerate(texts)]

    def similarity(x, y, n):
        x, y = sets_of(x, n), sets_of(y, n)
        return len(x & y) / len(x | y)

    links = {(i, j) for (i, x), (j, y) in itertools.combinations(items, 2) if 10 * len(sets_of(x, 5) & sets_of(y, 5)) >= 8 * len(sets_of(x, 5) | sets_of(y, 5))}
    text = dict(items)
    assert sum(similarity(text[i], text[j], 5) < 0.9 and similarity(text[i], text[j], 3) < 0.9 for i, j in links) > 5
    assert similarity(texts[-1], texts[-2], 5) == 0.8
    least = {i: i for i in text}
    while any(least[i] != least[j] for i, j in links):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(items, "doc_id bigint, text string").repartition(4), "")
    assert sorted(r["doc_id"] for r in rows(kept)) == sorted(set(least.values())) != sorted(text)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")] + ["pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 11)] + ["pipeline"])
    assert "op9_mixing" in entry.oracle_sql()
