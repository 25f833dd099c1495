"""Long blank runs and words in the encoder, letters of late blocks, runs of marks."""

import random
import re

from tapeloom.llm import language, token_counts
from tapeloom.llm.token_counts import PATTERN, RANKS


def test_blank_runs_are_encoded_as_the_pattern_cuts_them(monkeypatch):
    with open(RANKS, "rb") as f:
        encoder, sizes = token_counts._encoding(f.read(), PATTERN)
    for text in (" " * 5_000_000, "a" + " \n" * 500_000 + "b", "x" * 1_000_000):
        assert sizes[token_counts.encode(encoder, text)].sum() == len(text)
    monkeypatch.setattr(token_counts, "_BLANKS", re.compile(token_counts._BLANKS.pattern.replace("10000", "2")))
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["  ", "\n", " ", "\t", "a", "be", "'s", "1", "!", "　", "\x1c", "\x85"]) for _ in range(r.randint(0, 14)))
        assert token_counts.encode(encoder, text) == encoder.encode_ordinary(text)


def test_long_texts_are_counted(spark):
    df = spark.createDataFrame([(1, " " * 2_000_000), (2, "x" * 1_000_000), (3, "a\n" * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in token_counts.count_sections(df).groupBy("doc_id").agg({"n_bytes": "sum"}).toDF("doc_id", "n").collect()}
    assert got == {1: 2_000_000, 2: 1_000_000, 3: 100_000}


def test_late_letters_and_marks(spark):
    w = language.Words(["́̂ ab́c", "\U00030000\U00031350", "́"])
    assert w.sizes.tolist() == [4, 2] and w.bounds.tolist() == [0, 1, 2, 2]
    docs = spark.createDataFrame([(i, "the cat and the dog", "en", "x", "y") for i in range(8)], "doc_id long, text string, lang string, _id string, _lang string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, "́̂"), (2, "\U00031350")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, model).collect()} == {1: "und", 2: "en"}
