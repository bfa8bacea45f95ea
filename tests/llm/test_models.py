import random

import numpy as np
from pyspark.sql import functions as F

from lagloom.llm import language, toxicity


def test_interactions_beat_additive_terms():
    """Toxic only where an insult meets a group or neither is there: no additive weights can tell, the pair terms do."""
    rng = random.Random(1)
    terms, labels = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(["insult"] * a + ["group"] * b + [rng.choice("abcdefgh") for _ in range(5)])
        terms.append(np.asarray(sorted(toxicity.hashed_terms(text, {}))))
        labels.append(int(a == b))
    accuracy = lambda x: np.mean((x.score([set(t.tolist()) for t in terms]) >= 0.5) == labels)
    assert accuracy(toxicity.train(terms, np.asarray(labels))) > 0.95
    assert accuracy(toxicity.train(terms, np.asarray(labels), rank=0)) < 0.65


def test_score_is_the_sum_over_pairs():
    """The identity of sums and squares against a double loop; unknown terms count nothing."""
    rng = np.random.default_rng(4)
    place = np.full(toxicity.BUCKETS, -1)
    known = rng.choice(toxicity.BUCKETS, 30, replace=False)
    place[known] = np.arange(30)
    m = toxicity.Machine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)), place)
    texts = [set(), set(known[:1].tolist()), set(known[:12].tolist()) | {int(x) for x in rng.integers(0, toxicity.BUCKETS, 5)}]
    for t, got in zip(texts, m.score(texts), strict=True):
        own = [int(place[x]) for x in t if place[x] >= 0]
        z = m.bias + sum(m.weights[i] for i in own) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(own) for j in own[:k])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_beginnings_of_several_words():
    one, two, four = (toxicity.hashed_terms(t, {}) for t in ("stemming", "stemming stemmed stemmed", "stemming stemmed stemmer stemmest"))
    stem = np.asarray([toxicity._bucket("stem-")])
    twice, often = int(toxicity._often(stem, 2)[0]), int(toxicity._often(stem, 4)[0])
    assert twice not in one and twice in two and often not in two and {twice, often} <= four


def test_pairs_are_learned():
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        a, b = rng.random() < 0.6, rng.random() < 0.6
        rows.append((" ".join(["insult"] * a + ["group"] * b + rng.sample("abcdefgh", 3)), int(a and b)))
    m = toxicity.train([np.asarray(sorted(toxicity.hashed_terms(t, {}))) for t, _ in rows], np.asarray([y for _, y in rows]))
    p = m.score([toxicity.hashed_terms(t, {}) for t in ("insult group a", "insult a", "group a", "a", "")])
    assert (p >= 0.5).tolist() == [True, False, False, False, False]
    i, j = (int(m.place[toxicity._bucket(w)]) for w in ("insult", "group"))
    assert float(m.factors[i] @ m.factors[j]) > 0.1


def test_toxicity_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    m = toxicity.fit(odd_docs, labels)
    rows = toxicity.score_toxicity(odd_docs, m).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(no_docs, m).count() == 0
    kept = toxicity.keep_clean(odd_docs, toxicity.Machine(-1.0, np.zeros(0), np.zeros((0, 8)), np.full(toxicity.BUCKETS, -1)))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_language_edges(spark, odd_docs, no_docs):
    model = language.fit(odd_docs)
    rows = language.identify(odd_docs, model).collect()
    by = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert by[2] == by[3] == by[6] == ("und", 0.0)
    assert by[1][0] == "en" and by[5][0] == "de"
    assert language.identify(no_docs, model).count() == 0
    nothing = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.identify(odd_docs, nothing).collect()} == {"und"}


def slow_presence(text):
    """The buckets of all n-grams of 1 to 3 characters, one by one."""
    m = 1 << 32
    c = [ord(x) if not (ord(x) < 97 or 122 < ord(x) < 170) else 32 for x in f" {text.lower()} "]
    out = set()
    for i in range(len(c)):
        h = 0
        for n in range(min(language.GRAMS, len(c) - i)):
            h = (h * 31 + c[i + n] * int(language._ODD[n])) % m
            g = h * int(language._ODD[0]) % m
            out.add((g ^ (g >> 15)) % language.DIMS)
    return out


def test_presence_counts_every_gram_of_long_texts():
    """Of texts longer than a piece too, and at the seams of pieces."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij ") for _ in range((1 << 18) - 1)) + "xyzzy" + "".join(rng.choice("abc ") for _ in range(500))
    for text in ("a", "Ab", "Grüße, 1½ Жизнь 漢字", long):
        assert set(np.flatnonzero(language.presence([text])[0])) == slow_presence(text)


def test_one_matrix_equals_explicit_kernels():
    """Scores by the collapsed matrix against kernels with landmarks, their inverse root and ridge, one by one."""
    rng = random.Random(5)
    alphabets = {"a": "abcdefg", "b": "efghijk", "c": "klmnop"}
    texts, labels = [], []
    for _ in range(60):
        lang = rng.choice("abc")
        texts.append("".join(rng.choice(alphabets[lang] + " ") for _ in range(rng.randint(5, 60))))
        labels.append(lang)
    model = language.train(texts, labels, landmarks=9, ridge=0.01)
    langs = sorted(set(labels))
    sets = [slow_presence(t) for t in texts]
    k = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    by = {x: [i for i, y in enumerate(labels) if y == x] for x in langs}
    marks = [sets[by[x][n]] for n in range(60) for x in langs if n < len(by[x])][:9]
    values, vectors = np.linalg.eigh(np.asarray([[k(x, y) for y in marks] for x in marks]))
    inverse_root = vectors @ np.diag(values**-0.5) @ vectors.T
    phi = np.asarray([[k(x, z) for z in marks] for x in sets]) @ inverse_root
    y = np.asarray([[1.0 if lab == x else -1.0 for x in langs] for lab in labels])
    w = np.linalg.solve(phi.T @ phi + 0.01 * len(texts) / 100 * np.eye(9), phi.T @ y)
    new = texts[:20] + ["unseen words", "mnop mnop"]
    want = np.asarray([[k(slow_presence(t), z) for z in marks] for t in new]) @ inverse_root @ w
    got = language.unit(language.presence(new)) @ model.weights
    assert np.abs(got - want).max() < 1e-3
    names, scores = model.predict(new)
    assert names == [langs[i] for i in want.argmax(axis=1)] and all(0 < x <= 1 for x in scores)


def test_only_letters_are_letters(spark):
    """Digits, fractions, roman numerals and marks are none: such texts are und, and teach nothing."""
    rows = [(1, "plain words in a row", "en"), (2, "½ ² Ⅷ 12 _ ٣ \u0301", "xx"), (3, "ª", "yy"), (4, "漢", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == ["en", "yy", "zz"]
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert by[2] == ("und", 0.0) and by[1][0] == "en" and by[4][0] == "zz" and by[3][0] != "und"


def test_rare_languages_are_learned_and_ties_go_to_the_first(spark):
    rows = [(i, f"common words number {i} here", "en") for i in range(300)] + [(900, "жизнь и судьба", "ru"), (901, "same text", "b"), (902, "same text", "a")]
    rows += [(903, "z" * 5000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=20, most_chars=3000)
    assert model.langs == ["a", "b", "en", "ru"]
    assert model.predict(["same text", "судьба"])[0] == ["a", "ru"]


def test_language_held_out(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language.op6_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 20 and r["a"] >= 0.95


def test_toxicity_held_out(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        return
    d = "/root/testdata/sf0.01"
    out = toxicity.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    r = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("a"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("fp")).first()
    assert r["a"] >= 0.9 and r["fp"] <= 0.05


def test_toxicity_recall(spark):
    import os

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        return
    out = toxicity.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    r = out.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("fp")).first()
    assert r["recall"] >= 0.9 and r["fp"] <= 0.005
