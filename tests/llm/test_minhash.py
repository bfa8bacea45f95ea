import random
import re

import numpy as np
import pytest

from lagloom.llm import minhash as M


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k=4):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, text) -> sorted rows, by comparing all sets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return sorted(((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def _get(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in M.near_duplicates(df).collect()), key=str)


def _changed(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randint(0, 10**6)) if rng.random() < share else w for w in words]


def _corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    passage = [f"law{i}" for i in range(60)]
    for _ in range(40):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 200))]
        texts += [words] + [_changed(rng, words, rng.choice([0, 0.01, 0.03, 0.05, 0.08])) for _ in range(rng.randint(0, 4))]
    # Many texts around one passage, nearly all far from each other, and a chain of near copies.
    texts += [passage + [f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 60))] for _ in range(60)]
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):
        chain = chain[:]
        chain[8 * k] = f"new{k}"
        texts.append(chain)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("whole", "each"), [(2048, 1 << 17), (8, 10)])
def test_equals_all_pairs(spark, monkeypatch, whole, each):
    """With groups of 8 the keys of the passage are dealt again and cut into blocks; links are contracted over several tasks."""
    monkeypatch.setattr(M, "WHOLE", whole)
    monkeypatch.setattr(M, "EDGES_EACH", each)
    rows = _corpus()
    assert _get(spark, rows) == brute(rows)


def test_equals_all_pairs_on_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = M.op13_minhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    got = M.near_duplicates(odd_docs)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert M.near_duplicates(no_docs).collect() == []


def test_ids_null_and_repeated(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (None, "else"), (5, "a b c d e"), (5, text), (4, ""), (None, " "), (4, "")]
    got = _get(spark, rows)
    assert [r for r in got if r[0] is None] == [(None, 0, None, True), (None, 1, None, True), (None, 3, 5, False), (None, 3, 5, False)]
    assert [r for r in got if r[0] is not None] == [(4, 0, 4, True), (4, 0, 4, True), (5, 2, 5, True), (5, 3, 5, True)]


def test_a_large_group_of_near_copies(spark):
    """1,500 copies with a few words changed are one group, at a few comparisons a member."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(_changed(rng, words, 0.005))) for i in range(1500)]
    got = _get(spark, rows)
    want = {i: shingles(t) for i, t in rows}
    near = {i for i in want if len(want[i] & want[0]) * 5 >= 4 * len(want[i] | want[0])}
    assert {r[0] for r in got if r[2] == 0} >= near


def test_sets_are_those_of_the_definition():
    texts = ["", None, " \t", "a", "A b", "a b c d", "a b c d a b c d a b c d", "x\x00 é漢 \x1c\x85 y z z z z z z", "A" * 10_000]
    for t, own in zip(texts, M.shingle_sets(texts), strict=True):
        assert len(own) == len(shingles(t)) and (np.diff(own.astype(object)) > 0).all()
    a, b, c, d = M.shingle_sets(["q r s t u", "x q r s t u y", "Q R s t u", "a b"])
    assert set(a) < set(b) and (a == c).all() and not set(d) & set(b)


def test_posterior_prunes_at_the_stated_probability():
    assert M.posterior(32, 32) > 0.999 and M.posterior(0, 32) < 1e-20
    for k, need in M._NEED:
        assert M.posterior(need, k) >= M.MISS > M.posterior(need - 1, k)
    assert all(rash > need for (_, rash), (_, need) in zip(M._RASH, M._NEED, strict=False))
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (2000, M.LONG), np.uint8)
    same = rng.random(x.shape) < 0.8
    y = np.where(same, x, rng.integers(0, 256, x.shape, np.uint8))
    left, equal = M.survivors(x, y)
    assert len(left) == 2000 and (equal == (x == y).sum(axis=1)).all()
    far = np.where(rng.random(x.shape) < 0.3, x, rng.integers(0, 256, x.shape, np.uint8))
    assert len(M.survivors(x, far)[0]) < 5


def test_a_spanning_forest_of_greatest_weight():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(2, 30)
        root = np.array([rng.randint(0, n) for _ in range(n)])
        edges = [(i, j, rng.randint(90, 128)) for i in range(n) for j in range(i) if root[i] != root[j] and rng.random() < 0.3]
        i, j, w = (np.array(c, np.int64) for c in (zip(*edges, strict=True) if edges else ([], [], [])))
        got = M.forest(root, i, j, w)
        # Kruskal, an edge at a time.
        own, weight = {r: {r} for r in root.tolist()}, 0
        for a, b, x in sorted(edges, key=lambda e: -e[2]):
            if own[root[a]] is not own[root[b]]:
                both = own[root[a]] | own[root[b]]
                own |= dict.fromkeys(both, both)
                weight += x
        assert w[got].sum() == weight
        assert len(got) == len(set(root.tolist())) - len({id(v) for v in own.values()})


def test_labels_of_components():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 60, (2, int(rng.integers(0, 50))))
        near = {int(x): {int(x)} for x in [*a, *b]}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            both = near[x] | near[y]
            near |= dict.fromkeys(both, both)
        assert dict(zip(*(v.tolist() for v in M.labelled(a, b)), strict=True)) == {x: min(c) for x, c in near.items() if x != min(c)}
