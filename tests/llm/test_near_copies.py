import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from lagloom.llm import minhash, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(rows):
    """Ids that stay of rows with distinct ids, by all pairs."""
    sets = [slow_set(t) for _, t in rows]
    near = lambda a, b: a == b or (a | b and 5 * len(a & b) >= 4 * len(a | b))
    links = [[j for j in range(len(rows)) if near(sets[i], sets[j])] for i in range(len(rows))]
    at = [i for i, _ in rows]
    while (new := [min(at[j] for j in own) for own in links]) != at:
        at = new
    return set(at), sum(len(x) - 1 for x in links)


def stage(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    return dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, "")


def test_near_copies_go_and_others_stay(spark):
    """Copies with a few changed words, chains of them and pairs just below the threshold, against all pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        for k in range(8):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for p in rng.sample(range(len(text)), max(1, len(text) * (k % 4) // 80)):
                text[p] = rng.choice(words)
    rows += [(1000, ""), (1001, " \n"), (1002, "two words"), (1003, "Two  Words"), (1004, "two other")]
    want, links = slow_kept(rows)
    assert links > 60 and len(want) < len(rows) - 20
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == sorted(want)


def test_a_large_group_of_near_copies(spark):
    """Each differs from the first in one place; one that hangs on another by a chain goes too."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        own = list(base)
        for p in rng.sample(range(120), 2):
            own[p] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows.append((500, "nothing of the kind is written in this text"))
    want, _ = slow_kept(rows)
    assert want == {0, 500} and {r["doc_id"] for r in stage(spark, rows).collect()} == want


def test_bands_hit_what_is_promised():
    """Of 300 pairs at 0.8 or little more all share a band."""
    rng = random.Random(10)
    for _ in range(300):
        common = [rng.getrandbits(64) for _ in range(80)]
        a, b = (np.unique(np.array(common + [rng.getrandbits(64) for _ in range(10)], np.uint64)) for _ in range(2))
        assert minhash.similar(a, b) and (minhash.signature(a)[0] == minhash.signature(b)[0]).any()


def test_texts_that_share_an_id_are_judged_apart(spark):
    """A copy under a repeated id goes without the id's other text; a copy without an id goes too."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (2, one), (2, two), (3, two), (4, three), (4, three), (None, one), (None, "a text of its own without an id")]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in stage(spark, rows).collect())
    assert got == sorted([(1, one), (2, two), (4, three), (0, "a text of its own without an id")])


def test_texts_that_share_a_passage_only(spark, monkeypatch):
    """Common keys are cut into blocks; the near copies among them are found all the same."""
    monkeypatch.setattr(minhash, "WHOLE", 7)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(80):
        own = [f"o{k}x{i}" for i in range(25)]
        rows.append((len(rows), " ".join(own + passage)))
        if k % 8 == 0:
            for p in rng.sample(range(25), 1):
                own[p] = "changed"
            rows.append((len(rows), " ".join(own + passage)))
    want, links = slow_kept(rows)
    assert links >= 20 and 70 < len(want) < len(rows)
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == sorted(want)


def test_a_key_in_blocks_gives_the_pairs_of_the_whole(spark, monkeypatch):
    """Pairs of different components with likely signatures, once each, and none within the largest component."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (4, minhash.LONG), np.uint8)
    rows, signed = [], []
    for n in range(60):
        own = base[n % 4].copy()
        own[rng.choice(minhash.LONG, int(rng.integers(0, 300)), replace=False)] = 7
        rows.append((1, n, int(rng.integers(80, 130)), 0 if n % 3 else n))
        signed.append((n, bytearray(own.tobytes())))
    held, signed_df = spark.createDataFrame(rows, "band int, node long, size long, root long"), spark.createDataFrame(signed, "node long, sketch binary")
    want = set()

    def survives(x, y):
        same = [u == v for u, v in zip(x, y, strict=True)]
        return all(sum(same[:k]) >= need for k, need in minhash._NEED)

    for _, a, s, r in rows:
        for _, b, t, q in rows:
            if a > b and r != q and survives(signed[a][1], signed[b][1]) and 5 * min(s, t) >= 4 * max(s, t):
                want.add((a, b))
    assert len(want) > 20
    # Two keys that all share: common keys are dealt again by pairs of keys.
    held = held.withColumn("key", F.lit(1).cast("long")).unionByName(held.withColumn("key", F.lit(2).cast("long")).withColumn("band", F.lit(2)))
    for whole in (4096, 9):
        monkeypatch.setattr(minhash, "WHOLE", whole)
        got = [tuple(r) for r in minhash._within(minhash._dealt(held, signed_df), minhash.compared).distinct().collect()]
        assert set(got) == want and len(got) == len(want)


def test_clashing_columns_stay(spark):
    rows = [(1, "a b c d e f", "k1", True, 5), (1, "a b c d e f", "k1", True, 5), (2, "a b c d e f", "k2", False, 6), (3, "other words", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string, twice boolean, band long")
    assert sorted(map(tuple, near_copies.keep_first(df).collect()), key=str) == [rows[0], rows[3]]


def test_signatures_agree_as_sets_do():
    """Lowest bytes of min-hashes agree in a share of about the similarity; at 0.8 far more than must."""
    rng = np.random.default_rng(2)
    for n in (5, 40, 400):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            b = np.unique(np.concatenate([a[: int(0.89 * len(a))], rng.integers(0, 1 << 64, n - int(0.89 * n), np.uint64)]))
            x, y = (np.frombuffer(minhash.signature(s)[1], np.uint8) for s in (a, b))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs((x == y).mean() - j) < 0.25
            assert j < 0.79 or (x == y).sum() > dict(minhash._NEED)[128]
