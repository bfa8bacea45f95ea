import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import xxhash

from lagloom.llm import decontaminate, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_print(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints):
    at = list(range(len(prints)))
    while True:
        new = [min(at[j] for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in range(len(prints))]
        if new == at:
            return at
        at = new


def test_fingerprints_and_groups(spark, odd_docs):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()}
    rows = odd_docs.collect()
    prints = [slow_print(r["text"]) for r in rows]
    roots = slow_groups(prints)
    low = {g: min((r["doc_id"] for r, x in zip(rows, roots, strict=True) if x == g and r["doc_id"] is not None), default=None) for g in set(roots)}
    assert got == {(r["doc_id"], f"{p:016x}", low[g]) for r, p, g in zip(rows, prints, roots, strict=True)}


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_group_search_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(25):
        x = rng.integers(0, 2**63, 5, dtype=np.int64).astype(np.uint64)[rng.integers(0, 5, int(rng.integers(1, 300)))]
        for _ in range(int(rng.integers(0, 6))):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
        x = np.unique(x)
        key = np.sort(rng.integers(0, 3, len(x)))
        order = np.lexsort((simhash.gray_rank(x), key))
        x, key = x[order], key[order]
        label = np.arange(len(x))
        i, j = simhash.linked(key, x)
        label[i] = j
        want = np.arange(len(x))
        near = (key[:, None] == key) & (np.bitwise_count(x[:, None] ^ x) <= 3)
        while True:
            new = np.asarray([want[row].min() for row in near])
            if (new == want).all():
                break
            want = new
        assert (label == want).all()


def test_hot_groups_are_dealt_again(spark, monkeypatch):
    """A ball of near fingerprints: groups beyond the bound go to further blocks and no link is lost."""
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = random.Random(1)
    prints = sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = slow_groups(prints)
    got = [found.get(s, s) for s in signed]
    assert len(set(zip(got, groups, strict=True))) == len(set(got)) == len(set(groups))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 99}


def test_masks_hit_what_is_promised():
    masks = [int(m[::-1], 2) for m in decontaminate.MASKS]
    for n in range(decontaminate.SPAN, 21):
        subs = n - math.ceil(0.8 * n)
        windows = [m << k for m in masks for k in range(n - decontaminate.SPAN + 1)]
        for places in itertools.combinations(range(n), subs):
            hit = sum(1 << p for p in places)
            assert any(not w & hit for w in windows)


def test_decontamination_against_brute_force(spark, odd_docs):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (15, 18, 25, 40, 5, 40)]
    docs = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if k % 2:
            own = list(items[k % 4])
            for p in rng.sample(range(len(own)), rng.randint(0, len(own) // 4)):
                own[p] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = own[: rng.randint(10, len(own))]
        docs.append((k, " ".join(text) + ("!" if k % 3 else ""), 1))
    docs += [(None, " ".join(items[0]).upper(), 1), (70, None, 1), (71, " ".join(items[1]), 1), (71, " ".join(items[1]), 1)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (None, " ".join(items[2])), (91, " ".join(items[3]))]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = Counter(map(tuple, decontaminate.contaminated(d, b).collect()))
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = set()
    for doc, text, _ in docs:
        w = split(text)
        for item, own in bench:
            v = split(own)
            size = min(len(v), 20)
            best = 0
            for shift in range(-len(v), len(w)):
                same = [int(0 <= i + shift < len(w) and w[i + shift] == x) for i, x in enumerate(v)]
                best = max([best, *(sum(same[s : s + size]) for s in range(len(v) - size + 1))])
            if len(v) >= 8 and best >= 0.8 * size:
                want.add((doc, item, size, best))
    assert got == Counter(want) and len(want) > 10
    kept = [r["doc_id"] for r in decontaminate.keep_uncontaminated(d, b).collect()]
    assert sorted(x for x in kept if x is not None) == [k for k in [*range(60), 70] if k not in {x[0] for x in want}]
    assert None not in kept
    assert decontaminate.contaminated(odd_docs, b.limit(0)).count() == 0
    assert decontaminate.contaminated(odd_docs.limit(0), b).count() == 0
    few = decontaminate.BROADCAST_ROWS
    try:
        decontaminate.BROADCAST_ROWS = 0
        assert Counter(map(tuple, decontaminate.contaminated(d, b).collect())) == got
    finally:
        decontaminate.BROADCAST_ROWS = few
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'a')) t(doc_id, text)")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1, 'a')) t(item_id, text)")
    assert con.execute(decontaminate.OP3_SQL).fetchall() == []


def test_rows_are_judged_by_their_own_text(spark):
    """Texts that share an id, and rows without one, go or stay one by one."""
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item, "x"), (1, "clean words of the same id", "x"), (None, item, "x"), (None, "clean words without an id", "x"), (2, None, None), (2, None, None), (3, "", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key_1 string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = decontaminate.keep_uncontaminated(d, b)
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[1], *rows[3:]]))


def test_a_text_and_an_item_of_one_word(spark):
    """Every window of one meets every window of the other."""
    rows = [(1, "la " * 20_000), (2, "la " * 9 + "x"), (3, "la x " * 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, "la " * 40), (8, "la la la la la la la la")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(d, b).collect()))
    assert got == [(1, 7, 20, 20), (1, 8, 8, 8), (2, 8, 8, 8)]
