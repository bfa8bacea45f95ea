import random
import re
from collections import Counter

import numpy as np
import pytest

from lagloom.llm import collocations as C


def brute(rows, least=10, top=2000):
    """(lang, text) -> rows, by counting every run of words."""
    f = Counter()
    n = Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        own = []
        for (where, p), a in f.items():
            if where != lang or len(p) < 2 or a < least:
                continue
            if any(w == lang and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and b >= least and 100 * b >= 50 * a for (w, q), b in f.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            own.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def _texts(n=300):
    rng = random.Random(8)
    words = ["The", "the", "oil", "Price", "rises", "of", "day", "é漢", "x\x00y", "--", "\x1c", "a_b"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choices(ends, [9, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def _get(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **how).collect())


def test_equals_brute_force(spark):
    assert _get(spark, _texts()) == brute(_texts())


def test_small_blocks_and_a_top(spark, monkeypatch):
    """Texts longer than a block go on in the next, where a piece ends; a short list is cut by rank."""
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(C, "HELD", 100)
    assert _get(spark, _texts(), top=7) == brute(_texts(), top=7)


def test_places_shared_in_the_bitmap_change_nothing(spark, monkeypatch):
    """With 64 places nearly all phrases share one with a frequent phrase."""
    monkeypatch.setattr(C, "SLOTS", 64)
    assert _get(spark, _texts(60)) == brute(_texts(60))


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    got = C.collocations(odd_docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert brute(rows)
    assert C.collocations(no_docs).collect() == []


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**12, 5 * 10**12, 6 * 10**12)], "a long, l long, r long")
    assert df.select(C._score("a", "l", "r")).first()[0] == 10**6 * 16 * 10**24 // (30 * 10**24)


def test_hashes_are_those_of_the_engine(spark):
    rows = [("en", "word"), ("é", "漢"), ("", ""), ("und", "a b")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").selectExpr("xxhash64(a, b)").collect()]
    assert [int(C.word_hashes(a, [b]).view(np.int64)[0]) for a, b in rows] == got


@pytest.mark.parametrize("text", [b"", b" \t ", b"...", b"a", b"a b. c,d\te"])
def test_positions(text):
    words, at = C.positions(text)
    pieces = [p.split() for p in re.split(rb"[.,;:!?\x0a-\x0d]", text)]
    assert [w.as_py().encode() for w in words] == [w for p in pieces for w in p]
    firsts = np.cumsum([len(p) for p in pieces if p])[:-1]
    assert [i for i in range(1, len(at)) if at[i] != at[i - 1] + 1] == list(firsts)


def test_a_row_group_holds_few_blocks(spark, monkeypatch):
    """One task's blocks are many row groups: what a task holds does not grow with the text it reads."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(C, "BLOCK", 1 << 16)
    monkeypatch.setattr(C, "GROUP", 1 << 18, raising=False)
    rng = random.Random(3)
    rows = [("en", " ".join(str(rng.randrange(9999)) for _ in range(14_000))) for _ in range(40)]
    blocks = C.lists(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    path = blocks.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert blocks.count() == sum(g.num_rows for g in groups) == 40
    assert max(g.num_rows for g in groups) <= 6
