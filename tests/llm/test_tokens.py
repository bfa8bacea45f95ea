import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lagloom.llm import packing, pieces, rans, token_counts, token_files


def plain(name, text, end):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(pieces.vocabulary(name)).encode(text or "", add_special_tokens=False).ids
    return np.asarray([*ids, *end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_exact(name):
    rng = random.Random(5)
    parts = list(" \n\t  ab.,'sé1<|> ́Σ漢😀\x1c\x01") + [" word", " the", "'s", "\nFoo", "<|endoftext|>", "　", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", " ", "a\n\n", "ΣΑΣ ΣΑΣ. x"]
    e = pieces.PieceEncoder(name, limit=50)
    for _ in range(2):  # the second time with a full memory
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            assert e.encode(some) == e._plain(some)


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.4, 150_000) % 50_257).astype(np.int64)
    freq, bits = rans.quantise(np.bincount(ids, minlength=50_257))
    assert freq.sum() == 1 << bits and (freq[np.unique(ids)] > 0).all()
    coder = rans.Coder(freq, bits)
    blocks = [ids[:0], ids[:1], ids[:17], ids[:8192], ids[:8193], ids[:65_536], ids]
    coded = coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(coded), strict=True))
    entropy = Counter(ids.tolist())
    least = sum(-c * np.log2(c / len(ids)) for c in entropy.values()) / 8
    assert len(coded[-1]) < 1.1 * least + 4000
    bad = bytearray(coded[3])
    bad[200] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode([bytes(bad)])
    one = rans.Coder(*rans.quantise(np.asarray([0, 7])))
    assert one.decode(one.encode([np.ones(100, np.int64)]))[0].tolist() == [1] * 100


def test_token_files_round_trip(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(odd_docs, path, "byte_bpe_50k.json", 2)
    want = Counter((r["doc_id"], plain("byte_bpe_50k.json", r["text"], [2]).tobytes()) for r in odd_docs.collect())
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], np.asarray(r["ids"], "<u4").tobytes()) for r in rows) == want
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6]
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    digests = {(r["start"], r["ids_crc32"]) for r in token_files.digest_tokens(spark, path).collect()}
    assert digests == {(r["start"], zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())) for r in rows}


def test_token_files_empty(spark, no_docs, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(no_docs, path, "byte_bpe_50k.json", 2)
    assert token_files.digest_tokens(spark, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, odd_docs, tmp_path, name):
    cache = f"file://{tmp_path}/c"
    got = sorted(map(tuple, token_counts.count_tokens(odd_docs, name, cache).collect()), key=str)
    if name.endswith(".json"):
        count = lambda t: len(plain(name, t, []))
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary(name))
        count = lambda t: len(p.encode(t or ""))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), count(r["text"]), count(r["text"]) > 512) for r in odd_docs.collect()), key=str)
    assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == 6  # null and empty are one content, the repeated row another
    more = odd_docs.unionByName(spark.createDataFrame([(9, "new words", "en", "s", 9, 9)], odd_docs.schema))
    assert sorted(map(tuple, token_counts.count_tokens(more, name, cache).collect()), key=str)[:3] == sorted([*want, (9, 9, count("new words"), False)], key=str)[:3]
    assert spark.read.parquet(cache).count() == 7


def test_counts_empty(no_docs):
    assert token_counts.count_tokens(no_docs, "byte_bpe_50k.json").count() == 0


def test_fullest_against_all_sums():
    rng = random.Random(2)
    for _ in range(200):
        left = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        free = rng.randint(1, 80)
        sums = {0}
        for n, c in left.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        chosen = packing.fullest(free, left)
        assert all(c <= left[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= free)


def test_plan_uses_each_piece_once():
    rng = random.Random(3)
    lengths = Counter(rng.randint(1, 100) for _ in range(3000))
    plan = packing.plan_bins(dict(lengths), 100)
    used = Counter()
    for bins, chosen in plan:
        assert sum(n * c for n, c in chosen) <= 100
        for n, c in chosen:
            used[n] += bins * c
    assert used == lengths
    # Within 1 % of what the lengths fill at least.
    assert sum(b for b, _ in plan) <= 1.01 * sum(n * c for n, c in lengths.items()) / 100 + 1


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, "word_bpe_49k.json", capacity=64).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = plain("word_bpe_49k.json", r["text"], [0])
        for k, at in enumerate(range(0, len(ids), 64)):
            want[r["doc_id"], k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 64) + 1
    assert packing.pack(no_docs, "word_bpe_49k.json").count() == 0


def test_a_cache_that_two_runs_appended_to(spark, tmp_path):
    """Both found the same misses; no row is doubled, other versions' counts are not taken, hits are not encoded."""
    name, cache = "byte_bpe_50k.json", f"file://{tmp_path}/c"
    docs = spark.createDataFrame([(1, "some words"), (2, "other words here"), (2, "some words"), (None, None)], "doc_id long, text string")
    want = sorted(map(tuple, token_counts.count_tokens(docs, name, cache).collect()), key=str)
    assert len(want) == 4
    once = spark.read.parquet(cache).collect()
    spark.createDataFrame(once).write.mode("append").partitionBy("version").parquet(cache)
    spark.createDataFrame([(r["digest"], 99, "another") for r in once], token_counts.CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache)
    assert spark.read.parquet(cache).count() == 9
    assert sorted(map(tuple, token_counts.count_tokens(docs, name, cache).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == 9
    # A stored count is taken as it is.
    version = token_counts.tokenizer_version(name)
    digest = bytearray(hashlib.sha256((version + "never encoded").encode()).digest())
    spark.createDataFrame([(digest, 77, version)], token_counts.CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache)
    more = spark.createDataFrame([(5, "never encoded")], "doc_id long, text string")
    assert [tuple(r) for r in token_counts.count_tokens(more, name, cache).collect()] == [(5, 13, 77, False)]


def test_many_misses_go_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FEW_MISSES", 0)
    docs = spark.createDataFrame([(1, "some words"), (2, "some words"), (3, "x")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in token_counts.count_tokens(docs, "byte_bpe_50k.json", f"file://{tmp_path}/c").collect()) == [(1, 10, 2), (2, 10, 2), (3, 1, 1)]


def test_the_query_reads_what_it_has_stored(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "some words"), (2, "some words"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, token_counts.op2_token_counts(spark, str(tmp_path)).collect()))

    def fails(name):
        raise AssertionError("a stored text is encoded again")

    monkeypatch.setattr(token_counts, "_count", fails)
    assert sorted(map(tuple, token_counts.op2_token_counts(spark, str(tmp_path)).collect())) == want
