import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import texts, vectors

SCHEMA = "id long, year int, company string, embedding array<float>"


def _rows(n=1500, dim=24, clusters=20, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.5 * rng.normal(size=(n, dim))
    return [(i, 2015 + i % 4, f"c{i % 3}", [float(np.float32(v)) for v in x[i]]) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    return vectors.build(table, str(tmp_path_factory.mktemp("index")), ["year"], lists=20)


def _queries(spark, n=30, dim=24):
    return spark.createDataFrame([(r[0], r[3]) for r in _rows(n, dim, seed=1)], "query_id long, embedding array<float>")


def _true(table, query, k, where=None):
    return [(r.id, round(r.distance, 9)) for r in texts.nearest(table, query, k, where).orderBy("distance", "id").collect()]


@pytest.mark.parametrize("where", [None, "year = 2016 and company = 'c1'"])
def test_exact_search_equals_the_full_scan(spark, table, index, where):
    got = {}
    for r in index.search(_queries(spark, 6), 10, where, exact=True).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.distance, 9)))
    for r in _rows(6):
        assert got[r[0]] == _true(table, r[3], 10, where)


def test_recall_and_partitions_read(spark, table, index):
    queries = _queries(spark)
    found = index.search(queries, 10).cache()
    true = spark.createDataFrame([(r[0], i) for r in _rows(30) for i, _ in _true(table, r[3], 10)], "query_id long, id long")
    assert vectors.recall(found, true).agg(F.avg("recall")).first()[0] >= 0.95
    assert index.probes < 10
    one = index.rows.filter(F.col("list").isin(index.probed(np.array([_rows(1)[0][3]]), index.probes)[0].tolist()))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(one) < files(index.rows) / 2


def test_the_first_pass_reads_codes_and_few_partitions(index, capsys):
    index.rows.filter((F.col("year") == 2016) & F.col("list").isin([3])).select("id", "list", "code").explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<id:bigint,code:binary>" in plan
    assert "PartitionFilters" in plan and "(year" in plan and "(list" in plan


def test_odd_vectors(spark, tmp_path):
    rows = [*_rows(40, 8, 3), (100, 2015, None, None), (101, 2015, "c", []), (102, 2015, "c", [0.0] * 8), (103, 2015, "c", [1.0, float("nan"), *[0.0] * 6]), (104, None, "c", [1.0] * 7), (105, 2016, "c", _rows(40, 8, 3)[0][3]), (105, 2016, "c", _rows(40, 8, 3)[0][3])]
    made = vectors.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"), ["year"])
    assert made.rows.count() == 42
    queries = spark.createDataFrame([(1, rows[0][3]), (2, None), (3, [0.0] * 8), (4, [1.0])], "query_id int, embedding array<float>")
    got = made.search(queries, 3, exact=True).orderBy("rank").collect()
    assert {r.query_id for r in got} == {1}
    assert [r.id for r in got[:2]] == [0, 105]
    assert made.search(queries.filter("query_id = 2"), 3).collect() == []


def test_an_empty_table(spark, tmp_path):
    made = vectors.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"))
    assert made.search(spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"), 3, exact=True).collect() == []


def test_rows_added_later_are_found(spark, table, index):
    extra = spark.createDataFrame([(9000, 2016, "c1", [3.0 * v for v in _rows()[0][3]])], SCHEMA)
    vectors.add(extra, index.path, ["year"], index.centroids, index.books)
    assert {r.id for r in index.search(spark.createDataFrame([(1, _rows()[0][3])], "query_id long, embedding array<float>"), 2, exact=True).collect()} == {0, 9000}


def test_queries_of_many_partitions_are_few_blocks(spark, table, index, monkeypatch):
    taken, block = [], vectors.VectorIndex._block
    monkeypatch.setattr(vectors.VectorIndex, "_block", lambda self, rows, q, *more: taken.append(len(q)) or block(self, rows, q, *more))
    queries = _queries(spark, 30).repartition(9)
    got = index.search(queries, 3, exact=True)
    assert taken == [30]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    monkeypatch.setattr(vectors, "BLOCK", 4)
    few = index.search(queries, 3, exact=True)
    assert sum(taken[1:]) == 30 and 1 < len(taken[1:]) <= 8
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, got.collect()))


def test_many_queries_are_one_pass_and_lists_are_not_tiny(spark, tmp_path, monkeypatch):
    """Folders and passes do not grow as the root of the rows for each metadata partition, or one for each thousand queries."""
    rows = _rows(2200, 8, 12)
    made = vectors.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"), ["year"])
    assert made.rows.select("year", "list").distinct().count() <= 2200 / 256
    taken, block = [], vectors.VectorIndex._block
    monkeypatch.setattr(vectors.VectorIndex, "_block", lambda self, rows, q, *more: taken.append(len(q)) or block(self, rows, q, *more))
    asked = spark.createDataFrame([(r[0], r[3]) for r in rows], "query_id long, embedding array<float>")
    got = {}
    for r in made.search(asked, 3, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert taken == [2200]
    x = np.array([r[3] for r in rows])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    assert got == {i: np.argsort(-s, kind="stable")[:3].tolist() for i, s in enumerate(x @ x.T)}


def test_copies_go_by_id_whatever_a_task_holds(spark, tmp_path, monkeypatch):
    """Equal vectors in many tiles and batches: the smallest ids, though a task drops candidates all the time."""
    for name, size in {"HELD": 64, "TILE": 7, "ROWS": 50}.items():
        monkeypatch.setattr(vectors, name, size, raising=False)
    rows = _rows(400, 24, 5)
    rows = [(r[0], r[1], r[2], rows[r[0] % 3][3] if r[0] >= 100 else r[3]) for r in rows]
    made = vectors.build(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "i"), lists=4)
    asked = spark.createDataFrame([(r[0], r[3]) for r in rows[:30]], "query_id long, embedding array<float>")
    got = {}
    for r in made.search(asked, 9, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(3):
        assert got[i] == [i, *[j for j in range(100, 400) if j % 3 == i][:8]]
    assert len(got) == 30 and all(len(ids) == 9 for ids in got.values())
