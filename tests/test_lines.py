import json
import os

import pytest
from pyspark.sql import functions as F

from lagloom.sources import lines

SCHEMA = "day string, id long, text string, v double"


def _write(path, name, rows):
    os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
    with open(f"{path}/{name}", "a", encoding="utf-8") as f:
        f.writelines(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


@pytest.fixture
def folder(tmp_path):
    for d in (1, 2, 3):
        for k in range(2):
            _write(tmp_path, f"day=2024-01-0{d}/part-{k}.json", [{"id": 100 * d + 10 * k + i, "text": f"é漢 {i}" * (i + 1), "v": i / 2} for i in range(10)])
    _write(tmp_path, "_SUCCESS", [])
    return str(tmp_path)


@pytest.mark.parametrize("chunk", [7, 100, 1 << 20])
def test_every_line_once_whatever_the_ranges(spark, folder, chunk):
    rows = lines.read(spark, folder, SCHEMA, chunk).collect()
    assert sorted(r.id for r in rows) == sorted(100 * d + 10 * k + i for d in (1, 2, 3) for k in range(2) for i in range(10))
    assert {(r.day, r.text, r.v) for r in rows if r.id == 213} == {("2024-01-02", "é漢 3" * 4, 1.5)}


def test_filters_are_pushed(spark, folder, capsys):
    df = lines.read(spark, folder, SCHEMA, 100, push=True).filter("day = '2024-01-02' and id > 211 and text is not null")
    assert sorted(r.id for r in df.collect()) == list(range(212, 220))
    df.explain()
    plan = capsys.readouterr().out
    assert "Filter" in plan and "day#" not in plan.split("Filter")[1].split("\n")[0]
    one = lines.read(spark, folder, SCHEMA, push=True).filter("day = '2024-01-02'")
    assert one.rdd.getNumPartitions() == 2 < lines.read(spark, folder, SCHEMA).rdd.getNumPartitions() == 6


def test_plans_that_follow_each_other_have_their_own_filters(spark, folder):
    whole = lines.read(spark, folder, SCHEMA, push=True)
    assert [whole.filter(f).count() for f in ("day = '2024-01-02'", "id > 311", "day in ('2024-01-01', '2024-01-03') and day > '2024-01-01'", "true", "day = 'no'", "true")] == [20, 8, 20, 60, 0, 60]


def test_without_pushing_one_plan_may_scan_twice(spark, folder):
    whole = lines.read(spark, folder, SCHEMA)
    one = lambda f: whole.filter(f)
    assert one("day = '2024-01-02' and id > 215").union(one("day = '2024-01-03'")).count() == 24
    assert one("day = '2024-01-02'").union(whole).count() == 80


def test_bad_lines(spark, tmp_path):
    _write(tmp_path, "a.json", [{"id": 1}, "no json\n", {"id": "text"}, "[1]\n", "\n", {"id": True}, {"id": 2, "more": 1}, {"id": None}, '{"id": 3}'])
    assert sorted(r.id for r in lines.read(spark, str(tmp_path), "id long").filter("id is not null").collect()) == [1, 2, 3]
    rows = lines.read(spark, str(tmp_path), "id long, _bad string").collect()
    assert sorted(r._bad for r in rows if r._bad) == ["[1]", "no json", '{"id": "text"}', '{"id": true}']
    assert sum(r._bad is None for r in rows) == 4
    assert lines.read(spark, str(tmp_path / "none"), "id long").collect() == []
    with pytest.raises(Exception, match="columns must be"):
        lines.read(spark, str(tmp_path), "at date").collect()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    log, out, seen = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "seen")

    def run():
        q = lines.stream(spark, str(log), "id long", 20).withColumn("at", F.current_timestamp()).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long").parquet(out).collect())

    _write(log, "0001.json", [{"id": i} for i in range(5)])
    _write(log, "0002.json", [{"id": 5}, '{"id": 6'])
    assert run() == [0, 1, 2, 3, 4, 5]
    assert run() == [0, 1, 2, 3, 4, 5]
    _write(log, "0002.json", ["}\n", {"id": 7}])
    _write(log, "0003.json", [{"id": i} for i in range(8, 20)])
    assert run() == list(range(20))
