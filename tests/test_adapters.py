"""The data source: chapters, JSON rows and vectors, in batch with pushed filters, and as a stream that resumes."""

import json
import os
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from engram.sources import adapters


@pytest.fixture(scope="module", autouse=True)
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(folder, name, text, at=0):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(f"{folder}/{name}", (time.time() - 1000 + at,) * 2)


def test_numerals():
    cases = {"一百二十": 120, "十": 10, "二十三": 23, "120": 120, "十万": 100000, "一百二十万": 1200000, "一千零一": 1001, "零": 0, "万": 10000, "": 0}
    assert {k: adapters.numeral(k) for k in cases} == cases


def test_chapters_of_a_text():
    text = "﻿preface 第三日 第一回 甲\na 第一回 again\n第二回 乙 在第三天回家\nb\n第零回 x 第十章 c "
    assert adapters.chapters(text) == [(1, "甲\na 第一回 again"), (2, "乙 在第三天回家\nb\n第零回 x"), (10, "c")]
    assert adapters.chapters("no header") == adapters.chapters("") == []


def test_novels(spark, folder):
    write(folder, "one.txt", "第一回 a 第二回 b")
    write(folder, "two.txt", "第一回 c")
    write(folder, "empty.txt", "")
    df = adapters.read(spark, "chapters", folder)
    assert sorted(map(tuple, df.collect())) == [("one", 1, "a"), ("one", 2, "b"), ("two", 1, "c")]
    assert [tuple(r) for r in df.where("novel = 'one' and chapter = 2 and body like '%b%'").collect()] == [("one", 2, "b")]
    assert df.where("novel = 'two'").rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 3  # other files stay closed


def test_rows_of_json(spark, folder):
    write(folder, "a.json", json.dumps([{"id": 1, "text": "x", "score": 7}, {"id": "b", "text": None}]))
    write(folder, "b.json", '{"id": "c", "text": "y", "score": -1}\n\n{"text": "z", "score": 0.25}\n')
    df = adapters.read(spark, "json", folder)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, [("1", "x", 1.0), ("b", None, 0.5), ("c", "y", 0.0), (None, "z", 0.25)]))
    assert [r["id"] for r in df.where("score >= 1").collect()] == ["1"] and df.where("id is null").count() == 1


def test_vectors_by_row_group(spark, folder):
    t = pa.table({"key": pa.array(range(100), pa.int64()), "v": [[float(i), 1.0] for i in range(100)], "label": ["x"] * 100})
    pq.write_table(t, f"{folder}/v.parquet", row_group_size=10)
    df = adapters.read(spark, "vectors", folder, id="key", vector="v", columns="label")
    assert df.columns == ["id", "vector", "label"] and df.count() == 100 and df.rdd.getNumPartitions() == 10
    near = df.where("id > 42 and id <= 55")
    assert near.rdd.getNumPartitions() == 2 and sorted(r["id"] for r in near.collect()) == list(range(43, 56))
    assert sorted(r["id"] for r in df.where("id in (5, 95)").collect()) == [5, 95]


def test_a_stream_resumes(spark, folder):
    write(folder, "a.txt", "第一回 a")
    out, cp = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def run():
        q = adapters.stream(spark, "chapters", folder).writeStream.format("parquet").option("path", out + "/t").option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["novel"], r["chapter"]) for r in spark.read.schema("novel string, chapter int, body string").parquet(out + "/t").collect())

    assert run() == [("a", 1)]
    assert run() == [("a", 1)]
    write(folder, "b.txt", "第一回 b 第二回 c", 5)
    assert run() == [("a", 1), ("b", 1), ("b", 2)]


def test_filters_that_are_not_pushed(spark, folder):
    write(folder, "one.txt", "第一回 a 第二回 b")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert [tuple(r) for r in adapters.read(spark, "chapters", folder).where("chapter = 2").collect()] == [("one", 2, "b")]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
