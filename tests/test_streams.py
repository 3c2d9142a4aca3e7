"""Stateful streams over several batches: forgetting, conversations compiled turn by turn, factions with betrayals."""

import os
import random
import tempfile
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from engram.operators import cognition
from engram.streaming import jobs


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stream(spark, folder, schema, batches, name="in"):
    """A stream that reads one file a batch, in the order of the batches."""
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    at = len(os.listdir(f"{folder}/{name}"))
    for i, rows in enumerate(batches, at):
        path = f"{folder}/{name}/{i:03}.parquet"
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), path)
        os.utime(path, (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


MEMORY = "tenant_id string, id long, at long, expires_at long"


def forget(spark, folder, source):
    t = lambda c: F.timestamp_seconds(c).alias(c)
    with jobs.timers_and_lists(spark):
        out = jobs.forget(source.select("tenant_id", "id", t("at"), t("expires_at")))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["tenant_id"], r["id"], int(r["expired_at"].timestamp())) for r in spark.read.parquet(f"{folder}/out").collect())


def test_forgetting(spark, folder):
    first = [
        [("a", 1, 100, 200), ("a", 2, 100, None), ("b", 1, 100, 150), ("a", 3, 100, 900)],
        [("a", 1, 140, 400), ("a", 4, 120, 110), (None, None, 160, None)],  # 1 is refreshed, 4 has expired already, the clock goes on
        [("b", 2, 300, 310), ("b", 2, 300, 320)],
    ]
    source = stream(spark, folder, MEMORY, first)
    assert forget(spark, folder, source) == [("a", 4, 110), ("b", 1, 150)]
    assert forget(spark, folder, source) == [("a", 4, 110), ("b", 1, 150)]  # a restart emits nothing twice
    source = stream(spark, folder, MEMORY, [[("c", 9, 500, 1000)], [(None, None, 900, None)]])
    assert forget(spark, folder, source) == [("a", 1, 400), ("a", 3, 900), ("a", 4, 110), ("b", 1, 150), ("b", 2, 320)]


MESSAGE = "conv_id long, turn long, role string, content string"
MARKERS, RESTATE = [("like", "like"), ("plan", "plan")], [("you like", "preference"), ("you plan", "goal")]


def compiled(turns):
    return cognition.channels(turns, MARKERS, RESTATE, ["done"])


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_in_any_order_give_the_batch_result(spark, folder, seed):
    rng = random.Random(seed)
    texts = ["I like tea", "I plan a trip", "you like tea", "you plan it, done", "well", None, ""]
    rows = [(c, t, rng.choice(["user", "assistant", "tool"]), rng.choice(texts)) for c in range(6) for t in range(rng.randrange(1, 12))]
    want = sorted(map(str, map(tuple, compiled(spark.createDataFrame(rows, MESSAGE)).collect())))
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    batches.append([(1, 0, "user", "replaced"), (0, 0, "user", "I like it")])
    final = {(c, t): (c, t, r, x) for b in batches for c, t, r, x in b}
    want = sorted(map(str, map(tuple, compiled(spark.createDataFrame(list(final.values()), MESSAGE)).collect())))
    for at in (2, len(batches)):  # stopped after two batches and started again
        source = stream(spark, folder, MESSAGE, batches[:2] if at == 2 else batches[2:])
        with jobs.timers_and_lists(spark):
            jobs.compile_turns(source, compiled, f"{folder}/out", f"{folder}/cp").start().awaitTermination()
    assert sorted(map(str, map(tuple, jobs.compiled_turns(spark, f"{folder}/out").collect()))) == want and want


def test_factions_with_betrayals(spark, folder):
    schema = "doc_id long, pos int, verb string, subject string, object string, faction string"
    source = stream(spark, folder, schema, [[(1, 0, "降", "a", "b", "wei"), (1, 1, "叛", "a", "b", None)], [(1, 2, "降", "a", "c", "shu"), (2, 0, "叛", "x", "y", None)]])
    jobs.factions(source, ["降"], ["叛"]).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {(1, 0, "a", "未知", "wei", "surrender"), (1, 1, "a", "wei", "wei", "betrayal"), (1, 2, "a", "wei", "shu", "surrender"), (2, 0, "x", "未知", "未知", "betrayal")}


def test_value_fusion(spark):
    m = spark.createDataFrame([(1, 0, "user", "I like tea"), (1, 1, "user", "worth keeping"), (1, 2, "assistant", None), (2, 0, "user", "I like tea")], MESSAGE)
    v = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y")], "conv_id long, turn long, category string")
    facts, items, summary = cognition.fuse(m, v, MARKERS)
    assert facts.count() == 2 and {(r["turn"], r["content"]) for r in items.collect()} == {(1, "worth keeping"), (2, None)}
    assert {r["conv_id"]: (r["messages"], r["high_value"], r["facts"], r["raw_items"], r["by_category"]) for r in summary.collect()} == {1: (3, 3, 1, 2, {"x": 2, "y": 1}), 2: (1, 0, 1, 0, None)}
