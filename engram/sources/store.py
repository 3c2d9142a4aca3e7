"""A table that is changed by key: rows are put in, changed and taken out by id, a batch at a time.

A batch is one folder, written whole, so it is there or it isn't, with everything that belongs to its rows (a memory and its
vector, a piece of evidence and its links). It is known by its number: written again after a failure, it replaces itself.
The table is what its batches come to, in their order; compact() writes that as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """A folder of batches of rows with this schema, by the columns `keys`. Keys are not null; of rows of one key in a batch
    one counts, the least by all columns that can be ordered. spark.read sees only whole batches."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str] = ("id",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = spark.createDataFrame([], schema).schema

    def _write(self, rows: DataFrame, op: str, batch: int) -> None:
        named = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*named, F.lit(op).alias("_op"), F.lit(batch).cast("long").alias("_batch"), F.lit(",".join(c for c in rows.columns if c not in self.keys)).alias("_set")).write.mode("overwrite").parquet(f"{self.path}/b={batch}")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Rows in, in place of those of the same key."""
        self._write(rows.select(self.schema.names), "put", batch)

    def insert(self, rows: DataFrame, batch: int) -> None:
        """Rows in whose key isn't there yet; others stay as they are."""
        self._write(rows.select(self.schema.names), "insert", batch)

    def update(self, changes: DataFrame, batch: int) -> None:
        """Columns of changes, beside the keys, take the place of those of rows that are there; other keys change nothing."""
        if unknown := set(changes.columns) - set(self.schema.names):
            raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
        self._write(changes, "update", batch)

    def delete(self, keys: DataFrame, batch: int) -> None:
        self._write(keys.select(self.keys), "delete", batch)

    def log(self) -> DataFrame:
        full = StructType([*self.schema.fields]).add("_op", "string").add("_batch", "long").add("_set", "string")
        if not self._there():
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path}/b=*")

    def _there(self) -> bool:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.path}/b=*")
        return len(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0

    def current(self) -> DataFrame:
        """The rows there are now: a fold over the changes of each key, of which there are at most as many as batches."""
        names = [c for c in self.schema.names if c not in self.keys]
        order = F.struct(*[f.name for f in self.schema if f.name in names and "map<" not in f.dataType.simpleString()]) if names else F.lit(0)
        w = Window.partitionBy(*self.keys, "_batch").orderBy(order)
        log = self.log().withColumn("_r", F.row_number().over(w)).where("_r = 1")
        steps = F.array_sort(F.collect_list(F.struct("_batch", "_op", "_set", F.struct(*names).alias("v"))), lambda a, b: (a["_batch"] - b["_batch"]).cast("int"))
        kind = f"struct<alive:boolean,v:struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in self.schema if f.name in names)}>>"
        state = lambda alive, v: F.struct(F.lit(alive).alias("alive"), v.alias("v"))

        def step(a, x):
            changed = F.struct(*[F.when(F.array_contains(F.split(x["_set"], ","), F.lit(c)), x["v"][c]).otherwise(a["v"][c]).alias(c) for c in names])
            taken = (x["_op"] == "put") | ((x["_op"] == "insert") & ~a["alive"])
            return F.when(taken, state(True, x["v"])).when(x["_op"] == "delete", state(False, x["v"])).when((x["_op"] == "update") & a["alive"], state(True, changed)).otherwise(a).cast(kind)

        start = F.struct(F.lit(False).alias("alive"), F.lit(None).cast(kind.split("v:", 1)[1][:-1]).alias("v")).cast(kind)
        folded = log.groupBy(*self.keys).agg(F.reduce(steps, start, step).alias("s")).where("s.alive")
        return folded.select(*self.keys, *[F.col(f"s.v.{c}").alias(c) for c in names]).select(self.schema.names)

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys."""
        return self.current().join(keys.select(self.keys).distinct(), self.keys, "left_semi")

    def compact(self, path: str) -> Store:
        """A new store at another path that holds the current rows as its one batch, 0; this one stays as it is."""
        new = Store(self.spark, path, self.schema, self.keys)
        new.put(self.current(), 0)
        return new


def append_facts(store: Store, facts: DataFrame, batch: int) -> DataFrame:
    """Facts are never changed: rows go in whose id isn't there, and (inserted, known) is returned."""
    keys = store.current().select("id")
    new = facts.join(keys, "id", "left_anti").select("id").distinct()
    counts = new.agg(F.count("*").alias("inserted")).join(facts.join(keys, "id", "left_semi").select("id").distinct().agg(F.count("*").alias("known")))  # one row each
    counts = store.spark.createDataFrame(counts.collect(), counts.schema)
    store.insert(facts, batch)
    return counts


def evidence_tables(store: Store) -> tuple[DataFrame, DataFrame]:
    """(evidence, links) of a store whose rows have id, doc_id, content and links (array of kind and source_id): each batch has
    written a piece of evidence and its links as one row, so neither is ever there without the other."""
    now = store.current()
    return now.drop("links"), now.select(F.col("id").alias("evidence_id"), F.inline("links"))
