"""Tables that streams keep: keyed rows in hash buckets with a change log, and capped logs; manifests make each change whole."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Manifests:
    """Numbered JSON documents in a folder of any file system that Spark writes; the last whole one is the truth.

    A number is written once: who finds it taken has lost a race and must start again from the newer state. A document
    cut off by a crash does not parse and is passed over.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, *parts: str) -> Any:
        """The document, or None if it is missing or cut off."""
        at = self._at(*parts)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def write(self, doc: Any, *parts: str, replace: bool = False) -> None:
        out = self._fs.create(self._at(*parts), replace)
        try:
            out.write(bytearray(json.dumps(doc).encode()))
        finally:
            out.close()

    def last(self) -> tuple[int, Any]:
        """(number, document) of the newest whole manifest; (0, None) if there is none."""
        for name in reversed(self.names("_manifest")):
            if name.endswith(".json") and (doc := self.read("_manifest", name)) is not None:
                return int(name.removesuffix(".json")), doc
        return 0, None

    def put(self, number: int, doc: Any) -> None:
        name = f"{number:012d}.json"
        cut_off = self._fs.exists(self._at("_manifest", name)) and self.read("_manifest", name) is None
        self.write(doc, "_manifest", name, replace=cut_off)

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._at(*parts), True)


def query_id(spark: SparkSession) -> str:
    """What names the stream whose foreachBatch runs now: its checkpoint's id; a new checkpoint has a new one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


class KeyedStore:
    """The last row of each key, by `order`, in hash buckets; a batch rewrites only the buckets it touches.

    Each batch that changes something makes a version: new files for its buckets, a segment of the change log, and a
    manifest that names them. Until the manifest stands nothing has changed, and a batch that is run again, or a stream
    that starts over with a new checkpoint or leaves numbers out, gives the same rows, as the greater `order` wins and
    the stored row stands on a tie. Old files stay until compact(), so readers of an older version are not disturbed.

    Rows with a null in the key have a key of their own; rows with a null order lose to all others. A row whose `gone`
    column is true takes its key out of the list and is told to readers as a change; its order is kept, so that a
    replayed older row does not bring it back. One writer at a time: a second one fails on the manifest's number.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, buckets: int = 64, gone: str | None = None):
        self.spark, self.path, self.key, self.order, self.gone = spark, path.rstrip("/"), key, order, gone
        self.files = Manifests(spark, self.path)
        self.buckets = buckets

    def _state(self) -> tuple[int, dict]:
        version, doc = self.files.last()
        return version, doc or {"buckets": {}, "count": self.buckets, "log": {}, "floor": 0, "applied": {}, "schema": None}

    def version(self) -> int:
        return self._state()[0]

    def put(self, batch: DataFrame, number: int, stream: str | None = None) -> None:
        """Upserts a batch, a function for foreachBatch. Columns stay those of the first batch."""
        stream = stream or query_id(self.spark)
        version, doc = self._state()
        if doc["applied"].get(stream, -1) >= number:
            return
        columns = [c for c in batch.columns if c not in ("_bucket", "_version")]
        schema = T.StructType.fromJson(json.loads(doc["schema"])) if doc["schema"] else batch.select(*columns).schema
        count, new = doc["count"], version + 1
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(count)).cast("int")
        rows = batch.select(*schema.names, bucket.alias("_bucket")).withColumn("_version", F.lit(new).cast("long"))
        part = uuid.uuid4().hex[:12]
        incoming = f"{self.path}/incoming/{part}"
        self._last(rows).write.parquet(incoming)  # the batch is computed once, by keys
        rows = self.spark.read.parquet(incoming)
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        changed: list[int] = []
        if touched:
            old = [doc["buckets"][str(b)] for b in touched if str(b) in doc["buckets"]]
            both = rows.unionByName(self._read(old, schema)) if old else rows
            target = f"state/{new:012d}-{part}"
            self._last(both).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{target}")
            written = self.spark.read.parquet(f"{self.path}/{target}").where(F.col("_version") == new)
            log = f"log/{new:012d}-{part}"
            written.select(*schema.names, "_version", "_bucket").write.parquet(f"{self.path}/{log}")
            changed = sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/{log}").select("_bucket").distinct().collect())
            for b in changed:
                doc["buckets"][str(b)] = f"{target}/_bucket={b}"
            if changed:
                doc["log"][str(new)] = log
        doc["applied"][stream] = number
        doc["schema"] = schema.json()
        self._swap(new, doc)
        self.files.delete("incoming", part)

    def _swap(self, number: int, doc: dict) -> None:
        self.files.put(number, doc)

    def _last(self, rows: DataFrame) -> DataFrame:
        """One row a key: the greatest order, then the oldest version."""
        rest = [c for c in rows.columns if c not in self.key]
        best = F.max_by(F.struct(*rest), F.struct(F.col(self.order).isNotNull(), F.col(self.order), -F.col("_version")))
        return rows.groupBy(*self.key).agg(best.alias("_r")).select(*self.key, "_r.*").select(*rows.columns)

    def _read(self, parts: list[str], schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("_version", T.LongType()), T.StructField("_bucket", T.IntegerType())])
        if not parts:
            return self.spark.createDataFrame([], full)
        frames: dict[str, list[str]] = {}
        for p in parts:
            frames.setdefault(p.split("/_bucket=")[0], []).append(f"{self.path}/{p}")
        out = None
        for base, paths in frames.items():
            one = self.spark.read.schema(full).option("basePath", f"{self.path}/{base}").parquet(*paths).select(*full.names)
            out = one if out is None else out.unionByName(one)
        return out

    def _shown(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        live = df.where(~F.coalesce(F.col(self.gone), F.lit(False))) if self.gone else df
        return live.select(*schema.names)

    def table(self) -> DataFrame:
        """The whole list as of now."""
        _, doc = self._state()
        if not doc["schema"]:
            raise ValueError("nothing has been put into this store")
        schema = T.StructType.fromJson(json.loads(doc["schema"]))
        return self._shown(self._read(list(doc["buckets"].values()), schema), schema)

    def changes(self, since: int) -> DataFrame | None:
        """Rows changed after version `since`, with _version, which orders them; None if the log no longer reaches back to it."""
        version, doc = self._state()
        if since < doc["floor"] or not doc["schema"]:
            return None
        schema = T.StructType.fromJson(json.loads(doc["schema"]))
        return self._read_log([p for v, p in doc["log"].items() if int(v) > since], schema)

    def _read_log(self, parts: list[str], schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("_version", T.LongType())])
        return self.spark.read.schema(full).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], full)

    def follow(self, reader: str) -> tuple[str, DataFrame, int]:
        """("list", all rows, version) for a reader that is new or fell behind the log, else ("changes", rows since its offset, version).

        A list replaces what the reader has, changes are put over it by key. Call acknowledge() once they are taken.
        """
        at = self.files.read("_readers", f"{reader}.json")
        version = self.version()
        changes = self.changes(at["version"]) if at else None
        return ("list", self.table(), version) if changes is None else ("changes", changes, version)

    def acknowledge(self, reader: str, version: int) -> None:
        self.files.write({"version": version}, "_readers", f"{reader}.json", replace=True)

    def compact(self, keep_versions: int = 100) -> None:
        """Cuts the change log to the last keep_versions versions and deletes what the newest manifest does not name.

        A reader that is further behind gets the list. Not to run beside put().
        """
        version, doc = self._state()
        floor = max(doc["floor"], version - keep_versions)
        doc["log"] = {v: p for v, p in doc["log"].items() if int(v) > floor}
        doc["floor"] = floor
        self._swap(version + 1, doc)
        used = {p.split("/")[1] for p in (*doc["buckets"].values(), *doc["log"].values())}
        for folder in ("state", "log"):
            for name in self.files.names(folder):
                if name not in used:
                    self.files.delete(folder, name)
        for name in self.files.names("incoming"):
            self.files.delete("incoming", name)
        live = {b: p for b, p in doc["buckets"].items()}
        for folder in {p.rsplit("/", 1)[0] for p in live.values()}:
            for name in self.files.names(folder):
                if name.startswith("_bucket=") and live.get(name.split("=")[1]) != f"{folder}/{name}":
                    self.files.delete(folder, name)
        for name in self.files.names("_manifest")[:-1]:
            self.files.delete("_manifest", name)


class CappedLog:
    """Rows appended file by file; compact() keeps the newest `cap` rows of each key and rewrites only files that lose some.

    With each file go its bounds: per key the number of rows and the least and greatest order. From them compact() tells
    which files hold only rows that stay, or none; the others alone are read. Ties at the cap all stay out or in by
    `tie`, so the result is exact. A null order is the oldest.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, tie: str, cap: int):
        self.spark, self.path, self.key, self.order, self.tie, self.cap = spark, path.rstrip("/"), key, order, tie, cap
        self.files = Manifests(spark, self.path)

    def _state(self) -> tuple[int, dict]:
        version, doc = self.files.last()
        return version, doc or {"files": [], "applied": {}}

    def append(self, rows: DataFrame, number: int | None = None, stream: str | None = None) -> None:
        """Adds rows; with a number, a batch of a stream that has been added already adds nothing."""
        version, doc = self._state()
        stream = stream or query_id(self.spark)
        if number is not None and doc["applied"].get(stream, -1) >= number:
            return
        doc["files"].append(self._write(rows, version + 1))
        if number is not None:
            doc["applied"][stream] = number
        self.files.put(version + 1, doc)

    def _write(self, rows: DataFrame, version: int) -> str:
        name = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/rows/{name}")
        got = self.spark.read.parquet(f"{self.path}/rows/{name}")
        order = F.coalesce(F.col(self.order).cast("double"), F.lit(float("-inf")))
        got.groupBy(F.col(self.key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).withColumn("file", F.lit(name)).write.parquet(f"{self.path}/bounds/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/rows/{n}" for n in names])

    def table(self) -> DataFrame:
        """The newest `cap` rows of each key, compacted or not."""
        _, doc = self._state()
        if not doc["files"]:
            raise ValueError("nothing has been added to this log")
        return self._newest(self._read(doc["files"]))

    def _newest(self, rows: DataFrame) -> DataFrame:
        by = W.partitionBy(self.key).orderBy(F.col(self.order).desc_nulls_last(), F.col(self.tie).desc())
        return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= self.cap).drop("_n")

    def doubtful(self, names: list[str]) -> tuple[list[str], list[str]]:
        """(files to read, files to drop whole) by the bounds of all files alone."""
        b = self.spark.read.parquet(*[f"{self.path}/bounds/{n}" for n in names])
        # rows surely newer than all of a file's: those of files whose low is above its high; at most newer: high not below its low
        starts = b.select("key", F.col("low").alias("t"), "n", F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("ask"))
        ends = b.select("key", F.col("high").alias("t"), "n", F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("ask"))
        above = starts.unionByName(b.select("key", F.col("high").alias("t"), F.lit(0).cast("long").alias("n"), "file", F.lit("above").alias("ask")))
        not_below = ends.unionByName(b.select("key", F.col("low").alias("t"), F.lit(0).cast("long").alias("n"), "file", F.lit("reach").alias("ask")))
        down = W.partitionBy("key").orderBy(F.desc("t"))
        above = above.withColumn("newer", F.coalesce(F.sum("n").over(down.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n").over(W.partitionBy("key", "t")), F.lit(0))).where("ask is not null").select("key", "file", "newer")
        reach = not_below.withColumn("most", F.sum("n").over(down.rangeBetween(W.unboundedPreceding, W.currentRow))).where("ask is not null").select("key", "file", "most")
        per = above.join(reach, [above["key"].eqNullSafe(reach["key"]), above["file"] == reach["file"]]).select(above["file"], "newer", "most")
        f = per.groupBy("file").agg(F.min(F.col("newer") >= self.cap).alias("gone"), F.min(F.col("most") <= self.cap).alias("stays")).collect()  # a row a file
        return sorted(r["file"] for r in f if not r["gone"] and not r["stays"]), sorted(r["file"] for r in f if r["gone"])

    def compact(self) -> None:
        """Rewrites the files that lose rows to the cap; the others keep their names."""
        version, doc = self._state()
        read, gone = self.doubtful(doc["files"])
        kept = [n for n in doc["files"] if n not in gone and n not in read]
        if read:
            # ranks need the newest rows of the same keys, which files that stay may hold: of those only key and order
            keys = self._read(read).select(F.col(self.key).alias("_k")).distinct()
            slim = self._read(read).select(self.key, self.order, self.tie, F.lit(True).alias("_own"))
            if kept:
                others = self._read(kept).select(self.key, self.order, self.tie, F.lit(False).alias("_own"))
                slim = slim.unionByName(others.join(keys, F.col(self.key).eqNullSafe(F.col("_k")), "left_semi"))
            left = self._newest(slim).where("_own").select(F.col(self.key).alias("_k"), F.col(self.order).alias("_o"), F.col(self.tie).alias("_t")).distinct()
            for n in read:  # file by file, so that a file that loses nothing keeps its name
                rows = self._read([n])
                stay = rows.join(left, F.col(self.key).eqNullSafe(F.col("_k")) & F.col(self.order).eqNullSafe(F.col("_o")) & F.col(self.tie).eqNullSafe(F.col("_t")), "left_semi")
                had, has = rows.count(), stay.count()
                if has == had:
                    kept.append(n)
                elif has:
                    kept.append(self._write(stay, version + 1))
        doc["files"] = sorted(kept)
        self.files.put(version + 1, doc)
        for folder in ("rows", "bounds"):
            for name in self.files.names(folder):
                if name not in doc["files"]:
                    self.files.delete(folder, name)
        for name in self.files.names("_manifest")[:-1]:
            self.files.delete("_manifest", name)
