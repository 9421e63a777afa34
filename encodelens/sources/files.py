"""Readers of documents, samples, listings and logs, and writers of run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.functions.scalars import phase_key, split_command, stage_codec

RUN_RECORD = (
    "schema_version int, job_id string, output string, config struct<codec: string, ladder: string, burnin: boolean>, "
    "phases array<struct<phase: string, n: bigint, span_s: double, wall_s: double>>, "
    "stages array<struct<key: string, status: string, started: bigint, ended: bigint>>, "
    "cost struct<spot: double, egress: double, total: double>, vmaf map<string,double>, argv map<string,array<string>>, _corrupt_record string"
)
SIDECAR = "s3_prefix string, expires_at string, gone boolean, reason string, _corrupt_record string"
SWEEP = "codec string, mode string, resolution string, bitrate_mbps double, vmaf double"


def usable(records: DataFrame) -> DataFrame:
    """Run records that could be read and name their job."""
    return records.where(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull()).drop("_corrupt_record")


def sidecars(documents: DataFrame) -> DataFrame:
    """State documents that could be read and have a prefix."""
    return documents.where(F.col("_corrupt_record").isNull() & (F.coalesce("s3_prefix", F.lit("")) != "")).drop("_corrupt_record")


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records under a path; unknown fields are ignored, and documents that cannot be read are left out."""
    df = spark.read.schema(RUN_RECORD).option("multiLine", True).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(path)
    return usable(df.withColumn("path", F.col("_metadata.file_path")))


def read_sidecars(spark: SparkSession, path: str, name: str = ".remote.json") -> DataFrame:
    """State documents of one name; those without a prefix are none."""
    df = spark.read.schema(SIDECAR).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{name}").json(path)
    return sidecars(df)


def read_samples(logs: DataFrame, col: str = "value", fields: tuple[str, ...] = ("ts", "hourly", "used", "total", "queued", "running"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of JSON lists of positional samples; short old rows have nulls at the end."""
    rows = logs.select(*keep, F.explode(F.from_json(col, "array<array<double>>")).alias("r"))
    return rows.select(*keep, *[F.try_element_at("r", F.lit(i + 1)).alias(n) for i, n in enumerate(fields)]).where("ts is not null")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel, bytes, mtime) of all files under a root, from the listing alone: no content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", rf"^[a-z0-9]+:/+{base.replace('.', chr(92) + '.')}/", "")
    return df.select(rel.alias("rel"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"))


def scan_outputs(files: DataFrame) -> DataFrame:
    """Per output folder: bytes, files, newest time; hidden ones, temporary ones and dated backups are left out."""
    name = F.split_part("rel", F.lit("/"), F.lit(1))
    f = files.where(F.contains("rel", F.lit("/"))).withColumn("name", name)
    f = f.where(~F.col("name").startswith(".") & ~F.col("name").endswith("_tmp") & ~F.col("name").rlike(r"_\d{8}(_\d{6})?$"))
    return f.groupBy("name").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"), F.max("mtime").alias("mtime"))


def output_files(files: DataFrame) -> DataFrame:
    """Files per output with a total row each (null file) and one over all (null output)."""
    f = files.where(F.contains("rel", F.lit("/"))).select(F.split_part("rel", F.lit("/"), F.lit(1)).alias("output"), F.regexp_replace("rel", "^[^/]*/", "").alias("file"), "bytes")
    return f.rollup("output", "file").agg(F.sum("bytes").alias("bytes"))


def parse_ffmpeg_log(lines: DataFrame) -> DataFrame:
    """(source, command, argv) of lines with an `[ffmpeg] ` mark; a command with an unclosed quote goes."""
    out = lines.where(F.contains("line", F.lit("[ffmpeg] "))).select("source", F.split_part("line", F.lit("[ffmpeg] "), F.lit(2)).alias("command"))
    return out.withColumn("argv", split_command("command")).where("argv is not null")


def read_newest_logs(spark: SparkSession, path: str, newest: int, name: str = "*.log") -> DataFrame:
    """(source, line) of the newest files by modification time, ties by path; the others are listed but never opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    chosen = [r.path for r in files.orderBy(F.desc("modificationTime"), "path").limit(newest).collect()]
    if not chosen:
        return spark.createDataFrame([], "source string, line string")
    return spark.read.text(chosen).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("line"))


def read_sweep_csv(spark: SparkSession, path: str) -> DataFrame:
    """A rate-quality sweep; rows that do not fit the columns are left out."""
    return spark.read.schema(SWEEP).option("header", True).option("mode", "DROPMALFORMED").csv(path)


#: The codecs of names in the order in which they are looked for, and the stages that one packaging job drives.
NAME_CODECS, PACKAGING = ("h264", "hevc", "av1"), ("package", "fragments", "hls")


def parse_job_names(names: DataFrame, col: str = "name") -> DataFrame:
    """Job names with the keys of the stages that they drive, a row a key: stage_key, codec, label, height, chunk.

    var-CODEC-LABEL-cN-... is a chunk, var-CODEC-LABEL-whole-... a whole rung, pkgall-CODEC-... three stages, mezz-... and
    audio-... one each. Other names have one row with nulls.
    """
    part = F.split(F.col(col), "-")
    at = lambda i: F.get(part, i)
    codec, label, piece = at(1), at(2), at(3)
    var = (at(0) == "var") & (F.size(part) > 4) & codec.rlike(r"^\w+$") & label.rlike(r"^\w+$") & piece.rlike(r"^(whole|c\d+)$")
    chunk = F.when(piece != "whole", F.substring(piece, 2, 20).try_cast("int"))
    rung = F.concat_ws(":", F.lit("encode"), codec, label)
    packs = (at(0) == "pkgall") & (F.size(part) > 2)
    keys = (
        F.when(var, F.array(F.when(chunk.isNull(), rung).otherwise(F.concat(rung, F.lit(":chunk"), chunk.cast("string")))))
        .when(packs, F.array(*[F.concat(F.lit(f"{s}:"), codec) for s in PACKAGING])).when(at(0) == "mezz", F.array(F.lit("mezzanine"))).when(at(0) == "audio", F.array(F.lit("audio")))
    )
    keys = F.when(F.contains(col, F.lit("-")), keys)
    return names.select("*", F.explode_outer(keys).alias("stage_key"), F.when(var | packs, codec).alias("codec"), F.when(var, label).alias("label"), F.when(var, F.regexp_extract(label, r"^(\d+)p", 1).try_cast("int")).alias("height"), F.when(var, chunk).alias("chunk"))


def parse_folder_names(names: DataFrame, col: str = "name") -> DataFrame:
    """Names of output folders with codec, partial (as 200ms) and padding, by the marks between underscores.

    A partial mark is what follows the first _p up to the next underscore, if it is digits alone.
    """
    c = F.col(col)
    codec = F.lit(None).cast("string")
    for known in reversed(NAME_CODECS):
        codec = F.when(c.endswith(f"_{known}") | c.contains(f"_{known}_"), known).otherwise(codec)
    first = F.split_part(F.substring_index(F.substr(c, F.instr(c, "_p") + 2), "_", 1), F.lit("_"), F.lit(1))
    partial = F.when(F.contains(c, F.lit("_p")) & first.rlike(r"^\d+$"), F.concat(first, F.lit("ms")))
    return names.withColumns({"codec": codec, "partial": partial, "padding": F.when(c.contains("_padblack"), "black").when(c.contains("_padpink"), "pink")})


def run_records(stages: DataFrame, outputs: DataFrame) -> DataFrame:
    """One nested record per output folder (job, dir, codec, source): its stages by seq, phases as first seen, and rungs.

    A folder's record has the stages of its codec and those of none, and of a job with several files those of its own
    source alone. Stages per job are bounded by its plan.
    """
    keys = ["job", "dir", "codec", "source"]
    # whether a job has several files is told by its rows in order, so stages and outputs meet in one join, by job
    many = F.min("file").over(W.partitionBy("job")) < F.max("file").over(W.partitionBy("job"))
    s = stages.withColumn("_codec", stage_codec("key")).withColumn("_many", F.coalesce(many, F.lit(False))).join(outputs.select(*keys), "job")
    s = s.where((F.col("_codec").isNull() | (F.col("_codec") == F.col("codec"))) & (~F.col("_many") | (F.col("file") == F.col("source"))))
    one = F.struct("seq", "key", "status", "started", "ended", "cpu_s")
    ph = s.withColumn("phase", phase_key("key")).groupBy(*keys, "phase").agg(F.collect_list(one).alias("s"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"), (F.max("ended") - F.min("started")).alias("span_s"), F.first("_codec").alias("_codec"))
    rung = F.when(F.col("_codec").isNotNull(), F.split_part("phase", F.lit(":"), F.lit(3)))
    r = ph.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("stages"), F.array_sort(F.collect_list(F.struct("first_seq", "phase", "n", "span_s"))).alias("phases"), F.array_sort(F.collect_set(rung)).alias("rungs"))
    return r.select("dir", "job", "codec", "source", "stages", "phases", "rungs", F.lit(1).alias("schema_version"))


def with_costs(records: DataFrame, costs: DataFrame | Column) -> DataFrame:
    """Records with the cost of their folder; a cost of all zeros is null, as nothing was measured.

    costs: (dir, spot, egress, total), or the struct of the last three where a record tells it itself, which needs no join.
    """
    measured = lambda c: F.when(c["total"] > 0, c)
    if isinstance(costs, Column):
        return records.withColumn("cost", measured(costs))
    return records.join(costs.select("dir", measured(F.struct("spot", "egress", "total")).alias("cost")), "dir", "left")


def write_run_records(records: DataFrame, path: str) -> None:
    """Records as JSON, dealt by job in as many files as there are tasks."""
    records.write.mode("append").json(path)
