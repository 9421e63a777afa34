"""What may be deleted, and why the rest is held; deleting itself is not done here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.functions.scalars import backup_base, is_backup


def prefix_of(key: str = "key"):
    """The first two path segments of an object's key."""
    return F.concat_ws("/", F.slice(F.split(key, "/"), 1, 2))


def output_state(outputs: DataFrame, now: int) -> DataFrame:
    """outputs with state (gone, expired, available), and whether they can be packaged or are lost for good.

    An expiry that cannot be read is none.
    """
    exp = F.unix_timestamp(F.try_to_timestamp(F.col("expires_at"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    expired = F.coalesce(exp < now, F.lit(False))
    out = outputs.withColumn("state", F.when(F.col("gone"), "gone").when(expired, "expired").otherwise("available"))
    ok = (F.col("state") == "available") & (F.col("s3_prefix") != "")
    return out.withColumn("packageable", ok).withColumn("unrecoverable", F.col("gone") & ~F.col("sidecar"))


def vmaf_state(outputs: DataFrame) -> DataFrame:
    """outputs (scores, failed, eligible) with done > failed > ineligible > pending."""
    return outputs.withColumn("vmaf_state", F.when(F.col("scores") > 0, "done").when(F.col("failed"), "failed").when(~F.col("eligible"), "ineligible").otherwise("pending"))


def rung_scores(rungs: DataFrame, scores: DataFrame) -> DataFrame:
    """rungs (output, codec, height) with vmaf, model and common_height from measured scores (output, codec, label, mean, model, common_height).

    A rung has the score of its plain label, as 720p, else that of its first numbered one, as 720p_2, else none. The model
    and the height of comparison are those of any rung of the output and codec that names a model, the first by label.
    """
    s = scores.where(F.col("mean").isNotNull()).withColumn("height", F.regexp_extract("label", r"^(\d+)p(?:_.*)?$", 1).try_cast("int"))
    plain = F.concat(F.col("height").cast("string"), F.lit("p")) == F.col("label")
    per = s.where(F.col("height").isNotNull()).groupBy("output", "codec", "height").agg(F.coalesce(F.max(F.when(plain, F.col("mean"))), F.min_by("mean", F.when(~plain, F.col("label")))).alias("vmaf"))
    of = scores.where(F.coalesce("model", F.lit("")) != "").groupBy("output", "codec").agg(F.min_by(F.struct("model", "common_height"), "label").alias("p")).select("output", "codec", "p.*")
    return rungs.join(per, ["output", "codec", "height"], "left").join(of, ["output", "codec"], "left")


def keep_list_anti(candidates: DataFrame, active: DataFrame, state_files: DataFrame, key: str = "id") -> DataFrame:
    """Candidates that neither active ids nor state files name."""
    return candidates.join(active.select(key).unionByName(state_files.select(key)).distinct(), key, "left_anti")


def gone_under_prefix(outputs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Outputs whose prefix is a deleted prefix or lies under one at a slash: an equi-join on each output's ancestors."""
    parts = F.split("s3_prefix", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    d = deleted.where(F.coalesce("prefix", F.lit("")) != "").select(F.rtrim("prefix", F.lit("/")).alias("_p")).distinct()
    hit = outputs.select("output", F.explode(up).alias("_p")).join(d, "_p", "left_semi").select("output").distinct()
    return outputs.join(hit, "output", "left_semi")


def prefix_usage(objects: DataFrame, now: int, skip_shallow: bool = True) -> DataFrame:
    """Per two-segment prefix: objects, bytes, seconds since the newest; shallower keys are left out or kept as they are."""
    o = objects.where(F.size(F.split("key", "/")) > 2) if skip_shallow else objects
    return o.groupBy(prefix_of().alias("prefix")).agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"), (F.lit(now) - F.max("modified")).alias("idle_s"))


def staging_gc(objects: DataFrame, keep: DataFrame, now: int, max_age_s: int, cache_age_s: int) -> DataFrame:
    """Each prefix with its action: would-delete when idle for its window and not kept; the mezz cache has a window of its own."""
    u = prefix_usage(objects, now).join(keep.select("prefix").distinct().withColumn("_kept", F.lit(True)), "prefix", "left")
    window = F.when(F.col("prefix").startswith("mezz/"), cache_age_s).otherwise(max_age_s)
    act = F.when(F.col("_kept"), "skipped").when((window > 0) & (F.col("idle_s") >= window), "would-delete").otherwise("skipped")
    return u.select("prefix", "objects", "bytes", "idle_s", act.alias("action"))


def tmp_gc(files: DataFrame, keep: DataFrame, now: int, max_age_s: int) -> DataFrame:
    """Job folders of digits only whose newest file is older than the window and that are not kept."""
    f = files.where(F.col("job").rlike(r"^\d+$")).groupBy("job").agg(F.max("mtime").alias("newest"), F.sum("bytes").alias("bytes"))
    return f.where((F.lit(max_age_s) > 0) & (F.col("newest") < now - max_age_s)).join(keep.select("job").distinct(), "job", "left_anti")


def archive_gc(entries: DataFrame, active: DataFrame, now: int, max_age_s: int, orphans: bool = False) -> DataFrame:
    """Dated backups past the window with why they are held, null if they may go: sidecar, keep, active, orphan in that order.

    A backup is an orphan if no live output has its base name.
    """
    b = entries.where(is_backup("name") & (F.lit(max_age_s) > 0) & (F.col("mtime") < now - max_age_s)).withColumn("base", backup_base("name"))
    live = entries.where(~is_backup("name")).select(F.col("name").alias("base")).distinct().withColumn("_live", F.lit(True))
    act = active.select(F.col("stem").alias("base")).distinct().withColumn("_active", F.lit(True))
    j = b.join(live, "base", "left").join(act, "base", "left")
    why = F.when(F.col("sidecar"), "sidecar").when(F.col("keep"), "keep").when(F.col("_active"), "active").when(F.col("_live").isNull() & F.lit(not orphans), "orphan")
    return j.select("output", "name", "base", "bytes", why.alias("held"))


def held_bytes(archive: DataFrame) -> DataFrame:
    return archive.groupBy(F.coalesce("held", F.lit("reclaimable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def failed_staging_gc(objects: DataFrame, now: int, max_age_s: int) -> DataFrame:
    """Prefixes with a _FAILED object older than the window, with what they hold."""
    f = objects.where(F.col("key").endswith("/_FAILED") & (F.col("modified") < now - max_age_s)).select(prefix_of().alias("prefix")).distinct()
    return objects.withColumn("prefix", prefix_of()).join(f, "prefix", "left_semi").groupBy("prefix").agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"))


def stale_uploads(uploads: DataFrame, keep: DataFrame, now: int, max_age_s: int) -> DataFrame:
    """Unfinished uploads under jobs/ older than the window, not of a kept prefix."""
    u = uploads.where(F.col("key").startswith("jobs/") & (F.lit(max_age_s) > 0) & (F.col("initiated") < now - max_age_s)).withColumn("prefix", prefix_of())
    return u.join(keep.select("prefix").distinct(), "prefix", "left_anti")


def purge_speed_keys(keys: DataFrame, codec: str, passes: str | None = None, machine: str | None = None) -> DataFrame:
    """Six-part speed keys with whether they are to go: of the codec, and of the pass and machine if given."""
    p = F.split("key", ":")
    hit = (F.size(p) == 6) & (F.get(p, 1) == codec)
    hit = hit & (F.get(p, 3) == passes) if passes is not None else hit
    hit = hit & (F.get(p, 0) == machine) if machine is not None else hit
    return keys.withColumn("doomed", F.coalesce(hit, F.lit(False)))


def stable_new_files(scans: DataFrame, outputs: DataFrame) -> DataFrame:
    """Video files whose size is not 0 and equal in the last two scans, without an output that begins with their stem."""
    by = W.partitionBy("name").orderBy("scan")
    s = scans.where(F.lower("name").rlike(r"\.(mp4|mkv|mov|avi|webm|ts|m3u8)$")).withColumn("_b", F.lag("size").over(by)).withColumn("_last", F.lead("scan").over(by).isNull())
    s = s.where(F.col("_last") & (F.col("size") > 0) & (F.col("size") == F.col("_b"))).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    # an output is named stem or stem_codec...: its own names cut at each underscore are the stems it can belong to
    parts = F.split("name", "_")
    up = outputs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("_", F.slice(parts, 1, n)))).alias("stem")).distinct()
    return s.join(up, "stem", "left_anti").select("name", "stem", "size")


def census_repair(states: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per key last known state against a status snapshot: seeded, repaired, unchanged, or protected as it is final."""
    m = {"SUBMITTED": "queued", "RUNNABLE": "queued", "STARTING": "starting", "RUNNING": "running", "SUCCEEDED": "done", "FAILED": "failed"}
    to = F.lit(None)
    for k, v in m.items():
        to = F.when(F.col("batch") == k, v).otherwise(to)
    from encodelens.operators.stages import rank

    j = states.join(snapshot.withColumn("snap", to), "key", "full_outer")
    act = F.when(F.col("snap").isNull(), "absent").when(F.col("status").isNull(), "seeded").when(F.col("status").isin("done", "failed"), "protected").when(rank(F.col("snap")) > rank(F.col("status")), "repaired").otherwise("unchanged")
    return j.select("key", "status", "snap", act.alias("action"))


def diff_sync(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files with whether they are to fetch: missing here or of another size."""
    l = local.select("rel", "size").distinct().withColumn("_have", F.lit(True))
    return remote.join(l, ["rel", "size"], "left").select("rel", "size", F.col("_have").isNull().alias("fetch"))


def splice_snapshot(inventories: DataFrame, enumerations: DataFrame, block_s: int = 86400) -> DataFrame:
    """Inventories with the newest enumeration of their bucket from before they were fetched; their own bytes if they have any.

    Both sides run through time together and carry the newest enumeration, so that they make no pairs. A bucket is cut in
    blocks of block_s seconds, into which the newest enumeration of earlier blocks is carried.
    """
    e = enumerations.where("bucket is not null and at is not null").select("bucket", F.col("at").alias("t"), F.struct("at", "listed_bytes").alias("e"))
    i = inventories.select("bucket", F.col("fetched_at").alias("t"), "bytes").distinct().withColumn("wanted", F.lit(True))
    both = i.unionByName(e, allowMissingColumns=True).withColumn("block", F.floor(F.col("t") / block_s))
    blocks = both.groupBy("bucket", "block").agg(F.max("e").alias("newest"))
    earlier = F.max("newest").over(W.partitionBy("bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(F.col("bucket").alias("_bucket"), F.col("block").alias("_block"), earlier.alias("carried"))
    here = F.max("e").over(W.partitionBy("bucket", "block").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow))
    g = both.withColumn("e", here).where("wanted")
    g = g.join(blocks, g["bucket"].eqNullSafe(blocks["_bucket"]) & g["block"].eqNullSafe(blocks["_block"]), "left").withColumn("e", F.coalesce("e", "carried"))
    return g.select("bucket", F.col("t").alias("fetched_at"), F.coalesce("bytes", "e.listed_bytes").alias("bytes"), F.when(F.col("bytes").isNull(), F.col("e.at")).alias("as_of"))


def output_logs(logs: DataFrame, names: DataFrame, jobs: DataFrame, head: int = 4096, gram: int = 4) -> DataFrame:
    """(log, name, how): logs of jobs whose output stem a name begins with (`job`), and other logs that mention the name
    anywhere in their first `head` characters (`content`).

    names and jobs (log, stem) meet by the beginnings of each name. Names and logs meet by the first `gram` characters of
    a name, which the distinct substrings of that length of each head must hold, and are then verified: equi-joins, not
    products. Shorter names are their own beginnings.
    """
    n = names.select("name").where("name <> ''").distinct()
    starts = n.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substring("name", F.lit(1), k))).alias("stem"))
    by_job = starts.join(jobs.select("log", "stem"), "stem").select("log", "name").distinct()
    heads = logs.select("log", F.substring("content", 1, head).alias("head"))
    keys = n.select("name", F.substring("name", 1, gram).alias("key"))
    lengths = F.array(*[F.lit(k) for k in range(1, gram + 1)])
    cuts = F.transform(F.sequence(F.lit(1), F.length("head")), lambda at: F.transform(lengths, lambda k: F.substring("head", at, k)))
    grams = heads.where("head <> ''").select("log", F.explode(F.array_distinct(F.flatten(cuts))).alias("key"))
    met = grams.join(keys, "key").select("log", "name")
    found = met.join(heads, "log").where(F.contains("head", "name")).select("log", "name")
    return by_job.withColumn("how", F.lit("job")).unionByName(found.join(by_job, ["log", "name"], "left_anti").withColumn("how", F.lit("content")))


def source_for_dir(configs: DataFrame, dirs: DataFrame) -> DataFrame:
    """Per output folder the first file of its job whose stem the folder's name begins with; a job of one file needs no match."""
    f = configs.select("job", F.size("files").alias("n"), F.posexplode("files").alias("pos", "file")).withColumn("stem", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""))
    j = dirs.join(f, "job", "left")
    hit = (F.col("n") == 1) | F.col("dir").startswith(F.col("stem"))
    return j.groupBy("job", "dir").agg(F.min(F.when(hit, F.struct("pos", "file"))).alias("s")).select("job", "dir", F.col("s.file").alias("source"))
