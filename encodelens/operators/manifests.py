"""Playlists, manifests and the tables behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_playlist(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) to playlist rows: segment durations with their URI, and variants with bandwidths and size."""
    by = W.partitionBy("path").orderBy("line_no")
    n = lines.withColumn("uri", F.lead("line").over(by))
    seg, var = F.col("line").startswith("#EXTINF:"), F.col("line").startswith("#EXT-X-STREAM-INF:")
    number = lambda name: F.regexp_extract("line", rf"(?:^|[^-A-Z]){name}=(\d+)", 1).try_cast("long")
    return n.where(seg | var).select(
        "path", "line_no", F.when(seg, "segment").otherwise("variant").alias("kind"), F.when(seg, F.regexp_extract("line", r"^#EXTINF:([0-9.]+)", 1).try_cast("double")).alias("duration"),
        number("BANDWIDTH").alias("bandwidth"), number("AVERAGE-BANDWIDTH").alias("average_bandwidth"),
        F.regexp_extract("line", r"RESOLUTION=(\d+)x\d+", 1).try_cast("int").alias("width"), F.regexp_extract("line", r"RESOLUTION=\d+x(\d+)", 1).try_cast("int").alias("height"), "uri",
    )


def strip_leading_junk(df: DataFrame, col: str = "value") -> DataFrame:
    """Documents without what stands before <?xml or <MPD; without either they stay as they are."""
    at = F.least(F.nullif(F.instr(col, "<?xml"), F.lit(0)), F.nullif(F.instr(col, "<MPD"), F.lit(0)))
    return df.withColumn(col, F.when(at > 1, F.substr(F.col(col), at)).otherwise(F.col(col)))


MPD = (
    "Period struct<AdaptationSet: array<struct<_contentType: string, _mimeType: string, _width: int, _height: int, _frameRate: string, "
    "Representation: array<struct<_id: string, _bandwidth: bigint, _width: int, _height: int, _codecs: string, _frameRate: string, "
    "SegmentList: struct<_timescale: bigint, SegmentTimeline: struct<S: array<struct<_t: bigint, _d: bigint, _r: int>>>, SegmentURL: array<struct<_media: string, _mediaRange: string>>>>>>>>"
)


def parse_mpd(docs: DataFrame, col: str = "value") -> DataFrame:
    """(path, representation attributes, durations, media) of each representation; sizes come from its set if it has none.

    A timeline entry of duration d and r repeats stands for r + 1 segments.
    """
    m = strip_leading_junk(docs, col).select("path", F.from_xml(col, MPD).alias("m"))
    s = m.select("path", F.explode("m.Period.AdaptationSet").alias("a")).select("path", "a", F.explode("a.Representation").alias("r"))
    d = F.flatten(F.transform("r.SegmentList.SegmentTimeline.S", lambda x: F.array_repeat(x["_d"], F.coalesce(x["_r"], F.lit(0)) + 1)))
    return s.select(
        "path", F.col("r._id").alias("id"), F.col("r._bandwidth").alias("bandwidth"), F.coalesce("r._width", "a._width").alias("width"), F.coalesce("r._height", "a._height").alias("height"),
        F.coalesce("r._frameRate", "a._frameRate").alias("frame_rate"), F.col("r._codecs").alias("codecs"), F.coalesce("r.SegmentList._timescale", F.lit(1)).alias("timescale"), d.alias("durations"),
        F.transform("r.SegmentList.SegmentURL", lambda u: F.struct(u["_media"].alias("media"), u["_mediaRange"].alias("range"))).alias("urls"),
    )


def observed_format(files: DataFrame) -> DataFrame:
    """Per output: fmp4, ts or both by its segment files, else by what its playlists say, else null."""
    a = files.groupBy("output").agg(F.max(F.col("name").endswith(".m4s")).alias("m"), F.max(F.col("name").endswith(".ts")).alias("t"), F.max(F.coalesce("says_map", F.lit(False))).alias("pm"), F.max(F.coalesce("says_ts", F.lit(False))).alias("pt"))
    by = lambda m, t: F.when(F.col(m) & F.col(t), "both").when(F.col(m), "fmp4").when(F.col(t), "ts")
    return a.select("output", F.coalesce(by("m", "t"), by("pm", "pt")).alias("format"))


def delivered_kbps(segments: DataFrame) -> DataFrame:
    """Per output and rung: seconds, bytes with each file once, kbps; null where the media is elsewhere."""
    by_file = segments.groupBy("output", "rung", "file").agg(F.max("bytes").alias("bytes"), F.sum("duration").alias("duration"), F.max("remote").alias("remote"))
    a = by_file.groupBy("output", "rung").agg(F.sum("duration").alias("seconds"), F.sum("bytes").alias("bytes"), F.max("remote").alias("remote"))
    return a.select("output", "rung", F.round("seconds", 4).alias("seconds"), F.when(~F.col("remote"), F.col("bytes")).alias("bytes"), F.round(F.when(~F.col("remote"), F.col("bytes") * 8 / F.nullif(F.col("seconds"), F.lit(0.0)) / 1000), 4).alias("kbps"))


def declared_rates(variants: DataFrame, audio: DataFrame) -> DataFrame:
    """Per output and rung the peak and average kbps of the picture alone: what the master playlist says of the pair, less its audio.

    variants: (output, rung, bandwidth, average_bandwidth) in bits a second, audio: (output, bits); an output without audio
    loses nothing, and no rate falls under 0.
    """
    v = variants.join(audio.groupBy("output").agg(F.max("bits").alias("_audio")), "output", "left")
    less = lambda c: F.floor(F.greatest(F.col(c) - F.coalesce("_audio", F.lit(0)), F.lit(0)) / 1000).cast("long")
    return v.select("output", "rung", less("bandwidth").alias("peak_kbps"), less("average_bandwidth").alias("average_kbps"))


def fragment_timeline(segments: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row per fragment of each segment: start, duration (equal parts, the remainder to the first), byte range."""
    n = fragments.groupBy("track", "segment").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("track", "segment").orderBy("offset")
    f = fragments.withColumn("i", F.row_number().over(by) - 1).join(n, ["track", "segment"]).join(segments, ["track", "segment"])
    d = F.expr("duration div n") + F.when(F.col("i") == 0, F.col("duration") % F.col("n")).otherwise(0)
    f = f.withColumn("d", d)
    t = F.sum("d").over(W.partitionBy("track").orderBy("segment", "i")) - F.col("d")
    return f.select("track", "segment", "i", t.alias("t"), "d", F.concat_ws("-", F.col("offset"), F.col("offset") + F.col("length") - 1).alias("range"))


def timeline_runs(rows: DataFrame) -> DataFrame:
    """Runs of equal durations along a track: first time, duration, repeats after the first."""
    by = W.partitionBy("track").orderBy("t")
    r = rows.withColumn("_new", (~F.col("d").eqNullSafe(F.lag("d").over(by))).cast("int"))
    r = r.withColumn("_run", F.sum("_new").over(by))
    return r.groupBy("track", "_run").agg(F.min("t").alias("t"), F.min("d").alias("d"), (F.count(F.lit(1)) - 1).alias("r")).drop("_run")


def segment_regroup(urls: DataFrame) -> DataFrame:
    """Fragments back to segments by media: the sum of their durations (4 s if it is 0), in the order first seen."""
    g = urls.groupBy("track", "media").agg(F.sum("d").alias("d"), F.min("pos").alias("pos"))
    return g.select("track", "media", F.when(F.col("d") == 0, 4.0).otherwise(F.col("d").cast("double")).alias("duration"), F.row_number().over(W.partitionBy("track").orderBy("pos")).alias("place"))


def variant_index(renditions: DataFrame, audio: DataFrame) -> DataFrame:
    """Master playlist rows: bandwidths with the audio's, codecs joined, resolution and target duration, and the line itself."""
    j = renditions.join(audio.select("output", F.col("peak").alias("a_peak"), F.col("average").alias("a_avg"), F.col("codecs").alias("a_codecs")), "output", "left")
    peak = F.ceil(F.col("peak") + F.coalesce("a_peak", F.lit(0.0))).cast("long")
    avg = F.ceil(F.col("average") + F.coalesce("a_avg", F.lit(0.0))).cast("long")
    codecs = F.concat_ws(",", "codecs", "a_codecs")
    line = F.format_string('#EXT-X-STREAM-INF:BANDWIDTH=%d,AVERAGE-BANDWIDTH=%d,CODECS="%s",RESOLUTION=%dx%d', peak, avg, codecs, F.col("width"), F.col("height"))
    return j.select("output", "rung", peak.alias("bandwidth"), avg.alias("average_bandwidth"), codecs.alias("codecs"), F.ceil("longest").cast("long").alias("target_duration"), line.alias("line"))


def output_ladder(actual: DataFrame, profile: DataFrame, standard: DataFrame, declared: DataFrame) -> DataFrame:
    """Per rung of an output its target (its own profile's, else the standard tier's of its height), what it declares and has, and their ratio."""
    p = profile.select("output", "rung", F.col("kbps").alias("own"), "vmaf", "profile")
    j = actual.join(p, ["output", "rung"], "left").join(declared, ["output", "rung"], "left").join(standard.select("height", F.col("kbps").alias("tier")), "height", "left")
    target = F.coalesce("own", "tier")
    return j.select("output", "rung", "height", target.alias("target_kbps"), F.round("kbps", 4).alias("actual_kbps"), F.round(F.col("kbps") / target, 4).alias("share"), "peak_kbps", "average_kbps", F.col("bytes").alias("size"), "vmaf", "profile")


def settings_diff(commands: DataFrame) -> DataFrame:
    """Per rung and distinct normalised settings the sources that use them; divergent if the rung has several."""
    s = commands.groupBy("rung", "settings").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("divergent", F.count(F.lit(1)).over(W.partitionBy("rung")) > 1)


#: Fixed value: how an output's name tells its codec and height.
RUNG_NAME = r"\b(h264|hevc|av1)[_/-](\d{3,4})(?!\d)"


def rung_of(argv: Column) -> Column:
    """codec_height of the last argument that names one, else `unknown`."""
    named = F.try_element_at(F.filter(argv, lambda a: a.rlike(RUNG_NAME)), F.lit(-1))
    return F.coalesce(F.concat(F.regexp_extract(named, RUNG_NAME, 1), F.lit("_"), F.regexp_extract(named, RUNG_NAME, 2)), F.lit("unknown"))


def chunk_span(argv: Column) -> Column:
    """(start, frames) of a command that encodes a part of its clip, `-` for what it does not say; null for a whole encode."""
    value = lambda flag: F.coalesce(F.get(argv, F.array_position(argv, F.lit(flag)).cast("int")), F.lit("-"))
    said = lambda flag: F.when(F.array_contains(argv, flag), value(flag)).otherwise("-")
    return F.when(F.array_contains(argv, "-ss"), F.struct(said("-ss").alias("start"), said("-frames:v").alias("frames")))


def chunk_plans(commands: DataFrame) -> DataFrame:
    """Per rung whether local and cloud paths cut the clip in the same places: identical, DIFFER, or one path only.

    commands: (path, argv). dist counts as local, as both run here. Plans are compared as sets of (start, frames) by
    counting who has each, so no plan is gathered. Commands that cannot be read (a null argv) take no part.
    """
    path = F.when(F.col("path") == "dist", "local").otherwise(F.col("path"))
    c = commands.select(rung_of(F.col("argv")).alias("rung"), path.alias("path"), chunk_span(F.col("argv")).alias("span")).where("span is not null")
    s = c.groupBy("rung", "span").agg(F.max(F.col("path") == "local").alias("l"), F.max(F.col("path") == "cloud").alias("c"))
    out = s.groupBy("rung").agg(F.count_if("l").alias("local"), F.count_if("c").alias("cloud"), F.count_if(F.col("l") & F.col("c")).alias("shared"), F.count(F.lit(1)).alias("_n"))
    verdict = F.when((F.col("local") == 0) | (F.col("cloud") == 0), "one path only").when(F.col("shared") == F.col("_n"), "identical").otherwise("DIFFER")
    return out.withColumn("verdict", verdict).drop("_n")
