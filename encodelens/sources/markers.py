"""Telemetry marker lines: `[[ENCODER-KIND key=value ...]]` among log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which marker kinds the next one supersedes and which are gauges; every other kind is a record.
LIVE = ("STAGE",)
GAUGE = ("FLEET",)
#: Kinds with typed fields of their own; register_marker adds to them.
FIELDS: dict[str, T.StructType] = {}


def register_marker(kind: str, fields: T.StructType | str) -> None:
    """Names the typed fields of a kind, as a schema or its text: parse_marker gives them in a struct named after the kind.

    Of a line of that kind each field is cast, null if absent or malformed; lines of other kinds have a null struct. The
    map keeps all fields, unknown ones too. Registering a kind again replaces its fields.
    """
    FIELDS[kind] = fields if isinstance(fields, T.StructType) else T._parse_datatype_string(fields)


def scan_markers(lines: DataFrame, col: str = "value") -> DataFrame:
    """One row per line (parts between LF, CR or CRLF) with is_marker; empty parts go."""
    others = [c for c in lines.columns if c != col]
    out = lines.select(*others, F.posexplode(F.split(col, r"\r\n|\r|\n")).alias("line_no", "line"))
    return out.where(F.col("line") != "").withColumn("is_marker", F.col("line").startswith("[[ENCODER-"))


def unpack_batches(messages: DataFrame, body: str = "body") -> DataFrame:
    """One row per packed marker with its place in the message, so (publisher, seq, place) orders all."""
    others = [c for c in messages.columns if c != body]
    return messages.select(*others, F.posexplode(F.split(body, "\n")).alias("place", "raw")).where(F.col("raw") != "")


def pairs(body: str = "body"):
    """The key=value tokens of a body as a map; tokens without `=` go, the last of a repeated key stays."""
    tokens = F.filter(F.split(body, " +"), lambda t: F.instr(t, "=") > 1)
    entries = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substr(t, F.instr(t, "=") + 1).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def parse_marker(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with kind, body, kv, the payloads of PLAN (stages) and ARGV (argv), and a struct for each registered kind; null for lines that are no marker."""
    m = r"^\[\[ENCODER-(\w+) ?(.*?)\]\]\s*$"
    kind = F.nullif(F.regexp_extract(raw, m, 1), F.lit(""))
    df = df.withColumn("kind", kind).withColumn("body", F.when(kind.isNotNull(), F.regexp_extract(raw, m, 2)))
    df = df.withColumn("kv", F.when(~F.col("kind").isin("PLAN"), pairs()))
    df = df.withColumn("plan", F.when(F.col("kind") == "PLAN", F.from_json("body", "array<struct<key string, label string>>")))
    coded = F.try_element_at("kv", F.lit("b64"))
    for name, fields in FIELDS.items():
        df = df.withColumn(name.lower(), F.when(F.col("kind") == name, F.struct(*[field(f.name, f.dataType.simpleString()).alias(f.name) for f in fields])))
    return df.withColumn("argv", F.when(F.col("kind") == "ARGV", F.from_json(F.expr("try_to_binary(kv['b64'], 'base64')").cast("string"), "array<string>")).otherwise(F.when(coded.isNull(), None)))


def field(name: str, kind: str = "string"):
    """A typed field of the map; null if absent or malformed."""
    return F.try_element_at("kv", F.lit(name)).try_cast(kind)


def classify_marker(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Parsed markers with marker_class (live, gauge, record; unknown kinds are records) and is_heartbeat.

    A heartbeat tells how far a running stage is, neither at its start nor at its end, or is a gauge.
    """
    k = F.col(kind)
    of = F.when(k.isin(*LIVE), "live").when(k.isin(*GAUGE), "gauge").when(k.isNotNull(), "record")
    underway = (field("status") == "running") & ~field("percent").isin("0.0", "100.0")
    beat = (k.isin(*LIVE) & underway) | k.isin(*GAUGE)
    return df.withColumn("marker_class", of).withColumn("is_heartbeat", F.coalesce(beat, F.lit(False)))


def job_timing(lines: DataFrame, stream: str = "stream", order: str = "line_no", line: str = "line") -> DataFrame:
    """(stream, measures): the `*_s` tokens of the last timing line of each stream."""
    t = lines.where(F.col(line).contains("phase=")).withColumn("body", F.col(line)).withColumn("kv", pairs())
    seconds = F.map_filter("kv", lambda k, v: k.endswith("_s") & v.try_cast("double").isNotNull())
    return t.groupBy(stream).agg(F.max_by(seconds, order).alias("measures"))
