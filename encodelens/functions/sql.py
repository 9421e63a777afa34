"""The small helpers as SQL functions: temporary functions of SQL expressions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and arguments, result, expression.
FUNCTIONS = [
    ("stage_codec(key STRING)", "STRING", "get(filter(split(key, ':'), p -> p in ('h264', 'hevc', 'av1')), 0)"),
    ("phase_key(key STRING)", "STRING", "regexp_replace(key, ':chunk[^:]*$', '')"),
    ("label_height(label STRING)", "INT", "try_cast(regexp_extract(label, '([0-9]+)p', 1) as int)"),
    ("path_basename(path STRING)", "STRING", "element_at(split(path, '/'), -1)"),
    ("path_stem(path STRING)", "STRING", "regexp_replace(element_at(split(path, '/'), -1), '[.][^.]*$', '')"),
    ("backup_base(name STRING)", "STRING", "regexp_replace(name, '_[0-9]{8}(_[0-9]{6})?$', '')"),
    ("is_backup(name STRING)", "BOOLEAN", "name rlike '_[0-9]{8}(_[0-9]{6})?$'"),
    ("object_prefix(key STRING)", "STRING", "concat_ws('/', slice(split(key, '/'), 1, 2))"),
    ("used_pct(busy DOUBLE, perf DOUBLE)", "DOUBLE", "case when perf > 0 then 100 * busy / perf else 0D end"),
    ("stage_rank(status STRING)", "INT", "case status when 'queued' then 1 when 'starting' then 2 when 'running' then 3 when 'reclaimed' then 3 when 'failed' then 4 when 'done' then 5 else 0 end"),
    ("rendered_width(status STRING, percent DOUBLE)", "DOUBLE", "case when status in ('pending', 'queued', 'starting') then 0D when status in ('done', 'skipped', 'reclaimed') then 100D else coalesce(percent, 0D) end"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL and tells their names; registering again replaces them."""
    for head, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in FUNCTIONS]
