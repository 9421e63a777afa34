"""The input tables of the operators, derived from the driver's tables; one text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from encodelens.operators.blocks import ROWS_A_BLOCK

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()

#: Words in capitals are the functions in which the two dialects differ.
DIALECT = {
    "spark": {
        "EPOCH": lambda x: f"unix_timestamp({x})",
        "MICROS": lambda x: f"unix_micros(cast({x} as timestamp))",
        "PROP": lambda x: f"cast(get_json_object({x}, '$.k') as bigint)",
        "DOUBLE": lambda x: f"cast({x} as double)",
    },
    "duckdb": {
        "EPOCH": lambda x: f"cast(floor(epoch({x})) as bigint)",
        "MICROS": lambda x: f"epoch_us({x})",
        "PROP": lambda x: f"cast(json_extract({x}, '$.k') as bigint)",
        "DOUBLE": lambda x: f"cast({x} as double)",
    },
}

_CODEC = "case l_returnflag when 'A' then 'h264' when 'N' then 'hevc' else 'av1' end"
_HEIGHT = "case l_linenumber when 1 then 234 when 2 then 360 when 3 then 432 when 4 then 540 when 5 then 720 when 6 then 1080 else 2160 end"

VIEWS = {
    # one row per stage attempt; times in epoch seconds
    "stages": f"""
        select l_orderkey as job, concat('in/clip', l_partkey % 3, '.mp4') as file, l_partkey % 3 as file_index,
               EPOCH(o_orderdate) as submitted,
               case when l_tax = 0.08 then null else EPOCH(l_shipdate) end as started,
               case when l_tax = 0.08 or (l_linestatus = 'O' and l_discount = 0) then null
                    else EPOCH(l_shipdate) + cast(l_quantity as bigint) * 86400 end as ended,
               case when l_linenumber = 7 then concat('package:', l_partkey % 2)
                    else concat('encode:', {_CODEC}, ':', {_HEIGHT}, 'p:chunk', l_partkey % 8) end as key,
               case when l_tax = 0.08 then 'pending' when l_linestatus = 'O' and l_discount = 0 then 'running'
                    when l_discount = 0.1 then 'failed' else 'done' end as status,
               {_HEIGHT} as height, l_suppkey as instance, l_extendedprice as cpu_s,
               l_extendedprice * (1 - l_discount) as worker_s, l_partkey % 4096 as peak_mib, l_quantity as percent,
               ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + cast(l_quantity as bigint) as seq
        from lineitem join orders on l_orderkey = o_orderkey""",
    "samples": """
        select event_id as seq, user_id as machine, user_id % 4 as fleet, EPOCH(ts) as ts, value as busy, DOUBLE(50) as perf,
               case when PROP(props) % 7 = 0 then null else concat('v', PROP(props) % 3) end as version,
               PROP(props) as k
        from events""",
    "transitions": """
        select event_id as seq, concat('encode:', user_id) as key, user_id as publisher,
               case event_type when 'signup' then 'queued' when 'view' then 'starting' when 'click' then 'running'
                    when 'purchase' then 'done' else 'failed' end as status,
               case when PROP(props) % 5 = 0 then null else value end as percent,
               case when PROP(props) % 2 = 0 then 'worker' else 'batch' end as src,
               EPOCH(ts) as sent, EPOCH(ts) + PROP(props) as arrival
        from events""",
    "run_samples": """
        select o_orderkey as run, o_custkey % 10 as account, EPOCH(o_orderdate) as started_at,
               EPOCH(o_orderdate) + (o_custkey % 20) * 86400 as ended_at, o_totalprice / 10000 as machine,
               o_totalprice / 12500 as allocated, o_orderkey % 48 as fleet_vcpu,
               DOUBLE((o_orderkey % 48) * (60 + o_orderkey % 300)) / 3600 as edge, DOUBLE(o_orderkey % 600) as lost_s,
               DOUBLE(600 + o_orderkey % 6000) as total_s, o_totalprice / 1000000 as saved_usd
        from orders""",
    "rungs": """
        select p_brand as ladder,
               case when p_type in ('ECONOMY', 'SMALL') then 'h264' when p_type in ('STANDARD', 'MEDIUM') then 'hevc' else 'av1' end as codec,
               p_partkey as pos,
               case p_size % 8 when 0 then 416 when 1 then 640 when 2 then 768 when 3 then 960 when 4 then 1280 when 5 then 1920 when 6 then 2560 else 3840 end as width,
               case p_size % 8 when 0 then 234 when 1 then 360 when 2 then 432 when 3 then 540 when 4 then 720 when 5 then 1080 when 6 then 1440 else 2160 end as height,
               cast(floor(p_retailprice * 10) as int) - 8800 + p_size * 100 as kbps
        from part""",
    "requests": """
        select s_suppkey as request, concat('Brand#', s_suppkey % 25 + 1) as ladder, 60 + abs(s_acctbal) / 10 as duration,
               case s_nationkey % 4 when 0 then 24 when 1 then 30 when 2 then 50 else 60 end as fps,
               s_nationkey % 2 = 0 as two_pass, case s_nationkey % 3 when 0 then 1920 when 1 then 3840 else 1280 end as src_width,
               s_suppkey % 3 as plan, DOUBLE(20 + s_nationkey * 8) as src_mbps, s_nationkey % 5 <> 0 as has_audio, s_suppkey % 2 = 0 as local
        from supplier""",
    "curves": f"""
        select concat('clip', l_suppkey % 5) as clip, {_CODEC} as codec, case when l_linestatus = 'O' then 2160 else 1080 end as reference,
               {_HEIGHT} as height, cast(l_quantity * 100 as int) as kbps,
               round(avg(l_extendedprice) / 1053.7 * (0.4 + l_quantity / 91.3), 8) as vmaf
        from lineitem group by l_suppkey % 5, l_returnflag, l_linestatus, l_linenumber, l_quantity""",
    "vmaf_parts": f"""
        select l_orderkey as job, {_CODEC} as codec, concat({_HEIGHT}, 'p') as label, l_partkey as chunk, l_extendedprice / 1053.7 as mean,
               l_extendedprice / 1103.3 as harmonic, l_extendedprice / 2000 as low, cast(l_quantity as bigint) as frames,
               case when l_discount = 0 then DOUBLE(0) else l_quantity / (l_extendedprice / 1103.3) end as inv_sum
        from lineitem""",
    "frames": """
        select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value * 0.99731357e0 as score
        from events""",
    "objects": """
        select concat('jobs/', page_id % 50, '/p', page_id, case when page_id % 9 = 0 then '/_FAILED' else '.html' end) as key,
               cast(length(html) as bigint) as bytes, 1700000000 + page_id * 370 as modified
        from pages
        union all
        select concat('mezz/', doc_id % 20, '/d', doc_id), cast(n_chars as bigint), 1700000000 + doc_id * 110 from documents""",
    "outputs": """
        select doc_id as output, concat('clip', doc_id % 40, '_', lang, case when doc_id % 3 = 0 then '_20240105' when doc_id % 7 = 0 then '_20240210_101500' else '' end) as name,
               concat('jobs/', doc_id % 50, case when doc_id % 2 = 0 then concat('/p', doc_id) else '' end) as s3_prefix,
               case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then 'unknown' when doc_id % 5 = 2 then '2024-03-01T00:00:00Z' else '2099-01-01T00:00:00Z' end as expires_at,
               doc_id % 11 = 0 as gone, cast(n_chars as bigint) as bytes, 1700000000 + doc_id * 5000 as mtime, doc_id % 4 = 1 as sidecar, source
        from documents""",
    "fleet": """
        select s_suppkey as instance, concat('c7g.', case s_nationkey % 5 when 0 then 'medium' when 1 then 'large' when 2 then 'xlarge' when 3 then '2xlarge' else '4xlarge' end) as type,
               case s_nationkey % 5 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 else 16 end as vcpu, n_regionkey as region,
               case when s_acctbal < 0 then 'terminated' when s_acctbal < 1000 then 'pending' else 'running' end as state,
               case when s_suppkey % 3 = 0 then null else round(s_acctbal / 10000, 4) end as spot_price,
               1700000000 + s_suppkey * 60 as launch, case when s_acctbal < 0 then 1700000000 + s_suppkey * 60 + 90000 else null end as ended
        from supplier join nation on s_nationkey = n_nationkey""",
    "batch_jobs": f"""
        select l_orderkey as exec, (l_orderkey * 10 + l_linenumber) * 100000000 + (l_partkey % 100000) * 1000 + l_suppkey % 1000 as job_id, {_CODEC} as codec, {_HEIGHT} as height, l_suppkey as instance,
               1700000000 + (l_partkey % 500) * 100 as start_s,
               case when l_linestatus = 'O' and l_discount = 0 then null else 1700000000 + (l_partkey % 500) * 100 + cast(l_quantity as bigint) * 60 end as stop_s,
               case when l_linenumber > 5 then 4 else 2 end as vcpu, l_extendedprice as cpu_s, l_extendedprice / (1 + l_quantity / 10) as encode_s,
               case when l_linestatus = 'O' and l_discount = 0 then 'RUNNING' when l_tax = 0.08 then 'RUNNABLE' when l_discount = 0.1 then 'FAILED' else 'SUCCEEDED' end as status
        from lineitem""",
    "markers": """
        select event_id as seq, user_id as publisher, EPOCH(ts) as sent, EPOCH(ts) + PROP(props) as arrival,
               case event_type
                 when 'signup' then concat('[[ENCODER-STAGE key=encode:', user_id, ' status=running percent=', PROP(props), ']]')
                 when 'view' then concat('[[ENCODER-TIMING phase=encode key=k', user_id, ' startup_s=', PROP(props), ' encode_s=', PROP(props) * 2, ' note=x]]')
                 when 'click' then concat('[[ENCODER-FLEET machine=m', user_id, ' busy=', PROP(props), ' perf=50]]')
                 when 'purchase' then concat('[[ENCODER-COST exec=e', user_id % 20, ' spot_usd=', PROP(props), ' egress_usd=1 junk]]')
                 else concat('plain line ', event_id) end as raw
        from events""",
}


def body(name: str, dialect: str) -> str:
    """A view's SELECT in a dialect."""
    text = VIEWS[name]
    for word, f in DIALECT[dialect].items():
        text = re.sub(rf"\b{word}\(((?:[^()]|\([^()]*(?:\([^()]*\)[^()]*)*\))*)\)", lambda m, f=f: f(m[1]), text)
    return text


def with_views(sql: str) -> str:
    """DuckDB SQL that may name the views: those it names come first as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    rest = sql.strip()
    heads, first = [f"{n} as ({body(n, 'duckdb')})" for n in used], "with "
    for start in ("with recursive ", "with "):
        if rest.startswith(start):
            heads, rest, first = [*heads, rest[len(start) :]], "", start
    return (first if heads else "") + ",\n".join(heads) + "\n" + rest


#: Keys by which a view's large tables are dealt, in parts of bounded rows, before the view joins or orders them; what is
#: then grouped by the key stays where it is.
DEALT = {"stages": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "frames": {"events": "user_id"}}


#: Rows up to which adaptive execution deals a view's tables as it sees fit.
MOST_UNDEALT = 4 * ROWS_A_BLOCK


class Views:
    """Tables and views of a data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        text = body(name, "spark")
        named = {t: getattr(self, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)}
        named |= self._dealt(named, DEALT.get(name, {}))
        for t in named:
            text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **named)

    def _dealt(self, named: dict[str, DataFrame], by: dict[str, str]) -> dict[str, DataFrame]:
        """Tables dealt alike by their keys, if the largest has more rows than a few tasks should hold."""
        rows = max((named[t].count() for t in by), default=0)
        if rows <= MOST_UNDEALT:
            return {}
        return {t: named[t].repartition(-(-rows // ROWS_A_BLOCK), key) for t, key in by.items()}
