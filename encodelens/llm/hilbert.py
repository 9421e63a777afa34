"""Sharding along a Hilbert curve over quantised metadata, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.llm.common import columns, utf8, written

BITS, DIMS = 4, 4
LEVELS, CELLS = 1 << BITS, 1 << BITS * DIMS
#: Bytes of a string, after what all strings share, by which it is placed between the least and the greatest.
PREFIX = 6


def size_level(size: Column) -> Column:
    """The binary logarithm of a size from 8 on, in 16 levels; sizes of 2 ** 18 and more share the last."""
    return F.least(F.greatest(F.length(F.bin(size)) - 4, F.lit(0)), F.lit(LEVELS - 1))


def _shared(a: str | None, b: str | None) -> int:
    """Bytes that two strings begin with alike."""
    x, y = (a or "").encode(), (b or "").encode()
    return next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def _number(value: str | None, skip: int) -> int:
    return int.from_bytes((value or "").encode()[skip : skip + PREFIX].ljust(PREFIX, b"\0"), "big")


def string_level(c: str, least: str | None, most: str | None) -> Column:
    """Where a string lies between the least and the greatest of its column, in 16 levels of equal width; null: 0."""
    skip = _shared(least, most)
    lo, hi = _number(least, skip), _number(most, skip)
    part = F.substring(utf8(F.coalesce(c, F.lit(""))), skip + 1, PREFIX)
    n = F.conv(F.rpad(F.hex(part), 2 * PREFIX, "0"), 16, 10).cast("long")
    level = F.floor((n - lo) * LEVELS / F.lit(hi - lo + 1)) if hi > lo else F.lit(0)
    return F.when(F.col(c).isNull(), 0).otherwise(F.least(F.greatest(level, F.lit(0)), F.lit(LEVELS - 1))).cast("int")


def number_level(c: str, least: int | None, most: int | None) -> Column:
    """Where a number lies between the least and the greatest of its column, in 16 levels; null: 0."""
    lo, hi = least or 0, most or 0
    return F.coalesce(F.floor((F.col(c).cast("double") - float(lo)) * LEVELS / (float(hi) - float(lo) + 1)), F.lit(0)).cast("int")


def with_hilbert(df: DataFrame, levels: list[str], out: str = "curve", bits: int = BITS) -> DataFrame:
    """df with the position on the Hilbert curve of the cell that its level columns (0 to 2 ** bits - 1) name.

    From the highest bit down: where a bit of an axis is set, the lower bits of the first axis are inverted, else
    they are exchanged with those of that axis. A Gray code runs over the axes, and their bits are interleaved.
    Each part is a fold over an array, so that expressions stay short.
    """
    n = len(levels)
    bit = lambda x, b: F.getbit(x.cast("long"), b).cast("int")
    down = range(bits - 1, 0, -1)

    def turn(x: Column, step: Column) -> Column:
        first, here, low = F.element_at(x, 1), F.element_at(x, step["axis"] + 1), step["low"]
        one = bit(here, step["bit"]) == 1
        at_first = F.when(one, low).otherwise(first.bitwiseXOR(here).bitwiseAND(low))
        at_here = F.when(one | (step["axis"] == 0), F.lit(0)).otherwise(first.bitwiseXOR(here).bitwiseAND(low))
        return F.transform(x, lambda v, k: v.bitwiseXOR(F.when(k == 0, at_first).when(k == step["axis"], at_here).otherwise(F.lit(0))))

    steps = [F.struct(F.lit(b).alias("bit"), F.lit((1 << b) - 1).alias("low"), F.lit(i).alias("axis")) for b in down for i in range(n)]
    df = df.withColumn("_axes", F.aggregate(F.array(*steps), F.array(*[F.col(c).cast("int") for c in levels]), turn))
    gray = F.aggregate("_axes", F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))))
    df = df.withColumn("_gray", gray)
    parts = [F.when(bit(F.element_at("_gray", n), F.lit(b)) == 1, F.lit((1 << b) - 1)).otherwise(F.lit(0)) for b in down]
    turned = F.lit(0)
    for x in parts:
        turned = turned.bitwiseXOR(x)
    df = df.withColumn("_turned", turned)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index * 2 + bit(F.element_at("_gray", i + 1).bitwiseXOR(F.col("_turned")), F.lit(b))
    return df.withColumn(out, index).drop("_axes", "_gray", "_turned")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", string_cols: tuple[str, str] = ("source", "lang"), parts: int | None = None) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot, rows_in_all) of each row: runs of equal row counts along a Hilbert curve.

    Four metadata dimensions (size, two strings, id) are quantised to 16 levels each. Rows are ordered by their cell's
    place on the curve, then by a part (a hash of id and text), then by id; the run of each shard is cut by rank, so
    shard counts differ by one at most, and a shard holds few levels of each dimension, which is what min/max pruning
    needs. The rank of a row is the number of rows in earlier cells and parts, from counts of at most 65,536 cells by
    `parts`, plus its place within its own part: a cell that holds a third of all rows is spread over `parts` groups, 256
    or so many that all rows in one cell would make 65,536 a group. The texts are read once and never shuffled.
    Strings are placed by six bytes behind what all of them share. Null texts have size 8 and the CRC of nothing;
    null strings and ids take level 0; repeated rows take neighbouring slots; fewer rows than shards leave shards empty.
    """
    a, b = string_cols
    text = utf8(F.coalesce(text_col, F.lit("")))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col(a).alias("a"), F.col(b).alias("b"))
    slim = written(slim, "shard-rows")
    r = slim.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("a", "b", "id") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    levels = {"l0": size_level(F.col("size")), "l1": string_level("a", r["lo_a"], r["hi_a"]), "l2": string_level("b", r["lo_b"], r["hi_b"]), "l3": number_level("id", r["lo_id"], r["hi_id"])}
    parts = parts or 256 << max(0, (r["n"] >> 24).bit_length())
    spread = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("text_crc32").cast("string"))), 1, 7), 16, 10).cast("long")
    rows = slim.select("id", "size", "text_crc32", F.pmod(spread, F.lit(parts)).cast("int").alias("part"), *[c.cast("int").alias(n) for n, c in levels.items()])
    cell = F.lit(0)
    for n in levels:
        cell = cell * LEVELS + F.col(n)
    rows = rows.withColumn("cell", cell.cast("int"))
    counts = written(rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    cells = with_hilbert(cells.select("cell", "n", *[F.pmod(F.floor(F.col("cell") / LEVELS ** (DIMS - 1 - i)), F.lit(LEVELS)).alias(f"l{i}") for i in range(DIMS)]), [f"l{i}" for i in range(DIMS)])
    # at most one row per cell: 65,536
    along = W.orderBy("curve")
    cells = cells.select("cell", "curve", (F.sum("n").over(along) - F.col("n")).alias("cell_start"), F.sum("n").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("rows_in_all"))
    starts = counts.withColumn("part_start", F.sum("n").over(W.partitionBy("cell").orderBy("part")) - F.col("n")).join(F.broadcast(cells), "cell")
    starts = starts.select("cell", "part", "curve", (F.col("cell_start") + F.col("part_start")).alias("start"), "rows_in_all")
    place = F.row_number().over(W.partitionBy("cell", "part").orderBy("id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("place", place).join(starts, ["cell", "part"]).withColumn("rank", F.col("start") + F.col("place"))
    number = F.expr(f"(rank * {shards}) div rows_in_all").cast("int")
    first = F.expr(f"(shard * rows_in_all + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", number).withColumn("slot", F.col("rank") - first).select(F.col("id").alias(id_col), "size", "text_crc32", "curve", "shard", "slot", "rows_in_all")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs as Parquet folders shard=N under path, each in slot order; a part of a shard's slots per file.

    placed: what shard() says of docs. A row is met by its id, size and CRC, and repeated ones by their number, so that
    each row is written once. docs must have no columns shard or slot.
    """
    text = utf8(F.coalesce(text_col, F.lit("")))
    key = ["_id", "_size", "_crc"]
    d = docs.withColumns({"_id": F.col(id_col), "_size": (F.octet_length(text) + 8).cast("long"), "_crc": F.crc32(text)})
    d = d.withColumn("_no", F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64(*columns(docs)))))
    at = placed.select(F.col(id_col).alias("_i"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), "shard", "slot")
    at = at.withColumn("_n", F.row_number().over(W.partitionBy("_i", "_s", "_c").orderBy("shard", "slot")))
    on = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_size") == F.col("_s")) & (F.col("_crc") == F.col("_c")) & (F.col("_no") == F.col("_n"))
    out = d.join(at, on).select(*columns(docs), "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
