"""Column expressions: names, prices, multipliers, planning arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = ("h264", "hevc", "av1")

# Fixed prices in dollars: egress a decimal GB, requests a thousand, storage a GB-month of 730 hours, state
# transitions a thousand, queue requests a million, and requests that a staged GB was found to make.
PRICES = {"egress_gb": 0.09, "tier1_k": 0.005, "tier2_k": 0.0004, "storage_gb_month": 0.023, "transitions_k": 0.025, "queue_std_m": 0.40, "queue_fifo_m": 0.50, "puts_gb": 1897.0}

# Fixed values of the seed speeds: codec at 1080p30 medium, presets relative to medium, machines relative to the base.
SEED = {"h264": 1.5, "hevc": 0.14, "av1": 0.1}
PRESET = {"ultrafast": 8.0, "superfast": 5.0, "veryfast": 3.0, "faster": 1.8, "fast": 1.3, "medium": 1.0, "slow": 0.5, "slower": 0.3, "veryslow": 0.18}
MACHINE = {"mac": 0.8, "macmini": 0.8, "graviton": 0.7}

# Fixed reservations of an encode by height band (over lo, up to hi): codec, lo, hi, virtual CPUs, MiB; '' is any other codec.
RESERVATIONS = [
    ("h264", 0, 594, 4, 2048),
    ("h264", 594, 1080, 3, 2048),
    ("h264", 1080, 99999, 2, 3072),
    ("hevc", 0, 1080, 2, 3072),
    ("hevc", 1080, 99999, 2, 6144),
    ("av1", 0, 540, 2, 3072),
    ("av1", 540, 99999, 8, 6144),
    ("", 0, 540, 2, 3072),
    ("", 540, 1080, 4, 3072),
    ("", 1080, 99999, 4, 6144),
]

# Fixed options of the encoder whose value is a path or differs for each chunk, and virtual CPUs by instance size.
VALUED = ("-i", "-passlogfile", "-ss", "-frames:v", "-t")
SIZES = {"medium": 1, "large": 2, "xlarge": 4, "2xlarge": 8, "4xlarge": 16, "8xlarge": 32, "12xlarge": 48, "16xlarge": 64, "24xlarge": 96, "48xlarge": 192, "metal": 64}


def lookup(table: dict, key: Column) -> Column:
    """The value of a small fixed table; null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def rounded(x: Column, digits: int) -> Column:
    """x rounded half away from zero where its product with 10 ** digits, a double, is cut; F.round cuts x's shortest decimals,
    which may end in a 5 that the product does not reach."""
    return F.round(x * 10.0**digits) / 10.0**digits


def ordered_sum(x: Column) -> Column:
    """The sum of a group's values from the least on, so that rows in any order give the same; null without values."""
    return F.when(F.count(x) > 0, F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), lambda s, y: s + y))


def stage_codec(key: str | Column) -> Column:
    """The first known codec among a key's colon-separated parts; null: shared."""
    parts = F.filter(F.split(key, ":"), lambda p: p.isin(*CODECS))
    return F.try_element_at(parts, F.lit(1))


def phase_key(key: str | Column) -> Column:
    return F.regexp_replace(key, r":chunk[^:]*$", "")


def label_height(label: str | Column) -> Column:
    return F.regexp_extract(label, r"(\d+)p", 1).try_cast("int")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: str | Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def backup_base(name: str | Column) -> Column:
    """A name without the date of a dated backup."""
    return F.regexp_replace(name, r"_\d{8}(_\d{6})?$", "")


def is_backup(name: str | Column) -> Column:
    return F.col(name).rlike(r"_\d{8}(_\d{6})?$") if isinstance(name, str) else name.rlike(r"_\d{8}(_\d{6})?$")


def trim_name(name: str | Column, most: int = 80, tail: int = 20) -> Column:
    """A long name cut in the middle, so that its end, which tells runs apart, stays."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - tail), F.right(c, F.lit(tail))))


def egress_usd(nbytes: Column) -> Column:
    return F.greatest(nbytes, F.lit(0)) / 1e9 * PRICES["egress_gb"]


def request_usd(tier1: Column, tier2: Column) -> Column:
    return tier1 / 1000 * PRICES["tier1_k"] + tier2 / 1000 * PRICES["tier2_k"]


def storage_usd(gb: Column, hours: Column) -> Column:
    return gb * hours / 730 * PRICES["storage_gb_month"]


def transitions_usd(n: Column) -> Column:
    return n / 1000 * PRICES["transitions_k"]


def queue_usd(n: Column, fifo: Column) -> Column:
    return n / 1e6 * F.when(fifo, PRICES["queue_fifo_m"]).otherwise(PRICES["queue_std_m"])


def put_estimate_usd(gb: Column) -> Column:
    return gb * PRICES["puts_gb"] / 1000 * PRICES["tier1_k"]


def speed_key(machine: Column, codec: Column, height: Column, two_pass: Column, preset: Column, fps: Column) -> Column:
    """The six-part key of a learned speed; a blank machine is `local`, a blank preset `medium`."""
    blank = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return F.concat_ws(":", blank(machine, "local"), codec, height.cast("string"), F.when(two_pass, "2").otherwise("1"), blank(preset, "medium"), fps.cast("string"))


def seed_speed(codec: Column, height: Column, two_pass: Column, preset: Column, fps: Column, machine: Column) -> Column:
    """The speed to assume before any is learned, in content seconds a second.

    A codec that is not known counts as hevc, a height of 0 or less as 1080, and a frame rate of 0 or less as 30.
    """
    base = F.coalesce(lookup(SEED, codec), F.lit(SEED["hevc"]))
    height, fps = F.when(height > 0, height).otherwise(1080), F.when(fps > 0, fps).otherwise(30)
    s = base * 1080 * 1080 / (height * height) * F.coalesce(lookup(PRESET, preset), F.lit(1.0)) * 30 / fps
    s = s * F.when(two_pass, 0.5).otherwise(1.0) * F.coalesce(lookup(MACHINE, machine), F.lit(1.0))
    return F.greatest(s, F.lit(0.001))


def seed_weighted(x: Column, codec: Column, height: Column) -> Column:
    """x over the seed speed of one pass at the medium preset and 30 frames a second.

    Divided once, as what makes it up is whole but for the codec's share: a quotient by the speed itself is rounded three times.
    """
    whole = {c: round(s * 1080 * 1080, 3) for c, s in SEED.items()}
    base = F.coalesce(lookup(whole, codec), F.lit(whole["hevc"]))
    height = F.when(height > 0, height).otherwise(1080).cast("double")
    return F.when(height * height > 1000 * base, x * 1000.0).otherwise(x * height * height / base)


def _reserved(codec: Column, height: Column, table: Sequence[tuple], at: int) -> Column:
    known = sorted({r[0] for r in table} - {""})
    name = F.when(codec.isin(*known), codec).otherwise(F.lit(""))
    rows = [F.when((name == r[0]) & (height <= r[2]), F.lit(r[at])) for r in sorted(table, key=lambda r: (r[0], r[2]))]
    return F.coalesce(*rows)


def vcpu_for(codec: Column, height: Column, table: Sequence[tuple] = RESERVATIONS) -> Column:
    """Virtual CPUs that an encode reserves, by the table's bands."""
    return _reserved(codec, height, table, 3)


def memory_for(codec: Column, height: Column, table: Sequence[tuple] = RESERVATIONS) -> Column:
    """MiB of memory that an encode reserves, by the table's bands."""
    return _reserved(codec, height, table, 4)


def fps_mult(fps: Column) -> Column:
    """One for each 30 frames a second begun; an unknown rate counts as 30."""
    return F.when(fps > 0, F.ceil(fps / 30)).otherwise(F.lit(1))


def bitrate_mult(mbps: Column) -> Column:
    return F.when(mbps > 50, 1 + 0.25 * F.ceil((mbps - 50) / 50)).otherwise(1.0)


def keyint(fps: Column, gop: Column) -> Column:
    """Frames between key frames, rounded half to even."""
    return F.greatest(F.bround(fps * gop), F.lit(1.0)).cast("int")


def snap(seconds: Column, segment: Column) -> Column:
    """A time limit in whole segments, one at least."""
    return F.greatest(F.round(seconds / segment), F.lit(1.0)) * segment


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a bounded fold; whole numbers of up to about 2 ** 40."""
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % F.greatest(s["y"], F.lit(1))).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")), step)["x"]


def lcm(a: Column, b: Column) -> Column:
    return (a * b / gcd(a, b)).cast("long")


def padding(ms: Column, boundary_ms: Column, threshold_ms: int = 500) -> Column:
    """Milliseconds to the next boundary; 0 for an empty stream and for one that passes a boundary by the threshold or less."""
    over = ms % boundary_ms
    return F.when((ms <= 0) | (over <= threshold_ms), F.lit(0)).otherwise(boundary_ms - over).cast("long")


def frame_rate(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator of `30000/1001` or `25`."""
    return F.split_part(text, F.lit("/"), F.lit(1)).try_cast("long"), F.when(text.contains("/"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("long")).otherwise(F.lit(1).cast("long"))


def normalize_argv(argv: Column) -> Column:
    """A command's arguments as one string that tells its settings apart, and nothing else.

    Values of path and per-chunk options, absolute paths and URLs read <PATH>; progress options are left out. An
    option that is itself such a value takes none: what is taken alternates along a row of these options.
    """
    # as the one element of an array, the words and their marks are found once a row and not once a word
    return F.get(F.transform(F.array(argv), lambda words: F.get(F.transform(F.array(F.transform(words, lambda a: a.isin(*VALUED))), lambda valued: _normalized(words, valued)), F.lit(0))), F.lit(0))


def _normalized(argv: Column, valued: Column) -> Column:
    """normalize_argv of words, of which `valued` tells which are options that take a value."""

    def taken(i: Column) -> Column:
        # how many such options stand in a row right before
        row = F.aggregate(F.slice(valued, 1, i), F.lit(0), lambda n, v: F.when(v, n + 1).otherwise(0))
        return F.when(F.coalesce(F.get(valued, F.greatest(i - 1, F.lit(0))), F.lit(False)) & (i > 0), row % 2 == 1).otherwise(False)

    def place(a: Column) -> Column:
        return a.startswith("/") | a.startswith("s3://") | a.startswith("http://") | a.startswith("https://") | a.startswith("file:")

    def reports(i: Column) -> Column:
        # an option of progress reports or its value, by its neighbours; a command's first word is none
        me, before, next_ = (F.coalesce(F.when(j >= 0, F.get(argv, j)), F.lit("")) for j in (i, i - 1, i + 1))
        last = i == F.size(argv) - 1
        of_pipe = ((me == "-progress") & (next_ == "pipe:1") & (i > 0)) | ((me == "pipe:1") & (before == "-progress") & (i > 1))
        return of_pipe | ((me == "-stats_period") & ~last & (i > 0)) | ((before == "-stats_period") & (i > 1))

    shown = F.transform(argv, lambda a, i: F.struct(F.when(taken(i) | place(a), "<PATH>").otherwise(a).alias("a"), reports(i).alias("out")))
    return F.array_join(F.transform(F.filter(shown, lambda x: ~x["out"]), lambda x: x["a"]), " ")


#: A word of a command line as a shell reads it: plain characters, escaped ones, and single or double quotes, without a gap.
_PIECE = r"""[^\s'"\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+\""""
_WORD, _PART = f"(?s)(?:{_PIECE})++", rf"""(?s)(?:[^'"\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+")"""


def split_command(line: str | Column) -> Column:
    """The words of a command line as a shell splits it; null with an unclosed quote or a last backslash.

    Single quotes keep all they hold; in double quotes a backslash escapes a double quote or a backslash alone; outside, it
    escapes any character.
    """
    c = F.col(line) if isinstance(line, str) else line

    def plain(part: Column) -> Column:
        inner = F.substr(part, F.lit(2), F.length(part) - 2)
        double = F.regexp_replace(inner, r"""\\(["\\])""", "$1")
        return F.when(part.startswith("'"), inner).when(part.startswith('"'), double).when(part.startswith("\\"), F.substr(part, F.lit(2), F.length(part) - 1)).otherwise(part)

    words = F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))
    read = F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(_PART), F.lit(0)), plain), ""))
    return F.when(F.trim(F.regexp_replace(F.regexp_replace(c, _WORD, ""), r"\s+", "")) == "", read)


def normalize_command(line: str | Column) -> Column:
    """normalize_argv of a command line."""
    return normalize_argv(split_command(line))


def instance_vcpus(kind: Column) -> Column:
    """Virtual CPUs by the size in an instance type's name, whatever its family; 0 if not known."""
    return F.coalesce(lookup(SIZES, F.regexp_extract(kind, r"^[^.]*\.(.*)$", 1)), F.lit(0))


def compare_dims(width: Column, height: Column, cap: int = 2160) -> tuple[Column, Column]:
    """The even width and height at which two streams are compared: the source's, but no taller than cap."""
    even = lambda c: (c - F.pmod(c, F.lit(2))).cast("int")
    scaled = F.bround(width * cap / height).cast("int")
    return even(F.when(height <= cap, width).otherwise(scaled)), even(F.least(height, F.lit(cap)))


def quality_model(height: Column) -> Column:
    """The VMAF model by the capped height: that for 4K from 1440 on."""
    return F.when(height >= 1440, "vmaf_4k_v0.6.1").otherwise("vmaf_v0.6.1")
