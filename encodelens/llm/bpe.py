"""Byte-level BPE over overlapping chunks, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encodelens.llm.common import written


def _ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, once per Python worker."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(path: str) -> np.ndarray:
    """The bytes of each token of a rank file."""
    ranks = _ranks(path)
    out = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, rank in ranks.items():
        out[rank] = len(token)
    return out


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def safe_cuts(text: str, pattern: str, end: int | None = None) -> list[int]:
    """Ends of pre-tokens, as found from the start of text, at which text can be cut for encoding.

    Only ends behind a character other than white space count: what stands before is then matched alike without
    what follows. `end`: matches that reach it are left out, as the text goes on there.
    """
    ends = (m.end() for m in _compiled(pattern).finditer(text))
    return [e for e in ends if (end is None or e < end) and not text[e - 1].isspace()]


def encode(text: str | None, path: str, pattern: str) -> np.ndarray:
    return np.array(encoding(path, pattern).encode_ordinary(text or ""), "<u4")


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """The raw bytes of all ids, concatenated."""
    return encoding(path, pattern).decode_bytes(ids.tolist())


def _encoded(batches: Iterator[pa.RecordBatch], at: int, path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [encode(t, path, pattern).tobytes() for t in b.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:at], *b.columns[at + 1 :], pa.array(ids, pa.binary())], [*[n for i, n in enumerate(b.schema.names) if i != at], "ids"])


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(id, key, k, part, more): each text in overlapping chunks, a few MB of them at a time."""
    for b in batches:
        for i, text in enumerate(b.column(2)):
            text, at = text.as_py(), 0
            while at < len(text):
                some = range(at, min(len(text), at + 128 * chunk), chunk)
                n, at = len(some), some[-1] + chunk
                parts = [text[c : c + chunk + overlap] for c in some]
                more = [c + chunk + overlap < len(text) for c in some]
                cols = [pa.array([x.as_py()] * n, x.type) for x in (b.column(0)[i], b.column(1)[i])]
                cols += [pa.array([c // chunk for c in some], pa.int32()), pa.array(parts, pa.string()), pa.array(more, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "key", "k", "part", "more"])


def _coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks as (ids, heads, tails, base): cuts within both overlaps as a bit for each byte, tails from byte base on."""

    def bits(at: np.ndarray) -> bytes:
        flags = np.zeros(int(at[-1]) + 1 if len(at) else 0, bool)
        flags[at] = True
        return np.packbits(flags, bitorder="little").tobytes()

    for b in batches:
        ids, heads, tails, base = [], [], [], []
        for part, more in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
            ids.append(encode(part, path, pattern).tobytes())
            cuts = np.array([0, *safe_cuts(part, pattern, len(part) if more else None)], np.int64)
            begins = np.append(np.flatnonzero((np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80), len(part.encode()))
            base.append(int(begins[min(chunk, len(part))]))
            heads.append(bits(begins[cuts[cuts < overlap]]))
            tails.append(bits(begins[cuts[cuts >= chunk]] - base[-1]))
        cols = [*b.columns[:4], *(pa.array(x, pa.binary()) for x in (ids, heads, tails)), pa.array(base, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "key", "n", "k", "ids", "heads", "tails", "base"])


def stitch(chunks: list[dict], lengths: np.ndarray) -> bytes | None:
    """The ids of a text from those of its chunks in order: each gives way to the next at the first cut that both have.

    lengths: the bytes of each token, by which a cut's place among the ids is found. None if two neighbours share no cut.
    """
    out, start = [], 0
    for c, after in zip(chunks, [*chunks[1:], None]):
        ids = np.frombuffer(c["ids"], "<u4")
        through = np.cumsum(lengths[ids])

        def place(byte: int, through: np.ndarray = through) -> int:
            """The number of ids before a byte; -1 if no token ends there, as two engines may differ on where pre-tokens do."""
            i = int(np.searchsorted(through, byte))
            return 0 if not byte else i + 1 if i < len(through) and through[i] == byte else -1

        if (first := place(start)) < 0:
            return None
        if after is None:
            out.append(ids[first:])
            break
        t, h = (np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in (c["tails"], after["heads"]))
        n = min(len(t), len(h))
        both = np.flatnonzero(t[:n] & h[:n])
        if not len(both):
            return None
        if (last := place(c["base"] + int(both[0]))) < 0:
            return None
        out.append(ids[first:last])
        start = int(both[0])
    return np.concatenate(out).tobytes() if out else b""


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16384, overlap: int = 1024) -> DataFrame:
    """(id, ids): the token ids of each row's whole text as little-endian unsigned 32-bit integers.

    Texts of over `chunk` characters become chunks that overlap by `overlap` characters; they are dealt out one by one
    and each is pre-tokenised and encoded apart. A chunk may start within a pre-token, but pre-tokenising depends on
    nothing before its start, so from the first cut that two neighbours share in their overlap both have the same
    pre-tokens: there they are stitched, by slices of their ids. Texts are shuffled once, as chunks, and ids once, to
    the chunks of their text. A text with a neighbourhood that shares no cut (a pre-token longer than the overlap) is
    encoded whole. Null counts as empty; an empty text has no ids. Repeated rows of a long text share one encoding and
    all stay; a null id stays. Other columns are ignored.
    """
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be over 0 and under chunk")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(~long).mapInArrow(lambda bs: _encoded(bs, 1, path, pattern), f"id {kind}, ids binary")
    # a long text is known by its id and two hashes
    keyed = rows.where(long).select("id", F.concat(F.hex(F.xxhash64("text")), F.md5("text")).alias("key"), "text")
    chunks = keyed.mapInArrow(lambda bs: _chunks(bs, chunk, overlap), f"id {kind}, key string, k int, part string, more boolean")
    chunks = chunks.groupBy("id", "key", "k").agg(F.first("part").alias("part"), F.first("more").alias("more"), F.count(F.lit(1)).alias("n"))
    coded = chunks.select("id", "key", "n", "k", "part", "more").mapInArrow(lambda bs: _coded(bs, path, pattern, chunk, overlap), f"id {kind}, key string, n long, k int, ids binary, heads binary, tails binary, base int")
    # a row of the result holds one text's ids, as the row that was read held its text
    whole = coded.groupBy("id", "key", "n").agg(F.collect_list(F.struct("k", "ids", "heads", "tails", "base")).alias("chunks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_lengths(path)
        for b in batches:
            for i in range(b.num_rows):
                ids = stitch(sorted(b.column(3)[i].as_py(), key=lambda c: c["k"]), lengths)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns[:3]), pa.array([ids], pa.binary())], ["id", "key", "n", "ids"])

    stitched = written(whole.mapInArrow(join, f"id {kind}, key string, n long, ids binary"), "stitched")
    out = short.unionByName(stitched.where("ids is not null").select("id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("id", "ids"))
    unmet = stitched.where("ids is null").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    if unmet.isEmpty():
        return out
    alone = keyed.join(unmet, keyed["id"].eqNullSafe(F.col("_id")) & (keyed["key"] == F.col("_key")), "left_semi")
    return out.unionByName(alone.select("id", "text").mapInArrow(lambda bs: _encoded(bs, 1, path, pattern), f"id {kind}, ids binary"))


def with_decoded(tokens: DataFrame, path: str, pattern: str, id_col: str = "id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded, decoded_sha256): ids decoded into raw bytes, which need not be UTF-8 piecewise."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [decode(np.frombuffer(x, "<u4"), path, pattern) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [id_col, "ids", "decoded"])

    out = tokens.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, ids binary, decoded binary")
    return out.select(id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded", F.sha2("decoded", 256).alias("decoded_sha256"))
