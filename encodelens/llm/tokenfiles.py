"""Token ids in binary segments with Elias-Fano document boundaries.

A segment is one byte string: the header (magic, version, bytes an id, documents, ids, documents without a doc_id, the
least doc_id), the Elias-Fano codes of the document ends and of the doc_ids above the least, and the concatenated ids.
Segments are rows of a Parquet table, so that Spark's own writers commit them, and any store that Spark reads can hold
them. Each segment covers a run of documents in ascending id order. No table of 64-bit offsets or ids is kept.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.llm.common import broadcast_if_small

MAGIC = b"EFID"
HEADER = struct.Struct("<4sHHQQQq")
#: A sample of every so many ends points into the upper bits.
SAMPLE = 64
#: Values coded or decoded at once; a multiple of 8.
BLOCK = 1 << 14


class EliasFano:
    """A non-decreasing run of unsigned integers in about 2 + log2(greatest / count) bits each.

    The low bits of each value stand in a packed array; the high bits are the gaps between ones in `upper`. select
    starts at a sampled one and counts on from there.
    """

    def __init__(self, n: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.lower, self.upper, self.samples = n, low_bits, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = [np.packbits(((v[i : i + BLOCK, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, BLOCK)]
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, np.concatenate(low) if low else np.zeros(0, np.uint8), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.lower), len(self.upper), len(self.samples))
        return head + self.lower.tobytes() + self.upper.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The code that starts at a byte, and where it ends."""
        n, low_bits, nl, nu, ns = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        lower = np.frombuffer(raw, np.uint8, nl, at)
        upper = np.frombuffer(raw, np.uint8, nu, at + nl)
        samples = np.frombuffer(raw, "<u4", ns, at + nl + nu)
        return cls(n, low_bits, lower, upper, samples), at + nl + nu + 4 * ns

    def _low(self, i: int, j: int) -> np.ndarray:
        at = np.arange(i, j)[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.lower[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int, j: int | None = None) -> np.ndarray:
        """Values i to j - 1 (j: i + 1 by default), found from the nearest sample before the first on."""
        j = i + 1 if j is None else j
        if not 0 <= i < j <= self.n:
            raise IndexError((i, j))
        at, skip = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, found, have = at >> 3, [], 0
        while have < skip + j - i:
            bits = np.unpackbits(self.upper[byte : byte + 512], bitorder="little")
            bits[: max(0, at - 8 * byte)] = 0
            found.append(np.flatnonzero(bits) + 8 * byte)
            have += len(found[-1])
            byte += 512
        high = np.concatenate(found)[skip : skip + j - i] - np.arange(i, j)
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(i, j)

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, values from the i-th on) in blocks, so that no whole table of values stands in memory."""
        for i in range(0, self.n, BLOCK):
            yield i, self.select(i, min(self.n, i + BLOCK))


def pack(docs: list[np.ndarray], doc_ids: list[int | None], id_bytes: int) -> bytes:
    """A segment of documents' ids; doc_ids ascend, those that are null come first."""
    ends = np.cumsum([len(d) for d in docs], dtype=np.int64) if docs else np.zeros(0, np.int64)
    ids = np.concatenate(docs) if docs else np.zeros(0)
    named = np.array([i for i in doc_ids if i is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    above = named.view(np.uint64) - np.array(least, np.int64).view(np.uint64)  # the difference may need all 64 bits
    head = HEADER.pack(MAGIC, 2, id_bytes, len(docs), len(ids), len(docs) - len(named), least)
    return head + EliasFano.of(ends).to_bytes() + EliasFano.of(above).to_bytes() + ids.astype(f"<u{id_bytes}").tobytes()


class Segment:
    """A packed segment: documents by their place in it, ids as a view of its bytes."""

    def __init__(self, raw: bytes):
        magic, version, id_bytes, self.n_docs, n_ids, self.n_null, least = HEADER.unpack_from(raw)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.from_bytes(raw, HEADER.size)
        self.above, at = EliasFano.from_bytes(raw, at)
        self.least, self.ids = np.array(least, np.int64), np.frombuffer(raw, f"<u{id_bytes}", n_ids, at)

    def offsets(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 start, and where the last of them ends."""
        before = self.ends.select(i - 1)[0] if i else 0
        return np.concatenate(([before], self.ends.select(i, j))).astype(np.int64)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        a, b = max(0, i - self.n_null), max(0, j - self.n_null)
        named = (self.above.select(a, b) + self.least.view(np.uint64)).view(np.int64).tolist() if b > a else []
        return [None] * (j - i - len(named)) + named

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, by two selects."""
        start, end = self.offsets(i, i + 1)
        return self.ids[start:end]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokens:
    return Tokens(path)


_UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")
#: White space other than the four characters at which texts are cut, and characters that some tables call so.
_RARE = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")
#: Latin letters, and behind them punctuation, which then is a pre-token of its own; an apostrophe may start a contraction.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = rf"^[{_LETTERS}]+[!-&(-/:-@\[-`{{-~]*$"


def _place(key: str) -> bool:
    """Whether a piece ends, and begins but for one line break, with something other than white space."""
    return bool(key) and not key[-1].isspace() and (not key[0].isspace() or key[0] == "\n" and not key[1].isspace())


class Tokens:
    """A byte-level tokenizer of the tokenizers library that encodes each distinct word of a worker's texts once.

    The tokenizer begins a pre-token wherever white space follows another character, and what stands before does not
    change what follows. So texts are cut there, and the ids of the pieces are those of the text. A piece is a word
    behind one space (known by the word) or anything else (known as it is, with its white space); a word of letters
    with punctuation behind is put together from both. Texts with an added token's name or with rare white space
    beside a cut are encoded whole. Known pieces are kept in two generations of about `room`: when the new one is
    full, the old one goes, so that frequent words stay.
    """

    def __init__(self, path: str, room: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.names = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.id_bytes = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.id_bytes}"
        self.room, self.young, self.old = room, {}, {}
        vocab = self.library.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token)  # a character of the byte-level alphabet stands for a byte

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, words: list[str], between: str) -> list[bytes]:
        """The ids of pieces that follow each other in one text, each few hundred; ids are cut where a piece's bytes end."""
        if not words:
            return []
        raw = b"".join(self._whole([between + between.join(words[i : i + 512]) for i in range(0, len(words), 512)]))
        through = np.cumsum(self.length[np.frombuffer(raw, self.kind)])
        upto = np.cumsum(pc.binary_length(pa.array(words)).to_numpy().astype(np.int64) + len(between))
        ends = np.concatenate(([0], np.searchsorted(through, upto) + 1)) * self.id_bytes
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).to_pylist()

    def _learn(self, keys: list[str]) -> list[bytes]:
        """The ids of pieces not known: words behind a space, words behind a line break, and others, each kind in a row."""
        spaced = [n for n, k in enumerate(keys) if not k[0].isspace()]
        lined = [n for n, k in enumerate(keys) if k[0] == "\n" and k[1:] and not k[1].isspace()] if len(spaced) < len(keys) else []
        out: list = [None] * len(keys)
        for at, between in ((spaced, " "), (lined, "")):
            for n, v in zip(at, self._row([keys[n] for n in at], between)):
                out[n] = v
        other = [n for n, v in enumerate(out) if v is None]
        for n, v in zip(other, self._whole([keys[n] for n in other])):
            out[n] = v
        return out

    def _ids(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, keys))
        rest = [n for n, v in enumerate(out) if v is None]
        asked = [keys[n] for n in rest]
        got = list(map(self.old.get, asked))
        new = [k for k, v in zip(asked, got) if v is None]
        learnt = self._learn(new)
        fresh = iter(learnt)
        for n, v in zip(rest, got):
            out[n] = next(fresh) if v is None else v
        self.young.update((k, v) for k, v in zip(asked, got) if v is not None)
        self.young.update((k, v) for k, v in zip(new, learnt) if len(k) <= 64)
        return out

    def _pieces(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of distinct words behind spaces or line breaks, and which of them are no pieces."""
        plain = pc.match_substring_regex(keys, _PLAIN)
        words = keys.filter(plain)
        stems = pc.utf8_rtrim(words, "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha() and c != 39)).dictionary_encode()
        marks = pc.replace_substring_regex(words, f"^[{_LETTERS}]+", "").dictionary_encode()
        of_stem = pa.array(self._ids(stems.dictionary.to_pylist()), pa.large_binary())
        of_mark = pa.array(self._whole(marks.dictionary.to_pylist()), pa.large_binary())
        put = pc.binary_join_element_wise(of_stem.take(stems.indices), of_mark.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        plain = plain.to_numpy(zero_copy_only=False)
        other = keys.filter(pa.array(~plain)).to_pylist()
        good = np.array([*map(_place, other)], bool)
        odd = np.zeros(len(keys), bool)
        odd[np.flatnonzero(~plain)[~good]] = True
        rest = np.full(len(other), b"", object)
        rest[good] = self._ids([k for k, g in zip(other, good) if g])
        order = np.empty(len(keys), np.int64)
        order[np.flatnonzero(plain)], order[np.flatnonzero(~plain)] = np.arange(len(put)), np.arange(len(other)) + len(put)
        return pa.concat_arrays([put, pa.array(rest.tolist(), pa.large_binary())]).take(pa.array(order)), odd

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as little-endian integers of id_bytes; none for a null one."""
        texts, nothing = pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar(b"", pa.large_binary())
        # a line break starts a piece of its own, marked by the break that it keeps; with a space before, that is odd
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        heads, rest = pc.list_element(words, 0).to_pylist(), pc.list_slice(words, 1)
        pieces = rest.flatten().dictionary_encode()
        ids, odd = self._pieces(pieces.dictionary)
        hard = np.array([h[-1:].isspace() or h[:1].isspace() for h in heads], bool)
        if odd.any():
            hard[pc.list_parent_indices(rest).to_numpy()[odd[pieces.indices.to_numpy(zero_copy_only=False)]]] = True
        for name in self.names:
            hard |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        lists = pa.LargeListArray.from_arrays(rest.offsets.cast(pa.int64()), ids.take(pieces.indices))
        first = pa.array(self._whole(["" if h else x for x, h in zip(heads, hard.tolist())]), pa.large_binary())
        out = pc.binary_join_element_wise(first, pc.binary_join(lists, nothing), nothing)
        if not hard.any():
            return out
        some = self._hard(texts.filter(pa.array(hard)).to_pylist())
        return pc.replace_with_mask(out, pa.array(hard), pa.array(some, pa.large_binary()))

    def _hard(self, texts: list[str]) -> list[bytes]:
        """Texts with runs of white space by the pieces before each run, or whole."""
        cut = []
        for t in texts:
            units = None if any(n in t for n in self.names) or _RARE.search(t) else _UNIT.findall(t)
            cut.append(units and [units[0], *(u[1:] if u[0] == " " and u[1:] and not u[1].isspace() else u for u in units[1:])])
        keys = list({u for units in cut if units for u in units[1:]})
        known = dict(zip(keys, self._ids(keys)))
        first = iter(self._whole([units[0] if units else t for t, units in zip(texts, cut)]))
        return [next(first) + b"".join(map(known.__getitem__, units[1:] if units else ())) for units in cut]


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 20, partitions: int | None = None) -> None:
    """Writes the ids of each row's whole text and an end id, in ascending id order, as segments of about segment_ids ids.

    Rows are dealt by ranges of id and of the text's hash, so files and segments follow the order, an id with very
    many rows is spread, and each task packs its segments as it goes. Null texts have the end id alone; rows of equal
    id are ordered by hash and text; null ids come first. A segment holds at least one document, however long: as for
    any value of Spark, its bytes must stay under 2 GiB. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    schema = "part int, seq int, first_id long, n_docs long, n_ids long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, ids, count = TaskContext.get().partitionId(), 0, [], [], 0
        t = tokenizer(tokenizer_path)

        def segment() -> pa.RecordBatch:
            raw = pack(held, ids, t.id_bytes)
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([count], pa.int64()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "seq", "first_id", "n_docs", "n_ids", "payload"])

        end = np.array([end_id], t.kind).tobytes()
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), t.encode(b.column(1)).to_pylist()):
                held.append(np.frombuffer(raw + end, t.kind))
                ids.append(i)
                count += len(held[-1])
                if count >= segment_ids:
                    yield segment()
                    seq, held, ids, count = seq + 1, [], [], 0
        if held:
            yield segment()

    dealt.mapInArrow(run, schema).write.parquet(out)


def read_tokens(spark: SparkSession, path: str, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, start, ids): each document of a token table, start being the number of ids of all documents before it.

    The segments' own counts, one small row each, give where each begins: summed per part, then along each part. The
    Elias-Fano ends give the documents, a block of them at a time.
    """
    segments = spark.read.parquet(path)
    counts = segments.select("part", "seq", "n_ids")
    # one row a part, that is a task of the writer
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = counts.withColumn("within", within).join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    starts, _ = broadcast_if_small(starts, 16, broadcast_bytes)
    placed = segments.join(starts, ["part", "seq"]).select("base", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, raw in zip(b.column(0).to_pylist(), b.column(1)):
                s = Segment(raw.as_buffer())
                for i in range(0, s.n_docs, BLOCK):
                    j = min(s.n_docs, i + BLOCK)
                    at = s.offsets(i, j)
                    wide = s.ids[at[0] : at[-1]].astype("<u4")
                    ends = pa.array((at - at[0]) * 4, pa.int64())
                    got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, ends.buffers()[1], pa.py_buffer(wide)])
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(i, j), pa.int64()), pa.array(at[:-1] + base), got.cast(pa.binary())], ["id", "start", "ids"])

    return placed.mapInArrow(run, "id long, start long, ids binary")


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF
