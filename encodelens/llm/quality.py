"""Quality rules as a short-circuit cascade, ordered by what a sample says of cost and selectivity."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from encodelens.llm.common import named

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """A text and what rules ask of it; each figure is computed once, when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of 8 words that occur twice or more; equal hashes are compared word by word."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)
        with np.errstate(over="ignore"):
            key = h[:n].copy()
            for k in range(1, WINDOW):
                key = key * _MIX + h[k : n + k]
        order = np.sort(key)
        if not (same := order[1:] == order[:-1]).any():
            return 0
        at = np.flatnonzero(np.isin(key, order[1:][same]))
        seen: dict[tuple, int] = {}
        grams = [tuple(self.words[i : i + WINDOW]) for i in at.tolist()]
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        edge = np.zeros(self.n_words + 1, np.int64)
        for i, g in zip(at.tolist(), grams):
            if seen[g] > 1:
                edge[i] += 1
                edge[i + WINDOW] -= 1
        return int((np.cumsum(edge[:-1]) > 0).sum())

    @cached_property
    def n_same_as_previous(self) -> int:
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_letters_upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text if reject(Text) is true."""

    name: str
    reject: Callable[[Text], bool]


#: Texts under 20 words, or of over 30 % repeated words.
BASE = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)

#: The rules of the cascade; documents that all of them pass are kept.
RULES = (
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words),
    Rule("exclamations", lambda t: 5 * t.text.count("!") > t.n_words),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 15 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("stutter", lambda t: 10 * t.n_same_as_previous > 3 * t.n_words),
    Rule("few_letters", lambda t: 2 * t.n_letters < t.word_chars),
    Rule("shouting", lambda t: 2 * t.n_letters_upper > t.n_letters),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text_col: str = "text", rows: int = 64, parts: int = 4) -> tuple[list[tuple[str, float, float]], dict[frozenset[str], int]]:
    """What each rule costs and rejects, on `rows` rows of each of the first partitions that pass the base rules.

    First (rule, seconds a row, share rejected) of each rule alone: its seconds are those that it adds after the base
    rules, whose figures the cascade has by then. Second how many rows are rejected by which rules. Texts stay on the
    executors; no more partitions are read than it takes to have `parts` of them with such rows. A sorted table shows its
    first partitions alone, which can cost time but moves no verdict. No rows: costs of 1 and shares of 0.
    """
    rules, base = tuple(rules), tuple(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, spent, masks = 0, [0.0] * len(rules), {}
        for b in batches:
            for text in b.column(0).to_pylist():
                if n >= rows or any(r.reject(Text(text)) for r in base):
                    continue
                n, mask = n + 1, 0
                for i, r in enumerate(rules):
                    t = Text(text)
                    for x in base:
                        x.reject(t)
                    began = time.perf_counter()
                    mask |= bool(r.reject(t)) << i
                    spent[i] += time.perf_counter() - began
                masks[mask] = masks.get(mask, 0) + 1
            if n >= rows:
                break
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([spent], pa.list_(pa.float64())), pa.array([list(masks)], pa.list_(pa.int64())), pa.array([list(masks.values())], pa.list_(pa.int64()))], ["spent", "masks", "counts"])

    got = docs.select(text_col).mapInArrow(run, "spent array<double>, masks array<long>, counts array<long>").take(parts)
    seen: dict[int, int] = {}
    for x in got:
        for m, c in zip(x["masks"], x["counts"]):
            seen[m] = seen.get(m, 0) + c
    n = sum(seen.values())
    alone = [(r.name, sum(x["spent"][i] for x in got) / n if n else 1.0, sum(c for m, c in seen.items() if m >> i & 1) / n if n else 0.0) for i, r in enumerate(rules)]
    return alone, {frozenset(r.name for i, r in enumerate(rules) if m >> i & 1): c for m, c in seen.items()}


def cascade_order(measured: Sequence[tuple[str, float, float]]) -> list[str]:
    """Rules by rejections per second, the best first; ties by name."""
    return [name for name, _, _ in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[1], m[0]))]


def greedy_order(measured: Sequence[tuple[str, float, float]], together: dict[frozenset[str], int]) -> list[str]:
    """Rules one by one, each time the one that rejects most a second of the rows that those before it leave.

    Rules that reject none of them follow by cascade_order().
    """
    cost, left, out = {name: max(c, 1e-9) for name, c, _ in measured}, dict(together), []
    while len(out) < len(cost):
        gain = {r: sum(n for names, n in left.items() if r in names) / cost[r] for r in cost if r not in out}
        best = min(gain, key=lambda r: (-gain[r], cost[r], r))
        if not gain[best]:
            break
        out.append(best)
        left = {names: n for names, n in left.items() if best not in names}
    return out + [r for r in cascade_order(measured) if r not in out]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text_col: str = "text", order: Sequence[str] | None = None, figures: bool = True) -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed.

    Base rules come first; the others follow in `order` (by default as measured on a sample), and the first that
    rejects ends the row's work, named in `failed`. The order moves cost and `failed`, never `kept`. With
    figures=False only kept and failed are added and no figure is computed that no rule has asked for. A null text
    counts as empty and fails the base; repeated rows are judged alike; other columns pass unchanged, unless
    their names are those added.
    """
    added = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")] if figures else []
    keep = [c for c in docs.columns if c != text_col and c not in {n for n, _ in added} | {"base_failed", "kept", "failed"}]
    return _judged(docs.select(*map(named, [*keep, text_col])), keep, rules, base, text_col, order, added, False)


def accepted(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text_col: str = "text", order: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs that all rules keep, with their columns, of any names.

    A null text counts as empty and fails the base; rows of a null id and repeated rows are judged like others, and an
    empty table stays empty.
    """
    return _judged(docs, docs.columns, rules, base, text_col, order, [], True)


def _judged(docs, keep, rules, base, text_col, order, added, only_kept) -> DataFrame:
    by_name = {r.name: r for r in rules}
    if order is None:
        order = greedy_order(*measure(docs, rules, base, text_col))
    first, then = tuple(base), tuple(by_name[n] for n in order)
    schema = StructType([docs.schema[c] for c in keep])
    if not only_kept:
        for n, kind in [*added, ("base_failed", "boolean"), ("kept", "boolean"), ("failed", "string")]:
            schema = schema.add(n, kind)
    names, at, figures = schema.names, docs.columns.index(text_col), [n for n, _ in added]
    kept_at = [docs.columns.index(c) for c in keep]

    def verdict(t: Text) -> tuple[bool, str | None]:
        for r in first:
            if r.reject(t):
                return True, r.name
        for r in then:
            if r.reject(t):
                return False, r.name
        return False, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, nums = [], []
            for text in b.column(at).to_pylist():
                t = Text(text)
                found.append(verdict(t))
                nums.append([getattr(t, n) for n in figures])
            if only_kept:
                yield pa.RecordBatch.from_arrays(b.filter(pa.array([f is None for _, f in found], pa.bool_())).columns, names)
                continue
            cols = [b.column(i) for i in kept_at]
            cols += [pa.array([x[i] for x in nums], pa.int64()) for i in range(len(figures))]
            cols += [pa.array([x for x, _ in found], pa.bool_()), pa.array([f is None for _, f in found], pa.bool_()), pa.array([f for _, f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    # by number, as mapInArrow takes no names with backticks
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)
