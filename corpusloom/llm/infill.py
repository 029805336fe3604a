"""Fill-in-the-middle forms of documents, cut at whole units through Fenwick trees over text blocks.

A unit is a line with its line feed, or what follows the last one. A document is cut after two of its
units, drawn by a seeded digest of its id, into prefix, middle and suffix, and written in one of two
orders between markers.

Where a unit ends is found without walking over the text. The UTF-8 bytes of a document are split into
blocks of fixed size; two Fenwick trees hold the units that end in a block and the code points that
begin in it. For "the end of the k-th unit", a descent by halving steps from the largest power of two
adds whole nodes while they stay below k; it ends at the block that holds the boundary, with the code
points of all blocks before it. Only that block is then read. The trees of all documents of a slice
are built and descended together, level by level, in numpy. Python returns counts of code points; the
forms are put together by built-in expressions, so no text comes back from it.

The work is one pass without a shuffle. Slices are bounded by bytes, so memory follows the slice or the
longest single text, whichever is larger; no text is shortened.

Defined results: a null text is an empty text; an empty text and one with a marker in it stay plain, with
null counts; a null id draws like the empty id; repeated rows give equal results; other columns of the
input are kept only where named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_FEED = 10


@dataclass(frozen=True)
class Infill:
    """``percent`` of the documents change their form, ``spm_percent`` of these put the suffix first."""

    percent: int = 100
    spm_percent: int = 50
    seed: int = 7
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    block_bytes: int = 256
    slice_bytes: int = 8_000_000

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


class Trees:
    """Fenwick trees over the blocks of many texts at once.

    ``data`` holds the bytes of all texts one after another, ``ends`` their ends. Block j of text t is
    node ``base[t] + j`` (j from 0); a node sums the blocks that its lowest set bit spans.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, block_bytes: int):
        self.data, self.block_bytes = data, block_bytes
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.ends = ends.astype(np.int64)
        self.blocks = -(-(self.ends - self.starts) // block_bytes)
        self.base = np.concatenate([[0], np.cumsum(self.blocks)[:-1]]).astype(np.int64)
        owner = np.repeat(np.arange(len(ends)), self.blocks)
        self.place = np.arange(len(owner)) - self.base[owner] + 1  # from 1 inside its text
        first = self.starts[owner] + (self.place - 1) * block_bytes
        self.units = self._sums(data == LINE_FEED, first)
        self.points = self._sums((data & 0xC0) != 0x80, first)
        step, most = 1, self.blocks[owner] if len(owner) else np.zeros(0, np.int64)
        while len(owner) and step < self.blocks.max():
            child = np.flatnonzero((self.place & (2 * step - 1) == step) & (self.place + step <= most))
            self.units[child + step] += self.units[child]
            self.points[child + step] += self.points[child]
            step *= 2

    @staticmethod
    def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Line feeds and code points of every text: the nodes on the way from its last block to 0."""
        feeds, points = np.zeros(len(self.ends), np.int64), np.zeros(len(self.ends), np.int64)
        at = self.blocks.copy()
        while (live := np.flatnonzero(at > 0)).size:
            node = self.base[live] + at[live] - 1
            feeds[live] += self.units[node]
            points[live] += self.points[node]
            at[live] &= at[live] - 1
        return feeds, points

    def points_until(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Code points of ``text[i]`` up to and with its ``k[i]``-th line feed; k from 1, never above the total."""
        left, seen, at = k.astype(np.int64), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        step = 1 << int(self.blocks.max() if len(self.blocks) else 0).bit_length()
        while step:
            there = np.minimum(at + step, self.blocks[text])
            node = self.base[text] + there - 1
            go = (at + step <= self.blocks[text]) & (self.units[node] < left)
            left -= np.where(go, self.units[node], 0)
            seen += np.where(go, self.points[node], 0)
            at += np.where(go, step, 0)
            step //= 2
        first = self.starts[text] + at * self.block_bytes
        inside = np.arange(self.block_bytes)
        spots = np.minimum(first[:, None] + inside, self.ends[text][:, None] - 1)
        bytes_ = self.data[spots]
        valid = first[:, None] + inside < self.ends[text][:, None]
        counted = np.cumsum((bytes_ == LINE_FEED) & valid, axis=1, dtype=np.int32)
        last = (counted < left[:, None]).sum(axis=1)  # the place of the boundary's line feed
        begins = ((bytes_ & 0xC0) != 0x80) & valid & (inside <= last[:, None])
        return seen + begins.sum(axis=1)


def cut_points(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray, block_bytes: int) -> np.ndarray:
    """(units, code points of the prefix, code points of prefix and middle) of every text."""
    trees = Trees(data, ends, block_bytes)
    feeds, points = trees.totals()
    sizes = trees.ends - trees.starts
    open_end = (sizes > 0) & (data[np.maximum(trees.ends - 1, 0)] != LINE_FEED) if len(data) else np.zeros(len(ends), bool)
    units = feeds + open_end
    one, two = h1 % (units + 1), h2 % (units + 1)
    found = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        cut = np.where(k > feeds, points, 0)  # past the last line feed lies the end of the text
        inner = np.flatnonzero((k > 0) & (k <= feeds))
        if inner.size:
            cut[inner] = trees.points_until(inner, k[inner])
        found.append(cut)
    return np.stack([units, *found])


def _slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes, or of one row."""
    low = 0
    while low < len(offsets) - 1:
        high = max(int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1, low + 1)
        yield low, high
        low = high


def _cuts(settings: Infill):
    block_bytes, slice_bytes = settings.block_bytes, settings.slice_bytes

    @F.arrow_udf("struct<units: long, low: long, high: long>")
    def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        text = text.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        one, two = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
        out = [np.zeros((3, 0), np.int64)]
        for low, high in _slices(offsets, slice_bytes):
            begin, end = offsets[low], offsets[high]
            out.append(cut_points(data[begin:end], offsets[low + 1 : high + 1] - begin, one[low:high], two[low:high], block_bytes))
        return pa.StructArray.from_arrays([pa.array(a) for a in np.concatenate(out, axis=1)], ["units", "low", "high"])

    return cuts


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first four groups of eight hex digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, settings: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns and (text, n, form, prefix_chars, middle_chars, output) of every row."""
    names = [f"c{i}" for i in range(len(keep))]  # inside, so that no name of the input can clash
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.array(*draws(F.col(f"`{id_col}`"), settings.seed)).alias("h"),
    )
    rows = rows.select(*names, "text", "h", _cuts(settings)(F.col("text"), F.col("h")[0], F.col("h")[1]).alias("cut"))
    marked = F.lit(False)
    for mark in settings.marks:
        marked = marked | F.col("text").contains(mark)
    plain = (F.col("text") == "") | marked | (F.col("h")[2] % 100 >= settings.percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < settings.spm_percent, "spm").otherwise("psm")
    rows = rows.select(*names, "text", "cut", form.alias("form"))
    low, high, text = F.col("cut.low"), F.col("cut.high"), F.col("text")
    prefix = F.substring(text, F.lit(1), low.cast("int"))
    middle = F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))
    suffix = F.substring(text, (high + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = [F.lit(mark) for mark in settings.marks]
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(text)
    )
    changed = F.col("form") != "plain"
    return rows.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        text,
        F.col("cut.units").alias("n"),
        "form",
        F.when(changed, low).alias("prefix_chars"),
        F.when(changed, high - low).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, settings: Infill = Infill()) -> Column:
    """The text that :func:`transform` was given, from its output and form alone.

    A changed text holds no marker of its own, and no marker can arise where a part meets one, so the
    first place of each marker is the one that was written.
    """
    p, s, m = settings.marks
    end = F.lit(2**31 - 1)

    def after(mark: str) -> Column:
        return F.substring(output, F.instr(output, mark) + len(mark), end)

    def between(first: str, second: str) -> Column:
        begin = F.instr(output, first) + len(first)
        return F.substring(output, begin, F.instr(output, second) - begin)

    return (
        F.when(form == "psm", F.concat(between(p, s), after(m), between(s, m)))
        .when(form == "spm", F.concat(between(p, m), after(m), between(s, p)))
        .otherwise(output)
    )
