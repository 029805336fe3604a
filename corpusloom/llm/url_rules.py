"""URL filters over sorted digest arrays.

A rule is a host and a beginning of a path, with a verdict. It fits its host and all hosts below it, if
the path of the URL starts with the rule's; of several that fit, the longest wins.

Rules are stored in shards, each an array of 64-bit xxhash keys in order, with the full strings behind
them. A shard holds a range of keys, so the array as a whole is sorted. Spark hashes, deals out and sorts
the rules; one task writes one shard. A second array of the same form holds the hosts of the rules with
the path lengths that each host needs.

Tasks map the shards that they need into memory and probe them with binary search, all candidates of a
batch at once: first every domain above a URL's host against the hosts, then, for the hosts that are
there, the beginnings of the path of the lengths that they name. A key that is found counts only if the
stored string equals the candidate; keys that collide lie side by side and all are compared. Judging is
one pass without a shuffle, and a mapped shard costs a task the pages that it touches. Where the shared
folder is not a mounted one, a shard is read as a whole; ``shard_rules`` bounds it.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; without a rule
the verdict is ``Judge.otherwise``: the method is a membership test, and what is in no list is allowed.
A rule named twice with both verdicts blocks. Rules with a null column or without a host never fit.
Of fitting rules of equal length the one with the longer host wins. Null and repeated ids stay, one row
per input row; URLs of any length are judged whole; other columns are kept only where named in ``keep``;
an empty table, of URLs or of rules, gives no row or no rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.files import new_name, open_folder, shared_folder

SEED = 42  # the seed of Spark's own xxhash64


@dataclass(frozen=True)
class Judge:
    """``shard_rules`` is the mean number of entries in a shard; ``bits`` keeps so many high bits of a key."""

    otherwise: str = "allow"
    shard_rules: int = 1_000_000
    bits: int = 64


@dataclass(frozen=True)
class Index:
    """Where the shards are: one file name per key range, or None for an empty range."""

    folder: str
    rules: tuple[str | None, ...]
    hosts: tuple[str | None, ...]
    longest_host: int
    judge: Judge


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The parts of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(F.regexp_substr(rest, F.lit(r"^[^?#]*")), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return lowered(host), F.substring(rest, F.char_length(host) + 1, F.lit(2**31 - 1))


def _shard(key: Column, shards: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * shards, 32)


def _write_shards(entries: DataFrame, folder: str, judge: Judge) -> tuple[str | None, ...]:
    """Write (name, value) entries with unique names; ``value`` is bytes."""
    spark = entries.sparkSession
    shards = entries.count() // judge.shard_rules + 1
    key = F.xxhash64("name")
    if judge.bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - judge.bits), 64 - judge.bits)
    keyed = entries.select(key.alias("key"), "name", "value").withColumn("shard", _shard(F.col("key"), shards))

    def write(group: tuple, rows: pa.Table) -> pa.Table:
        keys = rows["key"].to_numpy().view(np.uint64)
        names = rows["name"].cast(pa.binary()).to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], names[i]))
        parts = [[names[i] for i in order], rows["value"].take(pa.array(order)).to_pylist()]
        system, root = open_folder(folder)
        path = new_name(root, ".keys")
        with system.open_output_stream(path) as out:
            out.write(np.array([len(order)], np.uint64).tobytes())
            out.write(keys[order].tobytes())
            for part in parts:
                out.write(np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.uint64).tobytes())
            for part in parts:
                out.write(b"".join(part))
        return pa.table({"shard": [group[0].as_py()], "file": [path]})

    _make_folder(spark, folder)
    made = keyed.groupBy("shard").applyInArrow(write, "shard long, file string").collect()  # one row per shard
    names: list[str | None] = [None] * shards
    for row in made:
        names[row["shard"]] = row["file"]
    return tuple(names)


def _make_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def build(rules: DataFrame, judge: Judge = Judge()) -> Index:
    """The index of ``rules`` (host, path, verdict)."""
    folder = shared_folder(rules.sparkSession, "url-rules")
    clean = (
        rules.select(lowered(F.col("host")).alias("host"), "path", F.col("verdict"))
        .filter("host <> '' and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block comes after allow
    )
    as_rules = clean.select(F.concat("host", "path").alias("name"), F.col("verdict").cast("binary").alias("value"))
    lengths = clean.groupBy("host").agg(F.array_sort(F.collect_set(F.char_length("path"))).alias("lengths"))
    as_hosts = lengths.select(F.col("host").alias("name"), F.concat_ws(",", F.col("lengths").cast("array<string>")).cast("binary").alias("value"))
    longest = clean.agg(F.max(F.char_length("host"))).first()[0] or 0
    return Index(folder, _write_shards(as_rules, folder, judge), _write_shards(as_hosts, folder, judge), longest, judge)


class Shard:
    """One mapped file: keys in order, then names and values with their offsets."""

    def __init__(self, system: fs.FileSystem, path: str):
        if isinstance(system, fs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with system.open_input_file(path) as file:
                raw = np.frombuffer(file.read(), np.uint8)
        n = int(raw[:8].view(np.uint64)[0])
        self.keys, at = raw[8 : 8 + 8 * n].view(np.uint64), 8 + 8 * n
        self.ends, blobs = [], []
        for _ in range(2):
            self.ends.append(raw[at : at + 8 * n + 8].view(np.uint64))
            at += 8 * n + 8
        for ends in self.ends:
            blobs.append(raw[at : at + int(ends[-1])])
            at += int(ends[-1])
        self.blobs = blobs

    def entry(self, i: int, part: int) -> bytes:
        ends = self.ends[part]
        return self.blobs[part][int(ends[i]) : int(ends[i + 1])].tobytes()

    def find(self, keys: np.ndarray, names: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(place, value) of the candidates whose string is stored."""
        low = np.searchsorted(self.keys, keys, "left")
        high = np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(high > low):
            for at in range(int(low[i]), int(high[i])):
                if self.entry(at, 0) == names[i]:
                    yield int(i), self.entry(at, 1)
                    break


class Probe:
    """The arrays of an index as one task sees them; shards are mapped when first needed."""

    def __init__(self, index: Index):
        self.index = index
        self.system = open_folder(index.folder)[0]
        self.mapped: dict[str, Shard] = {}

    def find(self, files: tuple[str | None, ...], names: list[bytes]) -> dict[int, bytes]:
        if not names:
            return {}
        keys = np.fromiter((xxhash.xxh64_intdigest(n, SEED) for n in names), np.uint64, len(names))
        if self.index.judge.bits < 64:
            drop = np.uint64(64 - self.index.judge.bits)
            keys = keys >> drop << drop
        shard = ((keys >> np.uint64(32)) * np.uint64(len(files)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        found: dict[int, bytes] = {}
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            file = files[shard[part[0]]]
            if file is None:
                continue
            if file not in self.mapped:
                self.mapped[file] = Shard(self.system, file)
            for i, value in self.mapped[file].find(keys[part], [names[j] for j in part]):
                found[int(part[i])] = value
        return found

    def above(self, host: str) -> list[str]:
        """The host and the domains above it that are no longer than the longest host of a rule."""
        out, at = [], max(0, len(host) - self.index.longest_host)
        if at == 0:
            out.append(host)
        dot = host.find(".", max(at - 1, 0))
        while dot >= 0:
            out.append(host[dot + 1 :])
            dot = host.find(".", dot + 1)
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        owners, domains = [], []
        for i, host in enumerate(hosts):
            for domain in self.above(host) if host else []:
                owners.append(i)
                domains.append(domain)
        there = self.find(self.index.hosts, [d.encode() for d in domains])
        tries: list[tuple[int, str, str]] = []
        for place in sorted(there):
            owner, path = owners[place], paths[owners[place]]
            for length in map(int, there[place].split(b",")):
                if length <= len(path):
                    tries.append((owner, domains[place], path[:length]))
        fits = self.find(self.index.rules, [(d + p).encode() for _, d, p in tries])
        best: dict[int, tuple[int, int, str, str]] = {}
        for place, verdict in fits.items():
            owner, domain, path = tries[place]
            fit = (len(domain) + len(path), len(domain), domain + path, verdict.decode())
            best[owner] = max(best.get(owner, fit), fit)
        rules = [best[i][2] if i in best else None for i in range(len(hosts))]
        return rules, [best[i][3] if i in best else self.index.judge.otherwise for i in range(len(hosts))]


def judge(urls: DataFrame, index: Index, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns and (host, path, rule, verdict) of every row."""

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        probe = Probe(index)
        for host, path in batches:
            found = probe.judge(host.to_pylist(), path.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in found], ["rule", "verdict"])

    names = [f"c{i}" for i in range(len(keep))]  # inside, so that no name of the input can clash
    rows = urls.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{url_col}`").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select(*names, host.alias("host"), path.alias("path"))
    rows = rows.select(*names, "host", "path", judged("host", "path").alias("found"))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "host", "path", "found.rule", "found.verdict")
