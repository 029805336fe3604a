"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its text, its *blob*. The ledger holds one row
per (blob, rule, version) that was ever scanned, with the gaps and lengths of the matches. A scan

1. addresses the rows at hand and keeps one text per blob,
2. drops the pairs of blob and rule version that the ledger has,
3. scans the rest with built-in expressions and appends the result to the ledger,
4. joins findings back to every row that carries the blob.

Only step 1 moves texts, once. Findings move as numbers. A blob that a third of all rows share is
reduced to one row per task before it moves, and its rows in step 4 hold an id and a digest only.

Defined results: a null text is an empty text; an empty text has no findings; null and repeated ids
stay as they are, one result row per input row; other columns of the input are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fan_out


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``value_after`` cuts what precedes the measured value from a match."""

    kind: str
    pattern: str
    least: int
    value_after: str = ""
    version: int = 1


# Kinds, patterns and least lengths.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        r"""^[^:=]*[:=]\x20*["']?""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# The least run is in the pattern, so that short runs never become matches; longer runs stay whole.
SCAN = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}
LEDGER = "blob binary, rule string, version int, hits array<struct<gap:int,len:int,ok:boolean>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _matches(text: Column, rule: Rule) -> Column:
    return F.regexp_extract_all(text, F.lit(SCAN.get(rule.kind, rule.pattern)), F.lit(0))


def _long_enough(hit: Column, rule: Rule) -> Column:
    value = F.regexp_replace(hit, rule.value_after, "") if rule.value_after else hit
    return F.char_length(value) >= rule.least


def _hits(text: Column, rule: Rule) -> Column:
    """Matches in order: code points since the last match's end, length, and whether it is long enough."""
    pieces = F.zip_with(
        F.split(text, SCAN.get(rule.kind, rule.pattern), -1),
        _matches(text, rule),
        lambda gap, hit: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(hit).alias("len"), _long_enough(hit, rule).alias("ok")
        ),
    )
    return F.filter(pieces, lambda p: p["len"].isNotNull())  # what follows the last match


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version in ``versions`` (blob, text) that ``ledger`` lacks."""
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    due: dict[str, Column] = {r.kind: F.lit(True) for r in rules}
    if ledger is not None:
        wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        seen = (
            ledger.select("blob", F.struct("rule", "version").alias("pair"))
            .filter(F.array_contains(wanted, F.col("pair")))
            .groupBy("blob")
            .agg(F.collect_set("pair").alias("seen"))
        )
        blobs = blobs.join(seen, "blob", "left").filter(
            F.col("seen").isNull() | (F.size(F.array_except(wanted, "seen")) > 0)
        )
        due = {
            r.kind: ~F.coalesce(
                F.array_contains("seen", F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))),
                F.lit(False),
            )
            for r in rules
        }
    scanned = blobs.select(
        "blob",
        F.array(
            *[
                F.when(
                    due[r.kind],
                    F.struct(
                        F.lit(r.kind).alias("rule"),
                        F.lit(r.version).alias("version"),
                        _hits(F.col("text"), r).alias("hits"),
                    ),
                )
                for r in rules
            ]
        ).alias("all"),
    )
    return (
        fan_out(scanned, ["blob"], "all", "one")
        .filter(F.col("one").isNotNull())
        .select("blob", "one.rule", "one.version", "one.hits")
    )


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, end) of every finding of the current rule versions, in code points, end exclusive."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    along = Window.partitionBy("blob", "rule").orderBy("at")
    return (
        ledger.filter(current & (F.size("hits") > 0))
        .select("blob", "rule", F.posexplode("hits").alias("at", "hit"))
        .withColumn("end", F.sum(F.col("hit.gap") + F.col("hit.len")).over(along))
        .filter("hit.ok")
        .select("blob", "rule", (F.col("end") - F.col("hit.len")).alias("start"), "end")
    )


def address(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the blob and the text of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, text.alias("text")).select(*keep, blob_of(F.col("text")).alias("blob"), "text")


def open_ledger(spark, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None before the first scan."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def scan(
    docs: DataFrame,
    ledger_path: str,
    rules: tuple[Rule, ...] = RULES,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return ``keep`` and each row's findings.

    The result has ``found``: an array of (start, kind, rule, end) by start, then by the place of
    the rule in ``rules``; null for rows without findings.
    """
    versions = address(docs, text_col, keep)
    per_blob = _findings_by_blob(versions, ledger_path, rules)
    return versions.drop("text").join(per_blob, "blob", "left").drop("blob")


def blobs_with_findings(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return (blob, found) of the blobs with findings."""
    return _findings_by_blob(address(docs, text_col, ()), ledger_path, rules)


def _findings_by_blob(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...]) -> DataFrame:
    spark = versions.sparkSession
    fresh = scan_unseen(versions.select("blob", "text"), open_ledger(spark, ledger_path), rules)
    fresh.write.mode("append").parquet(ledger_path)
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule"))
    return (
        findings(open_ledger(spark, ledger_path), rules)
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("start", place.alias("kind"), "rule", "end"))).alias("found"))
    )


def spans_text(found: Column) -> Column:
    """kind:start:end of every finding, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(
            F.coalesce(found, F.array()),
            lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["end"].cast("string")),
        ),
    )


def count_of(found: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(found, lambda f: f["rule"] == kind)), F.lit(0)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the findings of ``rules`` in ``text_col`` replaced, rule after rule; null stays null."""
    for rule in rules:
        docs = docs.withColumn(text_col, _masked(F.col(text_col), mask, rule))
    return docs


def _masked(text: Column, mask: str, rule: Rule) -> Column:
    pieces = F.zip_with(
        F.split(text, SCAN.get(rule.kind, rule.pattern), -1),
        _matches(text, rule),
        lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").when(_long_enough(hit, rule), mask).otherwise(hit)),
    )
    return F.when(text.isNotNull(), F.array_join(pieces, ""))
