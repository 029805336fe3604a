"""Filter interaction audit: what each filter removes, alone and in every order, from one stream over the files.

Every document has a mask with one bit per filter that it fails. All orders of the filters follow from the
number of documents per part, mask and label, so the audit keeps these counters and nothing else.

All filters but the last depend on one text alone. The last, *identical to the text of a smaller id*, depends on
the whole table. The files are read as a stream of available-now micro-batches beside a table of state that
is keyed by text: the smallest id seen, and the rows with that id. Every row is first counted as a repeat. What
the state adds:

* the smallest id of a text gets its bit taken back;
* when a smaller id arrives in a later micro-batch, the earlier row's mask without the bit is retracted
  from its part's counters and put back with it.

State is a log: a micro-batch appends the texts whose smallest id is new or fell, under its own number, and
writes the changes of counters that it caused beside it. As ids only fall, the state before a
micro-batch is the minimum over the log of the earlier ones, and a micro-batch that runs again replaces what it
wrote. The counters are the sum of all changes, whatever order the files came in. (Spark's own state
store would need a Python call per text or bucket, and writes four small files per partition and micro-batch.)

Texts are reduced to a digest and a mask before anything moves. Rows are counted by text and id before they
are joined, so repeated rows are one; minima of a text are partial aggregates; every join is by text and id or
has one row per text, so a text that a third of all rows share is in no join more than once per id.

Defined results: a null text is an empty text; a null source is part of the part ''; rows with equal id and
text don't repeat each other; a row with a null id repeats nothing and is repeated by nothing; a document
with several labels has a label if one of them says so, a null label is none; an empty table gives no row; other
columns are ignored; texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.files import shared_folder
from corpusloom.session import drop_copies, materialize, recorded_copies

SPACE = r"[\x20\x09-\x0D]+"

# The conditions and their bounds.
TEXT_FILTERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "A": lambda text, words, distinct: words < 200,
    "B": lambda text, words, distinct: 100 * distinct < 50 * words,
    "C": lambda text, words, distinct: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
    "D": lambda text, words, distinct: text.rlike("[#$%&*|]"),
}


@dataclass(frozen=True)
class Audit:
    """Filters by letter; ``repeat`` is the letter of the filter on identical texts.

    The files come in about ``batches`` micro-batches of equal size.
    """

    filters: dict[str, Callable[[Column, Column, Column], Column]] = field(default_factory=lambda: dict(TEXT_FILTERS))
    repeat: str = "E"
    batches: int = 4

    @property
    def letters(self) -> str:
        return "".join(self.filters) + self.repeat

    @property
    def repeat_bit(self) -> int:
        return 1 << len(self.filters)


CELL = ["part", "good", "toxic"]
STATE = "digest binary, id long, mask int, part string, good boolean, toxic boolean, n long, batch int"
CHANGE = "part string, mask int, good boolean, toxic boolean, n long"


def masked(docs: DataFrame, audit: Audit, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, mask) of every row, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select("id", "part", "text", F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("distinct"))
    mask = F.lit(0)
    for i, fails in enumerate(audit.filters.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words").cast("long"), F.col("distinct").cast("long")), 1 << i).otherwise(0)
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def counted_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(digest, known, id, mask, part, good, toxic, n) from :func:`masked`; ``labels`` is (label_id, good, toxic)."""
    # a null id takes a number of its own, so that null ids don't meet in one task
    rows = rows.withColumn("known", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.xxhash64("digest", "part")))
    rows = rows.join(labels, (F.col("id") == F.col("label_id")) & F.col("known"), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.select("digest", "known", "id", "mask", "part", *flags).groupBy("digest", "known", "id", "mask", *CELL).agg(F.count(F.lit(1)).alias("n"))


def advance(rows: DataFrame, state: DataFrame, bit: int) -> tuple[DataFrame, DataFrame]:
    """(what ``rows`` adds to the state, the changes of counters), from :func:`counted_rows` and the log so far."""
    known = rows.filter("known")
    least = known.groupBy("digest").agg(F.min("id").alias("id"))
    was = state.groupBy("digest").agg(F.min("id").alias("was"))
    moved = materialize(least.join(was, "digest", "left").filter("was is null or id <= was"))
    up = materialize(known.join(moved.select("digest", "id"), ["digest", "id"]).drop("known"))
    fallen = moved.filter("id < was").select("digest", F.col("was").alias("id"))
    down = state.drop("batch").join(fallen, ["digest", "id"])
    repeated = F.col("mask").bitwiseOR(bit)

    def change(of: DataFrame, mask: Column, n: Column) -> DataFrame:
        return of.select("part", mask.alias("mask"), "good", "toxic", n.alias("n"))

    n, mask = F.col("n"), F.col("mask")
    changes = change(rows, F.when(F.col("known"), repeated).otherwise(mask), n)
    for of, sign in ((up, 1), (down, -1)):
        changes = changes.unionByName(change(of, mask, sign * n)).unionByName(change(of, repeated, -sign * n))
    return up, changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def counters(
    spark: SparkSession,
    path: str,
    labels: DataFrame,
    audit: Audit = Audit(),
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """(part, mask, good, toxic, n) over all Parquet files at ``path``."""
    known = labels.filter("(quality = 1 or toxic = 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    known = materialize(
        known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    )
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getContentSummary(at).getLength()
    # a stream reads folders or patterns: a single file is given as a pattern that only it matches
    files = path if system.getFileStatus(at).isDirectory() else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", size // audit.batches + 1).parquet(files)
    folder = shared_folder(spark, "filter-audit")

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        with recorded_copies() as made:
            rows = materialize(counted_rows(batch, known))
            log = own.read.schema(STATE)
            earlier = log.parquet(f"{folder}/texts").filter(F.col("batch") < number) if number else own.createDataFrame([], STATE)
            up, changes = advance(rows, earlier, audit.repeat_bit)
            changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
            up.write.mode("overwrite").parquet(f"{folder}/texts/batch={number}")
        drop_copies(own, made)

    run = masked(stream, audit, id_col, text_col, part_col).writeStream.foreachBatch(put)
    run.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    written = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    if not written.getFileSystem(spark._jsc.hadoopConfiguration()).exists(written):  # no file, no micro-batch
        return spark.createDataFrame([], CHANGE)
    made = spark.read.schema(CHANGE + ", batch int")
    return made.parquet(f"{folder}/changes").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n > 0")


def interactions(counted: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """One row per part, order and step from the counters of :func:`counters`.

    Of a mask with c bits, each filter is the first in a c-th of all orders, which is what the sum of a
    filter's removals over all orders needs.
    """
    letters = audit.letters
    orders = ["".join(p) for p in permutations(letters)]
    total = F.sum("n")
    per_mask = counted.groupBy("part", "mask").agg(
        total.alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    per_part = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2 ** filters at most
    rows = per_part.select("part", "masks", F.explode(F.split(F.lit(" ".join(orders)), " ")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))

    def bits(names: Column) -> Column:
        return F.aggregate(F.split(names, ""), F.lit(0), lambda a, c: a + _power(c, letters))

    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    rows = rows.select("part", "masks", "filter_order", "step", _power(letter, letters).alias("bit"), bits(before).alias("gone"))
    bit, gone = F.col("bit"), F.col("gone")

    def summed(value: Callable[[Column], Column], holds: Callable[[Column], Column]) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("masks", zero, lambda a, m: a + F.when(holds(m["mask"]), value(m)).otherwise(zero))

    def fails(m: Column) -> Column:
        return m.bitwiseAND(bit) != 0

    def here(m: Column) -> Column:
        return fails(m) & (m.bitwiseAND(gone) == 0)

    return rows.select(
        "part",
        "filter_order",
        "step",
        summed(lambda m: m["n"], lambda m: m.bitwiseAND(bit.bitwiseOR(gone)) == 0).alias("kept"),
        summed(lambda m: m["n"], here).alias("removed"),
        summed(lambda m: m["n"], lambda m: fails(m) & (m.bitwiseAND(gone) != 0)).alias("redundant"),
        summed(lambda m: m["n"], lambda m: m == bit).alias("unique_fails"),
        summed(lambda m: m["good"], here).alias("good_lost"),
        summed(lambda m: m["toxic"], here).alias("toxic_lost"),
        summed(lambda m: m["n"] * (F.lit(len(orders)) / F.bit_count(m["mask"])).cast("long"), fails).alias("shapley"),
    )


def _power(letter: Column, letters: str) -> Column:
    value = F.lit(0)
    for i, name in enumerate(letters):
        value = F.when(letter == name, 1 << i).otherwise(value)
    return value


def audit_files(spark: SparkSession, path: str, labels: DataFrame, audit: Audit = Audit(), **columns: str) -> DataFrame:
    """The audit of all Parquet files at ``path``: a row per part, order of the filters and step."""
    return interactions(counters(spark, path, labels, audit, **columns), audit)
