"""Readers: files in the formats of corpus and benchmark tools to DataFrames.

Schemas are always given or fixed; nothing is inferred by reading the data twice.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusloom.functions import text as T
from corpusloom.ids import running_total

# The files' own conventions.
HIGHLIGHT = "@highlight"
SENTENCE_ENDINGS = [".", "!", "?", "...", "'", "`", '"', "’", ")"]
# Schemes that tasks can open through Arrow; what a task holds of small files and of names at once.
ARROW_SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss")
FILES_BYTES, FILES_ROWS, NAMES = 1 << 23, 256, 10_000


def read_blankline_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents separated by blank lines; stripped, empty ones dropped, inner newlines kept as marks."""
    raw = spark.read.option("lineSep", "\n\n").text(path)
    stripped = raw.select(T.strip("value").alias("text")).filter(F.col("text") != "")
    return stripped.select(T.encode_newlines("text").alias("text"))


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """One document per line, inner newlines restored."""
    return spark.read.text(path).select(T.decode_newlines("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    stripped = spark.read.text(path).select(T.strip("value").alias("text"))
    return stripped.filter(F.col("text") != "")


def read_records(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_delimited(spark: SparkSession, path: str, schema: S.StructType | str, sep: str = "\t", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_shards(spark: SparkSession, paths: list[str], id_col: str = "seq_id") -> DataFrame:
    """Consecutive shards as one table with ids that run on: local id plus the rows of earlier shards.

    Rows are counted by one aggregate; one number per shard reaches the driver.
    """
    frames = [spark.read.parquet(p).withColumn("shard", F.lit(i)) for i, p in enumerate(paths)]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    counts = {r["shard"]: r["n"] for r in out.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = [], 0
    for i in range(len(paths)):
        offsets += [F.lit(i), F.lit(at).cast("long")]
        at += counts.get(i, 0)
    return out.withColumn(id_col, F.col(id_col) + F.element_at(F.create_map(*offsets), F.col("shard")))


def merge_sequences(first: DataFrame, second: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """Append a store; its ids go on after the first one's. Schemas must agree."""
    if [f.dataType for f in first.schema] != [f.dataType for f in second.schema]:
        raise ValueError("both stores need the same column types")
    n = first.agg(F.count(F.lit(1)).alias("_n"))
    moved = second.crossJoin(F.broadcast(n)).withColumn(id_col, F.col(id_col) + F.col("_n")).drop("_n")
    return first.unionByName(moved)


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): 0-based line numbers inside each file, for files of any size.

    Lines get a position inside their file split (their row order there), splits get the number of
    lines before them in their file; no task sees a whole file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    placed = running_total(raw, "_in", ["_row"], keys=["file", "block"], total="_n")
    blocks = placed.groupBy("file", "block").agg(F.max("_n").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = placed.drop("_n").join(offsets, ["file", "block"])
    return joined.select("file", (F.col("_in") + F.col("_off")).alias("line"), "value")


def head_per_file(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` lines of every file."""
    return with_line_numbers(spark, path).filter(F.col("line") < n)


def pair_lines(src: DataFrame, tgt: DataFrame, on: list[str]) -> DataFrame:
    """Two numbered line tables (``on`` + value) as (``on``, src, tgt); an empty or lone line is an error."""
    left = src.select(*on, F.col("value").alias("src"))
    right = tgt.select(*on, F.col("value").alias("tgt"))
    both = left.join(right, on, "full_outer")
    sound = (F.length(F.coalesce("src", F.lit(""))) > 0) & (F.length(F.coalesce("tgt", F.lit(""))) > 0)
    checked = F.when(sound, F.col("src")).otherwise(
        F.raise_error(F.concat(F.lit("empty or missing text at "), F.concat_ws(":", *on)))
    )
    return both.select(*on, checked.cast("string").alias("src"), "tgt")


def read_parallel(spark: SparkSession, src_path: str, tgt_path: str) -> DataFrame:
    """(file_no, line, src, tgt): line-aligned files as pairs; several files pair in name order."""

    def numbered(path: str) -> DataFrame:
        lines = with_line_numbers(spark, path).withColumn("value", F.rtrim("value"))
        # one row per file
        files = lines.select("file").distinct()
        order = Window.partitionBy(F.lit(0)).orderBy("file")
        return lines.join(files.withColumn("file_no", F.row_number().over(order) - 1), "file")

    return pair_lines(numbered(src_path), numbered(tgt_path), ["file_no", "line"])


def read_conll(spark: SparkSession, path: str, label_idx: int = -1) -> DataFrame:
    """(file, sent, words, labels): blank-line separated sentences of space-separated columns.

    ``-DOCSTART-`` lines also end a sentence; a word without further columns gets the label ``O``.
    """
    lines = with_line_numbers(spark, path)
    return conll_sentences(lines, label_idx)


def conll_sentences(lines: DataFrame, label_idx: int = -1) -> DataFrame:
    """Numbered lines (file, line, value) to sentences.

    A sentence is known by how many border lines stand before it: a per-file prefix sum.
    """
    border = (F.col("value") == "") | F.startswith(F.col("value"), F.lit("-DOCSTART-"))
    marked = lines.withColumn("_b", border)
    placed = running_total(marked, "_s", ["line"], keys=["file"], weight=F.col("_b").cast("int"))
    cols = F.split("value", " ", -1)
    at = F.size(cols) + label_idx if label_idx < 0 else F.lit(label_idx)
    label = F.when(F.size(cols) > 1, F.get(cols, at)).otherwise("O")
    words = placed.filter(~F.col("_b")).select("file", F.col("_s").alias("sent"), "line", F.get(cols, F.lit(0)).alias("w"), label.alias("l"))
    lists = words.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("line", "w", "l"))).alias("_a"))
    return lists.select(
        "file", "sent", F.transform("_a", lambda s: s["w"]).alias("words"), F.transform("_a", lambda s: s["l"]).alias("labels")
    )


def conllu_sentences(lines: DataFrame, form: int = 1, tag: int = 3) -> DataFrame:
    """The tab-separated variant: word form and tag by column, comments and range lines skipped."""
    plain = lines.filter(~F.startswith(F.col("value"), F.lit("#")) & ~F.col("value").rlike(r"^\d+[-.]"))
    cols = F.split("value", "\t", -1)
    short = F.when(F.col("value") == "", "").otherwise(F.concat_ws(" ", F.get(cols, F.lit(form)), F.get(cols, F.lit(tag))))
    return conll_sentences(plain.withColumn("value", short))


def read_tasks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(task, definition, positives, pos, id, input, outputs): all instances of each task file, or the first ``limit``."""
    schema = (
        "`Definition` array<string>, `Positive Examples` array<struct<input:string,output:string>>, "
        "`Instances` array<struct<id:string,input:string,output:array<string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    tasks = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("task"),
        F.get("Definition", F.lit(0)).alias("definition"),
        F.col("`Positive Examples`").alias("positives"),
        (F.col("Instances") if limit is None else F.slice("Instances", 1, limit)).alias("_i"),
    )
    return tasks.select("task", "definition", "positives", F.posexplode("_i").alias("pos", "_x")).select(
        "task", "definition", "positives", "pos", "_x.id", "_x.input", F.col("_x.output").alias("outputs")
    )


def multi_questions(articles: DataFrame) -> DataFrame:
    """(id, pos, article, question, options, label): one row per question, the letter as an index."""
    zipped = F.arrays_zip("questions", "options", "answers")
    rows = articles.select("id", "article", F.posexplode(zipped).alias("pos", "q"))
    return rows.select(
        "id", "pos", "article",
        F.col("q.questions").alias("question"),
        F.col("q.options").alias("options"),
        (F.ascii("q.answers") - 65).alias("label"),
    )


def four_choice(df: DataFrame, choices: str = "choices", key: str = "answer_key") -> DataFrame:
    """Questions with exactly four choices; the key A-D or 1-4 as 0-3."""
    letter = F.when(F.col(key).rlike("^[A-D]$"), F.ascii(key) - 65).when(F.col(key).rlike("^[1-4]$"), F.ascii(key) - 49)
    return df.filter(F.size(choices) == 4).withColumn("label", letter)


def choice_counts(df: DataFrame, choices: str = "choices") -> DataFrame:
    n = F.size(choices)
    kind = F.when(n == 3, "three").when(n == 4, "four").when(n == 5, "five").otherwise("other")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def relevance_records(df: DataFrame) -> DataFrame:
    """(question, titles): tab-joined titles of the positive contexts."""
    return df.select("question", F.array_join(F.transform("positive_ctxs", lambda c: c["title"]), "\t").alias("titles"))


def read_predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """The union of the prediction files that exist under a path or pattern."""
    return spark.read.schema("id string, prediction string").json(pattern)


def parse_stories(raw: DataFrame, text: str = "value") -> DataFrame:
    """Add ``story_lines`` and ``summary_lines``.

    Non-empty lines get a final period when they lack an ending; lines before the first highlight
    mark are the article, later ones without marks the summary.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), T.strip), lambda x: x != "")

    def finished(x: Column) -> Column:
        done = F.startswith(x, F.lit(HIGHLIGHT)) | F.substring(x, -1, 1).isin([e for e in SENTENCE_ENDINGS if len(e) == 1])
        return F.when(done, x).otherwise(F.concat(x, F.lit(".")))

    out = raw.withColumn("_l", F.transform(lines, finished))
    marks = F.transform("_l", lambda x: F.startswith(x, F.lit(HIGHLIGHT)).cast("int"))
    out = out.withColumn("_m", F.array_position(marks, 1).cast("int"))
    story = F.when(F.col("_m") == 0, F.col("_l")).otherwise(F.slice("_l", F.lit(1), F.col("_m") - 1))
    rest = F.when(F.col("_m") == 0, F.slice("_l", 1, 0)).otherwise(F.slice("_l", F.col("_m") + 1, F.size("_l")))
    summary = F.filter(rest, lambda x: ~F.startswith(x, F.lit(HIGHLIGHT)))
    return out.withColumn("story_lines", story).withColumn("summary_lines", summary).drop("_l", "_m")


def _entries(folder: str, local: bool) -> Iterator[tuple[str, str, bool, int]]:
    """(name, path, whether a folder, bytes) of what a folder shows to Spark's readers."""
    if local:
        with os.scandir(folder) as found:
            yield from ((e.name, e.path, e.is_dir(), e.stat().st_size) for e in found if _visible(e.name))
    else:
        files, root = fs.FileSystem.from_uri(folder)
        for e in files.get_file_info(fs.FileSelector(root)):
            if _visible(e.base_name):
                yield e.base_name, f"{folder.rstrip('/')}/{quote(e.base_name)}", e.type == fs.FileType.Directory, e.size or 0


def _visible(name: str) -> bool:
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _data_files(folder: str, local: bool) -> Iterator[str]:
    """The files of a folder that aren't empty, or those of its ``key=value`` folders if it has any."""
    inner = [path for name, path, is_folder, _ in _entries(folder, local) if is_folder and "=" in name]
    for path in inner:
        yield from _data_files(path, local)
    if not inner:
        yield from (path for _, path, is_folder, size in _entries(folder, local) if size and not is_folder)


def read_whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): every file of the given folders, files or patterns as one text.

    Tasks list the folders and read the files. Spark's own reader keeps the status of every file and a partition
    per few files in the driver; it is left to schemes that Arrow does not open.
    """
    paths = [path] if isinstance(path, str) else path
    found = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        matches = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        if not matches:
            raise FileNotFoundError(f"no such path: {p}")
        found += [(m.getPath().toUri(), m.isDirectory()) for m in matches]
    schemes = {uri.getScheme() for uri, _ in found}
    if not schemes <= set(ARROW_SCHEMES):
        return spark.read.schema("value string").text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    local = schemes <= {"file"}
    places = [(uri.getPath() if local else uri.toString(), is_folder) for uri, is_folder in found]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[str] = []
        for pdf in batches:
            for place, is_folder in zip(pdf["place"], pdf["folder"]):
                for name in _data_files(place, local) if is_folder else [place]:
                    names.append(name)
                    if len(names) == NAMES:
                        yield pd.DataFrame({"name": names})
                        names = []
        if names:
            yield pd.DataFrame({"name": names})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, bytes]] = []
        size = 0
        for pdf in batches:
            for name in pdf["name"]:
                files, at = (fs.LocalFileSystem(), name) if local else fs.FileSystem.from_uri(name)
                with files.open_input_stream(at) as data:
                    held.append((at.rpartition("/")[2], data.read()))
                size += len(held[-1][1])
                if size >= FILES_BYTES or len(held) == FILES_ROWS:
                    yield pd.DataFrame(held, columns=["file", "value"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["file", "value"])

    slots = max(len(places), spark.sparkContext.defaultParallelism)
    folders = spark.createDataFrame(places, "place string, folder boolean").repartition(max(1, len(places)))
    names = folders.mapInPandas(listed, "name string").repartition(slots)
    return names.mapInPandas(read, "file string, value binary").withColumn("value", F.col("value").cast("string"))


def read_stories(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One file per story; files with ``summary`` in their name are skipped."""
    raw = read_whole_files(spark, path)
    return parse_stories(raw.filter(~F.contains("file", F.lit("summary")))).drop("value")
