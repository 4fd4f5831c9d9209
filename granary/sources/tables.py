"""Sources: table loading, split routing and existence contracts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source name -> reader of (spark, root); ``register`` adds to it.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[name] = reader


def load(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A registered source, else ``root/name.parquet``; fails on a name that is neither."""
    if name not in READERS and not _there(spark, f"{root}/{name}.parquet"):
        raise ValueError(f"unknown source: {name}")
    return READERS[name](spark, root) if name in READERS else spark.read.parquet(f"{root}/{name}.parquet")


#: Task name -> the source that its rows come from and what to do with them; ``route`` adds to it.
TASKS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def route(task: str, source: str, rows: Callable[[DataFrame], DataFrame]) -> None:
    TASKS[task] = (source, rows)


def load_tasks(spark: SparkSession, root: str, tasks: Iterable[str]) -> DataFrame:
    """The rows of all ``tasks`` with their ``task``, each from its own source; an unknown task fails before anything is read."""
    tasks = list(tasks)
    unknown = sorted(set(tasks) - set(TASKS))
    if unknown:
        raise ValueError(f"unknown tasks: {', '.join(unknown)}")
    parts = [TASKS[t][1](load(spark, TASKS[t][0], root)).withColumn("task", F.lit(t)) for t in tasks]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_or_csv(spark: SparkSession, path: str, csv_path: str, schema: str) -> DataFrame:
    """Parquet, or a CSV copy with a header where it can't be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.read.schema(schema).csv(csv_path, header=True)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that is there, else the first one; through the store's own file system."""
    return next((p for p in paths if _there(spark, p)), paths[0])


def json_lines(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Lines of every matching file, with the file's name; ``rank`` is the number in ``rank<k>``."""
    lines = spark.read.schema(schema).json(glob).withColumn("file", F.input_file_name())
    return lines.withColumn("rank", F.regexp_extract("file", r"rank(\d+)", 1).try_cast("int"))


def folder_names(spark: SparkSession, root: str, pattern: str, parts: list[str]) -> DataFrame:
    """The groups of ``pattern`` in the names of what a folder holds, through the store's own file system; names that don't match are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    listed = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    return listed.where(F.col("name").rlike(pattern)).select(*[F.regexp_extract("name", pattern, i).alias(c) for i, c in enumerate(parts, 1)])


def subtask_counts(spark: SparkSession, root: str) -> DataFrame:
    """(task, split, n): rows of every folder ``<task>_subtask-<k>_<split>``, subtasks summed."""
    pattern = r"^(.+)_subtask-(\d+|multi_label_classification)_(train|val|test)$"
    found = folder_names(spark, root, pattern, ["task", "subtask", "split"]).collect()  # one row for each folder
    counts = [spark.read.parquet(f"{root}/{r.task}_subtask-{r.subtask}_{r.split}").agg(F.count("*").alias("n")).select(F.lit(r.task).alias("task"), F.lit(r.split).alias("split"), "n") for r in found]
    if not counts:
        return spark.createDataFrame([], "task string, split string, n long")
    return reduce(DataFrame.unionByName, counts).groupBy("task", "split").agg(F.sum("n").alias("n"))


def shard_rows(spark: SparkSession, path: str) -> int | None:
    """Rows of a table: null without its folder, 0 without files."""
    if not _there(spark, path):
        return None
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return 0


def run_history(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """(_step, epoch, metrics) of a run's CSV history: cells that aren't numbers and rows without a step are dropped."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").try_cast("double")), F.col(f"`{c}`").try_cast("double")) if c in raw.columns else F.lit(None).cast("double")
    return raw.select(number("_step").cast("long").alias("_step"), number("epoch").alias("epoch"), *[number(m).alias(m) for m in metrics]).where("_step is not null")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token): distinct trimmed lines of a text file, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''").distinct()


def predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of two arrays ``classification`` and ``generation`` of ``schema`` as rows with their ``part``."""
    whole = spark.read.schema(f"epoch double, global_step long, classification array<struct<{schema}>>, generation array<struct<{schema}>>").json(path, multiLine=True)
    parts = [whole.select("epoch", "global_step", F.lit(p).alias("part"), F.explode(p).alias("r")) for p in ("classification", "generation")]
    return parts[0].unionByName(parts[1]).select("epoch", "global_step", "part", "r.*")


def prediction_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``sinks.write_predictions`` wrote: JSON lines in a folder for each part, read by as many tasks as there are files."""
    return spark.read.schema(f"epoch double, global_step long, {schema}, part string").option("basePath", path).json(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def require(found: Iterable[str], wanted: Iterable[str]) -> None:
    """Fail on configured tables that were not loaded."""
    missing = sorted(set(wanted) - set(found))
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")


def hashed_split(key: Column) -> Column:
    """train, val (1 in 16) or test (1 in 16) by the first digit of the key's md5; the same on every engine and run."""
    digit = F.substring(F.md5(key.cast("string").cast("binary")), 1, 1)
    return F.when(digit == "0", "test").when(digit == "1", "val").otherwise("train")


def metadata_split(metadata: Column) -> Column:
    """All splits whose name a text holds; a row may be in several."""
    return F.filter(F.array(F.lit("train"), F.lit("test")), lambda s: F.contains(metadata, s))


def toy_sample(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """The n rows of smallest md5 of the key; all without n."""
    return df if n is None else df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)
