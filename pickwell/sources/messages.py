"""Message streams in, landed text out, newest landed days back in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pickwell.sources.files import Entry, children, exists, remove

FILES_PER_HOUR = 10
FOLD_TASKS = 1000
"""Tasks that write the files of a fold, at most."""


def read_messages(spark: SparkSession, fmt: str = "kafka", *, stream: bool = True, **options: str) -> DataFrame:
    """Message texts as one ``value`` column, keys dropped.

    ``options`` go to the source as they are (servers, topics, group and
    partition settings for a message bus, ``path`` for files). With
    ``stream=False`` the same source is read as a batch, between whatever
    start and end positions the options give.
    """
    reader = (spark.readStream if stream else spark.read).format(fmt)
    source = reader.options(**options).load()
    return source.select(F.col("value").cast("string").alias("value"))


def with_arrival(lines: DataFrame, at: F.Column | None = None) -> DataFrame:
    """Adds the ``day`` (yyyyMMdd) and ``hour`` folders a line lands in."""
    at = F.current_timestamp() if at is None else at
    return lines.withColumn("day", F.date_format(at, "yyyyMMdd")).withColumn("hour", F.date_format(at, "HH"))


def land_stream(lines: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch as text under ``day=/hour=/batch=``, with the batch's own parallelism.

    A batch that is repeated replaces its own folders. :func:`fold_hours` makes few files of an hour's
    batches. Without ``day`` and ``hour`` columns the processing time decides.
    """
    if "day" not in lines.columns:
        lines = with_arrival(lines)

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.select("value", "day", "hour", F.lit(f"{number:012d}").alias("batch"))
        _write_folders(rows, path)

    writer = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def _write_folders(rows: DataFrame, path: str) -> None:
    """Replace the folders that ``rows`` have lines for, and no other."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day", "hour", "batch").text(path)


def live_folders(spark: SparkSession, hour: str) -> list[Entry]:
    """Folders of an hour that count, oldest first: the newest fold, and batches it does not hold. Other layouts have none."""
    batches = [e for e in children(spark, hour) if e.name.startswith("batch=")]
    folds = [e for e in batches if e.name.startswith("batch=f")]
    if not folds:
        return batches
    return [folds[-1], *(e for e in batches if not e.name.startswith("batch=f") and _number(e) > _number(folds[-1]))]


def _number(folder: Entry) -> int:
    return int(folder.name.removeprefix("batch=").removeprefix("f"))


def fold_hours(
    spark: SparkSession, path: str, before: str | None = None, files: int = FILES_PER_HOUR, running: bool = True
) -> int:
    """Rewrite the batches of each closed hour as one folder of at most ``files`` files; how many hours there were.

    Hours are closed if ``yyyyMMddHH`` of their folder is less than ``before``. While the stream is ``running``, its newest batch
    may not be whole yet and is left for the next time. The fold appears at once and readers then leave out what
    it holds; the folders it replaces go last, so breaking off anywhere loses and doubles no line.
    """
    hours = [
        (day.name.split("=")[1], hour.name.split("=")[1], hour.path)
        for day in children(spark, path) if day.name.startswith("day=")
        for hour in children(spark, day.path) if hour.name.startswith("hour=")
    ]
    every = {h: [e for e in children(spark, h[2]) if e.name.startswith("batch=")] for h in hours}
    numbers = [_number(e) for found in every.values() for e in found]
    newest = max(numbers, default=-1) + (0 if running else 1)
    sources, folded, gone = [], [], []
    for (day, hour, place), found in every.items():
        if before is not None and day + hour >= before:
            continue
        live = [e for e in live_folders(spark, place) if _number(e) < newest or e.name.startswith("batch=f")]
        gone += [e.path for e in found if e not in live and _number(e) < newest]
        if len(live) > 1 or live and not live[0].name.startswith("batch=f"):
            sources.append(live)
            folded.append((day, hour))
    if sources:
        upto = max(_number(e) for live in sources for e in live)
        reader = spark.read.schema("value string, day string, hour string").option("basePath", path)
        rows = reader.text([e.path for live in sources for e in live])
        part = F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(files))
        dealt = rows.select("value", "day", "hour", F.lit(f"f{upto:012d}").alias("batch"))
        # A task a file, while they are not too many: dealt by a hash, several large files would fall to one task.
        places = spark.createDataFrame([(day, hour, i * files) for i, (day, hour) in enumerate(folded)], "day string, hour string, place int")
        task = F.pmod(F.col("place") + part, F.lit(FOLD_TASKS)).cast("int")
        placed = dealt.join(F.broadcast(places), ["day", "hour"]).repartitionById(min(len(folded) * files, FOLD_TASKS), task)
        _write_folders(placed.drop("place"), path)
        gone += [e.path for live in sources for e in live if e.name != f"batch=f{upto:012d}"]
    for folder in gone:
        remove(spark, folder)
    return len(sources)


def latest_dirs(spark: SparkSession, root: str, n: int | None, by: str = "name") -> list[str]:
    """Names of the newest ``n`` folders under ``root`` (all without), newest first (metadata only)."""
    key = {"name": lambda e: e.name.removeprefix("day="), "mtime": lambda e: (e.modified, e.name)}[by]
    dirs = [e for e in children(spark, root) if e.is_dir]
    return [e.name for e in sorted(dirs, key=key, reverse=True)[:n]]


def read_latest(spark: SparkSession, root: str, n: int = 10, by: str = "name") -> DataFrame:
    """Lines of the newest ``n`` day folders in one scan; other folders are not listed.

    Day folders are named ``day=yyyyMMdd`` or ``yyyyMMdd``; others do not count. A root
    that holds folders but no day is an error. Of an hour that was landed in batches the folders that
    count are read (:func:`live_folders`). Below another streaming sink the files come
    from the sink's log, which knows what was committed, and other days are pruned.
    """
    dirs = latest_dirs(spark, root, None, by)
    names = [name for name in dirs if re.fullmatch(r"(day=)?\d{8}", name)][:n]
    if not names and any(not name.startswith(("_", ".")) for name in dirs):
        raise ValueError(f"no day folder under {root}: {', '.join(dirs[:5])}")
    if not names:
        return spark.createDataFrame([], "value string")
    if exists(spark, f"{root}/_spark_metadata"):
        days = [name.split("=", 1)[1] for name in names]
        reader = spark.read.schema("value string, day string, hour string")
        return reader.text(root).where(F.col("day").isin(days)).select("value")
    folders = []
    for name in names:
        hours = [(e.path, live_folders(spark, e.path)) for e in children(spark, f"{root}/{name}") if e.name.startswith("hour=")]
        inside = [f.path for path, live in hours for f in (live or [Entry("", path, 0, True)])]
        folders += inside or [f"{root}/{name}"]
    return spark.read.schema("value string").option("recursiveFileLookup", "true").text(folders)
