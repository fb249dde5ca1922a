"""Tables in files and databases. Writers take frames and leave partitioning to Spark; nothing goes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from reelspark.functions.titles import season_of


def read_csv(spark: SparkSession, path: str, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """A CSV with a header and a declared schema (nothing is inferred), columns renamed."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path).withColumnsRenamed(renames or {})


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of that schema if nothing is there."""
    try:
        return conform(spark.read.parquet(path), schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def conform(rows: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The columns of ``schema`` in its order and types: others are dropped, missing ones filled with a default or null."""
    defaults = defaults or {}
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def schema_drift(rows: DataFrame, schema: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(column, what, expected, found) for each missing, extra or differently typed column."""
    want, have = {f.name: f.dataType.simpleString() for f in schema}, dict(rows.dtypes)
    out = [(c, "missing", t, None) for c, t in want.items() if c not in have]
    out += [(c, "extra", None, t) for c, t in have.items() if c not in want]
    return out + [(c, "type", t, have[c]) for c, t in want.items() if c in have and have[c] != t]


def read_jdbc(spark: SparkSession, url: str, query: str, key: str, bounds: tuple[int, int], partitions: int, properties: dict | None = None) -> DataFrame:
    """A query's rows, read in parallel by ranges of a numeric key."""
    options = {"url": url, "dbtable": f"({query}) q", "partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions), "fetchsize": "50000"}
    return spark.read.format("jdbc").options(**options, **(properties or {})).load()


def extract_jdbc(spark: SparkSession, url: str, query: str, key: str, path: str, ranges: int, at_once: int = 8, properties: dict | None = None) -> DataFrame:
    """A query's rows as Parquet below ``path``, read by ranges of a numeric key; an extract that broke off goes on where it was.

    The ranges are taken from the source once and written beside the data; the first and the last are open, so rows
    that come in later, and null keys (in the first), are in one of them. Ranges are read ``at_once`` at a time, one task each,
    into folders of their own. A folder that was written to the end is not read again.
    """
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/ranges/_SUCCESS")):
        quoted = f'"{key}"'
        lo, hi = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM ({query}) a) q", **(properties or {})).load().first()
        edges = [] if lo is None else sorted({int(lo) + (int(hi) - int(lo) + 1) * k // ranges for k in range(1, ranges)} - {int(lo)})
        spark.createDataFrame([(e,) for e in edges], "edge long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    edges = [None, *sorted(r["edge"] for r in spark.read.parquet(f"{path}/ranges").collect()), None]
    parts = []
    for n, (since, until) in enumerate(zip(edges, edges[1:], strict=False)):
        conditions = [f'"{key}" >= {since}'] * (since is not None) + [f'"{key}" < {until}'] * (until is not None)
        whole = " AND ".join(conditions) or "1 = 1"
        parts.append((n, whole if since is not None else f'({whole} OR "{key}" IS NULL)'))
    folder = lambda wave: f"{path}/wave={wave[0][0]}"
    waves = [parts[k : k + at_once] for k in range(0, len(parts), at_once)]
    for wave in waves:
        if not fs.exists(at(f"{folder(wave)}/_SUCCESS")):
            spark.read.jdbc(url, f"({query}) q", predicates=[w for _, w in wave], properties={"fetchsize": "50000", **(properties or {})}).write.mode("overwrite").parquet(folder(wave))
    return spark.read.parquet(*[folder(wave) for wave in waves])


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes paths for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, properties: dict | None = None) -> None:
    """Rows into a database table, in batches from every partition."""
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **(properties or {})).mode(mode).save()


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_snapshot(rows: DataFrame, folder: str, day: str) -> str:
    """A dated snapshot below ``folder``; a second one of a day replaces the first."""
    path = f"{folder.rstrip('/')}/snapshot={day}"
    rows.write.mode("overwrite").parquet(path)
    return path


def replace_by_type(rows: DataFrame, path: str, column: str = "type") -> None:
    """Replace the partitions of the types that ``rows`` holds; other types stay. Scores are cut to 1."""
    if "score" in rows.columns:
        rows = rows.withColumn("score", F.least("score", F.lit(1.0)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows whose key isn't in ``new``, and of each new key the first row by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(last)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All old rows, and of each key that they lack the first new row by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def fill_nulls(target: DataFrame, source: DataFrame, key: str, columns: list[str], replace: bool = False) -> DataFrame:
    """Target columns filled from the source's row of the same key, where they are null (or, with ``replace``, wherever the source has a value)."""
    s = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    pick = lambda c: F.coalesce(f"_{c}", c) if replace else F.coalesce(c, f"_{c}")
    return target.join(s, key, "left").withColumns({c: pick(c) for c in columns}).select(target.columns)


def update_by_season(items: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Items with ``columns`` from the source's row of the same series and season, where it has a value.

    The season is the one that an item's title names (1 without one). ``items``: series_nm, title and
    the columns; ``source``: series_nm, season and the columns, a row for each key. Items without a
    series, and seasons that the source lacks, stay as they are.
    """
    keyed = items.withColumn("_season", F.when(F.col("title").isNull(), 1).otherwise(season_of(F.col("title"))[1]))
    s = source.select(F.col("series_nm").alias("_series"), F.col("season").alias("_of"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = keyed.join(s, (F.col("series_nm") == F.col("_series")) & (F.col("_season") == F.col("_of")), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(items.columns)


def merge_parts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of parts; of each key the row of the earliest part stays."""
    out = None
    for n, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(n))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("_part")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_part")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are still to be processed."""
    return rows.join(done.select(key), key, "left_anti")


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(F.to_date(day), F.dayofweek(day) - 1)


def write_weekly(rows: DataFrame, path: str, at: str) -> None:
    """Rows partitioned by week, each week's rows together so that few files are written."""
    weekly = rows.withColumn("week_start", week_start(F.col(at)))
    weekly.repartition("week_start").write.mode("overwrite").partitionBy("week_start").parquet(path)


def read_weeks(spark: SparkSession, path: str, since: str, until: str, at: str) -> DataFrame:
    """Rows from ``since`` to before ``until``: the filter also names the partition column, so other weeks aren't listed or read."""
    first = week_start(F.lit(since).cast("date"))
    return spark.read.parquet(path).filter((F.col("week_start") >= first) & (F.col("week_start") <= F.lit(until).cast("date")) & (F.col(at) >= F.lit(since)) & (F.col(at) < F.lit(until)))


def flatten_dictionary(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    """(term, category) of a small reference dictionary of lists."""
    return spark.createDataFrame([(t, c) for c, terms in table.items() for t in terms], "term string, category string")


#: What a provider's nested item looks like.
PROVIDER = "title STRING, genres ARRAY<STRING>, runtime INT, crew ARRAY<STRUCT<job: STRING, name: STRING>>, cast ARRAY<STRING>, videos ARRAY<STRUCT<lang: STRING, kind: STRING, key: STRING>>"


def flatten_provider(rows: DataFrame, json: str, jobs: tuple[str, ...] = ("Director", "Creator"), langs: tuple[str, ...] = ("ko", "en")) -> DataFrame:
    """Nested provider JSON as flat columns: director by job priority, leads and guests, first genre and all, runtime as HH:MM, trailer by language and kind."""
    p = F.from_json(json, PROVIDER)

    def person(job: str) -> Column:
        return F.try_element_at(F.filter(p.crew, lambda c: c.job == job), F.lit(1)).getField("name")

    def video(lang: str, kind: str) -> Column:
        return F.try_element_at(F.filter(p.videos, lambda v: (v.lang == lang) & (v.kind == kind)), F.lit(1)).getField("key")

    by_job = [person(job) for job in jobs]
    trailers = [video(lang, kind) for lang in langs for kind in ("Trailer", "Teaser")]
    minutes = p.runtime
    clock = F.when(minutes > 0, F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0")))
    return rows.withColumns({"title": p.title, "director": F.coalesce(*by_job), "cast_lead": F.array_join(F.slice(p.getField("cast"), 1, 4), ", "), "cast_guest": F.array_join(F.slice(p.getField("cast"), 5, 4), ", "), "genre": F.try_element_at(p.genres, F.lit(1)), "genre_detail": F.array_join(p.genres, ", "), "disp_rtm": clock, "trailer": F.coalesce(*trailers)}).drop(json)
