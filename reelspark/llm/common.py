"""What the corpus operators share: reading tables and cutting lineage through shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts that a Python function gets at once at most, in rows and in bytes; one text may be longer.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


#: Bits of a list's map: for each of its rows, and at most. A map has a row of two longs for each 64 bits, so what is broadcast is 4 MB at most.
BITS_A_ROW, BITS_MOST = 16, 1 << 24


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, in order of a hash of ``key``, whose values are distinct.

    The count gives a threshold of the hash, so that little more than what is wanted has to be sorted.
    """
    n = rows.count()
    if n <= most:
        return rows
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))
    few = rows.filter(h < int(min(1.0, (most + 6 * most**0.5 + 100) / n) * (1 << 40)))
    return few.orderBy(h, key).limit(most)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` for the actions that run in here; the session's setting is what it was afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Folders of the runs under way, the innermost last; see ``scratch``.
_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (``spark.checkpoint.dir``).

    Only a local session, whose executors run on this machine, may leave the setting out.
    """
    if _scratch:
        return f"{_scratch[-1]}/{uuid.uuid4().hex}"
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/reelspark-shared"
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_folder`` gave."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` writes in here is removed at the end. A result must have been written elsewhere by then."""
    folder = shared_folder(spark)
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        remove(spark, folder)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to shared storage (or to ``path``) and read it back.

    This cuts the lineage: a lost executor costs a reread, not a new computation, and a frame that
    several jobs read is computed once. ``DataFrame.checkpoint`` would compute it twice.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_texts(df: DataFrame, path: str | None = None) -> DataFrame:
    """``materialise`` what Python makes of texts, which go to it TEXT_ROWS rows at a time rather than Spark's 10,000: both sides hold a batch in memory."""
    with batches_of(df.sparkSession, TEXT_ROWS):
        return materialise(df, path)


def maybe_listed(rows: DataFrame, listed: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``_maybe``: false only where no row of ``listed`` has equal keys; nulls equal each other.

    ``keys`` has pairs of a column of ``rows`` and one of ``listed`` of equal type. The list becomes a
    map of hashed bits of a fixed largest size, which is broadcast. What is true must still meet the
    list itself; what is false need not, and so isn't shuffled for it. A list too long for the map
    makes more rows true, and no row false that is listed. ``listed`` is read twice.
    """
    bits = min(BITS_MOST, 1 << max(6, (BITS_A_ROW * listed.count()).bit_length()))

    def place(columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(bits))

    def bit(at: str) -> Column:
        return F.expr(f"shiftleft(1L, cast({at} % 64 as int))")

    def word(at: str) -> Column:
        return F.floor(F.col(at) / 64).cast("long")

    held = listed.select(place([b for _, b in keys]).alias("_at")).groupBy(word("_at").alias("_word")).agg(F.bit_or(bit("_at")).alias("_bits"))
    marked = rows.withColumn("_at", place([a for a, _ in keys])).withColumn("_word", word("_at")).join(F.broadcast(held), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit("_at")) != 0, F.lit(False))).drop("_word", "_at", "_bits")


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``_at``, their place from 0 in that order, which no single task sorts or numbers.

    Rows are dealt by ranges of the order and sorted where they are; a row's place is the rows of the
    parts before it (one count a part) and its own number within. Columns of ``order`` should differ
    between any two rows: others come in an order that is settled once they are written.
    """
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    numbered = materialise(numbered.withColumn("_part", F.shiftright("_at", 33)))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(counts.select("_part", before.alias("_before")))
    return numbered.join(starts, "_part").withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def nonnull_text(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """A batch whose last column holds texts, in slices of bounded size: the other columns, and the texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, min(at + TEXT_ROWS, int(sizes.searchsorted(before + TEXT_BYTES, side="right"))))
        part = batch.slice(at, to - at)
        yield part.columns[:-1], part.column(part.num_columns - 1).to_pylist()
        at = to


def _beside(names: list[str]) -> str:
    """A name for the texts that none of the columns has."""
    name = "__text"
    while name in names:
        name += "_"
    return name


def map_texts(documents: DataFrame, keep: list[str], added: T.StructType, make: Callable[[], Callable[[list[str]], tuple[list[int] | None, list[list]]]], text_column: str = "text") -> DataFrame:
    """The columns ``keep``, untouched, with the columns ``added`` that a Python function makes of each text.

    ``make`` is called once in each task, and what it returns once for each slice of texts (null is
    empty): it gives the values of each added column, and for each row of them the place of its text
    in the slice (None: one row for each text, in order). Kept values stay in Arrow, so any type
    and null comes back as it was.
    """
    schema = T.StructType([*[documents.schema[c] for c in keep], *added.fields])
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for kept, texts in _parts(batch):
                at, columns = work(texts)
                if at is not None:
                    kept = [c.take(pa.array(at, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    return documents.select(*[F.col(f"`{c}`") for c in keep], nonnull_text(text_column).alias(_beside(keep))).mapInArrow(run, schema)


def fold_texts(documents: DataFrame, result: T.StructType, make: Callable[[], tuple[Callable[[list[str]], None], Callable[[], Iterator[list[list]]]]], text_column: str = "text") -> DataFrame:
    """What a Python function has gathered of all texts (null is empty) of a task, at its end.

    ``make`` is called once in each task and gives two functions: one takes each slice of texts, the
    other gives the columns of ``result`` in batches when there are no more.
    """
    types = [to_arrow_type(f.dataType) for f in result.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, gathered = make()
        for batch in batches:
            for _, texts in _parts(batch):
                add(texts)
        for columns in gathered():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=result.fieldNames())

    return documents.select(nonnull_text(text_column).alias("__text")).mapInArrow(run, result)


def filter_texts(documents: DataFrame, make: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """The rows of ``documents`` whose text (null is empty) a Python predicate keeps; nothing else changes."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = make()
        for batch in batches:
            mask = pa.array([bool(keeps(t)) for _, texts in _parts(batch) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(mask)

    return documents.select(*[F.col(f"`{c}`") for c in names], nonnull_text().alias(_beside(names))).mapInArrow(run, documents.schema)
