"""What the operators of this package share: the shared folder, tables, words, labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ship

#: A word is a maximal run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; only where that is
    unset (tests on one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder (options: of Spark's Parquet writer) and reads it back: cuts the
    lineage, survives lost executors. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize gave, once nothing reads it again."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A written table of few numbers a row, to be broadcast if it has at most so many rows; else the
    join shuffles, and AQE splits what is skewed."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: str) -> list[str]:
    """Words as WORD has them; str.split() alone also splits at other Unicode spaces."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def runs(batches: Iterator, keys: list[str]) -> Iterator[list]:
    """Rows of sorted pandas batches, as one list of tuples for each run of equal keys. Needs the
    rows of a key side by side; holds one run at a time."""
    held, at = [], None
    for batch in batches:
        where = [batch.columns.get_loc(k) for k in keys]
        for row in batch.itertuples(index=False, name=None):
            key = tuple(row[i] for i in where)
            if key != at and held:
                yield held
                held = []
            at = key
            held.append(row)
    if held:
        yield held


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, bound: int, keep: Column | None = None) -> DataFrame:
    """At most `bound` labelled documents, the first by md5 of doc_id, as a written table (__key, label,
    text) of a row for each different text: the bounded sample that a classifier is fitted on. Texts that
    stand there with several labels get the largest. Texts never reach the driver."""
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").alias("__id"), F.col(column).cast("long").alias("label")).where("__id is not null and label is not null")
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.withColumn("__order", F.md5(F.col("__id").cast("string")))
    n = rows.count()
    if n > 4 * bound:  # most can't be among the first; the task that takes them gets few more than needed
        rows = rows.where(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") < F.lit(min(1 << 32, int((1 << 32) * (bound + 10 * bound**0.5) / n))))
    rows = F.broadcast(rows.orderBy("__order", "label").limit(bound).select("__id", "label"))
    texts = docs.select(F.col("doc_id").alias("__doc"), whole(F.col("text")).alias("text"))
    one = texts.join(rows, texts["__doc"] == rows["__id"]).groupBy(F.md5("text").alias("__key")).agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return materialize(one.repartition(2 * spark.sparkContext.defaultParallelism, "__key"), "labelled")


class Rows:
    """Sparse rows (lists of column numbers with values) for the fits below."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width, self.n = width, len(rows)
        self.row = np.repeat(np.arange(self.n), [len(i) for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.col = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def descend(gradient: Callable, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam over a full-batch gradient."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


#: Texts that a function gets at a time; bounds what a worker holds.
SLICE = 500


def over_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict]], spec: str, text: str = "text") -> DataFrame:
    """Maps batches of whole texts to columns. make() runs once in each task and gives a function (whose
    attribute `done`, if any, is called at the end) from texts (null: empty) to Arrow arrays by name; df's other columns named in spec pass as they are."""
    ship(df.sparkSession)
    passed = [x.split()[0] for x in spec.split(", ") if x.split()[0] in df.columns and x.split()[0] != text]

    def work(batches):
        import pyarrow as pa

        f = make()
        names = [x.split()[0] for x in spec.split(", ")]
        try:
            for whole_batch in batches:
                for i in range(0, whole_batch.num_rows, SLICE):
                    batch = whole_batch.slice(i, SLICE)
                    made = f([t or "" for t in batch.column(text).to_pylist()])
                    columns = {c: batch.column(c) for c in passed} | made
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
        finally:
            getattr(f, "done", lambda: None)()

    return df.select(*passed, text).mapInArrow(work, spec)


#: Bits of a bitmap: 16 MB, whatever the data.
BITS = 1 << 27


def bitmap(keys: DataFrame, column: str):
    """Broadcast bitmap of a column's hashes: BITS bits, put together as 64-bit words by an aggregate, so
    at most BITS / 64 rows reach the driver. It never misses a key; of others it passes a share that
    grows with the number of keys."""
    at = keys.select(F.xxhash64(column).bitwiseAND(F.lit(BITS - 1)).alias("__at"))
    bit = F.expr("shiftleft(1L, cast(__at & 63 as int))")
    words = at.groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words["__word"].to_numpy(dtype=np.int64)] = words["__bits"].to_numpy(dtype=np.int64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def probable(df: DataFrame, column: str, bits, among: bool = True) -> DataFrame:
    """Rows of df whose key may be among the bitmap's (or, with among=False, is surely not): what a join
    needs to move, when most rows have no partner."""
    ship(df.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column("__hash").to_numpy() & (BITS - 1)
            inside = (bits.value[h >> 6] >> (h & 63)) & 1 == 1
            yield batch.filter(pa.array(inside == among))

    rows = df.withColumn("__hash", F.xxhash64(column))
    return rows.mapInArrow(work, rows.schema).drop("__hash")
