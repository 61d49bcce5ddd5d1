"""Stores behind one interface: a property graph kept as Parquet tables, relational databases, images, PDF pages, events."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import graph as G
from scriptorium.plans.scratch import stored

from .files import page_text


class GraphStore:
    """Nodes and edges by kind, each a Parquet table below ``path``; writes are idempotent upserts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, table: str, **equal: object) -> DataFrame:
        """Rows of a table whose columns have the values given."""
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        for column, value in equal.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def write(self, table: str, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Upsert by the keys: the batch's rows replace stored ones; the same batch twice changes nothing."""
        batch = batch.dropDuplicates(list(keys))
        merged = G.merge_edges(self.read(table).select(*batch.columns), batch, keys) if self._exists(table) else batch
        stored(merged, "graph_batch").write.mode("overwrite").parquet(f"{self.path}/{table}")  # read whole before it is replaced
        return self.read(table)


def read_relational(spark: SparkSession, url: str, sql: str, *, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query's rows from a database; ``partition`` (column, low, high, n) reads in n ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({sql}) q", **options)
    if partition is not None:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.load()


def read_images(spark: SparkSession, path: str, least_bytes: int = 1024) -> DataFrame:
    """(path, length, content) of image files of at least so many bytes, below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp,tif,tiff}").load(path)
    return files.where(F.col("length") >= least_bytes).select("path", "length", "content")


def read_pdf_pages(files: DataFrame, load: Callable[[], Callable[[bytes], list[tuple[str, str]]]]) -> DataFrame:
    """(path, page, text, error) from (path, content): ``load`` gives a reader of (text layer, recognised text) pages, called per file in Arrow batches.

    A page takes its text layer where that is nearly as long as what was
    recognised.  A file that its reader cannot read is one row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = load()
        schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("layer", pa.string()), ("seen", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"path": path, "page": i, "layer": layer, "seen": seen} for i, (layer, seen) in enumerate(reader(content), 1)]
                except Exception as e:  # noqa: BLE001  a file's fault is its row's
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:500]})
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    pages = files.select("path", "content").mapInArrow(run, "path string, page int, layer string, seen string, error string")
    return pages.select("path", "page", page_text(F.col("layer"), F.col("seen")).alias("text"), "error")


def publish(events: DataFrame, path: str) -> None:
    """Append events (any columns) as JSON lines to a folder that a stream may watch."""
    events.write.mode("append").json(path)
