"""Helpers shared by the corpus operators: reading, scratch tables, words, stable hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch
from ..workers import prepare as prepare_workers

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let workers import this package, and take texts in batches of 4 MB where the session has Spark's default of 64 MB.

    A batch has one row at least, so a text of any length passes; a cell is never cut.
    """
    prepare_workers(spark)
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, 4 << 20)



def vocabulary_file(path: str | None = None) -> str:
    """The vocabulary file to use; asked for where it is read, so each worker takes its own installed copy."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input size; used to choose partition counts only.

    Frames that aren't read from files have no estimate (Spark says 2**63 - 1); they count as 0.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 53 else 0


def partitions_for(df: DataFrame, target_bytes: int = 16 << 20) -> int:
    """Partitions of about target_bytes each, never fewer than spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, size_in_bytes(df) // target_bytes))


def split_residue(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo: the fold of a document."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def batches(table_iter, text_index: int, max_chars: int = 4_000_000):
    """Cut Arrow batches into slices of bounded text size; yields (slice, list of texts)."""
    for batch in table_iter:
        start, n, texts = 0, 0, []
        for i, text in enumerate(batch.column(text_index)):
            value = text.as_py() or ""
            texts.append(value)
            n += len(value)
            if n >= max_chars:
                yield batch.slice(start, i + 1 - start), texts
                start, n, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def byte_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


def quoted(names: list[str]) -> list[F.Column]:
    """Columns of these names, dots and backticks and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def by_position(df: DataFrame) -> DataFrame:
    """df with its columns named by position: names with dots don't pass mapInArrow. Give them back by toDF."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def append_in_arrow(df: DataFrame, made: list[T.StructField], compute: Callable[[Iterator], Iterator]) -> DataFrame:
    """df with the columns `made`, for which compute(batches) yields (batch, arrays); it replaces columns of these names."""
    names = [f.name for f in made]
    keep = [k for k, c in enumerate(df.columns) if c not in names]
    plain = by_position(df)

    def run(it):
        for part, arrays in compute(it):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *arrays], names=[*(f"c{k}" for k in keep), *names])

    found = plain.mapInArrow(run, T.StructType([*(plain.schema.fields[k] for k in keep), *made]))
    return found.toDF(*[df.columns[k] for k in keep], *names)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def hash_sample(rows: DataFrame, key: str, per_key: int) -> DataFrame:
    """At most per_key rows (doc_id, key) of each key, chosen by a hash of doc_id.

    Large keys are thinned by the hash to about twice what is wanted before rows are ranked, so no
    task ranks a whole hot key.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed(key, "_key")
    share = F.lit(float(2 * per_key)) / F.col("_n")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).where(draw < share).drop("_key", "_n")
    order = Window.partitionBy(key).orderBy(F.xxhash64("doc_id"), "doc_id")
    return thin.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_key).drop("_k")


BROADCAST_IDS = 1_000_000  # ids (8 MB) that may be broadcast; above that the join shuffles


def join_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join on doc_id; a list of ids that a count shows to be short is broadcast, else both sides shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", how)
