"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker holds at a time.
SLICE_BYTES = 2_000_000
#: Keys of documents are broadcast up to so many (16 bytes each, about 100 in a hash table).
BROADCAST_IDS = 500_000
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in local mode, where one machine does all, may go without it
    and gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="shared-"))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_array(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space, without building them."""
    bare = F.coalesce(F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", ""), F.lit(""))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def root_bits(n: int, least: int = 6) -> int:
    """Bits of a hash that deal ``n`` rows into about sqrt(n) cells."""
    return max(least, (max(1, n).bit_length() + 1) // 2)


def with_lists(docs: DataFrame, lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents joined with their row of ``lists``, documents that have none).

    Up to ``BROADCAST_IDS`` keys are broadcast, so that the other texts are not shuffled.
    """
    ids = lists.select(*keys)
    if lists.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), keys, "left_semi").join(lists, keys), docs.join(F.broadcast(ids), keys, "left_anti")
    return docs.join(lists, keys), docs.join(ids, keys, "left_anti")


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES`` bytes of text, a document at least, so that memory does not hang on the batch size."""
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
