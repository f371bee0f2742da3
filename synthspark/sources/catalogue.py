"""Tables to work on, each with its metadata: demo tables of a catalogue, uploaded files, generated ground truth."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import metadata, sequence_columns, sequential_metadata
from .tables import POSITION, ground_truth, read_table

#: Bytes of an upload that go to the file system at a time.
CHUNK = 1 << 20
_LOCAL: dict[str, str] = {}


@dataclass
class DataSource:
    """A table, what is known of its columns, and a key that changes with its content."""

    df: DataFrame
    meta: dict | None
    file_key: str
    modality: str = "single_table"
    demo_name: str | None = None

    @property
    def type_label(self) -> str:
        return "longitudinal" if self.modality == "sequential" else "tabular"


def described(df: DataFrame, order: str | None = None) -> dict:
    """Column types, and sequence key and index where the table is longitudinal."""
    if not [c for c in df.columns if c != order]:
        return {"columns": {}}
    found = sequence_columns(df, order=order).first()
    if not found["is_longitudinal"]:
        return metadata(df, order)
    return sequential_metadata(df, found["seq_key"], found["seq_index"], order)["tables"]["data"]


def plain(meta: dict) -> dict:
    """The metadata of the same table without its sequences."""
    return {k: v for k, v in meta.items() if k not in ("sequence_key", "sequence_index")}


def write_catalogue(spark: SparkSession, folder: str, path: str) -> None:
    """Describe the Parquet tables of ``folder`` once and for all, as JSON lines at ``path``.

    (name, path, longitudinal, key, meta): one row a table; ``key`` changes when the
    table is written anew. Every table is read once here, and never to list it. A
    folder without tables gives a catalogue without rows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(folder, "*.parquet")
    fs = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    rows = []
    for status in fs.globStatus(pattern) or []:
        at, name = status.getPath(), status.getPath().getName().removesuffix(".parquet")
        content = f"{at}:{status.getModificationTime()}:{fs.getContentSummary(at).getLength()}"
        meta = described(read_table(spark, at.toString(), position=POSITION), POSITION)
        rows.append((name, at.toString(), "sequence_key" in meta, hashlib.sha256(content.encode()).hexdigest(), json.dumps(meta)))
    spark.createDataFrame(rows, _CATALOGUE).coalesce(1).write.mode("overwrite").json(path)


_CATALOGUE = "name string, path string, longitudinal boolean, key string, meta string"


def _entries(spark: SparkSession, catalogue: str, modality: str) -> DataFrame:
    known = {"single_table": F.lit(True), "sequential": F.col("longitudinal")}
    return spark.read.schema(_CATALOGUE).json(catalogue).where(known.get(modality, F.lit(False)))


def list_demos(spark: SparkSession, catalogue: str, modality: str) -> list[str]:
    """Names of the tables that can be taken as ``single_table`` (all) or ``sequential`` (the longitudinal ones); none for another modality."""
    return sorted(r["name"] for r in _entries(spark, catalogue, modality).select("name").collect())


def load_demo(spark: SparkSession, catalogue: str, name: str, modality: str = "single_table") -> DataSource:
    """A table of the catalogue with its metadata; ValueError where it is not listed under the modality."""
    found = _entries(spark, catalogue, modality).where(F.col("name") == name).first()
    if found is None:
        raise ValueError(f"no {modality} table {name} in {catalogue}")
    meta = json.loads(found["meta"])
    return DataSource(read_table(spark, found["path"]), meta if modality == "sequential" else plain(meta), found["key"], modality, name)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in local mode may go without it and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="uploads-"))


def load_upload(spark: SparkSession, name: str, data: bytes, modality: str = "single_table") -> DataSource:
    """An uploaded file: Parquet by the suffix of its name, else CSV.

    The bytes stand once in the shared folder, under their own digest, so the same
    content is written once however often it comes and the executors read it
    as any file. Empty data, or Parquet that is none, raise what Spark raises.
    """
    suffix = ".parquet" if name.endswith(".parquet") else ".csv"
    key = hashlib.sha256(data).hexdigest() + suffix
    path = f"{shared_folder(spark)}/uploads/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(target):
        out = fs.create(part)
        try:
            for i in range(0, len(data), CHUNK):
                out.write(bytearray(data[i : i + CHUNK]))
        finally:
            out.close()
        # Of two uploads at once one is renamed; the other's bytes are the same.
        if not fs.rename(part, target):
            fs.delete(part, False)
    table = read_table(spark, path, position=POSITION)
    meta = described(table, POSITION)
    return DataSource(table.drop(POSITION), meta if modality == "sequential" else plain(meta), key, modality)


def load_ground_truth(spark: SparkSession, n: int = 300, seed: int = 42) -> DataSource:
    """The generated longitudinal table with its sequence key and index."""
    df = ground_truth(spark, n, seed)
    return DataSource(df, sequential_metadata(df, "student_id", "jaar")["tables"]["data"], f"doorstroom-{n}-{seed}", "sequential", "doorstroom")
