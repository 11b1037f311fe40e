"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, tab and the line controls 0x0A-0x0D. ``bytes.split()`` splits at exactly these.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
WORD_CLASS = r"[^ \t\n\x0B\f\r]"
_BLANKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="labframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/labframe-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_col(text: str = "text"):
    """array<string> of the words of a text column; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def split_words(text: str | None) -> list[bytes]:
    """The same words in Python, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def whole_runs(batches: Iterator[pd.DataFrame], names: list[str], handle: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Calls ``handle`` with frames that hold whole runs of equal ``names``; the batches are sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = (batch[names] == batch[names].iloc[-1]).all(axis=1).to_numpy()
        cut = len(same) - (len(same) if same.all() else int(np.argmin(same[::-1])))
        if cut or (held and not (held[-1][names].iloc[-1] == batch[names].iloc[-1]).all()):
            yield handle(pd.concat([*held, batch.iloc[:cut]]))
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield handle(pd.concat(held))
