"""Substring dedup by a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. Its fingerprint is the least hash of the ``GRAM``-word stretches inside it, so equal
windows have equal fingerprints and neighbouring windows mostly share one: about a fifth as many postings as words.

The index is a list of immutable runs, tables of (fp, doc_id) bucketed and sorted by fp. A new batch is written as a run of
tier 0 and merge-joined with every run before it, bucket by bucket, without moving them. Postings whose fingerprint stands in
two documents are noted. Noted postings only say where to look: they are verified on the texts before the batch counts as
indexed. Windows under a noted fingerprint are compared by 128 bits, made from two independent hashes of each of their words,
and a window is a repeat if a document with a smaller doc_id holds it too. Then a tier that holds ``FAN_IN`` runs is compacted
into one run of the next tier, so a posting is rewritten once a tier, and n batches leave about log(n) runs to join with.

The runs of an index without a name lie in the shared folder of the session; an index that was given a name stays in the
warehouse and can be opened again for later batches. A merged run is complete before the runs it replaces go; if a job dies
between, both stand, and postings that stand twice change nothing.

Documents whose whole text stands in a document with a smaller doc_id are set aside before: all their windows repeat.

Cases: null and blank texts have no words; texts under ``WINDOW`` words have no windows and stay whole. Rows with a null
doc_id stay whole and remove nothing. Rows with equal doc_id don't remove each other's words. Long texts are read whole.
Empty tables give empty results. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe.llm.common import materialize, remove_path, scratch_path, split_words
from labframe.llm.lines import _runs

WINDOW = 13
GRAM = 5
#: Runs of one tier that are merged into a run of the next.
FAN_IN = 2
#: Copies of whole texts, or ids of documents to verify, 16 bytes each: up to so many are sent to all executors; more are
#: joined by shuffle.
BROADCAST_COPIES = 500_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Hashes of all stretches of ``size`` words from the words' hashes: a polynomial, made by doubling, then a finaliser."""
    with np.errstate(over="ignore"):
        g, done, part, span = None, 0, h, 1
        while True:
            if size & span:
                n = len(h) - done - span + 1
                g = part if g is None else g[:n] * factor + part[done : done + n]
                done += span
            if done == size:
                break
            part = part[:-span] * factor + part[span:]
            factor, span = factor * factor, 2 * span
        g = (g ^ (g >> np.uint64(30))) * _B
        return g ^ (g >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Two rows of 64-bit hashes: the halves of each word's 128-bit hash."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2).T


def _fingerprints(h: np.ndarray) -> np.ndarray:
    """The fingerprint of every window of a text."""
    g, done, size = _grams(h[0], GRAM, _A), 1, WINDOW - GRAM + 1
    while done < size:
        step = min(done, size - done)
        g, done = np.minimum(g[:-step], g[step:]), done + step
    return g


def _first_of_runs(fps: np.ndarray) -> np.ndarray:
    """Where a fingerprint differs from the one before: neighbours mostly share theirs."""
    return np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1])))


def _window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _grams(h[0], WINDOW, _A), _grams(h[1], WINDOW, _B)


def postings(docs: DataFrame) -> DataFrame:
    """fp, doc_id: the different fingerprints of each document's windows."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, ids, held = [], [], 0
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                words = split_words(text)
                if len(words) >= WINDOW:
                    fp = _fingerprints(_word_hashes(words))
                    fp = np.unique(fp[_first_of_runs(fp)])
                    fps.append(fp)
                    ids.append(np.full(len(fp), doc_id, np.int64))
                    held += len(fp)
                if held > 500_000:
                    yield pd.DataFrame({"fp": np.concatenate(fps).view(np.int64), "doc_id": np.concatenate(ids)})
                    fps, ids, held = [], [], 0
            if fps:
                yield pd.DataFrame({"fp": np.concatenate(fps).view(np.int64), "doc_id": np.concatenate(ids)})

    return docs.select("doc_id", "text").mapInPandas(emit, "fp long, doc_id long")


class FingerprintIndex:
    """Runs of postings. ``add`` takes one batch and gives the postings, old and new, to be verified."""

    def __init__(self, spark: SparkSession, name: str | None = None, fan_in: int = FAN_IN):
        """``name`` opens the index of this name, or begins it. Its number of buckets stays what it was at the beginning."""
        self.spark, self.fan_in = spark, fan_in
        self.name = f"labframe_fp_{name or uuid.uuid4().hex}"
        self.folder = None if name else scratch_path(spark, "runs")
        found = [t.name for t in spark.catalog.listTables(pattern=f"{self.name}_run*")]
        self.runs = sorted(found, key=self._number)
        self.written = self._number(self.runs[-1]) + 1 if found else 0
        self.buckets = self._buckets_of(self.runs[0]) if found else int(spark.conf.get("spark.sql.shuffle.partitions"))

    @staticmethod
    def _number(table: str) -> int:
        return int(table.split("_")[-3])

    @staticmethod
    def _tier(table: str) -> int:
        return int(table.split("_")[-2])

    def _buckets_of(self, table: str) -> int:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
        return int(rows[0]["data_type"])

    def _write_run(self, rows: DataFrame, tier: int) -> str:
        # The last part of the name keeps clear of what a job that died has left under the same number.
        table = f"{self.name}_run_{self.written}_{tier}_{uuid.uuid4().hex[:8]}"
        self.written += 1
        writer = rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp")
        if self.folder:
            writer = writer.option("path", f"{self.folder}/{table}")
        writer.saveAsTable(table)
        return table

    def _drop_run(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if self.folder:
            remove_path(self.spark, f"{self.folder}/{table}")

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, fp of all postings whose fingerprint the batch shares with a run before it or within itself."""
        table = self._write_run(postings(docs), 0)
        new = self.spark.table(table)
        fps = new.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        found = new.join(fps.filter("lo <> hi").select("fp"), "fp", "left_semi")
        for run in self.runs:
            old = self.spark.table(run)
            found = found.unionByName(new.join(old.select("fp").distinct(), "fp", "left_semi"))
            found = found.unionByName(old.join(fps.select("fp"), "fp", "left_semi"))
        self.runs.append(table)
        return found.select("doc_id", "fp")

    def compact(self) -> None:
        """Merge the runs of each tier that holds ``fan_in`` of them. Readers of these runs must be done."""
        tier = 0
        while tier <= max(map(self._tier, self.runs), default=-1):
            full = [run for run in self.runs if self._tier(run) == tier]
            if len(full) >= self.fan_in:
                rows = self.spark.table(full[0])
                for run in full[1:]:
                    rows = rows.unionByName(self.spark.table(run))
                merged = self._write_run(rows, tier + 1)
                for run in full:
                    self._drop_run(run)
                self.runs = [run for run in self.runs if run not in full] + [merged]
            tier += 1

    def drop(self) -> None:
        for run in self.runs:
            self._drop_run(run)
        self.runs = []


def text_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key of the documents whose whole text a document with a smaller doc_id has; stored."""
    own = docs.filter("doc_id is not null and text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"), F.xxhash64("text").alias("text_key"))
    own = materialize(own, "texts")
    # Stored, so that the join reads two plain exchanges and Spark can split a text that very many documents share.
    first = materialize(own.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    return materialize(own.join(first, "h").filter("doc_id > first").select("doc_id", "text_key").distinct(), "copies")


def _with_copies(docs: DataFrame, copies: DataFrame, how: str) -> DataFrame:
    small = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    side = copies.select("doc_id", "text_key", F.lit(True).alias("is_copy")) if how == "left" else copies
    return docs.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(side) if small else side, ["doc_id", "text_key"], how).drop("text_key")


def _noted_windows(docs: DataFrame, noted: DataFrame, since: int | None = None) -> DataFrame:
    """key, h1, h2, doc_id, done: the windows under noted fingerprints, each once per document.

    Of the documents of one Arrow batch that hold a window, only the first is still open; the others are done, and get a key
    of their own, so a window that stands everywhere gives one open row per batch. Done ones below ``since`` are left out.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc_id, text, fps in zip(batch.doc_id, batch.text, batch.fps, strict=True):
                words = split_words(text)
                if len(words) < WINDOW:
                    continue
                h = _word_hashes(words)
                fp = _fingerprints(h)
                runs = _first_of_runs(fp)
                at = np.repeat(np.isin(fp[runs], np.asarray(fps, dtype=np.int64).view(np.uint64)), np.diff(np.append(runs, len(fp))))
                if not at.any():
                    continue
                h1, h2 = _window_hashes(h)
                h1, first = np.unique(h1[at], return_index=True)
                parts.append((h1, h2[at][first], np.full(len(h1), doc_id, np.int64)))
            if not parts:
                continue
            parts.sort(key=lambda part: part[2][0])
            h1, h2, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h1, kind="stable")
            h1, h2, ids = h1[order], h2[order], ids[order]
            same = np.concatenate(([False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])))
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
            done = ids > ids[start]
            with np.errstate(over="ignore"):
                key = np.where(done, _mixed(h1, ids), h1)
            keep = (done | ~same) if since is None else (~done & ~same) | (done & (ids >= since))
            for lo in range(0, len(ids), 500_000):
                k = slice(lo, lo + 500_000)
                some = keep[k]
                yield pd.DataFrame({
                    "key": key[k][some].view(np.int64), "h1": h1[k][some].view(np.int64), "h2": h2[k][some].view(np.int64),
                    "doc_id": ids[k][some], "done": done[k][some],
                })

    lists = noted.groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
    ids = noted.select("doc_id").distinct()
    if ids.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    joined = docs.join(lists, "doc_id")
    return joined.select("doc_id", "text", "fps").mapInPandas(emit, "key long, h1 long, h2 long, doc_id long, done boolean")


def _mixed(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (h ^ (ids.view(np.uint64) * _A)) * _B


def repeated_windows(docs: DataFrame, noted: DataFrame, since: int | None = None) -> DataFrame:
    """doc_id, h1 of the windows that a document with a smaller doc_id holds too, for documents from ``since`` on."""

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        open_ = frame[~frame.done.to_numpy(dtype=bool)]
        again = open_.doc_id > open_.groupby(["h1", "h2"], sort=False).doc_id.transform("min")
        if since is not None:
            again &= open_.doc_id >= since
        return pd.concat([frame[frame.done.to_numpy(dtype=bool)], open_[again.to_numpy(dtype=bool)]])[["doc_id", "h1"]]

    rows = _noted_windows(docs, noted, since).repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(lambda batches: _runs(batches, resolve), "doc_id long, h1 long")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def cut_texts(docs: DataFrame, copies: DataFrame, repeats: DataFrame, with_text: bool = False) -> DataFrame:
    """RESULT for every row. ``repeats`` has doc_id, h1."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, is_copy, hs in zip(batch.doc_id, batch.text, batch.is_copy, batch.hs, strict=True):
                words = split_words(text)
                kept = words
                if len(words) >= WINDOW and is_copy is True:
                    kept = []
                elif len(words) >= WINDOW and hs is not None:
                    at = np.isin(_grams(_word_hashes(words)[0], WINDOW, _A), np.asarray(hs, dtype=np.int64).view(np.uint64))
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[: len(at)] += at
                    edge[WINDOW:] -= at
                    kept = [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if not n]
                data = b" ".join(kept)
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(),
                             data.decode("utf-8", "surrogatepass") if with_text else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    marked = _with_copies(docs.select("doc_id", "text"), copies, "left")
    lists = repeats.groupBy("doc_id").agg(F.collect_list("h1").alias("hs"))
    return marked.join(lists, "doc_id", "left").select("doc_id", "text", "is_copy", "hs").mapInPandas(cut, RESULT)


def add_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame, more: bool = True, since: int | None = None) -> DataFrame:
    """doc_id, h1 of the repeated windows among the documents of a batch and those that share fingerprints with it; stored.

    ``history`` has the texts (doc_id, text) of the batch and of all batches before; those without a noted fingerprint are
    left out before anything is moved or hashed. The batch is indexed, verified on the texts, and only then full tiers are
    compacted, unless no ``more`` batches follow. Batches may come in any order of doc_id; where they rise, ``since`` is the
    least doc_id of the batch, and repeats in earlier documents, all of them known, are not given again.
    """
    noted = materialize(index.add(batch), "noted")
    repeats = materialize(repeated_windows(history, noted, since), "repeats")
    if more:
        index.compact()
    return repeats


def dedup_documents(docs: DataFrame, batches: int = 4, with_text: bool = False) -> DataFrame:
    """RESULT for every row of ``docs`` (doc_id, text), indexed in ``batches`` batches in the order of doc_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    copies = text_copies(docs)
    firsts = _with_copies(docs.filter("doc_id is not null"), copies, "left_anti")
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    index, repeats = FingerprintIndex(spark), None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        history = firsts if hi is None else firsts.filter(F.col("doc_id") < hi)
        batch = history if lo is None else history.filter(F.col("doc_id") >= lo)
        found = add_batch(index, batch, history, more=hi is not None, since=lo)
        repeats = found if repeats is None else repeats.unionByName(found)
    index.drop()
    return cut_texts(docs, copies, repeats, with_text)
