"""Importance resampling towards a target distribution by hashed word n-grams.

A feature is a run of one to ``most`` consecutive words; its bucket is the CRC-32 of its bytes modulo the number of buckets.
Bucket counts over all documents and over all target texts give each bucket a gain, the logarithm of its share in the target
over its share in the documents. A document's weight is the mean gain of its features; with one Gumbel draw by document id the
highest scores are a sample without replacement, and the same one in every run.

Features are found batch by batch: the texts are joined with a sentinel between them, one pass of a regular expression finds
all words and sentinels, a search among the sentinels' places names the document of each word and masks n-grams that reach
across documents, and counts come from one bincount. An n-gram's CRC comes from the CRC of its front and of its last word by a
linear step that depends on the last word's length only, so no n-gram is ever written out.

Texts are read twice, once for the counts and once for the weights, and never shuffled. What is shuffled are bucket counts, at
most one row per task and bucket, and for the ranks the ids with their scores. The driver gets the counts of the buckets, whose
number is a parameter.

Cases: null and empty texts, and texts without words, have no features, weight 0 and take no part in the draw if ``min_words``
is above 0. A null id counts as an empty one in the draw. Ties of score go to the smaller id, null ids first; rows equal in both
are ranked in some order. Repeated rows count and are drawn as often as they stand there. Empty documents give an empty result,
an empty target gains from zero counts. Extra columns, whatever their names, are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize
from labframe.llm.sharding import number_rows
from labframe.llm.stretches import slices, sums

BUCKETS = 10_000
MOST_WORDS = 2
MIN_WORDS = 20
SHARE_PERCENT = 25
SEED = 7
SLICE_BYTES = 4_000_000
#: The sentinel between texts; in texts it becomes another character that is in no word.
SENTINEL = b"\x00"
#: Digits, lower-case letters and all that is not ASCII, or a sentinel.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
#: A-Z to lower case, sentinels to spaces, other bytes as they are.
_LOWER = bytes.maketrans(SENTINEL + bytes(range(65, 91)), b" " + bytes(range(97, 123)))
#: Words up to this length have tables for the linear step; longer ones are rare and take it one by one.
TABLED = 64
_STEPS: list[np.ndarray] = []


def _step_tables() -> np.ndarray:
    """For each length n and byte k of a CRC: what that byte's values add to the CRC of the front when n bytes follow.

    crc(front + word) is crc(word) xor a linear function of crc(front); the function is the difference that the front makes on
    n zero bytes.
    """
    if not _STEPS:
        zeros = [bytes(n) for n in range(TABLED)]
        _STEPS.append(np.array([[[zlib.crc32(z, v << 8 * k) ^ zlib.crc32(z) for v in range(256)] for k in range(4)] for z in zeros], np.uint32))
    return _STEPS[0]


def _behind(front: np.ndarray, crc: np.ndarray, length: np.ndarray, words: list[bytes]) -> np.ndarray:
    """CRCs of front + word, from the CRCs of both."""
    tables, n = _step_tables(), np.minimum(length, TABLED - 1)
    out = crc ^ tables[n, 0, front & 255] ^ tables[n, 1, front >> 8 & 255] ^ tables[n, 2, front >> 16 & 255] ^ tables[n, 3, front >> 24]
    for i in np.flatnonzero(length >= TABLED).tolist():
        out[i] = zlib.crc32(words[i], int(front[i]))
    return out


def features(texts: pa.Array, most: int = MOST_WORDS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For one word, two words and so on: the CRCs of the runs of so many words, text by text, and how many each text has."""
    data = SENTINEL.join(t.encode().translate(_LOWER) for t in texts.to_pylist())
    words = WORD.findall(data)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    edges = np.flatnonzero((crc == zlib.crc32(SENTINEL)) & (length == 1))  # no word of one byte has this CRC: the step is invertible
    text_of = np.searchsorted(edges, np.arange(len(words)))
    inside = np.ones(len(words), bool)
    inside[edges] = False
    found, many, front, at = [], [], crc, np.arange(len(words))
    for n in range(1, most + 1):
        if n > 1:
            at = at[:-1]
            space = np.full(len(at), zlib.crc32(b" "), np.uint32)
            last = at + n - 1
            front = _behind(_behind(front[:-1], space, np.ones(len(at), np.int64), []), crc[last], length[last], words[n - 1 :])
        whole = inside[at] & inside[at + n - 1] & (text_of[at] == text_of[at + n - 1])
        found.append(front[whole])
        many.append(np.bincount(text_of[at][whole], minlength=len(texts)))
    return found, many


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """bucket, n: how many features of all texts fall into it. Buckets without any are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in slices(batch.column(0), SLICE_BYTES):
                for crc in features(some, most)[0]:
                    total += np.bincount(crc % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: dict[int, int], source: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share in the target over that in the source, one added to each count."""
    t_all, s_all = float(sum(target.values()) + buckets), float(sum(source.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""
    buckets = len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(batch.column(1), SLICE_BYTES):
                crcs, many = features(some, most)
                total = np.zeros(len(some), np.int64)
                for crc, n in zip(crcs, many, strict=True):
                    total += sums(gain[crc % buckets], np.append(0, np.cumsum(n)))
                n = sum(many)
                columns = [pa.array(x.astype(np.int64)) for x in (many[0], n, np.floor_divide(total, np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)).cast(pa.int64()), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS, min_words: int = MIN_WORDS, share_percent: int = SHARE_PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null if not drawn) of every document of ``docs``.

    ``docs`` has doc_id and text, ``target`` has text. Of the documents with ``min_words`` or more, ``share_percent`` are drawn.
    """
    of_target, of_docs = ({r["bucket"]: r["n"] for r in bucket_counts(x, "text", buckets, most).collect()} for x in (target, docs))
    weighed = weigh(docs, gains(of_target, of_docs, buckets), most)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    out = F.when(F.col("n_words") >= min_words, 0).otherwise(1)
    scored = weighed.withColumn("score", (F.col("weight") + draw).cast("long")).withColumn("_out", out)
    # The row's number spreads rows that are equal in all else; it must not change between sampling and sorting.
    stored = materialize(scored, "scores").withColumn("_low", -F.col("score")).withColumn("_row", F.monotonically_increasing_id())
    numbered, _ = number_rows(stored, ["_out", "_low", "doc_id", "_row"])
    drawn = stored.filter("_out = 0").count() * share_percent // 100
    rank = F.when(F.col("row") < drawn, F.col("row") + 1)
    return numbered.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))
