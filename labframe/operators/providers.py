"""Extractors behind one protocol: pages in, rows of fields or of errors out.

An extractor takes a DataFrame of pages (``by``, page_num, text) and gives rows of FIELDS: one per field, or one per document
with error_type and error. The rule-based one is Spark all through. A remote one sends one prompt per document through a plain
function, in batches inside tasks, and checks each answer against the schema; what doesn't fit is a permanent error, a refused
request too, all else may be tried again. ``with_fallback`` of the lifecycle puts the rules' rows in the place of failures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe import schema
from labframe.operators import extract as E
from labframe.operators import lifecycle as M
from labframe.sources.files import stored
from labframe.streaming.streams import folder

FIELDS = ["field_name", "value", "unit", "reference_range", "abnormal_flag", "confidence", "page_num"]
ANSWER = "array<struct<field_name:string,value:string,unit:string,reference_range:string,abnormal_flag:string,confidence:double,page_num:int>>"
# Statuses of a refused request.
REFUSED = [400, 401, 403]

#: Answers of a provider: prompts to pairs of a status (200: fine) and a text.
Ask = Callable[[list[str]], list[tuple[int, str]]]


def prompts(pages: DataFrame, by: str) -> DataFrame:
    """by, prompt: what is wanted, then the pages in their order. A document's text is one string, as its provider takes it."""
    names = ", ".join(schema.MANDATORY_FIELDS + schema.OPTIONAL_FIELDS)
    task = f"Read these fields off the report: {names}. Give each as printed, with unit, reference range and flag where they stand; leave out what is not there."
    one = F.sort_array(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(by).agg(one.alias("p")).select(by, F.concat_ws("\n", F.lit(task), F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("prompt"))


def answers(asked: DataFrame, by: str, ask: Ask) -> DataFrame:
    """by, status, answer. A batch whose request breaks off counts as status 0 for each of its documents."""
    kind = dict(asked.dtypes)[by]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                got = ask(frame["prompt"].tolist())
            except Exception as e:  # noqa: BLE001  the connection, not the document, is at fault
                got = [(0, str(e))] * len(frame)
            yield pd.DataFrame({by: frame[by], "status": [s for s, _ in got], "answer": [a for _, a in got]})

    return asked.select(by, "prompt").mapInPandas(batches, f"{by} {kind}, status int, answer string")


def checked(answered: DataFrame, by: str) -> DataFrame:
    """FIELDS, error_type and error. ``answered``: by, status, answer.

    Refused requests are PermanentProviderError, other failures RetryableProviderError; answers that are no list of known fields
    with a confidence from 0 to 100 are a SchemaError. An empty list is an answer: the document shows nothing.
    """
    rows = answered.withColumn("fields", F.from_json("answer", ANSWER, {"mode": "PERMISSIVE"}))
    known = F.array(*[F.lit(f) for f in schema.MANDATORY_FIELDS + schema.OPTIONAL_FIELDS])
    good = F.forall("fields", lambda f: F.coalesce(F.array_contains(known, f["field_name"]) & f["confidence"].between(0, 100), F.lit(False)))
    wrong = F.col("fields").isNull() | ~good | ~F.coalesce(F.trim("answer").startswith("["), F.lit(False))
    kind = F.when(F.col("status").isin(REFUSED), "PermanentProviderError").when(~F.col("status").eqNullSafe(200), "RetryableProviderError").when(wrong, "SchemaError")
    error = F.when(kind == "SchemaError", "answer does not fit the schema").when(kind.isNotNull(), F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown"))))
    rows = rows.withColumns({"error_type": kind, "error": error}).withColumn("fields", F.when(F.col("error_type").isNull(), F.col("fields")))
    return rows.select(by, "error_type", "error", F.explode_outer("fields").alias("f")).select(by, *[F.col(f"f.{c}").alias(c) for c in FIELDS], "error_type", "error")


def rule_based(pages: DataFrame, by: str, confidence: float = 99.0) -> DataFrame:
    """The rules' rows; they make no errors."""
    found = E.extract_fields(pages, by).withColumnsRenamed({"ref": "reference_range", "flag": "abnormal_flag"}).withColumn("confidence", F.lit(confidence))
    none = F.lit(None).cast("string")
    return found.select(by, *FIELDS, none.alias("error_type"), none.alias("error"))


def remote(ask: Ask) -> Callable[[DataFrame, str], DataFrame]:
    return lambda pages, by: checked(answers(prompts(pages, by), by, ask), by)


def extractor(provider: str, ask: Ask | None = None, consent: bool = False) -> Callable[[DataFrame, str], DataFrame]:
    """The extractor of a name. A remote one needs a way to ask and the consent that documents leave."""
    if provider == "rule_based":
        return rule_based
    if ask is None:
        raise ValueError(f"no provider {provider!r} is set up")
    if not consent:
        raise ValueError("documents may not go to an external provider without consent")
    return remote(ask)


def extract(pages: DataFrame, by: str, primary: Callable[[DataFrame, str], DataFrame], fallback: bool = True) -> DataFrame:
    """FIELDS, extractor, fallback_reason: the primary extractor's fields, and the rules' for documents it failed on. The rules read
    the pages of these documents only; the primary's rows are stored, so that an extractor is asked once."""
    own = primary(pages, by).withColumn("error", F.col("error_type")).drop("error_type")
    if not fallback:
        return own.filter("error IS NULL").drop("error")
    own = stored(own, folder(pages.sparkSession, "extracted"))
    failed = pages.join(own.filter("error IS NOT NULL").select(by).distinct(), by, "left_semi")
    return M.with_fallback(own, rule_based(failed, by).drop("error", "error_type"), by)
