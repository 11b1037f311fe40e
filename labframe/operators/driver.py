"""The document driver as a table function: from the bytes of an upload to its pages, or to one row that says why not.

``analyze_document(document_id, content, page_cap)`` can be used in SQL with LATERAL. An upload that can't be read gives a row
with error_type, error and the step at which it failed, so a bad upload never fails the job; ``split_quarantine`` parts these
from the pages. A text page holds enough text to be read as it is; other pages, and images, are left to an OCR step.

Uploads are text containers: the first bytes tell the type, a form feed ends a page, as tools that print a document's text layer
write them. Decoding of real PDFs and scans is left to a plug-in.

Cases: null content is of an unsupported type. A container without any page text has one empty page. Pages keep their order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_CAP = 50
NATIVE_TEXT_CHARS = 20
# First bytes of the types that are taken.
MAGIC = {"application/pdf": b"%PDF", "image/png": b"\x89PNG\r\n\x1a\n", "image/jpeg": b"\xff\xd8\xff"}
#: A container that has this in its head wants a password.
LOCKED = b"/Encrypt"
HEAD_BYTES = 1024
RESULT = "document_id string, page_num int, source string, text string, error_type string, error string, step string"


class Refused(Exception):
    """Why an upload is quarantined: error type, message and step."""


def pages_of(content: bytes | None, page_cap: int) -> Iterator[tuple[int, str, str | None]]:
    """page_num, source, text."""
    kind = next((k for k, magic in MAGIC.items() if (content or b"").startswith(magic)), None)
    if kind is None:
        raise Refused("UnsupportedType", "Unsupported mime_type", "sniff")
    if kind != "application/pdf":
        yield 1, "OCR", None
        return
    head, _, body = content.partition(b"\n")
    if LOCKED in content[:HEAD_BYTES]:
        raise Refused("PasswordProtected", "PDF is password protected", "open")
    try:
        pages = body.decode("utf-8").removesuffix("\f").split("\f")
    except UnicodeDecodeError as e:
        raise Refused("Unreadable", f"Could not open PDF: {e.reason}", "open") from e
    if len(pages) > page_cap:
        raise Refused("TooManyPages", f"PDF has {len(pages)} pages; the maximum is {page_cap}", "count")
    for number, text in enumerate(pages, 1):
        native = len(text.strip()) > NATIVE_TEXT_CHARS
        yield number, "PDF_NATIVE" if native else "OCR", text if native else None


class AnalyzeDocument:
    def eval(self, document_id: str, content: bytes, page_cap: int):
        try:
            # All pages are read before any is given: a document is taken whole or not at all.
            for number, source, text in list(pages_of(content, page_cap if page_cap is not None else PAGE_CAP)):
                yield document_id, number, source, text, None, None, None
        except Refused as e:
            yield (document_id, None, None, None, *e.args)
        except Exception as e:  # noqa: BLE001  whatever a decoder does wrong concerns its document only
            yield document_id, None, None, None, type(e).__name__, str(e), "read"


def register(spark: SparkSession, name: str = "analyze_document") -> None:
    spark.udtf.register(name, F.udtf(AnalyzeDocument, returnType=RESULT))


def analyze(uploads: DataFrame, page_cap: int = PAGE_CAP) -> DataFrame:
    """Rows of RESULT for ``uploads`` (document_id, content)."""
    register(uploads.sparkSession)
    own = uploads.select(F.col("document_id").cast("string").alias("document_id"), "content")
    return uploads.sparkSession.sql(f"SELECT a.* FROM {{u}} u, LATERAL analyze_document(u.document_id, u.content, {int(page_cap)}) a", u=own)


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages, and one row (document_id, error_type, error, step) for each document that has none."""
    return rows.filter("error_type IS NULL").select("document_id", "page_num", "source", "text"), rows.filter("error_type IS NOT NULL").select("document_id", "error_type", "error", "step")
