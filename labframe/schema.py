"""Field sets, states and artifact schema."""

from pyspark.sql import types as T

NUMERIC_FIELDS = ["glucose", "hemoglobin", "hematocrit", "white_blood_cell_count", "platelet_count"]
DATE_FIELDS = ["date_of_birth", "collection_date", "received_date"]
TEXT_FIELDS = ["patient_name", "patient_id", "specimen_type"]
OPTIONAL_FIELDS = ["patient_sex"]
MANDATORY_FIELDS = sorted(NUMERIC_FIELDS + DATE_FIELDS + TEXT_FIELDS)
CRITICAL_FIELDS = NUMERIC_FIELDS + ["patient_name", "patient_id", "date_of_birth"]
DOCUMENT_STATUSES = [
    "UPLOADED", "PROCESSING", "AUTO_ACCEPTED", "REVIEW_REQUIRED", "REVIEW_IN_PROGRESS", "HUMAN_APPROVED", "HUMAN_REJECTED", "FAILED",
]
EXPORT_STATUSES = ["AUTO_ACCEPTED", "HUMAN_APPROVED"]
RETAINED_FINAL_STATUSES = ["AUTO_ACCEPTED", "HUMAN_APPROVED", "HUMAN_REJECTED", "FAILED"]
ATTENTION_STATES = ["EXTREME_VALUE", "FLAG_MISMATCH", "POSSIBLE_MISREAD"]
BLOCKING_STATES = ["MISSING", "INVALID_FORMAT", "IMPLAUSIBLE_VALUE"]
PAGE_CHECK_STATES = ["SOURCE_MISMATCH", "FLAG_MISMATCH", "POSSIBLE_MISREAD"]

WORD = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("line", T.IntegerType()),
])
PAGE = T.StructType([
    T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
    T.StructField("source_type", T.StringType()), T.StructField("ocr_used", T.BooleanType()), T.StructField("deskew_applied", T.BooleanType()),
    T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(WORD)),
])
ARTIFACT = T.StructType([
    T.StructField("schema_version", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("processing_job_id", T.StringType()),
    T.StructField("generated_at", T.StringType()), T.StructField("pages", T.ArrayType(PAGE)),
])
