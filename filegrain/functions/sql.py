"""The library's functions under SQL names. Scalar ones become SQL functions, which Catalyst inlines; none runs Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import native

#: Name -> parameters, and the function.
SCALARS = {
    "sniff": ("content BINARY", native.sniff),
    "type_label": ("kind STRING", native.type_label),
    "category_of": ("kind STRING", native.category_of),
    "mime_category": ("mime STRING", native.mime_category),
    "mime_mismatch": ("kind STRING, mime STRING", native.mime_mismatch),
    "pdf_date": ("s STRING", native.pdf_date),
    "iso6709": ("s STRING", native.iso6709),
    "mac_date": ("seconds BIGINT", native.mac_date),
    "size_text": ("n BIGINT", native.size_text),
    "duration_text": ("seconds DOUBLE", native.duration_text),
    "escape_html": ("s STRING", native.escape_html),
    "base_name": ("name STRING", native.base_name),
}
ROWS = "section_id string, section_title string, k string, v string, s boolean"
OF_FILES = f"file_id string, {ROWS}"


def _rows(content: bytes | None) -> list[dict]:
    from ..operators.extraction import analyse

    return [{"section_id": x["id"], "section_title": x["title"], **{c: r[c] for c in ("k", "v", "s")}} for x in analyse(content or b"", {})["sections"] for r in x["rows"]]


class ExtractMetadata:
    """extract_metadata(content), in a LATERAL join: a row for each row of the file's report. Spark has no Arrow form there."""

    def eval(self, content):
        for r in _rows(content):
            yield tuple(r.values())


class ExtractFiles:
    """extract_files(TABLE(SELECT file_id, content ...)): the same for a table of files, in Arrow batches."""

    def eval(self, batch):
        schema = pa.schema([(c, pa.string()) for c in ("file_id", "section_id", "section_title", "k", "v")] + [("s", pa.bool_())])
        for name, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield pa.Table.from_pylist([{"file_id": name, **r} for r in _rows(content)], schema=schema)


def register(spark: SparkSession) -> list[str]:
    """Define the functions for this session; returns their names."""
    for name, (parameters, f) in SCALARS.items():
        names = [p.split()[0] for p in parameters.split(", ")]
        schema = ", ".join(parameters.split(", "))
        made = spark.createDataFrame([], schema).select(f(*map(F.col, names)).alias("out"))
        kind = made.schema["out"].dataType.simpleString()
        body = made._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
        for n in names:  # attributes are printed as names, in backquotes where a parser needs them
            body = body.replace(f"`{n}`", n)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("extract_metadata", F.udtf(ExtractMetadata, returnType=ROWS))
    spark.udtf.register("extract_files", F.arrow_udtf(ExtractFiles, returnType=OF_FILES))
    return [*SCALARS, "extract_metadata", "extract_files"]
