"""What is written for a document, as Column expressions; ``sources.sinks`` writes it to named files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import csv_field, file_name, format_epoch, json_text

# The header of the CSV form.
CSV_HEADER = "file_name,source_path,model_id,duration_sec,text"


def json_document(task_id: Column, path: Column, model: Column, duration: Column, pages: Column, completed_at: Column, text: Column) -> Column:
    return json_text(
        F.struct(
            task_id.cast("string").alias("task_id"), file_name(path).alias("file_name"), path.alias("source_path"), model.alias("model_id"),
            F.round(duration, 3).alias("duration_sec"), pages.alias("page_count"), format_epoch(completed_at).alias("timestamp"), F.coalesce(text, F.lit("")).alias("text"),
        )
    )


def markdown_document(path: Column, model: Column, duration: Column, pages: Column, text: Column) -> Column:
    return F.concat(
        F.lit("# OCR Output: "), file_name(path), F.lit("\n\n- **Source**: `"), path, F.lit("`\n- **Model**: `"), model, F.lit("`\n- **Pages**: "), pages.cast("string"),
        F.lit("\n- **Processing Time**: "), F.format_string("%.2f", duration), F.lit("s\n\n---\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"),
    )


def csv_document(path: Column, model: Column, duration: Column, text: Column) -> Column:
    row = F.concat_ws(",", csv_field(file_name(path)), csv_field(path), csv_field(model), F.format_string("%.3f", duration), csv_field(F.coalesce(text, F.lit(""))))
    return F.concat(F.lit(CSV_HEADER + "\r\n"), row, F.lit("\r\n"))


def text_document(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))


def rendered(fmt: Column, task_id: Column, path: Column, model: Column, duration: Column, pages: Column, completed_at: Column, text: Column) -> Column:
    """The document in any output format; one that isn't known is plain text."""
    return (
        F.when(fmt == "json", json_document(task_id, path, model, duration, pages, completed_at, text))
        .when(fmt.isin("markdown", "md"), markdown_document(path, model, duration, pages, text))
        .when(fmt == "csv", csv_document(path, model, duration, text))
        .otherwise(text_document(text))
    )
