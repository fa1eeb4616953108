"""Text, path, time and format functions as Column expressions: all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_recognised(text: Column) -> Column:
    """Coordinates such as ``(4,22),(996,121)`` become a space; blanks and empty lines are squeezed; the ends are stripped."""
    boxes = F.regexp_replace(text, r"(?U)(?:\(\d{1,4},\s*\d{1,4}\),?\s*)+", " ")
    return strip(F.regexp_replace(F.regexp_replace(boxes, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def preview(text: Column, limit: int = 150) -> Column:
    """The first ``limit`` characters with an ellipsis if there are more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def normalised_key(name: Column) -> Column:
    """Lower case without hyphens, underscores and spaces."""
    return F.translate(F.lower(name), "-_ ", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot; empty for ``.pdf``, ``name`` and ``name.``."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def path_order(path: Column) -> Column:
    """A sort key by path components: /d/a/x comes before /d/a-b/x."""
    return F.split(path, "/")


def format_extension(output_format: Column) -> Column:
    """File extension of an output format."""
    fmt = strip(F.lower(output_format))
    return F.when(fmt.isin("markdown", "md"), "md").otherwise(fmt)


def output_name(path: Column, output_format: Column) -> Column:
    return F.concat(stem(path), F.lit("_ocr."), format_extension(output_format))


def format_epoch(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def format_duration(seconds: Column) -> Column:
    """``1h 2m``, ``3m 4s`` or ``5s``; a dash for what isn't positive."""
    whole = lambda x: F.floor(x).cast("string")
    hours, minutes, rest = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), seconds % 60
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "—")
        .when(hours > 0, F.concat(whole(hours), F.lit("h "), whole(minutes), F.lit("m")))
        .when(minutes > 0, F.concat(whole(minutes), F.lit("m "), whole(rest), F.lit("s")))
        .otherwise(F.concat(whole(rest), F.lit("s")))
    )


def percent(part: Column, total: Column) -> Column:
    """Whole percent, rounded half up; 0 of nothing."""
    return F.when(total > 0, F.floor(part / total * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def progress_bar(step: Column, total: Column, cells: int = 25) -> Column:
    """A bar of full and light cells and the whole percent; a step past the total is the total."""
    total = F.greatest(total, F.lit(1))
    at = F.least(step, total)
    full = F.floor(at * cells / total).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), cells - full))
    return F.concat(F.lit("["), bar, F.lit("] "), F.floor(at / total * 100).cast("string"), F.lit("%"))


def log_line(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "), message)


def log_class(line: Column) -> Column:
    """err, ok, info or nothing, by the first rule that holds."""
    return F.when(line.contains("ERROR"), "err").when(line.contains("Done"), "ok").when(line.contains("Dashboard") | line.contains("Started"), "info").otherwise("")


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def json_text(value: Column) -> Column:
    """JSON with nulls kept and letters of any script as they are."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def csv_field(value: Column) -> Column:
    """A field in minimal quoting: quoted if it has a comma, quote or line break, quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp_like(value, F.lit('[,"\r\n]')), quoted).otherwise(value)


def route_path(url: Column) -> Column:
    """The path of a request target without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")


def gigabytes(n: Column, step: int = 3) -> Column:
    return n / float(1024**step)
