"""Request routing and validation as columns, for the HTTP adapter and for logs of requests alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import json_text, route_path, suffix
from pagemill.operators.prompts import DEFAULT_PROMPT
from pagemill.schema import RECONFIGURE, URL_REQUEST

MAX_NEW_TOKENS = 512
# The dashboard's routes.
ROUTES = {("GET", ""): "page", ("GET", "/api/status"): "status", ("GET", "/api/tasks"): "tasks", ("GET", "/api/logs"): "logs", ("GET", "/api/stream"): "stream"} | {("POST", f"/api/{x}"): x for x in ("pause", "resume", "cancel", "retry-failed", "reconfigure")}


def http_route(method: Column, url: Column) -> Column:
    """struct(handler, status) of a dashboard request."""
    path, out = route_path(url), None
    for (verb, route), handler in ROUTES.items():
        out = (out.when if out is not None else F.when)((method == verb) & (path == route), F.lit(handler))
    handler = out.otherwise(F.lit("not_found"))
    return F.struct(handler.alias("handler"), F.when(handler == "not_found", 404).otherwise(200).alias("status"))


def rest_route(loaded: Column, file: Column, image_url: Column) -> Column:
    """struct(status, is_pdf, reader) of an upload-or-URL request: 503 without an engine, 400 with neither source.

    An upload goes before a URL; an upload without a name is an image.
    """
    pdf = F.when(file.isNotNull(), F.lower(suffix(file)) == ".pdf").when(image_url.isNotNull(), F.lower(image_url).endswith(".pdf"))
    status = F.when(~loaded, 503).when(file.isNull() & image_url.isNull(), 400).otherwise(200)
    ok = status == 200
    reader = F.when(ok & pdf, "read_pdf").when(ok, "read")
    return F.struct(status.alias("status"), F.when(ok, pdf).alias("is_pdf"), reader.alias("reader"))


def rest_response(is_pdf: Column, text: Column, pages: Column, device: Column, seconds: Column) -> Column:
    """The JSON body of an answered request: ``pages`` of a PDF, else ``text``, the device and the seconds it took."""
    seconds = F.round(seconds, 3).alias("execution_time_seconds")
    whole = F.struct(F.lit("success").alias("status"), F.lit(True).alias("is_pdf"), pages.alias("pages"), device.alias("device_used"), seconds)
    single = F.struct(F.lit("success").alias("status"), F.lit(False).alias("is_pdf"), text.alias("text"), device.alias("device_used"), seconds)
    return F.when(is_pdf, json_text(whole)).otherwise(json_text(single))


def url_request(body: Column) -> Column:
    """struct(status, image_url, prompt, max_new_tokens, is_pdf) of a JSON body; 422 if it isn't JSON or has no image_url."""
    parsed = F.from_json(body, URL_REQUEST)
    url = parsed.getField("image_url")
    ok = url.isNotNull()
    return F.struct(
        F.when(ok, 200).otherwise(422).alias("status"),
        url.alias("image_url"),
        F.when(ok, F.coalesce(parsed.getField("prompt"), F.lit(DEFAULT_PROMPT))).alias("prompt"),
        F.when(ok, F.coalesce(parsed.getField("max_new_tokens"), F.lit(MAX_NEW_TOKENS))).alias("max_new_tokens"),
        F.when(ok, F.lower(url).endswith(".pdf")).alias("is_pdf"),
    )


def reconfigure(body: Column) -> Column:
    """struct(status, workers, output_format, retries) of a reconfigure body; an empty one changes nothing, a broken one is 400."""
    text = F.when(F.trim(body) == "", "{}").otherwise(body)
    parsed = F.from_json(text, RECONFIGURE)
    ok = F.try_parse_json(text).isNotNull()
    return F.struct(F.when(ok, 200).otherwise(400).alias("status"), *[F.when(ok, parsed.getField(f)).alias(f) for f in ("workers", "output_format", "retries")])
