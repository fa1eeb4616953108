"""Driver queries by name, one for each operator, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import rules, text
from pagemill.operators import catalog, export, pages, prompts, recognise, requests, tasks
from pagemill.plans import standins as S
from pagemill.schema import JobOptions
from pagemill.sources import kinds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LINES = "string_split(text, chr(10))"
_OCR = "'ocr:' || regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
_ASSEMBLED = "CASE WHEN len({a}) = 1 THEN {a}[1] ELSE array_to_string(list_transform({a}, lambda t, i: '--- Page ' || i || ' ---' || chr(10) || t), chr(10) || chr(10)) END"


# ---------------------------------------------------------------- the whole pipeline


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS task_id, regexp_extract(p, '[^/]*$') AS file_name, 'COMPLETED' AS status, CAST(len(a) AS INTEGER) AS page_count,
 (100 + doc_id % 1000) / 100.0::DOUBLE AS duration_sec, {_ASSEMBLED.format(a="a")} AS result_text
FROM (SELECT doc_id, {S.SQL_PATH} AS p, list_transform({_LINES}, lambda t: {_OCR.format(t="t")}) AS a FROM documents) WHERE {S.SQL_SUPPORTED.format(p="p")}"""
)
def pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported files, their pages recognised and assembled in one task each: no shuffle."""
    docs = S.documents(spark, sf_dir).select("doc_id", S.path().alias("source_path"), S.pages().alias("pages")).where(kinds.supported(F.col("source_path")))
    read = recognise.recognise_documents(docs, "pages")
    return read.select(F.col("doc_id").cast("string").alias("task_id"), text.file_name(F.col("source_path")).alias("file_name"), "status", F.size("texts").alias("page_count"), F.round(S.duration(), 3).alias("duration_sec"), pages.assembled(F.col("texts")).alias("result_text"))


# ---------------------------------------------------------------- sources


@query(f"SELECT p AS path, row_number() OVER (ORDER BY string_split(p, '/')) AS ordinal FROM (SELECT DISTINCT {S.SQL_PATH} AS p FROM documents) WHERE {S.SQL_SUPPORTED.format(p='p')}")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.documents(spark, sf_dir).select(S.path().alias("path")).where(kinds.supported(F.col("path"))).distinct()
    return kinds.numbered(found)


@query(f"SELECT {S.SQL_PATH} AS path FROM documents WHERE lang = 'en' UNION SELECT {S.SQL_PATH} FROM documents WHERE source IN ('src1', 'src2')")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.documents(spark, sf_dir)
    return docs.where("lang = 'en'").select(S.path().alias("path")).unionByName(docs.where("source IN ('src1', 'src2')").select(S.path().alias("path"))).distinct()


@query(f"SELECT doc_id, p AS path FROM (SELECT doc_id, {S.SQL_PATH} AS p FROM documents) WHERE {S.SQL_SUPPORTED.format(p='p')}")
def supported_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(spark, sf_dir).select("doc_id", S.path().alias("path")).where(kinds.supported(F.col("path")))


@query(
    f"""SELECT doc_id, regexp_extract(p, '[^/]*$') AS name, CASE WHEN e <> '' THEN regexp_extract(p, '([^/]*)(\\.[^./]+)$', 1) ELSE regexp_extract(p, '[^/]*$') END AS stem, e AS suffix
FROM (SELECT doc_id, p, regexp_extract(p, '[^/](\\.[^./]+)$', 1) AS e FROM (SELECT doc_id, {S.SQL_PATH} AS p FROM documents))"""
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.path()
    return S.documents(spark, sf_dir).select("doc_id", text.file_name(p).alias("name"), text.stem(p).alias("stem"), text.suffix(p).alias("suffix"))


@query(
    f"""SELECT doc_id, fmt, 'doc' || (doc_id % 97) || '_ocr.' || CASE WHEN lower(trim(fmt)) IN ('markdown', 'md') THEN 'md' ELSE lower(trim(fmt)) END AS output_name
FROM (SELECT doc_id, ['json', 'Markdown', 'md', ' CSV ', 'txt', 'xml'][(doc_id % 6) + 1] AS fmt FROM documents)"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("json", "Markdown", "md", " CSV ", "txt", "xml")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return S.documents(spark, sf_dir).select("doc_id", fmt.alias("fmt"), text.output_name(S.path(), fmt).alias("output_name"))


@query(
    """SELECT page_id, source, CASE WHEN regexp_matches(source, '^https?://') THEN 'url' WHEN source LIKE 'bytes:%' THEN 'bytes' ELSE 'path' END AS kind,
 CASE WHEN regexp_matches(source, '^https?://') THEN lower(source) LIKE '%.pdf' OR head = '%PDF' WHEN source LIKE 'bytes:%' THEN head = '%PDF' ELSE lower(source) LIKE '%.pdf' END AS is_pdf
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '.PDF' WHEN 2 THEN 'bytes:' || page_id WHEN 3 THEN '/in/' || page_id || '.pdf' ELSE '/in/' || page_id || '.png' END AS source,
 CASE WHEN page_id % 3 = 0 THEN '%PDF' ELSE substring(html, 1, 4) END AS head FROM pages)"""
)
def classify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    name = F.col("page_id").cast("string")
    source = F.when(k == 0, F.col("url")).when(k == 1, F.concat("url", F.lit(".PDF"))).when(k == 2, F.concat(F.lit("bytes:"), name)).when(k == 3, F.concat(F.lit("/in/"), name, F.lit(".pdf"))).otherwise(F.concat(F.lit("/in/"), name, F.lit(".png")))
    content = F.when(F.col("page_id") % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.col("html")).cast("binary")
    rows = S.table(spark, sf_dir, "pages").select("page_id", source.alias("source"), content.alias("content"))
    kind = F.when(F.col("source").startswith("bytes:"), "bytes").otherwise(kinds.source_kind(F.col("source")))
    return rows.select("page_id", "source", kind.alias("kind"), kinds.is_pdf(kind, F.col("source"), F.col("content")).alias("is_pdf"))


# ---------------------------------------------------------------- pages


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS page, CAST(len(a) AS INTEGER) AS total_pages, a[i] AS text FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS a FROM documents))")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.explode_pages(S.documents(spark, sf_dir), "doc_id", S.pages())


@query(f"SELECT doc_id, CAST(len({_LINES}) AS INTEGER) AS page_count FROM documents")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(spark, sf_dir).select("doc_id", F.size(S.pages()).alias("page_count"))


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS page, CAST(len(a) AS INTEGER) AS total_pages, {_OCR.format(t='a[i]')} AS text FROM (SELECT doc_id, a, unnest(range(1, least(len(a), 3) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS a FROM documents))")
def read_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pages.explode_pages(S.documents(spark, sf_dir), "doc_id", S.pages(), max_pages=3)
    return recognise.recognise_pages(cut, "text").select("doc_id", "page", "total_pages", F.col("recognised").alias("text"))


@query(
    f"""SELECT doc_id, CAST(sel AS INTEGER) AS selection, CAST(CASE WHEN sel > 0 AND sel <= n THEN sel WHEN sel = 0 THEN 1 WHEN sel < 0 AND n + sel + 1 >= 1 THEN n + sel + 1 END AS INTEGER) AS page
FROM (SELECT doc_id, doc_id % 7 - 3 AS sel, len({_LINES}) AS n FROM documents)"""
)
def page_select_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = (F.col("doc_id") % 7 - 3).cast("int")
    return S.documents(spark, sf_dir).select("doc_id", selection.alias("selection"), pages.select_page(F.size(S.pages()), selection).alias("page"))


_SELECT_LIST = """SELECT doc_id, '{name}' AS selection, CAST(o AS INTEGER) AS ordinal, CAST(s[o] AS INTEGER) AS page FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS o FROM (
 SELECT doc_id, CASE WHEN len(v) > 0 THEN v ELSE range(1, n + 1) END AS s FROM (SELECT doc_id, n, list_filter(list_transform({sel}, lambda p: CASE WHEN p > 0 THEN p WHEN p = 0 THEN 1 END), lambda p: p IS NOT NULL AND p <= n) AS v
 FROM (SELECT doc_id, len({lines}) AS n FROM documents))))"""


@query(_SELECT_LIST.format(name="some", sel="[2, 0, -1, 2, 99]", lines=_LINES) + " UNION ALL " + _SELECT_LIST.format(name="none", sel="[-1, 9999]", lines=_LINES))
def page_select_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.documents(spark, sf_dir)
    wanted = F.array(F.struct(F.lit("some").alias("name"), F.array(*map(F.lit, (2, 0, -1, 2, 99))).alias("list")), F.struct(F.lit("none").alias("name"), F.array(*map(F.lit, (-1, 9999))).alias("list")))
    rows = docs.select("doc_id", F.size(S.pages()).alias("n"), F.explode(wanted).alias("w"))
    chosen = rows.select("doc_id", F.col("w.name").alias("selection"), F.posexplode(pages.select_pages(F.col("n"), F.col("w.list"))).alias("at", "page"))
    return chosen.select("doc_id", "selection", (F.col("at") + 1).alias("ordinal"), "page")


@query(f"SELECT conv_id, CAST(len(a) AS INTEGER) AS page_count, {_ASSEMBLED.format(a='a')} AS text FROM (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS a FROM conversations GROUP BY conv_id)")
def page_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assemble_pages(S.table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"SELECT conv_id, turn, {_OCR.format(t='text')} AS recognised FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, {_OCR.format(t='text')} FROM conversations WHERE role <> 'user'")
def batch_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bags of sources read one after the other; the ordinal keeps their order."""
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    bag = rows.where("role = 'user'").unionByName(rows.where("role <> 'user'"))
    return recognise.recognise_pages(bag, "text").select("conv_id", "turn", "recognised")


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS page, {_OCR.format(t='a[i]')} AS recognised FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS a FROM documents))")
def recognise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.explode_pages(S.documents(spark, sf_dir), "doc_id", S.pages())
    return recognise.recognise_pages(rows, "text").select("doc_id", "page", "recognised")


# ---------------------------------------------------------------- prompts


@query("SELECT conv_id, turn, to_json({role: role, content: [{type: 'image', image: 'page' || turn, text: CAST(NULL AS VARCHAR)}, {type: 'text', image: CAST(NULL AS VARCHAR), text: text}]}) AS message FROM conversations")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.concat(F.lit("page"), F.col("turn").cast("string"))
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.chat_message(F.col("role"), image, F.col("text")).cast("string").alias("message"))


# The same catalog, prompts, rules and routes as the code's, written out once more, so that a wrong one shows.
_MODELS = "(VALUES (0, 'glm-ocr', 'GLM OCR'), (1, 'lighton-ocr', 'LightOnOCR'), (2, 'hunyuan-ocr', 'HunyuanOCR'), (3, 'smolvlm', 'SmolVLM-256M')) AS m(ordinal, id, display_name)"
_PROMPT_CASE = """CASE id WHEN 'glm-ocr' THEN 'Text Recognition:' WHEN 'smolvlm' THEN 'Extract all text from this image:' WHEN 'lighton-ocr' THEN ''
 WHEN 'hunyuan-ocr' THEN '提取文档图片中正文的所有信息用markdown格式表示，其中页眉、页脚部分忽略，表格用html格式表达，文档中公式用latex格式表示，按照阅读顺序组织进行解析。' END"""
_ASKED = "CASE turn % 3 WHEN 0 THEN '  ' WHEN 1 THEN text END"


@query(f"SELECT conv_id, turn, id AS model_id, CASE WHEN id = 'lighton-ocr' THEN '' WHEN asked IS NULL OR (id = 'hunyuan-ocr' AND trim(asked) = '') THEN {_PROMPT_CASE} ELSE asked END AS prompt FROM (SELECT conv_id, turn, {_ASKED} AS asked FROM conversations), {_MODELS}")
def prompt_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("turn") % 3 == 0, "  ").when(F.col("turn") % 3 == 1, F.col("text"))
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("asked")).crossJoin(F.broadcast(catalog.catalog(spark).select(F.col("id").alias("model_id"))))
    return rows.select("conv_id", "turn", "model_id", prompts.resolve_prompt(F.col("model_id"), F.col("asked")).alias("prompt"))


@query(
    """SELECT conv_id, turn, task, CASE task WHEN 'table' THEN 'Extract all table contents and output as formatted Markdown:'
 WHEN 'formula' THEN 'Extract mathematical formulas from this image into LaTeX syntax:'
 WHEN 'json' THEN 'Extract all key information from this document into a clean, structured JSON object:' || CASE WHEN coalesce(s, '') <> '' THEN chr(10) || 'Follow this exact JSON schema format:' || chr(10) || s ELSE '' END
 ELSE 'Text Recognition:' END AS prompt
FROM (SELECT conv_id, turn, ['table', 'formula', 'json', 'text'][(turn + conv_id) % 4 + 1] AS task, CASE WHEN turn % 2 = 1 THEN text END AS s FROM conversations)"""
)
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.element_at(F.array(*[F.lit(x) for x in ("table", "formula", "json", "text")]), ((F.col("turn") + F.col("conv_id")) % 4 + 1).cast("int"))
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", task.alias("task"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", "task", prompts.task_prompt(F.col("task"), F.col("s")).alias("prompt"))


# ---------------------------------------------------------------- texts

_NOISE = "' ' || chr(9) || chr(10) || '(4,22),(996,121) ' || text || '  ' || chr(9) || ' end' || chr(10) || chr(10) || chr(10) || chr(10) || '(1, 2) ' || text || chr(10) || ' '"


def _noisy():
    return F.concat(F.lit(" \t\n(4,22),(996,121) "), F.col("text"), F.lit("  \t end\n\n\n\n(1, 2) "), F.col("text"), F.lit("\n "))


@query(f"SELECT doc_id, regexp_replace({_NOISE}, '^\\s+|\\s+$', '', 'g') AS stripped FROM documents")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(spark, sf_dir).select("doc_id", text.strip(_noisy()).alias("stripped"))


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NOISE}, '(\\(\\d{{1,4}},\\s*\\d{{1,4}}\\),?\\s*)+', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents"""
)
def clean_ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(spark, sf_dir).select("doc_id", text.clean_recognised(_noisy()).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"))


# ---------------------------------------------------------------- tasks

_PROJECTED = "task_id, source_path, regexp_extract(source_path, '[^/]*$') AS file_name, status, retries, max_retries, created_at, started_at, completed_at, round(duration_sec, 3) AS duration_sec, error, CASE WHEN length(result_text) > 150 THEN substring(result_text, 1, 150) || '...' ELSE result_text END AS result_text_preview, output_path, page_count"


@query(f"SELECT {_PROJECTED} FROM ({S.SQL_TASKS})")
def task_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_projection(S.tasks(spark, sf_dir))


@query(f"SELECT {_PROJECTED} FROM ({S.SQL_TASKS}) WHERE task_id = '42'")
def get_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_projection(S.tasks(spark, sf_dir).where("task_id = '42'"))


_LATEST = f"SELECT user_id, arg_max({S.SQL_STATE}, struct_pack(t := ts, e := event_id)) AS status FROM events GROUP BY user_id"


@query(_LATEST)
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.latest_status(S.events(spark, sf_dir), "user_id", "status", "ts", "event_id")


@query(f"SELECT user_id, status FROM ({_LATEST}) WHERE status IN ('QUEUED', 'PROCESSING', 'RETRYING')")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.pending(tasks.latest_status(S.events(spark, sf_dir), "user_id", "status", "ts", "event_id"))


@query(f"SELECT {S.SQL_STATE} AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, status, retries, error FROM ({S.SQL_TASKS})")
def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tasks(spark, sf_dir).select("doc_id", "status", "retries", "error")


@query(f"SELECT task_id, CASE WHEN status = 'FAILED' THEN 'QUEUED' ELSE status END AS status, CASE WHEN status = 'FAILED' THEN 0 ELSE retries END AS retries, CASE WHEN status <> 'FAILED' THEN error END AS error FROM ({S.SQL_TASKS})")
def retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.retry_failed(S.tasks(spark, sf_dir).select("task_id", "status", "retries", "error"))


_DONE, _LOST = "count(*) FILTER (status = 'COMPLETED')", "count(*) FILTER (status = 'FAILED')"


@query(f"SELECT count(*) AS total_files, {_DONE} AS completed_files, {_LOST} AS failed_files, round({S.ELAPSED}::DOUBLE, 2) AS elapsed_time_sec, round({_DONE} / {S.ELAPSED}::DOUBLE, 2) AS average_speed_fps, 'glm-ocr' AS model_id FROM ({S.SQL_TASKS})")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.manifest_summary(S.tasks(spark, sf_dir), S.ELAPSED, "glm-ocr")


@query(f"SELECT task_id, to_json(struct_pack(task_id := task_id, source_path := source_path, status := status, retries := retries, duration_sec := round(duration_sec, 3), error := error, page_count := page_count)) AS task FROM ({S.SQL_TASKS})")
def manifest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's task entries as JSON, one row each: the sink streams them, no task gathers them all."""
    rows = S.tasks(spark, sf_dir).select("task_id", "source_path", "status", "retries", F.round("duration_sec", 3).alias("duration_sec"), "error", "page_count")
    return rows.select("task_id", tasks.task_json(rows).alias("task"))


@query(
    f"""SELECT count(*) AS total_files, {_DONE} AS processed_files, {_LOST} AS failed_files, count(*) FILTER (status IN ('QUEUED', 'PROCESSING', 'RETRYING')) AS queued_files,
 round({_DONE} / {S.ELAPSED}::DOUBLE, 2) AS processing_speed_fps, round({S.ELAPSED}::DOUBLE, 1) AS elapsed_time_sec, round((count(*) - {_DONE} - {_LOST}) / ({_DONE} / {S.ELAPSED}::DOUBLE), 1) AS eta_sec,
 'PAUSED' AS status, CAST(count(*) FILTER (status = 'PROCESSING') AS INTEGER) AS active_workers, 6 AS target_workers, 12.3::DOUBLE AS cpu_percent, 7.25::DOUBLE AS ram_used_gb, 31.5::DOUBLE AS ram_total_gb,
 1.5::DOUBLE AS vram_used_gb, 8.0::DOUBLE AS vram_total_gb, 'card' AS gpu_name, 'smolvlm' AS model_id, 'csv' AS output_format FROM ({S.SQL_TASKS})"""
)
def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gauges = {"cpu_percent": 12.34, "ram_used_gb": 7.25, "ram_total_gb": 31.5, "vram_used_gb": 1.5, "vram_total_gb": 8.0, "gpu_name": "card"}
    return tasks.job_metrics(S.tasks(spark, sf_dir), S.ELAPSED, "PAUSED", JobOptions(workers=6, model_id="smolvlm", output_format="csv"), gauges)


@query("SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN round(CAST(p_size AS DOUBLE) / (p_size % 7 * 50) * 100, 1) ELSE 0.0 END AS used_percent FROM part")
def used_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return S.table(spark, sf_dir, "part").select("p_partkey", tasks.used_percent(size, F.col("p_size") % 7 * 50).alias("used_percent"))


@query(
    """SELECT user_id, done, CASE WHEN done > 0 THEN round(done / span, 4) ELSE 0.0 END AS fps, CASE WHEN done > 0 THEN round((total - done - failed) / (done / span), 2) ELSE 0.0 END AS eta_sec
FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, 3600.0::DOUBLE AS span FROM events GROUP BY user_id)"""
)
def speed_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("status") == "COMPLETED")
    grouped = S.events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"), done.alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    fps = F.col("done") / F.lit(3600.0)
    return grouped.select("user_id", "done", F.when(F.col("done") > 0, F.round(fps, 4)).otherwise(F.lit(0.0)).alias("fps"), F.when(F.col("done") > 0, F.round((F.col("total") - F.col("done") - F.col("failed")) / fps, 2)).otherwise(F.lit(0.0)).alias("eta_sec"))


@query(
    """SELECT event_id, CAST(processed AS BIGINT) AS processed, CAST(failed AS BIGINT) AS failed, CASE WHEN processed > 0 THEN (n - processed - failed) / (processed / sec) ELSE 0.0 END AS eta_sec
FROM (SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS processed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS failed, (SELECT count(*) FROM events) AS n, 1.0::DOUBLE + event_id AS sec
 FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
)
def running_speed_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.events(spark, sf_dir).select("event_id", "ts", "status")
    one = lambda s: F.when(F.col("status") == s, 1).otherwise(0).cast("long")
    running = tasks.prefix_totals(log, ["ts", "event_id"], {"processed": one("COMPLETED"), "failed": one("FAILED")})
    total = F.broadcast(log.agg(F.count("*").alias("n")))
    eta = (F.col("n") - F.col("processed") - F.col("failed")) / (F.col("processed") / (F.lit(1.0) + F.col("event_id")))
    return running.crossJoin(total).select("event_id", "processed", "failed", F.when(F.col("processed") > 0, eta).otherwise(F.lit(0.0)).alias("eta_sec"))


@query("SELECT event_id, CASE WHEN t > 0 THEN CAST(floor(p / t * 100 + 0.5) AS BIGINT) ELSE 0 END AS pct FROM (SELECT event_id, (event_id % 90)::DOUBLE AS p, event_id % 91 AS t FROM events)")
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", text.percent(F.col("event_id") % 90, F.col("event_id") % 91).alias("pct"))


@query("SELECT event_id, '[' || repeat('█', CAST(s * 25 // t AS INTEGER)) || repeat('░', CAST(25 - s * 25 // t AS INTEGER)) || '] ' || CAST(floor(s / t * 100) AS BIGINT) || '%' AS bar FROM (SELECT event_id, least(event_id % 130, 120) AS s, 120 AS t FROM events)")
def progress_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", text.progress_bar(F.col("event_id") % 130, F.lit(120)).alias("bar"))


@query(
    """SELECT event_id, CASE WHEN x IS NULL OR x <= 0 THEN '—' WHEN h > 0 THEN h || 'h ' || m || 'm' WHEN m > 0 THEN m || 'm ' || s || 's' ELSE s || 's' END AS duration
FROM (SELECT event_id, x, CAST(floor(x / 3600) AS BIGINT) AS h, CAST(floor((x % 3600) / 60) AS BIGINT) AS m, CAST(floor(x % 60) AS BIGINT) AS s FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ((event_id * 37) % 9000 - 100) / 2.0::DOUBLE END AS x FROM events))"""
)
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 50 != 0, ((F.col("event_id") * 37) % 9000 - 100) / F.lit(2.0))
    return S.table(spark, sf_dir, "events").select("event_id", text.format_duration(x).alias("duration"))


@query("SELECT event_id, strftime(make_timestamp((1704067200 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS formatted FROM events")
def format_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", text.format_epoch((F.lit(S.EPOCH) + F.col("event_id")).cast("double")).alias("formatted"))


_LINE = "'[' || strftime(ts, '%H:%M:%S') || '] ' || CASE event_type WHEN 'error' THEN 'ERROR in task ' WHEN 'purchase' THEN 'Done ' WHEN 'signup' THEN 'Started ' ELSE 'task ' END || user_id"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    message = F.concat(F.when(kind == "error", "ERROR in task ").when(kind == "purchase", "Done ").when(kind == "signup", "Started ").otherwise("task "), F.col("user_id").cast("string"))
    return S.table(spark, sf_dir, "events").select("event_id", "ts", text.log_line(F.col("ts"), message).alias("line"))


@query(f"SELECT event_id, {_LINE} AS line FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "line")


@query(f"SELECT event_id, CASE WHEN contains(l, 'ERROR') THEN 'err' WHEN contains(l, 'Done') THEN 'ok' WHEN contains(l, 'Dashboard') OR contains(l, 'Started') THEN 'info' ELSE '' END AS class FROM (SELECT event_id, {_LINE} AS l FROM events)")
def log_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("event_id", text.log_class(F.col("line")).alias("class"))


@query(f"SELECT event_id, {_LINE} AS line FROM events WHERE event_id > 500")
def log_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client that has seen sequence number 500 gets next: the number filters at the scan."""
    return _lines(spark, sf_dir).where("event_id > 500").select("event_id", "line")


@query(f"SELECT event_id, user_id, {S.SQL_STATE} AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 60")
def latest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(60).select("event_id", "user_id", "status")


@query(f"SELECT output_name, doc_id FROM (SELECT 'doc' || (doc_id % 97) || '_ocr.json' AS output_name, doc_id, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY completed_at DESC, doc_id DESC) AS k FROM ({S.SQL_TASKS})) WHERE k = 1")
def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = S.tasks(spark, sf_dir).select(text.output_name(F.col("source_path"), F.lit("json")).alias("output_name"), "completed_at", "doc_id")
    return tasks.last_writer(named, "output_name", F.col("completed_at"), F.col("doc_id")).select("output_name", "doc_id")


# ---------------------------------------------------------------- exports


def _exported(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    c = F.col
    body = export.rendered(F.lit(fmt), c("task_id"), c("source_path"), F.lit("glm-ocr"), c("duration_sec"), c("page_count"), c("completed_at"), c("text"))
    return S.tasks(spark, sf_dir).select("doc_id", body.alias("body"))


_NAME = "regexp_extract(source_path, '[^/]*$')"


@query(
    f"""SELECT doc_id, to_json(struct_pack(task_id := task_id, file_name := {_NAME}, source_path := source_path, model_id := 'glm-ocr', duration_sec := round(duration_sec, 3), page_count := page_count,
 "timestamp" := strftime(make_timestamp(CAST(floor(completed_at) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S'), text := text)) AS body FROM ({S.SQL_TASKS})"""
)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "json")


@query(
    f"""SELECT doc_id, '# OCR Output: ' || {_NAME} || chr(10) || chr(10) || '- **Source**: `' || source_path || '`' || chr(10) || '- **Model**: `glm-ocr`' || chr(10) || '- **Pages**: ' || page_count || chr(10)
 || '- **Processing Time**: ' || printf('%.2f', duration_sec) || 's' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS body FROM ({S.SQL_TASKS})"""
)
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "markdown")


@query(
    f"""SELECT doc_id, 'file_name,source_path,model_id,duration_sec,text' || chr(13) || chr(10) || {_NAME} || ',' || source_path || ',glm-ocr,' || printf('%.3f', duration_sec) || ',' ||
 CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || chr(13) || chr(10) AS body FROM ({S.SQL_TASKS})"""
)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "csv")


@query("SELECT doc_id, text || chr(10) AS body FROM documents")
def export_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "txt")


# ---------------------------------------------------------------- catalog, doctor, probes


_CATALOG = """(VALUES
 (0, 'glm-ocr', 'GLM OCR', 'OCR', '0.9B', 'General OCR|Invoices|Books|Research Papers|Forms|Tables|Formula Recognition|Markdown Export', 6.0::DOUBLE, '6 GB VRAM', true, true, 'zai-org/GLM-OCR', 'The default engine: accurate text from invoices, papers, tables and formulas.', 1.8::DOUBLE),
 (1, 'lighton-ocr', 'LightOnOCR', 'OCR', '1B', 'Scientific Documents|Academic Papers|Multilingual OCR|PDF Parsing', 8.0, '8 GB VRAM', true, false, 'lightonai/LightOnOCR-2-1B', 'For scientific and multilingual documents and PDF parsing.', 2.0),
 (2, 'hunyuan-ocr', 'HunyuanOCR', 'OCR', '~1B', 'Enterprise Documents|Charts|Tables|Complex Layouts|Information Extraction', 8.0, '8 GB VRAM', true, false, 'tencent/HunyuanOCR', 'For complex layouts, charts and information extraction.', 2.0),
 (3, 'smolvlm', 'SmolVLM-256M', 'Vision Language Model', '256M', 'Low End GPU|Laptop|Edge Device|Jetson|Offline OCR', 2.0, '2 GB VRAM', true, false, 'HuggingFaceTB/SmolVLM-256M-Instruct', 'A compact model for edge devices and offline use.', 0.5))
 AS c(ordinal, id, display_name, category, parameters, use_cases, min_vram_gb, min_recommendation, cpu_supported, is_default, hf_repo_id, description, download_size_gb)"""


@query(f"SELECT * FROM {_CATALOG}")
def catalog_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog(spark).withColumn("use_cases", F.array_join("use_cases", "|"))


@query(f"SELECT id, display_name || CASE WHEN is_default THEN ' [Default]' ELSE '' END || ' (' || parameters || ')' AS label, array_to_string(string_split(use_cases, '|')[1:2], ', ') AS first_uses, list_contains(string_split(use_cases, '|'), 'Tables') AS reads_tables FROM {_CATALOG}")
def catalog_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("display_name", F.when(F.col("is_default"), " [Default]").otherwise(""), F.lit(" ("), "parameters", F.lit(")"))
    return catalog.catalog(spark).select("id", label.alias("label"), F.array_join(F.slice("use_cases", 1, 2), ", ").alias("first_uses"), F.array_contains("use_cases", "Tables").alias("reads_tables"))


@query(f"SELECT id, display_name FROM {_CATALOG} ORDER BY is_default DESC, ordinal LIMIT 1")
def catalog_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.default_model(catalog.catalog(spark)).select("id", "display_name")


_ALIASES = ("glm-ocr", "GLM OCR", "GLM-OCR", "glm_ocr", "LightOnOCR", "lighton-ocr", "HUNYUAN ocr", "SmolVLM-256M", "smolvlm", "gpt-vision", "")
_SQL_ALIAS = "[" + ", ".join(f"'{a}'" for a in _ALIASES) + f"][(doc_id % {len(_ALIASES)}) + 1]"
_SUPPORTED_IDS = "glm-ocr, lighton-ocr, hunyuan-ocr, smolvlm"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(spark, sf_dir).select("doc_id", F.element_at(F.array(*[F.lit(a) for a in _ALIASES]), (F.col("doc_id") % len(_ALIASES) + 1).cast("int")).alias("name"))


@query(f"SELECT doc_id, {_SQL_ALIAS} AS name, {_SQL_ALIAS} IN ('glm-ocr', 'lighton-ocr', 'hunyuan-ocr', 'smolvlm') AS registered FROM documents")
def catalog_is_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir).select("doc_id", "name", F.col("name").isin(*[m[0] for m in catalog.MODELS]).alias("registered"))


@query(
    f"""SELECT doc_id, name, coalesce(a.id, b.id) AS model_id, CASE WHEN coalesce(a.id, b.id) IS NULL THEN 'Unknown model ''' || name || '''. Supported models: {_SUPPORTED_IDS}' END AS error
FROM (SELECT doc_id, {_SQL_ALIAS} AS name FROM documents) LEFT JOIN (SELECT id FROM {_MODELS}) a ON name = a.id
LEFT JOIN (SELECT translate(lower(id), '-_ ', '') AS k, id FROM {_MODELS} UNION SELECT translate(lower(display_name), '-_ ', ''), id FROM {_MODELS}) b ON translate(lower(name), '-_ ', '') = b.k"""
)
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup(_aliases(spark, sf_dir), catalog.catalog(spark))


@query("SELECT source, count(*) FILTER (strlen(text) > 0) > 0 AS installed FROM documents GROUP BY source")
def cache_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders (sources) that have a non-empty file."""
    return S.documents(spark, sf_dir).groupBy("source").agg((F.count_if(F.octet_length("text") > 0) > 0).alias("installed"))


@query("SELECT source, sum(strlen(text)) AS bytes, round(sum(strlen(text)) / pow(1024, 3), 3) AS gb FROM documents GROUP BY source")
def disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sum(F.octet_length("text").cast("long"))
    return S.documents(spark, sf_dir).groupBy("source").agg(size.alias("bytes"), F.round(text.gigabytes(size), 3).alias("gb"))


_DOCTOR = """SELECT p_partkey, id AS model_id, split_part(r, '|', 1) AS level, split_part(r, '|', 2) AS note FROM (SELECT p_partkey, id, CASE id
 WHEN 'smolvlm' THEN CASE WHEN NOT cuda THEN 'Excellent|Excellent on CPU — designed for edge devices.' WHEN vram >= 2 THEN 'Excellent|' WHEN vram > 0 THEN 'Supported|Very low VRAM — CPU mode recommended.' ELSE 'Excellent|Excellent on CPU — designed for edge devices.' END
 WHEN 'glm-ocr' THEN CASE WHEN NOT cuda THEN 'Supported|Running on CPU — expect significantly slower performance.' WHEN vram >= 6 THEN 'Excellent|' WHEN vram >= 4 THEN 'Supported|Below recommended 6 GB VRAM. Large PDFs may be slower.'
  WHEN vram >= 2 THEN 'Supported|Low VRAM detected. Use smaller batch sizes.' ELSE 'Not Recommended|Insufficient VRAM. Use smolvlm instead.' END
 WHEN 'lighton-ocr' THEN CASE WHEN NOT cuda THEN 'Supported|Runs on CPU — significantly slower for large documents.' WHEN vram >= 8 THEN 'Excellent|' WHEN vram >= 6 THEN 'Supported|Below recommended 8 GB VRAM. May require lower batch size.' ELSE 'Not Recommended|Requires 8 GB VRAM for reliable performance.' END
 ELSE CASE WHEN NOT cuda THEN 'Not Recommended|Requires GPU. CPU mode is not practical for this model.' WHEN vram >= 8 THEN 'Excellent|' WHEN vram >= 6 THEN 'Supported|Below recommended 8 GB VRAM. Reduce batch size.' ELSE 'Not Recommended|Requires more GPU memory (8 GB minimum recommended).' END
 END AS r FROM (SELECT p_partkey, p_size / 4.0::DOUBLE AS vram, p_partkey % 3 > 0 AS cuda FROM part), """ + f"{_MODELS})"


@query(_DOCTOR)
def doctor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    machines = S.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(4.0)).alias("primary_vram_gb"), (F.col("p_partkey") % 3 > 0).alias("cuda_available"))
    return catalog.doctor(machines, catalog.catalog(spark)).select("p_partkey", "model_id", "level", "note")


@query("SELECT DISTINCT p_brand AS name, p_brand IN (SELECT p_brand FROM part WHERE p_size > 47) AS installed FROM part")
def dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required packages (brands) that are there (on a large part) and that are missing; of this machine, see hardware.missing_packages."""
    parts = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_size")
    return catalog.dependencies(parts.select("name").distinct(), parts.where("p_size > 47").select("name").distinct())


_GPU = "(p_partkey % 4) || ', ' || p_brand || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ', ' || CASE WHEN p_partkey % 5 = 0 THEN 'N/A' ELSE CAST(p_size * 512 AS VARCHAR) END || ',' || (p_size * 256) END"


def _gpu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    memory = F.concat(F.lit(", "), F.when(key % 5 == 0, "N/A").otherwise((size * 512).cast("string")), F.lit(","), (size * 256).cast("string"))
    line = F.concat((key % 4).cast("string"), F.lit(", "), F.col("p_brand"), F.when(key % 7 == 0, "").otherwise(memory))
    return S.table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


_GPU_ROWS = f"SELECT p_partkey, try_cast(trim(a[1]) AS INTEGER) AS index, trim(a[2]) AS name, round(try_cast(trim(a[3]) AS DOUBLE) / 1024, 2) AS vram_total_gb, round(try_cast(trim(a[4]) AS DOUBLE) / 1024, 2) AS vram_free_gb FROM (SELECT p_partkey, string_split({_GPU}, ',') AS a FROM part) WHERE try_cast(trim(a[1]) AS INTEGER) IS NOT NULL AND try_cast(trim(a[3]) AS DOUBLE) IS NOT NULL AND try_cast(trim(a[4]) AS DOUBLE) IS NOT NULL"


@query(_GPU_ROWS)
def parse_gpu_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gpu_lines(spark, sf_dir).select("p_partkey", rules.gpu_row(F.col("line")).alias("g")).where("g IS NOT NULL").select("p_partkey", "g.*")


@query(f"SELECT p_partkey // 16 AS machine, arg_min(name, p_partkey) AS primary_gpu_name, arg_min(vram_total_gb, p_partkey) AS primary_vram_gb FROM ({_GPU_ROWS}) GROUP BY 1")
def primary_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first GPU that each machine's probe lists."""
    rows = _gpu_lines(spark, sf_dir).select("p_partkey", rules.gpu_row(F.col("line")).alias("g")).where("g IS NOT NULL")
    return rows.groupBy(F.floor(F.col("p_partkey") / 16).alias("machine")).agg(F.min_by("g.name", "p_partkey").alias("primary_gpu_name"), F.min_by("g.vram_total_gb", "p_partkey").alias("primary_vram_gb"))


_SMI = "'| NVIDIA-SMI 550.54 ' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'CUDA Version: ' || (p_partkey % 3 + 11) || '.' || (p_partkey % 9) || ' |' END || chr(10) || CASE WHEN p_partkey % 6 = 0 THEN '|  0  Matrox  On |' ELSE '|   0  NVIDIA ' || p_brand || '-' || p_size || '  On  | 0' || chr(10) || '|   1  NVIDIA T4   Off | 1' END"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    version = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("CUDA Version: "), (key % 3 + 11).cast("string"), F.lit("."), (key % 9).cast("string"), F.lit(" |")))
    names = F.when(key % 6 == 0, "|  0  Matrox  On |").otherwise(F.concat(F.lit("|   0  NVIDIA "), "p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("  On  | 0\n|   1  NVIDIA T4   Off | 1")))
    return S.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("| NVIDIA-SMI 550.54 "), version, F.lit("\n"), names).alias("output"))


@query(f"SELECT p_partkey, nullif(regexp_extract({_SMI}, 'CUDA Version:\\s*([0-9]+\\.[0-9]+)', 1), '') AS cuda_version FROM part")
def parse_cuda_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).select("p_partkey", rules.cuda_version(F.col("output")).alias("cuda_version"))


@query(f"SELECT p_partkey, CASE WHEN len(n) > 0 THEN array_to_string(list_transform(n, lambda x: trim(x)), '|') ELSE 'NVIDIA GPU' END AS names FROM (SELECT p_partkey, regexp_extract_all({_SMI}, '(NVIDIA [A-Za-z0-9\\s\\-]+)\\s+(?:On|Off|ERR)', 1) AS n FROM part)")
def parse_gpu_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).select("p_partkey", F.array_join(rules.gpu_names(F.col("output")), "|").alias("names"))


_VERSIONS = (None, "11.7", "11.8", "12.0", "12.1", "12.3", "12.4", "13.0", "abc", "12", "14.2.1", "11.9")
_SQL_VERSION = "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in _VERSIONS) + "][(p_partkey % 12) + 1]"


@query(
    f"""SELECT p_partkey, v AS version, 'pip install torch torchvision --index-url https://download.pytorch.org/whl/' || CASE WHEN a IS NULL OR b IS NULL THEN 'cu124' WHEN a >= 13 THEN 'cu130' WHEN a = 12 AND b >= 4 THEN 'cu124' WHEN a = 12 AND b IN (1, 2, 3) THEN 'cu121' WHEN a = 11 AND b >= 8 THEN 'cu118' ELSE 'cu124' END AS command
FROM (SELECT p_partkey, v, try_cast(string_split(v, '.')[1] AS INTEGER) AS a, try_cast(string_split(v, '.')[2] AS INTEGER) AS b FROM (SELECT p_partkey, {_SQL_VERSION} AS v FROM part))"""
)
def cuda_install_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.element_at(F.array(*[F.lit(v).cast("string") for v in _VERSIONS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return S.table(spark, sf_dir, "part").select("p_partkey", version.alias("version")).select("p_partkey", "version", rules.install_command(F.col("version")).alias("command"))


# ---------------------------------------------------------------- requests


@query(
    """SELECT event_id, CASE WHEN NOT loaded THEN 503 WHEN file IS NULL AND url IS NULL THEN 400 ELSE 200 END AS status,
 CASE WHEN loaded AND (file IS NOT NULL OR url IS NOT NULL) THEN CASE WHEN file IS NOT NULL THEN lower(file) LIKE '%_.pdf' ELSE lower(url) LIKE '%.pdf' END END AS is_pdf,
 CASE WHEN loaded AND (file IS NOT NULL OR url IS NOT NULL) THEN CASE WHEN CASE WHEN file IS NOT NULL THEN lower(file) LIKE '%_.pdf' ELSE lower(url) LIKE '%.pdf' END THEN 'read_pdf' ELSE 'read' END END AS reader
FROM (SELECT event_id, event_id % 10 > 0 AS loaded, CASE WHEN event_id % 3 = 0 THEN ['a.PDF', 'b.png', '.pdf', 'c'][(event_id % 4) + 1] END AS file, CASE WHEN event_id % 4 < 2 THEN 'https://host/' || event_id || CASE WHEN event_id % 2 = 0 THEN '.Pdf' ELSE '.png' END END AS url FROM events)"""
)
def rest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    file = F.when(key % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in ("a.PDF", "b.png", ".pdf", "c")]), (key % 4 + 1).cast("int")))
    url = F.when(key % 4 < 2, F.concat(F.lit("https://host/"), key.cast("string"), F.when(key % 2 == 0, ".Pdf").otherwise(".png")))
    rows = S.table(spark, sf_dir, "events").select("event_id", (key % 10 > 0).alias("loaded"), file.alias("file"), url.alias("url"))
    return rows.select("event_id", requests.rest_route(F.col("loaded"), F.col("file"), F.col("url")).alias("r")).select("event_id", "r.*")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0
 THEN '{"status":"success","is_pdf":true,"pages":[' || CASE WHEN event_id % 2 = 0 THEN '{"page":1,"total_pages":2,"text":"a ' || event_id || '"},{"page":2,"total_pages":2,"text":"b \\"q\\""}' ELSE '' END || '],"device_used":"cpu","execution_time_seconds":' || (event_id % 100) || '.5}'
 ELSE '{"status":"success","is_pdf":false,"text":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"text é ' || event_id || '"' END || ',"device_used":"cuda","execution_time_seconds":' || (event_id % 100) || '.5}' END AS body FROM events"""
)
def rest_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    page = lambda n, t: F.struct(F.lit(n).alias("page"), F.lit(2).alias("total_pages"), t.alias("text"))
    both = F.array(page(1, F.concat(F.lit("a "), key.cast("string"))), page(2, F.lit('b "q"')))
    pages_ = F.when(key % 2 == 0, both).otherwise(F.slice(both, 1, 0))
    text_ = F.when(key % 5 != 0, F.concat(F.lit("text é "), key.cast("string")))
    body = requests.rest_response(key % 3 == 0, text_, pages_, F.when(key % 3 == 0, "cpu").otherwise("cuda"), key % 100 + F.lit(0.5))
    return S.table(spark, sf_dir, "events").select("event_id", body.alias("body"))


_BODY = """CASE event_id % 4 WHEN 0 THEN '{"image_url": "https://h/' || event_id || '.pdf", "prompt": "p' || event_id || '", "max_new_tokens": ' || (event_id % 100) || '}' WHEN 1 THEN '{"image_url": "https://h/' || event_id || '.png"}' WHEN 2 THEN '{"prompt": "x"}' ELSE 'no json' END"""


@query(
    f"""SELECT event_id, CASE WHEN u IS NULL THEN 422 ELSE 200 END AS status, u AS image_url, CASE WHEN u IS NOT NULL THEN coalesce(p, 'Text Recognition:') END AS prompt, CASE WHEN u IS NOT NULL THEN coalesce(t, 512) END AS max_new_tokens, lower(u) LIKE '%.pdf' AS is_pdf
FROM (SELECT event_id, j ->> '$.image_url' AS u, j ->> '$.prompt' AS p, CAST(j ->> '$.max_new_tokens' AS INTEGER) AS t FROM (SELECT event_id, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM (SELECT event_id, {_BODY} AS b FROM events)))"""
)
def rest_json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    full = F.concat(F.lit('{"image_url": "https://h/'), key, F.lit('.pdf", "prompt": "p'), key, F.lit('", "max_new_tokens": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    k = F.col("event_id") % 4
    body = F.when(k == 0, full).when(k == 1, F.concat(F.lit('{"image_url": "https://h/'), key, F.lit('.png"}'))).when(k == 2, '{"prompt": "x"}').otherwise("no json")
    return S.table(spark, sf_dir, "events").select("event_id", requests.url_request(body).alias("r")).select("event_id", "r.*")


_TARGETS = ("/", "", "/api/status", "/api/tasks/", "/api/logs?n=5", "/api/stream", "/nope", "/api/pause", "/api/resume/", "/api/cancel", "/api/retry-failed", "/api/reconfigure?x")
_ROUTE_CASE = """CASE WHEN method = 'GET' THEN CASE p WHEN '' THEN 'page' WHEN '/api/status' THEN 'status' WHEN '/api/tasks' THEN 'tasks' WHEN '/api/logs' THEN 'logs' WHEN '/api/stream' THEN 'stream' ELSE 'not_found' END
 ELSE CASE p WHEN '/api/pause' THEN 'pause' WHEN '/api/resume' THEN 'resume' WHEN '/api/cancel' THEN 'cancel' WHEN '/api/retry-failed' THEN 'retry-failed' WHEN '/api/reconfigure' THEN 'reconfigure' ELSE 'not_found' END END"""


@query(
    f"""SELECT event_id, {_ROUTE_CASE} AS handler, CASE WHEN {_ROUTE_CASE} = 'not_found' THEN 404 ELSE 200 END AS status FROM (SELECT event_id, method, rtrim(regexp_replace(u, '[?#].*$', ''), '/') AS p
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, [{", ".join(f"'{t}'" for t in _TARGETS)}][((event_id // 2) % {len(_TARGETS)}) + 1] AS u FROM events))"""
)
def http_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    target = F.element_at(F.array(*[F.lit(t) for t in _TARGETS]), (F.floor(key / 2) % len(_TARGETS) + 1).cast("int"))
    return S.table(spark, sf_dir, "events").select("event_id", requests.http_route(F.when(key % 2 == 0, "GET").otherwise("POST"), target).alias("r")).select("event_id", "r.*")


_SETTINGS = """CASE event_id % 4 WHEN 0 THEN '{"workers": ' || (event_id % 16) || '}' WHEN 1 THEN '' WHEN 2 THEN '{"output_format": "csv", "retries": 3}' ELSE '{broken' END"""


@query(
    f"""SELECT event_id, CASE WHEN j IS NULL THEN 400 ELSE 200 END AS status, CAST(j ->> '$.workers' AS INTEGER) AS workers, j ->> '$.output_format' AS output_format, CAST(j ->> '$.retries' AS INTEGER) AS retries
FROM (SELECT event_id, CASE WHEN trim(b) = '' THEN CAST('{{}}' AS JSON) WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM (SELECT event_id, {_SETTINGS} AS b FROM events))"""
)
def reconfigure_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.concat(F.lit('{"workers": '), (F.col("event_id") % 16).cast("string"), F.lit("}"))).when(k == 1, "").when(k == 2, '{"output_format": "csv", "retries": 3}').otherwise("{broken")
    return S.table(spark, sf_dir, "events").select("event_id", requests.reconfigure(body).alias("r")).select("event_id", "r.*")


@query(f"SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || to_json(struct_pack(event_id := event_id, status := {S.SQL_STATE}, props := props)) || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = text.json_text(F.struct("event_id", "status", "props"))
    return S.events(spark, sf_dir).select("event_id", text.sse_frame(F.col("event_type"), data).alias("frame"))
