"""Prompts: defaults by model, task templates and chat requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import json_text, strip

# Prompts that models and tasks expect.
DEFAULT_PROMPT = "Text Recognition:"
MODEL_PROMPTS = {
    "glm-ocr": "Text Recognition:",
    "smolvlm": "Extract all text from this image:",
    "hunyuan-ocr": "提取文档图片中正文的所有信息用markdown格式表示，其中页眉、页脚部分忽略，表格用html格式表达，文档中公式用latex格式表示，按照阅读顺序组织进行解析。",
    "lighton-ocr": "",
}
TASK_PROMPTS = {
    "table": "Extract all table contents and output as formatted Markdown:",
    "formula": "Extract mathematical formulas from this image into LaTeX syntax:",
    "json": "Extract all key information from this document into a clean, structured JSON object:",
}
SCHEMA_PROMPT = "\nFollow this exact JSON schema format:\n"


def resolve_prompt(model_id: Column, prompt: Column) -> Column:
    """The prompt a model gets: a missing one is the model's default, a blank one is for hunyuan-ocr, lighton-ocr ignores any."""
    own = None
    for model, text in MODEL_PROMPTS.items():
        own = (own.when if own is not None else F.when)(model_id == model, F.lit(text))
    default = own.otherwise(F.lit(DEFAULT_PROMPT))
    blank = (model_id == "hunyuan-ocr") & (strip(prompt) == "")
    return F.when(model_id == "lighton-ocr", F.lit("")).when(prompt.isNull() | blank, default).otherwise(prompt)


def task_prompt(task: Column, schema: Column) -> Column:
    """The template of a task; json takes the caller's schema if there is one."""
    out = None
    for name, text in TASK_PROMPTS.items():
        asked = F.concat(F.lit(text), F.when(F.coalesce(schema, F.lit("")) != "", F.concat(F.lit(SCHEMA_PROMPT), schema)).otherwise("")) if name == "json" else F.lit(text)
        out = (out.when if out is not None else F.when)(task == name, asked)
    return out.otherwise(F.lit(DEFAULT_PROMPT))


def json_prompt(schema: str | None = None) -> str:
    """``task_prompt`` of one json request."""
    return TASK_PROMPTS["json"] + (SCHEMA_PROMPT + schema if schema else "")


def chat_message(role: Column, image: Column, text: Column) -> Column:
    """A chat request as JSON: one message with an image item and a text item."""
    items = F.array(F.struct(F.lit("image").alias("type"), image.alias("image"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), text.alias("text")))
    return json_text(F.struct(role.alias("role"), items.alias("content")))
