"""Decision rules: which model suits a machine, which build fits a driver, what a probe's output says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels, and for each model its tiers: (least VRAM, whether only above it, level, note), the first that
# holds wins; the last entry is the rule for machines without CUDA.
EXCELLENT, SUPPORTED, NOT_RECOMMENDED = "Excellent", "Supported", "Not Recommended"
TIERS = {
    "smolvlm": (
        [(2.0, False, EXCELLENT, ""), (0.0, True, SUPPORTED, "Very low VRAM — CPU mode recommended."), (None, False, EXCELLENT, "Excellent on CPU — designed for edge devices.")],
        (EXCELLENT, "Excellent on CPU — designed for edge devices."),
    ),
    "glm-ocr": (
        [(6.0, False, EXCELLENT, ""), (4.0, False, SUPPORTED, "Below recommended 6 GB VRAM. Large PDFs may be slower."), (2.0, False, SUPPORTED, "Low VRAM detected. Use smaller batch sizes."), (None, False, NOT_RECOMMENDED, "Insufficient VRAM. Use smolvlm instead.")],
        (SUPPORTED, "Running on CPU — expect significantly slower performance."),
    ),
    "lighton-ocr": (
        [(8.0, False, EXCELLENT, ""), (6.0, False, SUPPORTED, "Below recommended 8 GB VRAM. May require lower batch size."), (None, False, NOT_RECOMMENDED, "Requires 8 GB VRAM for reliable performance.")],
        (SUPPORTED, "Runs on CPU — significantly slower for large documents."),
    ),
    "hunyuan-ocr": (
        [(8.0, False, EXCELLENT, ""), (6.0, False, SUPPORTED, "Below recommended 8 GB VRAM. Reduce batch size."), (None, False, NOT_RECOMMENDED, "Requires more GPU memory (8 GB minimum recommended).")],
        (NOT_RECOMMENDED, "Requires GPU. CPU mode is not practical for this model."),
    ),
}
UNKNOWN = (SUPPORTED, "Hardware compatibility unknown for this model.")
# Package index by the least (major, minor) of the driver's CUDA version and the last minor it holds for.
BUILDS = (((13, 0), None, "cu130"), ((12, 4), 12, "cu124"), ((12, 1), 12, "cu121"), ((11, 8), 11, "cu118"))
DEFAULT_BUILD, INSTALL = "cu124", "pip install torch torchvision --index-url https://download.pytorch.org/whl/"


def suitability(model_id: Column, vram_gb: Column, cuda: Column) -> Column:
    """struct(level, note) of a model on a machine."""
    pair = lambda level, note: F.struct(F.lit(level).alias("level"), F.lit(note).alias("note"))
    out = None
    for model, (tiers, without) in TIERS.items():
        own = (out.when if out is not None else F.when)((model_id == model) & ~cuda, pair(*without))
        for least, above, level, note in tiers:
            fits = F.lit(True) if least is None else vram_gb > least if above else vram_gb >= least
            own = own.when((model_id == model) & fits, pair(level, note))
        out = own
    return out.otherwise(pair(*UNKNOWN))


def install_command(cuda_version: Column) -> Column:
    """The install command for a driver's CUDA version; a missing or unreadable one takes the default build."""
    parts = F.split(cuda_version, r"\.")
    major, minor = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    build = None
    for (least_major, least_minor), only, name in BUILDS:
        fits = (major >= least_major) if only is None else (major == only) & (minor >= least_minor)
        build = (build.when if build is not None else F.when)(major.isNotNull() & minor.isNotNull() & fits, name)
    return F.concat(F.lit(INSTALL), F.coalesce(build.otherwise(DEFAULT_BUILD), F.lit(DEFAULT_BUILD)))


def cuda_version(output: Column) -> Column:
    """The version in a driver tool's output, null if there is none."""
    return F.nullif(F.regexp_extract(output, r"CUDA Version:\s*([0-9]+\.[0-9]+)", 1), F.lit(""))


def gpu_names(output: Column) -> Column:
    """The GPU names in a driver tool's output; one stand-in if none can be read."""
    names = F.transform(F.regexp_extract_all(output, F.lit(r"(NVIDIA [A-Za-z0-9\s\-]+(?=\s+On|\s+Off|\s+ERR))"), F.lit(1)), lambda x: F.trim(x))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("NVIDIA GPU")))


def gpu_row(line: Column) -> Column:
    """struct(index, name, vram_total_gb, vram_free_gb) of a line ``index, name, total MB, free MB``; null if it is short or not numeric."""
    part = lambda k: F.trim(F.get(F.split(line, ","), F.lit(k)))
    index, total, free = part(0).try_cast("int"), part(2).try_cast("double"), part(3).try_cast("double")
    row = F.struct(index.alias("index"), part(1).alias("name"), F.round(total / 1024, 2).alias("vram_total_gb"), F.round(free / 1024, 2).alias("vram_free_gb"))
    return F.when(index.isNotNull() & total.isNotNull() & free.isNotNull(), row)
