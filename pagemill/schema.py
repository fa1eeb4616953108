"""Record types of the engine as schemas in DDL, which workers can import too, and the values of its enumerations."""

from __future__ import annotations

from dataclasses import dataclass


# Task and job states.
QUEUED, PROCESSING, COMPLETED, FAILED, RETRYING = "QUEUED", "PROCESSING", "COMPLETED", "FAILED", "RETRYING"
TASK_STATES = (QUEUED, PROCESSING, COMPLETED, FAILED, RETRYING)
PENDING = (QUEUED, PROCESSING, RETRYING)
JOB_STATES = ("IDLE", "RUNNING", "PAUSED", "CANCELLED", "COMPLETED", "FAILED")

SOURCE = "source string, kind string, content binary"
PAGE_IMAGE = "doc_id string, page_no int, total_pages int, width int, height int, mode string, data binary"
PAGE_RESULT = "page int, total_pages int, text string"
TASK = (
    "task_id string, source_path string, status string, retries int, max_retries int, created_at double, started_at double,"
    " completed_at double, duration_sec double, error string, result_text string, output_path string, page_count int"
)
METRICS = (
    "status string, total_files long, processed_files long, failed_files long, queued_files long, active_workers int, target_workers int,"
    " processing_speed_fps double, elapsed_time_sec double, eta_sec double, cpu_percent double, ram_used_gb double, ram_total_gb double,"
    " vram_used_gb double, vram_total_gb double, gpu_name string, model_id string, output_format string"
)
MODEL = (
    "ordinal int, id string, display_name string, category string, parameters string, use_cases array<string>, min_vram_gb double,"
    " min_recommendation string, cpu_supported boolean, is_default boolean, hf_repo_id string, description string, download_size_gb double"
)
GPU = "index int, name string, vram_total_gb double, vram_free_gb double, cuda_available boolean"
_GPU_STRUCT = ", ".join(f.replace(" ", ": ", 1) for f in GPU.split(", "))
PROFILE = (
    "os_name string, python_version string, torch_version string, cuda_available boolean, cuda_version string, system_cuda_version string,"
    f" gpus array<struct<{_GPU_STRUCT}>>, primary_gpu_name string, primary_vram_gb double, cpu_name string, cpu_physical_cores int,"
    " cpu_logical_cores int, ram_total_gb double, device_type string"
)
URL_REQUEST = "image_url string, prompt string, max_new_tokens int"
RECONFIGURE = "workers int, output_format string, retries int"


@dataclass(frozen=True)
class JobOptions:
    """Options of a batch job."""

    output_dir: str = "./batch_output"
    model_id: str = "glm-ocr"
    workers: int = 4
    output_format: str = "json"
    retries: int = 2
    dpi: int = 200
    device: str | None = None
    enable_dashboard: bool = True
    dashboard_port: int = 8765
    dashboard_host: str = "127.0.0.1"
    recursive: bool = True
    prompt: str | None = None
    max_new_tokens: int = 2048
