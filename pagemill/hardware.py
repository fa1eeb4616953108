"""What the driver's machine has: processor, memory, GPUs. Text is parsed by the same rules as the Column functions' tables."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import platform
import re
import shutil
import subprocess
import sys

QUERY = ["nvidia-smi", "--query-gpu=index,name,memory.total,memory.free", "--format=csv,noheader,nounits"]


def parse_gpus(output: str) -> list[dict]:
    """GPUs of ``index, name, total MB, free MB`` lines; short and non-numeric lines are left out."""
    found = []
    for line in output.strip().splitlines():
        parts = [p.strip() for p in line.split(",")]
        try:
            index, name, total, free = int(parts[0]), parts[1], float(parts[2]), float(parts[3])
        except (ValueError, IndexError):
            continue
        found.append({"index": index, "name": name, "vram_total_gb": round(total / 1024, 2), "vram_free_gb": round(free / 1024, 2), "cuda_available": False})
    return found


def cpu_name(text: str) -> str | None:
    """The first model name of a cpuinfo text."""
    m = re.search(r"^model name\s*:\s*(.+)$", text, re.M)
    return m[1].strip() if m else None


def os_name(system: str, release: str, build: int = 0) -> str:
    if system == "Windows":
        return "Windows 11" if build >= 22000 else f"Windows {release}"
    return f"macOS {release}" if system == "Darwin" else f"{system} {release}"


def _tool(args: list[str]) -> str:
    if not shutil.which(args[0]):
        return ""
    try:
        done = subprocess.run(args, capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout if done.returncode == 0 else ""


def _torch_gpus() -> list[dict] | None:
    """GPUs as torch sees them, or None where it isn't there or sees none."""
    try:
        import torch

        if not torch.cuda.is_available():
            return None
        out = []
        for k in range(torch.cuda.device_count()):
            free, total = torch.cuda.mem_get_info(k)
            out.append({"index": k, "name": torch.cuda.get_device_name(k), "vram_total_gb": round(total / 1024**3, 2), "vram_free_gb": round(free / 1024**3, 2), "cuda_available": True})
        return out
    except Exception:  # a broken driver is no GPU
        return None


def _gputil_gpus() -> list[dict] | None:
    try:
        import GPUtil

        return [{"index": g.id, "name": g.name, "vram_total_gb": round(g.memoryTotal / 1024, 2), "vram_free_gb": round(g.memoryFree / 1024, 2), "cuda_available": False} for g in GPUtil.getGPUs()] or None
    except Exception:
        return None


#: Probes for GPUs in the order they are asked; the first that finds any answers.
PROBES = (_torch_gpus, _gputil_gpus, lambda: parse_gpus(_tool(QUERY)) or None)


def find_gpus(probes=PROBES) -> list[dict]:
    return next((found for probe in probes if (found := probe())), [])


def gauges() -> dict:
    """Processor, memory and video memory in use just now, by the names of schema.METRICS."""
    import psutil

    memory, gpu = psutil.virtual_memory(), next(iter(find_gpus()), None)
    total = gpu["vram_total_gb"] if gpu else 0.0
    return {
        "cpu_percent": round(psutil.cpu_percent(interval=None), 1), "ram_used_gb": round(memory.used / 1024**3, 2), "ram_total_gb": round(memory.total / 1024**3, 2),
        "vram_used_gb": round(total - gpu["vram_free_gb"], 2) if gpu else 0.0, "vram_total_gb": total, "gpu_name": gpu["name"] if gpu else None,
    }


def missing_packages(required: tuple[str, ...]) -> list[str]:
    """Those of ``required`` that can't be imported here."""
    return [name for name in required if importlib.util.find_spec(name) is None]


def _torch_cuda() -> str | None:
    import torch

    return torch.version.cuda


def _version(package: str) -> str | None:
    try:
        return importlib.metadata.version(package)
    except importlib.metadata.PackageNotFoundError:
        return None


def inspect() -> dict:
    """The driver's hardware profile (see schema.PROFILE)."""
    import psutil

    gpus = find_gpus()
    cuda = any(g["cuda_available"] for g in gpus)
    version = re.search(r"CUDA Version:\s*([0-9]+\.[0-9]+)", _tool(["nvidia-smi"]))
    try:
        with open("/proc/cpuinfo") as f:
            processor = cpu_name(f.read())
    except OSError:
        processor = None
    first = gpus[0] if gpus else {}
    return {
        "os_name": os_name(platform.system(), platform.release()), "python_version": sys.version.split()[0], "torch_version": _version("torch"), "cuda_available": cuda, "cuda_version": _torch_cuda() if cuda else None,
        "system_cuda_version": version[1] if version else None, "gpus": gpus, "primary_gpu_name": first.get("name"), "primary_vram_gb": first.get("vram_total_gb", 0.0),
        "cpu_name": processor or platform.processor() or "unknown", "cpu_physical_cores": psutil.cpu_count(logical=False), "cpu_logical_cores": psutil.cpu_count(), "ram_total_gb": round(psutil.virtual_memory().total / 1024**3, 2), "device_type": "cuda" if cuda else "cpu",
    }
