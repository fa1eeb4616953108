"""Command line: models, model, doctor, read, serve, batch, hardware, info."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pagemill import __version__, hardware
from pagemill.cache import ModelCache
from pagemill.errors import PagemillError
from pagemill.functions.rules import TIERS, UNKNOWN
from pagemill.operators import catalog
from pagemill.schema import JobOptions


# Packages that recognition needs beside this one.
REQUIRED = ("torch", "transformers", "PIL", "pypdfium2", "pyspark", "pyarrow", "psutil")


def suitability(model: str, vram: float, cuda: bool) -> tuple[str, str]:
    """Level and note of a model on one machine, by the same tiers as the Column rule."""
    if model not in TIERS:
        return UNKNOWN
    tiers, without = TIERS[model]
    if not cuda:
        return without
    return next((level, note) for least, above, level, note in tiers if least is None or (vram > least if above else vram >= least))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--cache", default=str(Path.home() / ".cache" / "pagemill"))
    sub = p.add_subparsers(dest="command")
    sub.add_parser("models", help="list the catalog")
    model = sub.add_parser("model", help="one model").add_subparsers(dest="action", required=True)
    for action in ("install", "remove", "info"):
        model.add_parser(action).add_argument("name")
    for name in ("doctor", "hardware", "info"):
        sub.add_parser(name)
    for name, what in (("read", "recognise one document"), ("serve", "answer requests over HTTP"), ("batch", "recognise a folder")):
        command = sub.add_parser(name, help=what)
        command.add_argument("--model", default="glm-ocr")
        command.add_argument("--device", choices=["cuda", "cpu"])
        command.add_argument("--stand-in", action="store_true", help="text stand-in instead of the model")
        if name != "serve":
            command.add_argument("source")
            command.add_argument("--prompt")
            command.add_argument("--dpi", type=int, default=200)
            command.add_argument("--max-new-tokens", type=int)
        if name == "read":
            command.add_argument("--page", type=int, action="append")
            command.add_argument("--output")
        elif name == "serve":
            command.add_argument("--host", default="127.0.0.1")
            command.add_argument("--port", type=int, default=8000)
        else:
            command.add_argument("--workers", type=int, default=4)
            command.add_argument("--format", default="json", choices=["json", "markdown", "csv", "txt"])
            command.add_argument("--output", default="./batch_output")
            command.add_argument("--retries", type=int, default=2)
            command.add_argument("--port", type=int, default=8765)
            command.add_argument("--no-dashboard", action="store_true")
            command.add_argument("--no-recursive", action="store_true")
    return p


def _engine(options: argparse.Namespace, cache: ModelCache):
    from pagemill.engine import Engine
    from pagemill.operators.recognise import EchoRecogniser

    return Engine(options.model, options.device, cache=cache, recogniser=EchoRecogniser() if options.stand_in else None)


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    cache = ModelCache(options.cache)
    try:
        return _run(options, cache)
    except (PagemillError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(options: argparse.Namespace, cache: ModelCache) -> int:
    if options.command == "models":
        for m in catalog.MODELS:
            print(f"{m[0]:12} {m[1]:14} {m[3]:6} {m[6]:10} {'installed' if cache.is_installed(m[0]) else ''}{' [Default]' if m[8] else ''}")
    elif options.command == "model":
        model = catalog.get(options.name)
        if options.action == "info":
            print(json.dumps(dict(zip(("id", "display_name", "category", "parameters", "use_cases", "min_vram_gb"), model, strict=False)) | {"installed": cache.is_installed(model[0]), "disk_gb": cache.disk_usage_gb(model[0])}, indent=2))
        elif options.action == "remove":
            print("removed" if cache.remove(model[0]) else "not installed")
        else:
            print(cache.download(model[0]))
    elif options.command == "doctor":
        profile = hardware.inspect()
        for m in catalog.MODELS:
            print(f"{m[0]:12} {': '.join(x for x in suitability(m[0], profile['primary_vram_gb'], profile['cuda_available']) if x)}")
    elif options.command == "hardware":
        print(json.dumps(hardware.inspect(), indent=2))
    elif options.command == "info":
        print(json.dumps({"version": __version__, "missing_packages": hardware.missing_packages(REQUIRED), **hardware.inspect()}, indent=2))
    elif options.command == "read":
        more = {"prompt": options.prompt} if options.prompt else {}
        found = _engine(options, cache).read(options.source, page=options.page, dpi=options.dpi, max_new_tokens=options.max_new_tokens, **more)
        if options.output:
            Path(options.output).write_text(found, encoding="utf-8")
        else:
            print(found)
    elif options.command == "serve":
        from pagemill import service

        engine = _engine(options, cache)
        engine.load()
        print(f"serving on http://{options.host}:{options.port}")
        service.serve(service.create_app(engine), options.host, options.port, block=True)
    elif options.command == "batch":
        from pyspark.sql import SparkSession

        from pagemill import backends, batch
        from pagemill.job import lines
        from pagemill.operators.recognise import EchoRecogniser

        job = JobOptions(
            output_dir=options.output, model_id=catalog.get(options.model)[0], workers=options.workers, output_format=options.format, retries=options.retries, dpi=options.dpi, device=options.device,
            recursive=not options.no_recursive, enable_dashboard=not options.no_dashboard, dashboard_port=options.port, prompt=options.prompt, max_new_tokens=options.max_new_tokens or JobOptions.max_new_tokens,
        )
        factory = EchoRecogniser if options.stand_in else backends.factory(options.model, options.device)
        pager = lines if options.stand_in else batch.rendered_pages(options.dpi)
        counts = {r["status"]: r["count"] for r in batch.run(SparkSession.builder.getOrCreate(), options.source, job, pager, factory).groupBy("status").count().collect()}
        print(f"completed {counts.get('COMPLETED', 0)}, failed {counts.get('FAILED', 0)}")
    else:
        parser().print_help()
    return 0


if __name__ == "__main__":
    sys.exit(main())
