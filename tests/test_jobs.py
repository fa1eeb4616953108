import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from pagemill import batch, hardware
from pagemill.cache import ModelCache
from pagemill.cli import main
from pagemill.errors import UnknownModelError
from pagemill.http import LogBuffer, serve
from pagemill.operators import catalog
from pagemill.schema import JobOptions
from pagemill.sources import files, kinds, sinks
from pagemill.streaming import jobs


@pytest.fixture
def tree(tmp_path):
    for name in ("A.PNG", "_e.png", ".f.png", ".hid/h.png", "sub/g.tif", "d.txt", "a/x.pdf", "a-b/x.pdf"):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"page of {name}\nsecond")
    return tmp_path


def test_discovery_finds_hidden_names_once_in_component_order(spark, tree):
    root = str(tree / "in")
    found = [r.path.removeprefix(root + "/") for r in files.discover(spark, [root, f"{root}/A.PNG", f"{root}/missing"]).collect()]
    assert found == sorted(["A.PNG", "_e.png", ".f.png", ".hid/h.png", "sub/g.tif", "a/x.pdf", "a-b/x.pdf"], key=lambda p: p.split("/"))
    flat = [r.path for r in files.discover(spark, root, recursive=False).collect()]
    assert {p.rsplit("/", 1)[1] for p in flat} == {"A.PNG", "_e.png", ".f.png"}
    assert files.discover(spark, f"{root}/missing").isEmpty()


def test_document_source(spark, tree):
    spark.dataSource.register(files.DocumentSource)
    rows = spark.read.format("documents").option("filesPerPartition", "2").load(str(tree / "in")).collect()
    assert len(rows) == 7 and all(r.length == len(r.content) for r in rows)


def test_numbering_is_the_global_order(spark):
    paths = [f"/{a}/{b}/{k}.pdf" for a in ("x", "y-z", "y") for b in ("s", "t") for k in range(20)]
    rows = kinds.numbered(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.ordinal)] == sorted(paths, key=lambda p: p.split("/"))
    assert sorted(r.ordinal for r in rows) == list(range(1, len(paths) + 1))


@pytest.mark.parametrize("fmt", ["json", "markdown", "csv", "txt"])
def test_job_end_to_end(spark, tree, fmt):
    out = tree / f"out-{fmt}"
    table = batch.run(spark, str(tree / "in"), JobOptions(output_dir=str(out), output_format=fmt))
    rows = table.collect()
    assert len(rows) == 7 and {r.status for r in rows} == {"COMPLETED"}
    manifest = json.loads((out / sinks.MANIFEST).read_text())
    assert manifest["batch_summary"]["total_files"] == 7 and len(manifest["tasks"]) == 7
    written = [p for p in out.iterdir() if p.is_file() and p.name != sinks.MANIFEST and not p.name.startswith(".")]
    assert len([r for r in rows if r.output_path]) == 7
    assert sum("ocr:page of" in p.read_text() for p in out.iterdir() if p.is_file() and p.name != sinks.MANIFEST and "_ocr" in p.name) == 7
    assert len(written) >= 6


def test_nothing_to_do_writes_nothing(spark, tmp_path):
    assert batch.run(spark, str(tmp_path / "none"), JobOptions(output_dir=str(tmp_path / "o"))).isEmpty()
    assert not (tmp_path / "o").exists()


def test_overwriting_keeps_the_last_row(spark, tmp_path):
    df = spark.createDataFrame([("1", "a.txt", "old", 1), ("2", "a.txt", "new", 2)], "task_id string, output_name string, body string, at int")
    assert [r.task_id for r in sinks.write_documents(df, str(tmp_path), collisions="overwrite", order="at").collect()] == ["2"]
    assert (tmp_path / "a.txt").read_text() == "new"


def test_streamed_counts_equal_the_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = jobs.status_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in jobs.status_counts(spark.read.parquet(str(folder)), "event_type").collect()}


def test_streamed_retries(spark, tmp_path):
    rows = [(1, True, None, 0), (2, False, "x", 0), (2, True, None, 1), (3, False, "x", 0), (3, False, "y", 1), (3, False, "z", 2)]
    schema = "task_id long, ok boolean, error string, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "a"))
    q = jobs.retry_states(stream, 2).writeStream.outputMode("update").format("memory").queryName("retried").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("retried").collect()} == {(1, "COMPLETED", 0, None), (2, "COMPLETED", 1, "Retrying attempt 1/2: x"), (3, "FAILED", 2, "z")}


def test_job_control_and_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    control, seen = jobs.JobControl(), []
    control.reconfigure(workers=2, output_format="csv")
    q = jobs.run_job(stream, lambda df, o: df.groupBy().count(), lambda df, n: seen.append(df.first()[0]), str(tmp_path / "cp"), control)
    q.awaitTermination()
    assert sum(seen) == 1000 and control.options.output_format == "csv"
    control.pause()
    assert control.status == "PAUSED"
    control.resume()
    control.cancel()
    assert control.status == "CANCELLED"
    with pytest.raises(ValueError):
        control.reconfigure(workers=0)


def test_http_adapter(tmp_path):
    log, control = LogBuffer(keep=3), jobs.JobControl(status="RUNNING")
    for k in range(5):
        log.add(f"line {k}")
    server = serve(control, lambda: {"status": control.status}, lambda: [{"task_id": "1"}], log, lambda: 2, port=0, period=0.05)
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p, data=None: urllib.request.urlopen(urllib.request.Request(base + p, data=data, method="POST" if data is not None else "GET"), timeout=5)
    with get("/api/stream") as stream:  # an open stream doesn't block the rest
        assert stream.readline() == b"event: metrics\n"
        assert json.load(get("/api/status")) == {"status": "RUNNING"}
        assert len(json.load(get("/api/logs?n=1"))) == 3
        assert json.load(get("/api/pause", b""))["ok"] and control.status == "PAUSED"
        assert json.load(get("/api/reconfigure", b'{"workers": 3}'))["ok"] and control.options.workers == 3
        with pytest.raises(urllib.error.HTTPError) as e:
            get("/api/reconfigure", b"{broken")
        assert e.value.code == 400
        with pytest.raises(urllib.error.HTTPError) as e:
            get("/nope")
        assert e.value.code == 404
    server.stopped.set()
    server.shutdown()


def test_log_sequence_numbers_go_on_after_trimming():
    log = LogBuffer(keep=500)
    for k in range(700):
        log.add(str(k))
    assert [s for s, _ in log.since(690)] == list(range(690, 700))


def test_catalog_and_cache(tmp_path):
    assert catalog.get("GLM-OCR")[0] == catalog.get("glm_ocr")[0] == "glm-ocr" and catalog.get("LightOnOCR")[0] == "lighton-ocr"
    assert catalog.is_registered("smolvlm") and not catalog.is_registered("SmolVLM-256M")
    with pytest.raises(UnknownModelError, match="glm-ocr"):
        catalog.get("gpt-vision")
    cache = ModelCache(tmp_path)
    assert not cache.is_installed("GLM OCR")
    cache.download("GLM OCR", lambda repo, folder: (folder / "w.bin").write_bytes(b"x" * 1024))
    assert cache.installed() == ["glm-ocr"] and cache.remove("glm-ocr") and not cache.remove("glm-ocr")


def test_command_line(tmp_path, capsys):
    root = ["--cache", str(tmp_path)]
    assert main([*root, "models"]) == 0 and "glm-ocr" in capsys.readouterr().out
    assert main([*root, "model", "info", "GLM OCR"]) == 0
    assert main([*root, "model", "install", "bad-model"]) == 1
    assert main([*root, "model", "remove", "smolvlm"]) == 0
    assert main([*root, "doctor"]) == 0
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0


def test_probe_parsing():
    assert [g["name"] for g in hardware.parse_gpus("0, A, 1024, 512\n1, B\n2, C, N/A, 1\n3, D, 2048, 1")] == ["A", "D"]
    assert hardware.cpu_name("x\nmodel name\t: Fast CPU\nmodel name: Other") == "Fast CPU"
    assert hardware.os_name("Windows", "10", 22631) == "Windows 11"
