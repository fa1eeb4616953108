"""Single documents, the HTTP service, the controlled batch job and its callbacks, the command line."""

import http.server
import io
import json
import sys
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill import backends, hardware, service
from pagemill.batch import rendered_pages
from pagemill.batch import run as run_batch
from pagemill.cache import ModelCache
from pagemill.cli import main, suitability
from pagemill.engine import Engine, chosen
from pagemill.errors import BackendUnavailableError, DownloadError, ModelNotInstalledError, UnknownModelError
from pagemill.functions import rules
from pagemill.job import BatchJob
from pagemill.operators import recognise
from pagemill.operators.prompts import TASK_PROMPTS
from pagemill.operators.recognise import EchoRecogniser, Recogniser
from pagemill.operators.tasks import job_metrics
from pagemill.schema import METRICS, JobOptions
from pagemill.sources import content, files


class Recording(Recogniser):
    """Gives back what it was asked, and counts its loads."""

    def __init__(self):
        self.loads, self.asked = 0, []

    def load(self):
        self.loads += 1

    def predict(self, page, prompt=None, max_new_tokens=512):
        self.asked.append((page, prompt, max_new_tokens))
        return f"<{page.decode() if isinstance(page, bytes) else page}>"


def pages_of(data, dpi, pages):
    return data.decode().split("\n")[1:]


PDF = b"%PDF\nfirst\nsecond\nthird"


@pytest.fixture
def engine():
    return Engine("smolvlm", recogniser=Recording(), render=pages_of)


# ---------------------------------------------------------------- sources


def test_sources_of_every_kind(tmp_path):
    path = tmp_path / "a.png"
    path.write_bytes(b"x")
    assert content.load(path).data == content.load(str(path)).data == content.load(b"x").data == content.load(io.BytesIO(b"x")).data == b"x"
    assert not content.load(path).is_pdf and content.load(PDF).is_pdf
    (tmp_path / "b.PDF").write_bytes(b"not really")
    assert content.load(tmp_path / "b.PDF").is_pdf
    with pytest.raises(FileNotFoundError):
        content.load(tmp_path / "missing.png")
    with pytest.raises(FileNotFoundError):
        content.load(tmp_path)
    with pytest.raises(ValueError, match="int"):
        content.load(5)
    assert list(content.flatten(["a", ["b", ("c", ["d"])], []])) == ["a", "b", "c", "d"]


@pytest.fixture
def site():
    class Files(http.server.BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):
            body = {"/page.png": b"image", "/paper.pdf": PDF, "/odd": PDF}.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_url_sources(site, engine):
    assert content.load(f"{site}/page.png").data == b"image"
    assert content.load(f"{site}/paper.pdf").is_pdf and content.load(f"{site}/odd").is_pdf
    with pytest.raises(OSError):
        content.load(f"{site}/none.png")
    assert engine.read(f"{site}/page.png") == "<image>"


# ---------------------------------------------------------------- the engine


def test_engine_loads_once_and_when_needed(engine, tmp_path):
    assert not engine.is_loaded and engine.model_id == "smolvlm" and engine.model_name == "SmolVLM-256M" and "idle" in repr(engine)
    assert engine.read(b"x") == "<x>" and engine.is_loaded and "loaded" in repr(engine)
    engine.read(b"y", prompt="p", max_new_tokens=7)
    assert engine._recogniser.loads == 1 and engine._recogniser.asked[-1] == (b"y", "p", 7)


def test_engine_reads_pages(engine):
    assert engine.read(PDF) == "--- Page 1 ---\n<first>\n\n--- Page 2 ---\n<second>\n\n--- Page 3 ---\n<third>"
    assert engine.read(PDF, page=2) == "<second>"
    assert engine.read(PDF, page=[3, 1]) == "--- Page 3 ---\n<third>\n\n--- Page 1 ---\n<first>"
    assert engine.read_pdf(PDF, max_pages=2) == [{"page": 1, "total_pages": 3, "text": "<first>"}, {"page": 2, "total_pages": 3, "text": "<second>"}]
    assert chosen(3, [9]) == [1, 2, 3] and chosen(3, 0) == [1, 2, 3] and chosen(0, None) == []
    assert engine.batch_read([b"a", [b"b"]]) == ["<a>", "<b>"]


def test_engine_tasks(engine):
    for task, call in (("table", engine.extract_table), ("formula", engine.extract_formula), ("json", engine.extract_json)):
        call(b"x")
        assert engine._recogniser.asked[-1][1] == TASK_PROMPTS[task]
    engine.extract_json(b"x", '{"a": 1}')
    assert engine._recogniser.asked[-1][1].endswith('{"a": 1}')


def test_engine_models(tmp_path):
    cache = ModelCache(tmp_path)
    with pytest.raises(UnknownModelError):
        Engine("gpt-vision", cache=cache)
    with pytest.raises(ModelNotInstalledError):
        Engine("smolvlm", cache=cache, auto_download=False)
    with pytest.raises(DownloadError):
        Engine("smolvlm", cache=cache)
    fetched = []
    assert Engine(cache=cache, fetch=lambda repo, folder: (fetched.append(repo), (folder / "w").write_bytes(b"1"))).model_id == "glm-ocr"
    assert len(fetched) == 1 and Engine.ensure("GLM OCR", cache).name == "glm-ocr" and len(fetched) == 1


def test_backends_are_found_by_id_and_import_late():
    model = backends.factory("SmolVLM-256M", "cpu")()
    assert model.model_id == "smolvlm" and model.limits.max_new_tokens == 512 and model.device_requirements()["min_vram_gb"] == 2.0
    assert backends.choose_device("cuda") == "cuda" and backends.choose_device(None) in ("cpu", "cuda")
    if hardware.missing_packages(("transformers",)):
        with pytest.raises(BackendUnavailableError, match="transformers"):
            model.load()
    backends.register("hunyuan-ocr", lambda device: EchoRecogniser())
    try:
        assert backends.factory("HunyuanOCR")().predict(" x ") == "ocr:x"
    finally:
        backends._REGISTERED.clear()


# ---------------------------------------------------------------- the service


def multipart(**fields):
    out = b""
    for name, value in fields.items():
        file, raw = value if isinstance(value, tuple) else (None, value)
        head = f'form-data; name="{name}"' + (f'; filename="{file}"' if file is not None else "")
        out += b"--edge\r\nContent-Disposition: " + head.encode() + b"\r\n\r\n" + (raw if isinstance(raw, bytes) else raw.encode()) + b"\r\n"
    return "multipart/form-data; boundary=edge", out + b"--edge--\r\n"


def test_service_over_http(engine, site):
    app = service.create_app()
    server = service.serve(app, port=0)
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, kind=None, body=None):
        request = urllib.request.Request(base + path, data=body, headers={"Content-Type": kind} if kind else {})
        try:
            with urllib.request.urlopen(request, timeout=10) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/")[1]["status"] == "online" and call("/")[1]["device"] == "unknown"
        assert call("/api/v1/health") == (200, {"status": "initializing", "model_id": None, "device": None, "is_cuda": False})
        assert call("/api/v1/ocr", *multipart(file=("a.png", b"x")))[0] == 503
        app.engine = engine
        assert call("/api/v1/health")[1]["status"] == "initializing"
        engine.load()
        assert call("/api/v1/health")[1] == {"status": "healthy", "model_id": "smolvlm", "device": engine.device, "is_cuda": engine.device == "cuda"}
        assert call("/api/v1/hardware")[1]["cpu_logical_cores"] >= 1
        status, body = call("/api/v1/ocr", *multipart(file=("a.png", b"bytes \xc3\xa9"), prompt="ask", max_new_tokens="9"))
        assert status == 200 and body["execution_time_seconds"] >= 0
        assert {k: v for k, v in body.items() if k != "execution_time_seconds"} == {"status": "success", "is_pdf": False, "text": "<bytes é>", "device_used": engine.device}
        assert engine._recogniser.asked[-1][1:] == ("ask", 9)
        body = call("/api/v1/ocr", *multipart(file=("a.PDF", PDF)))[1]
        assert body["is_pdf"] and [p["text"] for p in body["pages"]] == ["<first>", "<second>", "<third>"]
        assert call("/api/v1/ocr", "application/x-www-form-urlencoded", f"image_url={site}/page.png".encode())[1]["text"] == "<image>"
        assert call("/api/v1/ocr", *multipart(prompt="x"))[0] == 400
        assert call("/api/v1/ocr", *multipart(file=("a.png", b"x"), max_new_tokens="many"))[0] == 422
        assert call("/api/v1/ocr", *multipart(image_url="/etc/passwd"))[0] == 400
        payload = lambda **x: ("application/json", json.dumps(x).encode())
        assert call("/api/v1/ocr/json-payload", *payload(image_url=f"{site}/paper.pdf"))[1]["is_pdf"]
        assert call("/api/v1/ocr/json-payload", *payload(prompt="x"))[0] == 422
        assert call("/api/v1/ocr/json-payload", "application/json", b"{broken")[0] == 422
        assert call("/api/v1/ocr/json-payload", *payload(image_url=f"{site}/none.png"))[0] == 500
        assert call("/nope")[0] == 404 and call("/api/v1/health", "text/plain", b"x")[0] == 405
    finally:
        server.shutdown()


# ---------------------------------------------------------------- the batch job


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


class Slow(EchoRecogniser):
    """As slow as the page says, and unable to read some."""

    def predict(self, page, prompt=None, max_new_tokens=512):
        if "bad" in page:
            raise ValueError("unreadable")
        time.sleep(float(page.split()[-1]))
        return f"{page}|{prompt}|{max_new_tokens}"


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        (tmp_path / f"d{k}.png").write_text(f"page {0.02 + 0.06 * (k % 2)}")
    (tmp_path / "e.png").write_text("bad")
    return tmp_path


def test_job_measures_calls_back_and_uses_its_options(spark, folder):
    done, lost = [], []
    options = JobOptions(output_dir=str(folder / "out"), workers=3, retries=1, enable_dashboard=False, prompt="ask", max_new_tokens=77, output_format="txt")
    job = BatchJob(spark, str(folder), options, factory=Slow, on_complete=done.append, on_failed=lost.append, per_wave=3)
    rows = {r.source_path.split("/")[-1]: r for r in job.run().collect()}
    assert len(rows) == 7 and len(done) == 6 and [t["file_name"] for t in lost] == ["e.png"]
    took = [rows[f"d{k}.png"].duration_sec for k in range(6)]
    assert all(t > 0 for t in took) and min(took[1::2]) > max(took[0::2]) and len(set(took)) == 6
    assert all(r.started_at <= r.completed_at and r.created_at <= r.started_at for r in rows.values())
    assert rows["e.png"].status == "FAILED" and rows["e.png"].retries == 1 and rows["e.png"].error == "unreadable"
    assert rows["d0.png"].result_text.endswith("|ask|77") and rows["d0.png"].output_path.endswith(".txt")
    m = job.metrics()
    assert list(m) == [f.split()[0] for f in METRICS.split(", ")]
    assert (m["status"], m["total_files"], m["processed_files"], m["failed_files"], m["queued_files"], m["target_workers"]) == ("COMPLETED", 7, 6, 1, 0, 3)
    assert m["processing_speed_fps"] > 0 and m["ram_total_gb"] > 0
    manifest = json.loads((folder / "out" / "batch_manifest.json").read_text())
    assert manifest["batch_summary"]["completed_files"] == 6
    assert any("Discovered 7" in line for line in job.log.tail()) and len(job.tasks()) == 7


def test_a_listener_s_failure_is_not_the_job_s(spark, folder):
    job = BatchJob(spark, str(folder), JobOptions(output_dir=str(folder / "out"), enable_dashboard=False), factory=Slow, on_complete=lambda t: 1 / 0)
    assert job.run().count() == 7 and any("Callback error" in line for line in job.log.tail())


def test_a_running_job_is_paused_reconfigured_resumed_and_cancelled(spark, folder):
    seen = []
    job = BatchJob(spark, str(folder), JobOptions(output_dir=str(folder / "out"), workers=2, enable_dashboard=False), factory=Slow, per_wave=1)

    def first(task):
        seen.append(task["file_name"])
        if len(seen) == 2:
            job.pause()

    job.on_complete = first
    result = {}
    thread = threading.Thread(target=lambda: result.update(table=job.run().collect()))
    thread.start()
    for _ in range(600):
        if job.status == "PAUSED":
            break
        time.sleep(0.1)
    time.sleep(1)
    assert job.status == "PAUSED" and len(seen) == 2 and job.metrics()["queued_files"] == 5 and thread.is_alive()
    job.reconfigure(workers=1, output_format="csv")
    job.resume()
    for _ in range(600):
        if len(seen) >= 3:
            break
        time.sleep(0.1)
    job.cancel()
    thread.join(120)
    assert not thread.is_alive() and job.status == "CANCELLED" and 3 <= len(result["table"]) < 7
    paths = [r.output_path for r in sorted(result["table"], key=lambda r: r.completed_at)]
    assert paths[0].endswith(".json") and paths[2].endswith(".csv")
    with pytest.raises(ValueError):
        job.reconfigure(workers=0)


def test_failed_tasks_are_queued_again(spark, folder):
    job = BatchJob(spark, str(folder), JobOptions(output_dir=str(folder / "out"), enable_dashboard=False, retries=0), factory=Slow)
    assert job.retry_failed() == 0
    calls = []

    def lost(task):
        calls.append(task["file_name"])
        if len(calls) == 1:
            (folder / "e.png").write_text("page 0.01")
            assert job.retry_failed() == 1

    job.on_failed = lost
    rows = job.run().collect()
    assert calls == ["e.png"] and len(rows) == 7 and {r.status for r in rows} == {"COMPLETED"} and job.metrics()["failed_files"] == 0


def test_the_dashboard_belongs_to_the_job(spark, folder):
    job = BatchJob(spark, str(folder), JobOptions(output_dir=str(folder / "out"), dashboard_port=0), factory=Slow)
    answers = []

    def ask(task):
        if not answers:
            base = f"http://127.0.0.1:{job.server.server_address[1]}"
            answers.append(json.load(urllib.request.urlopen(f"{base}/api/status", timeout=10)))
            answers.append(json.load(urllib.request.urlopen(urllib.request.Request(f"{base}/api/reconfigure", data=b'{"retries": 5}'), timeout=10)))

    job.on_complete = ask
    job.run()
    assert answers[0]["status"] == "RUNNING" and answers[0]["total_files"] == 7 and answers[1]["ok"] and job.options.retries == 5
    with pytest.raises(urllib.error.URLError):
        urllib.request.urlopen(f"http://127.0.0.1:{job.server.server_address[1]}/api/status", timeout=2)


def test_nothing_to_do(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run_batch(spark, str(tmp_path / "in"), JobOptions(output_dir=str(tmp_path / "out"), enable_dashboard=False)).count() == 0
    assert not (tmp_path / "out" / "batch_manifest.json").exists()


def test_a_page_that_fails_is_a_value(spark):
    df = spark.createDataFrame([(1, "page 0"), (2, "bad"), (3, None)], "n int, page string")
    got = {r.n: (r.text, r.why) for r in recognise.recognise_pages(df, "page", "text", Slow, error="why").collect()}
    assert got[1][0].startswith("page 0") and got[2] == (None, "unreadable") and got[3] == (None, None)


def test_rendered_pages_without_a_renderer(spark):
    df = spark.createDataFrame([("a.png", b"image", None), ("b.pdf", PDF, None), ("c.png", None, "gone")], "path string, content binary, error string")
    got = {r.path: r for r in rendered_pages(200)(df).collect()}
    assert [bytes(p) for p in got["a.png"].pages] == [b"image"] and got["c.png"].error == "gone" and got["c.png"].pages is None
    if hardware.missing_packages(("pypdfium2",)):
        assert "pypdfium2" in got["b.pdf"].error


def test_metrics_table_has_all_fields(spark):
    rows = spark.createDataFrame([("COMPLETED",), ("PROCESSING",), ("FAILED",), ("QUEUED",)], "status string")
    m = job_metrics(rows, 2.0, "RUNNING", JobOptions(workers=5), {"cpu_percent": 1.26, "gpu_name": None})
    assert set(m.columns) == {f.split()[0] for f in METRICS.split(", ")}
    r = m.first()
    assert (r.active_workers, r.target_workers, r.cpu_percent, r.gpu_name, r.eta_sec) == (1, 5, 1.3, None, 4.0)


# ---------------------------------------------------------------- command line and machine


def test_read_command(tmp_path, capsys):
    (tmp_path / "a.png").write_text(" words ")
    assert main(["read", "--stand-in", str(tmp_path / "a.png")]) == 0 and capsys.readouterr().out == "ocr:words\n"
    assert main(["read", "--stand-in", str(tmp_path / "a.png"), "--output", str(tmp_path / "o.txt")]) == 0 and (tmp_path / "o.txt").read_text() == "ocr:words"
    assert main(["read", "--stand-in", str(tmp_path / "none.png")]) == 1
    assert main(["--cache", str(tmp_path), "read", str(tmp_path / "a.png")]) == 1  # not installed, and nothing to fetch with
    assert main(["info"]) == 0 and "missing_packages" in json.loads(capsys.readouterr().out)


def test_suitability_has_one_rule(spark):
    grid = [(m, v, c) for m in [*rules.TIERS, "other"] for v in (0.0, 0.5, 2.0, 3.9, 4.0, 6.0, 7.9, 8.0, 24.0) for c in (True, False)]
    df = spark.createDataFrame(grid, "m string, v double, c boolean")
    for r in df.withColumn("rule", rules.suitability(F.col("m"), F.col("v"), F.col("c"))).collect():
        assert (r.rule.level, r.rule.note) == suitability(r.m, r.v, r.c)


def test_probes_are_asked_in_order():
    asked = []
    probe = lambda name, found: lambda: (asked.append(name), found)[1]
    assert hardware.find_gpus((probe("a", None), probe("b", [{"name": "B"}]), probe("c", [{"name": "C"}]))) == [{"name": "B"}] and asked == ["a", "b"]
    assert hardware.find_gpus((probe("a", None),)) == [] and hardware.missing_packages(("json", "no_such_package_here")) == ["no_such_package_here"]
    assert set(hardware.gauges()) == {"cpu_percent", "ram_used_gb", "ram_total_gb", "vram_used_gb", "vram_total_gb", "gpu_name"}


def test_listing_and_reading_in_tasks(spark, tmp_path, site):
    (tmp_path / "x" / "y" / "_z").mkdir(parents=True)
    for name in ("a.png", ".b.PNG", "x/c.pdf", "x/y/d.jpg", "x/y/_z/.e.tif", "x/no.txt"):
        (tmp_path / name).write_bytes(b"12")
    every = files.discover(spark, [str(tmp_path), str(tmp_path / "a.png"), str(tmp_path / "missing")])
    assert [(r.path.removeprefix(f"{tmp_path}/"), r.length) for r in every.collect()] == [(n, 2) for n in (".b.PNG", "a.png", "x/c.pdf", "x/y/_z/.e.tif", "x/y/d.jpg")]
    assert files.discover(spark, str(tmp_path), recursive=False).count() == 2
    assert files.discover(spark, f"file://{tmp_path}/x").count() == 3
    assert files.discover(spark, str(tmp_path / "missing")).count() == 0
    paths = spark.createDataFrame([(f"{site}/page.png",), (f"{site}/none.png",), (str(tmp_path / "a.png"),), (str(tmp_path / "gone.png"),)], "path string")
    got = {r.path: r for r in files.read_content(paths).collect()}
    assert bytes(got[f"{site}/page.png"].content) == b"image" and got[f"{site}/none.png"].error and bytes(got[str(tmp_path / "a.png")].content) == b"12" and got[str(tmp_path / "gone.png")].error
