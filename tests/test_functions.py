import pytest
from pyspark.sql import functions as F

from pagemill.cli import suitability
from pagemill.functions import rules, text
from pagemill.operators import pages, recognise, tasks
from pagemill.sources import kinds


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_strip_and_clean_are_unicode_aware(spark):
    x = F.col("x")
    assert values(spark, text.strip(x), [("  a b ",), (None,)]) == ["a b", None]
    assert values(spark, text.clean_recognised(x), [("(4,22),(996,121) Title\n\n\n\nBody \t z (1, 2) ",), ("(٤,٢) x",)]) == ["Title\n\nBody z", "x"]


def test_preview_bounds(spark):
    rows = [("",), ("a" * 150,), ("ä" * 151,), (None,)]
    assert values(spark, text.preview(F.col("x")), rows) == ["", "a" * 150, "ä" * 150 + "...", None]


@pytest.mark.parametrize(("path", "stem", "suffix"), [("/a/a.tar.pdf", "a.tar", ".pdf"), ("/a/.pdf", ".pdf", ""), ("noext", "noext", ""), ("/d/a.", "a.", ""), ("/d/..x", ".", ".x")])
def test_path_parts(spark, path, stem, suffix):
    row = spark.createDataFrame([(path,)], "x string").select(text.stem(F.col("x")), text.suffix(F.col("x"))).first()
    assert tuple(row) == (stem, suffix)


def test_csv_field_is_minimal(spark):
    assert values(spark, text.csv_field(F.col("x")), [("a",), ("a,b",), ('q"q',), ("n\nl",), ("",)]) == ["a", '"a,b"', '"q""q"', '"n\nl"', ""]


@pytest.mark.parametrize(("vram", "cuda", "expected"), [(0, False, "ESSN"), (1, True, "NNNS"), (2, True, "SNNE"), (4, True, "SNNE"), (5.99, True, "SNNE"), (6, True, "ESSE"), (7.99, True, "ESSE"), (8, True, "EEEE")])
def test_doctor_tiers(spark, vram, cuda, expected):
    models = ("glm-ocr", "lighton-ocr", "hunyuan-ocr", "smolvlm")
    want = {"E": "Excellent", "S": "Supported", "N": "Not Recommended"}
    order = expected if cuda else "SSNE"
    rows = [(m, float(vram), cuda) for m in models]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, v double, c boolean").select(rules.suitability(F.col("m"), F.col("v"), F.col("c")).getField("level")).collect()]
    assert got == [want[k] for k in order]
    assert got == [suitability(m, vram, cuda)[0] for m in models]


def test_page_selection(spark):
    df = spark.createDataFrame([(5, s) for s in (1, 5, 0, -1, 6, -6)], "n int, s int")
    assert [r[0] for r in df.select(pages.select_page(F.col("n"), F.col("s"))).collect()] == [1, 5, 1, 5, None, None]
    lists = spark.createDataFrame([(5, [2, 0, -1, 2, 99]), (3, [-1]), (2, [])], "n int, s array<int>")
    assert [r[0] for r in lists.select(pages.select_pages(F.col("n"), F.col("s"))).collect()] == [[2, 1, 2], [1, 2, 3], [1, 2]]


def test_assembly(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "t array<string>")
    assert [r[0] for r in df.select(pages.assembled(F.col("t"))).collect()] == ["", "a", "--- Page 1 ---\na\n\n--- Page 2 ---\nb"]


def test_max_pages_keeps_the_total(spark):
    df = spark.createDataFrame([("d", ["a", "b", "c"])], "doc string, p array<string>")
    assert [tuple(r) for r in pages.explode_pages(df, "doc", F.col("p"), 2).collect()] == [("d", 1, 3, "a"), ("d", 2, 3, "b")]
    assert pages.explode_pages(df, "doc", F.col("p"), 0).count() == 0


class Flaky:
    def __init__(self, failures):
        self.left = failures

    def __call__(self):
        self.left -= 1
        if self.left >= 0:
            raise ValueError("bad page")
        return "text"


@pytest.mark.parametrize(("failures", "retries", "expected"), [(0, 2, ("COMPLETED", "text", 0, None)), (1, 2, ("COMPLETED", "text", 1, "Retrying attempt 1/2: bad page")), (3, 2, ("FAILED", None, 2, "bad page")), (1, 0, ("FAILED", None, 0, "bad page"))])
def test_retries(failures, retries, expected):
    assert recognise.with_retries(Flaky(failures), retries) == expected


def test_retry_rule_equals_the_loop(spark):
    df = spark.createDataFrame([(f, m) for f in range(5) for m in (0, 2)], "f int, m int")
    rows = df.select("f", "m", tasks.retry_outcome(F.col("f"), F.col("m"), F.lit("bad page")).alias("o")).collect()
    for r in rows:
        status, _, retries, error = recognise.with_retries(Flaky(r.f), r.m)
        assert (r.o.status, r.o.retries, r.o.error) == (status, retries, error)


def test_running_totals_match_a_window(spark):
    df = spark.range(1000).select("id", (F.col("id") / 100).cast("int").alias("b"), (F.col("id") % 3).alias("v"))
    got = {r.id: r.s for r in tasks.prefix_totals(df, ["id"], {"s": F.col("v")}).collect()}
    total = 0
    for k in range(1000):
        total += k % 3
        assert got[k] == total


def test_ranges_are_balanced_whatever_the_folders(spark):
    paths = spark.range(5000).selectExpr("concat('/one/flat/folder/document-', lpad(CAST(id * 7919 % 5000 AS STRING), 6, '0'), '.png') AS path")
    parted = paths.withColumn("parts", F.split("path", "/"))
    sizes = [r.n for r in parted.groupBy(kinds.order_range(parted, "parts")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == kinds.RANGES and max(sizes) < 5 * 5000 / kinds.RANGES
    got = {r.path: r.ordinal for r in kinds.numbered(paths).collect()}
    assert [got[p] for p in sorted(got)] == list(range(1, 5001))
