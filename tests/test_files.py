import pytest
from pyspark.sql import functions as F

from docfields.plans.batch import read_pages, run
from docfields.plans.spread import spread
from docfields.sources.files import extract_text, require_files, scan_folder, try_files
from docfields.sources.pages import (
    pages_of_large_files,
    distinct_pages, explode_pages, names_may_clash, page_path, pages_from_files, without_text,
)
from docfields.sources.sinks import is_complete, save_datasets, write_results

CATALOG = {"facturas": {"factura": [r"factura: *(\S+)"], "total": [r"\btotal: *(\d[\d.,]*)"]},
           "words": ["Total"]}


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    (path / "sub").mkdir(parents=True)
    contents = {
        "a b.pdf": "Factura: F-1\nTotal: 10,5\fTOTAL: 2\f", "B.PDF": "Factura: F-2\nTotal x y", "c.JPG": " Total 7 ",
        "d.png": b"\xff\xfe", "e.tif": "Total 100", "f.txt": "Total 100", "g.tiff": "nada\ftotal 1", "h.pdf": b"\xff",
        "sub/i.png": "Total 100",
    }
    for name, content in contents.items():
        (path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def names(df):
    return sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())


def test_scan_keeps_document_files_of_the_folder(spark, folder, tmp_path):
    files = scan_folder(spark, folder)
    assert names(files) == ["B.PDF", "a b.pdf", "c.JPG", "d.png", "g.tiff", "h.pdf"]
    assert names(scan_folder(spark, folder, [".txt"])) == ["f.txt"]
    missing = scan_folder(spark, str(tmp_path / "missing"))
    assert missing.count() == 0 and missing.columns == files.columns
    with pytest.raises(FileNotFoundError):
        require_files(missing, "missing")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        read_pages(spark, str(tmp_path / "empty"))


def test_pages(spark, folder):
    pages = read_pages(spark, folder)
    assert sorted((r["page_id"], r["page_no"], r["text"]) for r in pages.collect()) == [
        ("B_page_1.png", 1, "factura: f-2\ntotal x y"), ("a b_page_1.png", 1, "factura: f-1\ntotal: 10,5"),
        ("a b_page_2.png", 2, "total: 2"), ("c.JPG", 1, "total 7"), ("d.png", 1, ""), ("g.tiff", 1, "nada\ftotal 1")]
    assert [r["doc_id"] for r in without_text(pages).collect()] == ["d.png"]


def test_own_text_function(spark, folder):
    def recognise(content):
        if content.startswith(b"\xff"):
            raise RuntimeError("unreadable")
        return content.decode().upper()

    files = scan_folder(spark, folder)
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in extract_text(files, recognise).collect()}
    assert found["c.JPG"] == " TOTAL 7 " and found["d.png"] is None and found["h.pdf"] is None
    assert pages_from_files(extract_text(files, recognise)).where("doc_id = 'h.pdf'").count() == 0


def test_page_names(spark, tmp_path):
    docs = spark.createDataFrame([("s", "a\fb"), ("s", "c"), ("t", None)], "stem string, text string")
    pages = explode_pages(docs)
    assert sorted(r["page_id"] for r in pages.collect()) == ["s_page_1.png", "s_page_1.png", "s_page_2.png"]
    assert sorted(r["page_id"] for r in distinct_pages(pages).collect()) == ["s_page_1.png", "s_page_2.png"]
    assert pages.select(page_path("/x", F.col("page_id")).alias("p")).head()["p"].startswith("/x/s_page_")
    for files, clash in ((["a.pdf", "b_page_1.png"], True), (["a.pdf", "a.PDF"], True), (["a.pdf", "b.png"], False),
                         (["a.pdf", "a"], False), (["1/b.png", "2/b.png"], True), (["1/a.pdf", "2/a.pdf"], True)):
        listed = spark.createDataFrame([(f"file:/x/{f}",) for f in files], "path string")
        assert names_may_clash(listed) is clash
    (tmp_path / "a.pdf").write_text("x")
    (tmp_path / "a_page_1.png").write_text("x")
    assert read_pages(spark, str(tmp_path)).count() == 1
    for folder in ("in1", "in2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "scan.png").write_text(folder)
    both = read_pages(spark, str(tmp_path / "in*"), lambda content: content.decode())
    assert [(r["page_id"], r["text"]) for r in both.collect()] == [("scan.png", "in1")]


def test_whole_job(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    assert run(spark, folder, "facturas", out, CATALOG, extra_terms="nada", serials=True)
    results = {(r["image"], r["key"]): (r["value"], r["serial"]) for r in spark.read.parquet(f"{out}/results").collect()}
    assert results == {
        ("a b_page_1.png", "factura"): ("f-1", "f-1"), ("a b_page_1.png", "total"): ("10,5", "f-1"),
        ("a b_page_2.png", "total"): ("2", None), ("B_page_1.png", "factura"): ("f-2", "f-2"),
        ("B_page_1.png", "total"): ("x", "f-2"), ("c.JPG", "total"): ("7", None), ("g.tiff", "total"): ("1", None),
        ("g.tiff", "nada"): ("1", None)}
    assert {tuple(r) for r in spark.read.parquet(f"{out}/summed").collect()} == {("total", 20.5), ("nada", 1.0)}
    assert {tuple(r) for r in spark.read.parquet(f"{out}/strings").collect()} == {
        ("factura", "f-1"), ("factura", "f-2"), ("total", "x")}


def test_whole_job_with_default_catalogue_and_formats(spark, folder, tmp_path):
    for format in ("json", "csv"):
        out = str(tmp_path / format)
        assert run(spark, folder, "comprobantes", out, extra_terms="factura", n=1, trace=True, format=format)
        rows = spark.read.format(format).option("header", True).load(f"{out}/results")
        assert "factura:-1" in {r["path"] for r in rows.collect()}
    assert run(spark, folder, "words", str(tmp_path / "w"), CATALOG)
    with pytest.raises(ValueError):
        run(spark, folder, "unknown", str(tmp_path / "x"))


def test_nothing_found_writes_nothing(spark, folder, tmp_path):
    out = tmp_path / "none"
    pages = read_pages(spark, folder)
    assert run(spark, pages, "a", str(out), {"a": ["zzz"]}) is False
    assert not out.exists()
    nulls = spark.createDataFrame([("i", None, None, "v", None)], "image string, serial string, key string, value string, path string")
    assert write_results(nulls, str(out)) is False and not out.exists()


def test_datasets_from_mappings(spark, tmp_path):
    save_datasets(spark, {"n": {"a": 1, "b": 2.5}, "s": {"a": "x"}}, str(tmp_path))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "n")).collect())) == [("a", 1.0), ("b", 2.5)]
    assert spark.read.parquet(str(tmp_path / "s")).columns == ["Key", "Value"]


def test_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 1)
    assert spread(many) is many


def test_results_are_computed_once_and_nothing_stays_behind(spark, tmp_path):
    searched = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            searched.add(len(batch))
            yield batch

    pages = spark.range(40).selectExpr("concat('p', id) as page_id", "concat('total: ', id % 4, ' moneda: ', translate(id, '0123456789', 'abcdefghij')) as text")
    seen = pages.mapInPandas(counted, "page_id string, text string")
    out = str(tmp_path / "out")
    for format in ("parquet", "json"):
        searched.value = 0
        assert run(spark, seen, "t", out, {"t": {"total": [r"total: (\d+)"]}}, extra_terms="moneda", format=format)
        assert searched.value == 40 and is_complete(spark, out)
        assert [p.name for p in tmp_path.iterdir()] == ["out"]
        read = {name: spark.read.format(format).load(f"{out}/{name}") for name in ("results", "summed", "strings")}
        assert [read[name].count() for name in ("results", "summed", "strings")] == [80, 1, 40]


def test_a_job_that_fails_leaves_no_marker(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([("p", None, "a", "1", None)], "image string, serial string, key string, value string, path string")
    assert not is_complete(spark, out)
    assert write_results(good, out) and is_complete(spark, out)
    with pytest.raises(Exception):
        write_results(good.withColumn("value", F.raise_error(F.lit("x")).cast("string")), out)
    # It failed before anything was put in place, so what is there is still the last job's.
    assert is_complete(spark, out) and spark.read.parquet(f"{out}/results").count() == 1
    with pytest.raises(Exception):
        write_results(good, out, format="no such format")
    assert not is_complete(spark, out) and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_switches_of_the_job(spark, tmp_path):
    pages = spark.createDataFrame([("p", "total: 1.234,5 nota " + "-" * 30 + " a"), ("q", "total: 2")], "page_id string, text string")
    catalog = {"t": {"total": [r"total: (\S+)"]}}
    out = str(tmp_path / "out")
    assert run(spark, pages, "t", out, catalog, extra_terms="nota", flavors=(), locale="es", number_type="decimal(18,2)", by=["image"])
    assert sorted((r["image"], str(r["value"])) for r in spark.read.parquet(f"{out}/summed").collect()) == [("p", "1234.50"), ("q", "2.00")]
    long = spark.createDataFrame([("p", "nota " + ". " * 60 + "77")], "page_id string, text string")
    assert not run(spark, long, "t", out + "1", catalog, extra_terms="nota", flavors=())
    for extra in ({"extra_terms": "nota"}, {"term_list": spark.createDataFrame([(0, "nota")], "term_pos int, term string")}):
        assert run(spark, long, "t", out + "1", catalog, flavors=(), width=200, **extra)
        assert spark.read.parquet(f"{out}1/results").head()["value"] == "77"


def test_failures_become_a_dataset(spark, folder, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def recognise(content):
        calls.add(1)
        if content.startswith(b"\xff"):
            raise RuntimeError("unreadable \ud800")
        return 7 if b"nada" in content else content.decode()

    out = str(tmp_path / "out")
    assert run(spark, folder, "facturas", out, CATALOG, recognise=recognise)
    got = {(r["path"].rsplit("/", 1)[1], r["kind"], r["message"]) for r in spark.read.parquet(f"{out}/errors").collect()}
    assert got == {("d.png", "RuntimeError", "unreadable ?"), ("h.pdf", "RuntimeError", "unreadable ?"), ("g.tiff", "TypeError", "text expected, not int")}
    assert calls.value == 6
    # Without a function it is what isn't UTF-8, and it is told also where nothing is found.
    out = str(tmp_path / "none")
    assert run(spark, folder, "a", out, {"a": ["zzz"]}) is False
    assert {r["kind"] for r in spark.read.parquet(f"{out}/errors").collect()} == {"UnicodeDecodeError"}
    assert not is_complete(spark, out)


def test_many_large_files_are_handed_on_in_parts(spark):
    files = spark.range(0, 60, 1, 1).selectExpr("concat('f', id) as path", "cast(repeat('x', 1000000) as binary) as content")
    tried = try_files(files, lambda c: None if len(c) == 3 else c.decode())
    assert tried.selectExpr("sum(length(text)) as n", "count(error) as e").collect()[0][:] == (60_000_000, 0)


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    texts = {"a.pdf": "\f".join(f"Page {i} é " + "x y " * (i % 40) for i in range(900)), "b.PDF": " \n\ftotal 2\f", "c.pdf": "", "d.pdf": "one\r\ntwo",
             "e.pdf": "\f\f" + "z" * 5000 + "\f\fq\f\f", "f.pdf": b"ok\f\xff\xfe\fok", "g.txt": "no\fpdf"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    path = str(tmp_path)
    names = ["page_id", "doc_id", "page_no", "text", "no_text"]
    want = sorted(map(tuple, pages_from_files(extract_text(scan_folder(spark, path))).select(names).collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (700, 4096, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            pages = pages_of_large_files(spark, path).select(names)
            got = sorted(map(tuple, pages.collect()))
            assert got == want and len(got) > 900
            if size == 700:
                large = spark.read.option("lineSep", "\f").text(f"{path}/a.pdf")
                assert large.rdd.getNumPartitions() > 50
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    out = [str(tmp_path / name) for name in ("row", "split")]
    for target, large in zip(out, (False, True)):
        assert run(spark, path, "t", target, {"t": {"page": [r"page (\d+)"], "total": [r"total (\d)"]}}, large_files=large)
    a, b = (sorted((r["image"], r["key"], r["value"]) for r in spark.read.parquet(f"{o}/results").collect()) for o in out)
    assert a == b and len(a) > 900
