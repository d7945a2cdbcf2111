"""Run files, archives, importers, layout writers, modules, resuming, results and the command line."""

import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia import __main__ as cli
from marginalia import schema
from marginalia.functions.text import canonical_hash, days_since, iso_timestamp, lookalike, strip_invisible
from marginalia.operators import analyses, layout, metrics, reports, statistics
from marginalia.plans import evaluate, modules, resume
from marginalia.sources import ingest, layout_writer, readers, runfile, sinks, xml_layout
from marginalia.sources.history_store import History
from marginalia.streaming import incremental

RUN = """
run_id: first
corpus:
  name: small
  documents:
    - {id: d1, image_uri: d1.png, metadata: {stratum: print}, ground_truths: [{type: raw_text, uri: d1.gt.txt}]}
    - {id: d2, image_uri: d2.png, ground_truths: [{type: raw_text, uri: d2.gt.txt}]}
pipelines:
  - {name: eng, steps: [{id: s, kind: ocr, adapter_name: "precomputed:eng", output_types: [raw_text]}]}
evaluation:
  views:
    - {name: text, candidate_types: [raw_text], metric_names: [cer, wer], normalization_profile: nfc}
"""


def corpus_folder(tmp_path):
    for name, text in (("d1.gt.txt", "un deux"), ("d2.gt.txt", "trois"), ("d1.eng.txt", "un deus"), ("d2.eng.txt", "trois"), ("d9.eng.txt", "x")):
        (tmp_path / name).write_text(text)
    (tmp_path / "run.yaml").write_text(RUN)
    return tmp_path / "run.yaml"


def test_run_files(spark, tmp_path):
    path = corpus_folder(tmp_path)
    spec = runfile.load_run(path)
    assert (spec.run_id, spec.corpus, [v.name for v in spec.views]) == ("first", "small", ["text"])
    documents, truths, outputs = runfile.tables(spark, spec)
    assert {r.doc_id: r.content for r in truths.collect()} == {"d1": "un deux", "d2": "trois"}
    assert {(r.pipeline, r.doc_id): r.content for r in outputs.collect()} == {("eng", "d1"): "un deus", ("eng", "d2"): "trois"}
    assert {r.doc_id: r.stratum for r in documents.collect()} == {"d1": "print", "d2": None}
    for old, new in (("d1.png", "../../x.png"), ("d2.gt.txt", "gone.txt"), ("run_id: first", "bogus: 1"), ("nfc", "nope"), ("id: d2", "id: d1")):
        (tmp_path / "bad.yaml").write_text(RUN.replace(old, new))
        with pytest.raises(runfile.RunFileError):
            runfile.load_run(tmp_path / "bad.yaml")
    (tmp_path / "bad.yaml").write_text("just text")
    with pytest.raises(runfile.RunFileError):
        runfile.load_run(tmp_path / "bad.yaml")


def test_projections_by_source_come_before_the_default():
    view = runfile.view_from({"name": "v", "candidate_types": ["alto", "raw_text"], "projection": {"source_type": "alto", "name": "identity"}, "projections_by_source_type": {"alto": {"name": "layout_to_text"}}, "normalization_profile": {"nfc": True, "caseless": True}})
    assert view.projections == {"alto": "layout_to_text"} and view.profile.apply("É") == "é"


def test_command_line(spark, tmp_path, capsys):
    path, at = corpus_folder(tmp_path), lambda name: str(tmp_path / name)
    cli.main(["run", str(path), "-o", at("a"), "--history", at("history"), "--csv", at("a.csv")])
    back = readers.read_result(spark, at("a"), "aggregates")
    assert {(r.view, r.pipeline, r.metric): r.support for r in back.collect()} == {("text", "eng", "cer"): 2, ("text", "eng", "wer"): 2}
    first = readers.read_history(spark, at("history")).collect()
    # a rerun takes the place of the run of its name
    cli.main(["run", str(path), "-o", at("a"), "--history", at("history"), "--version", "1"])
    again = readers.read_history(spark, at("history")).collect()
    assert len(first) == len(again) == 2 and {r.code_version for r in again} == {"1"}
    later = readers.read_history(spark, at("history")).withColumns({"run_id": F.lit("later"), "completed_at": F.col("completed_at") + F.expr("interval 1 day"), "value": F.col("value") + 1})
    History(spark, at("history")).upsert(later)
    capsys.readouterr()
    cli.main(["compare", at("a"), at("a")])
    assert "value_a" in (out := capsys.readouterr().out) and out.count("eng") == 2
    cli.main(["history", at("history"), "--pipeline", "eng"])
    assert capsys.readouterr().out.count("eng") == 2
    cli.main(["history", at("history")])
    assert capsys.readouterr().out.count("eng") == 1
    plain = readers.read_history(spark, at("history")).withColumn("metric", F.lit("searchability"))
    plain.write.parquet(at("plain"))
    cli.main(["history", at("plain"), "--metric", "searchability"])
    assert "eng" not in capsys.readouterr().out  # more is better
    with pytest.raises(ValueError):
        readers.read_result(spark, at("a"), "nothing")


def test_command_line_prints_every_row(spark, capsys):
    cli.printed(spark.range(2500).select(F.col("id"), F.when(F.col("id") > 0, "x").alias("t")))
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2501 and out[0] == "id\tt" and out[1] == "0\t" and out[-1] == "2499\tx"


def test_command_line_resumes_and_takes_tables(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    path, at, corpus = corpus_folder(tmp_path / "corpus"), lambda name: str(tmp_path / name), tmp_path / "corpus"
    for name in ("d1.png", "d2.png"):
        (corpus / name).write_bytes(b"image " + name.encode())
    rows = [("eng", d, 3600.0, 1_000_000, 0) for d in ("d1", "d2")]
    spark.createDataFrame(rows, schema.USAGE).write.parquet(at("usage"))
    (tmp_path / "tariffs.jsonl").write_text('{"pipeline": "eng", "per_million_in": 2.0, "per_million_out": 0, "per_page": 0.5}\n')
    spark.createDataFrame([("d1", [float(i % 7) for i in range(64)], 8)], "doc_id string, pixels array<double>, width int").write.parquet(at("images"))
    more = ["--resume-dir", at("units"), "--usage", at("usage"), "--tariffs", at("tariffs.jsonl"), "--images", at("images"), "--system-records", at("records"), "--language", "en"]
    cli.main(["run", str(path), "-o", at("a"), *more])
    cost = readers.read_result(spark, at("a"), "economics").first()
    assert cost.pages == 2 and cost.cost == pytest.approx(2 * 0.08 + 2 * 2.0 + 2 * 0.5)
    assert readers.read_result(spark, at("a"), "image_summary").first().n == 1
    records = [json.loads(r.value) for r in spark.read.text(at("records")).collect()]
    assert {r["document_metadata"]["document_id"]: (r["ocr_hypothesis"]["transcription_unit"], r["document_metadata"]["language"]) for r in records} == {"d1": ("un deus", "en"), "d2": ("trois", "en")}
    # finished units are taken from the store, so what the folder holds now does not count
    (corpus / "d1.eng.txt").write_text("quite another text")
    cli.main(["run", str(path), "-o", at("b"), *more])
    same = lambda name: sorted(map(tuple, readers.read_result(spark, at(name), "aggregates").collect()))
    assert same("a") == same("b")
    # another version of the code makes other units
    cli.main(["run", str(path), "-o", at("c"), "--version", "2", *more])
    assert same("c") != same("a")


def test_demo(spark, tmp_path):
    cli.main(["demo", "-o", str(tmp_path / "demo"), "--history", str(tmp_path / "h")])
    found = readers.read_result(spark, str(tmp_path / "demo"), "aggregates").collect()
    assert {r.view for r in found} == {"text", "heritage"} and {r.pipeline for r in found} == {"one", "two"}
    assert {r.support for r in found if (r.view, r.metric) == ("text", "cer")} == {5}
    assert readers.read_result(spark, str(tmp_path / "demo"), "correction").first().n_documents == 5
    assert readers.read_result(spark, str(tmp_path / "demo"), "economics").count() == 2
    assert readers.read_history(spark, str(tmp_path / "h")).count() > 0


def test_history_store(spark, tmp_path):
    """Replays and reruns change nothing, and the files a reader opens stay few."""
    path = str(tmp_path / "store")
    store = History(spark, path, buckets=2, every=4)
    assert store.latest() is None
    expected = {}
    kinds = "run_id string, pipeline string, view string, metric string, value double"
    for n in range(11):
        rows = [(f"r{n % 5}", "p", "v", "m", float(n)), (f"r{n % 5}", "p", "v", "m", -1.0), (f"s{n}", "p", "v", "m", 0.5)]
        store.upsert(spark.createDataFrame(rows, kinds), n)
        expected |= {f"r{n % 5}": float(n), f"s{n}": 0.5}
        assert {r.run_id: r.value for r in store.latest().collect()} == expected
        assert len(store.latest().inputFiles()) <= 2 + 3 * 2
    for n in (10, 9, 0):  # one that is a batch still, one of each side of a merge
        rows = [(f"r{n % 5}", "p", "v", "m", float(n)), (f"s{n}", "p", "v", "m", 0.5)]
        store.upsert(spark.createDataFrame(rows, kinds), n)
    assert {r.run_id: r.value for r in store.latest().collect()} == expected
    store.compact()
    store.compact()
    assert {r.run_id: r.value for r in store.latest().collect()} == expected
    assert len(store.latest().inputFiles()) <= 2 and len(store._names("manifest")) == 1
    store.upsert(spark.createDataFrame([("r0", "p", "v", "m", 99.0)], kinds))
    assert {r.run_id: r.value for r in History(spark, path).latest().collect()} == expected | {"r0": 99.0}


def test_results_come_back_as_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5, ["x", None]), (None, None, float("inf"), None)], "s string, n long, v double, l array<string>")
    sinks.write_result(str(tmp_path / "r"), one=df, other=df.limit(0))
    back = readers.read_result(spark, str(tmp_path / "r"), "one")
    assert back.dtypes == sorted(df.dtypes) or dict(back.dtypes) == dict(df.dtypes)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert readers.read_result(spark, str(tmp_path / "r"), "other").count() == 0


def packed(entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in entries:
            z.writestr(name, content)
    return data.getvalue()


def test_archives(spark, monkeypatch):
    png = b"\x89PNG\r\n\x1a\nxx"
    assert [n for n, _ in ingest.archive_entries(packed([("a.png", png), ("x/a.gt.txt", "t"), ("__MACOSX/a.png", "junk"), ("._a.png", "junk")]))] == ["a.png", "a.gt.txt"]
    bad = {"no archive": b"junk", "empty": packed([]), "unsafe name": packed([("../a.txt", "x")]), "not allowed": packed([("a.exe", "x")]), "twice": packed([("a.txt", "x"), ("b/a.txt", "x")]), "no image": packed([("a.png", "x")])}
    for problem, data in bad.items():
        assert ingest.archive_entries(data).startswith(problem)
    monkeypatch.setattr(ingest, "ENTRIES", 1)
    assert ingest.archive_entries(packed([("a.txt", "x"), ("b.txt", "x")])) == "too many entries"
    monkeypatch.setattr(ingest, "FILE_BYTES", 3)
    assert ingest.archive_entries(packed([("a.txt", "long")])).startswith("too large")


def test_archives_are_read_side_by_side(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(packed([("a.txt", "one"), ("b.txt", "two")]))
    (tmp_path / "bad.zip").write_bytes(b"junk")
    rows = ingest.read_archives(spark, str(tmp_path)).collect()
    assert {(r.path.split("/")[-1], r.name, r.content and bytes(r.content), r.problem) for r in rows} == {("good.zip", "a.txt", b"one", None), ("good.zip", "b.txt", b"two", None), ("bad.zip", None, None, "no archive")}


def test_importers(spark, tmp_path):
    arks = spark.createDataFrame([("ark:/12148/btv1b",), (" 12148/btv1b/",), ("btv1b",), ("12148/a b",), (None,)], "a string")
    assert [r.x for r in arks.select(ingest.ark_name(F.col("a")).alias("x")).collect()] == ["12148/btv1b", "12148/btv1b", None, None, None]
    urls = spark.createDataFrame([("http://h/ark:/1/x/f12/full",), ("http://h/x",)], "u string")
    assert [r.x for r in urls.select(ingest.folio_number(F.col("u")).alias("x")).collect()] == [12, None]
    pages = spark.createDataFrame([("m", 0, "i0", "t0"), ("m", 1, None, "t1"), ("m", 2, "i2", None), ("n", 0, "j0", "u0")], "manifest string, pos int, image string, content string")
    documents, truths = ingest.imported_pages(pages, "reference_text", ("manifest",))
    assert {(r.manifest, r.doc_id, r.image_uri) for r in documents.collect()} == {("m", "page_0001", "i0"), ("m", "page_0002", "i2"), ("n", "page_0001", "j0")}
    assert {(r.manifest, r.doc_id, r.gt_type, r.content) for r in truths.collect()} == {("m", "page_0001", "reference_text", "t0"), ("n", "page_0001", "reference_text", "u0")}
    (tmp_path / "d1.eng.regions.json").write_text('{"r1": "un", "r2": "deux"}')
    (tmp_path / "d2.eng.regions.json").write_text("[]")
    assert {(r.doc_id, r.region_id): r.text for r in ingest.region_texts(spark, str(tmp_path), "eng").collect()} == {("d1", "r1"): "un", ("d1", "r2"): "deux"}
    (tmp_path / "d1.layout.json").write_text(json.dumps([{"page_no": 0, "region_id": "r1", "depth": 0, "dfs_pos": 0, "leaf": True, "lines": ["a"], "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}}]))
    rows = ingest.precomputed_layouts(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.region_id, r.bbox.width, r.lines) for r in rows] == [("d1", "r1", 3, ["a"])]
    linked = spark.createDataFrame([("http://h/1", '{"next": "http://h/2"}'), ("http://h/2", '{"next": "http://other/3"}'), ("http://other/3", "{}")], "url string, content string")
    chain = ingest.chained_pages(spark.createDataFrame([("http://h/1",)], "url string"), linked)
    assert [(r.n, r.url) for r in chain.orderBy("n").collect()] == [(0, "http://h/1"), (1, "http://h/2")]


ALTO = b"""<alto><Layout><Page WIDTH="100" HEIGHT="200"><PrintSpace>
<TextBlock ID="b1" HPOS="1" VPOS="2" WIDTH="30" HEIGHT="40"><TextLine><String CONTENT="un" WC="0.5"/><String CONTENT="deux"/></TextLine><TextLine><String CONTENT="trois" WC="0.25"/></TextLine></TextBlock>
<ComposedBlock ID="c"><Shape><Polygon POINTS="1,2 3,4 5,6"/></Shape><TextBlock ID="b2"><TextLine><String CONTENT="in"/></TextLine></TextBlock></ComposedBlock><Illustration ID="i"/>
</PrintSpace></Page></Layout></alto>"""


def test_layouts_come_back_as_written(spark):
    rows = xml_layout.parse(ALTO)
    assert xml_layout.parse(layout_writer.alto_text(rows).encode()) == rows
    for version in ("v2", "v3", "v4", "none"):
        text = layout_writer.alto_text(rows, version, "pixel")
        assert xml_layout.parse(text.encode()) == rows and "<MeasurementUnit>pixel</MeasurementUnit>" in text
        assert text == ET.canonicalize(text) and ('ns-' + version in text) == (version != "none")
    with pytest.raises(ValueError, match="v5"):
        layout_writer.alto_text(rows, "v5")
    assert 'xmlns="urn:x"' in layout_writer.page_text(rows, "urn:x")
    again = xml_layout.parse(layout_writer.page_text(rows).encode())
    keep = ("region_id", "parent_id", "depth", "dfs_pos", "leaf", "lines", "page_width")
    assert [[r[k] for k in keep] for r in again] == [[r[k] for k in keep] for r in rows]
    page = b'<PcGts><Page imageWidth="10" imageHeight="20"><TextRegion id="r1" type="heading"><Coords points="1,2 3,4"/><TextLine><TextEquiv><Unicode>\xc3\xa9t\xc3\xa9</Unicode></TextEquiv></TextLine></TextRegion><ImageRegion id="r2"/></Page></PcGts>'
    rows = xml_layout.parse(page)
    assert xml_layout.parse(layout_writer.page_text(rows).encode()) == rows
    files = spark.createDataFrame([("d", bytearray(ALTO))], "doc_id string, content binary")
    regions = xml_layout.regions(files, "content", "doc_id")
    texts = spark.createDataFrame([("d", "b2", "dans\nla")], "doc_id string, region_id string, text string")
    text = layout_writer.gathered(layout_writer.with_texts(regions, texts, "doc_id"), "doc_id").select(layout_writer.alto_column("rows").alias("x"), layout_writer.page_column("rows").alias("p")).first()
    assert xml_layout.text_of(xml_layout.parse(text.x.encode())) == "un deux\ntrois\n\ndans\nla"


def test_modules(spark):
    known = modules.Modules()
    known.register("upper", lambda label: modules.column_module(f"upper:{label}", "1", F.upper, ("raw_text",), ("raw_text",)))
    known.register("liar", lambda label: modules.column_module("other", "1", F.lower))
    module = known.build("upper:a")
    with pytest.raises(KeyError):
        known.build("none:a")
    with pytest.raises(ValueError):
        known.build("liar:a")
    rows = spark.createDataFrame([("d", "x"), ("e", None)], "doc_id string, content string")
    out = {r.doc_id: (r.content, r.problem) for r in modules.chain([module, module], rows).collect()}
    assert out == {"d": ("X", None), "e": (None, "no content")}
    files = spark.createDataFrame([("d", bytearray(ALTO))], "doc_id string, content binary")
    regions = xml_layout.regions(files, "content", "doc_id")
    failing = modules.column_module("upper:b", "1", lambda c: F.when(~c.startswith("in"), F.upper(c)))
    lines = {r.region_id: (r.lines, r.problems) for r in modules.fan_out(regions, failing).collect()}
    assert lines["b1"] == (["UN DEUX", "TROIS"], 1) and lines["b2"][0] == ["in"]


def test_resume(spark, tmp_path):
    units = spark.createDataFrame([("p", "d1", bytearray(b"i1")), ("p", "d2", bytearray(b"i2")), ("p", "d3", None)], "pipeline string, doc_id string, image binary")
    keyed = resume.unit_keys(units, "1", {"p": "{}"})
    assert keyed.filter("unit_key is null").count() == 1
    assert keyed.join(resume.unit_keys(units, "2", {"p": "{}"}), "unit_key").count() == 0
    outputs = keyed.filter("doc_id <> 'd3'").select("unit_key", "pipeline", "doc_id", F.lit("raw_text").alias("artifact_type"), F.when(F.col("doc_id") == "d1", "t").alias("content"))
    resume.save(outputs, str(tmp_path / "store"))
    other = units.withColumn("image", F.when(F.col("doc_id") == "d1", F.lit(b"changed")).otherwise(F.col("image")))
    assert {r.doc_id for r in keyed.join(resume.unit_keys(other, "1", {"p": "{}"}), "unit_key").select(keyed.doc_id).collect()} == {"d2"}
    done, left = resume.split(keyed, resume.finished(spark, str(tmp_path / "store")))
    assert [r.doc_id for r in done.collect()] == ["d1"] and sorted(r.doc_id for r in left.collect()) == ["d2", "d3"]


def test_whole_runs(spark, tmp_path):
    documents, truths, outputs = cli.demo_tables(spark)
    more = spark.createDataFrame([("two", "page_1", "confidences", '[{"text":"Icy","confidence":0.9},{"text":"liure","confidence":0.4}]'), ("one", "page_1", "entities", '{"text":"Icy","entities":[{"label":"P","start":0,"end":3,"text":"Icy"}]}')], outputs.schema)
    truths = truths.union(spark.createDataFrame([("page_1", "entities", '{"text":"Icy","entities":[{"label":"P","start":0,"end":3,"text":"Icy"}]}')], truths.schema))
    usage = spark.createDataFrame([(p, f"page_{n}", 2.0, 1000, 10) for p in ("one", "two") for n in (1, 2, 3)], "pipeline string, doc_id string, duration_seconds double, tokens_in long, tokens_out long")
    images = spark.createDataFrame([("page_1", [float(i % 7) for i in range(64)], 8)], "doc_id string, pixels array<double>, width int")
    run = evaluate.run(documents, truths, outputs.union(more), evaluate.default_views(["raw_text"]), usage=usage, images=images, folder=str(tmp_path / "run"))
    found = {k: run.analyses[k].collect() for k in ("calibration", "entities", "correction", "cross_engine", "verdicts", "economics", "marginal_cost", "image_summary")}
    assert {r.pipeline: r.n for r in found["calibration"]} == {"two": 2}
    assert [(r.pipeline, r.f1) for r in found["entities"]] == [("one", 1.0)]
    assert [r.pipeline for r in found["correction"]] == ["two"] and found["correction"][0].n_documents == 5
    assert {r.metric.split(":")[2] for r in found["cross_engine"]} >= {"spread"}
    assert found["verdicts"][0].verdict == "unknown" and found["verdicts"][0].pipeline in ("one", "two")
    assert {r.pipeline: r.pages for r in found["economics"]} == {"one": 3, "two": 3} and found["image_summary"][0].n == 1
    assert len(found["marginal_cost"]) == 2


def test_lookups(spark):
    assert [m.name for m in metrics.for_input_types("raw_text", "raw_text")] == sorted(metrics.METRICS) and not metrics.for_input_types("layout", "layout")
    one = spark.createDataFrame([("a​b\u0007", "2024-01-02T03:04:05Z", "vv")], "t string, ts string, v string")
    row = one.select(strip_invisible(F.col("t")).alias("t"), iso_timestamp(F.col("ts")).cast("string").alias("ts"), lookalike(F.col("v"), (("vv", "w"), ("w", "x"))).alias("v"), days_since(F.timestamp_seconds(F.lit(86400)), F.timestamp_seconds(F.lit(0))).alias("d"), canonical_hash("t").alias("h")).first()
    assert (row.t, row.ts, row.v, row.d) == ("ab", "2024-01-02 03:04:05", "x", 1.0) and len(row.h) == 64
    tokens = spark.createDataFrame([([("a", 50.0), ("b", -1.0), (" ", 90.0), ("c", 250.0)],)], "t array<struct<text:string,confidence:double>>")
    assert [(t.text, t.confidence) for t in tokens.select(readers.percent_confidences(F.col("t")).alias("t")).first().t] == [("a", 0.5), ("c", 1.0)]
    history = spark.createDataFrame([("r2", "2024-01-02", "p", "v", "m", 2.0), ("r1", "2024-01-01", "p", "v", "m", 1.0), ("r1", "2024-01-01", "q", "v", "m", 1.0)], "run_id string, completed_at string, pipeline string, view string, metric string, value double")
    assert [r.run_id for r in statistics.history_series(history, "p", "v", "m").collect()] == ["r1", "r2"]
    numerals = spark.createDataFrame([("v", "p", "d", 0, "an XIV et an IX", "an XIV et an")], "view string, pipeline string, doc_id string, doc_pos int, ref string, hyp string")
    assert [r.samples for r in analyses.lost_numerals(numerals).collect()] == [["IX"]]
    assert layout.image_summary(layout.image_quality(spark.createDataFrame([([1.0] * 9, 3)], "pixels array<double>, width int"))).first().n == 1
    assert reports.page_extents(spark.createDataFrame([("d", None, None, (1, 2, 3, 4))], "doc_id string, page_width long, page_height long, bbox struct<x:long,y:long,width:long,height:long>"), ["doc_id"]).first().width == 4


def test_progress_sessions_and_caches(spark, tmp_path):
    rows = spark.createDataFrame([("c", 0), ("c", 10), ("c", 100), ("d", 5)], "client string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r.client, r.n) for r in incremental.sessions(rows, "client").collect()} == {("c", 2), ("c", 1), ("d", 1)}
    assert {(r.client, r.s): (r.done, r.total) for r in incremental.progress(rows, "client", ("ts",)).collect()}[("c", 10)] == (2, 3)
    assert [r.s for r in incremental.replay(incremental.journal(rows, "client", ("ts",)), "c", 1, "client").collect()] == [10, 100]
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = incremental.ProgressLog()
    spark.streams.addListener(log)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.misses(stream, "client", ttl=50).writeStream.format("memory").queryName("misses").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.client for r in spark.table("misses").collect()} == {"c", "d"}
    spark.streams.removeListener(log)
    pages = spark.createDataFrame([(bytearray(b"x" * n), f"t{n}") for n in range(1, 7)], "image binary, ground_truth string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    q = readers.page_stream(spark, str(tmp_path / "pages"), limit=2, most_bytes=4, files_per_batch=1).writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("pages").count() == 2


def test_upserts_keep_the_largest_record(spark, tmp_path):
    rows = spark.createDataFrame([("r", "p", "v", "m", 1.0), ("r", "p", "v", "m", 3.0), ("r", "q", "v", "m", 2.0)], "run_id string, pipeline string, view string, metric string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    incremental.upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.pipeline: r.value for r in incremental.latest_records(spark, str(tmp_path / "out")).collect()} == {"p": 3.0, "q": 2.0}


def test_data_sets_and_catalogues(spark, tmp_path):
    pages = spark.createDataFrame([(bytearray(b"x" * n), f"t{n}") for n in (1, 2, 9)], "image binary, ground_truth string")
    pages.write.parquet(str(tmp_path / "pages"))
    assert readers.dataset_pages(spark, str(tmp_path / "pages"), most_bytes=4).count() == 2
    assert readers.dataset_pages(spark, str(tmp_path / "pages"), limit=1).count() == 1
    pages.drop("image").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        readers.dataset_pages(spark, str(tmp_path / "bad"))
    kind = "id string, title string, description string, languages array<string>"
    own = spark.createDataFrame([("a", "Old Books", None, ["fr"]), ("b", "Maps", "of old towns", [])], kind)
    found = spark.createDataFrame([("a", "Old again", None, None), ("c", "x", None, ["Old Norse"]), ("d", "new", None, None)], kind)
    assert [(r.id, r.source) for r in readers.catalogue_search(own, found, "OLD", 5).collect()] == [("a", 0), ("b", 0), ("c", 1)]


def test_representations_and_tables_of_prices(spark, tmp_path):
    region = {"page_no": 0, "region_id": "r1", "depth": 0, "dfs_pos": 0, "leaf": True, "lines": ["a"]}
    rows = [("x", "raw_text"), (ALTO.decode(), "layout"), (json.dumps([region]), "layout"), ('{"text":"ab","entities":[{"label":"X","start":0,"end":1}]}', "entities")]
    out = spark.createDataFrame(rows, "c string, k string").select(readers.represented(F.col("c"), F.col("k")).alias("r")).select("r.*").collect()
    assert [r.text for r in out] == ["x", None, None, None]
    assert [[x.region_id for x in r.layout] if r.layout else None for r in out] == [None, ["b1", "c", "b2", "i"], ["r1"], None]
    assert [r.entities is not None for r in out] == [False, False, False, True]
    (tmp_path / "t.json").write_text('{"kind": "cloud", "model": "m", "paid": true, "valid_until": "2030-01-01", "per_million_in": 1.5}\n')
    tariffs = readers.read_tariffs(spark, str(tmp_path / "t.json"))
    pipelines = spark.createDataFrame([("p", "cloud", "m"), ("q", "cloud", "n")], "pipeline string, kind string, model string")
    assert {r.pipeline: (r.per_million_in, r.basis) for r in reports.with_tariffs(pipelines, tariffs, "2026-01-01").collect()} == {"p": (1.5, "tariff"), "q": (None, "machine")}


def test_plug_ins_profiles_and_sinks(spark, tmp_path, monkeypatch):
    from marginalia.functions.normalize import load_profiles

    class Entry:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            if isinstance(self.value, Exception):
                raise self.value
            return self.value

    build = lambda label: modules.column_module(f"good:{label}", "1", F.lower)
    monkeypatch.setattr(modules, "entry_points", lambda group: [Entry("good", build), Entry("bad", ImportError("gone"))])
    known = modules.Modules()
    assert modules.discover(known) == {} and known.kinds() == []
    assert list(modules.discover(known, trusted=True)) == ["bad"] and known.build("good:x").name == "good:x"
    (tmp_path / "p.yaml").write_text("own: {nfc: true, caseless: true, diplomatic: {ſ: s}}\n")
    assert load_profiles(str(tmp_path / "p.yaml"))["own"].apply("ſÉ") == "sé"
    documents, truths, outputs = cli.demo_tables(spark)
    seen = []
    views = [evaluate.View("text", archaic="q", metrics=("air",))]
    documents = documents.drop("metadata", "stratum").withColumns({"stratum": F.lit(None).cast("string"), "metadata": F.create_map(F.lit("stratum"), F.lit("old"))})
    run = evaluate.run(documents, truths, outputs, views, sink=lambda df: seen.append(df.count()))
    assert seen == [15] and {r.stratum for r in run.pairs.collect()} == {"old"}
    assert all(r.value is None for r in run.scores.collect())


def test_insights_and_samples(spark):
    rows = [(f"r{d}", f"2024-01-{d:02d}T00:00:00", "p", v) for d, v in enumerate([1.0, 1.1, 1.2, 1.0, 1.1, 1.2, 5.0, 5.1, 5.2, 5.0, 5.1, 5.2], 1)] + [("x", "no time", "p", 9.0)]
    out = statistics.series_insight(spark.createDataFrame(rows, "run_id string, completed_at string, pipeline string, value double"), ["pipeline"]).first()
    assert (out.n, out.shift_run) == (12, "r7") and out.slope > 0
    entity = "struct<text:string,entities:array<struct<label:string,start:int,end:int,text:string>>>"
    pairs = spark.createDataFrame([("p", 0, ("abc def", [("X", 0, 3, "abc")]), ("abc def", [("Y", 4, 7, "def")]))], f"pipeline string, doc_pos int, ref {entity}, hyp {entity}")
    assert {r.kind: r.samples for r in layout.entity_samples(pairs, ["pipeline"]).collect()} == {"fn": ["abc"], "fp": ["def"]}
