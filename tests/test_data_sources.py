"""Layouts, archives and manifests through spark.read, spark.readStream and df.write."""

import io
import json
import os
import zipfile

import pytest

from marginalia.sources import data_sources, readers, xml_layout
from marginalia.sources.ingest import archives

ALTO = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page WIDTH="100" HEIGHT="200"><PrintSpace>
<TextBlock ID="b1" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"><TextLine><String CONTENT="un" WC="0.5"/><String CONTENT="{word}"/></TextLine></TextBlock>
<ComposedBlock ID="c"><TextBlock ID="b2"><TextLine><String CONTENT="trois"/></TextLine></TextBlock></ComposedBlock></PrintSpace></Page></Layout></alto>"""


@pytest.fixture(scope="module")
def formats(spark):
    data_sources.register(spark)
    return spark


def layouts(folder, names):
    folder.mkdir(exist_ok=True)
    for n, name in enumerate(names):
        (folder / f"{name}.xml").write_text(ALTO.format(word=name))
        os.utime(folder / f"{name}.xml", (1000 + n, 1000 + n))
    return str(folder)


def taken(formats, fmt, path, checkpoint, **options):
    """The rows of each batch of a stream."""
    batches = []
    query = formats.readStream.format(fmt).options(**options).load(path).writeStream.foreachBatch(lambda df, _: batches.append(df.collect())).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [b for b in batches if b]


def test_layouts_are_read_as_regions(formats, tmp_path):
    path = layouts(tmp_path / "in", ["d1", "d2", "d3"])
    (tmp_path / "in" / "broken.xml").write_text("<alto")
    (tmp_path / "in" / "_hidden.xml").write_text("x")
    rows = formats.read.format("layouts").option("partition_bytes", 600).load(path)
    assert rows.rdd.getNumPartitions() == 3
    found = rows.orderBy("doc_id", "dfs_pos").collect()
    assert [(r.doc_id, r.region_id) for r in found] == [("broken", None)] + [(d, b) for d in ("d1", "d2", "d3") for b in ("b1", "c", "b2")]
    files = formats.read.format("binaryFile").load(path).selectExpr("path", "content")
    plain = xml_layout.regions(files, "content", "path").drop("path")
    same = lambda df: sorted(map(str, df.collect()))
    assert same(rows.filter("region_id is not null").select(*plain.columns)) == same(plain)
    assert formats.read.format("layouts").load(str(tmp_path)).filter("doc_id = 'd1'").count() == 3
    (tmp_path / "none").mkdir()
    assert formats.read.format("layouts").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("kind", ["alto", "page"])
def test_layouts_come_back_as_written(formats, tmp_path, kind):
    rows = formats.read.format("layouts").load(layouts(tmp_path / "in", ["d1", "d2", "d3"]))
    out = str(tmp_path / "out")
    data_sources.by_document(rows).write.format("layouts").option("kind", kind).mode("append").save(out)
    assert sorted(os.listdir(out)) == ["d1.xml", "d2.xml", "d3.xml"]
    columns = ["doc_id", "page_width", "region_id", "parent_id", "depth", "dfs_pos", "leaf", "lines"] + ["bbox", "confidences", "region_type"] * (kind == "alto")
    same = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert same(formats.read.format("layouts").load(out)) == same(rows)
    more = {"version": "v2", "unit": "mm10"} if kind == "alto" else {"namespace": "urn:x"}
    data_sources.by_document(rows.filter("doc_id = 'd2'")).write.format("layouts").option("kind", kind).options(**more).mode("overwrite").save(out)
    assert all(x in open(f"{out}/d2.xml").read() for x in (("ns-v2", "mm10") if kind == "alto" else ("urn:x",)))
    assert sorted(os.listdir(out)) == ["d2.xml"]


def test_what_can_not_be_written_leaves_nothing(formats, tmp_path):
    rows = formats.read.format("layouts").load(layouts(tmp_path / "in", ["d1", "d2"]))
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="more than one place"):
        rows.filter("dfs_pos < 2").repartitionByRange(2, "dfs_pos").write.format("layouts").mode("append").save(out)
    assert os.listdir(out) == []
    with pytest.raises(Exception, match="columns missing"):
        rows.select("doc_id").write.format("layouts").mode("append").save(out)
    with pytest.raises(Exception, match="alto or page"):
        rows.write.format("layouts").option("kind", "hocr").mode("append").save(out)


def test_streams_read_each_file_once(formats, tmp_path):
    path, checkpoint = layouts(tmp_path / "in", ["d1", "d2", "d3"]), str(tmp_path / "cp")
    batches = taken(formats, "layouts", path, checkpoint, files_per_batch=2)
    assert [sorted({r.doc_id for r in b}) for b in batches] == [["d1", "d2"], ["d3"]] and sum(map(len, batches)) == 9
    for n, name in enumerate(("d4", "d0")):  # later files, one of a name that sorts before the others
        (tmp_path / "in" / f"{name}.xml").write_text(ALTO.format(word=name))
        os.utime(tmp_path / "in" / f"{name}.xml", (2000 + n, 2000 + n))
    again = taken(formats, "layouts", path, checkpoint, files_per_batch=2)
    assert [sorted({r.doc_id for r in b}) for b in again] == [["d0", "d4"]]
    assert taken(formats, "layouts", path, checkpoint) == []


def test_archives_and_manifests_are_those_of_the_column_functions(formats, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.txt", "un")
        z.writestr("b.xml", "<x/>")
    (tmp_path / "ok.zip").write_bytes(data.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    files = formats.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path)).selectExpr("path", "content")
    strip = lambda df: sorted((r.path.rpartition("/")[2], r.name or "", r.content and bytes(r.content), r.problem or "") for r in df.collect())
    assert strip(formats.read.format("archives").load(str(tmp_path))) == strip(archives(files))
    assert [len(b) for b in taken(formats, "archives", str(tmp_path), str(tmp_path / "cp"))] == [3]
    three = {"items": [{"label": {"fr": ["f. 1"]}, "items": [{"items": [{"body": {"id": "http://x/1"}}]}]}, {"label": {"none": ["f. 2"]}, "items": []}, {"items": [{"items": [{"body": {"id": "http://x/3"}}]}]}]}
    two = {"sequences": [{"canvases": [{"label": "p. 1", "images": [{"resource": {"@id": "http://y/1"}}]}]}]}
    for name, book in (("three", three), ("two", two), ("empty", {}), ("list", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(book))
    (tmp_path / "broken.json").write_text("{")
    pages = formats.read.format("manifests").load(str(tmp_path))
    texts = readers.text_files(formats, str(tmp_path)).filter("name like '%.json'")
    plain = readers.manifest_pages(texts)
    assert sorted((r.pos, r.label or "", r.image) for r in pages.collect()) == sorted((r.pos, r.label or "", r.image) for r in plain.collect()) and pages.count() == 3
