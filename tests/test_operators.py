"""Operators on small tables, sources, sinks, streaming, and queries against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tf
from marginalia.operators import aggregate, analyses, layout, relational, statistics
from marginalia.operators.metrics import HCPR, METRICS, registry, score
from marginalia.plans import catalogue, evaluate
from marginalia.sources import readers, sinks, xml_layout
from marginalia.streaming import incremental

PAIRS = "view string, pipeline string, doc_id string, doc_pos int, ref string, hyp string"


def pairs(spark, rows):
    return spark.createDataFrame([("v", p, d, n, a, b) for n, (p, d, a, b) in enumerate(rows)], PAIRS)


def scored(spark, ref, hyp, *names):
    rows = score(pairs(spark, [("p", "d", ref, hyp)]), names or METRICS).collect()
    return {r.metric: (r.value, r.weight) for r in rows}


def test_text_metrics(spark):
    got = scored(spark, "le chat été", "le chien ete")
    assert got["cer"] == (pytest.approx(5 / 11), 11)
    assert got["wer"] == (pytest.approx(2 / 3), 3) and got["mer"] == (pytest.approx(2 / 3), 3)
    assert got["diacritic_err"] == (1.0, 2) and got["mufi_err"][0] is None
    assert got["searchability"] == (pytest.approx(2 / 3), 3)
    assert got["cmer"] == (pytest.approx(5 / 12), 12)
    assert scored(spark, "", "")["cer"] == (0.0, 0) and scored(spark, "", "x")["cer"] == (1.0, 0)
    assert scored(spark, "", "")["mer"] == (0.0, 0) and scored(spark, "a", "")["cmer"] == (1.0, 1)
    assert scored(spark, None, "x")["cer"] == (None, None)
    assert scored(spark, "aſ", "as")["cer_diplo"] == (0.0, 2)
    assert scored(spark, "abcd", "abxd")["hallucination"] == (1.0, 2) and scored(spark, "ab", "ab")["hallucination"][0] is None
    assert scored(spark, "en 1515 et 1516", "en 1515")["numseq_strict"] == (0.5, 2)
    assert scored(spark, "ſa", "ſa ſ")["air"] == (0.5, 2)
    hcpr = score(pairs(spark, [("p", "d", "ſaſ", "ſas")]), ["hcpr"], registry([HCPR])).first()
    assert (hcpr.value, hcpr.weight) == (0.5, 2)
    with pytest.raises(KeyError):
        score(pairs(spark, [("p", "d", "a", "b")]), ["nope"])


def test_micro_counts_rows_of_no_weight(spark):
    rows = spark.createDataFrame([("v", "p", "m", 0.5, 4), ("v", "p", "m", 1.0, 0), ("v", "p", "m", None, 9), ("v", "q", "m", 1.0, 0), ("v", "r", "m", 0.2, None)], "view string, pipeline string, metric string, value double, weight long")
    got = {r.pipeline: (r.value, r.support) for r in aggregate.micro(rows).collect()}
    assert got == {"p": (0.5, 2), "q": (None, 1), "r": (None, 1)}


def test_gini_and_percentiles(spark):
    xs = [0.0, 0.0, 0.1, 0.4, 0.4, -1.0]
    rows = spark.createDataFrame([("a", x) for x in xs] + [("b", 0.0)], "g string, x double")
    got = {r.g: r.gini for r in aggregate.gini(rows, "x", ["g"]).collect()}
    ys = sorted(max(x, 0) for x in xs)
    n = len(ys)
    assert got["a"] == pytest.approx(2 * sum(i * y for i, y in enumerate(ys, 1)) / (n * sum(ys)) - (n + 1) / n) and got["b"] == 0
    p = aggregate.percentiles(spark.createDataFrame([("a", x) for x in (0.0, 0.1, 0.4)], "g string, x double"), "x", ["g"]).first()
    assert (p.p50, p.p75, p.p90) == (pytest.approx(0.1), pytest.approx(0.25), pytest.approx(0.34))


def test_columns_of_text(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x

    assert one(tf.word_array, " a b  c ") == ["a", "b", "c"]
    assert one(tf.token_array, "Été de l'eau, peut-être") == ["été", "de", "l'eau", "peut-être"]
    assert one(tf.line_array, "a\r\nb c\n") == "a\r\nb c\n".splitlines()
    assert one(tf.line_array, "") == [] and one(tf.char_ngrams, "ab") == []
    assert one(tf.plain_text, "﻿a\r\nb\rc") == "a\nb\nc"
    assert one(lambda c: tf.excerpt(c, 4), "abcdef") == "abc…"
    assert one(lambda c: tf.substring_count(c, "aa"), "aaaaa") == 2
    assert one(lambda c: tf.whole_word_count(c, ("per", "par")), "Per par partir") == 2
    assert one(tf.slug, "a b/c.é") == "a_b_c.é"


def rank_matrix(spark):
    values = {"alpha": [0.1, 0.2, 0.1, 0.3, 0.2, 0.1, 0.2, 0.3], "beta": [0.5, 0.6, 0.5, 0.7, 0.6, 0.5, 0.6, 0.7], "gamma": [0.1, 0.1, 0.2, 0.3, 0.3, 0.2, 0.3, 0.2]}
    return spark.createDataFrame([("v", p, i, v) for p, vs in values.items() for i, v in enumerate(vs)] + [("v", "alpha", 99, 0.1), ("v", "beta", 99, None)], "view string, pipeline string, doc_id int, value double"), values


def test_ranks(spark):
    rows, values = rank_matrix(spark)
    means = statistics.mean_ranks(rows, ["view"])
    got = {r.pipeline: (r.mean_rank, r.n) for r in means.collect()}
    expected = {p: 0.0 for p in values}
    for i in range(8):
        for p in values:
            less = sum(values[q][i] < values[p][i] for q in values)
            same = sum(values[q][i] == values[p][i] for q in values)
            expected[p] += (less + (same + 1) / 2) / 8
    assert {p: r for p, (r, _) in got.items()} == pytest.approx(expected) and all(n == 8 for _, n in got.values())
    distance = 2.343 * (3 * 4 / (6 * 8)) ** 0.5
    assert means.first().critical_distance == pytest.approx(distance)
    assert [r.names for r in statistics.tied_groups(means, ["view"]).orderBy("group").collect()] == [["alpha", "gamma"], ["beta"]]
    assert {(r.a, r.b): r.significant for r in statistics.rank_gaps(means, ["view"]).collect()} == {("alpha", "beta"): True, ("alpha", "gamma"): False, ("beta", "gamma"): True}
    test = statistics.friedman(rows, ["view"]).first()
    assert test.k == 3 and 0 < test.p < 0.01


def signed_rank(spark, xs, ys):
    rows = [("v", p, i, float(x)) for p, values in (("a", xs), ("b", ys)) for i, x in enumerate(values)]
    df = spark.createDataFrame([*rows, ("v", "a", 99, 1.0), ("v", "c", 1, 0.5)], "view string, pipeline string, doc_id int, value double")
    return statistics.wilcoxon(df, ["view"], "a", "b").first()


def test_wilcoxon(spark):
    r = signed_rank(spark, [1, 2, 3, 4, 5, 6], [2, 4, 6, 8, 10, 12.5])
    assert (r.n, r.statistic) == (6, 0) and r.p == pytest.approx(2 / 64)
    assert signed_rank(spark, [1] * 6, [1] * 6).p is None
    # textbook: differences 15 -7 5 20 0 -9 17 -12 5 -10 have W = 18
    a = [125, 115, 130, 140, 140, 115, 140, 125, 140, 135]
    b = [110, 122, 125, 120, 140, 124, 123, 137, 135, 145]
    r = signed_rank(spark, a, b)
    assert (r.n, r.statistic) == (10, 18) and 0.5 < r.p < 0.7


def test_distances_in_and_out_of_the_band(spark):
    from marginalia.functions.align import distance
    from marginalia.operators.metrics import with_distance

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    rows = [(text(n), text(m)) for n, m in ((0, 0), (0, 9), (9, 0), (40, 41), (300, 20), (9000, 60))]
    rows += [(t, t[:50] + "x" + t[60:]) for t in (text(200), text(3000))] + [("same", "same"), (None, "a"), ("a", None)]
    out = with_distance(spark.createDataFrame(rows, "a string, b string"), "d", F.col("a"), F.col("b")).collect()
    assert {(r.a, r.b): r.d for r in out} == {(a, b): None if a is None or b is None else distance(a, b) for a, b in rows}


def test_bootstrap_is_repeatable(spark):
    rows = spark.createDataFrame([("p", i, i / 10) for i in range(20)], "pipeline string, doc_pos int, value double")
    a, b = (statistics.bootstrap(rows.repartition(n), ["pipeline"]).first() for n in (1, 3))
    xs, draw = [i / 10 for i in range(20)], random.Random(42)
    means = sorted(sum(xs[draw.randint(0, 19)] for _ in range(20)) / 20 for _ in range(1000))
    assert a == b and a.lower == pytest.approx(means[25]) and a.upper == pytest.approx(means[974])


def test_time_series(spark):
    rows = spark.createDataFrame([("a", f"2024-01-{d:02d}", v) for d, v in enumerate([1.0, 1.0, 1.0, 5.0, 5.0, 5.0], 1)] + [("b", f"2024-01-0{d}", 0.1) for d in (1, 2, 3)] + [("c", "2024-01-01", 1.0)], "s string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    trend = {r.s: (r.slope, r.r2) for r in statistics.trend(rows, ["s"]).collect()}
    assert trend["b"] == (0.0, 1.0) and trend["a"][0] > 0 and "c" not in trend
    change = {r.s: r for r in statistics.change_point(rows, ["s"], ["ts"]).collect()}
    assert (change["a"].boundary, change["a"].u, change["a"].mean_before, change["a"].mean_after) == (3, 9, 1, 5) and "c" not in change
    last = {r.s: (r.previous, r.latest, r.worse) for r in statistics.last_two(rows, ["s"], ["ts"]).collect()}
    assert last == {"a": (5, 5, False), "b": (0.1, 0.1, False)}


def test_relational(spark):
    points = spark.createDataFrame([("a", 1, 5), ("b", 2, 2), ("c", 2, 3), ("d", 3, 1), ("e", 1, 5), ("f", None, 0)], "n string, x int, y int")
    assert sorted(r.n for r in relational.pareto_front(points, "n", "x", "y").collect()) == ["a", "b", "d", "e"]
    left = spark.createDataFrame([(1, "w", 0), (1, "w", 1), (1, "z", 2)], "d int, t string, pos int")
    right = spark.createDataFrame([(1, "w")], "d int, t string")
    assert [r.matched for r in relational.multiset_matches(left, right, ["d", "t"], ["pos"]).orderBy("pos").collect()] == [True, False, False]
    names = spark.createDataFrame([("X", 1), ("X", 2), ("Y", 3)], "n string, o int")
    assert [r.n for r in relational.unique_names(names, "n", "o").orderBy("o").collect()] == ["X", "X #2", "Y"]
    a, b = (spark.createDataFrame(r, "pipeline string, view string, metric string, value double") for r in ([("p", "v", "m", 1.0), ("q", "v", "m", 2.0)], [("p", "v", "m", 1.5), ("r", "v", "m", 1.0)]))
    assert {r.pipeline: r.delta for r in relational.compare_runs(a, b).collect()} == {"p": 0.5, "q": None, "r": None}


def test_alignment_analyses(spark):
    rows = pairs(spark, [("a", "1", "le chat dort bien", "le chatdort bon"), ("b", "1", "le chat dort bien", "le chat dort bien"), ("a", "2", "eau vive", "eau"), ("b", "2", "eau vive", "eau vine")])
    taxonomy = {(r.pipeline, r["class"]): r.n for r in analyses.taxonomy(rows).collect()}
    assert taxonomy[("a", "lacuna")] >= 1 and taxonomy[("b", "other")] == 1
    assert analyses.taxonomy(pairs(spark, [("a", "1", "le chat", "lechat")])).first()["class"] == "segmentation"
    words = {(r.pipeline, r.token): (r.form, r.group) for r in analyses.word_errors(rows).collect()}
    assert words[("a", "vive")] == ("∅", "universal") and words[("b", "vive")] == ("vine", "universal")
    confusions = {(r.expected, r.observed): r.n for r in analyses.confusions(rows.filter("pipeline = 'b'")).collect()}
    assert confusions == {("v", "n"): 1}
    rewritten = analyses.modernisation(rows.filter("doc_id = '2'")).collect()
    assert {(r.pipeline, r.token, r.rate) for r in rewritten} == {("a", "vive", 1.0), ("b", "vive", 1.0)}
    both = analyses.complementarity(rows).first()
    assert both.oracle_recall == pytest.approx(5 / 6) and both.best_pipeline == "b"
    assert {r.pipeline: r.samples for r in analyses.missed_rare_tokens(rows).collect()}["b"] == ["vive"]
    lines = analyses.aligned_lines(pairs(spark, [("a", "1", "un\ndeux\n\ntrois", "un\n\ntroiz")])).orderBy("place").collect()
    assert [r.cer for r in lines] == [0.0, 1.0, 0.0, 0.2]
    assert [r.line for r in analyses.worst_lines(pairs(spark, [("a", "1", "un\n\ndeux", "un\n\ndix")])).collect()] == [2]


def test_calibration_uses_each_word_once(spark):
    tokens = spark.createDataFrame([("p", "d", 0, "le", 0.9), ("p", "d", 1, "le", 0.8), ("p", "d", 2, "x", 1.0)], "pipeline string, doc_id string, pos int, text string, confidence double")
    rows = analyses.matched_tokens(tokens, spark.createDataFrame([("d", "le chat")], "doc_id string, ref string"))
    assert [r.correct for r in rows.orderBy("pos").collect()] == [1, 0, 0]
    assert analyses.calibration(rows, ["pipeline"]).first().mce == pytest.approx(0.8)


def test_correction(spark):
    triples = spark.createDataFrame([("p", "1", 0, "le chat noir", "le chat noix", "le chat noir"), ("p", "2", 1, "eau vive", "eau vive", "eau vine"), ("p", "3", 2, "un", None, "un"), ("p", "4", 3, "deux", "deux", None)], "pipeline string, doc_id string, doc_pos int, ref string, raw string, corrected string")
    r = analyses.correction(triples).first()
    assert (r.n_documents, r.n_missing_raw, r.n_missing_corrected) == (4, 1, 1)
    assert (r.improvement_rate, r.regression_rate, r.no_change_rate, r.pref_score) == (0.5, 0.5, 0.0, 0.0)
    assert (r.errors_before, r.errors_after, r.corrected, r.introduced, r.kept_wrong) == (2, 2, 2, 2, 0)
    assert (r.n_correct_ocr_words, r.n_over_normalized) == (5, 2)
    assert [x.doc_id for x in analyses.worst_regressions(triples).orderBy("place").collect()] == ["4", "2"]


ALTO = b"""<alto xmlns="x"><Layout><Page WIDTH="100" HEIGHT="200"><PrintSpace>
<TextBlock ID="b1" HPOS="1.7" VPOS="2" WIDTH="10" HEIGHT="20"><TextLine><String CONTENT="Bon" WC="0.9"/><SP/><String CONTENT="jour" WC="2"/></TextLine><TextLine><String CONTENT="hui"/></TextLine></TextBlock>
<ComposedBlock ID="c"><TextBlock><TextLine><String CONTENT="in"/></TextLine></TextBlock></ComposedBlock>
</PrintSpace></Page></Layout></alto>"""
PAGE = """<PcGts><Page imageWidth="10" imageHeight="20"><ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="r1"/><RegionRefIndexed index="0" regionRef="r2"/></OrderedGroup></ReadingOrder>
<TextRegion id="r1"><Coords points="0,0 4,0 4,4"/><TextLine><TextEquiv index="1"><Unicode>no</Unicode></TextEquiv><TextEquiv index="0"><Unicode>été</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="r2"><TextLine><Word><TextEquiv><Unicode>a</Unicode></TextEquiv></Word><Word><TextEquiv><Unicode>b</Unicode></TextEquiv></Word></TextLine></TextRegion></Page></PcGts>""".encode()


def test_layout_files(spark):
    files = spark.createDataFrame([("alto", bytearray(ALTO)), ("page", bytearray(PAGE)), ("doc", bytearray(b"<!DOCTYPE x><alto/>")), ("bad", bytearray(b"<a>")), ("none", None)], "name string, content binary")
    rows = {(r.name, r.region_id): r for r in xml_layout.regions(files, "content", "name").collect()}
    assert set(rows) == {("alto", "b1"), ("alto", "c"), ("alto", "region_1"), ("page", "r1"), ("page", "r2")}
    b1 = rows["alto", "b1"]
    assert (b1.bbox.x, b1.bbox.width, b1.lines) == (1, 10, ["Bon jour", "hui"]) and [c.confidence for c in b1.confidences] == [0.9, 1.0]
    assert rows["alto", "region_1"].parent_id == "c" and not rows["alto", "c"].leaf
    assert rows["page", "r1"].lines == ["été"] and rows["page", "r2"].lines == ["a b"] and rows["page", "r2"].dfs_pos == 0
    text = files.select("name", xml_layout.layout_text("content").alias("t")).collect()
    assert {r.name: r.t for r in text} == {"alto": "Bon jour\nhui\n\nin", "page": "a b\n\nété", "doc": None, "bad": None, "none": None}
    box = xml_layout.regions(files, "content", "name").select("region_id", layout.relative_box(F.struct("bbox", "polygon"), F.col("page_width"), F.col("page_height")).alias("box"))
    assert {r.region_id: r.box for r in box.collect()}["r1"] == [0.0, 0.0, 0.4, 0.2]
    assert xml_layout.points("1,2 3") is None and xml_layout.points("1.9,2") == [{"x": 1, "y": 2}]


def test_readers(spark, tmp_path):
    (tmp_path / "d1.gt.txt").write_bytes("﻿un\r\n".encode())
    (tmp_path / "d1.eng.txt").write_text("um\n")
    (tmp_path / "d1.txt").write_text("other")
    (tmp_path / "d1.png").write_text("x")
    (tmp_path / "d2.jpg").write_text("x")
    out = readers.precomputed_outputs(spark, str(tmp_path), ["eng"]).collect()
    assert [(r.doc_id, r.pipeline, r.content) for r in out] == [("d1", "eng", "um\n")]
    files = readers.text_files(spark, str(tmp_path)).select("name", "content")
    assert {r.doc_id: r.reference for r in readers.paired_ground_truth(files).collect()} == {"d1": "un\n", "d2": None}
    df = spark.createDataFrame([('[{"text":"a","confidence":0.5}]',), ("junk",)], "c string")
    assert [len(r.t) for r in df.select(readers.confidence_tokens(F.col("c")).alias("t")).collect()] == [1, 0]
    kinds = spark.createDataFrame([(" <PcGts/>", "layout"), ("<alto/>", "layout"), ("{}", "layout"), ("x", "raw_text"), ("{}", "entities")], "c string, k string")
    assert [r.r for r in kinds.select(readers.representation(F.col("c"), F.col("k")).alias("r")).collect()] == ["pagexml", "alto", "json", "text", "entities"]
    manifest = spark.createDataFrame([('{"items":[{"label":{"none":["p1"]},"items":[{"items":[{"body":{"id":"http://i/1"}}]}]},{"label":"x"}]}',), ('{"sequences":[{"canvases":[{"label":"f1","images":[{"resource":{"@id":"http://i/2"}}]}]}]}',)], "content string")
    assert sorted((r.label, r.image) for r in readers.manifest_pages(manifest).collect()) == [("f1", "http://i/2"), ("p1", "http://i/1")]
    entities = spark.createDataFrame([('{"text":"ab","entities":[{"label":"X","start":0,"end":1}]}',), ("[]",), ('{"text":"a","entities":[{"label":"X","start":3,"end":1}]}',)], "c string")
    assert [r.e is None for r in entities.select(layout.parse_entities(F.col("c")).alias("e")).collect()] == [False, True, True]


def corpus(spark):
    docs = spark.createDataFrame([(f"d{i}", i, "s", None, None) for i in range(7)], "doc_id string, doc_pos int, stratum string, image_uri string, metadata map<string,string>")
    gt = spark.createDataFrame([(f"d{i}", "raw_text", f"Le texte {i} ſe lit\nen 151{i}") for i in range(6)], "doc_id string, gt_type string, content string")
    out = [("a", f"d{i}", "raw_text", f"Le texte {i} se lit\nen 151{i}") for i in range(6)] + [("b", f"d{i}", "raw_text", f"le tezte {i} fe lit\nen 15l{i}") for i in range(5)]
    return docs, gt, spark.createDataFrame(out + [("b", "d0", "corrected_text", "Le texte 0 ſe lit\nen 1510")], "pipeline string, doc_id string, artifact_type string, content string")


def test_run(spark, tmp_path):
    docs, gt, out = corpus(spark)
    from marginalia.functions.normalize import PROFILES

    views = [evaluate.View("text", PROFILES["nfc"], metrics=("cer", "wer")), evaluate.View("hipe", PROFILES["hipe"], metrics=("cmer", "mer")), evaluate.View("raw", None, metrics=("cmer",)), evaluate.View("heritage", PROFILES["heritage"], metrics=("cmer",))]
    run = evaluate.run(docs, gt, out, views)
    rows = run.pairs.collect()
    assert len(rows) == 4 * 2 * 7 and {(r.pipeline, r.doc_id) for r in rows if r.view == "text" and r.hyp is None} == {("b", "d5"), ("a", "d6"), ("b", "d6")}
    assert next(r.hyp for r in rows if (r.view, r.pipeline, r.doc_id) == ("text", "b", "d0")) == "Le texte 0 ſe lit\nen 1510"
    means = {(r.view, r.pipeline, r.metric): (r.value, r.support) for r in run.aggregates.collect()}
    assert means["text", "a", "cer"] == (pytest.approx(1 / 25), 6) and means["text", "b", "cer"][1] == 5
    for name, table in run.analyses.items():
        assert table.collect() is not None, name
    conformity = {r.pipeline: r for r in run.analyses["conformity"].collect()}
    assert conformity["b"].n_missing == 2 and conformity["a"].delta_norm == pytest.approx(0.04)
    sinks.write_csv(run.aggregates, run.scores, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == list(sinks.CSV_COLUMNS)
    records = sinks.history_records(run.aggregates, "r1", "2024-01-01", "c", "1")
    again = sinks.upserted(records, records.withColumn("value", F.lit(9.0)))
    assert again.count() == records.count() and again.filter("value <> 9").count() == 0
    assert evaluate.default_views(["reference_text"])[0].gt_type == "reference_text" and evaluate.default_views([])[0].name == "text"


def test_jsonl(spark, tmp_path):
    triples = spark.createDataFrame([("p q", "1", 0, "r", None, None), ("p q", "2", 1, None, "x", None)], "pipeline string, doc_id string, doc_pos int, ref string, raw string, corrected string")
    records = sinks.system_records(triples, "c", "fr")
    sinks.write_jsonl(records, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.pipeline, r.ground_truth.transcription_unit, r.ocr_hypothesis.transcription_unit) for r in back] == [("p_q", "r", "")]


def test_streams(spark, tmp_path):
    _, gt, out = corpus(spark)
    out.filter("artifact_type = 'raw_text'").repartition(4).write.parquet(str(tmp_path / "in"))
    refs = gt.select("doc_id", F.col("content").alias("ref"))
    stream = incremental.running_micro(incremental.score_stream(incremental.output_stream(spark, str(tmp_path / "in"), 1), refs))
    q = stream.writeStream.format("memory").queryName("micro").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = incremental.running_micro(incremental.score_stream(spark.read.parquet(str(tmp_path / "in")), refs))
    assert sorted(map(tuple, spark.table("micro").collect())) == sorted(map(tuple, batch.collect()))


def test_job_states(spark, tmp_path):
    rows = [(1, 0, 0, "PENDING"), (1, 1, 1, "DONE"), (1, 2, 2, "RUNNING"), (1, 3, 3, "DONE"), (2, 0, 4, "RUNNING"), (2, 1, 5, "PENDING")]
    spark.createDataFrame(rows, "job_id long, ts long, event_id long, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("job_id long, ts long, event_id long, status string").parquet(str(tmp_path / "in"))
    q = incremental.job_states(events).writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("jobs").collect())) == [(1, 1, "PENDING"), (1, 2, "RUNNING"), (1, 3, "DONE"), (2, 1, "PENDING")]


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    for t in ("documents", "labels", "events", "orders", "lineitem", "supplier", "part", "embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(value):
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_against_sql(spark, tiny, sql, name):
    text = catalogue.oracle_sql()[name]
    columns = sorted(sql.sql(text).columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = sql.sql(f"SELECT {quoted} FROM ({text})").fetchall()
    got = catalogue.queries()[name](spark, tiny)
    assert sorted(got.columns) == columns
    rows = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in expected]
    assert sorted(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_return_rows(spark, tiny, name):
    assert catalogue.queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_char_confusions_cover_every_engine(spark, tiny):
    rows = catalogue.queries()["char_confusions"](spark, tiny).filter("place = 1").collect()
    assert {r.pipeline: (r.expected, r.observed) for r in rows} == {"alpha": ("r", "m"), "beta": ("E", "e"), "gamma": ("u", "n")}


def test_bootstrap_query_resamples_as_often_as_the_operator(spark, tiny):
    docs = catalogue.doc_scores(spark, tiny).withColumn("doc_pos", F.col("doc_id"))
    expected = {r.pipeline: (round(r.lower, 6), round(r.upper, 6)) for r in statistics.bootstrap(docs, ["pipeline"], rounds=1000).collect()}
    assert {r.pipeline: (r.lower, r.upper) for r in catalogue.queries()["bootstrap_intervals"](spark, tiny).collect()} == expected


@pytest.mark.parametrize("name", ["aligned_line_summary", "entity_scores"])
def test_queries_cover_every_engine(spark, tiny, name):
    assert {r.pipeline for r in catalogue.queries()[name](spark, tiny).collect()} == {"alpha", "beta", "gamma"}
