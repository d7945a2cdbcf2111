"""Cases that were once wrong: names of columns, ids, ties."""

import json

import pytest
from naive import words
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, embedding_dedup, mixing, substring_dedup, tool_calls

DOCS = "doc_id long, text string"
OWN = ["__block", "__bucket", "payload", "id", "row", "text2", "n_words", "kept_text", "edge_key", "epochs", "tied", "wanted", "rest", "of", "__source", "__key", "source_size", "taken", "size", "target", "__pass0", "__found", "coverage"]


def with_names(docs):
    """A column of every name that an operator uses inside or returns."""
    return docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in OWN])


def test_spans_beside_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, f"{text} end"), (3, "short")], DOCS)
    out = substring_dedup.remove_repeated_spans(with_names(docs))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == {1: (40, 0, text), 2: (41, 40, "end"), 3: (1, 0, "short")}
    assert out.columns == ["doc_id", "text", *[c for c in OWN if c not in ("n_words", "kept_text")], "kept_text", "n_words", "n_removed"]
    assert {(r.doc_id, r["__block"], r.row, r.id) for r in out.collect()} == {(i, f"__block {i}", f"row {i}", f"id {i}") for i in (1, 2, 3)}
    assert "text" not in substring_dedup.remove_repeated_spans(with_names(docs), with_text=False).columns


def test_spans_of_many_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, f"{n} {text}") for n in range(60)] + [(None, text)] * 5 + [(9, f"{text} x")]
    out = substring_dedup.remove_repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.n_words for r in out) == sum(len(words(t)) for _, t in rows)
    # the one with an id comes first, so every other loses the passage
    assert {r.n_removed for r in out if r.doc_id == 9} == {0}
    assert {r.n_removed for r in out if r.doc_id is None} == {25}
    alone = substring_dedup.remove_repeated_spans(spark.createDataFrame(rows[:-1], DOCS)).collect()
    assert sorted(r.n_removed for r in alone) == [0, *[25] * 64]
    again = substring_dedup.remove_repeated_spans(spark.createDataFrame(rows[:-1][::-1], DOCS).repartition(7)).collect()
    assert sorted((r.text, r.n_removed) for r in alone) == sorted((r.text, r.n_removed) for r in again)


def test_mix_beside_columns_of_any_name(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    plain = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(docs).collect()}
    out = mixing.mix_sources(with_names(docs))
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in out.collect()} == plain
    assert out.columns == ["doc_id", "text", "source", *[c for c in OWN if c not in ("size", "source_size", "target", "taken")], "size", "source_size", "target", "taken"]
    assert {(r.doc_id, r.rest, r.epochs, r["__key"]) for r in out.collect()} == {(i, f"rest {i}", f"epochs {i}", f"__key {i}") for i in range(50)}
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(docs).collect()} == plain


def test_mix_does_not_deal_documents_by_source(spark):
    docs = spark.createDataFrame([(i, "w", "a") for i in range(50)], "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("ids", [(-3, 5), (-1, -2), (None, -1), (0, None), (-(1 << 63), 1)])
def test_items_with_any_id_are_named(spark, ids):
    item = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, "nothing here")], DOCS)
    items = spark.createDataFrame([(ids[0], item), (ids[1], item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.find_leaks(with_names(docs), items).collect()}
    named = min(decontaminate.NO_ID if i is None else i for i in ids)
    assert (out[1].item_id, out[1].coverage, out[1].n_items, out[1].contaminated) == (named, 1.0, 2, 1)
    assert (out[2].item_id, out[2].coverage, out[2].n_items, out[2].contaminated) == (None, 0.0, 0, 0)
    assert (out[1]["__pass0"], out[1]["__found"]) == ("__pass0 1", "__found 1")


def test_different_vectors_of_one_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.01]), (5, [0.0, 1.0]), (7, [1.0, 0.02]), (None, [-1.0, 0.0])]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id or 0, r.n_links, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, True), (5, 0, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False)]


def test_calls_in_one_place_are_ordered_by_what_they_say(spark):
    call = lambda x: json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": x}}]})
    rows = [(1, 0, "user", call(n)) for n in (1, 2, 2, 3)] + [(1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "r"}))]
    kinds, schema = "conv_id long, turn long, role string, text string", {"f": {"x": ("integer", True)}}

    def found(rows):
        out = tool_calls.link_tool_calls(spark.createDataFrame(rows, kinds).coalesce(1), schema)
        return sorted((r.json, r.status) for r in out.collect())

    first = found(rows)
    assert sorted(s for _, s in first) == ["answered", "duplicate", "duplicate", "duplicate", "linked"]
    assert all(found(order) == first for order in (rows[::-1], rows[2:] + rows[:2]))


def test_tool_calls_do_not_deal_events_by_name_or_missing_identifier(spark):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(1, i, "user", "plain") for i in range(20)] + [(1, 30, "user", json.dumps({"tool_calls": [{"id": "a", "name": "f"}]}))]
    out = tool_calls.link_tool_calls(spark.createDataFrame(rows, kinds), {"f": {}})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(name" not in plan
    assert out.count() == 21
    with pytest.raises(ValueError, match="parameters"):
        tool_calls.link_tool_calls(spark.createDataFrame(rows, kinds), {str(i): {} for i in range(tool_calls.MOST_PARAMETERS + 1)})
