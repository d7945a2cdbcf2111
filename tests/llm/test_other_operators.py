"""URLs, vectors, tool calls, the pipeline, and queries against their SQL."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import components, embedding_dedup, queries, tool_calls, url_filter


def test_site_rules_and_patterns(spark):
    rules = [url_filter.UrlRule(*r) for r in queries.SITE_RULES] + [url_filter.UrlRule("/ads/*.gif", "block", "pattern"), url_filter.UrlRule("=ok^", "allow", "pattern"), *url_filter.DEFAULT_PATTERNS]
    urls = {
        "http://A.Example.com/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/x": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://badexample.com/en/x": ("badexample.com", "/en/x", "com/", "allow"),
        "https://example.com/EN/x": ("example.com", "/EN/x", "com/", "allow"),
        "http://x.net/fr/1#top": ("x.net", "/fr/1", "net/fr/", "block"),
        "http://x.net/de/1?ref=z": ("x.net", "/de/1", None, "block"),
        "http://x.net/de/1?a=1&ref=z&s=ok": ("x.net", "/de/1", None, "allow"),
        "http://x.org/ads/big.gif": ("x.org", "/ads/big.gif", None, "block"),
        "http://x.org/loads/big.gif": ("x.org", "/loads/big.gif", None, "allow"),
        "http://x.org?q": ("x.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert found == urls
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_rules_in_several_passes(spark, monkeypatch):
    rules = [url_filter.UrlRule(*r) for r in queries.SITE_RULES] + list(url_filter.DEFAULT_PATTERNS)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    once = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=str)
    monkeypatch.setattr(url_filter, "RULES_PER_PASS", 3)
    assert sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=str) == once


def test_tokens_must_be_whole():
    assert url_filter.UrlRule("example.com/en/", "block").tokens() == {"example", "com", "en"}
    assert url_filter.UrlRule("example.com/en", "block").tokens() == {"example", "com"}
    assert url_filter.UrlRule("/ads/*.gif", "block", "pattern").tokens() == {"ads"}


def vectors(seed=2, n=150, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, dim))
    rows = [(i, (base[rng.integers(len(base))] + rng.normal(scale=0.15, size=dim)).astype(np.float32).tolist(), 0) for i in range(n)]
    rows += [(n, rows[0][1], 1), (n + 1, None, 0), (n + 2, [0.0] * dim, 0), (n + 3, [float("nan")] * dim, 0), (n + 4, [None] * dim, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0)]
    return rows + [(n + 7, [x * 4 for x in rows[1][1]], 0), (n + 8, [1e30 * x for x in rows[2][1]], 0)]


@pytest.mark.parametrize("chunk", [4, 256])
def test_vectors_are_linked_as_by_brute_force(spark, chunk):
    rows = vectors()
    good = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _, _ in rows}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i].add(j)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.id: r for r in embedding_dedup.near_duplicate_vectors(df, recall=0.99999, chunk=chunk).collect()}
    assert sum(map(len, links.values())) > 200
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (len(links[i]), least(i), least(i) == i) for i in links}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicate_vectors(df).filter("n_links = 1").count()
    assert found >= 0.97 * len(rows)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {x: x for e in links for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tool_calls(spark):
    dump = json.dumps
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", dump({"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "arguments": dump({"x": "1"}), "after": ["a"]}, {"id": "a", "name": "nope", "arguments": {}}]})),
        (1, 2, "tool", dump({"tool_call_id": "b", "content": {"z": 1, "a": [3, {"q": 1, "b": 2}]}})),
        (1, 0, "tool", dump({"tool_call_id": "a", "content": "3"})),
        (1, 4, "tool", dump({"tool_call_id": "zz", "content": "3"})),
        (None, 0, "assistant", dump({"tool_calls": [{"id": "p", "name": "add", "arguments": {"x": 1, "y": 1.5, "w": True}, "after": ["q"]}, {"id": "q", "name": "add", "arguments": 3, "after": ["p"]}, {"name": "add"}]})),
        (2, 0, None, None),
        (2, 1, "user", "{broken"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string")
    out = tool_calls.link_tool_calls(df, {"add": {"x": ("integer", True), "y": ("number", True)}}).collect()
    got = {(r.conv, r.turn, r.part): r for r in out}
    status = {k: r.status for k, r in got.items() if k != ("1", 0, 0)}
    assert status == {("1", 1, 0): "answered", ("1", 1, 1): "answered", ("1", 1, 2): "duplicate", ("1", 2, 0): "linked", ("1", 4, 0): "orphan", (None, 0, 0): "blocked", (None, 0, 1): "blocked", (None, 0, 2): "no_id", ("2", 0, 0): "text", ("2", 1, 0): "text"}
    assert got["1", 1, 0].valid and got["1", 1, 0].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","role":"assistant"}'
    assert got["1", 1, 1].errors == ["missing:y", "type:x"] and got[None, 0, 0].errors == ["unexpected:w"]
    assert got["1", 1, 2].errors == ["unknown_tool"] and got[None, 0, 1].errors == ["arguments_not_object"]
    assert got["1", 2, 0].json == '{"content":{"a":[3,{"b":2,"q":1}],"z":1},"role":"tool","tool_call_id":"b"}'
    early = next(r for r in out if r.kind == "result" and r.call_id == "a")
    call = got["1", 1, 0]
    assert (early.order_turn, early.level) > (call.order_turn, call.level)
    assert got["2", 0, 0].json == '{"role":null,"text":null}'
    assert tool_calls.link_tool_calls(df.limit(0), {}).count() == 0


def test_call_chains_are_layered(spark):
    calls = [{"id": f"c{i}", "name": "f", "arguments": {}, "after": [f"c{j}" for j in range(i + 1, min(i + 3, 6))]} for i in range(6)]
    df = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id long, turn long, role string, text string")
    level = {r.call_id: (r.order_turn, r.level) for r in tool_calls.link_tool_calls(df, {"f": {}}).collect()}
    assert all(level[c["id"]] > level[d] for c in calls for d in c["after"])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    columns = sorted(expected.columns)
    got = queries.queries()[name](spark, tiny).select(*columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_op10_keeps_every_turn_and_its_order(spark, tiny):
    out = queries.op10_tool_calls(spark, tiny)
    turns = spark.read.parquet(f"{tiny}/conversations.parquet")
    assert out.count() == turns.count()
    assert {r.status for r in out.select("status").distinct().collect()} >= {"answered", "blocked", "linked", "text"}
    assert out.filter("kind = 'call' and not valid").count() > 0
    placed = out.filter("level is not null")
    late = placed.filter("kind = 'result'").alias("r").join(placed.filter("kind = 'call'").alias("c"), ["conv", "call_id"])
    assert late.filter("(r.order_turn, r.level) <= (c.order_turn, c.level)").count() == 0


def levels(calls):
    """(turn, level) by call id of what can be placed, layer by layer."""
    done, last = {}, None
    while last != len(done):
        last = len(done)
        for name, (turn, after) in calls.items():
            if name not in done and all(d in done for d in after):
                done[name] = (max([turn, *[done[d][0] for d in after]]), max([-2, *[done[d][1] for d in after]]) + 2)
    return done


@pytest.mark.parametrize("seed", range(3))
def test_calls_are_placed_as_layer_by_layer(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for conv in range(6):
        n = rng.choice((1, 12, 40))
        names = [f"c{i}" for i in range(n)]
        calls = {}
        for i, name in enumerate(names):
            kind = rng.random()
            after = [] if i == 0 or kind < 0.1 else [names[i - 1]] if kind < 0.75 else rng.sample(names[:i], min(i, rng.randint(1, 3)))
            if rng.random() < 0.03:
                after = [*after, rng.choice([*names, "nowhere"])]
            calls[name] = (rng.randint(0, 30), list(dict.fromkeys(after)))
        expected |= {(str(conv), k): v for k, v in levels(calls).items()}
        rows += [(conv, turn, "assistant", json.dumps({"tool_calls": [{"id": k, "name": "f", "arguments": {}, "after": after}]})) for k, (turn, after) in calls.items()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = tool_calls.link_tool_calls(df, {"f": {}}).collect()
    assert {(r.conv, r.call_id): (r.order_turn, r.level) for r in out if r.level is not None} == expected
    assert {r.status for r in out if r.level is None} <= {"blocked"}


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    toxic = p.reject_toxic(spark, docs, tiny)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    ids = {r.doc_id for r in toxic.select("doc_id").collect()}
    assert toxic.columns == columns and not any(labels.get(i) for i in ids)
    near = p.drop_near_copies(spark, docs.union(docs.limit(3)), tiny)
    assert near.columns == columns and near.count() == near.select("text").distinct().count()
    cut = p.drop_repeated_spans(spark, docs, tiny)
    assert cut.columns == columns and cut.count() == docs.count() and cut.filter("n_chars <> length(text)").count() == 0
    clean = p.drop_benchmark_leaks(spark, docs, tiny)
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    left = [r.text for r in clean.collect()]
    assert clean.columns == columns and not any(i in t for i in items for t in left)
    mixed = p.mix(spark, docs, tiny)
    assert mixed.filter("taken <= 0 or taken > 3 * size").count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), tiny).count() == 0


def test_pipeline_runs_whole(spark, tiny):
    import corpus_pipeline as p

    out = p.run(spark, tiny)
    assert out.count() > 0 and "taken" in out.columns
    assert out.agg(F.sum("taken")).first()[0] > 0


def pipeline_tables(seed=4):
    """Documents with toxic words, near copies, shared passages and leaks."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, items = [text(30) for _ in range(3)], [(i, " ".join(text(12))) for i in range(4)]
    docs = []
    for i in range(150):
        kind = rng.random()
        body = text(rng.randint(20, 80))
        if kind < 0.25 and docs:
            body = list(rng.choice(docs)[1].split()) or body
            body[rng.randrange(len(body))] = "edited"
        elif kind < 0.4:
            body[5:5] = rng.choice(passages)
        elif kind < 0.5:
            body[7:7] = rng.choice(items)[1].split()
        elif kind < 0.65:
            body[rng.randrange(len(body))] = "vile"
        docs.append((i, " ".join(body), "en", rng.choice(["a", "a", "b", "c"]), 0))
    docs = [(i, t, lang, source, len(t)) for i, t, lang, source, _ in docs]
    docs += [(150, None, "en", "a", None), (151, "", "en", None, 0), docs[3]]
    labels = [(d[0], rng.choice([0, 1]), int("vile" in d[1].split())) for d in docs[:150] if rng.random() < 0.8]
    return docs, labels, items


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    import naive

    from marginalia.llm import decontaminate, toxicity

    docs, labels, items = pipeline_tables()
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (items, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    cut = lambda t: naive.buckets(t or "", toxicity.STRIP, toxicity.BUCKETS)
    place = {r[0]: r[1] for r in spark.range(200).select("id", F.xxhash64("id")).collect()}
    toxic, text = {i: t for i, _, t in labels}, {d[0]: d[1] for d in docs}
    # the repeated document is learnt twice
    order = sorted((d[0] for d in docs if d[0] in toxic), key=place.__getitem__)
    model = naive.Ftrl([sorted(cut(text[i])) for i in order], [toxic[i] for i in order])
    left = [d for d in docs if model.chance(cut(d[1])) < 0.5]
    assert len(left) < len(docs)
    rows, links = naive.jaccard_links(left)
    keep = {rows[i][0] for i in links if rows[i][0] == min(rows[j][0] for j in naive.component_of(links, i))}
    near = [d for d in dict.fromkeys(left) if d[0] in keep]
    assert len(near) < len(left)
    cuts = naive.spans(near, 20)
    spans = [d if not cuts[d[0]][0][1] else (d[0], cuts[d[0]][0][2], *d[2:]) for d in near]
    assert spans != near
    leaks = naive.leaks([(d[0], d[1]) for d in spans], items, decontaminate.LEAST, decontaminate.THRESHOLD, decontaminate.STRIP)
    clean = [d for d in spans if not leaks[d[0]][0]]
    assert len(clean) < len(spans)
    worth = {i: queries.QUALITY[q] for i, q, _ in labels}
    taken = naive.mixed([(d[0], d[3], len(naive.words(d[1]))) for d in clean], worth)
    assert {r.doc_id: r.taken for r in p.run(spark, str(tmp_path)).collect()} == {i: n for i, n in taken.items() if n > 0}


def test_stages_keep_columns_that_clash(spark, tmp_path):
    import corpus_pipeline as p

    docs, labels, items = pipeline_tables(5)
    for name, rows, schema in (("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    clashing = ("score", "kept", "n_removed", "coverage", "size", "key", "node")
    df = spark.createDataFrame(docs[:40], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in clashing})
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and all(r[c] == c for r in out.select(*clashing).distinct().collect() for c in clashing)
    assert p.mix(spark, df, str(tmp_path)).count() > 0


def test_very_long_urls(spark):
    rules = [url_filter.UrlRule(*r) for r in queries.SITE_RULES]
    pages = spark.createDataFrame([(1, "http://x.net/fr/" + "a/" * 200_000), (1, "http://x.net/fr/" + "a/" * 200_000)], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, rules).collect()] == ["block", "block"]


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (1, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string").withColumns({"node": F.lit(1), "kept": F.lit(2), "id": F.lit(3)})
    assert {(r.id, r.n_links, r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect()} == {(1, 1, True), (2, 1, False)}
