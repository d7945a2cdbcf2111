"""Operators on texts against brute force, and their defined cases."""

import math
import random
import re
import zlib

import naive
import pytest
from naive import component_of, filled, jaccard_links, spans, words
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, jaccard_join, langid, licenses, mixing, queries, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(seed=1, n=60, vocabulary=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(vocabulary)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 90))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, rows[0][1], "en", "s1", 0), (n + 3, "three short words", "en", "s1", 0)]
    rows += [(n + 4, " \t\n ", "en", "s1", 0), (n + 5, "long " * 5000, "en", None, 0), (0, rows[0][1], "en", "s0", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(3)


@pytest.mark.parametrize("window", [1, 6, 11, 20, 30])
def test_spans_are_those_of_brute_force(spark, docs, window):
    found = {}
    for r in substring_dedup.remove_repeated_spans(docs, window=window).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_text or ""))
    assert {k: sorted(v) for k, v in found.items()} == spans(some_docs(), window)


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21, 31])
def test_covers_meet_at_every_shift(period):
    cover = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_spans_pass_other_columns_and_replace_clashing_ones(spark, docs):
    out = substring_dedup.remove_repeated_spans(docs.withColumn("n_removed", F.lit("x")).withColumn("extra", F.lit(1)))
    assert dict(out.dtypes)["n_removed"] == "bigint" and "extra" in out.columns
    assert out.filter("doc_id = 60").select("kept_text").first()[0] is None
    assert substring_dedup.remove_repeated_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 256])
def test_jaccard_join_is_that_of_brute_force(docs, chunk):
    rows, links = jaccard_links(some_docs())
    expected = sorted((rows[i][0], len(links[i]), min(rows[j][0] for j in component_of(links, i))) for i in links)
    found = jaccard_join.jaccard_join(docs, chunk=chunk).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_jaccard_join_of_nothing(docs):
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0
    null = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(1)
    assert jaccard_join.jaccard_join(null).first().doc_id is None


def test_prefixes_are_as_long_as_recall_allows():
    depth = jaccard_join.prefix_length(0.8)
    assert depth <= jaccard_join.DEEPEST
    assert 1 - (1 - 0.8**depth) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard_join.TREES


def test_tiling_finds_reordered_passages():
    import pyarrow as pa

    item = " ".join(f"a{i}" for i in range(20))
    parts = item.split()
    moved = " ".join(["x", *parts[12:], "y", *parts[:6], "z", *parts[6:12]])
    (flat, at), (doc, _) = decontaminate.tokens(pa.array([item])), decontaminate.tokens(pa.array([moved]))
    assert decontaminate.tiled(flat, doc) == 20
    assert decontaminate.tiled(flat, doc[::-1]) == 0
    # the longest match comes first, so the overlap goes to it
    assert decontaminate.tiled(flat[:8], flat[[0, 1, 2, 3, 30 % 20, 2, 3, 4, 5, 6, 7]]) >= 6


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank today"
    w = item.split()
    rows = [(1, f"Well, {item}! And more."), (2, " ".join(w[7:] + ["and"] + w[:7]).upper()), (3, "nothing of the kind " * 50), (4, None), (5, ""), (6, " ".join(w[:5])), (7, "tiny item")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, coverage int")
    bench = spark.createDataFrame([(5, item), (4, item), (9, "tiny item"), (8, None), (7, "")], "item_id long, text string")
    for passes in (1 << 20, 40):
        found = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench, pass_chars=passes).collect()}
        assert [i for i in sorted(found) if found[i].contaminated] == [1, 2, 7]
        assert (found[1].item_id, found[1].coverage, found[1].n_items) == (4, 1.0, 2)
        assert found[3].item_id is None and found[4].coverage == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).filter("contaminated = 1").count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_toxicity_is_learnt_and_defined(spark):
    rng = random.Random(3)
    plain = [f"p{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(30)] = "Vile!"
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (7, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, learns=F.col("doc_id") < 400)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), model).collect()}
    assert [out[i].predicted for i in range(400, 600)] == [int(i % 5 == 0) for i in range(400, 600)]
    assert out[1000].score == out[1001].score < 0.5
    assert len(model.weights) < 50
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, none).filter("predicted = 1").count() == 0


def longest_phrases(text, sample):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in sample:
            n += 1
        count, i = count + 1, i + max(1, n - 1)
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    parser = langid._Parser(sample)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 250))).strip() or "a" for _ in range(40)]
    clean = [langid.simplified(t) for t in texts]
    bits = langid.bits_a_character(texts, [parser])[:, 0]
    for t, b in zip(clean, bits, strict=True):
        assert math.isclose(b, longest_phrases(t, sample) * parser.bits / max(len(t), 1), abs_tol=1e-12), t


def test_languages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "fr"), (9002, "123 !?", "fr"), (9003, "", None)], "doc_id long, text string, lang string")
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    out = langid.identify_languages(docs.union(odd), langid.fit(docs.union(odd), learns=learns)).collect()
    test = [r for r in out if r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.9 * len(test)
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id > 9000)
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.identify_languages(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = "some words about nothing at all " * 20
    rows = [(1, "a/b/x.txt", f"{filler}\n{mit}\n{filler}"), (2, "a/b/c/y.txt", filler), (3, "a/LICENSE", f"intro\n{gpl}"), (4, "a/b/c/LICENSE.txt", mit), (5, "z/q.txt", filler), (6, None, filler), (7, "a/b/n.txt", None), (8, "z/whole.txt", gpl)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")
    out = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.fit(docs), path=F.col("path")).collect()}
    got = {i: (r.license, r.how, r.from_dir) for i, r in out.items()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a/b/c"), 3: ("GPL-3.0", "own", None), 4: ("MIT", "own", None), 5: ("GPL-3.0", "inherited", "z"), 6: (None, "none", None), 7: ("GPL-3.0", "inherited", "a"), 8: ("GPL-3.0", "own", None)}
    assert licenses.scan_licenses(docs.limit(0), licenses.fit(docs.limit(0)), path=F.col("path")).count() == 0


def test_license_cosine_is_that_of_all_lines():
    weights = licenses.Weights({"released": 4.0, "under": 2.0, "the": 1.1, "mit": 6.0, "license": 5.0}, 7.0, ())
    weights = licenses.Weights(weights.idf, 7.0, (("MIT", weights.vector(licenses.words("Released under the MIT License."))),))
    import pyarrow as pa

    lines = ["released under the mit license", "mit license license", "under the the the", "alien words mit license", "", "mit"]
    may = set(licenses._may_match(weights, pa.array(lines), 0.8).tolist())
    assert {i for i, t in enumerate(lines) if licenses.words(t) and weights.best(licenses.words(t))[0] >= 0.8} <= may


def stated(spark, texts):
    docs = spark.createDataFrame([(i, f"{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return {r.doc_id: r.stated for r in licenses.scan_licenses(docs, licenses.fit(docs), path=F.col("path")).collect()}


def test_license_lines_count_common_words_as_common(spark):
    some = {"released": 166, "mit": 165, "license": 83, "under": 50, "the": 3, "project": 5}
    other = [" ".join(w for w, n in some.items() if i % n == 1) + f" a{i} b{i} c{i}" for i in range(10_000)]
    got = stated(spark, ["Project released under the MIT License.", *other])
    assert got[0] == "MIT" and {v for k, v in got.items() if k} == {None}


def test_license_notices_may_be_wrapped(spark):
    texts = dict(licenses.full_texts())
    body = "\n".join(f"x{i} = call{i}(y{i})" for i in range(400))
    wrapped = "\n".join(f"# {line}" for line in texts["MIT"].splitlines()[:6])
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */"
    got = stated(spark, [f"{wrapped}\n{body}", f"{body}\n{bsd}\n{body}", *texts.values(), *[body.replace("x", f"z{i}") for i in range(500)]])
    assert (got[0], got[1]) == ("MIT", "BSD-3-Clause")
    assert [got[i + 2] for i in range(len(texts))] == list(texts)


def test_mixing_fills_targets(spark, docs):
    rows = [r for r in some_docs(n=200)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs, quality=F.col("doc_id") % 3).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    target = filled(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 3
    assert all(0 <= r.taken <= 3 * r.size and r.size == len(words(r.text)) for r in out)
    again = mixing.mix_sources(docs.repartition(5), quality=F.col("doc_id") % 3).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_quality_is_drawn_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 300 else "b", i % 2) for i in range(600)], "doc_id long, text string, source string, q int")
    out = mixing.mix_sources(docs, quality=F.when(F.col("q") == 1, 8.0).otherwise(1.0), weights=(1, 5))
    drawn = {r.q: r.n for r in out.filter("source = 'a'").groupBy("q").agg(F.sum("taken").alias("n")).collect()}
    assert drawn[1] > 2 * drawn[0]


def test_query_names(spark):
    names = [n for n in queries.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_items_without_an_id_are_leaks_too(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {item} so"), (2, "nothing of it at all")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (5, None)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_items, r.contaminated) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == {1: (decontaminate.NO_ID, 1, 1), 2: (None, 0, 0)}


@pytest.mark.parametrize("seed", range(6))
def test_tiling_is_that_of_brute_force(seed):
    import numpy as np

    rng = random.Random(seed)
    for _ in range(30):
        letters = rng.choice((2, 4, 30))
        item, doc = ([rng.randrange(letters) for _ in range(rng.randint(0, n))] for n in (25, 60))
        if rng.random() < 0.5:
            doc[5:5] = item[len(item) // 2 :] + item[: len(item) // 2]
        least = rng.choice((1, 2, 4))
        a, b = (np.array(x, np.uint64) for x in (item, doc))
        assert decontaminate.tiled(a, b, least) == naive.tiled(item, doc, least)
        few = [tuple(map(int, m)) for m in zip(*decontaminate.matches(a, b, 2, pairs=3))] if min(len(a), len(b)) >= 2 else []
        assert few == ([tuple(map(int, m)) for m in zip(*decontaminate.matches(a, b, 2))] if few else [])


def test_tiling_of_repetitive_texts_is_bounded():
    import time
    import tracemalloc

    import numpy as np

    item, doc = np.zeros(50, np.uint64), np.zeros(300_000, np.uint64)
    start = time.perf_counter()
    tracemalloc.start()
    assert decontaminate.tiled(item, doc) == 50
    assert tracemalloc.get_traced_memory()[1] < 300_000_000 and time.perf_counter() - start < 60
    tracemalloc.stop()


def leak_tables(seed=9):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(1, 14)))) for i in range(12)]
    docs = []
    for i in range(40):
        body = text(rng.randint(0, 40))
        if rng.random() < 0.6:
            w = rng.choice(items)[1].split()
            cut = rng.randint(0, len(w))
            body[len(body) // 2 : len(body) // 2] = [*w[cut:], "x", *w[:cut]][: rng.randint(1, 16)]
        docs.append((i, " ".join(body).title() if i % 3 else " ".join(body) + "!"))
    return docs, items


def test_leaks_are_those_of_brute_force(spark):
    docs, items = leak_tables()
    expected = naive.leaks(docs, items, decontaminate.LEAST, decontaminate.THRESHOLD, decontaminate.STRIP)
    assert 8 < sum(n > 0 for n, _ in expected.values()) < len(docs)
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_items, r.item_id if r.n_items else None) for r in found} == expected


def test_toxicity_is_that_of_dictionaries(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["vile!", "Calm", "so", "it", "is,", "was", f"n{i % 7}"]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    labels = [(i, int("vile!" in t and "so" in t)) for i, t in rows if i % 4]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    place = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    order = sorted((i for i, _ in labels), key=place.__getitem__)
    texts, toxic = dict(rows), dict(labels)
    cut = lambda t: naive.buckets(t, toxicity.STRIP, toxicity.BUCKETS)
    twin = naive.Ftrl([sorted(cut(texts[i])) for i in order], [toxic[i] for i in order])
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, known)).collect()
    assert all(abs(r.score - twin.chance(cut(r.text))) < 1e-5 for r in out)
    assert {r.predicted for r in out} == {0, 1}


def test_toxicity_of_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000 + "vile"), (2, "calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).filter("score between 0 and 1").count() == 2


def test_licenses_are_those_of_brute_force(spark):
    rng = random.Random(12)
    notices = (("MIT", "Released under the MIT License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."))
    full = (("ISC", "permission to use copy modify is hereby granted provided that the notice appears in all copies of it"),)
    other = [f"o{i}" for i in range(30)] + ["the", "license", "under", "work"]

    def wrapped(text):
        w = text.split()
        for _ in range(rng.randint(0, 2)):
            w.insert(rng.randrange(len(w)), rng.choice(other))
        cut = rng.randint(1, len(w))
        return "# " + " ".join(w[:cut]) + "\n# " + " ".join(w[cut:])

    docs = []
    for i in range(60):
        lines = [" ".join(rng.choice(other) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), wrapped(rng.choice(notices)[1]))
        text = full[0][1] if rng.random() < 0.1 else "\n".join(lines)
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))
        name = rng.choice(["LICENSE", "COPYING.txt", f"f{i}.py", f"g{i}.py"])
        docs.append((i, None if i % 17 == 5 else f"{folder}/{name}" if folder else name, None if i % 19 == 3 else text))
    df = spark.createDataFrame(docs, "doc_id long, path string, text string")
    found = licenses.scan_licenses(df, licenses.fit(df, notices, full), path=F.col("path")).collect()
    expected = naive.licensed(docs, notices, full, licenses.THRESHOLD, licenses.SPAN, licenses.words, licenses.FILE_NAMES)
    assert {r.doc_id: (r.license, r.how, r.from_dir) for r in found} == expected
    assert {h for _, h, _ in expected.values()} == {"own", "inherited", "none"}


@pytest.mark.parametrize("language", range(2))
def test_long_texts_are_parsed_in_groups(language, monkeypatch):
    rng = random.Random(language)
    parser = langid._Parser("".join(rng.choice("abc ") for _ in range(300)))
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (10, 3000, 0, 700)]
    once = langid.bits_a_character(texts, [parser])
    monkeypatch.setattr(langid, "TOGETHER", 600)
    assert (once == langid.bits_a_character(texts, [parser])).all()


def test_language_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "un deux trois", "fr", "x"), (1, "un deux trois", "fr", "x"), (2, "eins zwei drei", "de", "y")], "doc_id long, text string, lang string, score string")
    out = langid.identify_languages(docs, langid.fit(docs)).collect()
    assert [r.lang_pred for r in sorted(out, key=lambda r: r.doc_id)] == ["fr", "fr", "de"] and all(isinstance(r.score, float) for r in out)
    assert langid.identify_languages(docs.limit(0), langid.fit(docs)).count() == 0


def test_labels_are_those_of_plain_parsing(spark):
    samples = (("de", "der hund und die katze laufen über die straße nach haus"), ("fr", "le chien et le chat courent dans la rue vers la maison"))
    texts = ["die katze und der hund", "le chat et le chien", "la rue", "nach haus"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = lambda t, s: longest_phrases(langid.simplified(t), s) * math.log2(len(s) + 1) / len(langid.simplified(t))
    expected = {i: min(samples, key=lambda x: (bits(t, x[1]), x[0]))[0] for i, t in enumerate(texts)}
    assert {r.doc_id: r.lang_pred for r in langid.identify_languages(docs, samples).collect()} == expected


def test_forest_stops_only_where_no_partner_is_likely():
    least = jaccard_join.least_matched(0.8)
    draw = random.Random(1)
    sums = [sum(next((d for d in range(jaccard_join.DEEPEST) if draw.random() >= 0.8), jaccard_join.DEEPEST) for _ in range(jaccard_join.TREES)) for _ in range(20_000)]
    assert sum(s < least for s in sums) <= 20_000 * 5e-4 and least >= 12


def test_hot_nodes_are_compared_by_their_pivot(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named, links = jaccard_links(rows)
    expected = {(named[i][0], len(links[i])) for i in links}
    for chunk, weight in ((16, 10**9), (10**6, 4000)):
        found = jaccard_join.jaccard_join(docs, chunk=chunk, weight=weight).collect()
        assert {(r.doc_id, r.n_links) for r in found} == expected


def test_mixing_draws_as_by_full_order(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 30)) for i in range(900)]
    worth = {i: rng.choice([0.001, 0.5, 2.0]) for i, _, _ in docs}
    df = spark.createDataFrame([(*d, worth[d[0]], "x") for d in docs], "doc_id long, source string, size long, q double, taken string")
    monkeypatch.setattr(mixing, "ROWS", 5)
    monkeypatch.setattr(mixing, "BINS", 4)
    out = mixing.mix_sources(df, size_col="size", quality=F.col("q")).collect()
    assert {r.doc_id: r.taken for r in out} == naive.mixed(docs, worth)
