"""Merkle manifests, hard negatives and token counts against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import hard_negatives, merkle, queries, token_counts


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


class Tree:
    """The levels of a tree over digests, as lists."""

    def __init__(self, leaves, arity):
        self.arity, self.levels = arity, [leaves]
        while len(self.levels[-1]) > 1:
            last = self.levels[-1]
            self.levels.append([sha(*last[i : i + arity]) for i in range(0, len(last), arity)])
        self.root = self.levels[-1][0]

    def proof(self, i):
        """(left, right) siblings of each level."""
        out = []
        for level in self.levels[:-1]:
            start = i // self.arity * self.arity
            out.append((level[start:i], level[i + 1 : start + self.arity]))
            i //= self.arity
        return out


def plain_manifest(rows, arity):
    """Sorted (doc_id, leaf, subroot, root, proof digest, folded root) of rows (doc_id, source, text, seen)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaf = lambda r, text: sha(*map(field, (r[0], r[1], text)))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[2])))
        trees[s] = (mine, Tree([leaf(r, r[2]) for r in mine], arity))
    top = Tree([trees[s][1].root for s in sources], arity) if sources else None
    out = []
    for n, s in enumerate(sources):
        mine, tree = trees[s]
        for i, r in enumerate(mine):
            proof = tree.proof(i) + top.proof(n)
            node = leaf(r, r[3])
            for left, right in proof:
                node = sha(*left, node, *right)
            out.append((r[0], tree.levels[0][i], tree.root, top.root, sha(*[x for left, right in proof for x in left + right]), node))
    return sorted(out, key=str)


def manifest(spark, rows, arity):
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, source string, text string, seen string, idx int, digest string")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col(text)]
    carry = {"doc_id": F.col("doc_id"), "seen": merkle.leaf_digest(fields("seen"))}
    made = merkle.merkle_manifest(docs, fields("text"), group=F.col("source"), order=F.col("doc_id"), carry=carry, arity=arity)
    out = made.select("carry.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.as_text(merkle.fold(F.col("carry.seen"), F.col("path"))))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_is_that_of_plain_trees(spark, arity):
    rng = random.Random(arity)
    rows = [(i, rng.choice(["b", "ä", "", None, "a"]), rng.choice(["", "Ein Wort", None, "x" * 50_000, str(i)]), None) for i in range(60)]
    rows = [(*r[:3], r[2] if rng.random() < 0.7 else "other") for r in rows]
    rows += [(None, "a", "x", "x"), (None, "a", "y", "y"), (7, None, None, ""), (200, "alone", "z", "z"), *[(5, "copies", "same", "same")] * 40]
    rng.shuffle(rows)
    assert manifest(spark, rows, arity) == plain_manifest(rows, arity)


def test_manifest_of_few_rows(spark):
    assert manifest(spark, [], 16) == []
    assert manifest(spark, [(1, "s", "t", "t")], 16) == plain_manifest([(1, "s", "t", "t")], 16)
    assert manifest(spark, [(1, "s", "t", "T")], 16)[0][-1] != plain_manifest([(1, "s", "t", "t")], 16)[0][3]
    with pytest.raises(ValueError, match="arity"):
        manifest(spark, [(1, "s", "t", "t")], 1)


def test_counts_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, str(i % 5), str(i), str(i)) for i in range(100)]
    monkeypatch.setattr(merkle, "SMALL", 0)
    assert manifest(spark, rows, 4) == plain_manifest(rows, 4)


# -- hard negatives ---------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95, scale=256, every=5):
    """By all scores in whole numbers."""
    kept = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = tuple(int(np.floor(np.float64(x) * scale)) for x in v)
        if sum(x * x for x in v) < 2**62:
            kept.add((i, label, v))
    out = set()
    for i, label, v in kept:
        if i % every:
            continue
        others = {(-sum(a * b for a, b in zip(v, w)), j, m == label) for j, m, w in kept if j != i and len(w) == len(v)}
        for score, j, _ in sorted(x for x in others if x[2])[:positives]:
            ps = -score
            fit = sorted(x for x in others if not x[2] and low * ps <= 100 * -x[0] <= high * ps)
            out |= {(i, j, n + 1, k, ps, -s) for n, (s, k, _) in enumerate(fit[:negatives])}
    return sorted(out)


def negatives(spark, rows, **more):
    kinds = "vec_id long, label int, embedding array<double>, score double, row int, anchor int"
    table = spark.createDataFrame([(*r, 0.0, 1, 2) for r in rows], kinds)
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 5 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def clustered(seed, n, dim, lengths=(1.0, 1.0)):
    """Vectors about a few directions, of several lengths, with labels that often disagree."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(6))
        v = base[c] + rng.normal(scale=0.4, size=dim)
        rows.append((i, c % 3 if rng.random() < 0.7 else int(rng.integers(3)), (v / np.linalg.norm(v) * rng.uniform(*lengths)).tolist()))
    return rows


ODD = [(1000, None, [1.0] * 4), (1005, 0, None), (1010, 0, [1.0, None, 0.0, 0.0]), (1015, 1, [float("nan")] * 4), (1020, 1, [float("inf")] * 4), (1025, 1, []), (1026, 1, []), (1027, 2, []), (None, 0, [1.0] * 4), (1030, 0, [1e300] * 4), (1035, 0, [0.0] * 4), (1036, 1, [0.0] * 4), (1040, 0, [-1.0] * 4), (1045, 0, [5e6, 1.0, 1.0, 1.0]), (1046, 1, [3e6, 1.0, 1.0, 1.0]), (1047, 0, [4e6, 3.0, 1.0, 1.0])]


@pytest.mark.parametrize(("seed", "dim", "lengths"), [(1, 4, (1.0, 1.0)), (2, 4, (0.1, 3.0)), (3, 12, (0.5, 2.0))])
def test_negatives_are_those_of_all_scores(spark, monkeypatch, seed, dim, lengths):
    monkeypatch.setattr(hard_negatives, "BUCKET", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    rows = clustered(seed, 300, dim, lengths) + ODD + [(7, 1, clustered(seed, 8, dim)[7][2])]
    rows += [rows[10]] * 30 + [(2000 + i, i % 2, rows[20][2]) for i in range(60)]
    assert negatives(spark, rows) == plain_negatives(rows)


def test_negatives_by_other_shares_and_no_anchors(spark, monkeypatch):
    rows = clustered(5, 120, 6)
    assert negatives(spark, rows, positives=2, negatives=7, low=-50, high=120) == plain_negatives(rows, 2, 7, -50, 120)
    monkeypatch.setattr(hard_negatives, "FEW_BLOCKS", 0)
    assert negatives(spark, rows, label=F.lit(1)) == []
    assert negatives(spark, rows) == plain_negatives(rows)
    assert negatives(spark, []) == []
    assert negatives(spark, [r for r in rows if r[0] % 5]) == []


def test_coordinate_lists_leave_few_candidates():
    """Rows that can do are always among the candidates, and in tight clusters few others are."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    v = np.floor(256 * (base[rng.integers(40, size=2000)] + rng.normal(scale=0.05, size=(2000, 8)))).astype(np.int64)

    def block(v, lists):
        order = np.lexsort(((v * v).sum(1),))
        v = v[order].astype(np.int32)
        units = hard_negatives.unit(v.astype(float), np.sqrt((v.astype(float) ** 2).sum(1)))
        listed = np.ascontiguousarray(np.argsort(units, axis=0, kind="stable").T.astype(np.uint16)).tobytes() if lists else b""
        return hard_negatives.Block(8, np.arange(len(v)).tobytes(), ["x"] * len(v), v.tobytes(), listed)

    bucket, anchors = block(v, True), block(v[:50], False)
    scores = anchors.whole.astype(np.int64) @ bucket.whole.astype(np.int64).T
    bound = (0.9 * anchors.lengths * bucket.most).astype(np.int64)
    dense, sparse = hard_negatives.candidates(anchors, bound, bucket)
    found = {i: set(rows.tolist()) for i, rows in sparse}
    for i in range(50):
        able = set(np.flatnonzero(scores[i] >= bound[i]).tolist())
        assert i in dense or able <= found.get(i, set())
    assert len(dense) < 10
    assert np.mean([len(x) for x in found.values()]) < 400
    none = np.full(50, 1 << 61)
    assert [len(x) for x in hard_negatives.candidates(anchors, none, bucket)] == [0, 0]


# -- token counts ------------------------------------------------------------------------


def plain_counts(texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    return [len(made.encode(t or "", add_special_tokens=False)) for t in texts]


TEXTS = ["Hello world", "", None, "Hello world", "It's 3.14  and\n\n\tmore  　x", "<|endoftext|> a<|endoftext|>b", "naïve ſtraße 漢字 🙂" * 50, " " * 3000, "x" * 5000, "a\r\n b  c\x1c d\x85e " * 4000, "word " * 120_000]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.Vocabulary(public_tokenizers.path(queries.VOCABULARY))


def read_store(spark, store):
    return spark.read.parquet(store)


@pytest.mark.parametrize("few", [0, 100_000])
def test_counts_are_the_library_s_and_only_misses_are_encoded(spark, tmp_path, monkeypatch, vocabulary, few):
    monkeypatch.setattr(token_counts, "PIECE", 1000)
    store = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, t, 1, b"x", "v") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, digest binary, version string")
    expected = [(i, len((t or "").encode()), n, b"x", "v") for i, (t, n) in enumerate(zip(TEXTS, plain_counts(TEXTS)))]

    def counted(docs):
        rows = token_counts.count_tokens(docs, vocabulary, store, few=few).collect()
        return sorted((r.doc_id, r.n_bytes, r.n_tokens, bytes(r.digest), r.version) for r in rows)

    assert counted(docs.filter("doc_id < 4")) == expected[:4]
    first = read_store(spark, store).collect()
    assert len(first) == 2  # the empty text is the null's, and one text is there twice
    seen = {bytes(r.digest) for r in first}
    assert counted(docs) == expected
    every = read_store(spark, store)
    assert every.count() == len({t or "" for t in TEXTS})
    assert {r.version for r in every.collect()} == {vocabulary.version}
    assert seen < {bytes(r.digest) for r in every.collect()}
    assert counted(docs) == expected
    assert read_store(spark, store).count() == len({t or "" for t in TEXTS})


def test_stored_counts_answer_and_versions_stay_apart(spark, tmp_path, vocabulary):
    store = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "Hello world"), (2, "Hello world"), (None, "other")], "doc_id long, text string")
    forged = spark.createDataFrame([(vocabulary.version, hashlib.sha256(b"Hello world").digest(), 99), ("another", hashlib.sha256(b"other").digest(), 98)], token_counts.COUNTS)
    forged.write.partitionBy("version").parquet(store)
    rows = token_counts.count_tokens(docs, vocabulary, store).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 99), (2, 99)]
    assert {r.n_tokens for r in token_counts.stored(spark, store, vocabulary.version).collect()} == {99, 1}


def test_counts_of_nothing_and_of_repeated_rows(spark, tmp_path, vocabulary):
    store = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "a b c")] * 300, "doc_id long, text string")
    assert token_counts.count_tokens(docs.limit(0), vocabulary, store).collect() == []
    assert [tuple(r) for r in token_counts.count_tokens(docs, vocabulary, store).collect()] == [(1, 5, 3)] * 300
    assert read_store(spark, store).count() == 1
    assert [tuple(r) for r in token_counts.count_tokens(docs.select("text"), vocabulary, store).limit(1).collect()] == [(5, 3)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_libraries_and_normalised_texts(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    words = token_counts.Vocabulary(path)
    assert not words.pieces
    texts = ["Hello World", "hello world", "", None, "Ünicode <|endoftext|> x " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lower = F.lower if name.endswith(".json") else None
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, words, str(tmp_path / "s"), normalise=lower).collect()}
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        assert found == {i: len(made.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
        assert read_store(spark, str(tmp_path / "s")).count() == 3
    else:
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_file=path)
        assert found == {i: len(made.encode(t or "")) for i, t in enumerate(texts)}


def test_pieces_add_up():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\t", "'s", "1", "!", " ", "\x1d", "é"]) for _ in range(rng.randrange(60)))
        cut = list(token_counts.pieces(text, 5))
        assert "".join(cut) == text
        assert sum(plain_counts(cut)) == plain_counts([text])[0]


def test_op13_is_the_library_s(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    expected = {d.doc_id: n for d, n in zip(docs, plain_counts([d.text for d in docs]))}
    found = queries.op13_token_counts(spark, tiny).collect()
    assert {r.doc_id: r.n_tokens for r in found} == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert {r.doc_id: r.n_bytes for r in found} == {d.doc_id: len((d.text or "").encode()) for d in docs}
