"""Token counts with a cache by digest: a text is encoded once, whatever copies of it there are.

The key of a count is two SHA-256 digests: one of the normalised text, one of the tokenizer
(library, its version, the vocabulary file's bytes). Documents are joined by digest to the
counts stored under their tokenizer, the distinct texts without one are encoded, and their
counts are appended to the store, which then answers for all documents.

* Only digests travel to find out what is missing. If few texts are missing (``FEW``, the
  usual case of a store that is kept up to date) their digests are broadcast and the texts
  are picked where they are read; else texts are shuffled by digest once, after each task
  has dropped the copies that it has seen itself, and the missing ones are joined there.
* Documents and counts meet by ``spread_join``: a text with very many copies is joined
  where its rows are.
* The store is a Parquet folder by tokenizer version, appended to by Spark's committer, so a
  lost task leaves nothing behind; counts that two runs append for one text are the same
  and read as one.

The vocabulary file is read on the driver (``MOST_BYTES`` at most) and sent to the tasks. A
long text of a byte-level vocabulary is encoded in pieces that begin at white space after
another character, where such a vocabulary always begins a new token; so a task's memory
does not grow with such a text; one without white space is encoded whole.

``normalise`` is a column function that must not change a count, and so lets more texts
share one; by default texts are taken as they are.

Defined cases: null text: that of an empty one, 0 tokens. Empty text: 0 tokens. Repeated rows
and ties: each row gets its count. Null id: like any. Very long texts: see above. Empty
table: no rows, and nothing is stored. All columns but the text are passed through, whatever
their names; those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import checkpointed, one_array, partitions_for, slices, spread_join

#: Missing texts whose digests are broadcast (32 bytes each).
FEW = 100_000
#: The largest vocabulary file.
MOST_BYTES = 64_000_000
#: Characters of a piece of a long text.
PIECE = 200_000
#: Bytes of text that are encoded together.
TOGETHER = 1_000_000
#: Digests that a task remembers to drop copies before they are shuffled.
REMEMBERED = 200_000
COUNTS = "version string, digest binary, n_tokens long"
EDGE = re.compile(r"(?<=\S)(?=[ \n\t\r])")


class Vocabulary:
    """A public vocabulary file with its library: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str) -> None:
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        with open(path, "rb") as file:
            self.data = file.read()
        self.library = {".json": "tokenizers", ".model": "sentencepiece"}[os.path.splitext(path)[1]]
        release = importlib.metadata.version(self.library)
        self.version = hashlib.sha256(b"\0".join([self.library.encode(), release.encode(), self.data])).hexdigest()
        self.pieces = self.library == "tokenizers" and _byte_level(json.loads(self.data))

    def counter(self) -> Callable[[list[str]], list[int]]:
        """A function from texts to their numbers of tokens, without begin, end or other added tokens."""
        if self.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.data.decode())
        made.no_truncation()
        made.no_padding()
        return lambda texts: [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_level(made: dict) -> bool:
    """Whether every piece of a text that begins at white space after another character is encoded for itself."""
    cut = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    added = made.get("added_tokens") or []
    return plain and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about that many characters, each beginning at white space after another character."""
    at = 0
    while len(text) - at > size:
        edge = EDGE.search(text, at + size)
        if not edge:
            break
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


def unseen(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    """The rows without those whose digest is among about so many that were seen before."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for x in batch.column("digest").to_pylist():
            fresh.append(x not in seen)
            if fresh[-1]:
                if len(seen) >= memory:
                    seen.clear()
                seen.add(x)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(version, digest, n_tokens) of the rows (digest, text), which are sorted by digest within partitions."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        words = shared.value
        count = words.counter()
        for batch in unseen(batches, 1):
            for some in slices(batch, "text", TOGETHER):
                cut = [list(pieces(x)) if words.pieces else [x] for x in one_array(some.column("text")).to_pylist()]
                flat, counts, at = [y for x in cut for y in x], [], 0
                while at < len(flat):
                    to, room = at + 1, TOGETHER - len(flat[at])
                    while to < len(flat) and len(flat[to]) <= room:
                        room -= len(flat[to])
                        to += 1
                    counts += count(flat[at:to])
                    at = to
                parts = iter(counts)
                sums = [sum(next(parts) for _ in x) for x in cut]
                yield pa.RecordBatch.from_arrays([pa.array([words.version] * len(sums), pa.string()), one_array(some.column("digest")), pa.array(sums, pa.int64())], names=["version", "digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(encode, COUNTS)


def stored(spark: SparkSession, store: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the store has under a version, one row a digest."""
    try:
        found = spark.read.schema(COUNTS).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, store: str, *, text_col: str = "text", normalise: Callable[[Column], Column] | None = None, few: int = FEW) -> DataFrame:
    """The documents without their text, with ``n_bytes`` (of the text as UTF-8) and ``n_tokens``.

    ``store`` is the folder of the counts; afterwards it has those of all the documents.
    """
    spark, n = docs.sparkSession, partitions_for(docs)
    given = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(given) if normalise else given
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    light = checkpointed(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0)]).alias("row"), digest, F.octet_length(given).cast("long").alias("n_bytes")))

    missing = light.select("digest").distinct().join(stored(spark, store, vocabulary.version), "digest", "left_anti")
    missing = checkpointed(missing)
    count = missing.count()
    if count:
        texts = docs.select(digest, text.alias("text"))
        once = lambda batches: unseen(batches, REMEMBERED)
        if count <= few:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").mapInArrow(once, "digest binary, text string").repartition(n, "digest")
        else:
            texts = texts.mapInArrow(once, "digest binary, text string").repartition(n, "digest").join(missing, "digest", "left_semi")
        new = encoded(texts.sortWithinPartitions("digest"), vocabulary)
        new.hint("rebalance").write.mode("append").partitionBy("version").parquet(store)
    out = spread_join(light, stored(spark, store, vocabulary.version), "digest")
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "n_bytes", "n_tokens")
