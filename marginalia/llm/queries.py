"""The queries of the training-corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, hard_negatives, jaccard_join, langid, licenses, merkle, mixing, substring_dedup, token_counts, tool_calls, toxicity, url_filter
from .common import checkpointed, held_out, learns, read, shared_folder

SITE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.UrlRule(*r) for r in SITE_RULES] + list(url_filter.DEFAULT_PATTERNS)
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).drop("url")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 2), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 3), '') AS rest
  FROM pages
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), q AS (
  SELECT p.*,
    (SELECT max({'n': length(rhost || rpath), 'v': rverdict, 't': rhost || rpath}) FROM r
      WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best,
    (SELECT min(t) FROM (VALUES ('?ref='), ('&ref='), ('?affid='), ('&affid='), ('.casino.'), ('-casino-'), ('/casino/'), ('.porn.'), ('/porn/'), ('/torrent/'), ('/warez/')) AS s(t)
      WHERE contains(host || path || rest, t)) AS literal,
    CASE WHEN regexp_matches(host || path || rest, '\.xxx([^a-zA-Z0-9._%-]|$)') THEN '.xxx^' END AS tld
  FROM p
)
SELECT page_id, host, path, best.t AS rule, coalesce(least(literal, tld), literal, tld) AS pattern,
  coalesce(best.v, CASE WHEN literal IS NOT NULL OR tld IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM q
"""


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str, folds: bool) -> toxicity.Model:
    return toxicity.fit(docs, read(spark, sf_dir, "labels"), learns=learns() if folds else None)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir, True))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = langid.fit(docs, learns=learns())
    judged = langid.identify_languages(docs.select("doc_id", "text"), samples)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.remove_repeated_spans(docs, window=20, with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20
), k AS (
  SELECT s.doc_id, s.s, md5(array_to_string(d.w[s.s : s.s + 19], ' ')) AS k FROM s JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE nth > 1
), l AS (
  SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs).drop("text_key")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_items", "contaminated")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/lang/; every fiftieth is its folder's LICENSE."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    name = F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", name)
    return licenses.scan_licenses(docs, licenses.fit(docs), path=path)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


#: Weights of the draw by a document's quality label.
QUALITY = {1: 2.0, 0: 0.5}


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``__quality``: the draw's weight from the label, null without one."""
    known = read(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__label"))
    worth = F.when(F.col("__label") == 1, QUALITY[1]).when(F.col("__label") == 0, QUALITY[0])
    return docs.join(known, "doc_id", "left").withColumn("__quality", worth).drop("__label")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    # words are counted before the join with the labels, so no text is shuffled
    docs = checkpointed(with_quality(spark, docs, sf_dir))
    mixed = mixing.mix_sources(docs, size_col="size", quality=F.col("__quality"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, CASE WHEN max(quality) = 1 THEN 2.0 WHEN max(quality) = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS worth
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(worth, 1.0) AS k
  FROM documents LEFT JOIN w USING (doc_id)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), v AS (
  SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap, 3 * source_size / ((place - 1) % 3 + 1)::DOUBLE AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS here
  FROM v WINDOW f AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(here, {'r': ratio, 'p': place}) FROM l WHERE here <= ratio) * weight, cap::DOUBLE)) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), h AS (
  SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM g
), r AS (
  SELECT d.doc_id, d.size, h.source_size, h.target, h.epochs, h.rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM r
"""


#: The tools of the derived calls of op10.
REPLY_SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a call of a tool, each assistant turn as the result of the call before it.

    A call waits for the conversation's call before it, some also for the one before that;
    some wait for a call that is not there, some for the next, which makes a circle. Some
    arguments lack one, have one of another type, one too many, or come as a string, and
    some calls are of a tool that is not known.
    """
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn, conv = F.col("turn"), F.col("conv_id")
    name = lambda turn: F.concat_ws("-", conv.cast("string"), turn.cast("string"))
    bent = lambda n: (conv * 7 + turn) % n == 0
    kind = (conv * 3 + turn) % 10
    prompt = F.coalesce("text", F.lit(""))
    arguments = (
        F.when(kind == 1, F.to_json(F.struct(prompt.alias("prompt"), turn.cast("string").alias("turn"))))
        .when(kind == 2, F.to_json(F.struct(turn.alias("turn"))))
        .when(kind == 3, F.to_json(F.struct(F.lit(True).alias("loud"), prompt.alias("prompt"), turn.alias("turn"))))
        .otherwise(F.to_json(F.struct(prompt.alias("prompt"), turn.alias("turn"))))
    )
    after = F.array_compact(F.array(F.when(turn >= 2, name(turn - 2)), F.when((turn >= 4) & ((conv + turn) % 5 == 0), name(turn - 4)), F.when(bent(41), F.lit("nowhere")), F.when(bent(43), name(turn + 2))))
    tool = F.when((conv + turn) % 61 == 0, "shout").otherwise("reply")
    # arguments are JSON already, so the call is put together around them; some have them as a string
    quoted = F.regexp_extract(F.to_json(F.struct(arguments.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)
    given = F.when(kind % 5 == 4, quoted).otherwise(arguments)
    call = F.concat(F.lit('{"tool_calls":[{"after":'), F.to_json(after), F.lit(',"arguments":'), given, F.lit(',"id":"'), name(turn), F.lit('","name":"'), tool, F.lit('"}]}'))
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), prompt.alias("content")))
    text = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text"))
    return tool_calls.link_tool_calls(turns.withColumn("text", text), REPLY_SCHEMAS)


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(text, '') AS prompt, conv_id || '-' || turn AS id, (conv_id * 3 + turn) % 10 AS kind,
    CASE WHEN (conv_id + turn) % 61 = 0 THEN 'shout' ELSE 'reply' END AS name,
    (conv_id * 7 + turn) % 41 = 0 OR (conv_id * 7 + turn) % 43 = 0 OR (turn >= 2 AND lag(turn) OVER w IS DISTINCT FROM turn - 2)
      OR (turn >= 4 AND (conv_id + turn) % 5 = 0 AND lag(turn, 2) OVER w IS DISTINCT FROM turn - 4) AS bad,
    row_number() OVER w AS nth
  FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), k AS (
  SELECT *, CASE WHEN bool_or(bad) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) THEN NULL ELSE (2 * (nth - 1))::INT END AS level FROM c
), r AS (
  SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS id, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant'
), x AS (
  SELECT k.conv_id, k.turn, 'user' AS role, 'call' AS kind, k.id AS call_id, k.name,
    CASE WHEN level IS NULL THEN 'blocked' WHEN r.id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    CASE WHEN level IS NOT NULL THEN k.turn END AS order_turn, level,
    CASE WHEN k.name = 'shout' THEN ['unknown_tool'] WHEN k.kind = 1 THEN ['type:turn'] WHEN k.kind = 2 THEN ['missing:prompt'] WHEN k.kind = 3 THEN ['unexpected:loud'] ELSE [] END AS errors,
    json_object('arguments', CASE k.kind WHEN 1 THEN json_object('prompt', prompt, 'turn', k.turn::VARCHAR) WHEN 2 THEN json_object('turn', k.turn) WHEN 3 THEN json_object('loud', true, 'prompt', prompt, 'turn', k.turn) ELSE json_object('prompt', prompt, 'turn', k.turn) END, 'id', k.id, 'name', k.name, 'role', 'user')::VARCHAR AS json
  FROM k LEFT JOIN r ON k.id = r.id
  UNION ALL
  SELECT r.conv_id, r.turn, 'assistant', 'result', r.id, NULL, CASE WHEN k.id IS NULL THEN 'orphan' ELSE 'linked' END, r.turn,
    CASE WHEN k.id IS NULL THEN 0 ELSE level + 1 END, NULL, json_object('content', content, 'role', 'assistant', 'tool_call_id', r.id)::VARCHAR
  FROM r LEFT JOIN k ON k.id = r.id
  UNION ALL
  SELECT conv_id, turn, role, 'text', NULL, NULL, 'text', turn, 0, NULL, json_object('role', role, 'text', text)::VARCHAR
  FROM conversations WHERE role NOT IN ('user', 'assistant')
)
SELECT conv_id::VARCHAR AS conv, turn, 0 AS part, role, kind, call_id, name, status, order_turn, level, len(errors) = 0 AS valid, errors, json FROM x
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of its source's tree, checked after tampering with some texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    carry = {"doc_id": F.col("doc_id"), "seen": F.when(tampered, merkle.leaf_digest(fields(lower)))}
    made = merkle.merkle_manifest(docs, fields(F.col("text")), group=F.col("source"), order=F.col("doc_id"), carry=carry)
    folded = merkle.as_text(merkle.fold(F.coalesce("carry.seen", F.unhex("leaf")), F.col("path")))
    made = made.select("carry.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_sql(levels: int = 6) -> str:
    """Trees of 16 in SQL, level by level: a node that is alone in its tree stays and has no siblings."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    bit = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})))"
    lower = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    parts = [f"l AS (SELECT *, {leaf('text')} AS leaf, {crc} AS crc, {lower} AS lower_text FROM documents)"]
    parts.append(f"x AS (SELECT *, CASE WHEN crc % 5 = 0 THEN {leaf('lower_text')} ELSE leaf END AS seen, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l)")

    def up(name: str) -> None:
        for n in range(levels):
            run = f"SELECT grp, idx // 16 AS up, list(d ORDER BY idx) AS run, count(*) OVER (PARTITION BY grp) = 1 AND count(*) = 1 AS lone FROM (SELECT DISTINCT grp, idx, d FROM {name}{n}) GROUP BY grp, idx // 16"
            left, right = "array_to_string(run[1 : (idx % 16)::INT], '')", "array_to_string(run[(idx % 16)::INT + 2 :], '')"
            parts.append(
                f"{name}{n + 1} AS (SELECT doc_id, leaf, of, sub, a.grp, up AS idx, CASE WHEN lone THEN d ELSE sha256(array_to_string(run, '')) END AS d, CASE WHEN lone THEN seen ELSE sha256({left} || seen || {right}) END AS seen, "
                f"proof || {left} || {right} AS proof FROM {name}{n} a JOIN ({run}) r ON a.grp IS NOT DISTINCT FROM r.grp AND idx // 16 = up)"
            )

    parts.append("s0 AS (SELECT doc_id, leaf, source AS of, NULL AS sub, source AS grp, place AS idx, leaf AS d, seen, '' AS proof FROM x)")
    up("s")
    parts.append(f"t0 AS (SELECT doc_id, leaf, of, d AS sub, 0 AS grp, dense_rank() OVER (ORDER BY of NULLS FIRST) - 1 AS idx, d, seen, proof FROM s{levels})")
    up("t")
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, sub AS subroot, d AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = d AS verified FROM t{levels}"


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's negatives, with the labels of every seventh moved on."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=label)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
  (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


#: The vocabulary of op13, and the tokens over which a document is marked.
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents through a store of their own, which is empty at first: each distinct text is encoded."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    store = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(docs, token_counts.Vocabulary(public_tokenizers.path(VOCABULARY)), store)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_toxicity": op2_toxicity,
        "op3_language_id": op3_language_id,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_decontamination": op6_decontamination,
        "op7_license_scan": op7_license_scan,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_source_mix": op9_source_mix,
        "op10_tool_calls": op10_tool_calls,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op9_source_mix": OP9_SQL, "op10_tool_calls": OP10_SQL, "op11_merkle_manifest": merkle_sql(), "op12_hard_negatives": OP12_SQL}
