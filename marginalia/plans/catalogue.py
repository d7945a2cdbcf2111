"""The queries of the analytics core and, where SQL can express them, their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.normalize import PROFILES, Profile, effects
from ..functions.text import ascii_tokens, canonical_hash, char_ngrams, excerpt, line_array, substring_count, token_array, word_array
from ..operators import aggregate, analyses, layout, relational, reports, statistics
from ..operators.metrics import HCPR, registry, score
from ..sources import sinks
from ..streaming import incremental
from . import derived
from .derived import ITEM_SCORES_SQL, LINES_SQL, PAIRS_SQL, SCORES_SQL, SERIES_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def line_scores(spark, sf_dir, metrics=("cer",)) -> DataFrame:
    return score(derived.pairs(spark, sf_dir), metrics)


def doc_scores(spark, sf_dir) -> DataFrame:
    """Error rate of each document: the micro average of its lines."""
    return aggregate.micro(line_scores(spark, sf_dir), ["view", "pipeline", "doc_id", "stratum", "metric"]).withColumnRenamed("support", "weight")


# -- scores and their aggregates -------------------------------------------------------


@query(f"WITH {SCORES_SQL} SELECT pipeline, round(sum(edits) / sum(weight), 6) AS value, count(*) AS support FROM scores GROUP BY pipeline")
def cer_micro(spark, sf_dir):
    return rounded(aggregate.micro(line_scores(spark, sf_dir), ["pipeline"]), "value")


@query(f"WITH {SCORES_SQL} SELECT pipeline, round(avg(value), 6) AS value, count(*) AS support FROM scores GROUP BY pipeline")
def cer_macro(spark, sf_dir):
    return rounded(aggregate.macro(line_scores(spark, sf_dir), ["pipeline"]), "value")


@query(f"WITH {SCORES_SQL} SELECT pipeline, doc_id, round(value, 6) AS value FROM docs")
def cer_by_doc(spark, sf_dir):
    return rounded(doc_scores(spark, sf_dir), "value").select("pipeline", "doc_id", "value")


@query(f"WITH {SCORES_SQL} SELECT pipeline, stratum, round(sum(edits) / sum(weight), 6) AS value, count(*) AS support FROM scores GROUP BY ALL")
def cer_by_stratum(spark, sf_dir):
    return rounded(aggregate.micro(line_scores(spark, sf_dir), ["pipeline", "stratum"]), "value")


@query(f"WITH {SCORES_SQL}, m AS (SELECT pipeline, sum(edits) / sum(weight) AS value FROM scores GROUP BY pipeline) SELECT pipeline, round(value, 6) AS value, row_number() OVER (ORDER BY value, pipeline)::INT AS place FROM m")
def engine_ranking(spark, sf_dir):
    means = aggregate.micro(line_scores(spark, sf_dir), ["view", "pipeline"])
    return rounded(relational.ranking(means, ["view"]), "value").select("pipeline", "value", "place")


@query(f"WITH {SCORES_SQL}, m AS (SELECT pipeline, sum(edits) / sum(weight) AS value FROM scores GROUP BY pipeline), o AS (SELECT *, lead(pipeline) OVER w AS runner_up, lead(value) OVER w - value AS behind, row_number() OVER w AS n FROM m WINDOW w AS (ORDER BY value, pipeline)) SELECT pipeline, round(value, 6) AS value, runner_up, round(behind, 6) AS behind FROM o WHERE n = 1")
def leader_and_runner_up(spark, sf_dir):
    means = aggregate.micro(line_scores(spark, sf_dir), ["view", "pipeline"])
    return rounded(relational.leaders(means, ["view"]), "value", "behind").drop("view")


@query(f"WITH {SCORES_SQL}, r AS (SELECT doc_id, pipeline, round(value, 9) AS value FROM docs) SELECT doc_id, pipeline, round(value, 6) AS value FROM r QUALIFY value = min(value) OVER (PARTITION BY doc_id)")
def best_engine_per_doc(spark, sf_dir):
    docs = doc_scores(spark, sf_dir).withColumn("value", F.round("value", 9))
    return rounded(relational.best_each(docs, ["doc_id"]), "value").select("doc_id", "pipeline", "value")


@query(f"WITH {SCORES_SQL}, m AS (SELECT doc_id, round(avg(value), 9) AS v FROM docs GROUP BY doc_id) SELECT doc_id, round(v, 6) AS mean_cer, row_number() OVER (ORDER BY v DESC, doc_id)::INT AS place FROM m QUALIFY place <= 5")
def hardest_documents(spark, sf_dir):
    docs = doc_scores(spark, sf_dir).groupBy("doc_id").agg(F.round(F.avg("value"), 9).alias("mean_cer"))
    return rounded(aggregate.top(docs, 5, F.desc("mean_cer"), F.col("doc_id")), "mean_cer")


@query(f"WITH {SCORES_SQL} SELECT pipeline, round(min(value), 6) AS lowest, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(max(value), 6) AS highest FROM docs GROUP BY pipeline")
def dispersion(spark, sf_dir):
    return rounded(aggregate.dispersion(doc_scores(spark, sf_dir), ["pipeline"]), "lowest", "median", "mean", "highest")


@query(f"WITH {SCORES_SQL}, m AS (SELECT stratum, pipeline, sum(edits) / sum(weight) AS v FROM scores GROUP BY ALL) SELECT stratum, round(max(CASE WHEN pipeline = 'alpha' THEN v END), 6) AS alpha, round(max(CASE WHEN pipeline = 'beta' THEN v END), 6) AS beta, round(max(CASE WHEN pipeline = 'gamma' THEN v END), 6) AS gamma FROM m GROUP BY stratum")
def overview_pivot(spark, sf_dir):
    means = aggregate.micro(line_scores(spark, sf_dir), ["stratum", "pipeline"])
    return rounded(relational.wide(means, ["stratum"], "pipeline", list(derived.ENGINES)), *derived.ENGINES)


@query("WITH g AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY lang) SELECT stratum, n, round(n / sum(n) OVER (), 6) AS share FROM g")
def corpus_composition(spark, sf_dir):
    return rounded(aggregate.composition(table(spark, sf_dir, "documents").withColumnRenamed("lang", "stratum")), "share")


@query(f"WITH {SCORES_SQL} SELECT 'aggregate' AS scope, pipeline, NULL::VARCHAR AS document_id, 'cer' AS metric, round(sum(edits) / sum(weight), 6) AS value, count(*) AS support FROM scores GROUP BY pipeline UNION ALL SELECT 'document', pipeline, line_id, 'cer', round(value, 6), weight FROM scores")
def result_csv_rows(spark, sf_dir):
    scores = derived.by_line(line_scores(spark, sf_dir))
    rows = sinks.result_rows(aggregate.micro(scores), scores)
    return rounded(rows, "value").select("scope", "pipeline", "document_id", "metric", "value", "support")


# -- metrics that need an alignment ----------------------------------------------------


@query()
def alignment_metrics(spark, sf_dir):
    """All text metrics with a path through the edit matrix, micro-averaged."""
    names = ("cer", "cer_diplo", "wer", "mer", "del_rate", "ins_rate", "cmer", "searchability", "hallucination")
    return rounded(aggregate.micro(line_scores(spark, sf_dir, names), ["pipeline", "metric"]), "value")


def _chars(signs: str) -> str:
    return "[" + ", ".join(f"'{c}'" for c in sorted(set(signs)) if c != "'") + "]"


_GLYPHS = " OR ".join([f"list_contains({_chars(fixed.GLYPH_LETTERS)}, c)", *[f"unicode(c) BETWEEN {a} AND {b}" for a, b in fixed.GLYPH_RANGES]])
# every sign is replaced by one of the same length, so texts are aligned place by place
_HERITAGE_SQL = f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS ref FROM documents WHERE text IS NOT NULL),
h AS (SELECT string_split(ref, '') AS a, string_split(translate(ref, 'éèêëàâîôûüöäßñçœæſ', 'eeeeaaiouuoasnc'), '') AS b, ref FROM l),
z AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: {{'c': a[i], 'k': NOT list_contains({_chars("éèêëàâîôûüöäßñçœæſ")}, a[i])}}) AS p FROM h),
n AS (SELECT len(list_filter(p, lambda x: strip_accents(x.c) <> x.c)) AS marks, len(list_filter(p, lambda x: strip_accents(x.c) <> x.c AND x.k)) AS marks_kept,
  len(list_filter(p, lambda x: ({_GLYPHS.replace("c)", "x.c)")}))) AS glyphs, len(list_filter(p, lambda x: ({_GLYPHS.replace("c)", "x.c)")}) AND x.k)) AS glyphs_kept,
  len(list_filter(p, lambda x: list_contains({_chars(fixed.ARCHAIC_CORE)}, x.c))) AS archaic, len(list_filter(p, lambda x: list_contains({_chars(fixed.ARCHAIC_CORE)}, x.c) AND x.k)) AS archaic_kept FROM z),
m AS (SELECT 'diacritic_err' AS metric, marks AS w, marks - marks_kept AS v FROM n UNION ALL SELECT 'mufi_err', glyphs, glyphs - glyphs_kept FROM n UNION ALL SELECT 'hcpr', archaic, archaic_kept FROM n UNION ALL SELECT 'air', archaic_kept, 0 FROM n)
SELECT 'plain' AS pipeline, metric, round(sum(v) FILTER (WHERE w > 0) / nullif(sum(w) FILTER (WHERE w > 0), 0)::DOUBLE, 6) AS value, count(*) FILTER (WHERE w > 0) AS support FROM m GROUP BY metric"""


@query(_HERITAGE_SQL)
def heritage_metrics(spark, sf_dir):
    """Marks, glyphs and archaic characters on the texts as they are; the engine drops accents and ligatures."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.lit("text").alias("view"), F.lit("plain").alias("pipeline"), F.posexplode(F.split("text", "\n")).alias("line", "ref"), "doc_id")
    rows = rows.select("view", "pipeline", "doc_id", "line", "ref", F.translate("ref", "éèêëàâîôûüöäßñçœæſ", "eeeeaaiouuoasnc").alias("hyp"))
    scores = score(rows, ("diacritic_err", "mufi_err", "air", "hcpr"), registry([HCPR]))
    return rounded(aggregate.micro(scores, ["pipeline", "metric"]), "value")


_TRIGRAMS_SQL = f"""
WITH {PAIRS_SQL},
h AS (SELECT pipeline, line_id, substr(hyp, i, 3) AS g FROM (SELECT *, unnest(range(1, length(hyp) - 1)) AS i FROM pairs)),
r AS (SELECT DISTINCT pipeline, line_id, substr(ref, i, 3) AS g FROM (SELECT *, unnest(range(1, length(ref) - 1)) AS i FROM pairs))
SELECT h.pipeline, count(*) AS grams, count(*) FILTER (WHERE r.g IS NULL) AS new, round(count(*) FILTER (WHERE r.g IS NULL) / count(*)::DOUBLE, 6) AS value
FROM h LEFT JOIN r USING (pipeline, line_id, g) GROUP BY h.pipeline
"""


@query(_TRIGRAMS_SQL)
def hallucination_trigram(spark, sf_dir):
    return rounded(analyses.hallucination(derived.by_line(derived.pairs(spark, sf_dir))), "value").select("pipeline", "grams", "new", "value")


# -- tokens ----------------------------------------------------------------------------

_TOKENS_SQL = f"""{PAIRS_SQL},
a AS (SELECT pipeline, line_id, unnest(regexp_extract_all(ref, '[A-Za-z0-9_]+')) AS token FROM pairs),
b AS (SELECT pipeline, line_id, unnest(regexp_extract_all(hyp, '[A-Za-z0-9_]+')) AS token FROM pairs),
ca AS (SELECT pipeline, line_id, token, count(*) AS n FROM a GROUP BY ALL),
cb AS (SELECT pipeline, line_id, token, count(*) AS m FROM b GROUP BY ALL),
kept AS (SELECT ca.*, least(n, coalesce(m, 0)) AS kept FROM ca LEFT JOIN cb USING (pipeline, line_id, token))
"""


def _units(spark, sf_dir):
    return derived.by_line(derived.pairs(spark, sf_dir))


@query(f"WITH {_TOKENS_SQL} SELECT pipeline, sum(n)::BIGINT AS n, sum(kept)::BIGINT AS kept, round(sum(kept) / sum(n)::DOUBLE, 6) AS recall FROM kept GROUP BY pipeline")
def token_recall(spark, sf_dir):
    return rounded(analyses.token_recall(_units(spark, sf_dir), ascii_tokens), "recall").drop("view")


_ORACLE_SQL = """
o AS (SELECT line_id, sum(n) AS n, sum(k) AS oracle FROM (SELECT line_id, token, max(n) AS n, max(kept) AS k FROM kept GROUP BY ALL) GROUP BY line_id),
s AS (SELECT line_id, max(k) AS best FROM (SELECT line_id, pipeline, sum(kept) AS k FROM kept GROUP BY ALL) GROUP BY line_id)
"""


@query(f"""WITH {_TOKENS_SQL}, {_ORACLE_SQL},
e AS (SELECT pipeline, sum(kept) / sum(n)::DOUBLE AS r FROM kept GROUP BY pipeline),
t AS (SELECT sum(oracle) / sum(n)::DOUBLE AS v FROM o)
SELECT round(v, 6) AS oracle_recall, pipeline AS best_pipeline, round(r, 6) AS best_recall, round(v - r, 6) AS gap, round((v - r) / (1 - r), 6) AS relative_gap
FROM t, e ORDER BY r DESC, pipeline LIMIT 1""")
def complementarity(spark, sf_dir):
    return rounded(analyses.complementarity(_units(spark, sf_dir), ascii_tokens), "oracle_recall", "best_recall", "gap", "relative_gap").drop("view")


@query(f"WITH {_TOKENS_SQL}, {_ORACLE_SQL}, g AS (SELECT line_id, n, oracle, best, round((oracle - best) / n::DOUBLE, 9) AS gap FROM o JOIN s USING (line_id)) SELECT line_id, oracle::BIGINT AS oracle, best::BIGINT AS best, round(gap, 6) AS gap, row_number() OVER (ORDER BY gap DESC, line_id)::INT AS place FROM g QUALIFY place <= 20")
def complementary_lines(spark, sf_dir):
    docs = analyses.complementarity_by_doc(_units(spark, sf_dir), ascii_tokens).withColumn("gap", F.round((F.col("oracle") - F.col("best")) / F.col("n"), 9))
    top = aggregate.top(docs, 20, F.desc("gap"), F.col("doc_id"))
    return rounded(top, "gap").select(F.col("doc_id").alias("line_id"), "oracle", "best", "gap", "place")


@query(f"""WITH {_TOKENS_SQL},
f AS (SELECT token FROM (SELECT line_id, token, max(n) AS n FROM kept GROUP BY ALL) GROUP BY token HAVING sum(n) <= 2)
SELECT pipeline, sum(n)::BIGINT AS n, sum(kept)::BIGINT AS kept, round(sum(kept) / sum(n)::DOUBLE, 6) AS recall FROM kept SEMI JOIN f USING (token) GROUP BY pipeline""")
def rare_token_recall(spark, sf_dir):
    references = derived.lines(spark, sf_dir).select(F.lit("text").alias("view"), "ref")
    return rounded(analyses.rare_token_recall(_units(spark, sf_dir), 2, ascii_tokens, references), "recall").drop("view")


# -- lines -----------------------------------------------------------------------------


@query(f"WITH {SCORES_SQL}, c AS (SELECT pipeline, least(value, 1.0) AS v FROM scores) SELECT pipeline, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM c GROUP BY pipeline")
def line_percentiles(spark, sf_dir):
    rows = line_scores(spark, sf_dir).withColumn("v", F.least("value", F.lit(1.0)))
    return rounded(aggregate.percentiles(rows, "v", ["pipeline"]), "p50", "p75", "p90", "p95", "p99")


@query(f"WITH {SCORES_SQL}, c AS (SELECT pipeline, value AS v, row_number() OVER (PARTITION BY pipeline ORDER BY value) AS i, count(*) OVER (PARTITION BY pipeline) AS n FROM scores) SELECT pipeline, round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n)::DOUBLE, 6) AS gini FROM c GROUP BY pipeline")
def line_gini(spark, sf_dir):
    return rounded(aggregate.gini(line_scores(spark, sf_dir), "value", ["pipeline"]), "gini")


@query(f"WITH {SCORES_SQL}, c AS (SELECT pipeline, value, least(floor((line / (max(line) OVER (PARTITION BY doc_id) + 1)::DOUBLE) * 10), 9)::INT AS bin FROM scores), e AS (SELECT * FROM (SELECT DISTINCT pipeline FROM c), (SELECT unnest(range(10))::INT AS bin)) SELECT pipeline, bin, round(avg(value), 6) AS mean FROM e LEFT JOIN c USING (pipeline, bin) GROUP BY ALL")
def line_heatmap(spark, sf_dir):
    from pyspark.sql import Window

    place = F.col("line") / (F.max("line").over(Window.partitionBy("doc_id")) + 1)
    rows = line_scores(spark, sf_dir).select("view", "pipeline", place.alias("place"), F.col("value").alias("cer"))
    return rounded(analyses.line_heatmap(rows), "mean").drop("view")


@query(f"WITH {SCORES_SQL} SELECT pipeline, count(*) AS n_lines, round(avg((value >= 0.3)::INT), 6) AS over_30, round(avg((value >= 0.5)::INT), 6) AS over_50, round(avg((value >= 1)::INT), 6) AS over_100 FROM scores GROUP BY pipeline")
def catastrophic_lines(spark, sf_dir):
    rows = line_scores(spark, sf_dir).withColumnRenamed("value", "cer")
    return rounded(analyses.line_summary(rows), "over_30", "over_50", "over_100").select("pipeline", "n_lines", "over_30", "over_50", "over_100")


@query(f"WITH {SCORES_SQL}, c AS (SELECT *, round(value, 9) AS v FROM scores WHERE edits > 0) SELECT pipeline, line_id, round(v, 6) AS cer, row_number() OVER (ORDER BY v DESC, pipeline, line_id)::INT AS place FROM c QUALIFY place <= 5")
def worst_lines(spark, sf_dir):
    rows = line_scores(spark, sf_dir).filter("value > 0").withColumn("cer", F.round("value", 9))
    return rounded(aggregate.top(rows, 5, F.desc("cer"), F.col("pipeline"), F.col("doc_pos")), "cer").select("pipeline", F.col("doc_pos").alias("line_id"), "cer", "place")


@query()
def aligned_line_summary(spark, sf_dir):
    """Lines of whole documents aligned as sequences; each engine loses every seventh line."""
    rows = derived.pairs(spark, sf_dir)
    at = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    kept = F.when(F.col("line") % 7 != 3, F.struct("line", F.col("hyp").alias("t")))
    docs = rows.groupBy("view", "pipeline", "doc_id").agg(at(F.struct("line", F.col("ref").alias("t"))).alias("ref"), at(kept).alias("hyp"))
    return analyses.line_summary(analyses.aligned_lines(docs))


# -- ranks and tests -------------------------------------------------------------------

_RANKS_SQL = f"""{SCORES_SQL},
v AS (SELECT doc_id, pipeline, round(value, 9) AS value FROM docs),
r AS (SELECT doc_id, pipeline, rank() OVER (PARTITION BY doc_id ORDER BY value) + (count(*) OVER (PARTITION BY doc_id, value) - 1) / 2.0::DOUBLE AS rank FROM v),
m AS (SELECT pipeline, avg(rank) AS mean_rank, count(*) AS n FROM r GROUP BY pipeline)
"""


def _means(spark, sf_dir):
    docs = doc_scores(spark, sf_dir).withColumn("value", F.round("value", 9))
    return statistics.mean_ranks(docs, ["view"])


@query(f"WITH {_RANKS_SQL} SELECT pipeline, round(mean_rank, 6) AS mean_rank, n, round(2.343 * sqrt(3 * 4 / (6.0 * n)), 6) AS critical_distance FROM m")
def mean_ranks(spark, sf_dir):
    return rounded(_means(spark, sf_dir), "mean_rank", "critical_distance").select("pipeline", "mean_rank", "n", "critical_distance")


@query(f"WITH {_RANKS_SQL} SELECT a.pipeline AS a, b.pipeline AS b, round(abs(a.mean_rank - b.mean_rank), 6) AS gap, abs(a.mean_rank - b.mean_rank) > 2.343 * sqrt(3 * 4 / (6.0 * a.n)) AS significant FROM m a JOIN m b ON a.pipeline < b.pipeline")
def rank_gaps(spark, sf_dir):
    return rounded(statistics.rank_gaps(_means(spark, sf_dir), ["view"]), "gap").drop("view")


@query(f"""WITH {_RANKS_SQL}, o AS (SELECT list(pipeline ORDER BY mean_rank, pipeline) AS p, list(mean_rank ORDER BY mean_rank, pipeline) AS r, 2.343 * sqrt(12 / (6.0 * max(n))) AS cd FROM m),
g AS (SELECT CASE WHEN r[2] - r[1] > cd AND r[3] - r[2] > cd THEN [p[1:1], p[2:2], p[3:3]] WHEN r[2] - r[1] > cd THEN [p[1:1], p[2:3]] WHEN r[3] - r[1] > cd THEN [p[1:2], p[3:3]] ELSE [p] END AS g FROM o)
SELECT 'text' AS view, (i - 1)::INT AS "group", g[i] AS names FROM (SELECT g, unnest(range(1, len(g) + 1)) AS i FROM g)""")
def tied_groups(spark, sf_dir):
    return statistics.tied_groups(_means(spark, sf_dir), ["view"])


@query(f"""WITH {_RANKS_SQL}, t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT doc_id, rank, count(*) AS c FROM r GROUP BY ALL)), s AS (SELECT sum(rank) AS s, count(*) AS n FROM r GROUP BY pipeline),
f AS (SELECT max(n) AS n, (12.0 / (max(n) * 12) * sum(s * s) - 3 * max(n) * 4) / (1 - max(ties) / (max(n) * 24)) AS chi2 FROM s, t)
SELECT 'text' AS view, n, 3::BIGINT AS k, round(chi2, 4) AS chi2, round(exp(-chi2 / 2), 6) AS p FROM f""")
def friedman_test(spark, sf_dir):
    docs = doc_scores(spark, sf_dir).withColumn("value", F.round("value", 9))
    return rounded(statistics.friedman(docs, ["view"]), "p").withColumn("chi2", F.round("chi2", 4))


@query(f"""WITH {SCORES_SQL}, d AS (SELECT doc_id, round(max(value) FILTER (WHERE pipeline = 'alpha'), 9) - round(max(value) FILTER (WHERE pipeline = 'gamma'), 9) AS g FROM docs GROUP BY doc_id),
a AS (SELECT abs(g) AS x, g > 0 AS up FROM d WHERE g <> 0), c AS (SELECT x, count(*) AS t, count(*) FILTER (WHERE up) AS u FROM a GROUP BY x),
b AS (SELECT *, coalesce(sum(t) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS r FROM c),
w AS (SELECT sum(u * r) AS up, sum(t)::DOUBLE AS n, sum(t * t * t - t)::DOUBLE AS ties FROM b),
z AS (SELECT *, least(up, n * (n + 1) / 2 - up) AS low FROM w), y AS (SELECT *, abs(low - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2) AS e FROM z)
SELECT 'text' AS view, (SELECT count(*) FROM d) AS n, round(low, 1) AS statistic, round(list_sum(list_transform(range(8000), lambda k: exp(-pow(e + (k + 0.5) * 0.001, 2)))) * 0.001 * 2 / sqrt(pi()), 6) AS p FROM y""")
def wilcoxon_test(spark, sf_dir):
    docs = doc_scores(spark, sf_dir).withColumn("value", F.round("value", 9))
    return rounded(statistics.wilcoxon(docs, ["view"], "alpha", "gamma"), "p").withColumn("statistic", F.round("statistic", 1))


@query()
def bootstrap_intervals(spark, sf_dir):
    """Means of documents with resampled intervals."""
    docs = doc_scores(spark, sf_dir).withColumn("doc_pos", F.col("doc_id"))
    return rounded(statistics.bootstrap(docs, ["pipeline"]), "mean", "lower", "upper")


@query("WITH v AS (SELECT l_returnflag AS pipeline, l_orderkey AS doc_id, avg(l_discount) AS value FROM lineitem GROUP BY ALL), k AS (SELECT count(DISTINCT pipeline) AS k FROM v), c AS (SELECT doc_id FROM v, k GROUP BY doc_id, k HAVING count(*) = k) SELECT pipeline, count(*) AS n, round(avg(value), 6) AS value FROM v SEMI JOIN c USING (doc_id) GROUP BY pipeline")
def complete_cases(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("pipeline"), F.col("l_orderkey").alias("doc_id")).agg(F.avg("l_discount").alias("value"))
    cases = relational.complete_cases(rows.withColumn("view", F.lit("x")), ["view"])
    return rounded(cases.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


# -- time ------------------------------------------------------------------------------


@query(f"WITH {SERIES_SQL}, d AS (SELECT pipeline, value, date_diff('day', min(ts) OVER (PARTITION BY pipeline), ts)::DOUBLE AS d FROM series) SELECT pipeline, count(*) AS n, round(regr_slope(value, d), 6) AS slope, round(regr_intercept(value, d), 6) AS intercept, round(regr_r2(value, d), 6) AS r2 FROM d GROUP BY pipeline")
def trend(spark, sf_dir):
    return rounded(statistics.trend(derived.series(spark, sf_dir), ["pipeline"]), "slope", "intercept", "r2")


@query(f"""WITH {SERIES_SQL},
i AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ts) AS t, count(*) OVER (PARTITION BY pipeline) AS n FROM series),
u AS (SELECT a.pipeline, b.t, b.n, abs(sum(sign(c.value - a.value))) AS u FROM i b JOIN i a ON a.pipeline = b.pipeline AND a.t <= b.t JOIN i c ON c.pipeline = b.pipeline AND c.t > b.t WHERE b.t < b.n GROUP BY ALL),
k AS (SELECT pipeline, n, u, t, row_number() OVER (PARTITION BY pipeline ORDER BY u DESC, t) AS r FROM u)
SELECT k.pipeline, k.n, k.t::INT AS boundary, u::DOUBLE AS u, round(least(1.0, 2 * exp(-6.0 * u * u / (k.n ** 3 + k.n ** 2))), 6) AS p, round(avg(value) FILTER (WHERE i.t <= k.t), 6) AS mean_before, round(avg(value) FILTER (WHERE i.t > k.t), 6) AS mean_after
FROM k JOIN i ON i.pipeline = k.pipeline WHERE r = 1 GROUP BY k.pipeline, k.n, k.t, u""")
def change_point(spark, sf_dir):
    return rounded(statistics.change_point(derived.series(spark, sf_dir), ["pipeline"], ["ts"]), "p", "mean_before", "mean_after").drop("significant", "delta")


@query(f"WITH {SERIES_SQL}, l AS (SELECT *, lag(value) OVER w AS previous, row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC) AS n FROM series WINDOW w AS (PARTITION BY pipeline ORDER BY ts)) SELECT pipeline, round(previous, 6) AS previous, round(value, 6) AS latest, round(value - previous, 6) AS delta, value - previous > 0.5 AS worse FROM l WHERE n = 1")
def history_last_two(spark, sf_dir):
    return rounded(statistics.last_two(derived.series(spark, sf_dir), ["pipeline"], ["ts"], threshold=0.5), "previous", "latest", "delta")


@query("WITH a AS (SELECT event_type AS pipeline, avg(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), b AS (SELECT event_type AS pipeline, avg(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'view' GROUP BY ALL) SELECT pipeline, round(a.value, 6) AS value_a, round(b.value, 6) AS value_b, round(b.value - a.value, 6) AS delta FROM a FULL JOIN b USING (pipeline)")
def run_compare(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "pipeline")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    a, b = (events.filter(c).groupBy("pipeline").agg(F.avg("value").alias("value")) for c in (early, ~early & (F.col("pipeline") != "view")))
    return rounded(relational.compare_runs(a, b, ["pipeline"]), "value_a", "value_b", "delta")


_HISTORY_SQL = "h AS (SELECT event_type AS pipeline, ts::DATE AS day, user_id % 7 AS run, max(value) AS value FROM events GROUP BY ALL)"


def _history(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("pipeline"), F.to_date("ts").alias("day"), (F.col("user_id") % 7).alias("run")).agg(F.max("value").alias("value"))


@query(f"WITH {_HISTORY_SQL}, n AS (SELECT pipeline, day, run, value + 1 AS value FROM h WHERE run IN (2, 5) UNION ALL SELECT pipeline, day, 9 AS run, value FROM h WHERE run = 0) SELECT pipeline, run, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM h ANTI JOIN n USING (pipeline, day, run) UNION ALL SELECT * FROM n) GROUP BY ALL")
def history_upsert(spark, sf_dir):
    """Two runs of the history are replaced and one is added."""
    old = _history(spark, sf_dir)
    new = old.filter("run in (2, 5)").withColumn("value", F.col("value") + 1).unionByName(old.filter("run = 0").withColumn("run", F.lit(9).cast("long")))
    out = sinks.upserted(old, new, ("pipeline", "day", "run")).groupBy("pipeline", "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_difference(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.unseen(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq FROM events")
def job_journal(spark, sf_dir):
    return incremental.journal(table(spark, sf_dir, "events"), "user_id").select("user_id", "event_id", "seq")


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, count(*) AS n, greatest(0, count(*) - 2) AS refused FROM events GROUP BY ALL")
def rate_limit_windows(spark, sf_dir):
    out = incremental.rate_limited(table(spark, sf_dir, "events"), 2, 3600, "user_id")
    return out.withColumn("start", F.unix_timestamp("start"))


# -- joins, sets, fronts ---------------------------------------------------------------


@query("SELECT s_name AS name, s_acctbal AS x, s_nationkey AS y FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal <= a.s_acctbal AND b.s_nationkey <= a.s_nationkey AND (b.s_acctbal < a.s_acctbal OR b.s_nationkey < a.s_nationkey))")
def pareto_front(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    return relational.pareto_front(points, "name", "x", "y")


@query("""WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS l, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT a.s, b.l, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.s)::DOUBLE + 1e-12 AS p FROM (SELECT DISTINCT s FROM c) a CROSS JOIN (SELECT DISTINCT l FROM c) b LEFT JOIN c USING (s, l)),
q AS (SELECT s, l, p / sum(p) OVER (PARTITION BY s) AS p FROM p)
SELECT a.s AS a, b.s AS b, round(sum(a.p * log2(2 * a.p / (a.p + b.p)) + b.p * log2(2 * b.p / (a.p + b.p))) / 2, 6) AS js FROM q a JOIN q b ON a.l = b.l AND a.s < b.s GROUP BY ALL""")
def jensen_shannon(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rounded(analyses.jensen_shannon(counted, [], "o_orderstatus", "o_orderpriority", "n"), "js")


@query("WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'N'), w AS (SELECT l_partkey, string_agg(l_returnflag, '+' ORDER BY l_returnflag) AS names, sum(n) AS n FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM a GROUP BY ALL) GROUP BY l_partkey) SELECT names, count(*) AS words, sum(n)::BIGINT AS misses FROM w GROUP BY names")
def miss_signatures(spark, sf_dir):
    misses = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return relational.signatures(misses, "l_partkey", "l_returnflag").withColumn("names", F.array_join("names", "+"))


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE i <= n) AS matched FROM a LEFT JOIN b USING (l_partkey, l_suppkey) GROUP BY ALL")
def multiset_matching(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    rows = relational.multiset_matches(items.filter("l_returnflag = 'A'"), items.filter("l_returnflag = 'R'"), keys, ["l_orderkey", "l_linenumber"])
    return rows.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("matched"))


@query("WITH c AS (SELECT DISTINCT c_nationkey AS nation, c_custkey % 40 AS desk FROM customer), s AS (SELECT DISTINCT s_nationkey AS nation, s_suppkey % 40 AS desk FROM supplier) SELECT *, 'left' AS side FROM c ANTI JOIN s USING (nation, desk) UNION ALL SELECT *, 'right' FROM s ANTI JOIN c USING (nation, desk)")
def unmatched_keys(spark, sf_dir):
    """Desks of a nation that only customers have, or only suppliers; of all of them."""
    a, b = (table(spark, sf_dir, t).select(F.col(f"{c}_nationkey").alias("nation"), (F.col(f"{k}key") % 40).alias("desk")) for t, c, k in (("customer", "c", "c_cust"), ("supplier", "s", "s_supp")))
    return relational.unmatched(a, b, ["nation", "desk"])


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_name || ' #' || n ELSE p_name END AS p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark, sf_dir):
    return relational.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


_ECONOMICS_SQL = """WITH u AS (SELECT l_returnflag AS pipeline, count(*) AS pages, sum(l_quantity) AS d, sum(l_extendedprice::BIGINT) AS t FROM lineitem GROUP BY ALL),
e AS (SELECT l_returnflag AS pipeline, sum(l_discount * l_linenumber) AS errors, sum(l_discount * l_linenumber) / sum(l_linenumber) AS cer FROM lineitem GROUP BY ALL)
SELECT pipeline, pages, round(d, 4) AS duration, round(cer, 6) AS cer, round(errors, 4) AS errors, round(d / 3600 * 0.08 + t * coalesce(tariff, 0) / 1e6, 6) AS cost, round(pages * 3600 / d, 6) AS pages_per_hour, round(pages * 3600 / (d + errors * 5), 6) AS effective_pages_per_hour
FROM u JOIN e USING (pipeline) LEFT JOIN (VALUES ('A', 2.0), ('R', 0.5)) t(pipeline, tariff) USING (pipeline)"""


@query(_ECONOMICS_SQL)
def economics(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "pipeline")
    usage = items.select("pipeline", F.col("l_quantity").alias("duration_seconds"), F.rint("l_extendedprice").cast("long").alias("tokens_in"), F.lit(None).cast("long").alias("tokens_out"))
    scores = items.select("pipeline", F.lit("cer").alias("metric"), F.col("l_discount").alias("value"), F.col("l_linenumber").alias("weight"))
    tariffs = spark.createDataFrame([("A", 2.0, None, None), ("R", 0.5, None, None)], "pipeline string, per_million_in double, per_million_out double, per_page double")
    out = analyses.economics(usage, scores, tariffs)
    out = rounded(out, "cer", "cost", "pages_per_hour", "effective_pages_per_hour")
    return out.withColumns({n: F.round(n, 4) for n in ("duration", "errors")})


# -- calibration, sequences, regions ---------------------------------------------------

_TOKENS_CAL_SQL = "t AS (SELECT lang, (n_chars % 1000) / 1000.0::DOUBLE AS confidence, quality AS correct FROM documents JOIN labels USING (doc_id)), b AS (SELECT lang, least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS confidence, avg(correct) AS accuracy FROM t GROUP BY ALL)"


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("lang", ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("confidence"), F.col("quality").alias("correct"))


@query(f"WITH {_TOKENS_CAL_SQL} SELECT lang, bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def calibration_bins(spark, sf_dir):
    return rounded(analyses.calibration_bins(_judged(spark, sf_dir), ["lang"]), "confidence", "accuracy")


@query(f"WITH {_TOKENS_CAL_SQL} SELECT lang, round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, round(max(abs(accuracy - confidence)), 6) AS mce, sum(n)::BIGINT AS n FROM b GROUP BY lang")
def calibration(spark, sf_dir):
    return rounded(analyses.calibration(_judged(spark, sf_dir), ["lang"]), "ece", "mce")


@query("""WITH t AS (SELECT o_orderpriority AS pipeline, {'year': year(o_orderdate)::VARCHAR, 'foliation': (o_custkey % 50)::VARCHAR, 'currency': (o_orderkey % 30)::VARCHAR, 'regnal': (o_custkey % 20)::VARCHAR} AS v FROM orders),
c AS (SELECT pipeline, 'year' AS category, v.year AS x FROM t UNION ALL SELECT pipeline, 'foliation', v.foliation FROM t UNION ALL SELECT pipeline, 'currency', v.currency FROM t UNION ALL SELECT pipeline, 'regnal', v.regnal FROM t)
SELECT pipeline, category, count(*) AS n_total, count(*) FILTER (WHERE NOT contains(x, '9')) AS n_strict, count(*) FILTER (WHERE NOT contains(x, '9')) AS n_value FROM c GROUP BY ALL""")
def numeric_sequences(spark, sf_dir):
    out = analyses.structured_data(derived.order_texts(spark, sf_dir))
    return out.select("pipeline", "category", "n_total", "n_strict", "n_value")


@query(r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[' || chr(39) || '’\-][\p{L}\p{M}\p{N}_]+)*'))::INT AS tokens, len(list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[' || chr(39) || '’\-][\p{L}\p{M}\p{N}_]+)*'), lambda t: lower(t))))::INT AS kinds,
  len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::INT AS words, (len(string_split(text, chr(10))) - (ends_with(text, chr(10)) OR text = '')::INT)::INT AS lines,
  CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS head, ((length(text) - length(replace(text, 'en', ''))) / 2)::INT AS parts, len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))))::INT AS grams FROM d""")
def text_functions(spark, sf_dir):
    """Tokens, words, lines, excerpts and n-grams of the texts as they are."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    tokens, t = token_array(F.col("text")), F.col("text")
    grams = F.size(F.array_distinct(char_ngrams(t)))
    return docs.select("doc_id", F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("kinds"), F.size(word_array(t)).alias("words"), F.size(line_array(t)).alias("lines"), excerpt(t, 40).alias("head"), substring_count(t, "en").alias("parts"), grams.alias("grams"))


@query("WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), s AS (SELECT *, sum((before IS NULL OR epoch(ts) - epoch(before) >= 86400)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM e) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 86400 AS ends, count(*) AS n FROM s GROUP BY user_id, nth")
def idle_sessions(spark, sf_dir):
    """A client's events between pauses of a day."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.sessions(rows, "user_id", idle=86400)
    return out.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("ends"), "n")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events")
def unit_progress(spark, sf_dir):
    return incremental.progress(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "done", "total")


@query(f"WITH {LINES_SQL}, r AS (SELECT doc_id, ref AS a, CASE WHEN line % 3 = 0 THEN '' ELSE lower(ref) END AS b FROM lines) SELECT doc_id, round(sum(levenshtein(a, b)) / sum(length(a))::DOUBLE, 6) AS value, sum(length(a))::BIGINT AS weight FROM r GROUP BY doc_id")
def region_cer(spark, sf_dir):
    """Lines as regions; the other side lacks every third."""
    rows = derived.lines(spark, sf_dir).select("doc_id", F.col("line").alias("region_id"), F.col("ref").alias("text"))
    other = rows.filter("region_id % 3 <> 0").withColumn("text", F.lower("text"))
    return rounded(layout.region_cer(rows, other, ["doc_id"]), "value")


def _boxes(spark, sf_dir):
    """Boxes of an order's items on a page of 60 x 9; the hypothesis moves them by their tax."""
    items = table(spark, sf_dir, "lineitem")
    one = lambda dx: F.array(F.col("l_quantity") + dx, F.col("l_linenumber") + dx * 0, F.col("l_quantity") + dx + 4, F.col("l_linenumber") + 1.0)
    box = lambda side, dx: items.select(F.col("l_orderkey").alias("doc_id"), F.lit(side).alias("side"), F.col("l_linenumber").alias("pos"), F.transform(one(dx), lambda v, i: v / F.when(i % 2 == 0, 60.0).otherwise(9.0)).alias("box"))
    return box("ref", F.lit(0.0)).unionByName(box("hyp", F.col("l_tax") * 40))


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) AS i, l_quantity / 60.0::DOUBLE AS x0, (l_quantity + 4) / 60.0::DOUBLE AS x1, (l_quantity + l_tax * 40) / 60.0::DOUBLE AS u0, (l_quantity + l_tax * 40 + 4) / 60.0::DOUBLE AS u1, l_linenumber / 9.0::DOUBLE AS y0, (l_linenumber + 1) / 9.0::DOUBLE AS y1, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
o AS (SELECT a.doc_id, a.i, c.i AS j, greatest(0, least(a.x1, c.u1) - greatest(a.x0, c.u0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.u1 - c.u0) * (c.y1 - c.y0) AS t FROM b a JOIN b c USING (doc_id)),
m AS (SELECT doc_id, i, list({'v': s / (t - s), 'j': j}) AS l FROM o GROUP BY ALL),
r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, n, range(1, n + 1) AS free, 0 AS tp FROM b
  UNION ALL SELECT q.doc_id, q.i + 1, q.n, CASE WHEN q.best.v >= 0.5 THEN list_filter(q.free, lambda x: x <> q.best.j) ELSE q.free END, q.tp + (q.best.v >= 0.5)::INT
    FROM (SELECT r.*, list_max(list_filter(m.l, lambda x: list_contains(r.free, x.j))) AS best FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1) q)
SELECT doc_id, round(tp / n::DOUBLE, 6) AS value, n AS weight FROM r WHERE i = n""")
def region_detection(spark, sf_dir):
    return rounded(layout.region_detection(_boxes(spark, sf_dir), ["doc_id"]), "value")


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) * 127.5) AS g FROM embeddings),
m AS (SELECT vec_id,
  least(1.0, list_aggregate(list_transform(range(36), lambda k: g[(k // 6) * 8 + k % 6 + 2] + g[(k // 6) * 8 + k % 6 + 18] + g[(k // 6) * 8 + k % 6 + 9] + g[(k // 6) * 8 + k % 6 + 11] - 4 * g[(k // 6) * 8 + k % 6 + 10]), 'var_pop') / 500) AS sharpness,
  least(1.0, list_aggregate(list_concat(list_transform(range(56), lambda k: abs(g[(k // 7) * 8 + k % 7 + 2] - g[(k // 7) * 8 + k % 7 + 1])), list_transform(range(56), lambda k: abs(g[k + 9] - g[k + 1]))), 'median') / 30) AS noise,
  list_aggregate(g, 'quantile_cont', 0.05) AS dark, list_aggregate(g, 'quantile_cont', 0.95) AS light FROM g),
c AS (SELECT *, CASE WHEN light + dark > 0 THEN greatest(0.0, least(1.0, (light - dark) / (light + dark))) ELSE 0.0 END AS contrast FROM m),
q AS (SELECT *, greatest(0.0, least(1.0, 0.4 * sharpness + 0.3 * contrast + 0.2 * (1 - noise) + 0.1)) AS quality FROM c)
SELECT vec_id, 8 AS width, round(sharpness, 6) AS sharpness, round(noise, 6) AS noise, round(contrast, 6) AS contrast, 0.0::DOUBLE AS rotation, round(quality, 6) AS quality, CASE WHEN quality >= 0.7 THEN 'good' WHEN quality >= 0.4 THEN 'medium' ELSE 'poor' END AS tier FROM q""")
def image_quality(spark, sf_dir):
    """Vectors of 64 values as grey images of 8 x 8."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5).alias("pixels"), F.lit(8).alias("width"))
    return rounded(layout.image_quality(vectors), "sharpness", "noise", "contrast", "quality")


@query()
def entity_scores(spark, sf_dir):
    """Capitalised words as entities; the hypothesis has half of them, on spoilt text."""
    rows = derived.pairs(spark, sf_dir)

    def spans(text: str):
        words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Z][a-z]+)\b"), 1))
        # a word is looked for once
        found = F.transform(words, lambda w: F.struct(w.alias("w"), (F.position(w, F.col(text)) - 1).cast("int").alias("start")))
        one = lambda f: F.struct(F.when(F.length(f["w"]) > 4, "PER").otherwise("LOC").alias("label"), f["start"].alias("start"), (f["start"] + F.length(f["w"])).cast("int").alias("end"), f["w"].alias("text"))
        return F.struct(F.col(text).alias("text"), F.transform(found, one).alias("entities"))

    pairs = rows.select("pipeline", spans("ref").alias("ref"), spans("hyp").alias("hyp"))
    return rounded(analyses.entity_scores(layout.entity_counts(pairs, ["pipeline"]), ["pipeline", "label"]), "precision", "recall", "f1")


# -- analyses by alignment -------------------------------------------------------------


@query()
def char_confusions(spark, sf_dir):
    return analyses.confusions(derived.pairs(spark, sf_dir))


@query()
def taxonomy_counts(spark, sf_dir):
    return rounded(analyses.taxonomy(derived.pairs(spark, sf_dir)), "share")


@query()
def word_errors(spark, sf_dir):
    return analyses.word_errors(derived.pairs(spark, sf_dir))


@query()
def modernisation(spark, sf_dir):
    return rounded(analyses.modernisation(derived.pairs(spark, sf_dir)), "rate")


@query()
def philology(spark, sf_dir):
    """Marks of the texts as they are; the engine writes typographic marks in ASCII."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.lit("text").alias("view"), F.lit("ascii").alias("pipeline"), "doc_id", F.explode(F.split("text", "\n")).alias("ref"))
    return rounded(analyses.philology(rows.withColumn("hyp", F.translate("ref", "ñ’‘—–", "n''--"))), "strict", "expanded")


@query("""WITH n AS (SELECT o_orderpriority AS pipeline, (['II', 'III', 'IV', 'VI', 'VII', 'VIII', 'IX', 'XI', 'XII', 'XIV'])[o_custkey % 10 + 1] AS form FROM orders)
SELECT 'text' AS view, pipeline, CASE WHEN contains(form, 'V') THEN 'lost' ELSE 'strict_preserved' END AS status, count(*) AS n FROM n GROUP BY ALL""")
def roman_numerals(spark, sf_dir):
    """Regnal years from orders; the engine writes V as U."""
    digits = F.element_at(F.array(*[F.lit(x) for x in ("II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "XII", "XIV")]), (F.col("o_custkey") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.lit("text").alias("view"), F.col("o_orderpriority").alias("pipeline"), F.concat(F.lit("an "), digits).alias("ref"))
    return analyses.roman_numerals(rows.withColumn("hyp", F.replace("ref", F.lit("V"), F.lit("U"))))


@query()
def correction_balance(spark, sf_dir):
    """A second stage that restores capitals and spoils u."""
    rows = derived.lines(spark, sf_dir).select(F.lit("two-stage").alias("pipeline"), derived.line_id().alias("doc_id"), F.col("line").alias("doc_pos"), "ref")
    triples = rows.withColumns({"raw": F.lower("ref"), "corrected": F.translate("ref", "u", "n")})
    return analyses.correction(triples)


@query(f"""WITH {LINES_SQL}, w AS (SELECT line_id, unnest(regexp_extract_all(ref, '[^ ]+')) AS w, 'ref' AS s FROM lines UNION ALL SELECT line_id, unnest(regexp_extract_all(lower(ref), '[^ ]+')), 'raw' FROM lines UNION ALL SELECT line_id, unnest(regexp_extract_all(translate(ref, 'u', 'n'), '[^ ]+')), 'sys' FROM lines),
c AS (SELECT line_id, w, count(*) FILTER (WHERE s = 'ref') AS r, count(*) FILTER (WHERE s = 'raw') AS a, count(*) FILTER (WHERE s = 'sys') AS b FROM w GROUP BY ALL),
d AS (SELECT greatest(0, r - a) AS before, greatest(0, r - b) AS after FROM c WHERE r > 0)
SELECT sum(before)::BIGINT AS errors_before, sum(after)::BIGINT AS errors_after, sum(greatest(0, before - after))::BIGINT AS corrected, sum(greatest(0, after - before))::BIGINT AS introduced, sum(least(before, after))::BIGINT AS kept_wrong FROM d""")
def correction_absorption(spark, sf_dir):
    rows = derived.lines(spark, sf_dir).select(F.lit("x").alias("pipeline"), derived.line_id().alias("doc_id"), "ref")
    out = analyses.absorption(rows.withColumns({"raw": F.lower("ref"), "corrected": F.translate("ref", "u", "n")}))
    return out.select("errors_before", "errors_after", "corrected", "introduced", "kept_wrong")


@query("""WITH t AS (SELECT text, nfc_normalize(text) AS n FROM documents),
p AS (SELECT 'nfc' AS profile, text, n AS out FROM t UNION ALL SELECT 'no_apostrophes', text, translate(n, chr(39) || '’', '') FROM t UNION ALL SELECT 'flat_text', text, trim(regexp_replace(n, '\\s+', ' ', 'g')) FROM t
  UNION ALL SELECT 'minimal', text, replace(n, 'ſ', 's') FROM t UNION ALL SELECT 'no_diacritics', text, strip_accents(n) FROM t)
SELECT profile, count(*) FILTER (WHERE out <> text) AS changed, sum(length(out))::BIGINT AS chars FROM p GROUP BY profile""")
def lever_profiles(spark, sf_dir):
    """Profiles of one lever: how many texts each changes, and the characters left."""
    docs, names = table(spark, sf_dir, "documents").select("text"), ("nfc", "no_apostrophes", "flat_text", "minimal", "no_diacritics")
    rows = docs.select(F.inline(effects(F.col("text"), [PROFILES[n] for n in names])))
    return rows.groupBy("profile").agg(F.count_if("changed").alias("changed"), F.sum("chars").alias("chars"))


@query()
def normalisation_profiles(spark, sf_dir):
    """How many texts each profile changes."""
    docs = table(spark, sf_dir, "documents").select("text")
    rows = docs.select(F.inline(effects(F.col("text"), PROFILES.values())))
    return rows.agg(*[F.count_if(F.col("changed") & (F.col("profile") == name)).alias(name) for name in PROFILES])


@query("SELECT doc_id, regexp_replace(translate(replace(replace(text, 'æ', 'ae'), 'œ', 'oe'), 'ſ', 's'), '&', 'et', 'g') AS text FROM documents")
def diplomatic_texts(spark, sf_dir):
    """A profile of a diplomatic table alone; its signs never feed each other."""
    table_ = {"æ": "ae", "œ": "oe", "ſ": "s", "&": "et"}
    profile = Profile("four_signs", unicode_form="none", table=table_)
    return table(spark, sf_dir, "documents").select("doc_id", profile.column(F.col("text")).alias("text"))


@query("""WITH d AS (SELECT doc_id, text, lower(text) AS raw, CASE WHEN doc_id % 3 = 0 THEN text ELSE lower(text) END AS out FROM documents WHERE text IS NOT NULL)
SELECT 'two-stage' AS pipeline, doc_id, doc_id AS doc_pos, json_object('document_metadata', json_object('corpus', 'derived', 'document_id', doc_id::VARCHAR, 'language', 'und'), 'ground_truth', json_object('transcription_unit', text), 'ocr_hypothesis', json_object('transcription_unit', raw), 'ocr_postcorrection_output', json_object('transcription_unit', out))::VARCHAR AS json FROM d""")
def system_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("two-stage").alias("pipeline"), "doc_id", F.col("doc_id").alias("doc_pos"), F.col("text").alias("ref"))
    rows = docs.withColumns({"raw": F.lower("ref"), "corrected": F.when(F.col("doc_id") % 3 == 0, F.col("ref"))})
    return sinks.system_records(rows, "derived", "und")


@query("SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})::VARCHAR) AS unit_key FROM documents")
def unit_keys(spark, sf_dir):
    """Keys by which finished units of a run are found again."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", canonical_hash("doc_id", "lang", "n_chars", "source").alias("unit_key"))


# -- reports ---------------------------------------------------------------------------

_NAMES = [(p, m) for p in "ANR" for m in ("cer", "wer")]
_SCORE_COLUMNS = ", ".join(f"max(value) FILTER (WHERE pipeline = '{p}' AND metric = '{m}') AS \"{p}_{m}\"" for p, m in _NAMES)


@query(f"WITH {ITEM_SCORES_SQL} SELECT doc_id, {_SCORE_COLUMNS} FROM s GROUP BY doc_id")
def report_documents(spark, sf_dir):
    return reports.score_table(derived.item_scores(spark, sf_dir), _NAMES).drop("view")


@query(f"WITH {ITEM_SCORES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY value, pipeline)::INT AS place, pipeline, value FROM s WHERE metric = 'wer' AND value IS NOT NULL")
def report_engines_of_documents(spark, sf_dir):
    return reports.ordered_engines(derived.item_scores(spark, sf_dir), "wer").drop("view")


@query(f"WITH {ITEM_SCORES_SQL}, w AS (SELECT doc_id, max(value) FILTER (WHERE metric = 'wer') AS worst FROM s GROUP BY doc_id) SELECT doc_id, worst FROM w ORDER BY worst DESC NULLS LAST, doc_id LIMIT 60")
def report_worst_first(spark, sf_dir):
    return reports.worst_first(derived.item_scores(spark, sf_dir), "wer").limit(60)


@query("SELECT o_orderkey, replace(o_orderpriority, '-', '<del>-</del>') AS ref, replace(o_orderpriority, '-', '<ins>&amp;</ins>') AS hyp FROM orders")
def report_marked_texts(spark, sf_dir):
    """Priorities of orders as texts; the hypothesis writes & for the hyphen."""
    orders = table(spark, sf_dir, "orders")
    marked = reports.marked_texts(F.col("o_orderpriority"), F.replace("o_orderpriority", F.lit("-"), F.lit("&")))
    return orders.select("o_orderkey", marked.alias("m")).select("o_orderkey", "m.ref", "m.hyp")


_ESCAPED = "replace(replace(replace(replace(replace(ref, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


# what stands between two commas is longest where it is, so texts are aligned place by place
@query(f"WITH {LINES_SQL}, e AS (SELECT line_id, {_ESCAPED} AS t FROM lines) SELECT line_id, regexp_replace(t, ',+', '<del>\\0</del>', 'g') AS ref, replace(regexp_replace(t, ',+', '<ins>\\0</ins>', 'g'), ',', '·') AS hyp FROM e")
def report_marked_lines(spark, sf_dir):
    """Every line of the texts; the hypothesis has a dot for each comma."""
    lines = derived.lines(spark, sf_dir).select(derived.line_id().alias("line_id"), "ref")
    marked = reports.marked_texts(F.col("ref"), F.replace("ref", F.lit(","), F.lit("·")))
    return lines.select("line_id", marked.alias("m")).select("line_id", "m.ref", "m.hyp")


@query(f"WITH {ITEM_SCORES_SQL}, m AS (SELECT pipeline, metric, avg(value) AS value FROM s GROUP BY ALL) SELECT pipeline, metric, round(value, 6) AS value, round(max(value) OVER (PARTITION BY metric), 6) AS top, round(value / max(value) OVER (PARTITION BY metric), 6) AS bar FROM m")
def report_bars(spark, sf_dir):
    means = derived.item_scores(spark, sf_dir).groupBy("pipeline", "metric").agg(F.avg("value").alias("value"))
    return rounded(reports.share_of_top(means, ["metric"]), "value", "top", "bar")


@query("SELECT event_type AS pipeline, count(*) AS errors, round(count(*) FILTER (WHERE user_id % 3 = 0) / count(*)::DOUBLE, 6) AS c0, round(count(*) FILTER (WHERE user_id % 3 = 1) / count(*)::DOUBLE, 6) AS c1, round(count(*) FILTER (WHERE user_id % 3 = 2) / count(*)::DOUBLE, 6) AS c2 FROM events GROUP BY ALL")
def report_class_shares(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pipeline"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(reports.class_table(counted, ["c0", "c1", "c2"]), "c0", "c1", "c2")


@query(f"WITH {ITEM_SCORES_SQL} SELECT count(DISTINCT pipeline) AS engines, 1::BIGINT AS views, count(DISTINCT metric) AS metrics, count(DISTINCT doc_id) AS documents, (SELECT count(DISTINCT lang) FROM documents) AS strata FROM s")
def report_header(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "stratum")
    return reports.report_header(derived.item_scores(spark, sf_dir), docs)


@query("SELECT source AS corpus, count(*) AS documents, count(*) FILTER (WHERE quality IS NOT NULL) AS with_reference, sum(ceil(n_chars / 2000.0))::BIGINT AS pages FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source")
def corpus_summaries(spark, sf_dir):
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").drop("text").join(known, "doc_id", "left")
    docs = docs.select(F.col("source").alias("corpus"), F.col("quality").isNotNull().alias("has_reference"), F.ceil(F.col("n_chars") / 2000.0).alias("pages"))
    return reports.corpus_summary(docs)


@query(f"WITH {ITEM_SCORES_SQL} SELECT doc_id, arg_min(stratum, pipeline) AS stratum FROM i GROUP BY doc_id")
def document_strata(spark, sf_dir):
    return reports.first_strata(derived.item_scores(spark, sf_dir), "pipeline")


@query(f"""WITH {ITEM_SCORES_SQL}, c AS (SELECT pipeline, list(value ORDER BY value DESC) AS v, sum(value * weight) / sum(weight) AS value, count(*) AS support FROM s WHERE metric = 'cer' GROUP BY pipeline),
b AS (SELECT l_returnflag AS pipeline, least(floor(l_discount * 100), 9)::INT AS bin, count(*) AS n, avg(l_discount * 10) AS confidence, avg((l_quantity > 25)::INT) AS accuracy FROM lineitem GROUP BY ALL),
e AS (SELECT pipeline, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM b GROUP BY pipeline),
k AS (SELECT l_returnflag AS pipeline, l_linestatus AS class, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT pipeline, first(class ORDER BY n DESC, class) AS commonest FROM k GROUP BY pipeline)
SELECT pipeline, round(value, 6) AS value, support, v[1:100] AS worst, round(ece, 6) AS ece, commonest FROM c JOIN e USING (pipeline) JOIN m USING (pipeline)""")
def engine_profiles(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "pipeline")
    judged = items.select("pipeline", (F.col("l_discount") * 10).alias("confidence"), (F.col("l_quantity") > 25).cast("int").alias("correct"))
    classes = items.groupBy("pipeline", F.col("l_linestatus").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(reports.engine_profiles(derived.item_scores(spark, sf_dir), analyses.calibration(judged, ["pipeline"]), classes), "value", "ece")


_MATRIX_SQL = f"""{ITEM_SCORES_SQL},
x AS (SELECT metric, doc_id, pipeline, value FROM s WHERE value IS NOT NULL QUALIFY count(*) OVER (PARTITION BY metric, doc_id) = 3),
q AS (SELECT *, rank() OVER (PARTITION BY metric, doc_id ORDER BY value) + (count(*) OVER (PARTITION BY metric, doc_id, value) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY metric, doc_id, value) AS t FROM x),
z AS (SELECT metric, pipeline, sum(rank) AS s, avg(rank) AS mean_rank, count(*) AS n, sum(t * t - 1)::DOUBLE AS ties FROM q GROUP BY ALL),
f AS (SELECT metric, (12.0 / (max(n) * 12) * sum(s * s) - 3 * max(n) * 4) / (1 - sum(ties) / (max(n) * 24)) AS chi2, max(n) AS n FROM z GROUP BY metric)
"""


@query(f"WITH {_MATRIX_SQL} SELECT 'text:' || metric || ':friedman' AS metric, round(exp(-chi2 / 2), 6) AS value, n::BIGINT AS support FROM f UNION ALL SELECT 'text:' || metric || ':spread', round(avg(d), 6), count(*) FROM (SELECT metric, doc_id, max(value) - min(value) AS d FROM s WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY metric")
def cross_engine_metrics(spark, sf_dir):
    return rounded(reports.cross_engine(derived.item_scores(spark, sf_dir)), "value")


@query(f"""WITH {_MATRIX_SQL}, v AS (SELECT metric AS view, pipeline, sum(value * weight) / sum(weight) FILTER (WHERE value IS NOT NULL) AS value FROM s GROUP BY ALL),
o AS (SELECT view, pipeline, value, lead(pipeline) OVER w AS runner_up, lead(value) OVER w - value AS behind, row_number() OVER w AS nth FROM v WINDOW w AS (PARTITION BY view ORDER BY value, pipeline)),
d AS (SELECT o.*, f.chi2, abs(a.mean_rank - b.mean_rank) <= 2.343 * sqrt(12 / (6.0 * f.n)) AS near,
  (SELECT count(*) FROM z c WHERE c.metric = o.view AND c.mean_rank < least(a.mean_rank, b.mean_rank) AND greatest(a.mean_rank, b.mean_rank) - c.mean_rank > 2.343 * sqrt(12 / (6.0 * f.n)) AND least(a.mean_rank, b.mean_rank) - c.mean_rank <= 2.343 * sqrt(12 / (6.0 * f.n))) = 0 AS whole
  FROM o JOIN f ON f.metric = o.view JOIN z a ON a.metric = o.view AND a.pipeline = o.pipeline JOIN z b ON b.metric = o.view AND b.pipeline = o.runner_up WHERE nth = 1)
SELECT view, pipeline, round(value, 6) AS value, runner_up, round(behind, 6) AS behind, round(exp(-chi2 / 2), 6) AS p, CASE WHEN near AND whole THEN 'tie' ELSE 'confirmed' END AS verdict FROM d""")
def report_verdicts(spark, sf_dir):
    """Each metric as a view of its own."""
    scores = derived.item_scores(spark, sf_dir).withColumn("view", F.col("metric"))
    means = aggregate.micro(scores, ["view", "pipeline"])
    tied = statistics.tied_groups(statistics.mean_ranks(scores, ["view"]), ["view"])
    return rounded(reports.verdicts(means, tied, statistics.friedman(scores, ["view"])), "value", "behind", "p")


_RUNS_SQL = "h AS (SELECT 'r' || (user_id % 7) AS run_id, event_type AS pipeline, CASE WHEN user_id % 2 = 0 THEN 'text' ELSE 'raw' END AS view, 'm' || (user_id % 3) AS metric, max(ts) AS completed_at, max(value) AS value FROM events GROUP BY ALL)"


def _runs(spark, sf_dir):
    one = F.col("user_id")
    keys = [F.concat(F.lit("r"), one % 7).alias("run_id"), F.col("event_type").alias("pipeline"), F.when(one % 2 == 0, "text").otherwise("raw").alias("view"), F.concat(F.lit("m"), one % 3).alias("metric")]
    return table(spark, sf_dir, "events").groupBy(*keys).agg(F.max("ts").alias("completed_at"), F.max("value").alias("value"))


@query(f"WITH {_RUNS_SQL} SELECT run_id, pipeline, view, metric, strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at, value FROM h ORDER BY h.completed_at DESC, run_id, pipeline, view, metric LIMIT 1000")
def history_recent(spark, sf_dir):
    return reports.recent_history(_runs(spark, sf_dir)).withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {_RUNS_SQL} SELECT DISTINCT view, metric FROM h")
def history_measures(spark, sf_dir):
    return reports.measured_pairs(_runs(spark, sf_dir))


@query("SELECT l_orderkey AS doc_id, coalesce(max(CASE WHEN l_orderkey % 3 = 0 THEN 60 END), max(l_quantity::BIGINT + 4))::BIGINT AS width, coalesce(max(CASE WHEN l_orderkey % 4 = 0 THEN 9 END), max(l_linenumber + 1))::BIGINT AS height FROM lineitem GROUP BY l_orderkey")
def page_extents(spark, sf_dir):
    """An order as a page, its items as boxes; some pages declare their size."""
    items = table(spark, sf_dir, "lineitem")
    key, long = F.col("l_orderkey"), lambda c: F.col(c).cast("long")
    box = F.struct(long("l_quantity").alias("x"), long("l_linenumber").alias("y"), F.lit(4).cast("long").alias("width"), F.lit(1).cast("long").alias("height"))
    rows = items.select(key.alias("doc_id"), F.when(key % 3 == 0, 60).cast("long").alias("page_width"), F.when(key % 4 == 0, 9).cast("long").alias("page_height"), box.alias("bbox"))
    return reports.page_extents(rows, ["doc_id"])


@query("""WITH p AS (SELECT s_name AS pipeline, CASE s_suppkey % 4 WHEN 0 THEN 'cloud' WHEN 1 THEN 'pages' WHEN 2 THEN 'local' ELSE 'other' END AS kind, 'm' || (s_nationkey % 3) AS model FROM supplier),
t(kind, model, paid, valid_until, a, b, c) AS (VALUES ('cloud', 'm0', true, DATE '2030-01-01', 1.0, 2.0, NULL), ('cloud', 'm1', true, DATE '2020-01-01', 3.0, 4.0, NULL), ('cloud', NULL, true, NULL, NULL, NULL, NULL), ('pages', NULL, true, DATE '2030-01-01', NULL, NULL, 0.001))
SELECT p.*, coalesce(e.a, k.a)::DOUBLE AS per_million_in, coalesce(e.b, k.b)::DOUBLE AS per_million_out, coalesce(e.c, k.c)::DOUBLE AS per_page,
  CASE WHEN e.a IS NOT NULL OR k.c IS NOT NULL THEN CASE WHEN coalesce(e.valid_until, k.valid_until) < DATE '2026-01-01' THEN 'outdated' ELSE 'tariff' END WHEN k.paid THEN 'unknown tariff' ELSE 'machine' END AS basis
FROM p LEFT JOIN t e ON e.kind = p.kind AND e.model = p.model LEFT JOIN t k ON k.kind = p.kind AND k.model IS NULL""")
def tariff_lookup(spark, sf_dir):
    """Prices by kind and model, else by kind."""
    key = F.col("s_suppkey") % 4
    pipelines = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("pipeline"), F.when(key == 0, "cloud").when(key == 1, "pages").when(key == 2, "local").otherwise("other").alias("kind"), F.concat(F.lit("m"), F.col("s_nationkey") % 3).alias("model"))
    rows = [("cloud", "m0", True, "2030-01-01", 1.0, 2.0, None), ("cloud", "m1", True, "2020-01-01", 3.0, 4.0, None), ("cloud", None, True, None, None, None, None), ("pages", None, True, "2030-01-01", None, None, 0.001)]
    tariffs = spark.createDataFrame(rows, "kind string, model string, paid boolean, valid_until string, per_million_in double, per_million_out double, per_page double")
    return reports.with_tariffs(pipelines, tariffs.withColumn("valid_until", F.to_date("valid_until")), "2026-01-01")


@query("SELECT o_orderpriority AS pipeline, o_orderkey AS doc_id, 'ref' || o_custkey AS ref, CASE WHEN o_orderkey % 3 > 0 THEN 'raw' || o_custkey ELSE '' END AS raw, CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW' THEN 'fix' || o_custkey ELSE '' END AS corrected FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW')")
def two_stage_triples(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pipeline"), F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("c"))
    raw = orders.filter("doc_id % 3 > 0").select("pipeline", "doc_id", F.lit("raw_text").alias("artifact_type"), F.concat(F.lit("raw"), "c").alias("content"))
    fixed_ = orders.filter("doc_id % 2 = 0 and pipeline <> '5-LOW'").select("pipeline", "doc_id", F.lit("corrected_text").alias("artifact_type"), F.concat(F.lit("fix"), "c").alias("content"))
    references = orders.select("doc_id", F.lit(0).alias("doc_pos"), F.concat(F.lit("ref"), "c").alias("ref"))
    triples = reports.two_stage_triples(references, raw.unionByName(fixed_)).join(orders.select("pipeline", "doc_id"), ["pipeline", "doc_id"], "left_semi")
    return triples.drop("doc_pos")
