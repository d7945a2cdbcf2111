"""Corpora derived from the supplied tables, the same in both dialects.

The tables hold no pipeline outputs, so three engines are derived from ``documents``: the
text of each line in ASCII is the reference, and each engine spoils it in its own way. A
unit is one line that is not empty (``line_id``); whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENGINES = ("alpha", "beta", "gamma")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spoilt(ref: Column, engine: str) -> Column:
    if engine == "alpha":
        return F.replace(ref, F.lit("rn"), F.lit("m"))
    if engine == "beta":
        return F.lower(ref)
    return F.replace(F.translate(ref, "u", "n"), F.lit(" th"), F.lit(" "))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out anew; a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, stratum, line, ref)."""
    ascii_text = F.regexp_replace("text", "[^ -~\n]", "?")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    docs = docs.select("doc_id", F.col("lang").alias("stratum"), F.posexplode(F.split(ascii_text, "\n")).alias("line", "ref"))
    return docs.filter("ref <> ''")


def line_id() -> Column:
    """Sorts and names lines by document and place."""
    return F.format_string("%d:%d", "doc_id", "line")


def pairs(spark: SparkSession, sf_dir: str, engines=ENGINES) -> DataFrame:
    """(view, pipeline, doc_id, stratum, line, doc_pos, ref, hyp), a row for each engine and line.

    A line that an engine leaves empty is an empty hypothesis.
    """
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("pipeline"), spoilt(F.col("ref"), e).alias("hyp")) for e in engines]))
    rows = lines(spark, sf_dir).select("doc_id", "stratum", "line", "ref", both.alias("e"))
    return rows.select(F.lit("text").alias("view"), "e.pipeline", "doc_id", "stratum", "line", line_id().alias("doc_pos"), "ref", "e.hyp")


def by_line(df: DataFrame) -> DataFrame:
    """Units are lines: their number is the document's id."""
    return df.drop("doc_id").withColumn("doc_id", F.col("doc_pos"))


#: The same in SQL: ``lines`` and ``pairs``.
LINES_SQL = r"""
L AS (SELECT doc_id, lang, string_split(regexp_replace(text, '[^ -~\n]', '?', 'g'), chr(10)) AS ls FROM documents),
N AS (SELECT doc_id, lang, ls, unnest(range(1, len(ls) + 1)) AS i FROM L),
lines AS (SELECT doc_id, lang AS stratum, i - 1 AS line, doc_id || ':' || (i - 1) AS line_id, ls[i] AS ref FROM N WHERE ls[i] <> '')
"""
PAIRS_SQL = f"""{LINES_SQL},
pairs AS (
  SELECT *, 'alpha' AS pipeline, replace(ref, 'rn', 'm') AS hyp FROM lines
  UNION ALL SELECT *, 'beta', lower(ref) FROM lines
  UNION ALL SELECT *, 'gamma', replace(translate(ref, 'u', 'n'), ' th', ' ') FROM lines
)
"""
SCORES_SQL = f"""{PAIRS_SQL},
scores AS (SELECT *, levenshtein(ref, hyp)::DOUBLE AS edits, length(ref) AS weight, levenshtein(ref, hyp) / length(ref)::DOUBLE AS value FROM pairs),
docs AS (SELECT doc_id, stratum, pipeline, sum(edits) AS edits, sum(weight) AS weight, sum(edits) / sum(weight) AS value FROM scores GROUP BY ALL)
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of ``events`` as a run history: (pipeline, ts, value)."""
    events = table(spark, sf_dir, "events").filter("value is not null")
    return events.groupBy(F.col("event_type").alias("pipeline"), F.to_date("ts").alias("ts")).agg(F.round(F.avg("value"), 9).alias("value"))


SERIES_SQL = "series AS (SELECT event_type AS pipeline, ts::DATE AS ts, round(avg(value), 9) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL)"


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with years, folios, amounts and regnal years from ``orders``; the hypothesis reads every 9 as 4."""
    orders = table(spark, sf_dir, "orders")
    number = lambda c, n: (F.col(c) % n).cast("string")
    ref = F.concat(F.lit("en "), F.year("o_orderdate").cast("string"), F.lit(" fol. "), number("o_custkey", 50), F.lit("r, pour "), number("o_orderkey", 30), F.lit(" livres l'an "), number("o_custkey", 20))
    return orders.select(F.lit("text").alias("view"), F.col("o_orderpriority").alias("pipeline"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("doc_pos"), ref.alias("ref")).withColumn("hyp", F.replace("ref", F.lit("9"), F.lit("4")))


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three engines over orders, from ``lineitem``: two metrics, weights, and an order's status as stratum."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("pipeline"), F.col("l_orderkey").alias("doc_id"))
    rows = items.agg(F.round(F.avg("l_discount"), 6).alias("cer"), F.round(F.avg("l_tax"), 6).alias("wer"), F.sum("l_linenumber").cast("long").alias("weight"), F.max("l_linestatus").alias("stratum"))
    each = F.inline(F.array(F.struct(F.lit("cer").alias("metric"), F.col("cer").alias("value")), F.struct(F.lit("wer").alias("metric"), F.when(F.col("doc_id") % 5 > 0, F.col("wer")).alias("value"))))
    return rows.select(F.lit("text").alias("view"), "pipeline", "doc_id", "stratum", "weight", each)


ITEM_SCORES_SQL = """
i AS (SELECT l_returnflag AS pipeline, l_orderkey AS doc_id, round(avg(l_discount), 6) AS cer, round(avg(l_tax), 6) AS wer, sum(l_linenumber)::BIGINT AS weight, max(l_linestatus) AS stratum FROM lineitem GROUP BY ALL),
s AS (SELECT pipeline, doc_id, stratum, weight, 'cer' AS metric, cer AS value FROM i UNION ALL SELECT pipeline, doc_id, stratum, weight, 'wer', CASE WHEN doc_id % 5 > 0 THEN wer END FROM i)
"""
