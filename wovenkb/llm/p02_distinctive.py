"""How distinctive a term is per record.

Method: the log-odds ratio of a record against the rest with an informative Dirichlet prior taken from the
collection counts, divided by its standard error (a z-score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: A term in more than this share of all pairs is hot; there are at most 1/HOT_SHARE such terms.
HOT_SHARE = 1e-3


def log_odds_z(in_record: Column, record_size: Column, in_all: Column, all_size: Column, strength: float = 1.0) -> Column:
    """z of a term: counts in the record and in the collection; the prior is ``strength`` times the collection counts.

    With the collection itself as prior (strength 1) z falls strictly with the number of records that hold the
    term, among terms that are equally frequent in the record.
    """
    prior, prior_all = in_all * F.lit(strength), all_size * F.lit(strength)
    rest, rest_all = in_all - in_record, all_size - record_size
    own = F.log((in_record + prior) / (record_size + prior_all - in_record - prior))
    other = F.log((rest + prior) / (rest_all + prior_all - rest - prior))
    return (own - other) / F.sqrt(1 / (in_record + prior) + 1 / (rest + prior))


def distinctive_terms(links: DataFrame, record_col: str = "event_id", term_col: str = "entity_id", strength: float = 1.0) -> DataFrame:
    """(record, term, n_records bigint, z double) for every distinct (record, term).

    Repeated rows count once; rows with a null record or term are left out; other columns, weights too, are
    ignored. A term that is the only one of the whole table has no rest to compare with and gets z null.
    An empty table gives no rows. Hot terms don't skew a task: they are counted with map-side combination,
    and their few counts (at most 1/HOT_SHARE rows) are broadcast instead of joined by shuffle.
    """
    rows = links.select(F.col(record_col).alias("_r"), F.col(term_col).alias("_t")).filter("_r is not null and _t is not null").distinct()
    terms = rows.groupBy("_t").agg(F.count("*").alias("n_records"))
    sizes = rows.groupBy("_r").agg(F.count("*").alias("_size"))
    total = rows.agg(F.count("*").alias("_all"))
    hot = terms.crossJoin(F.broadcast(total)).filter(F.col("n_records") > F.lit(HOT_SHARE) * F.col("_all")).select("_t")
    hot_records = sizes.crossJoin(F.broadcast(total)).filter(F.col("_size") > F.lit(HOT_SHARE) * F.col("_all")).select("_r")
    x = common.split_hot_join(rows, terms, "_t", hot)
    x = common.split_hot_join(x, sizes, "_r", hot_records).crossJoin(F.broadcast(total))
    z = log_odds_z(F.lit(1.0), F.col("_size").cast("double"), F.col("n_records").cast("double"), F.col("_all").cast("double"), strength)
    return x.select(F.col("_r").alias(record_col), F.col("_t").alias(term_col), "n_records", F.when(F.col("_all") > F.col("n_records"), z).alias("z"))


def most_characteristic(scores: DataFrame, record_col: str = "event_id", term_col: str = "entity_id") -> DataFrame:
    """Of each record its shared terms (in two records or more) with the highest z; all terms of a tie."""
    best = Window.partitionBy(record_col).orderBy(F.col("z").desc_nulls_last())
    return scores.filter("n_records >= 2").withColumn("_rank", F.rank().over(best)).filter("_rank = 1").select(record_col, term_col)


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every linked entity of every event, rounded for comparison."""
    return distinctive_terms(common.table(spark, sf_dir, "kb_event_entities")).withColumn("z", F.round("z", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found over kb_event_entities."""
    return most_characteristic(distinctive_terms(common.table(spark, sf_dir, "kb_event_entities")))


_SCORES = """
WITH pairs AS (SELECT DISTINCT event_id, entity_id FROM kb_event_entities WHERE event_id IS NOT NULL AND entity_id IS NOT NULL),
t AS (SELECT entity_id, count(*) AS n_records FROM pairs GROUP BY 1),
s AS (SELECT event_id, count(*)::DOUBLE AS size FROM pairs GROUP BY 1),
c AS (SELECT p.event_id, p.entity_id, t.n_records, t.n_records::DOUBLE AS y, s.size, (SELECT count(*) FROM pairs)::DOUBLE AS n
      FROM pairs p JOIN t USING (entity_id) JOIN s USING (event_id))
"""

QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}
SQL = {
    "p2_scores": _SCORES
    + """SELECT event_id, entity_id, n_records, round((ln((1 + y) / (size + n - 1 - y)) - ln((2 * y - 1) / (2 * n - size - 2 * y + 1))) / sqrt(1 / (1 + y) + 1 / (2 * y - 1)), 6) AS z FROM c""",
    "p2_found": _SCORES + """SELECT event_id, entity_id FROM (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY n_records) AS r FROM c WHERE n_records >= 2) WHERE r = 1""",
}
