"""Queries of merges, folds, migrations and trailing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daram.functions import terms
from daram.operators import relational as R
from daram.operators import state
from daram.plans.registry import query
from daram.session import read

_LOG = "(SELECT DISTINCT ON (log_id) * FROM correction_log)"
_FIELDS = ("insuTerm", "payTerm", "ageRange", "renew")
_CHANGES = f"(SELECT insu_cd, log_id, created_at, f AS field_name, v AS value FROM {_LOG}, unnest([{{'f': 'insuTerm', 'v': corrected.insuTerm, 'o': original.insuTerm}}, {{'f': 'payTerm', 'v': corrected.payTerm, 'o': original.payTerm}}, {{'f': 'ageRange', 'v': corrected.ageRange, 'o': original.ageRange}}, {{'f': 'renew', 'v': corrected.renew, 'o': original.renew}}]) AS t(s), LATERAL (SELECT s.f AS f, s.v AS v, s.o AS o) WHERE v IS NOT NULL AND v IS DISTINCT FROM o AND insu_cd IS NOT NULL)"


def corrections(log: DataFrame) -> DataFrame:
    """One row per field that a log changed."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"corrected.{f}").alias("value"), F.col(f"original.{f}").alias("old")) for f in _FIELDS)))
    return log.filter("insu_cd IS NOT NULL").select("insu_cd", "log_id", "created_at", each.alias("c")).select("insu_cd", "log_id", "created_at", "c.*").filter(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("old"))).drop("old")


@query(f"""SELECT insu_cd, field_name, arg_max(value, log_id) AS pattern_value, CAST(least(80 + 10 * (count(*) - 1), 100) AS INT) AS confidence_score, count(*) - 1 AS apply_count FROM {_CHANGES} GROUP BY 1, 2""")
def pattern_upsert_fold(spark: SparkSession, d: str) -> DataFrame:
    """Replay of all corrections as the upserts would leave the pattern table."""
    log = read(spark, d, "correction_log").dropDuplicates(["log_id"])
    return state.fold_patterns(corrections(log), ["insu_cd", "field_name"], "value", [F.col("log_id")])


@query(f"""WITH n AS (SELECT insu_cd, field_name, arg_max(value, log_id) AS v, count(*) AS n FROM {_CHANGES} GROUP BY 1, 2)
    SELECT coalesce(p.insu_cd, n.insu_cd) AS insu_cd, coalesce(p.field_name, n.field_name) AS field_name, coalesce(n.v, p.pattern_value) AS pattern_value,
      CAST(CASE WHEN n.v IS NULL THEN p.confidence_score WHEN p.insu_cd IS NULL THEN 80 WHEN p.learning_source = 'UW_MAPPING' THEN 100 ELSE least(coalesce(p.confidence_score, 0) + 10 * n.n, 100) END AS INT) AS confidence_score
    FROM learned_pattern p FULL JOIN n ON p.insu_cd = n.insu_cd AND p.field_name = n.field_name""")
def pattern_merge(spark: SparkSession, d: str) -> DataFrame:
    """MERGE of the corrections into the learned patterns, as the next version of the table."""
    log = read(spark, d, "correction_log").dropDuplicates(["log_id"])
    new = corrections(log).groupBy("insu_cd", "field_name").agg(F.max_by("value", "log_id").alias("v"), F.count(F.lit(1)).alias("n"))
    table = read(spark, d, "learned_pattern").select("insu_cd", "field_name", "pattern_value", "confidence_score", "learning_source")
    raised = F.least(F.coalesce(F.col("t.confidence_score"), F.lit(0)) + 10 * F.col("s.n"), F.lit(100))
    out = state.merge(
        table, new, ["insu_cd", "field_name"],
        update={"pattern_value": F.col("s.v"), "confidence_score": F.when(F.col("t.learning_source") == "UW_MAPPING", 100).otherwise(raised)},
        insert={"pattern_value": F.col("s.v"), "confidence_score": F.lit(80)},
    )
    return out.drop("learning_source")


@query("""SELECT coalesce(a.stat_date, b.stat_date) AS stat_date, coalesce(b.n, 0) AS n_corrections, coalesce(a.n, 0) AS n_patterns FROM (SELECT strftime(created_at, '%Y-%m-%d') AS stat_date, count(*) AS n FROM learned_pattern WHERE created_at IS NOT NULL GROUP BY 1) a
    FULL JOIN (SELECT strftime(created_at, '%Y-%m-%d') AS stat_date, count(*) AS n FROM """ + _LOG + """ WHERE created_at IS NOT NULL GROUP BY 1) b ON a.stat_date = b.stat_date""")
def statistics_merge(spark: SparkSession, d: str) -> DataFrame:
    """Daily statistics of two tables merged by date."""
    day = F.date_format("created_at", "yyyy-MM-dd").alias("stat_date")
    a = read(spark, d, "learned_pattern").filter("created_at IS NOT NULL").groupBy(day).agg(F.count(F.lit(1)).alias("n_patterns")).withColumn("n_corrections", F.lit(0).cast("bigint"))
    b = read(spark, d, "correction_log").dropDuplicates(["log_id"]).filter("created_at IS NOT NULL").groupBy(day).agg(F.count(F.lit(1)).alias("n_corrections"))
    return state.merge(a, b, ["stat_date"], update={"n_corrections": F.col("s.n_corrections")}, insert={"n_corrections": F.col("s.n_corrections"), "n_patterns": F.lit(0).cast("bigint")}).select("stat_date", "n_corrections", "n_patterns")


@query("""WITH u AS (SELECT * FROM uw_code_mapping WHERE code IS NOT NULL)
    SELECT code, 'insuTerm' AS field_name, period_label AS pattern_value FROM u WHERE period_label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN period_label = '종신' THEN 0 ELSE 1 END, period_label) = 1
    UNION ALL SELECT code, 'payTerm', string_agg(DISTINCT pay_term, ', ' ORDER BY pay_term) FROM u WHERE pay_term IS NOT NULL GROUP BY 1
    UNION ALL SELECT code, 'ageRange', entry_age_m FROM u WHERE entry_age_m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(entry_age_m) DESC, entry_age_m) = 1
    UNION ALL SELECT DISTINCT code, 'renew', '비갱신형' FROM u""")
def migrate_four_fields(spark: SparkSession, d: str) -> DataFrame:
    """Pattern rows of four fields made from the mapping: first by custom order, distinct list, longest, constant."""
    u = read(spark, d, "uw_code_mapping").filter("code IS NOT NULL")

    def of(field: str, df: DataFrame) -> DataFrame:
        return df.select("code", F.lit(field).alias("field_name"), "pattern_value")

    first = R.pick_per_key(u.filter("period_label IS NOT NULL"), ["code"], [F.when(F.col("period_label") == "종신", 0).otherwise(1), F.col("period_label")], ["period_label"], largest=False).withColumnRenamed("period_label", "pattern_value")
    listed = u.filter("pay_term IS NOT NULL").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("pay_term")), ", ").alias("pattern_value"))
    longest = R.pick_per_key(u.filter("entry_age_m IS NOT NULL"), ["code"], [-F.length("entry_age_m"), F.col("entry_age_m")], ["entry_age_m"], largest=False).withColumnRenamed("entry_age_m", "pattern_value")
    return of("insuTerm", first).unionByName(of("payTerm", listed)).unionByName(of("ageRange", longest)).unionByName(of("renew", u.select("code").distinct().withColumn("pattern_value", F.lit("비갱신형"))))


@query(f"""WITH n AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM {_LOG} WHERE created_at IS NOT NULL GROUP BY 1)
    SELECT a.day, a.n, CAST(sum(b.n) FILTER (CAST(b.day AS DATE) > CAST(a.day AS DATE) - 7) AS BIGINT) AS n_week, CAST(sum(b.n) AS BIGINT) AS n_month FROM n a JOIN n b ON CAST(b.day AS DATE) BETWEEN CAST(a.day AS DATE) - 29 AND CAST(a.day AS DATE) GROUP BY 1, 2""")
def trailing_counts(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of the trailing 7 and 30 days of every day; the windows run over days."""
    n = read(spark, d, "correction_log").dropDuplicates(["log_id"]).filter("created_at IS NOT NULL").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.datediff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date")))
    return n.select("day", "n", F.sum("n").over(w.rangeBetween(-6, 0)).alias("n_week"), F.sum("n").over(w.rangeBetween(-29, 0)).alias("n_month"))


@query("""SELECT c AS code, min(src_file) AS src_file FROM (SELECT src_file, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 5)) AS c FROM documents WHERE text IS NOT NULL) WHERE NOT EXISTS (SELECT 1 FROM uw_code_mapping u WHERE u.code = c) GROUP BY 1""")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    """Rows a get-or-insert would append to the mapping for the codes that documents name."""
    u = read(spark, d, "uw_code_mapping").select("map_id", "code")
    new = read(spark, d, "documents").filter("text IS NOT NULL").select(F.explode(terms.codes(F.col("text"))).alias("code"), "src_file")
    return R.insert_missing(u, new, "code", "map_id").select("code", "src_file")
