"""Queries of the problems 2, 3, 7, 8, 9 and 10 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.llm import bpe, confusables, mojibake, packing, survivorship, truncation
from daram.session import read


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survive(survivorship.prepare(read(spark, d, "uw_code_mapping"), read(spark, d, "source_trust")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.best_rows(survivorship.prepare(read(spark, d, "uw_code_mapping"), read(spark, d, "source_trust")))


def _truncatable(spark: SparkSession, d: str) -> DataFrame:
    uw, log = read(spark, d, "uw_code_mapping"), read(spark, d, "correction_log")
    return truncation.texts(uw, "uw_code_mapping", "map_id", {"pay_term": "list"}).unionByName(
        truncation.texts(log, "correction_log", "log_id", {"corrected.ageRange": "list", "original.specialNotes": "prose"}, resent=True)
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(_truncatable(spark, d)).select("table_name", "row_id", "field_name")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(_truncatable(spark, d))


def _lookalike_texts(spark: SparkSession, d: str) -> DataFrame:
    def of(table: str, key: str, field: str) -> DataFrame:
        return read(spark, d, table).select(F.lit(table).alias("table_name"), F.col(key).alias("row_id"), F.lit(field).alias("field_name"), F.col(field).alias("text"))

    return of("uw_code_mapping", "map_id", "entry_age_m").unionByName(of("correction_log", "log_id", "corrected.ageRange")).unionByName(of("parse_result", "parse_id", "terms.ageRange"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.normalise(_lookalike_texts(spark, d)).filter("differs").select("table_name", "row_id", "field_name").distinct()


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its consistent form; a re-sent log once, left out by its id before anything is normalised."""
    texts = _lookalike_texts(spark, d)
    once = texts.filter("table_name <> 'correction_log'").unionByName(texts.filter("table_name = 'correction_log'").dropDuplicates(["row_id"]))
    return confusables.normalise(once).withColumn("comparable", confusables.comparable(F.col("form")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read(spark, d, "documents"), "doc_id", "text")


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read(spark, d, "documents"), "doc_id", "text", offsets=True).select("doc_id", "piece_starts", "piece_tokens")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode(p8_ids(spark, d), "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign(bpe.count_tokens(read(spark, d, "documents"), "doc_id", "text"), read(spark, d, "pack_capacity"))


def p9_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p9_containers(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(read(spark, d, "documents")).filter("is_garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(read(spark, d, "documents")).filter("is_garbled")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_survivors, p3_found, p3_report, p7_found, p7_forms, p8_ids, p8_offsets, p8_decoded, p9_containers, p9_usage, p10_found, p10_restored)}


# The blanks of the Spark side, for DuckDB's RE2.
_BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SHUT = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{00AD}\x{034F}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"


# Fixed values, written apart from the operator's own tables: signs that look like others, by ranges. Invisible ones, spaces, wide and narrow forms, letters for formulas, and the letters and signs of other scripts that the tables hold.
_ODD = (
    r"[\x{0001}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{00A0}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{1680}\x{180B}-\x{180F}\x{2000}-\x{200F}\x{2010}\x{2011}\x{2024}\x{202A}-\x{202F}\x{2044}\x{2053}\x{205F}-\x{206F}\x{2215}\x{2223}\x{223C}\x{223D}\x{2236}"
    r"\x{3000}\x{3007}\x{301C}\x{3131}-\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FF01}-\x{FF5E}\x{FFA0}-\x{FFDC}\x{FFE0}-\x{FFE6}\x{1D400}-\x{1D7FF}\x{0391}-\x{03A9}\x{03BF}\x{03F9}\x{0405}\x{0406}\x{0410}-\x{042F}\x{0430}\x{0435}\x{043E}\x{0440}\x{0441}\x{0443}\x{0445}\x{0455}\x{0456}\x{0458}\x{04AE}\x{04C0}\x{04CF}\x{02D0}\x{02DC}\x{02F8}\x{05C3}\x{A789}\x{0589}\x{2160}\x{217C}\x{2768}\x{2769}\x{201A}\x{01C0}]"
)


def _blank(c: str) -> str:
    return f"({c} IS NULL OR regexp_replace(CAST({c} AS VARCHAR), '{_BLANKS}', '', 'g') IN ('', '-', '—'))"


def _spelled(c: str) -> str:
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    return f"translate(regexp_replace({c}, '{_SHUT}', '', 'g'), '{wide}', '{plain}')"


def oracle_sql() -> dict[str, str]:
    filled = " + ".join(f"CAST(NOT {_blank(c)} AS INT)" for c in survivorship.FIELDS)
    best = f"""
    WITH u AS (SELECT *, {_spelled('code')} AS k, {_spelled('period_label')} AS l, upper({_spelled('period_kind')}) AS m, {filled} AS filled, coalesce(trust_rank, -1) AS trust
        FROM uw_code_mapping LEFT JOIN source_trust USING (load_channel) WHERE NOT {_blank('code')}),
    g AS (SELECT *, CASE WHEN NOT {_blank('period_label')} THEN
            CASE WHEN contains(l, '갱신') AND regexp_matches(l, '[0-9]') THEN 'R' || CAST(CAST(regexp_extract(l, '[0-9]+') AS INT) AS VARCHAR)
                 WHEN regexp_matches(l, '종신|평생') THEN 'E999'
                 WHEN regexp_matches(l, '[0-9]세') THEN 'S' || CAST(CAST(regexp_extract(l, '[0-9]+') AS INT) AS VARCHAR)
                 WHEN regexp_matches(l, '[0-9]년') THEN 'N' || CAST(CAST(regexp_extract(l, '[0-9]+') AS INT) AS VARCHAR) ELSE '?' || l END
            WHEN m = 'E' OR period_value = 999 THEN 'E999' WHEN NOT {_blank('period_kind')} AND period_value IS NOT NULL THEN m || CAST(period_value AS VARCHAR) END AS p FROM u),
    t AS (SELECT k, p, min(map_id) AS group_id, max(filled) AS f, max(loaded_at) AS a, max(trust) AS r, count(*) AS n FROM g WHERE p IS NOT NULL GROUP BY k, p)
    SELECT group_id, min(map_id) AS best_id FROM t JOIN g USING (k, p) WHERE n > 1 AND filled = f AND loaded_at = a AND trust = r GROUP BY group_id HAVING count(*) = 1"""
    part = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS row_id, '{f}' AS field_name, {f} AS text FROM {t}" for t, k, f in (("uw_code_mapping", "map_id", "entry_age_m"), ("correction_log", "log_id", "corrected.ageRange"), ("parse_result", "parse_id", "terms.ageRange")))
    alike = f"SELECT DISTINCT table_name, row_id, field_name FROM ({part}) WHERE regexp_matches(text, '{_ODD}') OR nfc_normalize(text) <> text OR regexp_matches(text, '[0-9][OolI]|[OolI][0-9]') OR regexp_matches(text, '(^|[^A-Za-z0-9])[OolI]+\\s*[~세년]')"
    values = ", ".join(f"arg_max({c}, {{'r': trust, 'a': coalesce(loaded_at, TIMESTAMP '0001-01-01'), 'v': {c}}}) FILTER (NOT {_blank(c)}) AS {c}" for c in survivorship.FIELDS)
    survivors = best.replace(best[best.index("    t AS ("):], f"    x AS (SELECT 1) SELECT min(map_id) AS group_id, count(*) AS n_rows, k AS code_key, p AS period_key, {values} FROM g WHERE p IS NOT NULL GROUP BY k, p")
    survivors = f"SELECT s.*, f.best_id FROM ({survivors}) s LEFT JOIN ({best}) f USING (group_id)"
    return {"p2_survivors": survivors, "p2_found": best, "p7_found": alike}
