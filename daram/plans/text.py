"""Queries of text extraction, normalising and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.functions import numbers, terms
from daram.operators import relational as R
from daram.operators import sections
from daram.plans.registry import query
from daram.session import read

_CODES = "list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 5)"


@query(f"SELECT doc_id, c AS code, n FROM (SELECT doc_id, unnest(list_distinct({_CODES})) AS c, len({_CODES}) AS n FROM documents WHERE text IS NOT NULL)")
def code_extract(spark: SparkSession, d: str) -> DataFrame:
    """Five-digit codes of every document, once each, with the number of mentions."""
    every = F.regexp_extract_all("text", F.lit(terms.CODE), F.lit(1))
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(every)).alias("code"), F.size(every).cast("bigint").alias("n"))


@query("""SELECT map_id, regexp_replace(regexp_replace(regexp_replace(trim(code, ' '), '^([0-9]) ([0-9]) ([0-9]) ([0-9]) ([0-9])$', '\\1\\2\\3\\4\\5'), '^([0-9]{3}) ([0-9]{2})$', '\\1\\2'), '^([0-9]{2}) ([0-9]{3})$', '\\1\\2') AS code FROM uw_code_mapping""")
def code_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Codes torn apart by blanks put together; other spellings stay."""
    return read(spark, d, "uw_code_mapping").select("map_id", terms.join_code(F.trim("code")).alias("code"))


@query("""SELECT doc_id, coalesce(len(list_distinct(regexp_extract_all(text, '[0-9]+[년세]납|전기납|일시납'))), 0) AS n_pay, coalesce(len(list_distinct(regexp_extract_all(text, '종신|[0-9]+[세년]만기'))), 0) AS n_term,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+[년세]납|전기납|일시납'))), ',') AS pay, CASE WHEN contains(text, '비갱신') THEN '비갱신형' WHEN contains(text, '갱신') THEN '갱신형' ELSE '비갱신형' END AS renew FROM documents WHERE text IS NOT NULL""")
def terms_extract(spark: SparkSession, d: str) -> DataFrame:
    """Payment terms, insurance terms and the kind of renewal named in a document."""
    t = F.col("text")
    pay = terms.pay_terms(t)
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(pay).cast("bigint").alias("n_pay"), F.size(terms.insurance_terms(t)).cast("bigint").alias("n_term"), F.array_join(F.array_sort(pay), ",").alias("pay"), terms.renewal(t, "비갱신형").alias("renew"))


@query("""WITH l AS (SELECT doc_id, text, coalesce(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+ *[년세회] *납|전기납|일시납|월납|연납'), lambda x: replace(x, ' ', ''))), []) AS pay,
        coalesce(list_distinct(list_transform(regexp_extract_all(text, '종신|평생|[0-9]+ *[세년] *만기|[0-9]+ *세 *(?:까지|종료)'), lambda x: replace(x, ' ', ''))), []) AS insu,
        coalesce(list_distinct(list_transform(regexp_extract_all(text, '만? ?[0-9]+세? ?~ ?만? ?[0-9]+세?'), lambda x: regexp_replace(x, '[만세 ]', '', 'g'))), []) AS ages FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, coalesce(array_to_string(list_sort(pay), ','), '') AS pay, coalesce(array_to_string(list_sort(insu), ','), '') AS insu, coalesce(array_to_string(list_sort(ages), ','), '') AS ages FROM l""")
def terms_all_forms(spark: SparkSession, d: str) -> DataFrame:
    """Payment terms, insurance terms and age ranges of a document in every form of the survey."""
    t = F.col("text")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", joined(terms.all_pay_terms(t)).alias("pay"), joined(terms.all_insurance_terms(t)).alias("insu"), joined(terms.age_ranges(t)).alias("ages"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10))) AS line, unnest(range(len(string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
    h AS (SELECT *, nullif(regexp_extract(line, '^\\[([^\\]]+)\\]', 1), '') AS head FROM l),
    s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h)
    SELECT doc_id, section, CAST(line_no AS INT) AS line_no, line FROM s WHERE head IS NULL AND section IS NOT NULL""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines below headings in square brackets, by a state machine over each document's own lines."""
    return sections.sections(read(spark, d, "documents"), "text", r"^\[([^\]]+)\]", ["doc_id"])


@query("""WITH l AS (SELECT doc_id, string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10)) AS a FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(i AS INT) AS line_no, CAST(len(a[greatest(i - 2, 0) + 1 : i + 2]) AS INT) AS n_around FROM l, unnest(range(len(a))) r(i) WHERE regexp_matches(a[i + 1], '\\([0-9]{5}\\)')""")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name a code in brackets, with two lines before and one after."""
    x = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(sections.with_neighbours(F.col("text"), 2, 1)).alias("x"))
    return x.filter(F.col("x.line").rlike(r"\(\d{5}\)")).select("doc_id", "x.line_no", F.size("x.around").alias("n_around"))


LINES = """WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS n FROM (SELECT doc_id, string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
    f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, len(list_filter(regexp_extract_all(line, '[0-9]+'), lambda x: length(x) = 5)) > 0 AS done FROM l WHERE trim(line, ' ') <> ''),
    r AS (SELECT *, coalesce(sum(CAST(done AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM f),
    g AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY n) - 1) // 3 AS part_of_run FROM r),
    p AS (SELECT doc_id, string_agg(line, ' ' ORDER BY n) AS part, min(n) AS n FROM g GROUP BY doc_id, run, part_of_run),
    parts AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS part_no, part FROM p)"""


@query(LINES + " SELECT doc_id, part_no, part FROM parts")
def lines_combined(spark: SparkSession, d: str) -> DataFrame:
    """Lines put together until they name a code; each line is used once."""
    return sections.combine(read(spark, d, "documents").filter("text IS NOT NULL"), "text", ["doc_id"], terms.CODE)


@query("""SELECT map_id, lower(regexp_replace(regexp_replace(product_name, '\\(무\\)|\\[[^\\]]*\\]', '', 'g'), '[^가-힣0-9A-Za-z]', '', 'g')) AS title FROM uw_code_mapping""")
def normalise_title(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uw_code_mapping").select("map_id", terms.normal_title(F.col("product_name")).alias("title"))


@query("""WITH e AS (SELECT DISTINCT insu_cd, product_name FROM correction_log WHERE insu_cd IS NOT NULL AND product_name IS NOT NULL), m AS (SELECT DISTINCT code, product_name FROM uw_code_mapping WHERE code IS NOT NULL AND product_name IS NOT NULL),
    s AS (SELECT insu_cd, e.product_name AS a, m.product_name AS b, CASE WHEN contains(e.product_name, m.product_name) OR contains(m.product_name, e.product_name) THEN 1000 ELSE len(list_distinct(list_intersect(list_filter(string_split(e.product_name, ' '), lambda x: x <> ''), list_filter(string_split(m.product_name, ' '), lambda x: x <> '')))) END AS score FROM e JOIN m ON code = insu_cd)
    SELECT insu_cd, a AS product_name, b AS best_title, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY insu_cd, a ORDER BY score DESC, b) = 1""")
def title_match(spark: SparkSession, d: str) -> DataFrame:
    """Best mapping title of the same code: containment first, else the most shared words; no word in common is no match."""
    e = read(spark, d, "correction_log").select("insu_cd", F.col("product_name").alias("a")).dropna().distinct()
    m = read(spark, d, "uw_code_mapping").select("code", F.col("product_name").alias("b")).dropna().distinct()
    score = F.when(F.contains("a", F.col("b")) | F.contains("b", F.col("a")), 1000).otherwise(terms.word_overlap(F.col("a"), F.col("b"))).cast("bigint")
    s = e.join(m, F.col("code") == F.col("insu_cd")).withColumn("score", score).filter("score > 0")
    return R.pick_per_key(s, ["insu_cd", "a"], [-F.col("score"), F.col("b")], ["b", "score"], largest=False).select("insu_cd", F.col("a").alias("product_name"), F.col("b").alias("best_title"), "score")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS INT) AS k_int FROM events""")
def json_value(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", k.alias("k"), k.try_cast("int").alias("k_int"))


@query("""SELECT map_id, CASE WHEN regexp_matches(period_label, '종신|평생') THEN 999 WHEN regexp_matches(period_label, '[0-9]+세') THEN CASE WHEN n <= 30 THEN n WHEN n > 15 THEN n - 15 END ELSE n END AS term FROM (SELECT map_id, period_label, try_cast(regexp_extract(period_label, '[0-9]+') AS INT) AS n FROM uw_code_mapping)""")
def term_to_int(spark: SparkSession, d: str) -> DataFrame:
    """Length of the term for someone aged 15."""
    return read(spark, d, "uw_code_mapping").select("map_id", terms.term_to_int(F.col("period_label"), F.lit(15)).alias("term"))


@query("""SELECT map_id, CASE WHEN pay_term IS NULL OR trim(pay_term, ' ') = '' THEN '—' WHEN regexp_extract(pay_term, '월납\\(([^)]*)\\)', 1) <> '' THEN regexp_extract(pay_term, '월납\\(([^)]*)\\)', 1) ELSE trim(pay_term, ' ') END AS pay_term FROM uw_code_mapping""")
def pay_term_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uw_code_mapping").select("map_id", terms.inner_pay_term(F.col("pay_term")).alias("pay_term"))


@query("""SELECT parse_id, nullif(regexp_replace(regexp_extract(terms.ageRange, '남\\s*:\\s*([^,)]*)', 1), '[만세 ]', '', 'g'), '') AS men, nullif(regexp_replace(regexp_extract(terms.ageRange, '여\\s*:\\s*([^,)]*)', 1), '[만세 ]', '', 'g'), '') AS women FROM parse_result""")
def gender_ages(spark: SparkSession, d: str) -> DataFrame:
    """First age range of each gender in plain numbers."""
    a = F.col("terms.ageRange")
    return read(spark, d, "parse_result").select("parse_id", terms.gender_age(a, "남").alias("men"), terms.gender_age(a, "여").alias("women"))


@query("""WITH p AS (SELECT parse_id, terms.ageRange AS a, unnest(list_distinct(regexp_extract_all(terms.payTerm, '[0-9]+[년세]납|전기납|일시납'))) AS pay_term FROM parse_result),
    s AS (SELECT *, CASE WHEN contains(a, pay_term) THEN substr(a, strpos(a, pay_term) + length(pay_term)) END AS behind FROM p)
    SELECT parse_id, pay_term, coalesce(nullif(regexp_extract(behind, '^\\(([^)]*)\\)', 1), ''), nullif(regexp_extract(behind, '^\\s*:\\s*([^,]*)', 1), ''), a) AS ages FROM s""")
def age_for_pay_term(spark: SparkSession, d: str) -> DataFrame:
    """Age range of each payment term a record names."""
    return read(spark, d, "parse_result").select("parse_id", F.col("terms.ageRange").alias("a"), F.explode(terms.pay_terms(F.col("terms.payTerm"))).alias("pay_term")).select("parse_id", "pay_term", terms.age_for_pay_term(F.col("a"), F.col("pay_term")).alias("ages"))


@query("""SELECT parse_id, len(l) AS n, array_to_string(l, '|') AS entries FROM (SELECT parse_id, coalesce(list_filter(list_transform(string_split(terms.insuTerm, ','), lambda x: trim(x, ' ')), lambda x: x NOT IN ('', '—')), []) AS l FROM parse_result)""")
def comma_list(spark: SparkSession, d: str) -> DataFrame:
    entries = terms.comma_list(F.col("terms.insuTerm"))
    return read(spark, d, "parse_result").select("parse_id", F.size(entries).cast("bigint").alias("n"), F.array_join(entries, "|").alias("entries"))


@query("""SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS head FROM documents""")
def shorten(spark: SparkSession, d: str) -> DataFrame:
    """Head of a text, marked only where something was cut."""
    return read(spark, d, "documents").select("doc_id", terms.shorten(F.col("text"), 80).alias("head"))


@query("""SELECT parse_id, nullif(regexp_extract(file_name, 'UW([0-9]{5})(\\.pdf)?$', 1), '') AS code FROM parse_result""")
def code_of_file(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "parse_result").select("parse_id", terms.code_of_file(F.col("file_name")).alias("code"))


@query("""SELECT doc_id, concat_ws('_', substr(translate(base64(unhex(sha256(text))), '+/', '-_'), 1, 16), insu_cd, 'v1') AS cache_key FROM documents WHERE text IS NOT NULL""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Key of a parse: content hash, code and version."""
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", terms.cache_key(F.col("text"), F.col("insu_cd"), F.lit("v1")).alias("cache_key"))


@query("""SELECT doc_kind, CASE WHEN text IS NULL OR length(trim(text, ' ')) < 100 THEN 'EMPTY' WHEN contains(text, '한도표') THEN 'TABLE' WHEN regexp_matches(text, '[0-9]+년납') AND regexp_matches(text, '[0-9]+세') THEN 'TERMS' WHEN length(text) < 1000 THEN 'SIMPLE' ELSE 'COMPLEX' END AS kind, count(*) AS n FROM documents GROUP BY 1, 2""")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("doc_kind", terms.document_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT source, count(*) AS n_docs, CAST(sum(coalesce(len({_CODES}), 0)) AS BIGINT) AS n_codes, count(*) FILTER (contains(text, '종신')) AS n_whole_life FROM documents GROUP BY 1""")
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents, codes and found words per source."""
    n = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(terms.CODE), F.lit(1))), F.lit(0))
    return read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.greatest(n, F.lit(0))).alias("n_codes"), F.count(F.when(F.col("text").contains("종신"), 1)).alias("n_whole_life"))


@query("""WITH m AS (SELECT doc_id, replace(regexp_extract(text, '([0-9,]+) ?(억|천만|백만|만|천)? ?원', 1), ',', '') AS a, regexp_extract(text, '([0-9,]+) ?(억|천만|백만|만|천)? ?원', 2) AS u FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, try_cast(a AS BIGINT) * CASE u WHEN '억' THEN 100000000 WHEN '천만' THEN 10000000 WHEN '백만' THEN 1000000 WHEN '만' THEN 10000 WHEN '천' THEN 1000 ELSE 1 END AS won FROM m WHERE a <> ''""")
def won_parse(spark: SparkSession, d: str) -> DataFrame:
    """First amount of money of each document in won."""
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", numbers.won(F.col("text")).alias("won")).filter("won IS NOT NULL")


@query("""SELECT o_orderkey, CASE WHEN e > 0 AND m > 0 THEN e || '억 ' || m || '만원' WHEN e > 0 THEN e || '억원' WHEN m > 0 THEN m || '만원' ELSE w || '원' END AS shown FROM (SELECT o_orderkey, w, w // 100000000 AS e, (w % 100000000) // 10000 AS m FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * 13 AS w FROM orders))""")
def money_display(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", numbers.money_display(numbers.cents(F.col("o_totalprice")) * 13).alias("shown"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN '10세이하' WHEN p_size <= 20 THEN '11~20세' WHEN p_size <= 30 THEN '21~30세' WHEN p_size <= 40 THEN '31~40세' WHEN p_size > 40 THEN '41세이상' END AS band FROM part""")
def age_band(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", numbers.band(F.col("p_size"), [10, 20, 30, 40], "세").alias("band"))


@query("""WITH e AS (SELECT * FROM (SELECT DISTINCT insu_cd, example_id FROM few_shot_example WHERE is_active AND insu_cd IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY insu_cd ORDER BY md5('7:' || example_id), example_id) <= 3)
    SELECT parse_id, example_id FROM parse_result p JOIN e ON e.insu_cd = p.insu_cd""")
def few_shot_select(spark: SparkSession, d: str) -> DataFrame:
    """Three examples of the same code per record, by hash order instead of chance. They are chosen per code, before records meet them."""
    e = read(spark, d, "few_shot_example").filter("is_active AND insu_cd IS NOT NULL").select("insu_cd", "example_id").distinct()
    chosen = R.top_per_key(e, ["insu_cd"], [F.md5(F.concat(F.lit("7:"), F.col("example_id").cast("string"))), F.col("example_id")], 3)
    return read(spark, d, "parse_result").select("parse_id", "insu_cd").join(chosen, "insu_cd").select("parse_id", "example_id")


@query("""WITH a AS (SELECT DISTINCT insu_cd, example_id, md5('7:' || example_id) AS h FROM few_shot_example WHERE is_active),
    m AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(trim(code, ' '), '^([0-9]) ([0-9]) ([0-9]) ([0-9]) ([0-9])$', '\\1\\2\\3\\4\\5'), '^([0-9]{3}) ([0-9]{2})$', '\\1\\2'), '^([0-9]{2}) ([0-9]{3})$', '\\1\\2') AS code FROM uw_code_mapping WHERE product_group = '주계약' OR class_tag = 'MAIN'),
    own AS (SELECT insu_cd, example_id FROM a WHERE insu_cd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY insu_cd ORDER BY h, example_id) <= 3),
    pool AS (SELECT DISTINCT 2 AS tier, example_id, h FROM a WHERE insu_cd IN (SELECT code FROM m) UNION ALL SELECT DISTINCT 3, example_id, h FROM a),
    spare AS (SELECT tier, example_id FROM pool WHERE tier = (SELECT min(tier) FROM pool) QUALIFY row_number() OVER (ORDER BY h, example_id) <= 3)
    SELECT parse_id, example_id, 1 AS tier FROM parse_result p JOIN own ON own.insu_cd = p.insu_cd
    UNION ALL SELECT parse_id, example_id, tier FROM parse_result p, spare WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.insu_cd = p.insu_cd)""")
def few_shot_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Examples of every record: three of its own code (tier 1), else three of main contracts (2), else, where there are none, any three (3), by hash order."""
    active = read(spark, d, "few_shot_example").filter("is_active").select("insu_cd", "example_id").distinct()
    order = [F.md5(F.concat(F.lit("7:"), F.col("example_id").cast("string"))), F.col("example_id")]
    own = R.top_per_key(active.filter("insu_cd IS NOT NULL"), ["insu_cd"], order, 3)
    main = read(spark, d, "uw_code_mapping").filter("product_group = '주계약' OR class_tag = 'MAIN'").select(terms.join_code(F.trim("code")).alias("insu_cd")).distinct()
    first = lambda df, tier: df.select("example_id").distinct().orderBy(*order).limit(3).withColumn("tier", F.lit(tier))
    pool = first(active.join(main, "insu_cd", "left_semi"), 2).unionByName(first(active, 3))
    spare = pool.join(F.broadcast(pool.agg(F.min("tier").alias("tier"))), "tier")
    records = read(spark, d, "parse_result").select("parse_id", "insu_cd")
    without = records.join(own.select("insu_cd").distinct(), "insu_cd", "left_anti").crossJoin(F.broadcast(spare))
    return records.join(own, "insu_cd").select("parse_id", "example_id", F.lit(1).alias("tier")).unionByName(without.select("parse_id", "example_id", "tier"))


@query("""SELECT doc_id, nullif(regexp_extract(text, '(?s)보험기간은\\s*(.*?)\\s*이며', 1), '') AS term FROM documents WHERE text IS NOT NULL""")
def section_between(spark: SparkSession, d: str) -> DataFrame:
    """Text between two marks, both needed."""
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", terms.between(F.col("text"), "보험기간은", "이며").alias("term"))


@query("""SELECT log_id, CAST(date_diff('day', CAST(created_at AS DATE), CAST(verified_at AS DATE)) AS INT) AS days FROM (SELECT DISTINCT ON (log_id) * FROM correction_log) WHERE verified_at IS NOT NULL""")
def days_between(spark: SparkSession, d: str) -> DataFrame:
    """Calendar days from a correction to its verification."""
    return read(spark, d, "correction_log").dropDuplicates(["log_id"]).filter("verified_at IS NOT NULL").select("log_id", F.datediff(F.col("verified_at").cast("date"), F.col("created_at").cast("date")).alias("days"))


@query("""SELECT insu_cd, substr(string_agg(example_id || ': ' || coalesce(output_pay_term, '-'), chr(10) ORDER BY example_id), 1, 500) AS prompt FROM (SELECT DISTINCT ON (example_id) * FROM few_shot_example) WHERE insu_cd IS NOT NULL GROUP BY 1""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """Examples of a code rendered line by line and cut to 500 characters; only the smallest ids that can show up are kept while aggregating."""
    e = read(spark, d, "few_shot_example").filter("insu_cd IS NOT NULL").dropDuplicates(["example_id"])
    first = R.top_per_key(e.select("insu_cd", "example_id", "output_pay_term"), ["insu_cd"], [F.col("example_id")], 250)  # a line has two characters at least
    row = F.struct("example_id", F.concat(F.col("example_id").cast("string"), F.lit(": "), F.coalesce("output_pay_term", F.lit("-"))).alias("line"))
    return first.groupBy("insu_cd").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n"), 1, 500).alias("prompt"))
