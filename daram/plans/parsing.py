"""Queries of parsers: code tables, sections, terms by label, amounts, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.functions import numbers, terms
from daram.operators import codes, sections
from daram.operators import extraction as X
from daram.plans.registry import query
from daram.plans.text import LINES
from daram.session import read

def _runs(pattern: str) -> str:
    """A pattern whose numbers are whole runs of digits (and commas): a search never starts inside one, which finds the same and costs no more than the length of the run."""
    return pattern.replace("[0-9][0-9,]*", "(?<![0-9])(?<![0-9],)[0-9][0-9,]*+").replace("[0-9]+", "(?<![0-9])[0-9]++")


_FIVE = "list_filter(regexp_extract_all({0}, '[0-9]+'), lambda x: length(x) = 5)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("text IS NOT NULL")


@query(LINES + f""", kept AS (SELECT * FROM parts WHERE NOT regexp_matches(part, '갱신(계약|형|\\)|\\])') AND NOT regexp_matches(lower(part), '지정대리청구서비스특약|특정신체부위질병보장제한부인수특약|할증특약|제도성특약')),
    toks AS (SELECT doc_id, part_no, unnest(list_distinct({_FIVE.format('part')})) AS code, part FROM kept)
    SELECT doc_id, code, count(*) AS n_lines, max(part_no) AS last_part FROM toks GROUP BY 1, 2""")
def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """Codes of lines that are neither renewal contracts nor institutional riders, with how often and where last they are named."""
    parts = sections.combine(_texts(spark, d), "text", ["doc_id"], terms.CODE).filter(~codes.is_renewal(F.col("part")) & ~codes.is_institutional(F.col("part")))
    return parts.select("doc_id", "part_no", F.explode(terms.codes(F.col("part"))).alias("code")).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n_lines"), F.max("part_no").alias("last_part"))


@query("""WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS n FROM (SELECT doc_id, string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
    c AS (SELECT doc_id, n, line, regexp_extract(line, '^(\\(무\\)[가-힣A-Za-zⅡ]+) ?\\(([0-9]{5})\\)', 2) AS code, regexp_extract(line, '^(\\(무\\)[가-힣A-Za-zⅡ]+) ?\\(([0-9]{5})\\)', 1) AS name FROM l WHERE NOT regexp_matches(line, '갱신(계약|형|\\)|\\])'))
    SELECT doc_id, code, arg_max(name, n) AS name FROM c WHERE code <> '' GROUP BY 1, 2""")
def code_table(spark: SparkSession, d: str) -> DataFrame:
    """Names with their codes at the beginning of lines; renewal lines are left out, the last naming of a code counts."""
    lines = _texts(spark, d).select("doc_id", F.posexplode(sections.lines(F.col("text"))).alias("n", "line")).filter(~codes.is_renewal(F.col("line")))
    part = lambda i: F.regexp_extract("line", r"^(\(무\)[가-힣A-Za-zⅡ]+) ?\(([0-9]{5})\)", i)
    return lines.filter(part(2) != "").groupBy("doc_id", part(2).alias("code")).agg(F.max_by(part(1), "n").alias("name"))


_ROW = "product_name || ' ' || code || ' ' || main_code"


@query(f"""WITH l AS (SELECT map_id, regexp_extract({_ROW}, '^(.*?)((?:\\s+[0-9]{{5}}){{2}})\\s*$', 1) AS name, string_split_regex(trim(regexp_extract({_ROW}, '((?:\\s+[0-9]{{5}}){{2}})\\s*$', 1)), '\\s+') AS c FROM uw_code_mapping)
    SELECT map_id, trim(name) AS name, v AS variant, c[i] AS code FROM l, (VALUES (1, 'V2'), (2, '표준형')) t(i, v) WHERE len(c) = 2 AND trim(name) <> '' AND NOT regexp_matches(trim(name), '[0-9]$')""")
def typed_code_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end in two codes to one row per code with its variant; here a line is a product's name, its code and its main code."""
    line = F.concat("product_name", F.lit(" "), "code", F.lit(" "), "main_code")
    rows = read(spark, d, "uw_code_mapping").select("map_id", F.explode(codes.typed_rows(line, ("V2", "표준형"))).alias("r"))
    return rows.select("map_id", "r.name", "r.variant", "r.code")


@query(r"""WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS n FROM (SELECT doc_id, string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
    h AS (SELECT *, nullif(regexp_extract(line, '^\s*([345])\.', 1), '') AS head FROM l),
    s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM h)
    SELECT doc_id, section, string_agg(line, chr(10) ORDER BY n) AS block, count(*) AS n_lines FROM s WHERE head IS NULL AND section IS NOT NULL GROUP BY 1, 2""")
def three_sections(spark: SparkSession, d: str) -> DataFrame:
    """Blocks 3, 4 and 5 of a document: a line that starts with the number and a stop opens its block, also a second time."""
    rows = sections.sections(_texts(spark, d), "text", r"^\s*([345])\.", ["doc_id"])
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "section").agg(block.alias("block"), F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[0-9]{1,4}년납?'), lambda x: NOT contains(x, '납')), lambda x: CAST(replace(x, '년', '') AS INT)), lambda n: n <= 50))), ',') AS years FROM documents WHERE text IS NOT NULL""")
def bare_years(spark: SparkSession, d: str) -> DataFrame:
    """Years that are no payment terms, up to 50, in order."""
    return _texts(spark, d).select("doc_id", F.array_join(F.array_sort(terms.bare_years(F.col("text"))).cast("array<string>"), ",").alias("years"))


_INSU, _PAY, _AGE = "(종신|[0-9]+세만기|[0-9]+년만기)", "([0-9]+[년세]납|전기납|일시납)", "(만? ?[0-9]+세? ?~ ?만? ?[0-9]+세?)"
_LABELS = {"insu_term": (("보험기간[은:이 ]*", _INSU), ("", _INSU)), "pay_term": (("납입기간[은:이 ]*", _PAY), ("", _PAY)), "age_range": (("가입나이[는은:이 ]*", _AGE), ("", _AGE))}


@query("SELECT doc_id, " + ", ".join(f"coalesce({', '.join(f'''nullif(regexp_extract(text, '{a}{b}', 1), '')''' for a, b in ways)}, '—') AS {n}" for n, ways in _LABELS.items()) + ", CASE WHEN contains(text, '비갱신') THEN '비갱신형' WHEN contains(text, '갱신') THEN '갱신형' ELSE '비갱신형' END AS renew FROM documents WHERE text IS NOT NULL")
def labelled_terms(spark: SparkSession, d: str) -> DataFrame:
    """First term behind its label, else the first anywhere in the text, else a dash; non-renewal is the default."""
    first = lambda ways: F.coalesce(*(F.nullif(F.regexp_extract("text", _runs(a + b), 1), F.lit("")) for a, b in ways), F.lit("—"))
    return _texts(spark, d).select("doc_id", *(first(w).alias(n) for n, w in _LABELS.items()), terms.renewal(F.col("text"), "비갱신형").alias("renew"))


@query("""WITH n AS (SELECT code, max(product_name) AS name FROM uw_code_mapping WHERE code IS NOT NULL AND length(product_name) >= 5 GROUP BY 1),
    w AS (SELECT doc_id, name, substr(text, greatest(1, strpos(text, name) - 200), 700 + length(name)) AS near FROM documents JOIN n ON code = insu_cd WHERE text IS NOT NULL AND contains(text, name))
    SELECT doc_id, name, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(near, '[0-9]+[년세]납|전기납|일시납'))), ','), '') AS pay, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(near, '종신|[0-9]+[세년]만기'))), ','), '') AS insu FROM w""")
def terms_near_name(spark: SparkSession, d: str) -> DataFrame:
    """Terms within 200 characters before and 500 behind the first naming of the document's product."""
    names = read(spark, d, "uw_code_mapping").filter(F.col("code").isNotNull() & (F.length("product_name") >= 5)).groupBy("code").agg(F.max("product_name").alias("name"))
    rows = _texts(spark, d).join(names, F.col("code") == F.col("insu_cd")).filter(F.contains("text", F.col("name")))
    at = F.call_function("instr", F.col("text"), F.col("name"))
    near = F.call_function("substring", F.col("text"), F.greatest(F.lit(1), at - 200), F.length("name") + 700)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("doc_id", "name", near.alias("near")).select("doc_id", "name", joined(terms.pay_terms(F.col("near"))).alias("pay"), joined(terms.insurance_terms(F.col("near"))).alias("insu"))


@query(r"""WITH t AS (SELECT rec_id, 'INFO start' || chr(10) || payload || chr(10) || 'done {}' AS out FROM hybrid_result WHERE payload IS NOT NULL)
    SELECT rec_id, json_extract_string(regexp_extract(out, '(?s)\n(\{.*\})\ndone', 1), '$.insuCd') AS insu_cd FROM t""")
def json_in_noise(spark: SparkSession, d: str) -> DataFrame:
    """A JSON record within other output: from the first line that starts with a brace to the last line that ends with one before what follows; here log lines stand around each payload."""
    out = F.concat(F.lit("INFO start\n"), "payload", F.lit("\ndone {}"))
    return read(spark, d, "hybrid_result").filter("payload IS NOT NULL").select("rec_id", F.get_json_object(terms.json_part(out), "$.insuCd").alias("insu_cd"))


@query(r"""WITH m AS (SELECT doc_id, replace(regexp_extract(text, '([0-9][0-9,]*) ?(구좌|만원|원|%)', 1), ',', '') AS v, regexp_extract(text, '([0-9][0-9,]*) ?(구좌|만원|원|%)', 0) AS hint FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, hint, CASE WHEN contains(hint, '구좌') OR contains(hint, '만원') THEN try_cast(v AS BIGINT) * 10000 WHEN NOT contains(hint, '원') AND try_cast(v AS BIGINT) < 10000 THEN try_cast(v AS BIGINT) * 10000 ELSE try_cast(v AS BIGINT) END AS won FROM m WHERE v <> ''""")
def amount_by_hint(spark: SparkSession, d: str) -> DataFrame:
    """Number of won by what the line around it says of its unit."""
    part = lambda i: F.regexp_extract("text", _runs(r"([0-9][0-9,]*) ?(구좌|만원|원|%)"), i)
    return _texts(spark, d).select("doc_id", part(1).alias("v"), part(0).alias("hint")).filter("v <> ''").select("doc_id", "hint", numbers.won_by_hint(F.col("v"), F.col("hint")).alias("won"))


_LIMIT = "([가-힣]+) ([0-9][0-9,]*) ?(억|천만|백만|만|천)?원"


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_LIMIT}')) AS m FROM documents WHERE contains(text, '한도')),
    v AS (SELECT doc_id, regexp_extract(m, '{_LIMIT}', 1) AS name, try_cast(replace(regexp_extract(m, '{_LIMIT}', 2), ',', '') AS BIGINT) * CASE regexp_extract(m, '{_LIMIT}', 3) WHEN '억' THEN 100000000 WHEN '천만' THEN 10000000 WHEN '백만' THEN 1000000 WHEN '만' THEN 10000 WHEN '천' THEN 1000 ELSE 1 END AS won FROM m)
    SELECT doc_id, name, min(won) AS min_won, max(won) AS max_won, count(*) AS n FROM v GROUP BY 1, 2""")
def limit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Named amounts of documents that speak of limits, with the smallest and greatest of each name."""
    whole = _LIMIT.replace("([가-힣]+)", "(?<![가-힣])([가-힣]++)")  # a search never starts inside a run of syllables
    found = read(spark, d, "documents").filter(F.contains("text", F.lit("한도"))).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("m"))
    return found.select("doc_id", F.regexp_extract("m", whole, 1).alias("name"), numbers.won(F.col("m")).alias("won")).groupBy("doc_id", "name").agg(F.min("won").alias("min_won"), F.max("won").alias("max_won"), F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT doc_id, text, regexp_extract(text, '합산 한도[^.0-9]*([0-9][0-9,]*) ?(억|천만|백만|만|천)?원', 0) AS a, regexp_extract(text, '최대 ?([0-9][0-9,]*) ?(억|천만|백만|만|천)?원', 0) AS b, regexp_extract(text, '([0-9][0-9,]*) ?(억|천만|백만|만|천)?원까지', 0) AS c FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, CASE WHEN a <> '' THEN 'sum' WHEN b <> '' THEN 'most' WHEN c <> '' THEN 'up_to' ELSE 'none' END AS source, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) AS m FROM v)
    SELECT doc_id, source, try_cast(replace(regexp_extract(m, '([0-9][0-9,]*) ?(억|천만|백만|만|천)?원', 1), ',', '') AS BIGINT) * CASE regexp_extract(m, '([0-9][0-9,]*) ?(억|천만|백만|만|천)?원', 2) WHEN '억' THEN 100000000 WHEN '천만' THEN 10000000 WHEN '백만' THEN 1000000 WHEN '만' THEN 10000 WHEN '천' THEN 1000 ELSE 1 END AS won FROM f""")
def limit_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Limit of a document by the first of several patterns that gives one, with its source."""
    amount = _runs(r"([0-9][0-9,]*) ?(억|천만|백만|만|천)?원")
    ways = {"sum": rf"(합산 한도[^.0-9]*{amount})", "most": rf"(최대 ?{amount})", "up_to": rf"({amount}까지)"}
    found = X.resolve([(n, F.nullif(F.regexp_extract("text", p, 1), F.lit(""))) for n, p in ways.items()])
    return _texts(spark, d).select("doc_id", found.alias("r")).select("doc_id", "r.source", numbers.won(F.col("r.value")).alias("won"))


@query("""SELECT map_id, CASE WHEN contains(pay_term, '일시납') THEN 1 WHEN contains(pay_term, '전기납') THEN 1 WHEN contains(pay_term, '월납') AND NOT regexp_matches(pay_term, '[0-9]') THEN 0 ELSE try_cast(regexp_extract(pay_term, '[0-9]+') AS INT) END AS n FROM uw_code_mapping""")
def pay_term_to_int(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uw_code_mapping").select("map_id", terms.pay_term_to_int(F.col("pay_term")).alias("n"))


_GROUPS = [["암", "cancer"], ["상해", "재해"], ["뇌", "혈관"]]
_NORMAL = "lower(regexp_replace(regexp_replace({0}, '\\(무\\)|\\[[^\\]]*\\]', '', 'g'), '[^가-힣0-9A-Za-z]', '', 'g'))"


@query(f"""WITH p AS (SELECT code, min(product_name) AS a, max(product_name) AS b FROM uw_code_mapping WHERE code IS NOT NULL AND product_name IS NOT NULL GROUP BY 1), n AS (SELECT code, {_NORMAL.format('a')} AS x, {_NORMAL.format('b')} AS y FROM p)
    SELECT code, contains(x, y) OR contains(y, x) OR {' OR '.join(f"(regexp_matches(x, '{'|'.join(g)}') AND regexp_matches(y, '{'|'.join(g)}'))" for g in _GROUPS)} AS same FROM n""")
def alias_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first and the last name of a code match by containment or by words of the same alias group."""
    p = read(spark, d, "uw_code_mapping").filter(F.col("code").isNotNull() & F.col("product_name").isNotNull()).groupBy("code").agg(F.min("product_name").alias("a"), F.max("product_name").alias("b"))
    return p.select("code", terms.alias_match(F.col("a"), F.col("b"), _GROUPS).alias("same"))


@query("""SELECT parse_id, CAST(coalesce(try_cast(regexp_extract(error, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE), DATE '2024-01-31' - 30) AS VARCHAR) AS day FROM parse_result""")
def date_or_default(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "parse_result").select("parse_id", terms.date_or_default(F.col("error"), F.lit("2024-01-31").cast("date"), 30).cast("string").alias("day"))


_SECTION = ("(?s)\\n[ \\t]*4\\.(.{100,}?)\\n[ \\t]*5\\.", "(?s)\\n[ \\t]*4\\.(.{100,})$", "(?s)보험기간(.{100,}?)가입한도")
_ROWS = ("([^\\n]*[0-9]년납[^\\n]*\\n[^\\n]*[0-9]년납[^\\n]*)", "([^\\n]{15,}[0-9]세만기[^\\n]{15,})")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_extract(text, '{p}', 1) <> '' THEN 'section' || {i}" for i, p in enumerate(_SECTION)) + " " + " ".join(f"WHEN length(regexp_extract(text, '{p}', 1)) > 30 THEN 'rows' || {i}" for i, p in enumerate(_ROWS)) + " ELSE 'whole' END AS found_by, length(CASE "
       + " ".join(f"WHEN regexp_extract(text, '{p}', 1) <> '' THEN regexp_extract(text, '{p}', 1)" for p in _SECTION) + " " + " ".join(f"WHEN length(regexp_extract(text, '{p}', 1)) > 30 THEN regexp_extract(text, '{p}', 1)" for p in _ROWS) + " ELSE text END) AS n_chars FROM documents WHERE text IS NOT NULL")
def find_section(spark: SparkSession, d: str) -> DataFrame:
    """Section 4 of a document by the first pattern that gives a hundred characters, else rows that look like its table, else the whole text."""
    # where a pattern doesn't hold from its first beginning on, it doesn't from any later one: only that is tried
    begins = [F.call_function("regexp_instr", F.col("text"), F.lit(p)) for p in ("\n[ \t]*4\\.", "\n[ \t]*4\\.", "보험기간")]
    tails = [F.when(at > 0, F.call_function("substring", F.col("text"), at)) for at in begins]
    ways = [(f"section{i}", F.nullif(F.regexp_extract(tail, p.replace("(?s)", "(?s)^"), 1), F.lit(""))) for i, (tail, p) in enumerate(zip(tails, _SECTION))]
    has = lambda x: x.rlike("[0-9]년납")
    below = lambda i: F.get("_lines", i + 1)
    first = lambda each: F.get(F.filter(F.transform("_lines", each), lambda x: x.isNotNull()), F.lit(0))
    rows = [first(lambda x, i: F.when(has(x) & has(below(i)), F.concat(x, F.lit("\n"), below(i)))), first(lambda x, i: F.when(x.rlike(f"^{_ROWS[1]}$"), x))]  # line by line, as a pattern over the text would look at a long line again for each of its places
    ways += [(f"rows{i}", F.when(F.length(r) > 30, r)) for i, r in enumerate(rows)]
    found = F.coalesce(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("by"), c.alias("part"))) for n, c in ways), F.struct(F.lit("whole").alias("by"), F.col("text").alias("part")))
    return _texts(spark, d).withColumn("_lines", F.split("text", "\n")).select("doc_id", found.alias("f")).select("doc_id", F.col("f.by").alias("found_by"), F.length("f.part").alias("n_chars"))


_NAME = r"trim(regexp_replace(regexp_replace({0}, '\(?[0-9]{{5,}}\)?', ' ', 'g'), '\s+', ' ', 'g'))"
_GOOD = "length({0}) >= 8 AND regexp_matches({0}, '[가-힣(]')"


@query(rf"""WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS n FROM (SELECT doc_id, string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
    c AS (SELECT doc_id, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS below FROM l),
    k AS (SELECT doc_id, n, unnest(list_distinct({_FIVE.format('line')})) AS code, {_NAME.format('line')} AS same, {_NAME.format('below')} AS below FROM c),
    v AS (SELECT doc_id, code, n, CASE WHEN {_GOOD.format('same')} THEN same WHEN {_GOOD.format('below')} THEN below END AS name, CASE WHEN {_GOOD.format('same')} THEN 'line' WHEN {_GOOD.format('below')} THEN 'below' ELSE 'none' END AS source FROM k)
    SELECT doc_id, code, arg_min(coalesce(name, '—'), n) AS name, arg_min(source, n) AS source FROM v GROUP BY 1, 2""")
def names_of_codes(spark: SparkSession, d: str) -> DataFrame:
    """Name of each code a document gives: what stands in the first line that has the code, if it is long enough and Korean, else the line below."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\(?\d{5,}\)?", " "), r"\s+", " "))
    lines = _texts(spark, d).select("doc_id", F.explode(sections.with_neighbours(F.col("text"), 0, 1)).alias("x")).select("doc_id", "x.line_no", "x.line", F.get("x.around", F.lit(1)).alias("below"))
    good = lambda c: F.when((F.length(c) >= 8) & c.rlike("[가-힣(]"), c)
    rows = lines.select("doc_id", "line_no", F.explode(terms.codes(F.col("line"))).alias("code"), X.resolve([("line", good(bare(F.col("line")))), ("below", good(bare(F.col("below"))))]).alias("r"))
    return rows.groupBy("doc_id", "code").agg(F.min_by(F.coalesce("r.value", F.lit("—")), "line_no").alias("name"), F.min_by("r.source", "line_no").alias("source"))
