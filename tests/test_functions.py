from pyspark.sql import functions as F

from daram.functions import numbers, terms, text
from daram.operators import codes, extraction, relational, sections


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_terms(spark):
    x = F.col("x")
    cases = [
        (terms.term_to_int(x, F.lit(15)), "종신", 999), (terms.term_to_int(x, F.lit(15)), "90세만기", 75), (terms.term_to_int(x, F.lit(15)), "30세만기", 30), (terms.term_to_int(x, F.lit(75)), "70세만기", None),
        (terms.term_to_int(x, F.lit(15)), "10년만기", 10), (terms.term_to_int(x), "—", None), (terms.pay_term_to_int(x), "월납(10년납)", 10), (terms.pay_term_to_int(x), "전기납", 1), (terms.pay_term_to_int(x), "일시납", 1),
        (terms.pay_term_to_int(x), "월납", 0), (terms.pay_term_to_int(x, F.lit(20)), "전기납", 20), (terms.pay_term_to_int(x), "20년납", 20), (terms.join_code(x), "79 5 25", "79 5 25"), (terms.join_code(x), "795 25", "79525"),
        (terms.join_code(x), "79 525", "79525"), (terms.join_code(x), "7 9 5 2 5", "79525"), (terms.renewal(x), "비갱신형", "비갱신형"), (terms.renewal(x), "갱신형 특약", "갱신형"), (terms.inner_pay_term(x), "월납(10년납)", "10년납"),
        (terms.inner_pay_term(x), None, "—"), (terms.gender_age(x, "남"), "10년납(남:만15세~80세,여:15~70)", "15~80"), (terms.code_of_file(x), "UW21239.pdf", "21239"), (terms.code_of_file(x), "x.pdf", None),
        (terms.age_for_pay_term(x, F.lit("10년납")), "5년납(남:1~2), 10년납(남:15~80,여:15~70)", "남:15~80,여:15~70"), (terms.age_for_pay_term(x, F.lit("10년납")), "15~80", "15~80"), (terms.comma_list(x), " a, ,b,— ", ["a", "b"]),
        (terms.comma_list(x), None, []), (terms.codes(x), "코드21686은 1234567, 21686", ["21686"]), (terms.normal_title(x), "(무)참 이든[A] 3N5!", "참이든3n5"), (text.spelling(x), "３ 0​1\t86", "30186"),
    ]
    for column, value, wanted in cases:
        assert one(spark, value, "string", column) == wanted, (value, wanted)


def test_extraction(spark):
    x = F.col("x")
    for column, value, wanted in [
        (terms.between(x, "시작", "끝"), "a 시작\n b \n끝 끝", "b"), (terms.between(x, "시작", "끝"), "시작 b", None), (terms.bare_years(x), "10년, 20년납 2024년 10년 30년", [10, 30]),
        (terms.trailing_codes(x, 4), "이름 11111 22222 33333 44444 ", ["11111", "22222", "33333", "44444"]), (terms.trailing_codes(x, 4), "이름 11111", None),
        (terms.alias_match(x, F.lit("(무)암 보험"), [["암", "cancer"]]), "Cancer plan", True), (terms.alias_match(x, F.lit("상해"), [["암", "cancer"]]), "Cancer", False),
        (terms.date_or_default(x, F.lit("2024-01-31").cast("date"), 30).cast("string"), "2024-05-06T01:02", "2024-05-06"), (terms.date_or_default(x, F.lit("2024-01-31").cast("date"), 30).cast("string"), "", "2024-01-01"),
    ]:
        assert one(spark, value, "string", column) == wanted, (value, wanted)
    score, reasons = extraction.rule_score({"a": (x == "1", 30), "b": (x.isNotNull(), 80)})
    assert one(spark, None, "string", F.struct(score, reasons)) == (0, "a,b") and one(spark, "1", "string", F.struct(score, reasons)) == (100, "")
    assert one(spark, "—", "string", extraction.resolve([("p", x), ("q", F.lit("v"))])) == ("v", "q")


def test_numbers(spark):
    for n, d, wanted in [(25, 2, 13), (249, 20, 12), (24, 2, 12), (1, 0, None)]:
        assert spark.range(1).select(numbers.half_up(F.lit(n).cast("bigint"), F.lit(d).cast("bigint")).alias("y")).first()["y"] == wanted
    for amount, wanted in [(150_000_000, "1억 5000만원"), (100_000_000, "1억원"), (30_000, "3만원"), (500, "500원"), (None, None)]:
        assert one(spark, amount, "bigint", numbers.money_display(F.col("x"))) == wanted
    for value, wanted in [("3,500만원", 35_000_000), ("9억원", 900_000_000), ("67,000,000원", 67_000_000), ("없음", None)]:
        assert one(spark, value, "string", numbers.won(F.col("x"))) == wanted
    for value, wanted in [(60, "60세이하"), (61, "61~65세"), (66, "66세이상")]:
        assert one(spark, value, "int", numbers.band(F.col("x"), [60, 65], "세")) == wanted


def test_votes_and_lines(spark):
    for a, b, c, wanted in [("a", "a", "b", "a"), ("a", "b", "b", "b"), ("a", "longer", "c", "longer"), ("a", None, "longer", "longer"), ("a", "b", "c", "a")]:
        df = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
        assert df.select(relational.three_way_vote(*map(F.col, "abc")).alias("y")).first()["y"] == wanted
    rows = spark.createDataFrame([(1, "이름\n12345 끝\n\n다음\n또\n셋\n넷"), (2, None), (3, " \n"), (4, "a\n" * 40_000)], "id int, t string")
    got = sections.combine(rows, "t", ["id"], terms.CODE).orderBy("id", "part_no").collect()
    assert [r.part for r in got if r.id == 1] == ["이름 12345 끝", "다음 또 셋", "넷"] and [r.part_no for r in got if r.id == 1] == [0, 1, 2]
    assert {r.id for r in got} == {1, 4} and sum(r.id == 4 for r in got) == 13_334
    assert sections.sections(spark.createDataFrame([(1, "[A]\n" + "a\n" * 40_000)], "id int, t string"), "t", r"^\[(\w)\]", ["id"]).count() == 40_001
    df = spark.createDataFrame([(1, "x\n[A] h\na\n[B] h\nb\r\nc"), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.section, r.line) for r in sections.sections(df, "t", r"^\[(\w)\]", ["id"]).orderBy("id", "line_no").collect()] == [(1, "A", "a"), (1, "B", "b"), (1, "B", "c")]


def test_blank(spark):
    values = [None, "", " \t", "　 ", "-", " — ", "--", "a", "0"]
    df = spark.createDataFrame([(v,) for v in values], "x string").select(text.is_blank(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [True] * 6 + [False] * 3


def test_few_shot_tiers(spark, tmp_path):
    from daram.plans import text

    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    got = lambda: sorted((r.parse_id, r.example_id, r.tier) for r in text.few_shot_tiers(spark, str(tmp_path)).collect())
    put("few_shot_example", [("10000", 1, True), ("10000", 1, True), ("20000", 2, True), ("30000", 3, False)], "insu_cd string, example_id bigint, is_active boolean")
    put("parse_result", [(1, "10000"), (2, "30000"), (3, None)], "parse_id bigint, insu_cd string")
    put("uw_code_mapping", [("2 0 0 0 0", "주계약", None), (None, "주계약", None), ("10000", "선택특약", "X")], "code string, product_group string, class_tag string")
    assert got() == [(1, 1, 1), (2, 2, 2), (3, 2, 2)]
    put("uw_code_mapping", [("30000", None, "MAIN")], "code string, product_group string, class_tag string")
    assert got() == [(1, 1, 1), (2, 1, 3), (2, 2, 3), (3, 1, 3), (3, 2, 3)]


def test_terms_all_forms(spark, tmp_path):
    from daram.plans import text

    rows = [(1, "월납 연납 12회납 10 년 납 10년납 60세납 전기납 일시납; 평생 종신 80세까지 90세 종료 10 년 만기 100세만기; 만 15세 ~ 80세 15~80 0~70"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in text.terms_all_forms(spark, str(tmp_path)).collect()}
    split = lambda x: set(x.split(","))
    assert split(got[1].pay) == {"월납", "연납", "12회납", "10년납", "60세납", "전기납", "일시납"}
    assert split(got[1].insu) == {"평생", "종신", "80세까지", "90세종료", "10년만기", "100세만기"} and split(got[1].ages) == {"15~80", "0~70"}
    assert (got[2].pay, got[2].insu, got[2].ages) == ("", "", "") and len(got) == 2


def test_code_tables(spark):
    text = "특약 이름\n(무)참든든보장 12345 54321\n(무)갱신형 특약(갱신형) 22222\n할증특약 33333\n새이름 12345\n끝"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = {r.code: r.name for r in codes.code_table(df, "t", ["id"]).collect()}
    assert got == {"12345": "새이름", "54321": "특약 이름 (무)참든든보장"}
    assert codes.code_table(df, "t", ["id"], drop=()).count() == 4
    x = F.col("x")
    rows = lambda v, *names: [tuple(r) for r in one(spark, v, "string", codes.typed_rows(x, names))]
    assert rows("참든든 11111 22222 ", "V2", "표준형") == [("참든든", "V2", None, None, "11111"), ("참든든", "표준형", None, None, "22222")]
    assert rows("암특약(갱신형, 10년) 최초계약 33333", "V2", "표준형") == [("암특약", "갱신형", "최초계약", "10년", "33333")] and rows("암특약 (갱신형) 갱신계약 33333", "a") == [("암특약", "갱신형", "갱신계약", None, "33333")]
    assert rows("이름 11111 22222 33333", "V2", "표준형") == [] and rows("이름", "a") == [] and rows("a 11111 22222 33333 44444", *"abcd")[3][4] == "44444"


def test_json_part_and_hints(spark):
    x = F.col("x")
    for value, wanted in [("log\n{\"a\": 1}\nend", '{"a": 1}'), ('{"a": {"b": 2}}', '{"a": {"b": 2}}'), ('x {no}\n{\n  "a": "}",\n  "b": {}\n}\n\ndone {}', '{\n  "a": "}",\n  "b": {}\n}'), ("no {json}", None), ("", None), (None, None)]:
        assert one(spark, value, "string", terms.json_part(x)) == wanted, value
    for number, hint, wanted in [("3", "(가입단위 : 만)", 30_000), ("5", "1구좌=100만원", 5_000_000), ("5", "구좌", 50_000), ("1,000", "만원", 10_000_000), ("9999", "", 99_990_000), ("10,000", "", 10_000), ("500", "원", 500), ("7", None, 70_000), ("x", "", None)]:
        assert one(spark, number, "string", numbers.won_by_hint(x, F.lit(hint).cast("string"))) == wanted, (number, hint)


def test_layers_and_bands(spark):
    x = F.col("x")
    r = one(spark, "15~80", "string", extraction.layered_score({"a": {"p": (x == "15~80", 30), "q": (F.lit(None).cast("boolean"), 30)}, "b": {"r": (x.isNotNull(), 40)}}, 90, 70))
    assert tuple(r) == (70, "WARNING", "a.q", 30, 40)
    for value, wanted in [("15~80", True), ("80~15", False), ("1~130", False), ("15~80, 20~19", False), ("", True), (None, False), ("0~99999999999", False)]:
        assert one(spark, value, "string", extraction.ages_in_order(x)) is wanted, value
    for value, wanted in [(None, 0), (5, 0), (10, 1), (20, 3), (99, 5)]:
        assert one(spark, value, "int", extraction.steps(x, [(50, 5), (10, 1), (20, 3)])) == wanted
    assert [one(spark, v, "int", extraction.grade(x, [(90, "S"), (50, "D")], "F")) for v in (95, 90, 60, 1, None)] == ["S", "S", "D", "F", "F"]
    found = lambda *fields: extraction.share_found([F.lit(f).cast("string") for f in fields], x)
    for value, fields, wanted in [("10년납 종신", ("종신", "5년납"), True), ("10년납", ("종신", "5년납"), False), ("", ("a",), True), (None, ("a",), True), ("z", (None, "—"), True), ("b", ("a, b",), True)]:
        assert one(spark, value, "string", found(*fields)) is wanted, (value, fields)


def test_long_runs(spark, tmp_path):
    """Long runs of digits, syllables, blanks and lines take no more than in proportion to them."""
    import time

    from daram.plans import core

    rows = [(i, t, "1") for i, t in enumerate(["1" * 60_000, "1," * 30_000, "가" * 60_000 + "한도", " " * 60_000, "1 " * 30_000, "가\n" * 30_000, "4.\n" * 30_000, "10년납" * 15_000, "," * 60_000, "(무)" * 20_000, "\n" * 60_000])]
    spark.createDataFrame(rows, "doc_id bigint, text string, insu_cd string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("code_extract", "terms_extract", "terms_all_forms", "labelled_terms", "limit_rows", "limit_cascade", "won_parse", "bare_years", "three_sections", "section_split", "lines_combined", "code_lines", "code_table", "names_of_codes", "find_section", "amount_by_hint"):
        began = time.time()
        core.queries()[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
        assert time.time() - began < 10, name
