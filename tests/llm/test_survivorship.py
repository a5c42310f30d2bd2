import datetime as dt

import compare
from pyspark.sql import functions as F

from daram.llm import queries
from daram.llm import survivorship as S

FOLDER = "/root/testdata/sf0.001"
DDL = "map_id bigint, src_file string, code string, product_name string, main_code string, period_label string, period_value int, pay_term string, entry_age_m string, entry_age_f string, product_group string, type_label string, period_kind string, class_tag string, load_channel string, loaded_at timestamp_ntz, trust int, given int"


def row(i, code="30001", label="10년만기", channel="a", day=1, **k):
    base = dict.fromkeys(S.FIELDS) | {"code": code, "period_label": label} | k
    return (i, base["src_file"], base["code"], base["product_name"], base["main_code"], base["period_label"], base["period_value"], base["pay_term"], base["entry_age_m"], base["entry_age_f"], base["product_group"], base["type_label"], base["period_kind"], base["class_tag"], channel, dt.datetime(2024, 1, day) if day else None, 1, 2)


def survivors(spark, rows):
    trust = spark.createDataFrame([("a", 10), ("b", 20), ("b", 20)], "load_channel string, trust_rank int")
    return S.survive(S.prepare(spark.createDataFrame(rows, DDL), trust)).orderBy("group_id").collect()


def test_best_row(spark):
    got = survivors(spark, [
        row(1), row(2, code=" 3000​1", label="만기 １０년", day=2, pay_term="x"),  # 2 beats 1 everywhere
        row(3, code="2"), row(4, code="2"),  # exact copies
        row(5, code="3", day=2), row(6, code="3", pay_term="x"),  # neither beats the other
        row(7, code="4", channel=None, day=None), row(8, code="4", channel="b", day=None),
        row(9, code="5"), row(10, code=None), row(11, code="—"), row(12, code="6", label=None), row(13, code="6", label=" ", period_kind="N"),
        row(14, code="7", label=None, period_kind="E"), row(15, code="7", label="종신", day=3), row(16, code="7", label="평생", day=3, pay_term="-"),
    ])
    assert {r.group_id: (r.n_rows, r.best_id) for r in got} == {1: (2, 2), 3: (2, None), 5: (2, None), 7: (2, 8), 9: (1, None), 14: (3, None)}


def test_fields(spark):
    r = survivors(spark, [row(1, channel="b", pay_term=" ", entry_age_m="old"), row(2, channel="a", day=5, pay_term="p", entry_age_m="low"), row(3, channel="b", day=2, entry_age_m="new", product_name="z" * 100_000), row(4, channel="b", day=2, entry_age_m="mew")])[0]
    assert (r.pay_term, r.entry_age_m, r.class_tag, len(r.product_name)) == ("p", "new", None, 100_000)
    assert survivors(spark, []) == []


def test_heavy_groups(spark):
    """A group of a third of the rows is spread over salts and comes out as one, as without the split."""
    rows = [row(i, code="hot", day=1 + i % 28, pay_term=f"p{i % 7}" if i % 3 else "-", channel="ab"[i % 2]) for i in range(1, 301)] + [row(1000 + i, code=str(i), day=2, pay_term="x") for i in range(600)]
    trust = spark.createDataFrame([("a", 10), ("b", 20)], "load_channel string, trust_rank int")
    prepared = S.prepare(spark.createDataFrame(rows, DDL), trust)
    got = [sorted(map(str, S.survive(prepared, heavy_share=h).collect())) for h in (0.1, 2.0, 0.0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 601


def test_periods(spark):
    cases = [("10년만기", None, None, "N10"), ("갱신형(10년)", None, None, "R10"), ("1년마다 갱신", None, None, "R1"), ("100세까지", None, None, "S100"), ("종신 보장", None, None, "E999"), (None, "S", 80, "S80"), ("-", "e", None, "E999"), ("", None, 999, "E999"), (None, "N", None, None), ("기타", "N", 5, "?기타")]
    df = spark.createDataFrame(cases, "l string, k string, v int, w string").select(S.period_key(F.col("l"), F.col("k"), F.col("v")).alias("p"), "w")
    assert [r.p for r in df.collect()] == [c[3] for c in cases]


def test_against_sql(spark):
    con = compare.tables(FOLDER)
    for name in ("p2_found", "p2_survivors"):
        assert compare.rows(queries.queries()[name](spark, FOLDER).toPandas()) == compare.rows(con.execute(queries.oracle_sql()[name]).df())
