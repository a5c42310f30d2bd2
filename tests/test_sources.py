import json

from pyspark.sql import functions as F

from daram.operators import relational, state
from daram.sources import documents as D
from daram.sources.tables import SCHEMAS, empty_as_null, read_jdbc
from daram.streaming import learning


def test_texts(spark, tmp_path):
    (tmp_path / "UW21239.txt").write_bytes("보험\r\n기간\x0c둘".encode("euc-kr"))
    (tmp_path / "b.txt").write_bytes(b"x")
    rows = {r.name: r for r in D.read_texts(spark, str(tmp_path), encoding="EUC-KR").collect()}
    assert rows["UW21239.txt"].text == "보험\n기간\x0c둘" and rows["UW21239.txt"].code == "21239" and rows["b.txt"].code is None and rows["b.txt"].text == "x"
    assert sorted((r.page, r.text) for r in D.pages(D.read_texts(spark, str(tmp_path), "UW*", "EUC-KR")).collect()) == [(1, "보험\n기간"), (2, "둘")]
    (tmp_path / "A.PDF").write_bytes(b"%PDF")
    assert [r.name for r in D.list_files(spark, str(tmp_path)).collect()] == ["A.PDF"]


def test_mapping_csv(spark, tmp_path):
    path = str(tmp_path / "m")
    row = ('30001', '이름, "둘"', None, "", "30001", "10년만기", 10, "N", "5년납, 7년납", None, None, "MAIN", "UW1")
    df = spark.createDataFrame([row], D.CSV_SCHEMA)
    D.write_mapping_csv(df, path)
    got = D.read_mapping_csv(spark, path).first()
    assert got.malformed is None and got.product_name == '이름, "둘"' and got.pay_term == "5년납, 7년납" and got.period_value == 10 and got.entry_age_m is None


def test_malformed_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(D.CSV_HEADER + "\n30001,a,,,30001,10년만기,ten,N,x,y,z,M,UW1\n30002,b\n", encoding="utf-8")
    got = {r.code: r for r in D.read_mapping_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert got["30001"].period_value is None and got["30001"].product_name == "a" and got["30001"].malformed.startswith("30001,a") and got["30002"].malformed == "30002,b" and len(got) == 2


def test_json(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"1": {"insuTerm": "종신", "payTerm": "x"}, "2": {"renew": "r"}}, ensure_ascii=False), encoding="utf-8")
    assert {r.code: (r.insuTerm, r.renew) for r in D.read_overrides(spark, str(path)).collect()} == {"1": ("종신", None), "2": (None, "r")}
    out = str(tmp_path / "out")
    D.write_results(spark.createDataFrame([("1", "a"), ("2", "b")], "insu_cd string, t string"), out)
    assert spark.read.json(out).count() == 2
    df = spark.createDataFrame([("ab", "abcd"), ("ab", "abc")], "a string, b string")
    assert [r.x for r in df.select(D.longer_text("a", "b").alias("x")).collect()] == ["abcd", "ab"]


def test_merge(spark):
    t = spark.createDataFrame([("a", 1, "keep"), ("b", 2, "keep")], "k string, v int, w string")
    s = spark.createDataFrame([("b", 5), ("c", 7), ("c", 9)], "k string, v int")
    one = state.one_per_key(s, ["k"], [F.col("v")])
    got = state.merge(t, one, ["k"], update={"v": F.col("t.v") + F.col("s.v")}, insert={"v": F.col("s.v")})
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, "keep"), ("b", 7, "keep"), ("c", 9, None)]


def test_delete_update_batches(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", None), (2, "b", None), (None, "c", None), (2, "d", "x")], "k int, v string, w string")
    keys = spark.createDataFrame([(2,), (2,), (None,)], "k int")
    assert sorted(r.v for r in state.delete(t, keys, ["k"]).collect()) == ["a", "c"]
    assert state.truncate(t).count() == 0 and state.truncate(t).schema == t.schema
    got = state.update(t, spark.createDataFrame([(2, "new")], "k int, n string"), ["k"], {"w": F.col("s.n")}).collect()
    assert sorted((str(r.k), r.v, r.w) for r in got) == [("1", "a", None), ("2", "b", "new"), ("2", "d", "new"), ("None", "c", None)]
    assert sorted((r.rule, r.key, r.n) for r in state.violations(t, [["k"], ["v"]], ["k", "v"]).collect()) == [("required k", None, 1), ("unique k", '{"k":2}', 2)]
    rows = spark.createDataFrame([("a", i, i // 4) for i in range(25)] + [("b", i, None) for i in range(9)] + [(None, i, 0) for i in range(10)], "k string, at int, part int")
    got = state.full_batches(rows, ["k"], F.col("part"), [F.col("at")], 10).collect()
    assert sorted((str(r.k), r.at, r.batch_no) for r in got) == [("None", i, 0) for i in range(10)] + [("a", i, i // 10) for i in range(20)]
    D.write_statistics(t, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "csv")).count() == spark.read.json(str(tmp_path / "s" / "json")).count() == 4


def test_fold_in_batches(spark):
    rows = [(i % 7, f"v{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, value string, at int")
    fold = lambda part: state.fold_patterns(part, ["k"], "value", [F.col("at")])
    whole = fold(df)
    parts = state.merge_fold(fold(df.filter("at < 20")), fold(df.filter("at >= 20")), ["k"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_insert_missing(spark):
    table = spark.createDataFrame([(5, "a"), (9, "b")], "id bigint, name string")
    new = spark.createDataFrame([("a", 1), ("c", 2), ("d", 3), ("c", 4), (None, 5)], "name string, x int")
    got = relational.insert_missing(table, new, "name", "id").collect()
    assert sorted(r.name for r in got) == ["c", "d"] and sorted(r.id for r in got) == [10, 11]


LOG = "log_id bigint, insu_cd string, original struct<insuTerm:string,payTerm:string,ageRange:string,renew:string>, corrected struct<insuTerm:string,payTerm:string,ageRange:string,renew:string>, created_at timestamp_ntz"


def test_stream(spark, tmp_path):
    import datetime as dt

    for i in range(5):
        rows = [(n, f"c{n % 3}", ("a", "b", None, None), (f"t{n}", "b", None, "r"), dt.datetime(2024, 1, 1 + i)) for n in (i, i + 1)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    got = learning.scored(learning.learn(spark, str(tmp_path / "log"), f"file://{tmp_path}/state", files_per_batch=1)).collect()
    assert {(r.insu_cd, r.field_name): (r.pattern_value, r.apply_count) for r in got if r.field_name == "insuTerm"} == {("c0", "insuTerm"): ("t3", 1), ("c1", "insuTerm"): ("t4", 1), ("c2", "insuTerm"): ("t5", 1)}


def test_shared_dir(spark, monkeypatch):
    """A cluster without a shared folder is an error; stored tables go when they are released."""
    import pytest

    from daram import session

    df = session.store(spark.range(5))
    assert df.count() == 5 and df.inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir"))
    session.release(spark)
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        df.count()

    class Nothing:
        def __getattr__(self, name):
            return lambda *_: self if name != "isEmpty" else True

    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("X", (), {"master": "spark://x:7077", "_jsc": Nothing()})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare)
    Bare.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare)


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([(i, "c", None, None, None) for i in range(3)], LOG).withColumn("created_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.col("log_id") * 9))
    rows.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "w")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    q = learning.windowed_counts(stream).writeStream.format("memory").queryName("wc").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wc").count() == 3


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(20).selectExpr("id", "cast(id as string) s").write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = read_jdbc(spark, url, "t", "id", (0, 20), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.filter("id > 4").count() == 15


def test_empty_as_null(spark):
    df = spark.createDataFrame([("", 1), ("a", None)], "`a.b` string, n int")
    assert [tuple(r) for r in empty_as_null(df).collect()] == [(None, 1), ("a", None)]
    for ddl in SCHEMAS.values():
        assert spark.createDataFrame([], ddl).count() == 0
