"""The general problems on small tables with nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import csv
import datetime as dt
import io
import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daram.operators import drift, nested, orphans, unify
from daram.operators.packed import bare_edges, split_values, unpack
from daram.plans import problems

LINES = "raw_id bigint, feed string, run_no int, file_name string, line_no int, payload string, value string, ix int"


def feed(name, runs, kind="json"):
    rows, n = [], 0
    for run, lines in runs.items():
        for i, p in enumerate(lines):
            n += 1
            rows.append((n, name, run, f"{name}_{run:02}.{kind}", i, p, "clash", 7))
    return rows


def report(spark, rows):
    return {tuple(r) for r in drift.changes(spark.createDataFrame(rows, LINES)).collect()}


def test_drift_json(spark):
    rec = lambda i, **k: json.dumps({"insuCd": str(i), **k}, ensure_ascii=False)
    rows = feed("a_result", {
        1: [rec(i, terms={"insuTerm": f"{i}년", "renew": "x"}, n=i, codes={"1": "q"}) for i in range(5)] + [None, "", "{bad", "[]"],
        3: [rec(i, terms={"insuranceTerm": f"{i}년"}, n=str(i), codes={"2": {"z": 1}}, extra=None) for i in range(5)] * 2,
        4: [rec(i, terms={"insuranceTerm": "y" * 100_000}, n=str(i), flag=True) for i in range(5)],
    })
    rows += [(99, None, 1, None, None, '{"a": 1}', "", 1), (98, "a_result", None, None, None, '{"a": 1}', "", 1)]
    assert report(spark, rows) == {
        ("a_result", 3, "renamed", "terms.insuTerm", "terms.insuranceTerm"), ("a_result", 3, "removed", "terms.renew", ""),
        ("a_result", 3, "retyped", "n", "n"), ("a_result", 4, "added", "", "flag"),
    }


def line(*cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def test_drift_csv(spark):
    rows = feed("b_mapping", {
        1: [line("CODE", "A,B", "V", "W")] + [line(i, f"x,{i}", i, "") for i in range(4)],
        2: [line("V", "CODE", "W", "C")] + [line(f"{i}년", i, "k", f"x,{i}") for i in range(4)],
    }, "csv")
    assert report(spark, rows) == {("b_mapping", 2, "renamed", "A,B", "C"), ("b_mapping", 2, "retyped", "V", "V"), ("b_mapping", 2, "added", "", "W")}


def test_drift_empty(spark):
    empty = spark.createDataFrame([], LINES)
    assert drift.changes(empty).count() == 0 and unify.records(empty, aliases(spark)).count() == 0


def aliases(spark, *rows):
    return spark.createDataFrame([r if len(r) == 4 else (None, *r) for r in rows], "feed string, path string, canonical string, cast string")


AGREED = [("insuCd", "code", "string"), ("CODE", "code", "string"), ("python.terms.payTerm", "pay_term", "string"), ("N", "n", "bigint")]


def test_unify(spark):
    rec = lambda i, **k: json.dumps({"insuCd": str(i), **k})
    rows = feed("c_result", {1: [rec(i, python={"terms": {"payTerm": f"p{i}"}}, ok=True) for i in range(4)], 2: [rec(i, python={"terms": {"pay": f"p{i}"}, "codes": {"01": "x", "02": {"a": 1}}}, ok=False) for i in range(4)]})
    rows += feed("d_mapping", {1: [line("CODE", "PAY_TERM", "N")] + [line(f"0{i}", f"p{i}", "12" if i else "1O") for i in range(2)]}, "csv")
    df = spark.createDataFrame(rows + rows[:1], LINES)
    got = unify.records(df, aliases(spark, *AGREED, ("PAY_TERM", "pay_term", None)))
    assert dict(got.dtypes) == {"feed": "string", "run_no": "int", "line_no": "int", "rec_id": "string", "code": "string", "n": "bigint", "ok": "boolean", "pay_term": "string", "codes": "map<string,string>", "unread": "map<string,string>"}
    got = got.collect()
    assert len(got) == 10 and sorted(r.code for r in got if r.feed == "d_mapping") == ["00", "01"]
    assert sorted((r.run_no, r.pay_term) for r in got if r.feed == "c_result") == [(n, f"p{i}") for n in (1, 2) for i in range(4)]
    assert {r.ok for r in got if r.run_no == 2} == {False} and all(r.codes == {"python.codes.01": "x", "python.codes.02": '{"a": 1}'} for r in got if r.run_no == 2)
    assert {r.code: (r.n, r.unread) for r in got if r.feed == "d_mapping"} == {"00": (None, {"n": "1O"}), "01": (12, {})}
    one = unify.names(df, aliases(spark, ("d_mapping", "CODE", "key", "string"), ("CODE", "code", "string"))).collect()
    assert {(r.path, r.canonical, r["cast"]) for r in one} == {("insuCd", "insu_cd", "string"), ("python.terms.payTerm", "python_terms_pay_term", "string"), ("python.terms.pay", "python_terms_pay_term", "string"), ("ok", "ok", "boolean"), ("CODE", "key", "string"), ("PAY_TERM", "pay_term", "string"), ("N", "n", "string")}


def test_casts(spark):
    df = spark.createDataFrame([(x,) for x in ("12", "999세", "4,700만원", "2억", "1O", "-3", "")], "x string")
    assert [r.y for r in df.select(unify._read(F.col("x"), "bigint").alias("y")).collect()] == [12, 999, 47_000_000, 200_000_000, None, -3, None]
    df = spark.createDataFrame([(x,) for x in ("true", "Y", "예", "아니오", "?")], "x string")
    assert [r.y for r in df.select(unify._read(F.col("x"), "boolean").alias("y")).collect()] == [True, True, True, False, None]


def test_unify_keeps_all(spark):
    """Fields of equal last segments keep their values; conflicts get a name of their own; every line but headers is a record."""
    rows = feed("e_result", {1: [json.dumps({"terms": {"insuTerm": "X"}, "meta": {"insuTerm": "Y"}, "a": {"bC": 1}, "a.b": {"c": 2}, "feed": "f"}), None, "{bad", "{}"]})
    rows += [(90, "f_mapping", 1, "f.csv", 1, "x,y", "", 1), (91, "f_mapping", 1, "f.csv", None, "z", "", 1), (91, "f_mapping", 1, "f.csv", None, "w", "", 1)]
    df = spark.createDataFrame(rows, LINES)
    got = unify.records(df, aliases(spark)).collect()
    assert len(got) == 7
    r = next(r for r in got if r["terms_insu_term"])
    assert (r.terms_insu_term, r.meta_insu_term, r.a_b_c, r.a_b_c_2, r.field_feed) == ("X", "Y", 2.0, 1.0, "f")
    assert {(n.path, n.conflict) for n in unify.names(df, aliases(spark)).collect() if n.path.startswith("a")} == {("a.b.c", False), ("a.bC", True)}
    assert len(unify.records(df, aliases(spark, ("meta.insuTerm", "t", None), ("terms.insuTerm", "t", None))).filter("t = 'Y' AND terms_insu_term = 'X'").collect()) == 1


def at(day):
    return dt.datetime(2024, 1, day)


def settled(spark, refs, alive, gone, **k):
    a = spark.createDataFrame(refs, "id bigint, ref bigint, created_at timestamp_ntz, target string, alive string")
    t = spark.createDataFrame(alive, "key bigint, created_at timestamp_ntz, gone string")
    g = spark.createDataFrame(gone, "table_name string, key_id bigint")
    r = orphans.references(a, "a", "id", "ref", "t")
    return r, orphans.settle(r, orphans.existing({"t": (t, "key")}), orphans.removed(g), **k)


def test_orphans(spark):
    refs = [(1, 10, at(5), "x", "y"), (1, 10, at(5), "x", "y"), (2, None, at(5), "", ""), (3, 11, at(5), "", ""), (4, 12, at(5), "", ""), (5, 13, at(5), "", ""), (6, 14, None, "", ""), (7, 15, at(9), "", ""), (8, 11, at(7), "", "")]
    alive = [(10, at(1), "z"), (10, at(9), "z"), (11, at(6), ""), (14, at(6), ""), (15, None, ""), (None, at(1), "")]
    gone = [("t", 12), ("t", 12), ("u", 13), ("t", 10), (None, None)]
    for share in (0.001, 0.2, 2.0):  # all keys heavy, one, none
        r, v = settled(spark, refs, alive, gone, heavy_share=share)
        assert sorted((x.row_id, x.orphan_kind) for x in orphans.judge(r, v).collect()) == [(3, "late"), (4, "deleted"), (5, "missing")]
        assert sorted((str(x.period), x.n_references, x.n_missing, x.n_deleted, x.n_late) for x in orphans.report(r, v).collect()) == [("2024-01", 6, 1, 1, 1), ("None", 1, 0, 0, 0)]
    r, v = settled(spark, [], [], [])
    assert orphans.judge(r, v).count() == 0 and orphans.report(r, v).count() == 0


def test_orphans_hot_key(spark):
    """A key with two thirds of all references is heavy, and only it; the result is that of no split."""
    refs = [(i, 1 if i % 3 else i, at(5 + i % 9), "", "") for i in range(3_000)] + [(5_000 + i, 2, at(3), "", "") for i in range(900)]
    for share, n in ((0.1, 2), (2.0, 0)):
        r, v = settled(spark, refs, [(1, at(10), "")], [("t", 2)], heavy_share=share)
        assert v.heavy.count() == n
        got = {x.orphan_kind: x["count"] for x in orphans.judge(r, v).groupBy("orphan_kind").count().collect()}
        assert got == {"late": sum(1 for i in range(3_000) if i % 3 and i % 9 < 5), "missing": 1_000, "deleted": 900}
        assert [(x.n_references, x.n_missing, x.n_deleted, x.n_late) for x in orphans.report(r, v).collect()] == [(3_900, 1_000, 900, got["late"])]


def test_packed():
    cases = {
        "5년납, 15년납, 전기납(10년, 15년)": ["5년납", "15년납", "전기납(10년, 15년)"], '["60세납", "80세납"]': ["60세납", "80세납"], "10년납 25년납 65세납": ["10년납", "25년납", "65세납"],
        "5년납 및 55세납": ["5년납", "55세납"], '"20년납, 30년납': ["20년납", "30년납"], ",,5년납, ,7년납;": ["5년납", "7년납"], "월납(10년납)": ["월납(10년납)"], "5년납\n7년납\t9년납": ["5년납", "7년납", "9년납"],
        "": [], "  ": [], '"a,b",c': ["a,b", "c"], "'5년납' , '7년납'": ["5년납", "7년납"], "전기납(10년, 1": ["전기납(10년, 1"], "a）,b": ["a）", "b"], "[[a],b": ["a", "b"], '"': [], ")": [")"],
    }
    for text, wanted in cases.items():
        assert split_values(text, True)[0] == wanted, text
    assert split_values(None) == ([], [])
    assert split_values('"20년납, 30년납')[1] == ["open_quote"]
    assert split_values("7년납 19세~65세, 15년납 19세~60세")[0] == ["7년납 19세~65세", "15년납 19세~60세"]
    assert len(split_values("5년납," * 50_000)[0]) == 50_000
    assert len(split_values("(" * 50_000)[0]) == 1


def test_packed_in_proportion():
    """Every pattern of brackets, quotes and blanks, at doubled sizes: no text takes more than in proportion, and 100,000 open lists take under 2 s."""
    for pattern in ("[a, ", "[“a, ", "“a, ", '"a, ', "[[,", "[(, ", '["a"x, ', '" ', "[ ] ", "[a], ", "(a", "a  ", "[“a,”x", "및 ", "[a] x ", "[a;] b"):
        took = []
        for n in (25_000, 100_000):
            began = time.process_time()
            split_values(pattern * n, True)
            took.append(time.process_time() - began)
        assert took[1] < max(2, 8 * took[0]), (pattern, took)
    for text in ("a" + " " * 400_000 + "b", "“a, " * 50_000 + "”" + " " * 50_000 + "x", "[“a, " * 50_000 + "” ]x"):
        began = time.process_time()
        split_values(text, True)
        assert time.process_time() - began < 2


def test_packed_nearest_quote():
    assert split_values('[ ,","; "및년') == ([",", "및년"], ["empty_value", "open_list", "open_quote"])
    assert split_values('[[,a년납\n",""')[0] == ["a년납"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("0123년세납가나 ~:", min_size=1).map(str.strip).filter(lambda x: x and " " not in x), min_size=1, max_size=6), st.sampled_from([", ", ";", "/", " | ", "\n", "，"]), st.sampled_from(["", '"', "'"]))
def test_packed_round_trip(values, sep, quote):
    assert split_values(sep.join(quote + v + quote for v in values))[0] == values


@settings(max_examples=300, deadline=None)
@given(st.text("a(),;\"'[] 및\n“”", max_size=40))
def test_packed_never_fails(text):
    values, _ = split_values(text, True)
    assert all(v and v == bare_edges(v) for v in values)


def test_unpack(spark):
    df = spark.createDataFrame([(1, "pay_term", "a,b", 1), (1, "pay_term", "a,b", 1), (2, "x", None, 1), (3, "x", "a", 1)], "row_id bigint, source string, text string, pos int")
    assert sorted((r.row_id, r.pos, r.item_value) for r in unpack(df).collect()) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (3, 1, "a")]
    assert unpack(df, at_least=2).filter("row_id = 3").count() == 0
    assert unpack(df.limit(0)).count() == 0


PAYLOAD = {"insuCd": "1", "python": {"codes": {"10": "a", "11": {"name": "b", "riders": [{"code": "12", "name": "c"}, {"code": "13"}]}, "14": None, "15": [{"q": 1}]}}, "ocr": None, "x": {}}


def brute(node, path="", parent="", key="", depth=0, entry=False):
    if depth and (isinstance(node, dict) or entry):
        yield path, parent
    here = path if isinstance(node, dict) else parent
    if isinstance(node, dict):
        for k, v in node.items():
            yield from brute(v, f"{path}.{k}" if path else k, here, k, depth + 1, key == "codes" and depth > 0)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from brute(v, f"{path}[{i}]", here, "", depth + 1)


def test_nested(spark):
    deep = "{" + '"a":{' * 400 + "}" * 400 + "}"
    rows = [(1, json.dumps(PAYLOAD), 5), (2, None, 5), (3, "{}", 5), (4, "[1]", 5), (5, "nope", 5), (6, deep, 5), (1, json.dumps(PAYLOAD), 5)]
    df = spark.createDataFrame(rows, "rec_id bigint, payload string, doc int")
    tree = nested.nodes(df).cache()
    got = sorted((r.node_path, r.parent_path) for r in tree.filter("is_node AND rec_id = 1").collect())
    assert got == sorted(list(brute(PAYLOAD)) * 2)
    assert tree.filter("is_node AND rec_id = 6").count() == 400
    assert {r.rec_id for r in nested.errors(df).collect()} == {4, 5}
    riders = nested.flat(tree, r".*\.riders\[\]", {"code": "string", "name": "string"})
    assert sorted((r.code, r.name) for r in riders.filter("rec_id = 1").collect() if r.code) == [("12", "c")] * 2 + [("13", None)] * 2
    assert nested.nodes(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.integers(), st.text(max_size=3)), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "codes"]), x, max_size=3), max_leaves=12))
def test_labels(value):
    record = {"r": value}
    labels = nested.label(record)
    ups = nested.enclosing(labels)
    got = sorted((x[5], labels[u][5] if u >= 0 else "") for x, u in zip(labels, ups) if x[6])
    assert got == sorted(brute(record))


def test_nested_repeated_ids(spark, tmp_path):
    """Records of one rec_id keep their own links, exact copies too."""
    one = lambda *names: json.dumps({"python": {"codes": {"11": {"riders": [{"code": n, "variants": [{"code": n, "limit": {"max": int(n)}}]} for n in names]}}}})
    rows = [(1, one("1", "2")), (1, one("3")), (None, one("4")), (1, one("3"))]
    spark.createDataFrame(rows, "rec_id bigint, payload string").write.parquet(f"{tmp_path}/hybrid_result.parquet")
    d = str(tmp_path)
    assert sorted((str(r.rec_id), r.code, r.entry_path) for r in problems.p6_riders(spark, d).collect()) == [("1", c, "python.codes.11") for c in "1233"] + [("None", "4", "python.codes.11")]
    assert sorted((r.code, r.limit_max, r.rider_path) for r in problems.p6_variants(spark, d).collect()) == [("1", 1, "python.codes.11.riders[0]"), ("2", 2, "python.codes.11.riders[1]"), ("3", 3, "python.codes.11.riders[0]"), ("3", 3, "python.codes.11.riders[0]"), ("4", 4, "python.codes.11.riders[0]")]


def test_nested_deep(spark):
    deep = '{"k": ' * 3_000 + "[1, {}]" + "}" * 3_000
    very = '{"k": ' * 200_000 + '"\\u00e9"' + "}" * 200_000
    assert nested._read_deep(very)["k"]["k"] is not None
    df = spark.createDataFrame([(1, deep), (2, deep[:-1]), (3, "[" * 100_000)], "rec_id bigint, payload string")
    assert nested.nodes(df, only_nodes=True).groupBy("rec_id").count().collect()[0]["count"] == 3_000
    assert {r.rec_id for r in nested.errors(df).collect()} == {2, 3}


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False), st.text(max_size=5)), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12), st.sampled_from([None, 1]), st.text("{}[],:\"1 a", max_size=2), st.integers(0, 40))
def test_read_deep(value, indent, noise, at):
    text = json.dumps(value, indent=indent)
    assert nested._read_deep(text) == value
    text = text[:at] + noise + text[at:]
    try:
        wanted = json.loads(text)
    except ValueError:
        wanted = ValueError
    try:
        got = nested._read_deep(text)
    except ValueError:
        got = ValueError
    assert got == wanted


def hybrid(spark, tmp_path, payloads):
    """A folder with these payloads, numbered from 1, as hybrid_result."""
    spark.createDataFrame(list(enumerate(payloads, 1)), "rec_id bigint, payload string").write.parquet(f"{tmp_path}/hybrid_result.parquet")
    return str(tmp_path)


def test_ages_of_all_shapes(spark, tmp_path):
    terms = lambda x: {"terms": {"payTerm": "p", "ageRange": x}}
    d = hybrid(spark, tmp_path, [
        json.dumps({"python": terms([{"pay": "7년납", "ages": [{"sex": "남", "from": 15, "to": 70}]}]), "ocr": terms({"5년납": {"남": "5~80", "여": "만 5세~83"}, "5.5년납": {"남": "?", "여": None}})}),
        json.dumps({"best": terms("5년납(남:15~70)"), "ocr": terms(""), "python": terms(None), "analysis": {"terms": {"ageRange": True}}}), None, "{}",
    ])
    got = [tuple(r) for r in problems.p6_ages(spark, d).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "python.terms.ageRange[0].ages[0]", "python.terms.ageRange[0]", "list", "7년납", "남", 15, 70, None),
        (1, "ocr.terms.ageRange.5년납.남", "ocr.terms.ageRange.5년납", "object", "5년납", "남", 5, 80, "5~80"), (1, "ocr.terms.ageRange.5년납.여", "ocr.terms.ageRange.5년납", "object", "5년납", "여", 5, 83, "만 5세~83"),
        (1, "ocr.terms.ageRange.5.5년납.남", "ocr.terms.ageRange.5.5년납", "object", "5.5년납", "남", None, None, "?"),
        (2, "best.terms.ageRange", "best.terms", "text", None, None, None, None, "5년납(남:15~70)"), (2, "ocr.terms.ageRange", "ocr.terms", "text", None, None, None, None, ""),
    ], key=str)


def test_errors_pages_and_branches(spark, tmp_path):
    d = hybrid(spark, tmp_path, [json.dumps({
        "attempts": [{"no": 1, "method": "ocr", "errors": []}, {"no": 2, "errors": [{"page": 3, "msg": "m"}, {"page": None, "msg": "k"}]}],
        "python": {"success": True, "method": "ocr", "codes": {"10": {"name": "a", "pages": [4, 9]}, "11": "b"}}, "ocr": {"success": False, "codes": [{"code": "12", "pages": [7]}]}, "best": None,
        "analysis": {"insuCd": "5", "terms": {"insuTerm": False, "payTerm": True}, "codes_count": 88},
    }), None, "{}"])
    got = lambda name, *c: sorted((tuple(r) for r in problems.queries()[name](spark, d).select(*c).collect()), key=str)
    assert got("p6_errors", "attempt_path", "node_path", "page", "msg") == [("attempts[1]", "attempts[1].errors[0]", 3, "m"), ("attempts[1]", "attempts[1].errors[1]", None, "k")]
    assert got("p6_pages", "entry_path", "pos", "page") == [("ocr.codes[0]", 1, 7), ("python.codes.10", 1, 4), ("python.codes.10", 2, 9)]
    assert got("p6_branches", "branch", "success", "method", "insuCd", "codes_count", "has_insuTerm", "has_payTerm", "has_renew") == [
        ("analysis", None, None, "5", 88, False, True, None), ("ocr", False, None, None, None, None, None, None), ("python", True, "ocr", None, None, None, None, None),
    ]
