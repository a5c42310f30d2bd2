"""Truncation, look-alikes and wrong encodings."""

import random
import unicodedata

from daram.llm import confusables as C
from daram.llm import mojibake as M
from daram.llm import truncation as T

WORDS = "보험 계약 나이 기준 확인 담당 적용 심사 접수 승인 특약 한도 가입 보장 금액".split()


def test_truncation(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(WORDS) + "으로" for _ in range(rng.randint(4, 9))) + " 합니다."
    rows, bad = [], set()
    for i in range(3000):
        src = f"f{i % 4}" if i % 7 else None
        notes = " ".join(sentence() for _ in range(rng.randint(1, 4)))
        terms = ", ".join(f"{n}년납" for n in range(5, 5 + rng.randint(1, 9)))
        if src == "f1" and len(notes) > 60:
            notes = notes[:60]
            if not notes.endswith("."):
                bad.add((i, "notes"))
        if src == "f2" and len(terms.encode()) > 40:
            terms = terms.encode()[:40].decode("utf-8", "replace")
            if not terms.endswith("납"):
                bad.add((i, "terms"))
        rows.append((i, src, terms, notes, 1, "x"))
    rows += [(9000, "f3", "5년납, 7년", "합니다. 보험으로 계", 1, ""), (9001, "f3", "5년납(10년, 1", "끝까지 합니다...", 1, ""), (9002, None, None, None, 1, ""), (9003, "f3", " ", "-", 1, ""), (9004, "f3", "5년납," * 20_000, "가" * 100_000 + " 합니다.", 1, ""), (9005, "f3", "5년납 7년납  ", "합니다.", 1, "")]
    bad |= {(9000, "terms"), (9000, "notes"), (9001, "terms"), (9001, "notes"), (9004, "terms")}
    df = spark.createDataFrame(rows + rows[:300], "id bigint, src_file string, terms string, notes string, bin int, last string")
    texts = T.texts(df, "t", "id", {"terms": "list", "notes": "prose"}, resent=True)
    got = T.cut_texts(texts).collect()
    assert len(got) == len({(r.row_id, r.field_name) for r in got})
    found = {(r.row_id, r.field_name) for r in got}
    assert len(found & bad) >= 0.98 * len(bad) and len(found - bad) <= 0.02 * len(bad), (sorted(found ^ bad)[:9])
    limit = [r for r in got if (r.src_file, r.field_name) in (("f1", "notes"), ("f2", "terms"))]
    assert sum(r.at_limit for r in limit) > 0.9 * len(limit)
    assert not any(r.at_limit for r in got if r.row_id >= 9000)
    rates = {(r.field_name, r.src_file): r for r in T.report(texts).collect()}
    assert rates["notes", "f1"].n_cut > 100 and rates["notes", "f0"].n_cut == 0 and rates["terms", None].n_texts > 0
    # the limits are those planted; a cut by bytes may fall up to two bytes short
    assert rates["notes", "f1"].limits_chars == [60] and set(rates["terms", "f2"].limits_bytes) <= {38, 39, 40} and rates["terms", "f2"].limits_bytes
    assert not any(r.limits_chars or r.limits_bytes for k, r in rates.items() if k not in (("notes", "f1"), ("terms", "f2")))
    assert T.cut_texts(texts.limit(0)).count() == 0


def test_truncation_is_tested(spark):
    """Endings with little evidence of their own are cases at a significant length only: without the test of lengths they are none, and neither are they at other lengths."""
    name = lambda i: "".join(chr(0xAC00 + (i * 7919 + k * 104_729) % 11_000) for k in range(10))
    rows = [(i, "cut" if i % 3 == 0 else "whole", f"{name(i)}{'다' * (i % 9)}") for i in range(600)]
    limit = [(i, s, t[:12]) for i, s, t in rows if s == "cut" and len(t) > 12]
    known = [(1000 + i, "other", t) for i, s, t in rows if s == "cut" and len(t) > 12] + [(2000 + i, "other", t) for i, s, t in rows if s == "cut" and len(t) > 12]
    rows = [r for r in rows if r[1] == "whole" or len(r[2]) <= 12] + limit + known + [(9000, "whole", name(2)[:7]), (9001, "whole", name(2)[:7] + "라마"), (9002, "whole", name(2)[:7] + "바사")]
    ended = T.judged(T.texts(spark.createDataFrame(rows, "id bigint, src_file string, x string"), "t", "id", {"x": "list"})).cache()
    assert {r.row_id for r in T.cases(ended).collect()} == {i for i, _, _ in limit}
    nothing = T.limits(T.lengths(ended)).limit(0)
    assert T.cases(ended, nothing).count() == 0


def test_truncation_ways(spark):
    """Values that always end with a delimiter or an open bracket end as they should; long unbroken texts are read once."""
    rows = [(i, "a", f"{i % 7}년납, {i % 5}년납,") for i in range(300)] + [(300, "a", "가" * 300_000), (301, "a", "가" * 299_999)]
    assert T.cut_texts(T.texts(spark.createDataFrame(rows, "id bigint, src_file string, x string"), "t", "id", {"x": "list"})).count() == 0


def test_truncation_of_many_rows(spark):
    """Counts as tables of some GB have them: their log p, in tenths, exceeds 32 bits."""
    counts = [("t:x", "0", 179_000, 116_000_000, 1 - 4e-9), ("t:x", "0년", 2_000_000_000, 600_000_000_000, 0.9), ("t:x", "전", 40, 60, 0.5), ("t:x", "5년납", 900, 100, 0.9), ("u:x", "0", 0, 90_000_000_000, 0.9)]
    words = spark.createDataFrame(counts, "field string, unit string, stops bigint, goes bigint, h0 double")
    assert {(r.field, r.last): r.sure for r in T.unfinished(words).collect()} == {("t:x", "0"): True, ("t:x", "0년"): True, ("t:x", "전"): False, ("u:x", "0"): True}
    tested = spark.createDataFrame([("t:x", i, p) for i, p in enumerate((-1e15, -214_748_364.8, -214_748_364.7, -9.0, -1.0, 0.0))], "field string, i int, log_p double")
    assert {r.i for r in T.discoveries(tested, 0.01).collect()} == {0, 1, 2, 3}


def forms(spark, values):
    df = spark.createDataFrame([("t", i, "f", v, "x") for i, v in enumerate(values)], "table_name string, row_id bigint, field_name string, text string, form string")
    return [(r.form, r.differs) for r in C.normalise(df).orderBy("row_id").collect()]


def test_lookalikes(spark):
    cases = {
        "만 15세 ~ 80세": None, "①5년납(남:15~80), B플랜 0~65세": None, "—": None, "-": None, "": None, " \n": None, "5·6、7…": None, "L플랜 5~7": None, "I": None,
        "１５～８０": "15~80", "15〜80": "15~80", "남꞉15": "남:15", unicodedata.normalize("NFD", "10년납"): "10년납", "1\u200b5": "15", "15\u2009~\u00a080": "15 ~ 80", "𝟏𝟓~𝟖𝟎": "15~80",
        "4O~55": "40~55", "l5~6o": "15~60", "2Ο년납": "20년납", "O~7О": "0~70", "남:I9~70": "남:19~70", "（남；１）": "(남;1)", "А플랜": "A플랜",
        "1OOOOOO": "1000000", "OOO세": "000세", "lOO세~I2O": "100세~120", "OIO": None, "Oil 5년": None, "lI": None,
    }
    assert forms(spark, list(cases)) == [(c if w is None else w, w is not None) for c, w in cases.items()]
    assert forms(spark, [None, "１" * 200_000]) == [(None, False), ("1" * 200_000, True)]
    assert forms(spark, ["１"])[0] == forms(spark, ["1"])[0][:1] + (True,)


def test_lookalikes_fixed_point(spark):
    """The form of a form is itself."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("OolI0123~세년 ５Ο〜꞉\u200b\u3000각ᄀ\u0301é𝟏ㅏＡ-") for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    once = [f for f, _ in forms(spark, texts)]
    assert [d for _, d in forms(spark, once)] == [False] * len(once)


KOREAN = "가입나이는 15세부터 60세이고 보험료 납입을 면제합니다."


def wrong(text, written, read):
    return M._read(text.encode(written), read) if read == "cp1252" else text.encode(written).decode(read)


def test_mojibake_restores():
    f = M.Finder()
    for text in (KOREAN, "the rider’s age is 0–57 €5 👍"):
        for pair in M.PAIRS[:4]:
            bad = text
            for _ in range(pair.times):
                bad = wrong(bad, pair.written, pair.read)
            assert f.repair("앞 SÃO é. " + bad + " 뒤 Café")[0] == "앞 SÃO é. " + text + " 뒤 Café", pair.name
    apart = unicodedata.normalize("NFD", KOREAN)
    assert f.repair(wrong(apart, "utf-8", "cp1252"))[0] == apart and f.repair(apart) == (apart, [])
    for read in ("latin-1", "gbk"):
        assert f.repair("앞. " + wrong(KOREAN, "cp949", read) + " 뒤")[0] == "앞. " + KOREAN + " 뒤"


def test_mojibake_lossy_and_sound():
    f = M.Finder()
    for bad in (KOREAN.encode("cp949").decode("utf-8", "replace"), KOREAN.encode("cp949").decode("utf-8", "ignore"), KOREAN.encode().decode("cp949", "replace")):
        fixed, passages = f.repair("앞 " + bad)
        assert passages and fixed == "앞 " + bad
    for text in (KOREAN, "SÃO 지점 GRÂCE Ø3mm ½ 감액, ©2015, 23°C ± 2", "被保險者 年齡은 滿 17歲로 計算함", "保險契約者의 告知義務", "α차단제 88μg, β Δ7.5 σ", "👍 □ ① “x” – …", "", "é" * 5):
        assert f.repair(text) == (text, []), text


def test_mojibake_other_scripts():
    """Sound texts in other scripts and with marks stay; garbled kana and Cyrillic come back."""
    f = M.Finder()
    for text in ("cafe\u0301 re\u0301sume\u0301 cre\u0300me a\u0330o\u0330", "Привет, как дела?", "Настоящим подтверждаем страхование", "Բարև ձեզ, ինչպես եք", "שלום עולם, מה שלומך", "مرحبا بالعالم", "Příliš žluťoučký kůň", "zażółć gęślą jaźń", "ťažký šťastný žiak", "İşçi ığdır çağ", "Ελληνικά κείμενα", "これはテストです", "ﾊﾝｶｸｶﾅ ﾃｽﾄ"):
        assert f.repair(text) == (text, []), (text, f.passages(text))
    for text in ("これはテストです。", "Привет, страхование"):
        for pair in M.PAIRS[:4]:
            bad = text
            for _ in range(pair.times):
                bad = wrong(bad, pair.written, pair.read)
            assert f.repair("앞 " + bad)[0] == "앞 " + text, (pair.name, f.repair(bad))


def test_mojibake_recall(spark):
    """Sound documents of the corpus through every pair: at least nine of ten come back as they were, and garbled text is found in all but a hundredth."""
    f = M.Finder()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 40").select("text").collect()
    sound = [r.text for r in rows if not f.passages(r.text) and any("가" <= c <= "힣" for c in r.text)]
    assert len(sound) > 400
    lossy = [("cp949", "utf-8", "ignore"), ("cp949", "utf-8", "replace"), ("utf-8", "cp949", "replace")]
    for written, read, how in lossy:
        assert sum(bool(f.passages(t.encode(written, "ignore").decode(read, how))) for t in sound) > 0.98 * len(sound), (written, read)
    for pair in M.PAIRS:
        back = n = found = 0
        for text in sound:
            try:
                bad = text
                for _ in range(pair.times):
                    bad = M._read(bad.encode(pair.written), pair.read)
            except UnicodeEncodeError:
                continue
            if bad is not None:
                fixed, passages = f.repair(bad)
                n, back, found = n + 1, back + (fixed == text), found + bool(passages)
        assert n < 20 or found > 0.99 * n, (pair.name, n, found)
        assert n < 20 or back > 0.9 * n, (pair.name, n, back)


def test_mojibake_rows(spark):
    rows = [(1, KOREAN, "x"), (2, wrong(KOREAN, "utf-8", "latin-1"), "x"), (3, None, ""), (4, "", ""), (2, wrong(KOREAN, "utf-8", "latin-1"), "x"), (5, KOREAN * 5_000 + wrong(KOREAN, "cp949", "latin-1"), "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    got = M.restore(df).collect()
    assert sorted((r.doc_id, r.is_garbled) for r in got) == [(1, False), (2, True), (2, True), (3, False), (4, False), (5, True)]
    assert {r.doc_id: r.restored for r in got}[2] == KOREAN and {r.doc_id: r.restored for r in got}[5] == KOREAN * 5_001 and {r.doc_id: r.restored for r in got}[3] is None
    assert M.restore(df.limit(0)).count() == 0


def test_mojibake_left_whole(spark):
    read = lambda text: text.encode().decode("cp949", "replace")
    rows = [(1, "앞 " + read("보험 계약 방법") + " 뒤"), (2, read("보험의 계약은 방법")), (3, "保險契約者의 告知義務, 계약 방법")]
    got = {r.doc_id: r for r in M.restore(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].restored == "앞 보험 계약 방법 뒤" and got[1].restorable and got[1].pairs == ["utf8_cp949"]
    assert got[2].restored == rows[1][1].replace(read("보험"), "보험").replace(read("계약"), "계약").replace(read("방법"), "방법") and not got[2].restorable
    assert got[3].restored == rows[2][1] and not got[3].is_garbled
