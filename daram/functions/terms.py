"""Column functions for product codes, terms, payment terms and ages in Korean policy text. Look-arounds bound numbers, as \\b differs between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = r"(?<!\d)(\d{5})(?!\d)"
NUMBER = r"(?<!\d)\d++"  # a whole run of digits: a search never starts inside one, so long runs cost no more than their length
WHOLE_LIFE = 999


def join_code(c: Column) -> Column:
    """Codes of five digits torn apart by single blanks (1+1+1+1+1, 3+2, 2+3) put together."""
    c = F.regexp_replace(c, r"(?<!\d)(\d) (\d) (\d) (\d) (\d)(?!\d)", "$1$2$3$4$5")
    c = F.regexp_replace(c, r"(?<!\d)(\d{3}) (\d{2})(?!\d)", "$1$2")
    return F.regexp_replace(c, r"(?<!\d)(\d{2}) (\d{3})(?!\d)", "$1$2")


def codes(c: Column) -> Column:
    """Five-digit codes in order of appearance, once each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CODE), F.lit(1)))


def unique_list(c: Column, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def pay_terms(c: Column) -> Column:
    """Payment terms as written: 10년납, 60세납, 전기납, 일시납."""
    return unique_list(c, rf"({NUMBER}[년세]납|전기납|일시납)")


def insurance_terms(c: Column) -> Column:
    """Insurance terms: 종신, n세만기, n년만기."""
    return unique_list(c, rf"(종신|{NUMBER}[세년]만기)")


def all_pay_terms(c: Column) -> Column:
    """Payment terms of every form, without blanks: those of ``pay_terms``, n회납, 월납, 연납, and numbers set apart (10 년 납)."""
    return F.array_distinct(F.transform(unique_list(c, rf"({NUMBER} *[년세회] *납|전기납|일시납|월납|연납)"), lambda x: F.regexp_replace(x, " ", "")))


def all_insurance_terms(c: Column) -> Column:
    """Insurance terms of every form, without blanks: those of ``insurance_terms``, 평생, n세까지, n세종료, and numbers set apart (10 년 만기)."""
    return F.array_distinct(F.transform(unique_list(c, rf"(종신|평생|{NUMBER} *[세년] *만기|{NUMBER} *세 *(?:까지|종료))"), lambda x: F.regexp_replace(x, " ", "")))


def age_ranges(c: Column) -> Column:
    """Ranges such as 15~80 with or without 만 and 세, in plain numbers."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"(만? ?{NUMBER}세? ?~ ?만? ?{NUMBER}세?)"), F.lit(1)), lambda x: F.regexp_replace(x, "[만세 ]", "")))


def renewal(c: Column, default: str | None = None) -> Column:
    """비갱신형 before 갱신형, as the one contains the other; the default where neither occurs."""
    return F.when(c.contains("비갱신"), "비갱신형").when(c.contains("갱신"), "갱신형").otherwise(F.lit(default))


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def term_to_int(c: Column, age: Column | None = None) -> Column:
    """Length of a term: 999 for whole life; n for n세만기, or the years left at ``age`` if more than 30; else the first number. Null where nothing is left."""
    n = first_number(c)
    to_age = n if age is None else F.when(n <= 30, n).when(n > age, n - age)
    return F.when(c.rlike("종신|평생"), WHOLE_LIFE).when(c.rlike(r"\d+세"), to_age).otherwise(n)


def pay_term_to_int(c: Column, insurance: Column | None = None) -> Column:
    """Payments: 1 for a single premium; 전기납 is the whole insurance term if given, else 1; 0 for a bare 월납; else the number."""
    return (
        F.when(c.contains("일시납"), 1).when(c.contains("전기납"), F.lit(1) if insurance is None else insurance)
        .when(c.contains("월납") & ~c.rlike(r"\d"), 0).otherwise(first_number(c))
    )


def inner_pay_term(c: Column) -> Column:
    """월납(10년납) is 10년납; null and blank are a dash."""
    inner = F.regexp_extract(c, r"월납\(([^)]*)\)", 1)
    return F.when(c.isNull() | (F.trim(c) == ""), "—").when(inner != "", inner).otherwise(F.trim(c))


def gender_age(c: Column, gender: str) -> Column:
    """Range of a gender (남, 여) up to the next comma or bracket, in plain numbers; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, rf"{gender}\s*:\s*([^,)]*)", 1), "[만세 ]", ""), F.lit(""))


def age_for_pay_term(ages: Column, pay: Column) -> Column:
    """What stands in brackets behind the payment term; else behind its colon up to the next comma; else the whole text."""
    behind = F.when((F.length(pay) > 0) & F.contains(ages, pay), F.call_function("substring", ages, F.call_function("instr", ages, pay) + F.length(pay)))
    bracket, colon = F.regexp_extract(behind, r"^\(([^)]*)\)", 1), F.regexp_extract(behind, r"^\s*:\s*([^,]*)", 1)
    return F.coalesce(F.nullif(bracket, F.lit("")), F.nullif(colon, F.lit("")), ages)


def normal_title(c: Column) -> Column:
    """Title for comparing: without brackets and what they mark, signs and blanks; letters and numbers stay, in lower case."""
    c = F.regexp_replace(c, r"\(무\)|\[[^\]]*\]", "")
    return F.lower(F.regexp_replace(c, r"[^가-힣0-9A-Za-z]", ""))


def word_overlap(a: Column, b: Column) -> Column:
    """Number of words two texts share."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.size(F.array_intersect(words(a), words(b)))


def comma_list(c: Column) -> Column:
    """Entries of a comma list, trimmed, without blanks; a dash is an empty list."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "—"))
    return F.coalesce(parts, F.array().cast("array<string>"))


def shorten(c: Column, n: int, mark: str = "...") -> Column:
    """First n characters, with a mark only where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def code_of_file(c: Column) -> Column:
    """21239 of UW21239.pdf; null for other names."""
    return F.nullif(F.regexp_extract(c, r"UW(\d{5})(?:\.pdf)?$", 1), F.lit(""))


def cache_key(content: Column, *parts: Column) -> Column:
    """First 16 characters of the URL-safe base64 of the SHA-256, then the parts."""
    return F.concat_ws("_", F.substring(F.translate(F.base64(F.unhex(F.sha2(content, 256))), "+/", "-_"), 1, 16), *parts)


def document_kind(c: Column) -> Column:
    """Rough kind of a text by its length and its tables; the first that holds."""
    return (
        F.when(c.isNull() | (F.length(F.trim(c)) < 100), "EMPTY").when(c.contains("한도표"), "TABLE").when(c.rlike(r"\d+년납") & c.rlike(r"\d+세"), "TERMS")
        .when(F.length(c) < 1000, "SIMPLE").otherwise("COMPLEX")
    )


def between(c: Column, start: str, end: str) -> Column:
    """Text between two marks, both of which must be there; null otherwise. Patterns go over line ends."""
    return F.nullif(F.regexp_extract(c, rf"(?s){start}\s*(.*?)\s*{end}", 1), F.lit(""))


def bare_years(c: Column, most: int = 50) -> Column:
    """Numbers of years that are no payment terms (n년 not followed by 납), up to ``most``, once each."""
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,4})년(?!납)"), F.lit(1)), lambda x: x.cast("int"))), lambda x: x <= most)


def trailing_codes(c: Column, n: int) -> Column:
    """The n codes a line ends with, in order; null if it doesn't end with so many."""
    codes_at_end = F.regexp_extract(c, rf"((?:\s+\d{{5}}){{{n}}})\s*$", 1)
    return F.when(codes_at_end != "", F.split(F.trim(codes_at_end), r"\s+"))


def alias_match(a: Column, b: Column, groups: list[list[str]]) -> Column:
    """Whether two titles match: one contains the other, or both name a word of the same alias group."""
    x, y = normal_title(a), normal_title(b)
    shared = F.lit(False)
    for words in groups:
        has = lambda t: t.rlike("|".join(words))  # noqa: E731, B023
        shared = shared | (has(x) & has(y))
    return F.contains(x, y) | F.contains(y, x) | shared


def date_or_default(c: Column, as_of: Column, days: int) -> Column:
    """Date of an ISO text; where there is none, so many days before ``as_of``."""
    return F.coalesce(F.to_date(F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), F.date_sub(as_of, days))


def json_part(c: Column) -> Column:
    """The JSON record within other output: from the first line that starts with a brace to the first line end behind a closing brace where the text ends or a line of other kind follows; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(?:^|\n)(\{.*?\})\s*(?:\n(?![\s{}\[\]\",])|$)", 1), F.lit(""))
