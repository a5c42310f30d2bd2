"""Tables of product codes in text: names with their codes, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daram.functions import terms
from daram.operators import sections

# Words of riders that are no products of their own, and marks of renewal contracts.
INSTITUTIONAL = ("지정대리청구서비스특약", "특정신체부위질병보장제한부인수특약", "할증특약", "제도성특약")
RENEWAL = r"갱신(계약|형|\)|\])"


def is_renewal(line: Column) -> Column:
    """Whether a line speaks of a renewal contract."""
    return line.rlike(RENEWAL)


def is_institutional(line: Column, words: tuple[str, ...] = INSTITUTIONAL) -> Column:
    return F.lower(line).rlike("|".join(words))


def line_name(line: Column) -> Column:
    """What is left of a line without its codes, the brackets around them and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\(?(?<!\d)\d{5}(?!\d)\)?", " "), r"\s+", " "))


def code_table(df: DataFrame, text: str, keys: list[str], drop: tuple = (is_renewal, is_institutional)) -> DataFrame:
    """(keys, code, name): lines are put together until they name a code, lines that ``drop`` tells are left out, all codes of a line share its name, and the last naming of a code counts."""
    parts = sections.combine(df, text, keys, terms.CODE)
    for told in drop:
        parts = parts.filter(~told(F.col("part")))
    named = parts.select(*keys, "part_no", line_name(terms.join_code(F.col("part"))).alias("name"), F.explode(terms.codes(terms.join_code(F.col("part")))).alias("code"))
    return named.groupBy(*keys, "code").agg(F.max_by("name", "part_no").alias("name"))


def typed_rows(line: Column, variants: tuple[str, ...]) -> Column:
    """Codes of one line with what they are: array of (name, variant, renewal, term, code).

    As many codes at the end of the line as there are ``variants`` stand for these in order; a line that ends in 최초계약 or 갱신계약 and a code gives one renewal row.
    """
    none = F.lit(None).cast("string")
    row = lambda name, variant, renewal, term, code: F.struct(name.alias("name"), variant.alias("variant"), renewal.alias("renewal"), term.alias("term"), code.alias("code"))
    last = terms.trailing_codes(line, len(variants))
    name = F.trim(F.regexp_extract(line, rf"^(.*?)((?:\s+\d{{5}}){{{len(variants)}}})\s*$", 1))
    several = F.when(last.isNotNull() & (name != "") & ~name.rlike(r"\d$"), F.array(*(row(name, F.lit(v), none, none, last[i]) for i, v in enumerate(variants))))
    renewal = r"^\s*(.+?)\s*\(\s*갱신형(?:,\s*(\d+년))?\s*\)\s*(최초계약|갱신계약)\s*(\d{5})\s*$"
    of = lambda i: F.nullif(F.regexp_extract(line, renewal, i), F.lit(""))
    return F.coalesce(F.when(line.rlike(renewal), F.array(row(of(1), F.lit("갱신형"), of(3), of(2), of(4)))), several, F.array().cast("array<struct<name:string,variant:string,renewal:string,term:string,code:string>>"))
