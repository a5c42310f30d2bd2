"""Problem 7: text that looks the same but differs in its characters.

DuckDB runs inside the Arrow partitions: embedded SQL drops what shows nothing, translates
compatibility forms and look-alikes, composes with ``nfc_normalize`` and reads letters inside numbers as digits.
A value is a case if the one consistent form differs from it.

Defined results:
* null stays null and is no case; empty and blank texts are as they are;
* signs that look different (circled digits, dashes, dots, curly quotes) stay;
* Latin letters stay unless they stand inside or in place of a number; repeated rows give repeated results.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daram.session import ship

# Look-alikes of ASCII signs and of the letters O, I and others, beyond what Unicode's own tables relate.
LOOKALIKES = {
    ":": "꞉∶ː˸׃։", "~": "〜∼˜⁓∽", ".": "․", "0": "〇", ",": "‚", "(": "❨", ")": "❩", "/": "∕⁄", "|": "∣ǀ", ";": ";", "-": "‐‑",
    "A": "ΑА", "B": "ΒВ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀⅠ", "l": "ӏⅼ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР", "S": "Ѕ", "C": "СϹ", "T": "ΤТ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "V": "Ѵ", "L": "Ꮮ",
    "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј", "o": "οо", "p": "р", "s": "ѕ", "x": "х", "y": "у",
}
# Ranges of a character class that show nothing (controls other than tab and line ends, fillers, joiners, marks), and spaces.
SHOWS_NOTHING = r"\x{01}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}" "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def table() -> tuple[str, str]:
    """(from, to) for translate: by rule every wide, narrow or font form of one ASCII sign or Hangul letter, then the fixed look-alikes and spaces."""
    pairs = {}
    for cp in range(0xA0, 0x20000):
        kind = unicodedata.decomposition(chr(cp)).partition(" ")[0]
        if kind in ("<font>", "<wide>", "<narrow>", "<small>") or 0xFF00 < cp < 0xFF5F:
            plain = unicodedata.normalize("NFKC", chr(cp))
            if len(plain) == 1 and plain != chr(cp):
                pairs[chr(cp)] = plain
    pairs |= {c: plain for plain, like in LOOKALIKES.items() for c in like} | dict.fromkeys(SPACES, " ")
    return "".join(pairs), "".join(pairs.values())


# Letters as digits: a run of digits and these letters with at least one digit, or of these letters alone in front of a unit or a range sign.
_WORDS = r"[A-Za-z0-9]+\s*[~세년]?|[^A-Za-z0-9]+"
_RUNS = "[0-9OolI]+|[^0-9OolI]+"
_ALONE = r"^[OolI]+\s*[~세년]$"


def statement() -> str:
    """The embedded SQL over a relation ``part`` with a column ``text``; parameters: the translate pair.

    Texts of plain signs only skip the translation, which leaves them as they are; forms without O, o, I, l skip the digits. Both give a fixed point: the form of a form is itself.
    """
    form = f"nfc_normalize(translate(nfc_normalize(regexp_replace(text, '[{SHOWS_NOTHING}]', '', 'g')), $1, $2))"
    read = "translate({0}, 'OolI', '0011')"
    runs = f"array_to_string(list_transform(regexp_extract_all(w, '{_RUNS}'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN {read.format('x')} ELSE x END), '')"
    digits = f"array_to_string(list_transform(regexp_extract_all(mapped, '{_WORDS}'), lambda w: CASE WHEN regexp_matches(w, '{_ALONE}') THEN {read.format('w')} WHEN regexp_matches(w, '[0-9]') THEN {runs} ELSE w END), '')"
    return f"""
        WITH a AS (SELECT *, CASE WHEN regexp_matches(text, '[^ -~\\n\\r\\t가-힣]') THEN {form} ELSE text END AS mapped FROM part),
        b AS (SELECT * EXCLUDE (mapped), CASE WHEN regexp_matches(mapped, '[OolI]') THEN {digits} ELSE mapped END AS form FROM a)
        SELECT *, form IS DISTINCT FROM text AS differs FROM b"""


def _normalise(batches):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
    sql, pair = statement(), table()
    for batch in batches:
        con.register("part", pa.Table.from_batches([batch]))
        found = con.sql(sql, params=list(pair)).to_arrow_table()
        yield from found.cast(pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("field_name", pa.string()), ("text", pa.string()), ("form", pa.string()), ("differs", pa.bool_())])).to_batches()


def normalise(texts: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, text) with ``form`` and whether it ``differs`` from the text. No shuffle."""
    ship(texts.sparkSession)
    rows = texts.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "field_name", "text")
    return rows.mapInArrow(_normalise, "table_name string, row_id bigint, field_name string, text string, form string, differs boolean")


def comparable(form):
    """The consistent form without spaces: equal ranges compare as equal."""
    return F.regexp_replace(form, r"\s+", "")
