"""Problem 5: several values packed in one field.

A parsing expression grammar with ordered alternatives; each rule takes a position and gives the
position behind what it matched, or None, in which case the next alternative is tried from the same place:

    list      <- blank* '[' items ']' blank* end  /  items end
    items     <- sep* (item (sep+ item)*)? sep*
    item      <- quoted / enclosed / bare
    quoted    <- q (!q .)* q &(blank* (sep / ']' / end))
    enclosed  <- '[' items ']' &(blank* (sep / end))
    bare      <- (group / !sep .)+
    group     <- '(' (group / !')' .)* (')' / end)
    sep       <- blank* (delimiter / 'AND' word) blank* / blank+ &start-of-value

Defined results:
* null, empty and blank texts give no row; a text without separators gives one row at position 1;
* empty values between separators are skipped and don't count, but set the flag ``empty_value``;
* a quote that doesn't close before a separator falls back to a bare value (flag ``open_quote``);
* a round bracket that doesn't close reaches to the end (flag ``open_bracket``);
* repeated rows are parsed alike; texts of any length take time in proportion to it: what a rule found at a place is
  kept (``separator``, ``ends_value``, the next closing quote, places from which no list closes), and values stay spans
  until the parse is over, so that going back never reads a stretch a second time.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daram.session import ship

# Delimiters seen in the exports, their full-width forms, quotes and brackets.
DELIMITERS = ",;/|·、\n\r\t+，；／｜"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "＂": "＂"}
OPEN, CLOSE = "(（", ")）"
LIST_OPEN, LIST_CLOSE = "[［", "]］"
AND = "및"
MARKS = "①-⑳"

_EDGE = "".join({*QUOTES, *QUOTES.values()}) + LIST_OPEN + LIST_CLOSE
_AROUND = _EDGE + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_BLANK = re.compile(r"[^\S\n\r\t]+")
_START = re.compile(rf"[{MARKS}]?[\"'“‘]?(?:[\dOolIΟОІ]+[년세]납|전기납|일시납|월납)")
_PLAIN = re.compile(rf"[^{re.escape(DELIMITERS + ''.join(QUOTES) + OPEN + CLOSE + LIST_OPEN + LIST_CLOSE)}\s]+")
_INNER = re.compile(rf"[^{re.escape(OPEN + CLOSE)}]+")
CACHE = 50_000
ITEM = "row_id bigint, source string, found array<string>, flags array<string>"


def bare_edges(text: str) -> str:
    """Without blanks of any kind, quotes and list brackets around it."""
    return text.strip(_AROUND)


class Packed:
    """One text under the grammar; ``spans`` of the values and ``flags`` after ``parse``."""

    def __init__(self, text: str, blank_after_term: bool):
        self.text, self.end, self.blank_after_term = text, len(text), blank_after_term
        self.spans: list[tuple[int, int]] = []
        self.flags: set[str] = set()
        self.separators: dict[int, int | None] = {}
        self.value_ends: dict[tuple[int, str], bool] = {}
        self.closing: dict[str, tuple[int, int]] = {}
        self.unclosed: set[int] = set()

    def parse(self) -> list[str]:
        i = self.blanks(0)
        if not (i < self.end and self.text[i] in LIST_OPEN and self.whole_list(i)):
            self.spans.clear()
            self.items(0, stop="")
        values = [v for a, b in self.spans if (v := bare_edges(self.text[a:b]))]
        if len(values) < len(self.spans):
            self.flags.add("empty_value")
        return values

    def whole_list(self, i: int) -> bool:
        j = self.items(i + 1, stop=LIST_CLOSE)
        return j < self.end and self.text[j] in LIST_CLOSE and self.blanks(j + 1) == self.end

    def blanks(self, i: int) -> int:
        m = _BLANK.match(self.text, i)
        return m.end() if m else i

    def separator(self, i: int) -> int | None:
        """Behind one separator that starts at i."""
        if i not in self.separators:
            self.separators[i] = self._separator(i)
        return self.separators[i]

    def _separator(self, i: int) -> int | None:
        t, j = self.text, self.blanks(i)
        if j < self.end and t[j] in DELIMITERS:
            return self.blanks(j + 1)
        if j > i and t.startswith(AND, j) and self.blanks(j + len(AND)) > j + len(AND):
            return self.blanks(j + len(AND))
        if j > i and j < self.end and i > 0:
            complete = t[i - 1] == "납" or t[i - 1] in CLOSE or t[i - 1] in QUOTES.values()
            if _START.match(t, j) or self.blank_after_term and complete and t[j] not in OPEN:
                return j
        return None

    def items(self, i: int, stop: str) -> int:
        """Place of the stop sign or the end. Items of a list end at once where an earlier list, that never closed, has been already."""
        wanted, begins = False, []
        while True:
            while (j := self.separator(i)) is not None:
                if wanted is False:
                    self.flags.add("empty_value")
                wanted, i = False, j
            i = self.blanks(i)
            if i >= self.end or self.text[i] in stop:
                if stop and not (i < self.end and self.ends_value(i + 1, "")):
                    self.unclosed.update(begins)
                return i
            if stop:
                if i in self.unclosed:
                    self.unclosed.update(begins)
                    return self.end
                begins.append(i)
            before = i
            for rule in (self.quoted, self.enclosed, self.bare):
                if (j := rule(i, stop)) is not None:
                    i = j
                    break
            wanted = True
            if i == before:  # a lone closing sign: never stand still
                i += 1

    def ends_value(self, i: int, stop: str) -> bool:
        if (i, stop) not in self.value_ends:
            j = self.blanks(i)
            self.value_ends[i, stop] = j >= self.end or self.text[j] in stop or self.separator(i) is not None
        return self.value_ends[i, stop]

    def next_close(self, close: str, i: int) -> int:
        """First place of the sign behind i, or the end. Kept with the place it was looked for from, so that no stretch is searched twice."""
        since, j = self.closing.get(close, (i, i))
        if j <= i:
            since, j = i, self.text.find(close, i + 1)
            j = self.end if j < 0 else j
        elif i < since:
            nearer = self.text.find(close, i + 1, since + 1)
            since, j = i, j if nearer < 0 else nearer
        self.closing[close] = since, j
        return j

    def quoted(self, i: int, stop: str) -> int | None:
        close = QUOTES.get(self.text[i])
        if close is None:
            return None
        j = self.next_close(close, i)
        if j == self.end or not self.ends_value(j + 1, stop):
            self.flags.add("open_quote")
            return None
        self.spans.append((i + 1, j))
        return j + 1

    def enclosed(self, i: int, stop: str) -> int | None:
        if self.text[i] not in LIST_OPEN or stop:  # lists within lists are read as bare text
            return None
        mark, flags = len(self.spans), set(self.flags)
        j = self.items(i + 1, stop=LIST_CLOSE)
        if j < self.end and self.ends_value(j + 1, stop):
            return j + 1
        del self.spans[mark:]
        self.flags = flags | {"open_list"}
        return None

    def bare(self, i: int, stop: str) -> int:
        t, j = self.text, i
        while j < self.end:
            if m := _PLAIN.match(t, j):
                j = m.end()
            elif t[j] in OPEN:
                j = self.group(j)
            elif t[j] in stop or self.separator(j) is not None:
                break
            else:
                j = max(j + 1, self.blanks(j))  # blanks that don't separate at their first don't at any
        self.spans.append((i, j))
        return j

    def group(self, i: int) -> int:
        depth, j, t = 1, i + 1, self.text
        while j < self.end and depth:
            if m := _INNER.match(t, j):
                j = m.end()
            else:
                depth += 1 if t[j] in OPEN else -1
                j += 1
        if depth:
            self.flags.add("open_bracket")
        return j


def split_values(text: str | None, blank_after_term: bool = False) -> tuple[list[str], list[str]]:
    """(values in order, error flags) of one text."""
    if text is None:
        return [], []
    p = Packed(text, blank_after_term)
    return p.parse(), sorted(p.flags)


def _parse_batches(blank_after_term: tuple, at_least: int):
    schema = pa.schema([("row_id", pa.int64()), ("source", pa.string()), ("found", pa.list_(pa.string())), ("flags", pa.list_(pa.string()))])
    known: dict = {}

    def of(rows: pa.RecordBatch, blank_too: bool) -> pa.RecordBatch:
        once = rows.column(2).dictionary_encode()
        parsed = []
        for text in once.dictionary.to_pylist():
            if (found := known.get((text, blank_too))) is None:
                if len(known) >= CACHE:
                    known.clear()
                found = split_values(text, blank_too)
                if len(text) < 200:
                    known[text, blank_too] = found
            parsed.append(found)
        values, flags = (pa.array([p[k] for p in parsed], pa.list_(pa.string())) for k in (0, 1))
        enough = pc.greater_equal(pc.list_value_length(values), at_least).take(once.indices)
        at = once.indices.filter(enough)
        return pa.RecordBatch.from_arrays([rows.column(0).filter(enough), rows.column(1).filter(enough), values.take(at), flags.take(at)], schema=schema)

    def run(batches):
        names = pa.array(blank_after_term, pa.string())
        for batch in batches:
            too = pc.is_in(batch.column(1), value_set=names)
            for blank_too, mask in ((True, too), (False, pc.invert(too))):
                if (rows := batch.filter(mask)).num_rows:
                    yield of(rows, blank_too)

    return run


def unpack(texts: DataFrame, blank_after_term: tuple[str, ...] = (), at_least: int = 1) -> DataFrame:
    """(row_id, source, text) to one row per value (row_id, source, pos, item_value, flags), with its place from 1 and the text's error flags.

    Texts of fewer than ``at_least`` values are left out. In the sources named in ``blank_after_term`` a blank behind a finished payment term separates, too.
    """
    ship(texts.sparkSession)
    rows = texts.select(F.col("row_id").cast("bigint").alias("row_id"), "source", "text").filter(F.length(F.trim("text")) > 0)
    found = rows.mapInArrow(_parse_batches(tuple(blank_after_term), at_least), ITEM)
    return found.select("row_id", "source", F.posexplode("found").alias("at", "item_value"), "flags").select("row_id", "source", (F.col("at") + 1).alias("pos"), "item_value", "flags")
