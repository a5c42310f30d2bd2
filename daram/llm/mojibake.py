"""Problem 10: text garbled by a wrong character encoding.

For every pair (encoding written, encoding read) the garbled sequence of each character of a repertoire is
precomputed. One multi-pattern automaton (Aho-Corasick) holds them all; it is run over whole
texts, leftmost and longest first. Matches close to each other are a passage of their pair; a passage counts once its
evidence suffices, and only its matched spans are replaced, so that correct text beside it stays untouched.

CP949 read as UTF-8 loses most bytes; what stays are characters that the bytes of neighbouring syllables happen to form. These are generated
from the bytes of the syllables; a passage counts if nearly all letters of its range in it can be formed so and don't stand in words with Latin ones.
Marks on Latin letters are no evidence, and other scripts (Cyrillic, Armenian, Hebrew, Arabic, Latin letters with marks) hold letters that no syllables form.

Pairs that lose bytes (replacement characters, dropped bytes) can't be undone as a whole: their passages are found and kept. In UTF-8 read as
cp949, ``restore`` gives back the runs in which every byte of whole characters is left; what stands beside lost bytes is kept.

Reading by Shift-JIS is no pair: in nearly every text it loses bytes. A single character read by a seldom reader (Mac, CP437) is no evidence; two syllables side by side are.

Defined results: null gives null and no passage; empty and blank texts are sound; a text without passages comes back
as it is; texts are run over whole, whatever their length; repeated rows give equal results.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daram.session import ship

GAP = 24
LONGEST = 16
UNFORMED = 0.1


@dataclass(frozen=True)
class Pair:
    """Written in one encoding, read in another, ``times`` over. ``least``: evidence a passage needs; ``side_by_side``: matches in one run that count as enough."""

    name: str
    written: str
    read: str
    times: int = 1
    least: int = 1
    side_by_side: int = 1


PAIRS = (
    Pair("utf8_latin1", "utf-8", "latin-1"), Pair("utf8_cp1252", "utf-8", "cp1252"),
    Pair("utf8_latin1_twice", "utf-8", "latin-1", 2), Pair("utf8_cp1252_twice", "utf-8", "cp1252", 2),
    Pair("cp949_latin1", "cp949", "latin-1", least=2, side_by_side=2), Pair("cp949_cp1252", "cp949", "cp1252", least=2, side_by_side=2),
    Pair("cp949_gbk", "cp949", "gbk", least=4, side_by_side=4),
    Pair("utf8_mac", "utf-8", "mac-roman", least=2, side_by_side=2), Pair("utf8_cp437", "utf-8", "cp437", least=2, side_by_side=2),
)
SYLLABLES = [chr(c) for c in range(0xAC00, 0xD7A4)]
SELDOM = ("mac-roman", "cp437")  # readers with an automaton of their own, so that their sequences don't hide those of the others; syllables and other characters only
KS_SYLLABLES = [s for s in SYLLABLES if len(b := s.encode("cp949")) == 2 and b[0] >= 0xB0 and b[1] >= 0xA1]
# Further characters of the corpus that several bytes write: Latin letters and signs, Hangul letters, punctuation, enclosed numbers, CJK signs, Greek, Cyrillic, kana, hanja of the basic set.
OTHERS = [chr(c) for r in ((0xA0, 0x180), (0x391, 0x3CA), (0x401, 0x460), (0x1100, 0x1200), (0x2010, 0x2028), (0x2030, 0x203C), (0x20A9, 0x20AD), (0x2103, 0x2123), (0x2150, 0x2180), (0x2190, 0x21D5), (0x2200, 0x2290), (0x2460, 0x2500), (0x25A0, 0x2670), (0x3000, 0x3020), (0x3041, 0x3100), (0x3131, 0x3164), (0x3200, 0x3400), (0xFF01, 0xFF5F)) for c in range(*r)]
HANJA = [chr(c) for c in range(0x4E00, 0x9FA6)]
EMOJI = [chr(c) for r in ((0x2600, 0x27C0), (0x1F300, 0x1F650), (0x1F680, 0x1F700), (0x1F900, 0x1FA00), (0xFE00, 0xFE10)) for c in range(*r)]
CJK = range(0x3400, 0xA000)
UNBROKEN = re.compile("[^\x00-\x7f\ufffd]+")
LOST = re.compile("\ufffd+")


def _read(data: bytes, encoding: str) -> str | None:
    """Bytes as the reader saw them; cp1252's five unused bytes come out as control characters."""
    if encoding == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def garbled(char: str, pair: Pair) -> str | None:
    text = char
    for _ in range(pair.times):
        try:
            text = _read(text.encode(pair.written), pair.read)
        except UnicodeEncodeError:
            return None
        if text is None:
            return None
    return text if text != char else None


def sequences():
    """(garbled sequence, pair's place, original) of all pairs, then the sequences of the pairs that lose bytes with no original."""
    for i, pair in enumerate(PAIRS):
        repertoire = KS_SYLLABLES if pair.read == "gbk" else SYLLABLES + OTHERS if pair.read in SELDOM else SYLLABLES + OTHERS + HANJA + EMOJI
        for c in repertoire:
            if pair.written == "cp949" and not c.isascii() and 0xA0 <= ord(c) < 0x180:
                continue
            g = garbled(c, pair)
            if g and len(g) > 1 or g and pair.read == "gbk":
                yield g, i, c
    # UTF-8 read as cp949: a syllable's first two bytes are one character, its third pairs with what follows or breaks
    follow = [0xEA, 0xEB, 0xEC, 0xED, 0xE2]
    for s in SYLLABLES:
        b = s.encode("utf-8")
        broken = b.decode("cp949", "replace")  # a first byte that starts nothing breaks, the other two are one character
        if len(broken) == 2 and broken[0] == "�":
            yield broken, LOSSY_CP949, None
        head = b[:2].decode("cp949", "replace")
        if len(head) == 1 and ord(head) in CJK:
            for f in follow:
                tail = bytes([b[2], f]).decode("cp949", "replace")
                if len(tail) == 1:
                    yield head + tail, LOSSY_CP949, None
            yield head + "�", LOSSY_CP949, None
            yield "�" + head, LOSSY_CP949, None
    for c in formed():
        yield c, LOSSY_UTF8, None
    yield "��", BROKEN, None


def formed() -> set[str]:
    """Characters of two bytes, beyond Latin-1, that bytes of syllables form when CP949 is read as UTF-8: both of one syllable, or the last of one and the first of the next."""
    firsts, lasts = {s.encode("cp949")[0] for s in KS_SYLLABLES}, {s.encode("cp949")[1] for s in KS_SYLLABLES}
    pairs = [bytes([a, b]) for a, b in [*((a, b) for a in firsts for b in lasts), *((a, b) for a in lasts for b in firsts)] if 0xC4 <= a < 0xE0 and 0x80 <= b < 0xC0]
    return {p.decode("utf-8") for p in pairs}


LOSSY_CP949, LOSSY_UTF8, BROKEN = len(PAIRS), len(PAIRS) + 1, len(PAIRS) + 2
NAMES = [*(p.name for p in PAIRS), "utf8_cp949", "cp949_utf8", "replaced"]
LEAST = [*(p.least for p in PAIRS), 2, 3, 1]
SIDE = [*(p.side_by_side for p in PAIRS), 1, 1, 1]


class Finder:
    """The automaton; one per worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.parts = []
        parts: tuple[dict, dict] = {}, {}
        for g, pair, original in sequences():
            seldom = pair < len(PAIRS) and PAIRS[pair].read in SELDOM
            parts[seldom].setdefault(g, []).append((pair, original))
        for part in parts:
            automaton = ahocorasick.Automaton()
            for g, meanings in part.items():
                automaton.add_word(g, (len(g), tuple(meanings)))
            automaton.make_automaton()
            # every sequence holds a sign that is neither ASCII nor a syllable, so the automaton need only run around these
            signs = {c for g in part for c in g if not (c.isascii() or 0xAC00 <= ord(c) < 0xD7A4)}
            self.parts.append((automaton, re.compile("[" + re.escape("".join(sorted(signs))) + "]+")))
        # pairs of seldom readers need two syllables side by side, three characters each: texts without that aren't run a second time
        leads = ["".join({garbled(c, p)[0] for c in SYLLABLES}) for p in PAIRS if p.read in SELDOM]
        self.seldom = re.compile("|".join(f"[{re.escape(x)}][^\x00-\x7f]{{2}}[{re.escape(x)}]" for x in leads))
        gbk = next(p for p in PAIRS if p.read == "gbk")
        self.gbk_signs = {g: c for c in OTHERS if (g := garbled(c, gbk)) and len(g) == 1 and not "가" <= g <= "힣"}
        formable = formed()
        self.unformed = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x100, 0x800)) if c not in formable and not 0x370 <= ord(c) < 0x3D0 and c.isalpha())) + "]")

    def matches(self, text: str):
        """All matches of each automaton, leftmost and longest first. Between stretches around signs no sequence can lie, so they are left out."""
        for automaton, sign in self.parts[: 2 if self.seldom.search(text) else 1]:
            start, end = 0, -1
            for m in sign.finditer(text):
                if (begin := max(0, m.start() - LONGEST)) > end:
                    if end >= 0:
                        yield from automaton.iter_long(text, start, end)
                    start = begin
                end = min(len(text), m.end() + LONGEST)
            if end >= 0:
                yield from automaton.iter_long(text, start, end)

    def passages(self, text: str) -> list[tuple[str, int, int, list]]:
        """(pair, start, end, [(start, end, original)]) of every passage with enough evidence."""
        hits: dict[int, list] = {}
        for last, (n, meanings) in self.matches(text):
            for pair, original in meanings:
                hits.setdefault(pair, []).append((last + 1 - n, last + 1, original))
        out = []
        for pair, found in hits.items():
            run: list = []
            for h in found:
                if run and h[0] - run[-1][1] > GAP:
                    out += self._sure(text, pair, run)
                    run = []
                run.append(h)
            out += self._sure(text, pair, run)
        return self._choose(out)

    def _sure(self, text: str, pair: int, run: list) -> list:
        if len(run) < LEAST[pair]:
            return []
        if pair == LOSSY_UTF8:  # letters in Latin words are no evidence, nor are those that stand among others of their range that no syllables form; Greek letters are written on purpose
            run = [h for h in run if not 0x370 <= ord(text[h[0]]) < 0x400 and not _in_latin_word(text, h[0])]
            if len(run) < LEAST[pair] or len({ord(text[h[0]]) >> 7 for h in run}) < 2:  # one block of letters is a script, several side by side are not
                return []
            start, end = run[0][0], run[-1][1]
            while start and text[start - 1].isalpha():
                start -= 1
            while end < len(text) and text[end].isalpha():
                end += 1
            if len(self.unformed.findall(text, start, end)) > len(run) * UNFORMED:
                return []
        if pair < len(PAIRS) and PAIRS[pair].read == "gbk":  # whole words of hanja must read as syllables; hanja written on purpose don't
            if len(_whole_words(text, run, 2)) < LEAST[pair]:
                return []
            run = _whole_words(text, run, 1)
            signs = self.gbk_signs  # single signs among the words went the same way
            run = sorted([*run, *((i, i + 1, signs[text[i]]) for i in range(run[0][0], run[-1][1]) if text[i] in signs)], key=lambda h: h[0])
        elif SIDE[pair] > 1:  # Latin letters in a row may read as hanja by chance; syllables side by side are the evidence
            syllables = [h for h in run if h[2] and "가" <= h[2] <= "힣"]
            if len(syllables) < LEAST[pair] or not any(a[1] == b[0] for a, b in zip(syllables, syllables[1:])):
                return []
        return [(NAMES[pair], run[0][0], run[-1][1], run)]

    @staticmethod
    def _choose(found: list) -> list:
        """Of passages that claim the same spans, or the same stretch where a seldom reader is one of them, the one with the longer spans counts; of equals the one named first."""
        seldom = {p.name for p in PAIRS if p.read in SELDOM}
        kept: list = []
        for p in sorted(found, key=lambda p: (-sum(b - a for a, b, _ in p[3]), NAMES.index(p[0]))):
            spans = {a for a, _, _ in p[3]}
            if not any(p[1] < k[2] and k[1] < p[2] and (p[0] in seldom or k[0] in seldom or spans & {a for a, _, _ in k[3]}) for k in kept):
                kept.append(p)
        return sorted(kept, key=lambda p: p[1])

    def repair(self, text: str, partly: bool = False) -> tuple[str, list]:
        """(text with the spans of restorable passages replaced, its passages). ``partly`` also replaces the whole characters left in UTF-8 read as cp949."""
        passages = self.passages(text)
        if partly:
            passages = [(*p[:3], _left_whole(text, p)) if p[0] == NAMES[LOSSY_CP949] else p for p in passages]
        spans = sorted(s for p in passages for s in p[3] if s[2] is not None)
        out, at = [], 0
        for a, b, original in spans:
            if a < at:
                continue
            out += (text[at:a], original)
            at = b
        return "".join((*out, text[at:])), passages


def _left_whole(text: str, passage: tuple) -> list:
    """Spans of a passage of UTF-8 read as cp949: runs whose bytes are whole characters with their original, all else that was garbled with none."""
    _, start, end, run = passage
    while start and not text[start - 1].isascii():
        start -= 1
    while end < len(text) and not text[end].isascii():
        end += 1
    spans = []
    for m in UNBROKEN.finditer(text, start, end):
        i = m.start()
        while i < m.end():
            if original := _decoded(text, i, m.end()):
                spans.append((i, *original))
                i = original[0]
            else:
                i += 1
    covered = {i for a, b, _ in spans for i in range(a, b)}
    broken = [*((a, b) for a, b, _ in run if not covered.issuperset(range(a, b))), *(m.span() for m in LOST.finditer(text, start, end))]
    return sorted([*spans, *((a, b, None) for a, b in dict.fromkeys(broken))], key=lambda s: s[:2])


def _decoded(text: str, start: int, end: int) -> tuple[int, str] | None:
    """(end, original) of the longest run from here whose cp949 bytes are whole UTF-8 characters, a syllable among them."""
    data, best = bytearray(), None
    need = 0  # bytes that the last character still lacks
    for i in range(start, end):
        try:
            pair = text[i].encode("cp949")
        except UnicodeEncodeError:
            break
        for x in pair:
            if need:
                if not 0x80 <= x < 0xC0:
                    need = -1
                    break
                need -= 1
            elif x >= 0x80:
                need = 1 if 0xC2 <= x < 0xE0 else 2 if 0xE0 <= x < 0xF0 else 3 if 0xF0 <= x < 0xF5 else -1
                if need < 0:
                    break
        if need < 0:
            break
        data += pair
        if not need:
            try:
                original = data.decode("utf-8")
            except UnicodeDecodeError:
                break
            if any("가" <= c <= "힣" for c in original):
                best = i + 1, original
    return best


def _in_latin_word(text: str, at: int) -> bool:
    """Whether the letters around a place hold an ASCII letter."""
    for step in (-1, 1):
        i = at + step
        while 0 <= i < len(text) and i - at < LONGEST and at - i < LONGEST and (text[i].isalpha() or unicodedata.combining(text[i])):
            if text[i].isascii():
                return True
            i += step
    return False


def _whole_words(text: str, run: list, least: int) -> list:
    """Matches that fill a whole run of at least so many hanja."""
    keep: list = []
    word: list = []
    for h in [*run, (len(text) + 9, len(text) + 9, None)]:
        if word and h[0] != word[-1][1]:
            a, b = word[0][0], word[-1][1]
            clean = (a == 0 or ord(text[a - 1]) not in CJK) and (b >= len(text) or ord(text[b]) not in CJK)
            if clean and len(word) >= least:
                keep += word
            word = []
        word.append(h)
    return keep


_finder: list[Finder] = []
SCHEMA = pa.schema([("doc_id", pa.int64()), ("is_garbled", pa.bool_()), ("restorable", pa.bool_()), ("pairs", pa.list_(pa.string())), ("n_passages", pa.int32()), ("restored", pa.string())])
DDL = "doc_id bigint, is_garbled boolean, restorable boolean, pairs array<string>, n_passages int, restored string"


def _run(batches):
    if not _finder:
        _finder.append(Finder())
    for batch in batches:
        cols: list[list] = [[] for _ in SCHEMA]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fixed, passages = _finder[0].repair(text, partly=True) if text else (text, [])
            pairs = sorted({p[0] for p in passages})
            whole = all(s[2] is not None for p in passages for s in p[3])
            for c, v in zip(cols, (doc, bool(passages), bool(passages) and whole, pairs, len(passages), fixed)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)


def restore(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, is_garbled, restorable, pairs, n_passages, restored) of every document. No shuffle."""
    ship(documents.sparkSession)
    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_run, DDL)
