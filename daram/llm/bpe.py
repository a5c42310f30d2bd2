"""Problem 8: encoding of the whole corpus with a public byte-level tokenizer.

The pre-tokens of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

are found without a regular expression. Code points become class symbols (with one character of lookahead),
every symbol is a function on the eight states of a small automaton, and the functions are composed by an
associative scan: within blocks column by column, over the blocks by doubling. The state before
each position tells whether a pre-token starts there. The slices go through a cache to the pair merging.

Defined results:
* null and empty texts have the empty list of ids (and no pieces);
* strings of special tokens in a text are ordinary text; no special tokens are added;
* every other text gives ids whose bytes joined are its UTF-8; texts of any length are taken whole;
* repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Unicode's White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: class of a code point, some with what follows.
SEP, LETTER, SHORT, LONG, NUMBER, OTHER, QUOTE, SPACE, SPACE_RUN, WHITE, WHITE_RUN = range(11)
# States: what the character before was.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, AFTER_QUOTE, HALF_SUFFIX = range(8)
N_STATES = 8
BLOCK = 256
CHUNK = 1 << 20
CACHE = 1 << 18
LONG_PIECE = 48


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a pre-token starts at the symbol)."""
    if symbol == SEP:
        return FRESH, True
    if symbol in (SPACE, SPACE_RUN, WHITE, WHITE_RUN):
        inside = state == IN_WHITE and symbol in (SPACE_RUN, WHITE_RUN)  # the last of a run before a visible character stands alone
        return (AFTER_SPACE if symbol == SPACE else IN_WHITE), not inside
    if state == HALF_SUFFIX:
        return FRESH, False
    if symbol in (LETTER, SHORT, LONG):
        if state == AFTER_QUOTE and symbol != LETTER:
            return (FRESH if symbol == SHORT else HALF_SUFFIX), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if state in (IN_OTHER, AFTER_SPACE, AFTER_QUOTE):
        return IN_OTHER, False
    return (AFTER_QUOTE if symbol == QUOTE else IN_OTHER), True


class _Automaton:
    """Classes, the symbols' functions, their closure under composition and its table."""

    def __init__(self) -> None:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c == "L":
                kinds[cp] = LETTER
            elif c == "N":
                kinds[cp] = NUMBER
        kinds[WHITE_SPACE] = WHITE
        self.kinds = kinds
        functions = [tuple(_step(s, a)[0] for s in range(N_STATES)) for a in range(11)]
        self.starts = np.array([[_step(s, a)[1] for a in range(11)] for s in range(N_STATES)])
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(N_STATES)), *functions]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in list(dict.fromkeys(functions)):
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        members = list(known)
        self.of_symbol = np.array([known[f] for f in functions], np.uint16)
        self.compose = np.array([[known[tuple(g[x] for x in f)] for g in members] for f in members], np.uint16)
        self.from_fresh = np.array([f[FRESH] for f in members], np.uint8)

    def symbols(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbol of each code point; ``ends`` are the places of the separators."""
        out = self.kinds[codes]
        out[ends] = SEP
        following = np.empty_like(out)
        following[:-1], following[-1] = out[1:], SEP
        visible = (following != WHITE) & (following != SEP)
        after = np.empty_like(codes)
        after[:-1], after[-1] = codes[1:], 0
        white = out == WHITE
        blank = white & (codes == 0x20)
        out[white & ~visible] = WHITE_RUN
        out[blank & visible], out[blank & ~visible] = SPACE, SPACE_RUN
        live = out != SEP
        out[live & (codes == 0x27)] = QUOTE
        out[np.isin(codes, [ord(c) for c in "stmd"]) & live] = SHORT
        at_e = (after == ord("e")) & ((codes == ord("r")) | (codes == ord("v")))
        out[(at_e | (after == ord("l")) & (codes == ord("l"))) & live & (following != SEP)] = LONG
        return out

    def piece_starts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each place."""
        symbols = self.symbols(codes, ends)
        n = len(symbols)
        rows = -(-n // BLOCK)
        part = np.zeros((rows, BLOCK), np.uint16)  # 0 is the identity
        part.ravel()[:n] = self.of_symbol[symbols]
        part = np.ascontiguousarray(part.T)
        for j in range(1, BLOCK):
            part[j] = self.compose[part[j - 1], part[j]]
        before = np.zeros(rows, np.uint16)
        before[1:] = part[-1, :-1]
        step = 1
        while step < rows:
            before[step:] = self.compose[before[:-step], before[step:]]
            step *= 2
        whole = self.compose[before[None, :], part].T.ravel()[:n]
        state = np.empty(n, np.uint8)
        state[0], state[1:] = FRESH, self.from_fresh[whole[:-1]]
        return self.starts[state, symbols]


class Encoder:
    """Encoder over the ranks of a vocabulary; one per worker and vocabulary."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.automaton = _Automaton()
        self._clear()

    def _clear(self) -> None:
        """The cache: a number for every piece, and the ids of all numbered pieces one behind the other."""
        self.number: dict[str, int] = {}
        self.fresh: list[tuple[int, ...]] = []
        self.lengths = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Pair merging of one piece, lowest rank first, leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, sys.maxsize) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) != sys.maxsize:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], sys.maxsize)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], sys.maxsize)
        return tuple(map(ranks.__getitem__, parts))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and links, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n + [False]
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or end[i] != j or end[j] != k:
                continue
            end[i], alive[j] = k, False
            if k < n:
                prev[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:k])) is not None:
                heapq.heappush(heap, (r, p, i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _add(self, piece: str) -> int:
        self.fresh.append(self.merge(piece.encode("utf-8")))
        self.number[piece] = n = len(self.number)
        return n

    def _pieces(self, joined: str, codes: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text cut before every start: a sign that doesn't occur is put there, then the text is split at it."""
        sign = next(c for c in range(0x10FFFF, 0xE000, -1) if chr(c) not in joined)
        marked = np.insert(codes, starts, np.uint32(sign))
        return marked.tobytes().decode("utf-32-le").split(chr(sign))[1:]

    def encode(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, or None unless wanted; tokens per piece; start of each piece within its text; pieces per text)."""
        if len(self.number) >= CACHE or len(self.tokens) >= 8 * CACHE:
            self._clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(self.automaton.piece_starts(codes, ends))
        text_of = np.searchsorted(ends, starts, "left")
        inside = starts != ends[text_of]
        pieces = itertools.compress(self._pieces(joined, codes, starts), inside.tolist())
        starts, text_of = starts[inside], text_of[inside]
        get, add = self.number.get, self._add
        numbers = np.fromiter([n if (n := get(p)) is not None else add(p) for p in pieces], np.int64, len(starts))
        if self.fresh:
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))])
            self.tokens = np.concatenate([self.tokens, np.fromiter(itertools.chain.from_iterable(self.fresh), np.int32)])
            self.fresh = []
        per_piece = self.lengths[numbers]
        flat = None
        if ids:  # places in the table of ids: where a piece begins there, less where it begins here, plus the place here
            shift = (np.cumsum(self.lengths) - self.lengths)[numbers] - (np.cumsum(per_piece) - per_piece)
            flat = self.tokens[np.repeat(shift, per_piece) + np.arange(per_piece.sum())]
        return flat, per_piece, (starts - (ends - sizes)[text_of]).astype(np.int32), np.bincount(text_of, minlength=len(texts))


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """The worker's encoder of a broadcast vocabulary."""
    if (key := vocabulary.value[0]) not in _encoders:
        _encoders[key] = Encoder(vocabulary.value[1])
    return _encoders[key]


def _chunks(texts: list):
    """Ranges of rows of at most CHUNK characters together (a longer text is a range of its own)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def _lists(values: np.ndarray, per_row: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(values))


def _per_text(per_piece: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(per_piece)])
    at = np.concatenate([[0], np.cumsum(pieces)])
    return sums[at[1:]] - sums[at[:-1]]


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The ranks file (a fixed size of about 1 MB) as a broadcast; only the driver reads the path."""
    import zlib

    ship(spark)
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((zlib.crc32(data), data))


def encode(rows: DataFrame, key: str, text: str, path: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(key, ids), with ``offsets`` also the pieces' starts in the text and their numbers of tokens. No shuffle."""
    ranks = vocabulary(rows.sparkSession, path)
    schema = f"{key} bigint, ids array<int>" + ", piece_starts array<int>, piece_tokens array<int>" * offsets

    def run(batches):
        encoder = _encoder(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                flat, per_piece, starts, pieces = encoder.encode([t or "" for t in texts[a:b]])
                cols = [batch.column(0)[a:b], _lists(flat, _per_text(per_piece, pieces))]
                if offsets:
                    cols += [_lists(starts, pieces), _lists(per_piece.astype(np.int32), pieces)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "piece_starts", "piece_tokens"][: len(cols)])

    return rows.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).mapInArrow(run, schema)


def count_tokens(rows: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row, 0 for null and empty texts."""
    ranks = vocabulary(rows.sparkSession, path)

    def run(batches):
        encoder = _encoder(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                _, per_piece, _, pieces = encoder.encode([t or "" for t in texts[a:b]], ids=False)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(_per_text(per_piece, pieces), pa.int64())], names=[key, "n_tokens"])

    return rows.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).mapInArrow(run, f"{key} bigint, n_tokens bigint")


def decode(rows: DataFrame, key: str, path: str = VOCABULARY) -> DataFrame:
    """(key, text) of rows (key, ids); ids beyond the vocabulary are an error."""
    ranks = vocabulary(rows.sparkSession, path)

    def run(batches):
        pieces = {i: b for b, i in _encoder(ranks).ranks.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.select(F.col(key).cast("bigint").alias(key), "ids").mapInArrow(run, f"{key} bigint, text string")
