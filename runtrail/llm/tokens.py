"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary file.

Two deterministic transducers stand for the tokenizer:

* ``SPLITTER`` cuts text into pre-tokens. Its 12 states read classes of characters; a transition emits the boundaries that it
  settles, before its own character or before the one just read (a run of white space lends its last space to the next word).
  A slab of text is cut into chunks; the map from entry state to exit state of all chunks is computed in step, the maps are
  composed by a parallel prefix scan, and with the entry states known all chunks emit at once.
* ``Merger`` counts the tokens of a pre-token. Reading a byte, the last token of the BPE of the prefix read so far is the one
  suffix in the vocabulary that is compatible with the last token before it (two tokens are compatible if BPE leaves their
  bytes as these two); so the state is, for each place where a token may still be open, the open bytes, the last token before
  it and its count relative to now. A transition is annotated with the change of the token count, which may be zero or less.
  States and transitions are compiled when first met and kept up to a bound, as are the counts of short pre-tokens.
* Pre-tokens beyond ``LONG`` bytes have ever new states. They are cut into chunks whose maps are run side by side and composed
  (``longwords``); the compiled transducer takes those whose chunks do not agree.

Counts equal the library's without added special tokens. Strings of the vocabulary's own special tokens inside a text count as
one token each and split it. Defined results: null and empty texts have 0 bytes and 0 tokens. Long texts are cut where a single
space precedes a letter, which is a boundary whatever surrounds it.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns
from .longwords import LongWords

END, SP, WS, NUMBER, OTHER, APOSTROPHE, LETTER, ONE, RV, E, L = range(11)
START, LET, NUM, OTH, APO, APO_RV, APO_L, CON, SP1, SPN, WS1, WSN = range(12)
BEFORE, EARLIER = 1, 2
CHUNK = 256
SLAB = 1 << 19
#: Counts are remembered of pre-tokens of at most ``LONG`` bytes, so that ``MAX_WORDS`` of them are a bound in bytes.
LONG, MAX_WORDS, MAX_STATES = 64, 300_000, 100_000


def begins(symbol: int) -> int:
    return {SP: SP1, WS: WS1, NUMBER: NUM, OTHER: OTH, APOSTROPHE: APO}.get(symbol, LET)


def joins(symbol: int) -> int:
    """The state after a space that belongs to the pre-token of ``symbol``."""
    return {NUMBER: NUM, OTHER: OTH, APOSTROPHE: OTH}.get(symbol, LET)


def transition(state: int, symbol: int) -> tuple[int, int]:
    """(next state, boundaries emitted) of the splitter."""
    letter, space = symbol >= LETTER, symbol in (SP, WS)
    if symbol == END:
        return START, EARLIER if state in (APO_RV, APO_L) else 0
    if state in (SP1, SPN, WS1, WSN):
        if space:
            return (SPN if symbol == SP else WSN), 0
        late = EARLIER if state in (SPN, WSN) else 0
        return (joins(symbol), late) if state in (SP1, SPN) else (begins(symbol), late | BEFORE)
    if (state == APO_RV and symbol == E) or (state == APO_L and symbol == L):
        return CON, 0
    late = EARLIER if state in (APO_RV, APO_L) else 0
    if state in (LET, APO_RV, APO_L) and letter:
        return LET, late
    if state == NUM and symbol == NUMBER:
        return NUM, 0
    if state in (OTH, APO) and symbol in (OTHER, APOSTROPHE):
        return OTH, 0
    if state == APO and letter and symbol in (ONE, RV, L):
        return {ONE: CON, RV: APO_RV, L: APO_L}[symbol], 0
    return begins(symbol), late | BEFORE


NEXT = np.zeros(256, np.uint8)
EMIT = np.zeros(256, np.uint8)
for _s in range(12):
    for _x in range(11):
        NEXT[_s * 16 + _x], EMIT[_s * 16 + _x] = transition(_s, _x)


def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, symbol in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = symbol
    for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):  # White_Space
        table[c] = WS
    for chars, symbol in ((" ", SP), ("'", APOSTROPHE), ("stmd", ONE), ("rv", RV), ("e", E), ("l", L)):
        for c in chars:
            table[ord(c)] = symbol
    return table


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.take_along_axis(then, first, axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in as many rounds as the logarithm of their number."""
    done, maps = 1, maps.copy()
    while done < len(maps):
        maps[done:] = compose(maps[:-done], maps[done:])
        done *= 2
    return maps


def boundaries(symbols: np.ndarray) -> np.ndarray:
    """Places where a pre-token begins, and the places of END."""
    n = len(symbols)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.uint8)
    padded[:n] = symbols
    steps = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(12, dtype=np.uint8), (rows, 1))
    for column in steps:
        maps = NEXT[maps * np.uint8(16) + column[:, None]]
    state = np.concatenate((np.array([START], np.uint8), scan(maps)[:-1, START]))
    flags = np.empty_like(steps)
    for j, column in enumerate(steps):
        at = state * np.uint8(16) + column
        flags[j] = EMIT[at]
        state = NEXT[at]
    flags = flags.T.reshape(-1)[:n]
    starts = (flags & BEFORE).astype(bool)
    starts[:-1] |= (flags[1:] & EARLIER).astype(bool)
    return np.flatnonzero(starts | (symbols == END))


class Merger:
    """The token-count transducer, compiled from merges as its states are met."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.open = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fit: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: for each open place the open bytes, the last token before it (None at the start), its count less the present one.
        self.states: list[tuple] = [((b"", None, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[int, int]] = [{}]

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: bytes | None, token: bytes) -> bool:
        if before is None:
            return True
        known = self.fit.get((before, token))
        if known is None:
            if len(self.fit) > 250_000:
                self.fit.clear()
            known = self.fit[before, token] = self.merged(before + token) == [before, token]
        return known

    def compile(self, number: int, byte: int) -> int:
        """The transition of a state for a byte: the next state and the change of the count, packed."""
        state, b = self.states[number], bytes([byte])
        for held, before, count in state:  # longest open bytes first
            token = held + b
            if token in self.tokens and self.compatible(before, token):
                change, last = count + 1, token
                break
        else:
            raise ValueError("no token fits: the vocabulary lacks a byte")
        after = tuple((held + b, before, count - change) for held, before, count in state if held + b in self.open) + ((b"", last, 0),)
        to = self.numbers.get(after)
        if to is None:
            to = self.numbers[after] = len(self.states)
            self.states.append(after)
            self.moves.append({})
        packed = self.moves[number][byte] = to << 8 | (change + 128)
        return packed

    def count(self, data: bytes) -> int:
        moves, state, total = self.moves, 0, 0
        for byte in data:
            move = moves[state].get(byte)
            if move is None:
                move = self.compile(state, byte)
            state = move >> 8
            total += (move & 255) - 128
        return total


class Counter:
    """Splitter, merger and the counts of frequent pre-tokens; one per Python worker and vocabulary file."""

    _built: dict[str, "Counter"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        decode = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(decode(a), decode(b)) for a, b in pairs]
        self.merger = Merger(self.merges)
        self.long: LongWords | None = None
        special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.table = symbol_table()
        self.words: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls._built:
            cls._built[path] = cls(path)
        return cls._built[path]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; the slabs hold pieces of texts between special tokens and safe cuts."""
        totals = np.zeros(len(texts), np.int64)
        pieces, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in self.special.split(text) if self.special and text else [text or ""]:
                for part in cuts(piece):
                    pieces.append(part)
                    owners.append(i)
                    size += len(part)
                    if size >= SLAB:
                        self.add(totals, pieces, owners)
                        pieces, owners, size = [], [], 0
            if self.special and text:
                totals[i] += sum(1 for _ in self.special.finditer(text))
        self.add(totals, pieces, owners)
        return totals

    def add(self, totals: np.ndarray, pieces: list[str], owners: list[int]) -> None:
        if not pieces:
            return
        joined = "\0".join(pieces) + "\0"
        symbols = self.table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        symbols[ends] = END
        at = boundaries(symbols)
        real = np.flatnonzero(symbols[at[:-1]] != END)
        words, known, long = self.words, [], {}
        for a, b in zip(at[real].tolist(), at[real + 1].tolist()):
            word = joined[a:b]
            n = words.get(word)
            if n is None:
                data = word.encode("utf-8", "surrogatepass")
                if len(data) > LONG:
                    long.setdefault(data, []).append(len(known))
                    n = 0
                else:
                    n = words[word] = self.merger.count(data)
            known.append(n)
        for places, n in zip(long.values(), self.long_counts(list(long))):
            for place in places:
                known[place] = n
        np.add.at(totals, np.array(owners)[np.searchsorted(ends, at[real])], known)
        if len(words) > MAX_WORDS:
            words.clear()
        if len(self.merger.states) > MAX_STATES:
            self.merger.reset()


    def long_counts(self, words: list[bytes]) -> list[int]:
        if not words:
            return []
        self.long = self.long or LongWords(self.merges)
        found = self.long.counts(words).tolist() if self.long.usable else [-1] * len(words)
        out = []
        for word, n in zip(words, found):
            out.append(self.merger.count(word) if n < 0 else n)
            if len(self.merger.states) > MAX_STATES:
                self.merger.reset()
        return out


SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W\d_])")


def cuts(text: str) -> list[str]:
    """Pieces of about a slab each, cut before a single space between a letter or digit and a letter."""
    parts, lo = [], 0
    while len(text) - lo > SLAB:
        found = SAFE.search(text, lo + SLAB // 2)
        if not found:
            break
        parts.append(text[lo : found.start()])
        lo = found.start()
    return [*parts, text[lo:]] if lo else [text]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes and n_tokens; ``vocabulary`` is the path of the file on every executor."""

    def count(texts: list[str | None]) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array(Counter.of(vocabulary).counts(texts))}

    keep = docs.columns if keep is None else keep
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    return arrow_columns(sized, count, text_col, [("n_tokens", T.LongType())], [*[c for c in keep if c != "n_bytes"], "n_bytes"])


def token_digest(rows: DataFrame, limit: int = 1024) -> DataFrame:
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
