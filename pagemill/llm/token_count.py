"""Token counts by compiled finite-state transducers, without building token lists.

Two transducers are compiled from a byte-level BPE file:

* ``Splitter``: 13 states over 11 character classes; a transition's output says whether a part starts at this character
  or at the one before. A text is cut into chunks; each chunk maps every entry state to an exit state, the maps are composed by
  a parallel prefix scan, and with the entry states known all chunks write their outputs at once.
* ``Counter``: inside a part, a deterministic byte transducer. A state holds what later tokens can depend on: the longest suffix
  that a longer token continues, with the last token and relative count at each place where such a token may begin. A transition's
  annotation is the change of the token count. States are compiled when first reached and kept in a dense table; all
  parts of a batch step through it together.

The counts equal those of the tokenizers library. Special tokens' strings count as one token and cut the text, as there by default.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each get their count; an empty table gives
an empty result; a null doc_id stays null; very long texts are worked in slices that end before a space; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT = 1024
#: Characters in a chunk of the splitter, and in a batch.
CHUNK = 256
BATCH = 4 << 20
#: Cells of the counter's table, 5 bytes each; beyond, it is dropped and compiled anew (a cache bound, never a limit of the result).
MAX_CELLS = 48 << 20

# Character classes.
STMD, R, V, L, E, LETTER, NUMBER, SPACE, OTHER_SPACE, APOSTROPHE, OTHER = range(11)
# States: start; in letters, numbers, others; one space, one other space, a run ending in a space, in another; an apostrophe that may begin a
# contraction, and the same after r, v, l; a finished contraction.
S0, LET, NUM, OTH, SP1, WS1, SPN, WSN, AP, AP_R, AP_V, AP_L, DONE = range(13)
#: Outputs: a part starts here; a part starts one character before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by [state, class] of the pattern for contractions, letters, numbers, others and spaces."""
    to, out = np.zeros((13, 11), np.int8), np.zeros((13, 11), np.uint8)

    def fresh(c: int) -> int:
        if c <= LETTER:
            return LET
        return {NUMBER: NUM, SPACE: SP1, OTHER_SPACE: WS1, APOSTROPHE: AP, OTHER: OTH}[c]

    for c in range(11):
        kind = fresh(c)
        for s in range(13):
            to[s, c], out[s, c] = kind, HERE
        for s, same in ((LET, c <= LETTER), (NUM, c == NUMBER), (OTH, c in (APOSTROPHE, OTHER))):
            if same:
                to[s, c], out[s, c] = s, 0
        if c in (SPACE, OTHER_SPACE):
            for s in (SP1, WS1, SPN, WSN):
                to[s, c], out[s, c] = (SPN if c == SPACE else WSN), 0
        else:
            for s in (SP1, SPN):  # the last space joins what follows; an apostrophe after it begins no contraction
                to[s, c] = OTH if c == APOSTROPHE else kind
                out[s, c] = 0 if s == SP1 else BEFORE
            to[WSN, c], out[WSN, c] = kind, HERE | BEFORE
        if c in (APOSTROPHE, OTHER):
            to[AP, c], out[AP, c] = OTH, 0
        if c in (STMD, R, V, L):
            to[AP, c] = {STMD: DONE, R: AP_R, V: AP_V, L: AP_L}[c]
            out[AP, c] = 0
        for s, want in ((AP_R, E), (AP_V, E), (AP_L, L)):
            if c == want:
                to[s, c], out[s, c] = DONE, 0
            elif c <= LETTER:
                to[s, c], out[s, c] = LET, BEFORE
            else:
                out[s, c] = HERE | BEFORE
    return to, out


def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    category = unicodedata.category
    for i in range(sys.maxunicode + 1):
        k = category(chr(i))[0]
        if k == "L":
            table[i] = LETTER
        elif k == "N":
            table[i] = NUMBER
    for i in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[i] = OTHER_SPACE
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    for chars, c in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in chars:
            table[ord(x)] = c
    return table


def part_starts(kinds: np.ndarray, begins: np.ndarray, to: np.ndarray, out: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a part starts at each character. ``begins`` marks the first character of each text, where the state is S0."""
    n = len(kinds)
    width = -(-n // chunk)
    # classes from 11 on: the same character as the first of a text
    symbol = np.zeros(width * chunk, np.intp)
    symbol[:n] = kinds
    symbol[:n] += 11 * begins
    step = np.concatenate([to, np.broadcast_to(to[S0], to.shape)], axis=1).astype(np.intp).reshape(-1)
    said = np.concatenate([out, np.broadcast_to(out[S0], out.shape)], axis=1).reshape(-1)
    lanes = np.ascontiguousarray(symbol.reshape(width, chunk).T)
    # Maps of the chunks. A chunk whose states have all met goes on with one state.
    one, open_, maps = np.zeros(width, np.intp), np.arange(width), np.broadcast_to(np.arange(13), (width, 13)).copy()
    for i, row in enumerate(lanes):
        one = step[one * 22 + row]
        if len(open_):
            maps = step[maps * 22 + row[open_, None]]
            if i % 8 == 7:
                met = (maps == maps[:, :1]).all(axis=1)
                one[open_[met]] = maps[met, 0]
                open_, maps = open_[~met], maps[~met]
    whole = np.repeat(one[:, None], 13, axis=1)
    whole[open_] = maps
    maps, reach = whole, 1
    while reach < width:  # prefix scan: maps[i] becomes the map of chunks 0..i
        ahead = maps.copy()
        ahead[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        maps, reach = ahead, 2 * reach
    state = np.concatenate(([S0], maps[:-1, S0]))
    said_all = np.empty((chunk, width), np.uint8)
    for i, row in enumerate(lanes):
        key = state * 22 + row
        said_all[i], state = said[key], step[key]
    said_all = said_all.T.reshape(-1)[:n]
    starts = (said_all & HERE) > 0
    starts[:-1] |= (said_all[1:] & BEFORE) > 0
    return starts | begins


class Counter:
    """The byte transducer of one BPE file, compiled as it is used."""

    def __init__(self, vocab: dict[bytes, int]):
        self.vocab, self.token = vocab, {i: b for b, i in vocab.items()}
        self.prefixes = {b[:i] for b in vocab for i in range(1, len(b))}
        self.clear()

    def clear(self) -> None:
        """State 0 is the start of a part."""
        self.fits: dict[tuple[int, int], bool] = {}
        self.states: list[tuple] = [(b"", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.column = np.full(256, 255, np.uint8)
        self.bytes: list[int] = []
        self._table(4096, 64)

    def _table(self, rows: int, width: int) -> None:
        """A table with room for ``rows`` states and ``width`` different bytes, with the entries so far."""
        following, change = np.full((rows, width), -1, np.int32), np.zeros((rows, width), np.int8)
        if len(self.states) > 1:
            r, w = self.next.shape
            following[:r, :w], change[:r, :w] = self.next, self.change
        self.next, self.change = following, change

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table's column of each byte; bytes get columns as they first occur."""
        for b in np.nonzero(np.bincount(data, minlength=256))[0].tolist():
            if b not in self.bytes:
                self.column[b] = len(self.bytes)
                self.bytes.append(b)
        if len(self.bytes) > self.next.shape[1]:
            self._table(len(self.next), 128 if len(self.bytes) <= 128 else 256)
        return self.column[data]

    def encode(self, word: bytes) -> list[int]:
        """Plain merging by rank; used on pairs of tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.vocab.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.vocab[p] for p in parts]

    def follows(self, last: int | None, token: int) -> bool:
        """Whether ``token`` can stand after ``last`` (None: at the start of a part)."""
        key = (last, token)
        if key not in self.fits:
            word = (self.token[last] if last is not None else b"") + self.token[token]
            self.fits[key] = self.encode(word) == ([token] if last is None else [last, token])
        return self.fits[key]

    def compile(self, state: int, byte: int) -> None:
        """Fill one transition: of the tokens that end here exactly one stands rightly after what precedes it."""
        suffix, lasts, counts = self.states[state]
        grown = suffix + bytes([byte])
        for i in range(len(grown)):
            t = self.vocab.get(grown[i:]) if counts[i] is not None else None
            if t is not None and self.follows(lasts[i], t):
                break
        else:
            raise ValueError("no token ends here")
        count = counts[i] + 1
        use = [grown[j:] in self.prefixes for j in range(len(grown))] + [True]
        cut = use.index(True)
        kept = zip(use[cut:], (*lasts, t)[cut:], (*counts, count)[cut:])
        lasts, counts = zip(*((last, c - count) if u else (None, None) for u, last, c in kept))
        own = (grown[cut:], lasts, counts)
        at = self.number.get(own)
        if at is None:
            at = self.number[own] = len(self.states)
            self.states.append(own)
            if at == len(self.next):
                self._table(len(self.next) + min(len(self.next), 1 << 15), self.next.shape[1])
        column = self.column[byte]
        self.next[state, column], self.change[state, column] = at, count

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each part data[start : start + length]; parts of a batch step together, longest first."""
        if self.next.size > MAX_CELLS:
            self.clear()
        data, width = self._columns(data), self.next.shape[1]
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right") if len(lengths) else []
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for i, n in enumerate(live):
            key = state[:n] * width + data[starts[:n] + i]
            to = self.next.reshape(-1)[key]
            if (to < 0).any():
                for k in np.unique(key[to < 0]).tolist():
                    self.compile(k // width, self.bytes[k % width])
                to = self.next.reshape(-1)[key]
            total[:n] += self.change.reshape(-1)[key]
            state[:n] = to
        out = np.empty(len(starts), np.int64)
        out[order] = total
        return out


class Tokens:
    """Counts for the BPE file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.counter = Counter({bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special})
        self.to, self.out = _splitter()
        self.classes = _classes()

    def _batch(self, texts: list[str]) -> np.ndarray:
        """Tokens of each of some non-empty texts without special strings."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths) - lengths
        begins = np.zeros(len(points), bool)
        begins[first] = True
        starts = np.nonzero(part_starts(self.classes[points], begins, self.to, self.out))[0]
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(width) - width
        data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        begin = at[starts]
        found = self.counter.counts(data, begin, np.diff(np.append(begin, len(data))))
        return np.add.reduceat(found, np.searchsorted(starts, first))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text. Long texts are sliced before a space that follows no white space; there every state goes to the start."""
        total = np.zeros(len(texts), np.int64)
        pending, owner, size = [], [], 0

        def flush():
            nonlocal pending, owner, size
            if pending:
                np.add.at(total, owner, self._batch(pending))
            pending, owner, size = [], [], 0

        for i, text in enumerate(texts):
            pieces = [text] if text else []
            for s in self.special:
                if text and s in text:
                    cut = [p.split(s) for p in pieces]
                    total[i] += sum(len(c) - 1 for c in cut)
                    pieces = [x for c in cut for x in c if x]
            for p in pieces:
                while len(p) > BATCH:
                    at = p.find(" ", BATCH)
                    while at > 0 and p[at - 1].isspace():
                        at = p.find(" ", at + 1)
                    if at <= 0:
                        break
                    pending.append(p[:at])
                    owner.append(i)
                    p = p[at:]
                    flush()
                pending.append(p)
                owner.append(i)
                size += len(p)
                if size >= BATCH:
                    flush()
        flush()
        return total


_loaded: dict[str, Tokens] = {}


def loaded(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs(doc_id, text)``; one pass, no shuffle."""
    path = path or default_path()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = loaded(path).count
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n_bytes": f["n_bytes"], "n_tokens": count(f["text"].tolist())})

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    found = sized.mapInPandas(compute, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
