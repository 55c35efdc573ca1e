"""Operator 10, byte-level BPE encoding and decoding.

Pre-tokenisation runs on whole sub-batches without a regular expression. Every
code point becomes a symbol: its class (letter, number, space, other), refined by
what follows it (an apostrophe that begins a contraction, a space that belongs to
the next word). A symbol is a function from automaton state to automaton state.
Functions are numbered as elements of their finite monoid, so composing two is one table
look-up and associative: a blocked scan composes each block, then the blocks, then
replays each block from its entry state. State and symbol decide where a slice begins.

The slices tile the texts, so they are dictionary-encoded in place; only distinct
slices meet the pair merging, which is cached for the life of a Python worker. The
byte offset of every token is kept, which lets any run of tokens be decoded into its
place in the text.

Defined cases: null text gives null tokens and offsets, and n_tokens null; empty text gives empty
arrays. Strings that name special tokens are ordinary text. Repeated rows are
encoded alike. Only the columns named are read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import cluster, kernel

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SUB_BATCH = 1 << 20
#: Distinct slices that a worker remembers; beyond it starts afresh, which changes no result.
CACHE_ENTRIES = 200_000

# states: what the slice in progress is
LETTER, NUMBER, OTHER, ONE_MORE, TWO_MORE, DONE, SPACE, PREFIX = range(8)
# symbols; the second eight are the same at the start of a text
S_LETTER, S_NUMBER, S_OTHER, S_APOS1, S_APOS2, S_SPACE, S_PREFIX, S_CUT = range(8)
_STATES = 8


def _symbols() -> list[tuple[int, ...]]:
    const = lambda s: (s,) * _STATES
    letter = [LETTER] * _STATES
    letter[TWO_MORE], letter[ONE_MORE] = ONE_MORE, DONE
    apostrophe = {1: [ONE_MORE] * _STATES, 2: [TWO_MORE] * _STATES}
    for f in apostrophe.values():
        f[OTHER] = f[PREFIX] = OTHER
    base = [tuple(letter), const(NUMBER), const(OTHER), tuple(apostrophe[1]), tuple(apostrophe[2]), const(SPACE), const(PREFIX), const(SPACE)]
    return base + [const(f[DONE]) for f in base]


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, elements composed (first, then second), and element applied to state."""
    symbols = _symbols()
    elements = list(dict.fromkeys([tuple(range(_STATES)), *symbols]))
    i = 0
    while i < len(elements):
        for g in symbols:
            h = tuple(g[s] for s in elements[i])
            if h not in elements:
                elements.append(h)
        i += 1
    number = {f: k for k, f in enumerate(elements)}
    compose = np.array([[number.get(tuple(g[s] for s in f), 0) for g in elements] for f in elements], np.uint8)
    return np.array([number[f] for f in symbols], np.uint8), compose.ravel(), np.array(elements, np.uint8).ravel()


def scan(elements: np.ndarray, block: int = 256) -> np.ndarray:
    """The state before each element, from DONE at first."""
    _, compose, apply = monoid()
    size = len(compose)
    width = int(round(size**0.5))
    n = len(elements)
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    entry = np.full(rows, DONE, np.uint8)
    if rows > 1:
        total = grid[0].astype(np.intp)
        for j in range(1, block):
            total = compose[total * width + grid[j]].astype(np.intp)
        entry = scan(total.astype(np.uint8), block)
    before = np.empty_like(grid)
    state = entry.astype(np.intp)
    for j in range(block):
        before[j] = state
        state = apply[grid[j].astype(np.intp) * _STATES + state].astype(np.intp)
    return np.ascontiguousarray(before.T).ravel()[:n]


_SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    out = np.full(kernel.N_CODES, S_OTHER, np.uint8)
    for c in range(kernel.N_CODES):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = S_LETTER
        elif kind == "N":
            out[c] = S_NUMBER
    out[list(_SPACES)] = S_SPACE
    return out


def boundaries(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True at every code point that begins a slice."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[cp]
    first = np.zeros(n + 3, bool)
    first[starts[starts < n]] = True
    first[n:] = True
    symbol = kind.copy()
    space = kind == S_SPACE
    after = np.zeros(n, bool)  # the next code point is of the same text and not a space
    after[:-1] = ~space[1:] & ~first[1:n]
    symbol[space & after] = S_CUT
    symbol[space & after & (cp == 32)] = S_PREFIX
    at = np.flatnonzero(cp == 39)
    if len(at):
        pad = np.concatenate((cp, np.zeros(2, cp.dtype)))
        x, y = pad[at + 1], pad[at + 2]
        one = ~first[at + 1] & np.isin(x, [ord(c) for c in "stmd"])
        two = ~first[at + 1] & ~first[at + 2] & (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
        symbol[at[one]] = S_APOS1
        symbol[at[two]] = S_APOS2
    lead = first[:n]
    state = scan(monoid()[0][symbol + (lead * np.uint8(8))])
    begins = _begins()[symbol.astype(np.intp) * _STATES + state]
    return begins | lead


@cache
def _begins() -> np.ndarray:
    """By symbol and state before it: does a slice begin here?"""
    inside = {S_LETTER: (LETTER, ONE_MORE, TWO_MORE, PREFIX), S_NUMBER: (NUMBER, PREFIX), S_OTHER: (OTHER, PREFIX), S_APOS1: (OTHER, PREFIX), S_APOS2: (OTHER, PREFIX), S_SPACE: (SPACE,), S_PREFIX: (), S_CUT: ()}
    return np.array([s not in inside[x] for x in range(8) for s in range(_STATES)])


class Encoder:
    """Pair merging by rank, with the results kept as one flat pool of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {r: t for t, r in ranks.items()}
        top = max(ranks.values()) + 1
        self.sizes = np.zeros(top, np.int64)
        for t, r in ranks.items():
            self.sizes[r] = len(t)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flat = np.frombuffer(b"".join(self.token_bytes.get(r, b"") for r in range(top)), np.uint8)
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 100:
            return self._merge_long(piece)
        get, none = ranks.get, len(self.sizes)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, n log n."""
        ranks, n = self.ranks, len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def lookup(self, pieces: list[bytes]) -> np.ndarray:
        """Pool entry of each piece, merging those not yet known."""
        if len(self.index) > CACHE_ENTRIES:
            self.clear()
        index, out = self.index, np.empty(len(pieces), np.int64)
        for k, p in enumerate(pieces):
            e = index.get(p)
            if e is None:
                e = index[p] = len(index)
                ids = self.merge(p)
                if e >= len(self.start):
                    self.start, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count))
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
                self.pool[self.used : self.used + len(ids)] = ids
                self.start[e], self.count[e] = self.used, len(ids)
                self.used += len(ids)
            out[k] = e
        return out

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat token ids, byte offset of each in its text, token starts of the rows (n + 1), and which rows decode to their bytes."""
        n = len(arr)
        cp, starts = kernel.codepoints(arr)
        data, byte_rows = kernel.raw(arr)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.ones(n, bool)
        where = np.flatnonzero(boundaries(cp, starts))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cuts = np.concatenate((lead[where], [len(data)])).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        entry = self.lookup(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        count = self.count[entry]
        last = np.cumsum(count)
        pos = np.repeat(self.start[entry] - (last - count), count) + np.arange(last[-1])
        ids = self.pool[pos]
        size = self.sizes[ids]
        offset = np.concatenate(([0], np.cumsum(size)))
        bound = np.searchsorted(offset[:-1], byte_rows[:-1], side="left")
        rows = np.concatenate((bound, [len(ids)])).astype(np.int64)
        same = self.decode(ids)
        wrong = np.concatenate(([0], np.cumsum(same != data))) if len(same) == len(data) else np.arange(len(data) + 1)
        fine = wrong[byte_rows[1:]] == wrong[byte_rows[:-1]]
        own = offset[:-1] - np.repeat(byte_rows[:-1], np.diff(rows))
        return ids, own.astype(np.int32), rows, fine

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        size = self.sizes[ids]
        last = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (last - size), size) + np.arange(last[-1] if len(last) else 0)]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_encoders: dict[int, Encoder] = {}


def encoder(file: bytes) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    key = hash(file)
    if key not in _encoders:
        _encoders[key] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a})
    return _encoders[key]


def decode_udf(file: bytes):
    """Column function: tokens -> text; null for null. Bytes that are not UTF-8, as a cut run of tokens may have, become U+FFFD."""

    def run(tokens: pa.Array) -> pa.Array:
        enc = encoder(file)
        return pa.array([None if x is None else enc.decode(np.asarray(x, np.int64)).tobytes().decode("utf-8", "replace") for x in tokens.to_pylist()], pa.string())

    return cluster.arrow_column(run, "string")


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, offsets, n_tokens and round_trip, a row for each row of docs. Rows leave in batches of at most `SUB_BATCH` bytes of text, so that a worker holds no more tokens than that."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    file = read_ranks(path)
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("tokens array<int>, offsets array<int>, n_tokens int, round_trip boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for b in batches:
            missing = b["text"].is_null().to_numpy(zero_copy_only=False)
            for i, j, sub in kernel.sub_batches(b["text"], SUB_BATCH):
                ids, offsets, rows, fine = enc.encode(sub)
                none = missing[i:j]
                bounds = pa.array(rows.astype(np.int32), mask=np.append(none, False))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, offsets)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), *lists, pa.array(np.diff(rows).astype(np.int32), mask=none), pa.array(fine, mask=none)], ["doc_id", "tokens", "offsets", "n_tokens", "round_trip"])
                del ids, offsets, rows, fine, bounds, lists
                kernel.release()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text, from doc_id and tokens."""
    return encoded.select("doc_id", decode_udf(read_ranks(path))(F.col("tokens")).alias("text"))
