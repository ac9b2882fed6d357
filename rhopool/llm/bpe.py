"""Byte-level BPE over whole texts with a given rank file.

Text is cut by codepoint classes, not by a regular expression. Every codepoint is a transition function on four
states (an apostrophe that opens a token, and how much of a contraction has followed); composing functions is
associative, so a blockwise scan gives the state before each codepoint. Together with the neighbours' classes this
places the cuts of the usual pattern: contractions, an optional space before letters, numbers or other signs, and runs
of white space that leave their last character to what follows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.llm.words import span_hashes, text_blocks

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
# The codepoints of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE = 200_000        # pieces kept in a task before the cache starts anew
LONG = 128             # bytes from which a piece is merged with a heap
BLOCK = 1 << 20

IDLE, OPEN, PENDING_E, PENDING_L = range(4)


def _function(*to: int) -> int:
    return sum(t << (2 * s) for s, t in enumerate(to))


CONSTANT, STARTS = _function(IDLE, IDLE, IDLE, IDLE), _function(OPEN, OPEN, OPEN, OPEN)
AFTER_RV = _function(IDLE, PENDING_E, IDLE, IDLE)
AFTER_L = _function(IDLE, PENDING_L, IDLE, IDLE)
IDENTITY = _function(IDLE, OPEN, PENDING_E, PENDING_L)
_all = np.arange(256)
#: _THEN[f * 256 + g]: first f, then g.
_THEN = sum((((_all[None, :] >> (2 * ((_all[:, None] >> (2 * s)) & 3))) & 3) << (2 * s)) for s in range(4)).astype(np.uint8).ravel()


def codepoint_classes() -> np.ndarray:
    """The class of every codepoint."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    return out


def _then(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return _THEN[(f.astype(np.uint16) << 8) | g]


def compose_scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """out[i] is the composition of f[0] to f[i]: within blocks, over the blocks' totals, then both together."""
    n = len(f)
    if n <= 1:
        return f.copy()
    rows = -(-n // width)
    m = np.full(rows * width, IDENTITY, np.uint8)
    m[:n] = f
    m = np.ascontiguousarray(m.reshape(rows, width).T)
    for k in range(1, width):
        m[k] = _then(m[k - 1], m[k])
    if rows > 1:
        before = compose_scan(m[-1], width)[:-1]
        m[:, 1:] = _then(np.broadcast_to(before, (width, rows - 1)), m[:, 1:])
    return np.ascontiguousarray(m.T).ravel()[:n]


def cuts(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each codepoint; ``first`` marks the first codepoint of each text."""
    g = classes[cp]
    white = g == WHITE
    blank = cp == 0x20
    prev = np.empty_like(g)
    prev[:1], prev[1:] = 255, g[:-1]
    prev[first] = 255
    after_blank = np.zeros(len(cp), bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    next_plain = np.zeros(len(cp), bool)
    next_plain[:-1] = ~white[1:] & ~first[1:]
    cut = np.where(white, (prev != WHITE) | next_plain, (g != prev) & ~after_blank)

    starts = (cp == 0x27) & (prev != OTHER) & ~after_blank
    f = np.full(len(cp), CONSTANT, np.uint8)
    f[starts] = STARTS
    short = (cp == 0x73) | (cp == 0x74) | (cp == 0x6D) | (cp == 0x64)
    r_or_v, e, ell = (cp == 0x72) | (cp == 0x76), cp == 0x65, cp == 0x6C
    f[r_or_v & ~first] = AFTER_RV
    f[ell & ~first] = AFTER_L
    scanned = compose_scan(f) & 3  # the image of the idle state
    state = np.zeros_like(scanned)
    state[1:] = scanned[:-1]
    state[first] = IDLE
    one = np.flatnonzero((state == OPEN) & short)
    two = np.flatnonzero(((state == PENDING_E) & e) | ((state == PENDING_L) & ell))
    cut[one] = False
    cut[two - 1] = False
    after = np.concatenate([one, two]) + 1
    cut[after[after < len(cp)]] = True
    return cut


def _merge_long(piece: bytes, ranks: dict) -> list[int]:
    """Merges with a heap, for pieces in which a scan for each merge would take too long."""
    n = len(piece)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def push(i):
        j = right[i]
        if j < n and (r := ranks.get(piece[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], right[i] = stop, right[j]
        if right[i] < n:
            left[right[i]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


def merge(piece: bytes, ranks: dict) -> list[int]:
    """Token ids of one piece: the pair of least rank, leftmost first, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > LONG:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks)
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class Merger:
    """Merges many pieces at once: a row for each piece, in every round each row merges its pair of least rank."""

    WIDTHS = (8, 16, 32, 64)
    CHUNK = 1 << 18  # symbols handled at once

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.none = np.int32(max(ranks.values(), default=0) + 1)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62)
        self.values = np.append(np.array(values, np.int32)[order], self.none)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; negative ids are padding."""
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (b >= 0), self.values[at], self.none)

    def _rows(self, symbols: np.ndarray, length: np.ndarray) -> list[list[int]]:
        n, width = symbols.shape
        out = symbols.copy()
        live, sym = np.arange(n), symbols
        rank = self.pair(sym[:, :-1], sym[:, 1:])
        column = np.arange(width)
        while True:
            j = rank.argmin(axis=1)
            least = rank[np.arange(len(live)), j]
            going = least < self.none
            if not going.all():
                out[live[~going]] = sym[~going]
                live, sym, rank, j, least = live[going], sym[going], rank[going], j[going], least[going]
            if not len(live):
                return [r[:k] for r, k in zip(out.tolist(), length.tolist())]
            row = np.arange(len(live))
            length[live] -= 1
            take = np.minimum(column + (column > j[:, None]), width - 1)
            sym = np.take_along_axis(sym, take, 1)
            sym[:, -1] = -1
            sym[row, j] = least
            rank = np.take_along_axis(rank, take[:, :-1].clip(max=width - 2), 1)
            rank[:, -1] = self.none
            lo, hi = np.maximum(j - 1, 0), np.minimum(j, width - 2)
            rank[row, hi] = np.where(j <= width - 2, self.pair(sym[row, hi], sym[row, hi + 1]), rank[row, hi])
            rank[row, lo] = self.pair(sym[row, lo], sym[row, lo + 1])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Token ids of the pieces data[start:end], none of which is a token by itself."""
        out: list = [None] * len(starts)
        size = ends - starts
        for i in np.flatnonzero(size > self.WIDTHS[-1]).tolist():
            out[i] = merge(data[starts[i]:ends[i]].tobytes(), self.ranks)
        for low, width in zip((0, *self.WIDTHS), self.WIDTHS):
            chosen = np.flatnonzero((size > low) & (size <= width))
            for k in range(0, len(chosen), self.CHUNK // width):
                part = chosen[k:k + self.CHUNK // width]
                column = np.arange(width)
                inside = column < size[part, None]
                symbols = np.where(inside, self.bytes[data[np.where(inside, starts[part, None] + column, 0)]], np.int32(-1))
                for i, ids in zip(part.tolist(), self._rows(symbols, size[part])):
                    out[i] = ids
        return out


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + length], one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(int(length.sum()))]


class Decoder:
    """Bytes of every id, in one array."""

    def __init__(self, ranks: dict):
        size = max(ranks.values(), default=-1) + 1
        self.length = np.zeros(size, np.int64)
        for b, r in ranks.items():
            self.length[r] = len(b)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.flat, self.start[ids], self.length[ids])


def parse_ranks(data: bytes) -> dict:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


@lru_cache(maxsize=2)
def _tables(rank_file: bytes):
    """What a worker process keeps for a rank file: ranks, decoder, merger, and ids of known pieces by hash."""
    ranks = parse_ranks(rank_file)
    size = np.fromiter(map(len, ranks), np.int64, len(ranks))
    stops = np.cumsum(size)
    hashes = span_hashes(np.frombuffer(b"".join(ranks), np.uint8), stops - size, stops)
    return ranks, Decoder(ranks), Merger(ranks), dict(zip(hashes.tolist(), ([r] for r in ranks.values()))), {}


def _repaired(data: np.ndarray, offsets: np.ndarray):
    """Bytes and offsets of the texts with what is no UTF-8 read as U+FFFD."""
    texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _transcode(shared, names, offsets_wanted, decode_wanted):
    def run(batches):
        rank_file, classes = shared.value
        ranks, decode, merge_all, whole, cache = _tables(rank_file)
        for rows, data, offsets in text_blocks(batches, limit=BLOCK):
            try:
                points = data.tobytes().decode("utf-8")
            except UnicodeDecodeError:
                data, offsets = _repaired(data, offsets)
                points = data.tobytes().decode("utf-8")
            cp = np.frombuffer(points.encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((data & 0xC0) != 0x80)
            first = np.zeros(len(cp) + 1, bool)
            first[np.searchsorted(at, offsets[:-1])] = True
            starts = at[cuts(cp, first[:-1], classes)] if len(cp) else at
            ends = np.append(starts[1:], len(data))[:len(starts)]
            keys, where, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            if len(cache) > CACHE:
                cache.clear()
            keys = keys.tolist()
            found = [whole.get(k) or cache.get(k) for k in keys]
            new = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(new, merge_all(data, starts[where[new]], ends[where[new]])):
                found[i] = cache[keys[i]] = ids
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(joined.from_iterable(found), np.int32, int(size.sum()))
            ids = _gather(flat, (np.cumsum(size) - size)[which], size[which])
            decoded = decode(ids)
            if not np.array_equal(decoded, data):  # two pieces shared a hash: merge each by itself
                cache.clear()
                found = [merge(data[a:b].tobytes(), ranks) for a, b in zip(starts.tolist(), ends.tolist())]
                which, size = np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(joined.from_iterable(found), np.int32, int(size.sum()))
                decoded = decode(ids)
            stops = np.concatenate([[0], np.cumsum(size[which])])[np.searchsorted(starts, offsets)].astype(np.int32)
            columns = [*rows.columns, pa.ListArray.from_arrays(pa.array(stops), pa.array(ids, pa.int32()))]
            begins = np.concatenate([[0], np.cumsum(decode.length[ids])])
            if offsets_wanted:
                begin = begins[:-1] - np.repeat(offsets[:-1], np.diff(stops))
                columns.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(begin.astype(np.int32))))
            if decode_wanted:
                lines = pa.array(begins[stops])
                columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops) - 1, [None, lines.buffers()[1], pa.py_buffer(decoded)]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def transcode(docs: DataFrame, rank_file: bytes, text: str = "text", offsets: bool = False, decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` array<int>, the whole ``text`` encoded by the ranks in ``rank_file``'s bytes.

    ``offsets`` adds token_offsets, the byte at which each token starts in its text; ``decode`` adds decoded, the bytes that the
    ids stand for. A null or empty text has no ids; bytes that are no UTF-8 are read as U+FFFD. Columns of ``docs`` with these names are replaced. The ranks and
    the class of every codepoint (about 2 MB, fixed) are all that is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((rank_file, codepoint_classes()))
    ints = T.ArrayType(T.IntegerType())
    new = [("ids", ints), *[("token_offsets", ints)] * offsets, *[("decoded", T.BinaryType())] * decode]
    kept = docs.drop(*(n for n, _ in new))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in new)])
    source = kept if text == "text" else kept.withColumn("text", F.col(text))
    names = [f.name for f in schema]
    return source.mapInArrow(_transcode(shared, names, offsets, decode), schema)


def decode_ids(encoded: DataFrame, rank_file: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` binary: the bytes of its ids. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file)
    kept = encoded.drop("decoded")

    def run(batches):
        decode = Decoder(parse_ranks(shared.value))
        for rows in batches:
            out = [None if x is None else decode(np.array(x, np.int64)).tobytes() for x in rows.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], [*rows.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The bytes of a rank file; a path that only Spark can read will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
