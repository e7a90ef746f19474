"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` turns a .model file into arrays, once and on the driver:

* the normaliser: the model's own character map is a double-array transducer over
  bytes, walked from every character at once; then come the white space rules, and
  blanks and U+2581 become one symbol;
* the pieces: one acceptor over bytes, states and arcs packed by row displacement,
  whose final states emit a piece and carry its weight;
* the byte fallback: an arc over each character that no piece equals, dearer than
  any piece, that emits the character's bytes (or the unknown piece);
* for merge models (BPE) the links: whether piece b may follow piece a, that is
  whether merging the characters of a+b gives exactly a, b.  It is read off the
  merge tree of both pieces, walking down from the seam.

Composition with an input gives a lattice: every arc of the machine from every
character on.  The tropical-semiring shortest path through it is the encoding.  A
unigram model weighs an arc by minus the piece's score, in single precision, and of
equal paths takes the longest last piece, both as the library does; sums start anew at
each chunk, so of paths that differ by rounding alone the library may take another.
In a merge model the links leave one path, which is the library's encoding.

Where no piece joins a non-blank to a following blank the machine returns to its
start at each blank, so a text is cut into such chunks; equal chunks of a slice of
texts are composed once, and many chunks advance together.  Nothing outlives a
slice.  Longer chunks of a merge model are walked in overlapping windows at once and
joined where neighbours share a piece; those of a unigram model are cut where no arc
crosses.  Only what neither takes apart is walked byte by byte on its own.

Defined cases: null and empty texts have no pieces; characters without a piece
become bytes; control strings in a text are ordinary characters; a literal
U+2581 decodes to a blank, as in the library; repeated rows are encoded alike; an
empty table gives an empty result; other columns are kept or ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm._text import buffers, slices

BLANK = "▁"
#: Bytes of texts that are composed together, bytes of chunks that advance together, and the longest of them.
SLICE = 1 << 20
CELLS = 1 << 19
LONG = 64
#: Ranges that are gathered at once: what indexes them takes eight bytes an item.
RANGES = 1 << 16
#: Characters from window to window in longer chunks, and those that neighbours share.  A run
#: that repeats every 2 to 7 characters gives all windows of one of the strides the same phase.
STRIDES, OVERLAP = (240, 1680), 48
#: Symbols that are no piece: before the first piece, and a character without one.
START, LOOSE = -1, -2
PAD = 256
#: What the library takes off the least score for an unknown character.
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: varints as int, blobs and fixed32 as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Arcs:
    """A sparse table (row, column) -> value in flat arrays, one probe a lookup:
    each row is moved until its columns fall on free places."""

    move: np.ndarray
    owner: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(entries: dict[tuple[int, int], int], rows: int) -> Arcs:
        columns: dict[int, list[int]] = {}
        for row, column in entries:
            columns.setdefault(row, []).append(column)
        bits = max(10, (4 * len(entries)).bit_length(), max((c for _, c in entries), default=0).bit_length())
        move, owner, value = np.zeros(rows, np.int32), np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int32)
        rng = np.random.default_rng(1)
        for row in sorted(columns, key=lambda r: (-len(columns[r]), r)):
            spread = _spread(np.array(columns[row]))
            while True:
                move[row] = rng.integers(1 << bits)
                at = (spread + move[row]) & ((1 << bits) - 1)
                if (owner[at] < 0).all():
                    break
            owner[at] = row
            value[at] = [entries[row, c] for c in columns[row]]
        return Arcs(move, owner, value)

    def get(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The values, -1 where there are none."""
        at = (_spread(column) + self.move[row]) & (len(self.owner) - 1)
        return np.where(self.owner[at] == row, self.value[at], -1)


def _spread(column: np.ndarray) -> np.ndarray:
    return column.astype(np.int64) * 40503


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [start, start + count), one after the other."""
    out = np.repeat(starts - np.cumsum(counts) + counts, counts)
    out += np.arange(len(out))
    return out


def _gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """The values in the ranges [start, start + count), RANGES of them at a time."""
    for low in range(0, len(counts), RANGES):
        some = slice(low, low + RANGES)
        yield values[_ragged(starts[some], counts[some])]


def _widths(raw: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts at each byte, 0 inside one."""
    return np.array([1, 0, 2, 3, 4], np.int8)[np.digitize(raw, [0x80, 0xC0, 0xE0, 0xF0])]


@dataclass
class Transducer:
    arcs: Arcs  # (state, byte) -> state
    final: np.ndarray  # state -> symbol or -1; symbols are the ids and, in merge models, further characters
    weights: np.ndarray
    loose_weight: np.float32
    n_ids: int
    byte_ids: np.ndarray  # empty without byte fallback
    unknown: int
    decoded: np.ndarray  # bytes that the ids decode to, and where each begins
    decoded_at: np.ndarray
    merges: bool
    rank: np.ndarray  # of merge models: order of a symbol's last merge (-1: a character) and what it merges
    left: np.ndarray
    right: np.ndarray
    pairs: Arcs  # (symbol, symbol) -> order of their merge
    rules: np.ndarray  # the character map's double array, and the texts it emits
    emitted: bytes
    dummy_prefix: bool
    tidy_spaces: bool
    longest: int
    splits: bool
    own: re.Pattern | None = None  # pieces a user defined, which are found first
    own_ids: dict[str, int] | None = None

    # -- normaliser ---------------------------------------------------------
    def _rewritten(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts after the longest rule of the character map at each character."""
        ends = np.repeat(offsets[1:], np.diff(offsets))
        live = np.flatnonzero(_widths(raw))
        unit, node = np.full(len(live), self.rules[0]), np.zeros(len(live), np.int64)
        length, emits = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        for depth in range(1 << 16):
            inside = live + depth < ends[live]
            live, unit, node = live[inside], unit[inside], node[inside]
            if not len(live):
                break
            node = node ^ _offset(unit) ^ raw[live + depth]
            valid = node < len(self.rules)
            unit = self.rules[np.where(valid, node, 0)]
            ok = valid & ((unit & 0x800000FF) == raw[live + depth])
            live, unit, node = live[ok], unit[ok], node[ok]
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]] = depth + 1
            emits[live[leaf]] = self.rules[node[leaf] ^ _offset(unit[leaf])] & 0x7FFFFFFF
        parts, at = [], 0
        bounds = [0] * len(offsets)
        text, total = 0, 0
        hits = np.flatnonzero(length)
        for s in hits.tolist():
            if s < at:
                continue
            while offsets[text + 1] <= s:
                text += 1
                bounds[text] = total + int(offsets[text]) - at
            parts += [raw[at:s].tobytes(), self.emitted[emits[s] : self.emitted.index(0, emits[s])]]
            total += len(parts[-2]) + len(parts[-1])
            at = s + int(length[s])
        for t in range(text + 1, len(offsets)):
            bounds[t] = total + int(offsets[t]) - at
        parts.append(raw[at:].tobytes())
        return np.frombuffer(b"".join(parts), np.uint8), np.array(bounds, np.int64)

    def normalise(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bounds of the normalised texts, blanks as 0x20."""
        return self._spaced(*(self._rewritten(raw, offsets) if len(self.rules) else (raw, offsets)))

    def _spaced(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The white space rules."""
        if self.tidy_spaces:
            raw, offsets = _without(raw, offsets, _idle_blanks(raw, offsets, True))
        mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
        if len(mark):
            raw = raw.copy()
            raw[mark] = 0x20
            gone = np.zeros(len(raw), bool)
            gone[np.concatenate([mark + 1, mark + 2])] = True
            raw, offsets = _without(raw, offsets, gone)
            if self.tidy_spaces:
                raw, offsets = _without(raw, offsets, _idle_blanks(raw, offsets, False))
        if self.dummy_prefix:
            some = np.diff(offsets) > 0
            raw = np.insert(raw, offsets[:-1][some], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        return raw, offsets

    # -- composition and shortest path --------------------------------------
    def _lattice(self, matrix: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Starts (as flat indexes) and symbols of all arcs by their length in bytes.

        matrix holds a chunk a column, PAD below its end.
        """
        n, flat = matrix.shape[1], matrix.ravel()
        width = np.zeros(len(flat), np.int8)
        inside = flat < PAD
        width[inside] = _widths(flat[inside])
        live, state = np.flatnonzero(width), None
        starts, symbols = [live[:0]], [live[:0]]
        single = np.zeros(len(flat), bool)
        for depth in range(self.longest):
            if not len(live):
                break
            at = live + depth * n
            state = self.arcs.get(np.zeros(len(live), np.int32) if state is None else state, flat[at])
            ok = (state >= 0) & (at + n < len(flat))
            live, state = live[ok], state[ok]
            symbol = self.final[state]
            hit = symbol >= 0
            starts.append(live[hit])
            symbols.append(symbol[hit])
            single[starts[-1][width[starts[-1]] == depth + 1]] = True
        while len(starts) < 5:
            starts.append(live[:0])
            symbols.append(live[:0])
        for w in range(1, 5):
            loose = np.flatnonzero((width == w) & ~single)
            if len(loose):
                both = np.concatenate([starts[w], loose])
                order = np.argsort(both, kind="stable")
                starts[w] = both[order]
                symbols[w] = np.concatenate([symbols[w], np.full(len(loose), LOOSE)])[order]
        return starts, symbols

    def _cost(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol >= 0, self.weights[symbol], self.loose_weight)

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each symbol b may follow a.  From the seam on, the later of the two
        outer merges is undone; the pair is void if another merge across the seam
        would come before the one that is undone."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b, limit = a[at], b[at], np.full(len(at), 1 << 30)
        while len(at):
            across = self.pairs.get(a, b)
            void = (across >= 0) & (across < limit)
            ok[at[void]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~void & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def _together(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, first byte, symbol) of the pieces of many chunks' shortest paths."""
        n, top = len(starts), int(lengths.max())
        matrix = np.full((top + 1, n), PAD, np.int16)
        matrix[_ragged(np.zeros(n, np.int64), lengths), np.repeat(np.arange(n), lengths)] = raw[_ragged(starts, lengths)]
        begins, symbols = self._lattice(matrix)
        rows = [np.searchsorted(f, np.arange(top + 2) * n) for f in begins]
        cost, last, back = np.full((top + 1) * n, np.inf, np.float32), np.full((top + 1) * n, START, np.int32), np.zeros((top + 1) * n, np.int8)
        cost[:n] = 0
        for end in range(1, top + 1):
            for length in range(min(end, len(begins) - 1), 0, -1):
                lo, hi = rows[length][end - length], rows[length][end - length + 1]
                if lo == hi:
                    continue
                f, symbol = begins[length][lo:hi], symbols[length][lo:hi]
                to = f + length * n
                if self.merges:  # one path is left: what has one needs no other
                    new = np.flatnonzero(last[to] == START)
                    new = new[self.linked(last[f[new]], symbol[new])]
                    f, symbol, to = f[new], symbol[new], to[new]
                total = cost[f] + self._cost(symbol)
                less = total < cost[to]
                cost[to[less]], last[to[less]], back[to[less]] = total[less], symbol[less], length
        chunk, at = np.arange(n), lengths.astype(np.int64)
        found = []
        while len(chunk):
            f = at * n + chunk
            if not back[f].all():
                raise ValueError("the machine has no path through a chunk")
            at = at - back[f]
            found.append((chunk, at, last[f]))
            chunk, at = chunk[at > 0], at[at > 0]
        chunk, at, symbol = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(chunk * (top + 1) + at, kind="stable")
        return chunk[order], at[order], symbol[order]

    def _alone(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, symbol) of the pieces of one long chunk's shortest path."""
        n = len(raw)
        begins, symbols = self._lattice(np.append(raw.astype(np.int16), PAD)[:, None])
        first, symbol = np.concatenate(begins), np.concatenate(symbols)
        end = first + np.repeat(np.arange(len(begins)), [len(b) for b in begins])
        order = np.lexsort((first, end))
        weight = self._cost(symbol)[order].tolist()
        cost, last, back = [np.float32(np.inf)] * (n + 1), [START] * (n + 1), [0] * (n + 1)
        cost[0] = np.float32(0)
        known: dict[tuple[int, int], bool] = {}
        for s, e, x, w in zip(first[order].tolist(), end[order].tolist(), symbol[order].tolist(), weight):
            if self.merges and last[s] >= 0 and x >= 0:
                if len(known) > 1 << 16:
                    known.clear()
                ok = known.get((last[s], x))
                if ok is None:
                    ok = known[last[s], x] = bool(self.linked(np.array([last[s]]), np.array([x]))[0])
                if not ok:
                    continue
            total = cost[s] + np.float32(w)
            if total < cost[e]:
                cost[e], last[e], back[e] = total, x, s
        path = []
        while n:
            path.append((back[n], last[n]))
            n = back[n]
        return tuple(np.array(x, np.int64) for x in zip(*reversed(path)))

    def _many(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What :meth:`_together` gives, for any number of chunks; those of like length advance together."""
        order = np.argsort(-lengths, kind="stable")
        low = 0
        while low < len(order):
            some = order[low : low + max(1, CELLS // int(lengths[order[low]]))]
            low += len(some)
            chunk, at, symbol = self._together(raw, starts[some], lengths[some])
            yield some[chunk], at, symbol

    def _windowed(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, stride: int, second: np.ndarray):
        """(chunk, first byte, symbol) of the pieces of long chunks of a merge model, which
        chunks are whole, and the character at which a chunk's first path has a piece begin
        after its second window does.

        Windows of ``stride`` characters, each with OVERLAP more, are walked at once; a
        chunk's second one begins at character ``second``.
        Where two neighbours share a piece, the left path up to it and the right path
        from it on are one path all of whose links hold, and there is only one such.
        """
        raw = raw[_ragged(starts, lengths)]
        ends = np.cumsum(lengths)
        heads = np.flatnonzero(_widths(raw))
        of = np.searchsorted(ends, heads, "right")
        first, past = np.searchsorted(of, np.arange(len(lengths))), np.searchsorted(of, np.arange(len(lengths)), "right")
        number = np.arange(len(heads)) - first[of]
        on = (number >= second[of]) & ((number - second[of]) % stride == 0) & (past[of] - first[of] - number > OVERLAP)
        begin = np.flatnonzero((number == 0) | on)
        chunk = of[begin]
        stop = begin + np.where(number[begin] == 0, second[chunk], stride) + OVERLAP
        low = heads[begin]
        high = np.where(stop < past[chunk], np.append(heads, 0)[np.minimum(stop, len(heads))], ends[chunk])
        window, at, symbol = (np.concatenate(x) for x in zip(*self._many(raw, low, high - low)))
        at = at + low[window]
        order = np.lexsort((at, window))
        window, at, symbol = window[order], at[order], symbol[order]
        seam = np.append(chunk[1:] == chunk[:-1], False)  # whether a window has a next one
        key = at * (1 << 32) + symbol + 2
        left = seam[window] & (at >= np.append(low[1:], 0)[window])
        right = np.append(False, seam[:-1])[window] & (at < np.append(0, high[:-1])[window])
        _, _, shared = np.intersect1d(key[left], key[right], assume_unique=True, return_indices=True)
        shared = np.flatnonzero(right)[shared]
        join = np.full(len(low), len(raw))
        np.minimum.at(join, window[shared], at[shared])
        inner = np.append(False, seam[:-1])
        whole = np.ones(len(lengths), bool)
        whole[chunk[inner & (join == len(raw))]] = False
        join[~inner] = low[~inner]
        upto = np.where(seam, np.append(join[1:], 0), ends[chunk])
        kept = (at >= join[window]) & (at < upto[window]) & whole[chunk[window]]
        after = np.full(len(lengths), len(raw))
        lead = np.flatnonzero(left & ~inner[window])
        np.minimum.at(after, chunk[window[lead]], at[lead])
        again = np.searchsorted(heads, after) - first
        of = chunk[window[kept]]
        return of, at[kept] - (ends - lengths)[of], symbol[kept], whole, again

    def _parts(self, raw: np.ndarray) -> np.ndarray:
        """Where a chunk comes apart: the bounds that no arc of its lattice crosses."""
        begins, _ = self._lattice(np.append(raw.astype(np.int16), PAD)[:, None])
        over = np.zeros(len(raw) + 2, np.int64)
        for length, f in enumerate(begins):
            np.add.at(over, f + 1, 1)
            np.add.at(over, f + length, -1)
        return np.flatnonzero(np.cumsum(over)[: len(raw) + 1] == 0)

    def _long(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(chunk, first byte, symbol) of the pieces of chunks of over LONG bytes."""
        rest = np.arange(len(starts))
        if self.merges:
            for stride in STRIDES:
                second = np.full(len(rest), stride)
                for _ in range(2):  # then from where the first window has a piece begin
                    if len(rest):
                        chunk, at, symbol, whole, second = self._windowed(raw, starts[rest], lengths[rest], stride, second)
                        yield rest[chunk], at, symbol
                        rest, second = rest[~whole], second[~whole]
            for i in rest:
                at, symbol = self._alone(raw[starts[i] : starts[i] + lengths[i]])
                yield np.full(len(at), i), at, symbol
            return
        bounds = [self._parts(raw[a : a + n]) for a, n in zip(starts, lengths)]
        of = np.repeat(rest, [len(b) - 1 for b in bounds])
        low, high = (np.concatenate(x) for x in ([b[:-1] for b in bounds], [b[1:] for b in bounds]))
        short = np.flatnonzero(high - low <= LONG)
        for part, at, symbol in self._many(raw, (starts[of] + low)[short], (high - low)[short]):
            yield of[short[part]], at + low[short[part]], symbol
        for k in np.flatnonzero(high - low > LONG):
            begin = starts[of[k]] + low[k]
            at, symbol = self._alone(raw[begin : begin + high[k] - low[k]])
            yield np.full(len(at), of[k]), at + low[k], symbol

    def _paths(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and their bounds."""
        lengths, found = np.diff(offsets), []
        for walk, some in ((self._many, np.flatnonzero(lengths <= LONG)), (self._long, np.flatnonzero(lengths > LONG))):
            if len(some):
                found += [(some[chunk], at, symbol) for chunk, at, symbol in walk(raw, offsets[some], lengths[some])]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        chunk, at, symbol = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, chunk))
        chunk, at, symbol = chunk[order], at[order] + offsets[chunk[order]], symbol[order]
        piece = (symbol >= 0) & (symbol < self.n_ids)
        if len(self.byte_ids):
            counts = np.where(piece, 1, _widths(raw[at]).astype(np.int64))
            ids = np.repeat(symbol, counts).astype(np.int32)
            spelled = np.repeat(~piece, counts)
            ids[spelled] = self.byte_ids[raw[_ragged(at[~piece], counts[~piece])]]
        else:
            counts, ids = np.ones(len(symbol), np.int64), np.where(piece, symbol, self.unknown).astype(np.int32)
        per = np.bincount(chunk, counts, len(lengths)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some normalised texts, one after the other, and each text's bounds in them."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        some = offsets[:-1][np.diff(offsets) > 0]
        first = np.zeros(len(raw), bool)
        if self.splits:
            blank = raw == 0x20
            first[1:] = blank[1:] & ~blank[:-1]
        first[some] = True
        cuts = np.append(np.flatnonzero(first), len(raw))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        of, words = np.asarray(chunks.indices).astype(np.int64), chunks.dictionary
        _, at, data = words.buffers()
        ids, bounds = self._paths(np.frombuffer(data, np.uint8), np.frombuffer(at, np.int64, len(words) + 1))
        counts = np.diff(bounds)[of]
        flat = np.concatenate(list(_gathered(ids, bounds[:-1][of], counts)))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, offsets)]
        if not len(self.byte_ids):  # neighbouring unknown pieces are one
            again = np.zeros(len(flat), bool)
            again[1:] = (flat[1:] == self.unknown) & (flat[:-1] == self.unknown)
            again[ends[:-1][np.diff(ends) > 0]] = False
            flat, ends = flat[~again], ends - np.concatenate([[0], np.cumsum(again)])[ends]
        return flat, ends

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of an Arrow column, and their bounds; null counts as empty."""
        if self.own is None:
            return self.encode_slice(*self.normalise(*buffers(column)))
        # the map leaves the user's pieces alone, so it sees what stands between them
        column = pa.array([t or "" for t in column.to_pylist()], pa.string())
        if len(self.rules):
            parts = [self.own.split(t) for t in column.to_pylist()]
            raw, at = self._rewritten(*buffers(pa.array([p for some in parts for p in some[::2]], pa.string())))
            free = (raw[a:b].tobytes().decode() for a, b in zip(at, at[1:]))
            column = pa.array(["".join(p if i % 2 else next(free) for i, p in enumerate(some)) for some in parts], pa.string())
        raw, at = self._spaced(*buffers(column))
        parts = [self.own.split(raw[a:b].tobytes().decode()) for a, b in zip(at, at[1:])]
        free, at = self.encode_slice(*buffers(pa.array([p for some in parts for p in some[::2]], pa.string())))
        counts, out, k = [0], [], 0
        for some in parts:
            for i, p in enumerate(some):
                out += [self.own_ids[p]] if i % 2 else free[at[k] : at[k + 1]].tolist()
                k += i % 2 == 0
            counts.append(len(out))
        return np.array(out, np.int32), np.array(counts, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    # -- decoding -------------------------------------------------------------
    def decode_texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts that ranges of ids spell; bytes that are no UTF-8 become U+FFFD."""
        counts = np.diff(self.decoded_at)[ids]
        raw = b"".join(part.tobytes() for part in _gathered(self.decoded, self.decoded_at[ids], counts))
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds].tolist()
        skip = self.dummy_prefix
        return [raw[a + (skip and raw[a:b][:1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_texts(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def _offset(unit: np.ndarray) -> np.ndarray:
    """Where the children of a double array's unit lie, relative to it."""
    unit = unit.astype(np.int64)
    return (unit >> 10) << ((unit & 0x200) >> 6)


def _without(raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw[~gone], offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]


def _idle_blanks(raw: np.ndarray, offsets: np.ndarray, inner: bool) -> np.ndarray:
    """Blanks at the end of a text and, with ``inner``, at its start and after a blank."""
    blank = raw == 0x20
    idle = np.zeros(len(raw), bool)
    first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    if inner:
        idle[1:] = blank[1:] & blank[:-1]
        idle[first] = blank[first]
    solid = np.flatnonzero(~blank)
    for f, b in zip(first[blank[last]].tolist(), last[blank[last]].tolist()):
        k = np.searchsorted(solid, b)
        idle[(max(f, solid[k - 1] + 1) if k else f) : b + 1] = True
    return idle


def merged(text: str, ranks: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The characters of a short string merged by rank, and the last merge."""
    parts, final = list(text), None
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = ranks.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or k < best):
                best, at = k, i
        if at < 0:
            break
        final = (parts[at], parts[at + 1])
        parts[at : at + 2] = ["".join(final)]
    return parts, final


def compile_model(raw: bytes) -> Transducer:
    """The machine of a serialised SentencePiece model."""
    pieces, kinds, scores = [], [], []
    merges, dummy, tidy, escape, charmap = False, True, True, True, b""
    for tag, value in _fields(raw):
        if tag == 1:
            p = dict(_fields(value))
            pieces.append(p[1].decode())
            scores.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(p.get(3, 1))
        elif tag == 2:
            kind = dict(_fields(value)).get(3, 1)
            if kind not in (1, 2):
                raise ValueError("the model is neither a unigram nor a merge model")
            merges = kind == 2
        elif tag == 3:
            spec = dict(_fields(value))
            dummy, tidy, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
            charmap = spec.get(2, b"")
    if not escape:
        raise ValueError("the model does not escape blanks")
    normal, unknown, user, byte = 1, 2, 4, 6
    if merges and 5 in kinds:
        raise ValueError("the merge model has unused pieces")
    ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == normal}
    own_ids = {p.replace(BLANK, " "): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == user}
    own = sorted(own_ids, key=len, reverse=True)
    byte_ids = np.array([i for i, k in enumerate(kinds) if k == byte], np.int32)
    n = len(pieces)
    symbols, rank, left, right, pairs = dict(ids), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), {}
    weights = -np.array(scores, np.float32)
    if merges:
        for c in sorted({c for p in ids for c in p} - set(ids)):
            symbols[c] = n + len(symbols) - len(ids)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        ranks = {p: order[scores[i]] for p, i in ids.items() if len(p) > 1}
        size = n + len(symbols) - len(ids)
        rank, left, right = np.full(size, -1, np.int32), np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        for p, r in ranks.items():
            for i in range(1, len(p)):
                a, b = symbols.get(p[:i]), symbols.get(p[i:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        for p, r in ranks.items():
            parts, final = merged(p, ranks)
            if len(parts) > 1:  # never made by merging
                del symbols[p]
            else:
                k = ids[p]
                rank[k], left[k], right[k] = r, symbols[final[0]], symbols[final[1]]
        if (rank[left] > rank).any() or (rank[right] > rank).any():
            raise ValueError("the merge model makes a piece of later ones, as training never does")
        weights = np.zeros(size, np.float32)
    known = [scores[i] for i in ids.values()]
    loose = np.float32(1) if merges else np.float32(UNKNOWN_PENALTY) - np.float32(min(known, default=0.0))
    states: dict[tuple[int, int], int] = {}
    final, count = {}, 1
    for p, k in symbols.items():
        state = 0
        for b in p.replace(BLANK, " ").encode():
            nxt = states.get((state, b))
            if nxt is None:
                nxt = states[state, b] = count
                count += 1
            state = nxt
        final[state] = k
    text = [
        bytes([int(p[3:5], 16)]) if k == byte else p.replace(BLANK, " ").encode() if k in (normal, user) else b"" if k == 3 else " ⁇ ".encode()
        for p, k in zip(pieces, kinds)
    ]
    cut = int.from_bytes(charmap[:4], "little")
    return Transducer(
        Arcs.of(states, count), np.array([final.get(s, -1) for s in range(count)], np.int32), weights, loose, n, byte_ids, kinds.index(unknown),
        np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in text])]), merges,
        rank, left, right, Arcs.of(pairs, len(rank)),
        np.frombuffer(charmap[4 : 4 + cut], "<u4").astype(np.int64), charmap[4 + cut :], dummy, tidy,
        max((len(p.encode()) for p in symbols), default=1), not any(BLANK in p.lstrip(BLANK) for p in symbols),
        re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None, own_ids,
    )


def default_model() -> str:
    """The public merge model with byte fallback that the box offers."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _shared(df: DataFrame, model: str | None):
    """The compiled machine, sent to the tasks once; the model's size bounds it."""
    with open(model or default_model(), "rb") as file:
        return df.sparkSession.sparkContext.broadcast(compile_model(file.read()))


def _coded(machine: Transducer, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, next row, ids, bounds) of slices of a column."""
    for low, high in slices(column, SLICE):
        yield low, high, *machine.encode_texts(column.slice(low, high - low))


def encode(df: DataFrame, model: str | None = None, text: str = "text", out: str = "ids", checked: str | None = None) -> DataFrame:
    """``df`` with ``out`` array<int>: the pieces of the whole text.

    ``checked`` names a boolean column that tells whether decoding gives the text back.
    """
    machine = _shared(df, model)
    rest = df.drop(out, *([checked] if checked else []))
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    if checked:
        schema.add(checked, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine.value
        for batch in batches:
            for low, high, ids, bounds in _coded(fst, batch.column(text)):
                part = batch.slice(low, high - low)
                more = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if checked:
                    more.append(pa.array([a == (b or "") for a, b in zip(fst.decode_texts(ids, bounds), part.column(text).to_pylist())], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*batch.schema.names, out, *([checked] if checked else [])])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` string: the text that the pieces spell."""
    machine = _shared(df, model)
    schema = df.drop(out).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine.value
        for batch in batches:
            column = batch.column(ids)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]).astype(np.int64)
            texts = fst.decode_texts(np.asarray(column.flatten()).astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def digest(df: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_pieces, ids_sha256 (of the ids
    as little-endian 32-bit numbers), decoded_sha256, round_trip."""
    machine = _shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fst = machine.value
        for batch in batches:
            for low, high, ids, bounds in _coded(fst, batch.column(1)):
                backs = fst.decode_texts(ids, bounds)
                raw, ends = ids.astype("<i4").tobytes(), (bounds * 4).tolist()
                shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                same = [a == (b or "") for a, b in zip(backs, batch.column(1).slice(low, high - low).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(bounds), pa.int64()), pa.array(shas, pa.string()),
                     pa.array([hashlib.sha256(b.encode()).hexdigest() for b in backs], pa.string()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
