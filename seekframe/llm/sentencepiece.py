"""SentencePiece encoding and decoding: batched Viterbi in numpy over a given model file.

Text is cut into units (a run of word marks and what follows, which no piece crosses), each distinct unit of a slice
of rows is encoded once, and units of equal length advance together: hashes of all their substrings probe the sorted
piece keys, and at each position a vectorised maximum over the pieces that end there stores the backpointer.  A unit of
more than ``LONG`` bytes is cut into overlapping windows that advance together like units; where two windows have a
piece in common, one path goes over into the other, which is exact as the path is unique.  Rows go through Python by
slices of a few megabytes, so memory follows the slice or the longest text.

For unigram models the maximum is over the sum of scores.  Merge models (BPE) score no path by a sum, so there a piece
may follow another only where merging by rank would leave that pair as it is; the one path of such pairs is the merge
result, and the same maximum finds it.  ``follows`` decides that from the merge order, undoing one merge at a time at
the seam.  Characters outside the vocabulary become byte pieces, or the unknown piece where a model has none.

Defined results: null and empty texts have no pieces; U+2581 in a text counts as a space, as in the library; repeated
rows are encoded alike; further columns stay (one named like a result is replaced); an empty table gives no rows; texts
of megabytes without a space are encoded whole.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .blocks import _INVERSE, _MULTIPLIER, _SYMBOLS, Words, _power_table, mapped, mix, raw, slices

MARK = 0xFF  # stands for U+2581: no byte of UTF-8
MODEL = os.environ.get("SEEKFRAME_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
_NO_MARK = np.zeros(256, bool)
_INF = np.int64(1) << 40
#: Longer units are cut into windows of this many bytes, each begun ``STEP`` bytes after the one before.
LONG, STEP = 512, 384
#: Text bytes whose distinct units are encoded once, and piece ids that are decoded at once.
TEXTS, IDS = 8 << 20, 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n


class Pieces:
    """A model's vocabulary: piece keys for probing, scores, and for merge models the order and parts of merges."""

    def __init__(self, model: bytes, merges: bool | None = None):
        self.strings: list[bytes] = []
        scores, kinds = [], []
        self.prefix, self.squeeze, spec, normal = True, True, {}, {}
        for field, value in _fields(model):
            if field == 1:
                x = dict(_fields(value))
                self.strings.append(x[1].replace("▁".encode(), bytes([MARK])))
                scores.append(x.get(2, 0.0))
                kinds.append(x.get(3, 1))
            elif field == 2:
                spec = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if normal.get(2):
            raise ValueError("models with a character map aren't supported")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        if self.squeeze:
            raise ValueError("models that drop extra spaces aren't supported")
        self.merges = spec.get(3, 1) == 2 if merges is None else merges
        kinds = np.array(kinds)
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.bytes = np.full(256, -1)
        for i in np.flatnonzero(kinds == 6):
            self.bytes[int(self.strings[i][3:5], 16)] = i
        self.fallback = bool((self.bytes >= 0).all())
        self.scores = np.array(scores, np.float64)
        self.longest = max(len(self.strings[i]) for i in np.flatnonzero(kinds == 1))
        normal_ids = np.flatnonzero(kinds == 1)
        if any(b"\xff" in self.strings[i].lstrip(b"\xff") for i in normal_ids):
            raise ValueError("a piece crosses words")
        n = len(self.strings)
        self.raw = np.zeros(n, np.uint64)
        self.length = np.array([len(s) for s in self.strings])
        for i in normal_ids:
            d = np.frombuffer(self.strings[i], np.uint8)
            self.raw[i] = (_SYMBOLS[d] * _power_table(_MULTIPLIER, len(d))).sum(dtype=np.uint64)
        keys = self._key(self.raw[normal_ids], self.length[normal_ids])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], normal_ids[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys & np.uint64(0xFFFFF)] = True
        self.floor = float(self.scores[normal_ids].min()) - 10
        if self.merges:
            self._order(normal_ids)
        # what a piece decodes to
        plain = [b"" if kinds[i] == 3 else b" \xe2\x81\x87 " if kinds[i] == 2 else bytes([int(s[3:5], 16)]) if kinds[i] == 6 else s.replace(b"\xff", b" ") for i, s in enumerate(self.strings)]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_at = np.concatenate(([0], np.cumsum([len(s) for s in plain])))
        self._pairs = np.zeros(1 << 20, np.uint64)
        self._pair_ok = np.zeros(1 << 20, bool)

    @staticmethod
    def _key(raw_: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(raw_ + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def probe(self, raw_: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The id of the piece with this hash, or -1."""
        key = self._key(raw_, np.asarray(length))
        out = np.full(key.shape, -1, np.int32)
        some = np.nonzero(self.maybe[key & np.uint64(0xFFFFF)])
        k = key[some]
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == k, self.ids[at], -1)
        return out

    def _order(self, normal_ids: np.ndarray) -> None:
        """rank: when a piece is merged (-1 for characters); left and right: its parts. Pieces that merging can't reach are dropped."""
        n = len(self.strings)
        rank = np.full(n, -1, np.int64)
        by_score = normal_ids[np.argsort(-self.scores[normal_ids], kind="stable")]
        rank[by_score] = np.arange(len(by_score))
        number = {self.strings[i]: int(i) for i in normal_ids}
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        good = np.zeros(n, bool)
        for i in map(int, normal_ids):
            s = self.strings[i]
            parts = [c.encode() for c in s.decode(errors="replace")] if MARK not in s else _characters(s)
            while len(parts) > 1:
                pairs = [(rank[number[parts[k] + parts[k + 1]]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in number]
                if not pairs:
                    break
                k = min(pairs)[1]
                if len(parts) == 2:
                    self.left[i], self.right[i] = number.get(parts[0], -1), number.get(parts[1], -1)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            good[i] = len(parts) == 1
            if len(parts) == 1 and self.left[i] < 0:
                rank[i] = -1
        self.rank = rank
        keep = good[self.ids]
        self.all_keys, self.all_ids = self.keys, self.ids
        self.keys, self.ids = self.keys[keep], self.ids[keep]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves piece b after piece a as they are. -1: a character outside the vocabulary, which never merges."""
        out = np.ones(len(a), bool)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(todo):
            return out
        pair = (a[todo].astype(np.uint64) << np.uint64(32)) | b[todo].astype(np.uint64) | np.uint64(1 << 63)
        slot = (mix(pair) & np.uint64(0xFFFFF)).astype(np.int64)
        known = self._pairs[slot] == pair
        out[todo[known]] = self._pair_ok[slot[known]]
        if not known.all():
            new, back = np.unique(pair[~known], return_inverse=True)
            low = np.uint64(0xFFFFFFFF)
            ok = self._left_alone(((new >> np.uint64(32)) & np.uint64(0x7FFFFFFF)).astype(np.int64), (new & low).astype(np.int64))
            out[todo[~known]] = ok[back]
            slot = (mix(new) & np.uint64(0xFFFFF)).astype(np.int64)
            self._pair_ok[slot] = ok
            self._pairs[slot] = new
            # two new pairs in one slot: the one that is written last holds it
            held = self._pairs[slot] == new
            self._pair_ok[slot[held]] = ok[held]
        return out

    def _left_alone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        until_a = np.full(len(a), _INF)
        until_b = until_a.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            both = self.probe(self.raw[x] + _power_table(_MULTIPLIER, 4 * self.longest)[self.length[x]] * self.raw[y], self.length[x] + self.length[y])
            m = np.where(both >= 0, self.rank[both], _INF)
            # the pair merges unless a's or b's own next merge comes first; of equal ranks the left one comes first
            merged = (m < until_a[live]) & (m <= until_b[live])
            ok[live[merged]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~merged & ((rx >= 0) | (ry >= 0))
            undo_a = more & (rx > ry)
            undo_b = more & ~undo_a
            until_a[live[undo_a]] = rx[undo_a]
            a[live[undo_a]] = self.right[x[undo_a]]
            until_b[live[undo_b]] = ry[undo_b]
            b[live[undo_b]] = self.left[y[undo_b]]
            live = live[more]
        return ok

    def best_paths(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For units of equal length (row, byte): whether a piece starts at each byte, and its id (-1: outside the vocabulary)."""
        rows, n = units.shape
        total = np.zeros((rows, n + 1), np.uint64)
        np.cumsum(_SYMBOLS[units] * _power_table(_MULTIPLIER, n), axis=1, out=total[:, 1:])
        shift = _power_table(_INVERSE, n + 1)
        widest = min(n, self.longest)
        lead = (units & 0xC0) != 0x80
        width = np.where(units < 0xC0, 1, np.where(units < 0xE0, 2, np.where(units < 0xF0, 3, 4)))
        width[units == MARK] = 1
        match = [None, *(self.probe((total[:, w:] - total[:, :-w]) * shift[: n + 1 - w], w) for w in range(1, widest + 1))]
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((rows, n + 1), -1, np.int32)
        back = np.zeros((rows, n + 1), np.int32)
        for j in range(1, n + 1):
            for w in range(1, min(j, widest) + 1):
                i = j - w
                ids = match[w][:, i]
                alone = lead[:, i] & (width[:, i] == w) & (ids < 0) if w <= 4 else None
                can = ids >= 0 if alone is None else (ids >= 0) | alone
                can &= best[:, i] > -np.inf
                at = np.flatnonzero(can)
                if not len(at):
                    continue
                piece = ids[at]
                if self.merges:
                    if i:
                        fits = self.follows(last[at, i], piece)
                        at, piece = at[fits], piece[fits]
                    value = np.full(len(at), float(w))
                else:
                    value = best[at, i] + np.where(piece >= 0, self.scores[piece], self.floor)
                up = value > best[at, j]
                at, piece = at[up], piece[up]
                best[at, j] = value[up]
                last[at, j] = piece
                back[at, j] = w
        start = np.zeros((rows, n), bool)
        chosen = np.full((rows, n), -1, np.int32)
        live, j = np.arange(rows), np.full(rows, n)
        while len(live):
            w = back[live, j]
            if (w <= 0).any():
                raise ValueError("a unit has no path")
            at = j - w
            start[live, at] = True
            chosen[live, at] = last[live, j]
            live, j = live[at > 0], at[at > 0]
        return start, chosen

    def long_path(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ids of the pieces of one long unit."""
        found = self._joined(unit) if self.merges else None
        return self._scalar_path(unit) if found is None else found

    def _joined(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The paths of overlapping windows, joined where neighbours have a piece in common; None if some have none."""

        def back(x: np.ndarray) -> np.ndarray:  # to the start of a character
            for _ in range(3):
                x = x - ((x < len(unit)) & (unit[np.minimum(x, len(unit) - 1)] & 0xC0 == 0x80))
            return x

        begin = np.arange(0, max(1, len(unit) - (LONG - STEP)), STEP)
        begin, end = back(begin), back(np.minimum(begin + LONG, len(unit)))
        end[-1] = len(unit)
        paths: list = [None] * len(begin)
        size = end - begin
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for at in range(0, len(rows), step := max(1, (1 << 18) // int(n))):
                some = rows[at : at + step]
                starts, ids = self.best_paths(unit[begin[some][:, None] + np.arange(n)])
                r, c = np.nonzero(starts)
                cut = np.searchsorted(r, np.arange(len(some) + 1))
                piece = ids[r, c]
                for k, row in enumerate(some):
                    paths[row] = (c[cut[k] : cut[k + 1]] + begin[row], piece[cut[k] : cut[k + 1]])
        places, pieces = [], []
        place, piece = paths[0]
        for k in range(1, len(paths)):
            p, q = paths[k]
            both, i, j = np.intersect1d(place, p, assume_unique=True, return_indices=True)
            same = np.flatnonzero(piece[i] == q[j])
            if not len(same):
                return None
            m = same[len(same) // 2]
            places.append(place[: i[m]])
            pieces.append(piece[: i[m]])
            place, piece = p[j[m] :], q[j[m] :]
        return np.concatenate([*places, place]), np.concatenate([*pieces, piece])

    def _scalar_path(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same dynamic programme over one unit, position by position: matches of a block of positions at a time."""
        n = len(unit)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOLS[unit] * _power_table(_MULTIPLIER, n), out=total[1:])
        shift = _power_table(_INVERSE, n + 1)
        lead = (unit & 0xC0) != 0x80
        width = np.where(unit < 0xC0, 1, np.where(unit < 0xE0, 2, np.where(unit < 0xF0, 3, 4)))
        width[unit == MARK] = 1
        best, last, back = [-np.inf] * (n + 1), np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        best[0] = 0.0
        known: dict[tuple[int, int], bool] = {}

        def fits(a: int, b: int) -> bool:
            if (a, b) not in known:
                known[a, b] = bool(self.follows(np.array([a]), np.array([b]))[0])
            return known[a, b]

        for low in range(1, n + 1, 1 << 14):
            high = min(n + 1, low + (1 << 14))
            ends, widths, ids = [], [], []
            for w in range(1, min(self.longest, n) + 1):
                j = np.arange(max(low, w), high)
                i = j - w
                found = self.probe((total[j] - total[i]) * shift[i], w)
                some = found >= 0
                if w <= 4:
                    some |= lead[i] & (width[i] == w)
                ends.append(j[some])
                widths.append(np.full(int(some.sum()), w))
                ids.append(found[some])
            ends, widths, ids = (np.concatenate(x) for x in (ends, widths, ids))
            order = np.lexsort((widths, ends))
            for j, w, piece in zip(ends[order].tolist(), widths[order].tolist(), ids[order].tolist(), strict=True):
                i = j - w
                if best[i] == -np.inf:
                    continue
                if self.merges:
                    if i and not fits(int(last[i]), piece):
                        continue
                    value = float(w)
                else:
                    value = best[i] + (self.scores[piece] if piece >= 0 else self.floor)
                if value > best[j]:
                    best[j], last[j], back[j] = value, piece, w
        places, pieces, j = [], [], n
        while j:
            if not back[j]:
                raise ValueError("a unit has no path")
            pieces.append(last[j])
            j -= int(back[j])
            places.append(j)
        return np.array(places[::-1]), np.array(pieces[::-1], np.int32)

    def encode_units(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and n + 1 offsets."""
        counts = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(length, kind="stable")
        cut = [0, *(np.flatnonzero(np.diff(length[order])) + 1), len(order)]
        for b, e in zip(cut, cut[1:], strict=False):
            if b == e:
                continue
            n = int(length[order[b]])
            step = max(1, (1 << 16) // n)
            for at in range(b, e, step):
                rows = order[at : min(e, at + step)]
                units = data[start[rows][:, None] + np.arange(n)]
                if n > LONG:
                    found = [self.long_path(u) for u in units]
                    r, c, piece = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                else:
                    begins, ids = self.best_paths(units)
                    r, c = np.nonzero(begins)
                    piece = ids[r, c]
                # bytes of what lies outside the vocabulary
                size = np.ones(len(r), np.int64)
                out = piece < 0
                if self.fallback and out.any():
                    ends = np.append(c[1:], n)
                    ends[np.append(r[1:] != r[:-1], True)] = n
                    size[out] = np.where(units[r[out], c[out]] == MARK, 3, ends[out] - c[out])
                flat = np.repeat(piece, size)
                if out.any():
                    if not self.fallback:
                        flat[flat < 0] = self.unknown
                    else:
                        row, col = np.repeat(r, size), np.repeat(c, size)
                        k = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                        far = flat < 0
                        byte = units[row[far], np.minimum(col[far] + k[far], n - 1)]
                        marks = units[row[far], col[far]] == MARK
                        byte = np.where(marks, np.frombuffer("▁".encode(), np.uint8)[np.minimum(k[far], 2)], byte)
                        flat[far] = self.bytes[byte]
                counts[rows] = np.bincount(r, size, len(rows)).astype(np.int64)
                parts.append((rows, flat))
        at = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(at[-1], np.int32)
        for rows, flat in parts:
            n = counts[rows]
            ids[np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return ids, at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and n + 1 offsets."""
        seen, pieces, shift = [], [], 0
        for b, e in slices(texts):
            data, at = raw(texts.slice(b, e - b))
            data, at = self._marked(data, at)
            units = _units(data, at)
            h = units.hashes(fold=False)
            _, first = np.unique(h, return_index=True)
            n = (units.end - units.start)[first]
            to = np.cumsum(n) - n
            pieces.append(data[np.repeat(units.start[first] - to, n) + np.arange(n.sum())])
            seen.append((h, h[first], shift + to, n, np.diff(units.first)))
            shift += int(n.sum())
        if not seen:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        keys, first = np.unique(np.concatenate([x[1] for x in seen]), return_index=True)
        ids, at = self.encode_units(np.concatenate(pieces), *(np.concatenate([x[k] for x in seen])[first] for k in (2, 3)))
        out, counts = [], []
        for h, _, _, _, n_units in seen:
            row = np.searchsorted(keys, h)
            n = at[row + 1] - at[row]
            out.append(ids[np.repeat(at[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            sums = np.concatenate(([0], np.cumsum(n)))
            counts.append(np.diff(sums[np.concatenate(([0], np.cumsum(n_units)))]))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def _marked(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spaces and U+2581 as marks, and a mark before each text."""
        if b"\xe2\x96\x81" in (whole := data.tobytes()):
            texts = [whole[s:t].replace(b"\xe2\x96\x81", b" ") for s, t in zip(at, at[1:], strict=False)]
            data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        marked = np.where(data == 0x20, MARK, data).astype(np.uint8)
        if not self.prefix:
            return marked, at
        some = np.diff(at) > 0
        return np.insert(marked, at[:-1][some], MARK), at + np.concatenate(([0], np.cumsum(some)))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and n + 1 offsets."""
        n = np.diff(self.plain_at)[ids]
        end = np.concatenate(([0], np.cumsum(n)))
        out = self.plain[np.repeat(self.plain_at[:-1][ids] - end[:-1], n) + np.arange(end[-1])]
        to = end[at]
        if self.prefix:
            some = (np.diff(to) > 0) & (out[np.minimum(to[:-1], max(len(out) - 1, 0))] == 0x20) if len(out) else np.zeros(len(to) - 1, bool)
            out, to = np.delete(out, to[:-1][some]), to - np.concatenate(([0], np.cumsum(some)))
        return out, to


def _characters(s: bytes) -> list[bytes]:
    marks = len(s) - len(s.lstrip(b"\xff"))
    return [b"\xff"] * marks + [c.encode() for c in s[marks:].decode()]


def _units(data: np.ndarray, at: np.ndarray) -> Words:
    """Units start at texts and where a mark follows another byte."""
    units = Words.__new__(Words)
    units.data, units.at = data, at
    first = np.zeros(len(data), bool)
    mark = data == MARK
    first[1:] = mark[1:] & ~mark[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    units.start = np.flatnonzero(first)
    units.end = np.append(units.start[1:], len(data)) if len(units.start) else units.start
    units.first = np.searchsorted(units.start, at)
    return units


def load(path: str = MODEL, merges: bool | None = None) -> Pieces:
    """The vocabulary of a model file; ``merges`` overrides the model's type."""
    with open(path, "rb") as f:
        return Pieces(f.read(), merges)


_loaded: dict[tuple, Pieces] = {}


def _cached(model: bytes, merges: bool | None) -> Pieces:
    key = (hash(model), merges)
    if key not in _loaded:
        _loaded[key] = Pieces(model, merges)
    return _loaded[key]


def _encoded(pieces: Pieces, batch: pa.RecordBatch, text: str, out: str) -> pa.RecordBatch:
    ids, at = pieces.encode(batch[text])
    column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])


def _decoded(pieces: Pieces, batch: pa.RecordBatch, ids: str, out: str) -> pa.RecordBatch:
    column = batch[ids]
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    data, to = pieces.decode(flat, at)
    texts = [data[s:t].tobytes().decode(errors="replace") for s, t in zip(to, to[1:], strict=False)]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])


def _id_slices(column: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``IDS`` piece ids; a longer list is a range of its own."""
    at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + IDS, "right")) - 1)
        yield begin, end
        begin = end


_PIECES, _TEXT = ArrayType(IntegerType(), True), StringType()


def _model(frame: DataFrame, path: str):
    """The driver reads the model file; tasks get its bytes (half a megabyte)."""
    with open(path, "rb") as f:
        return frame.sparkSession.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, path: str = MODEL, text: str = "text", out: str = "pieces", merges: bool | None = None) -> DataFrame:
    """The documents with a column of piece ids."""
    shared, kept = _model(documents, path), documents.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _cached(shared.value, merges)
        for whole in batches:
            for b, e in slices(whole[text], TEXTS):
                yield _encoded(pieces, whole.slice(b, e - b), text, out)

    return mapped(kept, run, StructType([*kept.schema.fields, StructField(out, _PIECES)]))


def decode(rows: DataFrame, path: str = MODEL, ids: str = "pieces", out: str = "decoded") -> DataFrame:
    """The rows with the text of their pieces. Bytes that aren't UTF-8 become replacement characters; no list, no text."""
    shared, kept = _model(rows, path), rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _cached(shared.value, False)
        for whole in batches:
            for b, e in _id_slices(whole[ids]):
                yield _decoded(pieces, whole.slice(b, e - b), ids, out)

    return mapped(kept, run, StructType([*kept.schema.fields, StructField(out, _TEXT)]))


def round_trip(documents: DataFrame, path: str = MODEL, text: str = "text", ids: str = "pieces", out: str = "decoded", merges: bool | None = None) -> DataFrame:
    """The documents with their piece ids and the text that these decode to: both ways in one pass, one Python worker a task."""
    shared, kept = _model(documents, path), documents.drop(ids, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _cached(shared.value, merges)
        for whole in batches:
            for b, e in slices(whole[text], TEXTS):
                coded = _encoded(pieces, whole.slice(b, e - b), text, ids)
                for c, d in _id_slices(coded[ids]):
                    yield _decoded(pieces, coded.slice(c, d - c), ids, out)

    return mapped(kept, run, StructType([*kept.schema.fields, StructField(ids, _PIECES), StructField(out, _TEXT)]))
