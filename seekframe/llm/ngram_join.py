"""N-gram Jaccard join: which documents' shingle sets overlap by at least a threshold, and the groups this makes.

Method: rare-first prefix filtering.  A sketch of fixed size, summed over all documents, orders shingles by how often they
occur (in powers of the square root of two), then by hash.  If two sets reach the threshold, the first
``|x| - ceil(t |x|) + 1`` shingles of each in that order have one in common, so only these prefixes are dealt out, by hash.
Within the documents of a hash, pairs must pass the length and positional filters; distinct pairs must pass the suffix
filter (overlap of the sets' histograms by hash, an upper bound); what is left is verified once, on the sets themselves.

Copies are one class: equal sets are one node, whichever rows have them.  Groups need no pair of two nodes that are already
connected: a first round verifies every node of a hash with the one of the smallest id there, a second one every pair that is still
in different groups.  Of hashes with the same nodes only the first in prefix order is kept.  Nothing is capped, and no
document list comes to the driver: components are found by alternating stars, and the candidates' texts are picked out by a
bitmap of fixed size and an exact join.

No key is bound to one task.  Entries are dealt by hash in parts whose number follows the data; those of a hash that many
sets of one batch have go round these parts, which only get their number and fingerprint.  What follows are aggregates with
map-side partial results and joins that adaptive execution can split; in the second round the nodes of a hash are
dealt out in blocks, and each pair of blocks is a group of its own.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer words than ``width`` has its
whole sequence as its one shingle; a null id links with nothing and has a null component; rows that repeat an id are all
returned, each with the component of its own text (the smallest id there, its own included); further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, mapped, mix, raw, shingle_hashes, slices, written

#: Bits of the frequency sketch and of the candidate bitmap, and bins of a suffix histogram.
SKETCH_BITS, BITMAP_BITS, BINS = 20, 23, 256
_CHUNKS = 64
_SHIFT = np.uint64(64 - SKETCH_BITS)
_SETS = "doc_id long, print long, n long, low long, high long, bins binary"


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By blocks: the first row, and the sorted distinct shingle hashes of each text."""
    for b, e in slices(texts):
        words = Words(*raw(texts.slice(b, e - b)))
        grams, at = shingle_hashes(words.hashes(), words.first, width)
        yield b, [_distinct(grams[s:t]) for s, t in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.diff(x, prepend=~x[:1]) != 0] if len(x) > 1 else x


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def _bins(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(3)).astype(np.int64) & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes()


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document; at the end of the partition its sketch, in chunks with ids below zero in ``n``."""
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)

        def table(columns: list) -> pa.RecordBatch:
            kinds = (*[pa.int64()] * 5, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SETS.split(", ")])

        for batch in batches:
            for b, sets in shingle_sets(batch["text"], width):
                if sum(map(len, sets)):
                    sketch += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
                prints = [_fingerprint(s) for s in sets]
                yield table([batch["doc_id"].slice(b, len(sets)).to_pylist(), batch["print"].slice(b, len(sets)).to_pylist(), [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], [_bins(s) for s in sets]])
        if sketch.any():
            parts = sketch.reshape(_CHUNKS, -1)
            yield table([[None] * _CHUNKS, [None] * _CHUNKS, [-1 - k for k in range(_CHUNKS)], [0] * _CHUNKS, [0] * _CHUNKS, [zstandard.compress(p.tobytes(), 1) for p in parts]])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.uint32).astype(np.uint64) for x in table["bins"])
    return pa.table({"n": pa.array([table["n"][0].as_py()], pa.int64()), "bins": pa.array([total.tobytes()], pa.binary())})


def rarity(sketches: DataFrame) -> np.ndarray:
    """The class of each sketch cell: twice the base-2 logarithm of its count. One byte a cell, whatever the corpus."""
    rows = sketches.groupBy("n").applyInArrow(_summed, "n long, bins binary").collect()
    out = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.uint8)
    for r in rows:
        out[-1 - r["n"]] = np.floor(2 * np.log2(np.frombuffer(r["bins"], np.uint64) + 1)).astype(np.uint8)
    return out.ravel()


def prefix(s: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, in order: one of them is in every set that reaches the threshold with it."""
    size = len(s) - -(-percent * len(s) // 100) + 1
    rank = classes[(s >> _SHIFT).astype(np.int64)]
    return s[np.argsort(rank, kind="stable")[:size]]  # s is sorted: equal classes stay in order of hash


#: A hash that so many sets of a batch have doesn't go to its part: a third of all rows may have it.
HOT = 16
#: Prefix entries that a part should hold, and nodes of a hash that are paired in one group.
PART, BLOCK = 1 << 21, 4096


def _prefixes(width: int, percent: int, shared, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part of the hashes a blob: the sets of this batch that reach it, and their prefix entries.

        A set goes by its fingerprint; copies in a batch are one.  Entries of hot hashes are dealt out evenly, in blobs that
        say so, and the hash's own part gets the sum of their sets' marks instead.
        """
        turn = 0
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            known: set[tuple] = set()
            heads, hashes, counts = [], [], []
            for b, sets in shingle_sets(batch["text"], width):
                for i, s in enumerate(sets):
                    if not len(s) or ids[b + i] is None:
                        continue
                    low, high = _fingerprint(s)
                    if (key := (low, high, len(s))) in known:
                        continue
                    known.add(key)
                    heads.append(low)
                    p = prefix(s, shared.value, percent)
                    hashes.append(p)
                    counts.append(len(p))
            if not heads:
                continue
            head = np.array(heads, np.int64)
            h = np.concatenate(hashes)
            doc = np.repeat(np.arange(len(heads)), counts)
            # a place beyond 65,535 counts as that: the positional bound only gets looser
            place = np.minimum(np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts), 65535).astype(np.uint16)
            _, back, often = np.unique(h, return_inverse=True, return_counts=True)
            hot = often[back] >= HOT
            home = (mix(h) % np.uint64(n_parts)).astype(np.int64)
            # hot entries take turns by runs of a thousand
            part = np.where(hot, (turn + np.cumsum(hot) // 1024) % n_parts, home)
            turn += int(hot.sum()) // 1024 + 1
            key = 2 * part + hot
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order], prepend=-1))
            parts, blobs = [], []
            for b, e in zip(cut, [*cut[1:], len(order)], strict=True):
                rows = order[b:e]
                used, local = np.unique(doc[rows], return_inverse=True)
                parts.append(part[rows[0]])
                blobs.append(np.array([int(hot[rows[0]]), len(used), len(rows)], np.int64).tobytes() + head[used].tobytes() + h[rows].tobytes() + local.astype(_local(len(used))).tobytes() + place[rows].tobytes())
            if hot.any():
                rows = np.flatnonzero(hot)
                rows = rows[np.argsort(h[rows], kind="stable")]
                start = np.flatnonzero(np.diff(h[rows], prepend=~h[rows[:1]]) != 0)
                sums, at = np.add.reduceat(_mark(head[doc[rows]]), start), rows[start]
                for k in np.unique(home[at]):
                    some = home[at] == k
                    parts.append(k)
                    blobs.append(np.array([2, 0, some.sum()], np.int64).tobytes() + h[at[some]].tobytes() + sums[some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


def _mark(sets: np.ndarray) -> np.ndarray:
    return mix(sets.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, docs, rows = np.frombuffer(blob, np.int64, 3)
    ids = np.frombuffer(blob, np.int64, docs, 24)
    at, kind = 24 + 8 * docs, np.dtype(_local(docs))
    return np.frombuffer(blob, np.uint64, rows, at), ids[np.frombuffer(blob, kind, rows, at + 8 * rows)], np.frombuffer(blob, np.uint16, rows, at + (8 + kind.itemsize) * rows)


def _local(sets: int) -> type:
    """What holds a set's number in its blob."""
    return np.uint16 if sets <= 1 << 16 else np.uint32


_ENTRY = "head boolean, hash long, same long, rank int, set long, place int"
#: Flipped, a signed column sorts as the unsigned hashes in prefixes do.
_TOP = np.uint64(1 << 63)


def _entries(table: pa.Table, classes: np.ndarray) -> pa.Table:
    """Entries of hashes that two or more sets have, and for each such hash a head: a fingerprint of its sets and its rarity.

    The fingerprint sums a mark for each set and batch that has it.  A batch has all of a set's prefix or nothing, so hashes
    of the same sets have the same sum.
    """
    kinds: list[list[bytes]] = [[], [], []]
    for b in table["blob"]:
        blob = b.as_py()
        kinds[int(np.frombuffer(blob, np.int64, 1)[0])].append(blob)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
    h, sets, place = (np.concatenate(x) for x in zip(none, *map(_unpacked, kinds[0]), strict=True))
    moved, moved_sum = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for blob in kinds[2]:
        n = int(np.frombuffer(blob, np.int64, 3)[2])
        moved, moved_sum = np.append(moved, np.frombuffer(blob, np.uint64, n, 24)), np.append(moved_sum, np.frombuffer(blob, np.uint64, n, 24 + 8 * n))
    order = np.lexsort((sets, h))
    h, sets, place = h[order], sets[order], place[order]
    keys, start = np.unique(h, return_index=True)
    several = np.zeros(len(keys), bool)
    sums = np.zeros(len(keys), np.uint64)
    if len(keys):
        end = np.append(start[1:], len(h))
        several = sets[start] != sets[end - 1]
        sums = np.add.reduceat(_mark(sets), start)
    every = np.unique(np.concatenate([keys[several], moved]))
    total = np.zeros(len(every), np.uint64)
    at = np.minimum(np.searchsorted(every, keys), max(len(every) - 1, 0))
    good = every[at] == keys if len(every) else np.zeros(len(keys), bool)
    total[at[good]] = sums[good]
    np.add.at(total, np.searchsorted(every, moved), moved_sum)
    # of hashes with the same sets the first of this part; the first of all parts is found later
    rank = classes[(every >> _SHIFT).astype(np.int64)]
    order = np.lexsort((every, rank, total))
    ahead = np.zeros(len(every), bool)
    ahead[order] = np.diff(total[order].view(np.int64), prepend=~total[order[:1]].view(np.int64)) != 0
    every, total = every[ahead], total[ahead]
    at = np.minimum(np.searchsorted(every, keys), max(len(every) - 1, 0))
    good = every[at] == keys if len(every) else good
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (sets[1:] != sets[:-1])
    first &= np.repeat(good, np.diff(np.append(start, len(h)))) if len(h) else first
    hot = [_unpacked(b) for b in kinds[1]]
    h, sets, place = (np.concatenate(x) for x in zip((h[first], sets[first], place[first]), *hot, strict=True))
    n, m = len(every), len(h)
    flat = lambda a, b: pa.array(np.concatenate([a, b]))
    blank = lambda k, t: np.zeros(k, t)
    return pa.table({
        "head": flat(np.ones(n, bool), blank(m, bool)), "hash": flat((every ^ _TOP).view(np.int64), (h ^ _TOP).view(np.int64)), "same": flat(total.view(np.int64), blank(m, np.int64)),
        "rank": flat(classes[(every >> _SHIFT).astype(np.int64)].astype(np.int32), blank(m, np.int32)), "set": flat(blank(n, np.int64), sets), "place": flat(blank(n, np.int32), place.astype(np.int32)),
    })


def _passes(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filters, n1 <= n2; places count from 0. The needed overlap is t / (1 + t) of both sizes.

    The smaller set needs at least 2 t / (1 + t) of its own size, so its shorter prefix for that holds a common shingle too.
    """
    need = -(-percent * (n1 + n2) // (100 + percent))
    most = np.minimum(p1, p2) + np.minimum(n1 - p1, n2 - p2)
    return (100 * n1 >= percent * n2) & (most >= need) & (p1 <= n1 - -(-2 * percent * n1 // (100 + percent)))


def _allowed(x: np.ndarray, y: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: the overlap that the sets' histograms allow, bin by bin, is enough. A full bin bounds nothing."""
    full = (x == 255) | (y == 255)
    most = np.where(full, np.minimum(n1, n2)[:, None], np.minimum(x, y)).sum(axis=1, dtype=np.int64)
    return most >= -(-percent * (n1 + n2) // (100 + percent))


def _bins_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _pair_table(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    u = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, 0])), pa.array(np.ascontiguousarray(u[:, 1]))], ["a", "b"])


def _kept(percent: int):
    """Of given pairs (x, y) with sizes and histograms those that pass the suffix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 15):
                batch = whole.slice(at, 1 << 15)
                x, y, nx, ny = (batch[c].to_numpy().astype(np.int64) for c in ("x", "y", "nx", "ny"))
                ok = _allowed(_bins_of(batch["bx"]), _bins_of(batch["by"]), nx, ny, percent)
                yield _pair_table(x[ok], y[ok])

    return run


def _pairs(percent: int):
    """Candidate pairs of different groups in a stream sorted by hash, blocks, size and node; a group of rows has two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("hash", "blocks", "own", "node", "n", "place", "grp")

        def found(x: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            h, blocks, own, node, n, place, grp = (x[c] for c in names)
            start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (blocks[1:] != blocks[:-1]))))
            length = np.diff(np.append(start, len(h)))
            # a group of two blocks only pairs rows of different ones
            cross = np.repeat(np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start), length)
            # the smaller set of a pair has the hash in its shorter prefix
            rows, end, step = np.flatnonzero(place <= n - -(-2 * percent * n // (100 + percent))), np.repeat(start + length, length), 1
            while True:
                rows = rows[rows + step < end[rows]]
                # sizes ascend in a group: a row too short for this one is too short for all later ones
                rows = rows[100 * n[rows] >= percent * n[rows + step]] if len(rows) else rows
                if not len(rows):
                    return
                i, j = rows, rows + step
                ok = (grp[i] != grp[j]) & (~cross[i] | (own[i] != own[j]))
                i, j = i[ok], j[ok]
                ok = _passes(n[i], place[i], n[j], place[j], percent)
                i, j = i[ok], j[ok]
                for b in range(0, len(i), 1 << 15):
                    k, m = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
                    ok = _allowed(x["bins"][k], x["bins"][m], n[k], n[m], percent)
                    yield node[k[ok]], node[m[ok]]
                step += 1

        kept, size = [], 0

        def collected(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal kept, size
            for k, m in found(x):
                kept.append(np.stack([np.minimum(k, m), np.maximum(k, m)], axis=1))
                size += len(k)
                if size > 1 << 20:  # the same pair comes under many hashes
                    u = np.unique(np.concatenate(kept), axis=0)
                    kept, size = [u], len(u)
                    if size > 1 << 19:
                        yield _pair_table(u[:, 0], u[:, 1])
                        kept, size = [], 0

        held: list[dict[str, np.ndarray]] = []  # rows of the group that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch[c].to_numpy().astype(np.int64) for c in names}
            x["bins"] = _bins_of(batch["bins"])
            new = np.flatnonzero((x["hash"] != x["hash"][-1]) | (x["blocks"] != x["blocks"][-1]))
            last = int(new[-1]) + 1 if len(new) else 0
            if held and (last or (held[0]["hash"][0], held[0]["blocks"][0]) != (x["hash"][-1], x["blocks"][-1])):
                held.append({c: v[:last] for c, v in x.items()})
                yield from collected({c: np.concatenate([p[c] for p in held]) for c in x})
                held = []
            elif last:
                yield from collected({c: v[:last] for c, v in x.items()})
            held.append({c: v[last:] for c, v in x.items()})
        if held:
            yield from collected({c: np.concatenate([p[c] for p in held]) for c in held[0]})
        if size:
            u = np.concatenate(kept)
            yield _pair_table(u[:, 0], u[:, 1])

    return run


def _bitmap(table: pa.Table) -> pa.Table:
    low = np.zeros((1 << BITMAP_BITS) // _CHUNKS // 8, np.uint8)
    at = table["slot"].to_numpy()
    np.bitwise_or.at(low, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "bits": pa.array([low.tobytes()], pa.binary())})


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _texts(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, set and compressed text of the documents with these ids, and of a few others: a bitmap of fixed size tells, a join must follow."""
    spark = documents.sparkSession
    per = (1 << BITMAP_BITS) // _CHUNKS

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.unique(_slots(batch["doc_id"].to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((s // per).astype(np.int32)), pa.array((s % per).astype(np.int32))], ["chunk", "slot"])

    rows = mapped(ids, slotted, "chunk int, slot int").distinct().groupBy("chunk").applyInArrow(_bitmap, "chunk int, bits binary").collect()
    bits = np.zeros((_CHUNKS, per // 8), np.uint8)
    for r in rows:
        bits[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.ravel())  # one megabyte

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slots(batch["doc_id"].to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            keep = pa.array(np.flatnonzero(shared.value[at >> 3] >> (at & 7) & 1))
            some, ids_of = batch["text"].take(keep), batch["doc_id"].take(keep)
            for b, sets in shingle_sets(some, width):
                texts = [zstandard.compress(t.encode(), 3) for t in some.slice(b, len(sets)).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids_of.slice(b, len(sets)), pa.array([_fingerprint(s)[0] for s in sets], pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "set", "packed"])

    found = mapped(documents.where("doc_id is not null and text is not null"), picked, "doc_id long, set long, packed binary")
    return found.groupBy("doc_id", "set").agg(F.min("packed").alias("packed"))  # rows that repeat are one


def _verified(width: int, percent: int):
    """Links of a stream of (a, chunk, own, b, packed) sorted so that each chunk of a's partners follows a itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = pa.array([zstandard.decompress(x) for x in batch["packed"].to_pylist()], pa.binary())
                out = []
                a, chunk, own, b = (batch[c].to_pylist() for c in ("a", "chunk", "own", "b"))
                for first, block in shingle_sets(texts, width):
                    for i, s in enumerate(block, first):
                        if (a[i], chunk[i]) != now:
                            now, sets = (a[i], chunk[i]), []
                        if own[i] == 0:
                            sets.append(s)
                            continue
                        for t in sets:
                            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                                both = len(np.intersect1d(s, t, assume_unique=True))
                                if 100 * both >= percent * (len(s) + len(t) - both):
                                    out.append((a[i], b[i]))
                                    break
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """Each node of links and its component (its smallest node) from links (a, b), by alternating large and small stars until nothing changes."""
    edges = written(links.select("a", "b").where("a <> b").distinct(), "star")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "star")
        # now a > b for all edges: each points to something smaller
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _candidates(docs: DataFrame, nodes: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """hash, node, its smallest id, size and place of the prefix entries whose hash is the first of its family of nodes."""
    spark = docs.sparkSession
    total = nodes.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100D) + 1"))).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART))
    blobs = mapped(docs, _prefixes(width, percent, classes, n_parts), "part int, blob binary")
    both = written(blobs.groupBy("part").applyInArrow(lambda t: _entries(t, classes.value), _ENTRY), "join-entries", "head")
    firsts = both.where("head").groupBy("same").agg(F.min(F.struct("rank", "hash")).alias("f")).select("f.hash")
    entries = both.where("not head").select("hash", "set", "place").join(firsts, "hash", "left_semi")
    known = nodes.select(F.col("low").alias("set"), "node", "stands", F.col("n").cast("int").alias("n"))
    return written(entries.join(known, "set").select("hash", "node", "stands", "n", "place"), "join-buckets")


def _with_first(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of the node with a hash's smallest id and each other one there."""
    lead = buckets.groupBy("hash").agg(F.min(F.struct("stands", "node", "n", "place")).alias("lead"))
    met = buckets.join(lead, "hash").where("node <> lead.node")
    less = F.expr("n < lead.n or n = lead.n and node < lead.node")
    pair = [F.when(less, F.col(a)).otherwise(F.col(b)).alias(c) for c, a, b in (("x", "node", "lead.node"), ("y", "lead.node", "node"), ("nx", "n", "lead.n"), ("ny", "lead.n", "n"), ("px", "place", "lead.place"), ("py", "lead.place", "place"))]
    near = met.select(*pair).where(_passing("nx", "px", "ny", "py", percent)).select("x", "y", "nx", "ny").distinct()
    bins = nodes.select("node", "bins")
    given = near.join(bins.toDF("x", "bx"), "x").join(bins.toDF("y", "by"), "y")
    return mapped(given, _kept(percent), "a long, b long")


def _passing(n1: str, p1: str, n2: str, p2: str, percent: int) -> Column:
    """The filters of _passes as a column."""
    both = 100 + percent
    need = f"(({percent} * ({n1} + {n2}) + {both - 1}) div {both})"
    return F.expr(f"100 * {n1} >= {percent} * {n2} and least({p1}, {p2}) + least({n1} - {p1}, {n2} - {p2}) >= {need}") & _short(n1, p1, percent)


def _short(n: str, place: str, percent: int) -> Column:
    """Whether a place is in the shorter prefix, where the smaller set of a pair has a common hash."""
    return F.expr(f"{place} <= {n} - (2 * {percent} * {n} + {99 + percent}) div {100 + percent}")


def _between_groups(buckets: DataFrame, groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of a hash's nodes that are in different groups."""
    grouped = buckets.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK)))
    mixed = grouped.groupBy("hash").agg(F.min("grp").alias("g"), F.max("grp").alias("h"), F.bool_or(_short("n", "place", percent)).alias("short"), F.min("stands").alias("lead"), F.pow(F.lit(2), size).cast("int").alias("blocks"))
    rows = grouped.join(mixed.where("g < h and short").select("hash", "lead", "blocks"), "hash").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    # a row of block i meets block j in the group of both
    met = rows.join(nodes.select("node", "bins"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("blocks", F.expr("cast(least(own, other) as long) * blocks + greatest(own, other)"))
    # hashes of one family of nodes have the same smallest id: a pair that comes under many of them is one pair in its task
    ordered = met.select("hash", "blocks", "own", "node", "n", "place", "grp", "bins", "lead").repartition("lead", "blocks").sortWithinPartitions("hash", "blocks", "n", "node")
    return mapped(ordered, _pairs(percent), "a long, b long")


def _linked(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold, each verified once."""
    pairs = written(candidates.distinct(), "join-pairs")
    # partners of one node go in chunks, each after a copy of the node's own text
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("chunks"))
    dealt = pairs.join(share, "a").select("a", F.expr("cast(pmod(xxhash64(b), chunks) as int)").alias("chunk"), "b")
    rows = dealt.select("a", "chunk", F.lit(1).alias("own"), "b").unionByName(dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("own"), F.col("a").alias("b")))
    needed = nodes.select(F.col("node").alias("b"), F.col("stands").alias("doc_id"), F.col("low").alias("set")).join(pairs.select(F.explode(F.array("a", "b")).alias("b")).distinct(), "b")
    # texts move once to meet their rows, and rows take them to their chunk
    full = rows.join(needed, "b").join(_texts(docs, needed.select("doc_id"), width), ["doc_id", "set"]).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "own", "b")
    return written(mapped(full.select("a", "chunk", "own", "b", "packed"), _verified(width, percent), "a long, b long"), "join-links")


def text_print(text: Column) -> Column:
    """Tells apart texts that stand under one id."""
    return F.xxhash64(text)


def join(documents: DataFrame, width: int = 5, percent: int = 80, detail: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document.

    With ``detail`` also ``print``, the row's text_print, and ``grp``, a number of its component (null without shingles or id).
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_print(F.col("text")).alias("print"))
    both = written(mapped(docs, _sets(width), _SETS).withColumn("sketch", F.col("n") < 0), "join-sets", "sketch")
    sets = both.where("not sketch").drop("sketch")
    classes = spark.sparkContext.broadcast(rarity(both.where("sketch").select("n", "bins")))

    # one row, and a number, for each set, with the smallest id that has it
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("low", "high", "n").agg(F.min("doc_id").alias("stands"), F.min("bins").alias("bins"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")

    buckets = _candidates(docs, nodes, classes, width, percent)
    links = _linked(docs, nodes, _with_first(buckets, nodes, percent), width, percent)
    groups = written(components(links), "join-groups")
    more = _linked(docs, nodes, _between_groups(buckets, groups, nodes, percent), width, percent)
    groups = written(components(links.unionByName(more)), "join-groups")

    least = groups.join(nodes.select("node", "stands"), "node").groupBy("component").agg(F.min("stands").alias("least"))
    own = groups.join(least, "component")
    of_set = nodes.select("node", "stands", "low", "high", "n").join(own, "node", "left").select("low", "high", "n", F.coalesce("least", "stands").alias("component_id"), F.coalesce("component", "node").alias("grp"))
    of_row = sets.select("doc_id", "print", "n", "low", "high").join(of_set, ["low", "high", "n"], "left")
    known = F.col("doc_id").isNotNull()
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id")]
    return of_row.select(*out, *([F.col("print"), F.when(known, F.col("grp")).alias("grp")] if detail else []))
