"""Scoring by a language model: context-tree weighting over bytes.

Each byte is eight binary decisions; each decision node has a context tree over the ``DEPTH`` bytes before it, whose nodes
estimate by Krichevsky-Trofimov and mix with their children, half and half.  The probability of a sequence depends only on
counts, so training is one count of (DEPTH + 1)-byte grams over all training documents, dealt out by the two bytes
next to the predicted one: a group holds whole subtrees, and only the sums at depth 1 and 0 (at most 65,280 rows)
meet on the driver.  The same pass counts words for the add-one unigram base.

Texts are scored from two lookups, gram to log probability and word to count.  The most frequent keys (a fixed number)
are broadcast as direct-mapped tables; every other key goes through a join, so the result is exact at any size.

A text is its UTF-8 bytes and an end mark, after ``DEPTH`` marks of the same kind (0xFF, no byte of UTF-8).  Defined
results: a null text is empty and has the end alone; repeated rows count each time and are scored alike; without
training documents every byte has probability 1/256 and words are unknown; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, hash_of, mix, raw, slices, written

DEPTH = 4
MARK = 0xFF
#: The hash that stands for a document's end among the words (a word can't hold this byte).
END = np.uint64(hash_of(b"\x20"))
#: Keys that are broadcast at most, and slots of their tables.
MOST_WORDS, WORD_SLOTS = 1 << 17, 1 << 19
MOST_GRAMS, GRAM_SLOTS = 1 << 18, 1 << 20
WORD, GRAM, DOCUMENT = 0, 1, 2


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series after eight steps up; for x > 0."""
    x = np.asarray(x, np.float64)
    product = np.ones_like(x)
    big = x > 100
    y = np.where(big, x, x + 8)
    for k in range(8):
        product *= np.where(big, 1, x + k)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives any one sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key (context, then next byte) for each byte and end of the block's texts, and n + 1 offsets."""
    n = np.diff(at)
    begin = at[:-1] + (DEPTH + 1) * np.arange(len(n))
    stream = np.full(len(data) + (DEPTH + 1) * len(n), MARK, np.uint8)
    stream[np.arange(len(data)) + np.repeat(DEPTH + begin - at[:-1], n)] = data
    where = np.arange(len(data) + len(n)) + np.repeat(begin + DEPTH - at[:-1] - np.arange(len(n)), n + 1)
    key = np.zeros(len(where), np.uint64)
    for back in range(DEPTH, -1, -1):
        key = (key << np.uint64(8)) | stream[where - back]
    return key, np.concatenate(([0], np.cumsum(n + 1)))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, after each document's, of its end; and n + 1 offsets."""
    words = Words(data, at)
    h = np.insert(words.hashes(), words.first[1:], END)
    return h, words.first + np.arange(len(at))


def _reduced(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros((len(every), counts[0].shape[1]), np.int64)
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(back, np.concatenate([c[:, k] for c in counts]), len(every))
    return every, out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch: words of training documents, and grams of all, with their number in training and in all documents."""
    for batch in batches:
        words, grams_ = ([], []), ([], [])
        train = ~np.array(batch["held_out"].to_pylist(), bool)
        for b, e in slices(batch["text"]):
            data, at = raw(batch["text"].slice(b, e - b))
            for (keys, counts), (h, first) in ((words, tokens(data, at)), (grams_, grams(data, at))):
                seen = h[np.repeat(train[b:e], np.diff(first))]
                if keys is words[0]:
                    h = seen
                # plain sorts, one of all and one of the training part, are much faster than one that keeps places
                u, n = np.unique(h, return_counts=True)
                v, m = (u, n) if len(seen) == len(h) else np.unique(seen, return_counts=True)
                both = np.zeros((len(u), 2), np.int64)
                both[np.searchsorted(u, v), 0] = m
                both[:, 1] = n
                keys.append(u)
                counts.append(both)
        for kind, (keys, counts) in ((WORD, words), (GRAM, grams_)):
            if keys:
                u, n = _reduced(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["kind", "key", "n", "n_all"])


def count(documents: DataFrame) -> DataFrame:
    """kind, key, n (in training documents), n_all, from documents (text, held_out), written to the shared folder."""
    each = documents.select("text", "held_out").mapInArrow(_counted, "kind int, key long, n long, n_all long")
    return written(each.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")), "lm-counts", "kind")


def _bits(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 8): decision node of each bit (1 to 255) and the bit."""
    k = np.arange(8)
    b = byte.astype(np.int64)[:, None]
    return (1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1


class Level:
    """Nodes of one depth: sorted keys (context, decision node), counts, estimate and mixture in logs."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.estimate = log_kt(zeros, ones)
        self.mixture = self.estimate if children is None else np.logaddexp(self.estimate, children) - np.log(2)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts, estimate and mixture; zero where there is no node."""
        if not len(self.keys):
            z = np.zeros(keys.shape)
            return z, z, z, z
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        has = self.keys[i] == keys
        return tuple(np.where(has, x[i], 0.0) for x in (self.zeros, self.ones, self.estimate, self.mixture))


def levels(key: np.ndarray, n: np.ndarray, down: int, to: int) -> dict[int, Level]:
    """The nodes at depths ``down`` to ``to`` (fewer) from counts of grams."""
    some = n > 0
    key, n = key[some], n[some]
    node, bit = _bits((key & np.uint64(0xFF)).astype(np.int64))
    context = (key >> np.uint64(8)).astype(np.int64)
    out: dict[int, Level] = {}
    below: Level | None = None
    for depth in range(down, to - 1, -1):
        keys = (((context & ((1 << (8 * depth)) - 1)) << 8)[:, None] | node).ravel()
        u, back = np.unique(keys, return_inverse=True)
        ones = np.bincount(back, (n[:, None] * bit).ravel(), len(u))
        total = np.bincount(back, np.repeat(n, 8), len(u))
        children = None
        if below is not None:
            parent = (below.keys >> 8 & ((1 << (8 * depth)) - 1)) << 8 | below.keys & 0xFF
            children = np.bincount(np.searchsorted(u, parent), below.mixture, len(u))
        below = out[depth] = Level(u, total - ones, ones, children)
    return out


def log_probabilities(key: np.ndarray, nodes: dict[int, Level]) -> np.ndarray:
    """Natural log of the probability of each gram's last byte after its context."""
    node, bit = _bits((key & np.uint64(0xFF)).astype(np.int64))
    context = (key >> np.uint64(8)).astype(np.int64)
    left, p = np.ones(node.shape), np.zeros(node.shape)
    for depth in range(DEPTH + 1):
        zeros, ones, estimate, mixture = nodes[depth].at(((context & ((1 << (8 * depth)) - 1)) << 8)[:, None] | node)
        here = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
        stop = np.exp(estimate - mixture - np.log(2)) if depth < DEPTH else 1.0
        if depth < DEPTH:
            stop = np.minimum(np.where(zeros + ones > 0, stop, 0.5), 1.0)
        p += left * stop * here
        left = left * (1 - stop)
    return np.log(p).sum(axis=1)


_SEAM = 2  # bytes next to the predicted one that all grams of a group share


def _group_sums(table: pa.Table) -> pa.Table:
    """The group's depth-2 nodes: byte before, decision node, counts and mixture."""
    key = table["key"].to_numpy().view(np.uint64)
    top = levels(key, table["n"].to_numpy(), DEPTH, _SEAM)[_SEAM]
    return pa.table({"near": pa.array(((top.keys >> 8) & 0xFF).astype(np.int32)), "node": pa.array((top.keys & 0xFF).astype(np.int32)), "zeros": pa.array(top.zeros.astype(np.int64)), "ones": pa.array(top.ones.astype(np.int64)), "mixture": pa.array(top.mixture)})


def top_levels(rows: pa.Table) -> dict[int, Level]:
    """Depths 1 and 0 from the summed depth-2 nodes (near, node, zeros, ones, mixture)."""
    x = np.stack([rows[c].to_numpy().astype(np.float64) for c in ("near", "node", "zeros", "ones", "mixture")], axis=1)
    keys = (x[:, 0].astype(np.int64) << 8) | x[:, 1].astype(np.int64)
    order = np.argsort(keys)
    keys, x = keys[order], x[order]
    one = Level(keys, x[:, 2], x[:, 3], x[:, 4])
    u, back = np.unique(keys & 0xFF, return_inverse=True)
    return {1: one, 0: Level(u, *(np.bincount(back, v, len(u)) for v in (one.zeros, one.ones, one.mixture)))}


def values(counts: DataFrame) -> tuple[DataFrame, int, int]:
    """kind, key, n_all and value (words: log10 of count + 1; grams: log10 of the probability), written; and N and V of the words."""
    spark = counts.sparkSession
    words = counts.where((F.col("kind") == WORD) & (F.col("n") > 0))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    near = counts.where(F.col("kind") == GRAM).withColumn("seam", F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * _SEAM)) - 1))).select("seam", "key", "n", "n_all")
    sums = near.where("n > 0").groupBy("seam").applyInArrow(_group_sums, "near int, node int, zeros long, ones long, mixture double")
    rows = sums.groupBy("near", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixture").alias("mixture")).toArrow()  # at most 256 * 255
    top = spark.sparkContext.broadcast(top_levels(rows))

    def evaluated(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy().view(np.uint64)
        nodes = top.value | levels(key, table["n"].to_numpy(), DEPTH, _SEAM)
        out = np.concatenate([log_probabilities(key[b : b + 65536], nodes) for b in range(0, len(key), 65536)])
        return pa.table({"key": table["key"], "n_all": table["n_all"], "value": pa.array(out / np.log(10))})

    scored = near.groupBy("seam").applyInArrow(evaluated, "key long, n_all long, value double").select(F.lit(GRAM).alias("kind"), "key", "n_all", "value")
    counted = words.select("kind", "key", "n_all", F.log10(F.col("n") + 1).alias("value"))
    return written(counted.unionByName(scored), "lm-values", "kind"), int(n), int(v)


class Table:
    """A direct-mapped table of the most frequent keys; a key whose slot another one has isn't in it."""

    def __init__(self, rows: pa.Table, slots: int):
        key = rows["key"].to_numpy().astype(np.int64).view(np.uint64)[::-1]
        value = rows["value"].to_numpy()[::-1]
        self.keys, self.values, self.full = np.zeros(slots, np.uint64), np.zeros(slots), np.zeros(slots, bool)
        slot = self._slot(key)
        # of repeated slots the last write stays, which is the most frequent key
        self.keys[slot], self.values[slot], self.full[slot] = key, value, True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the key is in the table, and its value."""
        slot = self._slot(key)
        return self.full[slot] & (self.keys[slot] == key), self.values[slot]


_PARTS = "kind int, uid long, key long, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, model double"


def _parts(word_table, gram_table):
    """For each text what the tables know, and (uid, key, number) of the keys that they don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARTS.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in _PARTS.split(", ")]

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            uid = batch["uid"].to_numpy()
            for b, e in slices(batch["text"]):
                data, at = raw(batch["text"].slice(b, e - b))
                sums, known, n_tokens = [], None, None
                for kind, table, (key, first) in ((WORD, word_table.value, tokens(data, at)), (GRAM, gram_table.value, grams(data, at))):
                    has, value = table.find(key)
                    doc = np.repeat(np.arange(e - b), np.diff(first))
                    sums.append(np.bincount(doc[has], value[has], e - b))
                    if kind == WORD:
                        known, n_tokens = np.bincount(doc[has], minlength=e - b), np.diff(first)
                    doc, key = doc[~has], key[~has]
                    if len(key):
                        order = np.lexsort((key, doc))
                        doc, key = doc[order], key[order]
                        new = np.ones(len(key), bool)
                        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                        head = np.flatnonzero(new)
                        yield rows(len(head), kind=np.full(len(head), kind, np.int32), uid=uid[b:e][doc[head]], key=key[head].view(np.int64), tf=np.diff(np.append(head, len(key))))
                yield rows(e - b, kind=np.full(e - b, DOCUMENT, np.int32), uid=uid[b:e], doc_id=batch["doc_id"].slice(b, e - b), held_out=batch["held_out"].slice(b, e - b), n_tokens=n_tokens, n_known=known, n_bytes=np.diff(at), base=sums[0], model=sums[1])

    return run


def score(documents: DataFrame, held_out: str = "held_out", most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) and bits_per_byte.

    documents: doc_id, text and a boolean column that keeps a document out of training.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    known, n, v = values(count(docs))

    def table(kind: int, most: int, slots: int):
        rows = known.where(F.col("kind") == kind).orderBy(F.desc("n_all"), "key").limit(most).select("key", "value").toArrow()
        return spark.sparkContext.broadcast(Table(rows, slots))

    tables = table(WORD, most_words, WORD_SLOTS), table(GRAM, most_grams, GRAM_SLOTS)
    parts = written(docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_parts(*tables), _PARTS), "lm-parts", "kind")
    rare = parts.where(F.col("kind") < DOCUMENT).select("kind", "uid", "key", "tf").join(known.select("kind", "key", "value"), ["kind", "key"])
    is_word = F.col("kind") == WORD
    rest = rare.groupBy("uid").agg(
        F.sum(F.when(is_word, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.when(is_word, F.col("tf") * F.col("value")).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(~is_word, F.col("tf") * F.col("value")).otherwise(0.0)).alias("more_model"),
    )
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    model = F.col("model") + more("more_model")
    return parts.where(F.col("kind") == DOCUMENT).join(rest, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more("more_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        model.alias("score"),
        (-model / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
