"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND pruning.

Every training passage (``window`` words, one starting every ``stride``) is a query against the test items.  Items lie in
blocks; for each term the index holds its largest impact in each block and over all.  A passage goes on only with the
blocks whose summed block maxima reach the threshold (first the global maxima, then block by block), and only there
are items scored in full.  The threshold is a share of an item's own best score, or of its weakest part of ``window`` words
where that is less, so long and short items are alike: an item that a document holds whole is retrieved, however long.
What passes is verified against the document: the item's text is cut into question (all sentences but the last)
and answer (the last), and shares of their word ``n``-grams found in the document decide.

The index covers a chunk of at most ``chunk_items`` items and is broadcast; more items mean more chunks, each a pass over
the passages.  Item counts of terms and the mean length are those of all items, whatever the chunk.  Items of fewer words than ``n`` are compared by their whole word sequence.

Defined results: null and empty texts and items match nothing; repeated rows and items match alike; further columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LETTER_BREAK, Words, mapped, raw, shingle_hashes, slices

#: Passage length and step in words, n of the verifying n-grams, items of a block, items of a chunk.
WINDOW, STRIDE, N, BLOCK, CHUNK = 48, 24, 4, 8, 20_000
#: Share of the BM25 score of an item, or of its weakest window, that a passage must reach, and shares of n-grams that verify it.
THRESHOLD, QUESTION, ANSWER = 0.3, 0.5, 0.5
K1, B = 1.2, 0.75
_HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


_BREAK = LETTER_BREAK.copy()
_BREAK[48:58] = False


def _words(texts: pa.Array) -> Words:
    """Runs of letters and digits: case, punctuation and markup around a leaked word don't hide it."""
    return Words(*raw(pc.utf8_lower(texts)), _BREAK)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer; a single sentence is both."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(sentences) < 2:
        return text, text
    return " ".join(sentences[:-1]), sentences[-1]


def _grams(texts: list[str]) -> list[np.ndarray]:
    words = _words(pa.array(texts, pa.string()))
    grams, at = shingle_hashes(words.hashes(), words.first, N)
    return [np.unique(grams[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _weakest(code: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least sum of values over the distinct codes of any ``WINDOW`` words in a row of each item; of all words, if it has no more."""
    n = len(code)
    item = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((np.arange(n), code, item))
    again = np.flatnonzero((np.diff(code[order], prepend=-1) == 0) & (np.diff(item[order], prepend=-1) == 0))
    before = first[item] - 1  # the word's place before, which windows that count this one start after
    before[order[again]] = order[again - 1]
    last = np.maximum(first[1:] - WINDOW, first[:-1])[item]  # the item's last window
    at = np.arange(n)
    low, high = np.maximum(before + 1, np.maximum(at - WINDOW + 1, first[item])), np.minimum(at, last)
    ok = low <= high
    sums = np.cumsum(np.bincount(low[ok], value[ok], n + 1) - np.bincount(high[ok] + 1, value[ok], n + 1))[:n]
    out = np.full(len(first) - 1, np.inf)
    starts = at <= last
    np.minimum.at(out, item[starts], sums[starts])
    return out


class Statistics:
    """Number, words and sorted distinct terms of all items, and how many items hold each term."""

    def __init__(self):
        self.items = self.words = 0
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        words = _words(pa.array(texts, pa.string()))
        pair = np.unique(np.stack([words.hashes(), words.document().astype(np.uint64)], axis=1), axis=0)
        self.terms, at = np.unique(np.concatenate([self.terms, pair[:, 0]]), return_inverse=True)
        self.df = np.bincount(at, np.concatenate([self.df, np.ones(len(pair), np.int64)]), len(self.terms)).astype(np.int64)
        self.items += len(texts)
        self.words += int(words.first[-1])


class Index:
    """Terms' sorted hashes, their postings, and the largest impacts by term and block."""

    def __init__(self, ids: list[int], texts: list[str], every: Statistics | None = None):
        self.ids = np.array(ids, np.int64)
        words = _words(pa.array(texts, pa.string()))
        h, item = words.hashes(), words.document()
        n = len(ids)
        pair, back, tf = np.unique(np.stack([h, item.astype(np.uint64)], axis=1), axis=0, return_inverse=True, return_counts=True)
        self.terms, term = np.unique(pair[:, 0], return_inverse=True)
        item = pair[:, 1].astype(np.int64)
        df = np.bincount(term, minlength=len(self.terms))
        if every is None:
            every = Statistics()
            every.add(texts)
        held = every.df[np.searchsorted(every.terms, self.terms)]
        idf = np.log(1 + (every.items - held + 0.5) / (held + 0.5))
        length = np.diff(words.first)
        mean = max(every.words / every.items, 1) if n else 1
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.first = np.concatenate(([0], np.cumsum(df)))
        self.own = np.bincount(item, impact, n)
        self.blocks = -(-n // BLOCK)
        # block maxima relative to the least threshold of the block's items, so that 1 is enough for any of them
        back = back.ravel()
        reach = np.minimum(self.own, _weakest(back, impact[back], np.asarray(words.first, np.int64)))
        self.least = np.where(self.own > 0, THRESHOLD * reach, np.inf)
        relative = impact / self.least[item]
        # one entry for each term and block that has it
        order = np.lexsort((item, term))
        key = term[order] * max(self.blocks, 1) + item[order] // BLOCK
        start = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_max = np.maximum.reduceat(relative[order], start).astype(np.float32) if len(start) else np.zeros(0, np.float32)
        of, self.block_no = key[start] // max(self.blocks, 1), key[start] % max(self.blocks, 1)
        self.block_first = np.searchsorted(of, np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.block_max, self.block_first[:-1]) if len(start) else np.zeros(len(self.terms))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.terms & np.uint64(0x3FFFF)] = True
        both = [split_item(t) for t in texts]
        self.question, self.answer = _grams([q for q, _ in both]), _grams([a for _, a in both])

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """The term's number, or -1."""
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(self.maybe[h & np.uint64(0x3FFFF)])
        if len(some) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, h[some]), len(self.terms) - 1)
            out[some] = np.where(self.terms[at] == h[some], at, -1)
        return out

    def retrieve(self, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and score (as a share of the item's own) of all pairs at or above the item's threshold."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # word positions in the index, and the passage windows over all words of each document
        n = np.diff(first)
        windows = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(n)), windows)
        begin = first[doc] + STRIDE * (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
        end = np.minimum(begin + WINDOW, first[doc + 1])
        # 1. sums of global maxima (a repeated word counts each time: still an upper bound)
        top = np.concatenate(([0.0], np.cumsum(np.where(term >= 0, self.term_max[term] if len(self.terms) else 0, 0))))
        live = np.flatnonzero(top[end] - top[begin] >= 1 - 1e-6)
        if not len(live):
            return none
        out = []
        for b in range(0, len(live), 2048):
            rows = live[b : b + 2048]
            size = (end - begin)[rows]
            row = np.repeat(np.arange(len(rows)), size)
            t = term[np.repeat(begin[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            row, t = row[t >= 0], t[t >= 0]
            code = np.unique(row.astype(np.int64) * len(self.terms) + t)  # a passage's distinct terms
            row, t = code // len(self.terms), code % len(self.terms)
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            # 2. sums of block maxima, for each passage and block
            of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(row))))
            m = self.block_first[t + 1] - self.block_first[t]
            at = np.repeat(self.block_first[t] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            whose, where, how = np.repeat(of, m), self.block_no[at], self.block_max[at]
            for c in range(0, self.blocks, 512):
                width = min(512, self.blocks - c)
                some = (where >= c) & (where < c + width) if self.blocks > 512 else slice(None)
                bound = np.bincount(whose[some] * width + where[some] - c, how[some], len(heads) * width).reshape(-1, width)
                wanted = bound >= 1 - 1e-4
                if not wanted.any():
                    continue
                # 3. full scores of those blocks' items
                has = wanted.any(axis=1)[of]
                tt, oo = t[has], of[has]
                m = self.first[tt + 1] - self.first[tt]
                at = np.repeat(self.first[tt] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                o, item = np.repeat(oo, m), self.item[at]
                block = item // BLOCK - c
                inside = (block >= 0) & (block < wanted.shape[1])
                inside[inside] = wanted[o[inside], block[inside]]
                o, item, value = o[inside], item[inside], self.impact[at][inside]
                pair, back = np.unique(o * len(self.ids) + item, return_inverse=True)
                score = np.bincount(back, value)
                item = pair % len(self.ids)
                ok = score >= self.least[item] - 1e-9
                out.append((rows[row[heads]][pair[ok] // len(self.ids)], item[ok], score[ok] / self.own[item[ok]]))
        if not out:
            return none
        p, item, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return doc[p], item, score


def matches(index: Index, texts: pa.Array, question: float = QUESTION, answer: float = ANSWER) -> list[tuple[int, int, float, float, float]]:
    """Row, item id, best score, and shares of question and answer of all verified pairs."""
    out = []
    for b, e in slices(texts):
        words = _words(texts.slice(b, e - b))
        h = words.hashes()
        doc, item, score = index.retrieve(index.term_of(h), words.first)
        if not len(doc):
            continue
        pair, back = np.unique(doc * len(index.ids) + item, return_inverse=True)
        best = np.zeros(len(pair))
        np.maximum.at(best, back, score)
        grams: dict[int, np.ndarray] = {}
        for code, top in zip(pair.tolist(), best.tolist(), strict=True):
            d, i = divmod(code, len(index.ids))
            if d not in grams:
                own = h[words.first[d] : words.first[d + 1]]
                found = [shingle_hashes(own, np.array([0, len(own)]), N)[0]]
                short = {len(index.question[i]), len(index.answer[i])}
                grams[d] = np.unique(np.concatenate([*found, *(shingle_hashes(own, np.array([0, len(own)]), k, False)[0] for k in range(1, N) if short)]))
            share = [float(np.isin(g, grams[d], assume_unique=True).mean()) if len(g) else 0.0 for g in (index.question[i], index.answer[i])]
            if share[0] >= question and share[1] >= answer:
                out.append((b + d, int(index.ids[i]), top, *share))
    return out


def _indexes(benchmark: DataFrame, chunk: int) -> list[Index]:
    """One index for each chunk of items, read chunk by chunk in item order, after a first pass for the statistics of all."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")

    def chunks() -> Iterator[tuple[list[int], list[str]]]:
        ids, texts = [], []
        for r in rows.toLocalIterator():
            ids.append(r["item_id"])
            texts.append(r["text"])
            if len(ids) == chunk:
                yield ids, texts
                ids, texts = [], []
        if ids:
            yield ids, texts

    every = Statistics()
    for _, texts in chunks():
        every.add(texts)
    return [Index(ids, texts, every) for ids, texts in chunks()]


def find(documents: DataFrame, benchmark: DataFrame, question: float = QUESTION, answer: float = ANSWER, chunk: int = CHUNK) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of all contaminated documents, one row a pair."""
    spark = documents.sparkSession
    shared = [spark.sparkContext.broadcast(pickle.dumps(x)) for x in _indexes(benchmark, chunk)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [pickle.loads(s.value) for s in shared]
        for batch in batches:
            for index in indexes:
                found = matches(index, batch["text"], question, answer)
                ids = batch["doc_id"]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                columns = list(zip(*((ids[r].as_py(), *x) for r, *x in found), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _HIT.split(", ")])

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _HIT)


def clean(documents: DataFrame, benchmark: DataFrame, question: float = QUESTION, answer: float = ANSWER, chunk: int = CHUNK) -> DataFrame:
    """The documents without those that ``find`` gives; all columns stay."""
    spark = documents.sparkSession
    shared = [spark.sparkContext.broadcast(pickle.dumps(x)) for x in _indexes(benchmark, chunk)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [pickle.loads(s.value) for s in shared]
        for batch in batches:
            bad = {r for index in indexes for r, *_ in matches(index, batch["text"], question, answer)}
            yield batch if not bad else batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

    return mapped(documents, run, documents.schema)
