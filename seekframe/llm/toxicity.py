"""Toxicity by a classifier chain of linear models over words and word beginnings.

The categories are predicted in order.  Each model is a logistic regression on the words it selects (by document
frequency in its own training rows) and on the probabilities of all earlier categories; in training those come from
out-of-fold predictions, so a later model sees them as they will be, not as an overfitted earlier model gives them.

Defined results: a null or empty text has no features and gets the models' base rates; labels may be null (such rows
don't train that category); without training rows of both kinds a category has its base rate; repeated rows are
scored alike; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .blocks import Words, crc32, letter_runs, raw, sampled, slices, span_hashes

#: Labelled rows that training reads at most, word features a model has at most, and bytes of a word's beginning.
MOST_LABELS, MOST_FEATURES, BEGINNING = 8_000, 600, 6

_SIGN_BREAK = np.ones(256, bool)
_SIGN_BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By blocks: the first row, and the row and hash of each word, each longer word's beginning, and each run of symbols."""
    for b, e in slices(texts):
        data, at = raw(texts.slice(b, e - b))
        runs = letter_runs(data, at)
        doc = runs.document() + b
        words = runs.hashes()
        long = runs.end - runs.start > BEGINNING
        heads = span_hashes(data, runs.start[long], runs.start[long] + BEGINNING) ^ np.uint64(0x5BD1E995)
        signs = Words(data, at, _SIGN_BREAK)
        yield b, np.concatenate([doc, doc[long], signs.document() + b]), np.concatenate([words, heads, signs.hashes()])


class Chain:
    """Per category: sorted feature hashes, their weights, the weights of earlier categories' log odds, and a bias."""

    def __init__(self, categories: list[str]):
        self.categories = categories
        self.models: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = []

    def keys(self) -> np.ndarray:
        return np.unique(np.concatenate([m[0] for m in self.models] or [np.zeros(0, np.uint64)]))

    def probabilities(self, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """(row, category) from distinct (row, feature) pairs."""
        odds = np.zeros((n, len(self.models)))
        for k, (keys, weights, earlier, bias) in enumerate(self.models):
            odds[:, k] = bias + odds[:, :k] @ earlier
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                odds[:, k] += np.bincount(rows[hit], weights[at[hit]], n)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps; the bias isn't penalised."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _fit_one(sets: list[np.ndarray], y: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A model of one category; sets are the distinct feature hashes of each row."""
    if not len(y) or not 0 < y.sum() < len(y):
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    everything = np.concatenate(sets)
    keys, code = np.unique(everything, return_inverse=True)
    total = np.bincount(code)
    positive = np.bincount(code, y[rows])
    # signed root of the likelihood ratio of having the feature, for those of three rows or more
    rate = y.mean()
    expected = total * rate
    gain = np.where(total >= 3, 2 * (positive * np.log(np.maximum(positive, 1e-9) / expected) + (total - positive) * np.log(np.maximum(total - positive, 1e-9) / (total - expected))), -1)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:MOST_FEATURES])
    chosen = chosen[gain[chosen] > 3]
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sets), len(chosen) + earlier.shape[1]))
    hit = place[code] >= 0
    x[rows[hit], place[code[hit]]] = 1
    x[:, len(chosen) :] = earlier
    w, bias = _logistic(x, y)
    return keys[chosen], w[: len(chosen)], w[len(chosen) :], bias


def fit_chain(categories: list[str], sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, n_folds: int = 5) -> Chain:
    """labels: (row, category), NaN where unknown; folds: a number below ``n_folds`` for each row."""
    chain = Chain(categories)
    odds = np.zeros((len(sets), 0))  # out-of-fold log odds of the categories so far
    for k in range(len(categories)):
        known = ~np.isnan(labels[:, k])
        part = lambda at: _fit_one([sets[i] for i in np.flatnonzero(at)], labels[at, k], odds[at])  # noqa: B023, E731
        chain.models.append(part(known))
        column = np.zeros(len(sets))
        for f in range(n_folds):
            keys, w, earlier, bias = part(known & (folds != f))
            for i in np.flatnonzero(folds == f):
                at = np.searchsorted(keys, sets[i])
                at[at == len(keys)] = 0
                column[i] = bias + odds[i] @ earlier + (w[at[keys[at] == sets[i]]].sum() if len(keys) else 0)
        odds = np.concatenate([odds, np.clip(column, -30, 30)[:, None]], axis=1)
    return chain


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = [b""] * batch.num_rows
        for _, doc, h in features(batch["text"]):
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            doc, h = doc[new], h[new]
            for i, a, b in zip(*np.unique(doc, return_index=True), [*np.unique(doc, return_index=True)[1][1:], len(doc)], strict=True):
                out[i] = h[a:b].tobytes()
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["labels"], pa.array(out, pa.binary())], ["doc_id", "labels", "features"])


def fit(documents: DataFrame, labels: DataFrame, categories: dict[str, str], most_labels: int = MOST_LABELS) -> Chain:
    """Trains on at most ``most_labels`` labelled documents. categories: name to SQL condition over the label columns, in order.

    Of labels, and of texts, that repeat an id the smallest counts, wherever the rows lie.
    """
    names = list(categories)
    some = sampled(labels.where("doc_id is not null").select("doc_id", F.array(*[F.expr(f"cast(({c}) as double)") for c in categories.values()]).alias("labels")).groupBy("doc_id").agg(F.min("labels").alias("labels")), "doc_id", most_labels)
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("labels").alias("labels"), F.min("text").alias("text"))
    found = sorted(rows.mapInArrow(_sets, "doc_id long, labels array<double>, features binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([[np.nan if v is None else v for v in r["labels"]] for r in found], float).reshape(len(found), len(names))
    return fit_chain(names, [np.frombuffer(r["features"], np.uint64) for r in found], y, crc32([r["doc_id"] for r in found]) % 5 if found else np.zeros(0, int))


def predict(documents: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The documents with a probability ``p_<category>`` for each category; all columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(chain))  # at most MOST_FEATURES pairs a category
    new = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        keys = own.keys()
        maybe = np.zeros(1 << 16, bool)
        maybe[keys & np.uint64(0xFFFF)] = True
        for batch in batches:
            docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, doc, h in features(batch[text]):
                hit = maybe[h & np.uint64(0xFFFF)]
                doc, h = doc[hit], h[hit]
                if len(h):
                    hit = np.isin(h, keys)
                    pair = np.unique(np.stack([doc[hit].astype(np.uint64), h[hit]], axis=1), axis=0)
                    docs.append(pair[:, 0].astype(np.int64))
                    hashes.append(pair[:, 1])
            p = own.probabilities(np.concatenate(docs), np.concatenate(hashes), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k], pa.float64()) for k in range(len(new)))], [*batch.schema.names, *new])

    kept = documents.drop(*new)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *(StructField(c, DoubleType()) for c in new)]))
