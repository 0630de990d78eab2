"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads letter runs (pieces of at most ``WINDOW`` bytes, A-Z folded), labels every position from the
states of both directions there, and a document's probabilities are the mean over all its positions.  A run
gives the same labels wherever it stands, so each slice of ``SLICE_BYTES`` runs its distinct runs once, equal lengths together.
Training is plain numpy: backpropagation through time with Adam, on a bounded sample of labelled documents.

Defined results: no letter in the text (or a null text) gives ``und`` with score 0; so does an empty training set;
rows with a null id, repeated rows and ties are rows like others (ties go to the first language in order); further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .blocks import LETTER_BREAK, letter_runs, mapped, raw, sampled, slices

WINDOW = 16
UNKNOWN = "und"
#: Documents and distinct letter runs that training reads at most.
MOST_DOCUMENTS, MOST_RUNS = 4_000, 200_000
#: Text bytes whose runs are kept together (or the longest single text).
SLICE_BYTES = 8 << 20
#: A language is clear from this share of the way from chance to the median score of held-out documents.
CLEAR_SHARE = 0.2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Two gated recurrent layers, one each way, and a softmax over languages at every position."""

    def __init__(self, languages: list[str], hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        h, k = hidden, len(languages)
        self.p = {}
        for way in "fb":
            self.p[f"{way}x"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"{way}h"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            self.p[f"{way}bias"] = np.zeros(3 * h, np.float32)
        self.p["out"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        self.p["bias"] = np.zeros(k, np.float32)

    def _run(self, way: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States at all positions (time, row, hidden); x is (row, time)."""
        h, p = self.hidden, self.p
        n, t = x.shape
        states, kept, s = np.empty((t, n, h), np.float32), [], np.zeros((n, h), np.float32)
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            u = p[f"{way}x"][x[:, i]] + p[f"{way}bias"]
            v = s @ p[f"{way}h"]
            gate = _sigmoid(u[:, : 2 * h] + v[:, : 2 * h])
            z, r = gate[:, :h], gate[:, h:]
            c = np.tanh(u[:, 2 * h :] + r * v[:, 2 * h :])
            if keep:
                kept.append((i, s, z, r, c, v[:, 2 * h :]))
            s = c + z * (s - c)
            states[i] = s
        return states, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (time, row, language)."""
        both = np.concatenate([self._run("f", x, False)[0], self._run("b", x, False)[0]], axis=2)
        y = both @ self.p["out"] + self.p["bias"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradients; target is (row, language)."""
        h, p = self.hidden, self.p
        n, t = x.shape
        runs = {way: self._run(way, x, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        y = both @ p["out"] + p["bias"]
        y -= y.max(axis=2, keepdims=True)
        e = np.exp(y)
        q = e / e.sum(axis=2, keepdims=True)
        loss = -float((target * np.log(q + 1e-9)).sum() / (n * t))
        dy = (q * target.sum(axis=1)[None, :, None] - target) / np.float32(n * t)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = both.reshape(-1, 2 * h).T @ dy.reshape(-1, dy.shape[2])
        g["bias"] = dy.sum(axis=(0, 1))
        dboth = dy @ p["out"].T
        for way, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            ds = np.zeros((n, h), np.float32)
            for i, s, z, r, c, v in reversed(runs[way][1]):
                ds = ds + part[i]
                dc = ds * (1 - z) * (1 - c * c)
                dz = ds * (s - c) * z * (1 - z)
                dr = dc * v * r * (1 - r)
                du = np.concatenate([dz, dr, dc], axis=1)
                dv = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(g[f"{way}x"], x[:, i], du)
                g[f"{way}bias"] += du.sum(axis=0)
                g[f"{way}h"] += s.T @ dv
                ds = ds * z + dv @ p[f"{way}h"].T
        return loss, g

    def train(self, runs: dict[int, tuple[np.ndarray, np.ndarray]], steps: int = 1500, batch: int = 256, rate: float = 0.01, seed: int = 3) -> float:
        """Adam over batches of equal-length runs. runs: by length, bytes (row, time) and weights (row, language)."""
        rng = np.random.default_rng(seed)
        lengths = sorted(runs)
        mass = {n: np.sqrt(runs[n][1].sum(axis=1)) for n in lengths}
        share = np.array([mass[n].sum() * n for n in lengths])
        chance = {n: mass[n] / mass[n].sum() for n in lengths}
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            n = lengths[rng.choice(len(lengths), p=share / share.sum())]
            x, weight = runs[n]
            at = rng.choice(len(x), min(batch, len(x)), p=chance[n])
            target = weight[at] / weight[at].sum(axis=1, keepdims=True)
            now, g = self.gradients(x[at], target.astype(np.float32))
            loss = now if step == 1 else 0.98 * loss + 0.02 * now
            lr = rate * min(1, 3 * (1 - step / (steps + 1)))
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss


def run_scores(net: BiGRU, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums over positions of the language probabilities of each run."""
    out = np.zeros((len(start), len(net.languages)), np.float32)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        for b in range(0, len(rows), 4096):
            some = rows[b : b + 4096]
            out[some] = net.probabilities(data[start[some][:, None] + np.arange(n)]).sum(axis=0)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _fold(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def score_texts(net: BiGRU, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the language's number (-1: no letter) and its probability."""
    hashes, sums, starts, lengths, docs, pieces, shift = [], None, [], [], [], [], 0
    lettered = np.zeros(len(texts), bool)
    for b, e in slices(texts):
        data, at = raw(texts.slice(b, e - b))
        data = _fold(data)
        runs = letter_runs(data, at, WINDOW)
        h = runs.hashes(fold=False)
        _, first = np.unique(h, return_index=True)
        # the bytes of the runs seen first in this block are kept, the rest is only counted
        n = (runs.end - runs.start)[first]
        to = np.cumsum(n) - n
        part = data[np.repeat(runs.start[first] - to, n) + np.arange(n.sum())]
        pieces.append(part)
        hashes.append((h, h[first], shift + to, n))
        shift += len(part)
        docs.append(runs.document() + b)
        plain = np.concatenate(([0], np.cumsum((data < 128) & ~LETTER_BREAK[data])))
        lettered[b:e] = np.diff(plain[at]) > 0
        wide = np.concatenate(([0], np.cumsum(data >= 128)))
        for i in np.flatnonzero(~lettered[b:e] & (np.diff(wide[at]) > 0)):
            lettered[b + i] = has_letter(texts[b + int(i)].as_py())
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    if not hashes or not net.languages:
        return best, score
    keys, first = np.unique(np.concatenate([x[1] for x in hashes]), return_index=True)
    starts, lengths = (np.concatenate([x[k] for x in hashes])[first] for k in (2, 3))
    sums = run_scores(net, np.concatenate(pieces), starts, lengths)
    total = np.zeros((len(texts), len(net.languages)))
    for (h, _, _, _), doc in zip(hashes, docs, strict=True):
        row = np.searchsorted(keys, h)
        for k in range(len(net.languages)):
            total[:, k] += np.bincount(doc, sums[row, k], len(texts))
    positions = total.sum(axis=1)
    ok = lettered & (positions > 0)
    best[ok] = total[ok].argmax(axis=1)
    score[ok] = np.clip(total[ok].max(axis=1) / positions[ok], 0, 1)
    return best, score


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, bytes], int] = defaultdict(int)
        langs = batch["lang"].to_pylist()
        for b, e in slices(batch["text"]):
            data, at = raw(batch["text"].slice(b, e - b))
            data = _fold(data)
            runs = letter_runs(data, at, WINDOW)
            whole = data.tobytes()
            for d, s, t in zip(runs.document().tolist(), runs.start.tolist(), runs.end.tolist(), strict=True):
                found[langs[b + d], whole[s:t]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "run", "n"])


def fit(labelled: DataFrame, most_documents: int = MOST_DOCUMENTS, most_runs: int = MOST_RUNS, steps: int = 1500) -> BiGRU:
    """Trains on a sample of at most ``most_documents`` rows of (doc_id, text, lang), and at most ``most_runs`` distinct letter runs of them."""
    usable = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    ids = sampled(usable.select("doc_id"), "doc_id", most_documents).distinct()  # at most most_documents ids
    rows = usable.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "lang")
    counts = mapped(rows.select("lang", "text"), _counted, "lang string, run binary, n long").groupBy("run").agg(F.collect_list(F.struct("lang", "n")).alias("seen"))
    # as Arrow columns, not rows: a few megabytes on the driver
    table = sampled(counts, "run", most_runs).select("run", F.explode("seen").alias("s")).select("run", "s.lang", "s.n").toArrow()
    languages = sorted(table["lang"].unique().to_pylist())
    net = BiGRU(languages)
    if not languages:
        return net
    coded = table["run"].combine_chunks().dictionary_encode()
    words = coded.dictionary.to_pylist()
    weights = np.zeros((len(words), len(languages)))
    number = np.searchsorted(languages, table["lang"].to_numpy(zero_copy_only=False).astype(str))
    np.add.at(weights, (coded.indices.to_numpy(), number), table["n"].to_numpy())
    weights /= np.maximum(weights.sum(axis=0), 1)
    weights *= 1e6
    grouped: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(words)), key=words.__getitem__):
        grouped[len(words[i])].append(i)
    runs = {n: (np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n), weights[at]) for n, at in sorted(grouped.items())}
    net.train(runs, steps)
    return net


def predict(documents: DataFrame, net: BiGRU, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score; all columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # a few tens of kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        names = np.array([*own.languages, UNKNOWN], object)
        for whole in batches:
            for b, e in slices(whole[text], SLICE_BYTES):
                batch = whole.slice(b, e - b)
                best, score = score_texts(own, batch[text])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    kept = documents.drop("lang_pred", "score")
    return mapped(kept, run, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def least_score(scored: DataFrame, languages: int, share: float = CLEAR_SHARE) -> float:
    """The score from which on a language is clear: ``share`` of the way from chance to the median score of ``scored``.

    ``scored`` are held-out documents in learned languages; scores are counted in thousandths, so the median covers all of
    them.  Without any the way leads to 1; with fewer than two languages nothing is unclear.
    """
    if languages < 2:
        return 0.0
    counts = sorted(map(tuple, scored.where(F.col("lang_pred") != UNKNOWN).groupBy(F.floor(F.col("score") * 1000).alias("part")).count().collect()))
    n = np.cumsum([c for _, c in counts])
    middle = counts[int(np.searchsorted(n, n[-1] / 2))][0] / 1000 if counts else 1.0
    chance = 1 / languages
    return chance + share * max(0.0, middle - chance)


def fold(key: str, folds: int) -> Column:
    """CRC-32 of the id as text, by the number of folds."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % folds
