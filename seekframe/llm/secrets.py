"""Secret scans: fixed formats, and formats that are inferred as probabilistic automata.

Base spans are the leftmost, non-overlapping matches of three fixed patterns.  Their values label the credentials
of a bounded sample; other tokens of the same documents are the ordinary ones.  For each kind, and for the ordinary
tokens, state merging (red and blue states, Hoeffding's bound) turns the prefix tree of character classes into a
probabilistic automaton.  Every long token outside base spans is then a candidate; it is added as ``format`` if one
kind's automaton gives it a log likelihood per character that beats the ordinary automaton by ``margin`` and is one
that the labelled credentials themselves reach.

Defined results: a null text is empty and has no spans; without labelled credentials nothing is added; repeated rows
are scanned alike; further columns are ignored; an empty table gives no rows.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, mapped, raw, sampled, slices

# Fixed patterns, with the least length of the value or match.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "format")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Documents of the sample, credentials of a kind and ordinary tokens that are learnt from at most; shortest candidate.
MOST_DOCUMENTS, MOST_STRINGS, SHORTEST = 20_000, 600, 16

# Character classes of candidates: digits, a-f, g-z, A-F, G-Z, and each sign by itself.
_SIGNS = "+/_.=-"
CLASS = np.full(256, -1, np.int16)
for _n, _set in enumerate(["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *_SIGNS]):
    CLASS[list(_set.encode())] = _n
_SIZES = np.array([10, 6, 20, 6, 20, *[1] * len(_SIGNS)])
N_CLASSES = len(_SIZES)
_NO_TOKEN = CLASS < 0
_NO_HEX = np.ones(256, bool)
_NO_HEX[list(b"0123456789abcdef")] = False


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of all base spans, by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Automaton:
    """A deterministic probabilistic automaton over character classes, by merging compatible states of a prefix tree."""

    def __init__(self, strings: list[bytes], alpha: float = 0.05):
        self.count: list[int] = [0]
        self.ends: list[int] = [0]
        self.step: list[dict[int, int]] = [{}]
        self.passed: list[dict[int, int]] = [{}]
        for s in strings:
            self._add(CLASS[np.frombuffer(s, np.uint8)].tolist())
        self.alpha = alpha
        self.red = [0]
        self._merge()
        self._freeze()

    def _add(self, symbols: list[int]) -> None:
        at = 0
        for c in symbols:
            self.count[at] += 1
            if c not in self.step[at]:
                self.step[at][c] = len(self.count)
                self.count.append(0)
                self.ends.append(0)
                self.step.append({})
                self.passed.append({})
            self.passed[at][c] = self.passed[at].get(c, 0) + 1
            at = self.step[at][c]
        self.count[at] += 1
        self.ends[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > (0.5 * np.log(2 / self.alpha)) ** 0.5 * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.passed[a].keys() | self.passed[b].keys():
                if self._differ(self.passed[a].get(c, 0), n, self.passed[b].get(c, 0), m):
                    return False
                if c in self.step[a] and c in self.step[b]:
                    todo.append((self.step[a][c], self.step[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            for c, n in self.passed[b].items():
                self.passed[a][c] = self.passed[a].get(c, 0) + n
                if c in self.step[a]:
                    todo.append((self.step[a][c], self.step[b][c]))
                else:
                    self.step[a][c] = self.step[b][c]

    def _merge(self) -> None:
        while True:
            red = set(self.red)
            blue = [(r, c, b) for r in self.red for c, b in sorted(self.step[r].items()) if b not in red]
            if not blue:
                return
            # the blue state with the most strings comes first: its figures are the surest
            r, c, b = max(blue, key=lambda x: (self.count[x[2]], -x[2]))
            for other in self.red:
                if self._compatible(other, b):
                    self.step[r][c] = other
                    self._fold(other, b)
                    break
            else:
                self.red.append(b)

    def _freeze(self) -> None:
        number = {s: i for i, s in enumerate(self.red)}
        n = len(self.red)
        self.next = np.full((n + 1, N_CLASSES), n, np.int32)
        self.log = np.empty((n + 1, N_CLASSES))
        self.end = np.empty(n + 1)
        least = np.log(0.5 / (N_CLASSES + 1)) - np.log(_SIZES)
        self.log[n], self.end[n] = least, np.log(0.5 / (N_CLASSES + 1))
        for s, i in number.items():
            total = self.count[s] + 0.5 * (N_CLASSES + 1)
            for c in range(N_CLASSES):
                self.log[i, c] = np.log((self.passed[s].get(c, 0) + 0.5) / total) - np.log(_SIZES[c])
                if c in self.step[s]:
                    self.next[i, c] = number[self.step[s][c]]
            self.end[i] = np.log((self.ends[s] + 0.5) / total)
        del self.count, self.ends, self.step, self.passed

    def score(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log likelihood per character (the end counts as one) of the spans, all moved on together."""
        state, total = np.zeros(len(start), np.int32), np.zeros(len(start))
        order = np.argsort(start - end, kind="stable")  # longest first: those still going are a prefix
        length = (end - start)[order]
        begin = start[order]
        for i in range(int(length.max(initial=0))):
            going = int(np.searchsorted(-length, -i, "left"))
            rows = order[:going]
            c = classes[begin[:going] + i]
            total[rows] += self.log[state[rows], c]
            state[rows] = self.next[state[rows], c]
        return (total + self.end[state]) / (end - start + 1)


class Model:
    """Automata of the kinds and of ordinary tokens, and for each kind the least score of a credential."""

    def __init__(self, credentials: dict[str, list[bytes]], ordinary: list[bytes], margin: float = 0.35):
        self.kinds = {k: Automaton(v) for k, v in sorted(credentials.items()) if v}
        self.ordinary = Automaton(ordinary) if ordinary else None
        self.margin = margin
        self.least = {k: float(np.quantile(_scored(a, credentials[k]), 0.02)) for k, a in self.kinds.items()}

    def added(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the spans have a credential's format."""
        out = np.zeros(len(start), bool)
        if not self.kinds or not len(start):
            return out
        classes = CLASS[data]
        floor = self.ordinary.score(classes, start, end) if self.ordinary else np.full(len(start), -np.inf)
        for k, a in self.kinds.items():
            s = a.score(classes, start, end)
            out |= (s >= floor + self.margin) & (s >= self.least[k])
        return out


def _scored(a: Automaton, strings: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    return a.score(CLASS[data], end - [len(s) for s in strings], end)


def _candidates(data: np.ndarray, at: np.ndarray) -> Words:
    runs = Words(data, at, _NO_TOKEN)
    keep = runs.end - runs.start >= SHORTEST
    runs.start, runs.end = runs.start[keep], runs.end[keep]
    runs.first = np.searchsorted(runs.start, at)
    return runs


def _suspects(data: np.ndarray, at: np.ndarray) -> set[int]:
    """Documents of a block that may hold base spans."""
    lower = data.tobytes().lower()
    hits = []
    for name in (*_NAMES, b"akia"):
        i = lower.find(name)
        while i >= 0:
            hits.append(i)
            i = lower.find(name, i + 1)
    runs = Words(data, at, _NO_HEX)
    long = runs.start[runs.end - runs.start >= LEAST["hex"]]
    return set((np.searchsorted(at, np.concatenate([np.array(hits, np.int64), long]), "right") - 1).tolist())


class _Taken:
    """Whether a span meets one of a text's base spans: the furthest end of those that start before its own end tells."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        both = np.array(sorted((s, e) for _, s, e in spans), np.int64).reshape(-1, 2)
        self.start, self.end = both[:, 0], np.maximum.accumulate(both[:, 1])

    def meets(self, start: int, end: int) -> bool:
        k = int(np.searchsorted(self.start, end))
        return k > 0 and self.end[k - 1] > start


def scan(texts: pa.Array, model: Model | None) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by start, then kind."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for b, e in slices(texts):
        part = texts.slice(b, e - b)
        data, at = raw(part)
        for d in _suspects(data, at):
            out[b + d] = base_spans(part[d].as_py())
        if model is None:
            continue
        runs = _candidates(data, at)
        good = np.flatnonzero(model.added(data, runs.start, runs.end))
        doc = runs.document()
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(good) else None
        taken: dict[int, _Taken] = {}
        for i in good:
            d = int(doc[i])
            if d not in taken:
                taken[d] = _Taken(out[b + d])
            s, t = (int(points[x] - points[at[d]]) for x in (runs.start[i], runs.end[i]))
            if not taken[d].meets(s, t):
                out[b + d].append(("format", s, t))
        for d in set(doc[good].tolist()):
            out[b + d].sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of base spans by kind, and candidates outside them as ``ordinary``."""
    for batch in batches:
        kinds, values = [], []
        for b, e in slices(batch["text"]):
            part = batch["text"].slice(b, e - b)
            data, at = raw(part)
            suspects, runs = _suspects(data, at), _candidates(data, at)
            whole = data.tobytes()
            for d in suspects:
                text = part[d].as_py()
                for kind, s, t in base_spans(text):
                    kinds.append(kind)
                    values.append((ASSIGN.match(text, s)[2] if kind == "assign" else text[s:t]).encode())
            for d, s, t in zip(runs.document().tolist(), runs.start.tolist(), runs.end.tolist(), strict=True):
                if d not in suspects:
                    kinds.append("ordinary")
                    values.append(whole[s:t])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.binary())], ["kind", "value"])


def fit(documents: DataFrame, most_documents: int = MOST_DOCUMENTS, most_strings: int = MOST_STRINGS) -> Model:
    """Learns from at most ``most_documents`` documents, and at most ``most_strings`` distinct values of a kind."""
    from pyspark.sql import Window

    ids = sampled(documents.select("doc_id"), "doc_id", most_documents).distinct()
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    values = mapped(rows, _labelled, "kind string, value binary").distinct().withColumn("h", F.xxhash64("value"))
    first = values.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))).where(F.col("n") <= most_strings)
    found: dict[str, list[bytes]] = {}
    for r in first.orderBy("kind", "n").collect():
        found.setdefault(r["kind"], []).append(bytes(r["value"]))
    ordinary = found.pop("ordinary", [])
    return Model(found, ordinary)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of base spans, a digest of them, and all spans."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # automata of bounded samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            found = scan(batch["text"], own)
            base = [[x for x in spans if x[0] != "format"] for spans in found]
            counts = [pa.array([sum(x[0] == k for x in spans) for spans in base], pa.int64()) for k in KINDS[:3]]
            digest = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, digest, pa.array(map(joined, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return mapped(documents.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span, or run of overlapping spans, replaced by ``mark``, and n_chars to match; all columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for _, s, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            found = scan(batch["text"], own)
            if any(found):
                texts = batch["text"].to_pylist()
                texts = [clean(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns = {n: batch[n] for n in batch.schema.names} | {"text": pa.array(texts, batch.schema.field("text").type)}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(texts, found, batch["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield batch

    return mapped(documents, run, documents.schema)
