"""Each operator against brute force or an exact round trip, and its defined results for odd rows."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekframe.llm import blocks, chat, decontam, langid, lm, ngram_join, quality, secrets, sentencepiece, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
MODEL = sentencepiece.MODEL
ODD = [None, "", " \t\n", "x", "é", "a" * 5000, "Wörter und\x0bWörter 😀", "\x00 ok", "▁ mark", "same", "same"]
EXTRA = "doc_id long, text string, n long, score double, words string, uid long, h string, a long, component string"


def docs(spark, texts, ids=None):
    """Documents with further columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 0.5, "w", 7, "h", 3, "c") for i, t in zip(ids, texts, strict=True)], EXTRA)


def prose(rng, n, words=("alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "of", "the")):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "s", "x", "yz"]) for _ in range(n))


# ---- blocks


def test_words_and_shingles():
    texts = [t or "" for t in ODD] + ["the quick  brown\tfox jumps", "THE QUICK brown fox jumps over"]
    w = blocks.Words(*blocks.raw(pa.array(texts)))
    h = w.hashes()
    flat = [x for t in texts for x in WORD.findall(t)]
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)] == flat
    assert len({int(x) for x in h}) == len({x.translate(LOWER) for x in flat})
    assert all(int(x) == blocks.hash_of(t.encode()) for x, t in zip(h, flat, strict=True))
    for width in (1, 3, 5):
        g, at = blocks.shingle_hashes(h, w.first, width)
        seen = {}
        for d, t in enumerate(texts):
            own = WORD.findall(t.translate(LOWER))
            expected = [tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))] if own else []
            assert at[d + 1] - at[d] == len(expected)
            for x, y in zip(g[at[d] : at[d + 1]].tolist(), expected, strict=True):
                assert seen.setdefault(y, x) == x
        assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows():
    column = pa.array(["x" * n for n in (0, 5, 100, 3, 0, 50)])
    assert [list(range(*r)) for r in blocks.slices(column, 10)] and [i for r in blocks.slices(column, 10) for i in range(*r)] == list(range(6))
    assert list(blocks.slices(column.slice(2, 3), 1 << 20)) == [(0, 3)]


# ---- 1


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_pieces_equal_the_library():
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + [prose(rng, 80) for _ in range(20)] + ["".join(rng.choice("ab -_=.é中😀\n1") for _ in range(200)) for _ in range(60)]
    texts += ["aaaa" * 40, "  lead", "trail  ", "<s> </s> <unk> <0x41>", "日本語テキスト", "========----////"]
    pieces = sentencepiece.load()
    ids, at = pieces.encode(pa.array(texts))
    assert [t for i, t in enumerate(texts) if lib.encode(t) != ids[at[i] : at[i + 1]].tolist()] == []
    data, to = pieces.decode(ids, at)
    assert [data[s:e].tobytes().decode() for s, e in zip(to, to[1:], strict=False)] == [t.replace("▁", " ") for t in texts]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_unigram_scores_are_the_best_sums():
    pieces = sentencepiece.load(merges=False)
    number = {s: i for i, s in enumerate(pieces.strings)}
    ids, at = pieces.encode(pa.array(["hello worlds", "unbelievable"]))
    for k, t in enumerate(["hello worlds", "unbelievable"]):
        total = 0.0
        for unit in (b"\xff" + w.encode() for w in t.split(" ")):
            best = [0.0] + [-math.inf] * len(unit)
            for j in range(1, len(unit) + 1):
                for i in range(j):
                    if unit[i:j] in number:
                        best[j] = max(best[j], best[i] + pieces.scores[number[unit[i:j]]])
            total += best[-1]
        assert math.isclose(sum(pieces.scores[i] for i in ids[at[k] : at[k + 1]]), total, rel_tol=1e-9)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_long_units_equal_the_library():
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/="
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (sentencepiece.LONG - 1, sentencepiece.LONG, 1500, 200_000)]
    texts += ["a" * 5000, "=" * 7001, "aaa" * 3333 + "b", "ab" * 4000, "日本語テキスト" * 700, "".join(rng.choice("é中😀xqthe") for _ in range(6000))]
    pieces = sentencepiece.load()
    ids, at = pieces.encode(pa.array(texts))
    assert [i for i, t in enumerate(texts) if lib.encode(t) != ids[at[i] : at[i + 1]].tolist()] == []
    # the scalar programme gives the same path as windows, and the best sum where scores add up
    unit = pieces._marked(*blocks.raw(pa.array([texts[2]])))[0]
    (p, q), (r, t) = pieces._joined(unit), pieces._scalar_path(unit)
    assert p.tolist() == r.tolist() and q.tolist() == t.tolist()
    sums = sentencepiece.load(merges=False)
    begins, chosen = sums.best_paths(unit[None, :300])
    r, t = sums._scalar_path(unit[:300])
    value = lambda x: sum(float(sums.scores[k]) if k >= 0 else sums.floor for k in x)
    assert math.isclose(value(t.tolist()), value(chosen[begins].tolist()))


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_pieces_in_one_pass(spark):
    texts = [*ODD, "word " * 60_000, None]
    frame = docs(spark, texts).withColumn("pieces", F.lit(3)).withColumn("decoded", F.lit(4))
    once = sorted((r.doc_id, r.pieces, r.decoded) for r in sentencepiece.round_trip(frame).collect())
    twice = sorted((r.doc_id, r.pieces, r.decoded) for r in sentencepiece.decode(sentencepiece.encode(frame)).collect())
    assert once == twice and [x[2] for x in once] == [(t or "").replace("▁", " ") for t in texts]
    assert sentencepiece.round_trip(frame.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_pieces_of_odd_rows(spark):
    rows = sentencepiece.decode(sentencepiece.encode(docs(spark, ODD).withColumn("pieces", F.lit("clash")))).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == [(t or "").replace("▁", " ") for t in ODD]
    assert rows[0]["pieces"] == [] and rows[0]["component"] == "c"
    assert sentencepiece.encode(docs(spark, ODD).where("false")).count() == 0


# ---- 2


def test_chat(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we:ird#", None]), rng.choice([None, "", "\\### Assistant: </turn> ok", "a\\", "x\n### user: y</turn>\n", "é😀#<"])) for c in (1, 2, 3, None) for t in range(12)]
    rows += [(5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (5, 0, "user", "tie")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for size in (1 << 20, 40):
        got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns, part_bytes=size)).collect()}
        assert set(got) == set(by)
        for c, own in by.items():
            own = sorted(own)
            loss = "".join(x for _, r, x in own if r == "assistant")
            assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(own), len(loss))
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    formatted = chat.format_chats(turns).where("conv_id = 1").orderBy("part").collect()
    assert chat.parse("".join(r["formatted"] for r in formatted)) == [(r, x) for _, r, x in sorted(by[1])]
    assert chat.read_chats(chat.format_chats(turns.where("false"))).count() == 0


# ---- 3


def test_automaton_scores_its_own_format():
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)).encode() for _ in range(200)]
    keys = [("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))).encode() for _ in range(200)]
    plain = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(16, 30))).encode() for _ in range(300)]
    model = secrets.Model({"hex": hexes[:150], "access": keys[:150]}, plain[:200])

    def added(strings):
        data = np.frombuffer(b"".join(strings), np.uint8)
        end = np.cumsum([len(s) for s in strings])
        return model.added(data, end - [len(s) for s in strings], end)

    assert added(hexes[150:]).mean() > 0.8 and added(keys[150:]).mean() > 0.8 and added(plain[200:]).mean() < 0.05
    a = model.kinds["hex"]
    naive = 0.0
    state = 0
    for c in secrets.CLASS[np.frombuffer(hexes[150], np.uint8)]:
        naive += a.log[state, c]
        state = a.next[state, c]
    assert math.isclose(float(secrets._scored(a, [hexes[150]])[0]), (naive + a.end[state]) / 41)


def test_secrets(spark):
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [*ODD, f'é token = "{h}" x', "PASSWORD: 'abc12'", "Api_Key=abcdef", "AKIA" + "Z" * 16, "AKIA" + "Z" * 15, h[:23], h[:24], "tokens secret=ab.cd-ef token:passwd=123456", "ſecret=abcdefg", "Key apiKey=abcdefg"]
    frame = docs(spark, texts)
    model = secrets.fit(frame)
    got = {r["doc_id"]: r for r in secrets.find(frame, model).collect()}
    for i, t in enumerate(texts):
        base = []
        for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t or "", re.I | re.A):
            if len(m[2]) >= 6:
                base.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 24]
        expected = ",".join(x[2] for x in sorted(base))
        assert got[i]["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest(), t
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("format")] == [x for x in expected.split(",") if x]
    clean = {r["doc_id"]: r for r in secrets.redact(frame, model).collect()}
    assert clean[11]["text"] == "é [SECRET]\" x" and clean[9]["text"] == "same" and clean[0]["text"] is None and clean[11]["component"] == "c"
    assert secrets.find(frame.where("false"), secrets.fit(frame.where("false"))).count() == 0


# ---- 4


def test_quality(spark):
    rng = random.Random(4)
    good = [prose(rng, 60 + i) for i in range(40)]
    junk = [re.sub(r"(\S) ", r"\1*** ", prose(rng, 70)) for _ in range(40)]
    texts = [*ODD, *good, *junk, "a b c\n" * 30, "p q r s\np q r s\n \n \nx", " ".join(f"w{i % 45}" for i in range(400)), "one two"]
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, "x") for i in range(len(ODD), len(ODD) + 40)] + [(i, 0, "x") for i in range(len(ODD) + 40, len(ODD) + 80)] + [(None, 1, "x")], "doc_id long, quality int, text string")
    ratio = quality.ratios(quality.counts(frame, labels))
    got = {r["doc_id"]: r for r in quality.assess(frame, ratio).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), failed), t[:60]
    assert all(got[len(ODD) + i]["kept"] for i in range(40)) and not any(got[len(ODD) + 40 + i]["kept"] for i in range(40))
    assert quality.assess(frame.where("false"), quality.ratios(quality.counts(frame.where("false"), labels))).count() == 0
    plan = quality.assess(frame, ratio)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 5


def test_warc(spark):
    html = ["<p>é</p>", "<p>é</p>", None, "", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "z" * 100_000, "<p>é</p>", "x\n"]
    urls = ["http://b.example/1", "https://www.a.example:80/x?y#z", None, "", "http://a.example/\r\nx", "http://c.example", "http://b.example/1", "http://a.example/x"]
    rows = [(i + 10, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html, strict=True))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i + 10)
    for i, h in enumerate(html):
        p = (h or "").encode()
        r = got[i + 10]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        own = first[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == i + 10 else ("revisit", own))
        assert r["payload"] == ((h or "") if own == i + 10 else "")
    records = warc.read_archives(spark, warc.write_archives(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 100)), file_records=3))
    history = warc.capture_history(records).orderBy("position").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in history]
    assert keys == sorted(keys) and [r["position"] for r in history] == list(range(16))
    assert warc.capture_history(warc.read_archives(spark, warc.write_archives(pages.where("page_id = 10")))).count() == 1
    repeated = warc.read_archives(spark, warc.write_archives(spark.createDataFrame([(1, "u", "p")] * 2 + [(None, "u", "p")], "page_id long, url string, html string"))).collect()
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in repeated) == [("response", 0), ("response", 0), ("revisit", 1)]


def test_archives_by_bytes(spark):
    """Archives end by bytes, a longer record has its own; copies before and after in any order of ids refer to the smallest."""
    rng = random.Random(16)
    rows = [(i, "u", "x" * rng.randrange(3000) if i % 3 else "same") for i in rng.sample(range(300), 300)] + [(900, "u", "y" * 50_000), (901, "u", "y" * 50_000), (None, "u", "same")]
    folder = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), archive_bytes=20_000)
    got = warc.read_archives(spark, folder).collect()
    held = collections.Counter()
    for r in got:
        held[r["file"]] += len(r["payload"].encode())
    assert len(got) == len(rows) and len(held) > 10
    assert all(n <= 20_000 or n == 50_000 for n in held.values())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    expected = sorted((i or -1, h if first[h] == i else "", "response" if first[h] == i else "revisit") for i, _, h in rows)
    assert sorted((r["page_id"] or -1, r["payload"], r["record_type"]) for r in got) == expected


def test_copies_dropped_early(monkeypatch):
    """Only pages that a smaller id with the same payload precedes lose their html, however few digests are remembered."""
    rows = [(5, "a"), (3, "a"), (4, "a"), (None, "a"), (3, "a"), (None, "b"), (7, "b"), (8, ""), (9, None)]
    page, html = (list(x) for x in zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(["u"] * 9), pa.array(html, pa.string())], ["page_id", "url", "html"])
    kept = lambda least: [x for b in warc._without_copies(iter([batch.slice(0, 4), batch.slice(4, 0), batch.slice(4)]), least) for x in b["html"].to_pylist()]
    assert kept(0) == ["a", "a", None, None, "a", "b", "b", "", None]
    assert kept(1) == ["a", "a", None, None, "a", "b", "b", "", ""]
    assert kept(2) == ["a", "a", "a", "a", "a", "b", "b", "", ""]
    monkeypatch.setattr(warc, "MOST_DIGESTS", 1)
    assert kept(0) == ["a", "a", None, None, "a", "b", "b", "", None]


def test_loser_tree():
    rng = random.Random(5)
    for k in range(1, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


# ---- 6


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [sentence(18) + " " + sentence(8) for _ in range(60)] + ["Short one here now?", None, ""]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(0, items[0], "x")], "item_id long, text string, score string")
    texts, truth = [], set()
    for d in range(120):
        body = [sentence(12) for _ in range(rng.randrange(1, 30))]
        if d % 4 == 0:
            i = rng.randrange(60)
            body.insert(rng.randrange(len(body) + 1), items[i].upper() if d % 8 else items[i].replace(".", "!!"))
            truth.add((d, i))
        texts.append(" ".join(body))
    texts += ODD
    for chunk in (20_000, 7):
        got = decontam.find(docs(spark, texts), benchmark, chunk=chunk).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    left = decontam.clean(docs(spark, texts), benchmark)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in truth}
    assert decontam.clean(docs(spark, texts), benchmark.where("false")).count() == len(texts)
    assert decontam.find(docs(spark, texts).where("false"), benchmark).count() == 0


def test_pruning_loses_nothing():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(50)]
    index = decontam.Index(list(range(50)), items)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 150))) for _ in range(40)]
    w = decontam._words(pa.array(texts))
    h = w.hashes()
    d, i, s = index.retrieve(index.term_of(h), w.first)
    best = collections.defaultdict(float)
    for x, y, z in zip(d.tolist(), i.tolist(), s.tolist(), strict=True):
        best[x, y] = max(best[x, y], z)
    brute = collections.defaultdict(float)
    impact = {(int(t), int(x)): v for k, t in enumerate(index.terms) for x, v in zip(index.item[index.first[k] : index.first[k + 1]], index.impact[index.first[k] : index.first[k + 1]], strict=True)}
    for doc in range(len(texts)):
        own = h[w.first[doc] : w.first[doc + 1]].tolist()
        for b in range(0, max(1, len(own)), decontam.STRIDE):
            part = set(own[b : b + decontam.WINDOW])
            for item in range(50):
                v = sum(impact.get((t, item), 0.0) for t in part)
                if v >= decontam.THRESHOLD * index.own[item] - 1e-9 and v > 0:
                    brute[doc, item] = max(brute[doc, item], v / index.own[item])
    # the last window may end past the text: only windows that add words count
    assert set(best) == set(brute) and all(abs(best[k] - brute[k]) < 1e-6 for k in best)


def test_scores_are_free_of_chunks(spark):
    rng = random.Random(12)
    items = [" ".join(f"w{min(rng.randrange(50), rng.randrange(50))}" for _ in range(rng.randrange(8, 40))) for _ in range(41)]
    texts = [" ".join(items[(5 * k + j) % 41] for j in range(3)) for k in range(41)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole, parts = ({(r[0], r[1]): tuple(r[2:]) for r in decontam.find(docs(spark, texts), benchmark, chunk=c).collect()} for c in (100, 8))
    assert whole and whole == {k: pytest.approx(v) for k, v in parts.items()}


def test_long_items(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    zipf = [1 / (i + 1) for i in range(3000)]
    words = lambda n: " ".join(rng.choices(vocabulary, zipf, k=n))
    items = [words(n - 10) + ". " + words(10) + "." for n in [20, 49, 60, 71, 100, 200, 250, 300, 500, 1000] * 4]
    texts = [words(rng.randrange(200)) + ". " + items[k % 40] + " " + words(rng.randrange(200)) for k in range(80)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.find(docs(spark, texts + [words(900) for _ in range(20)]), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k % 40) for k in range(80)}
    code, first = np.array([rng.randrange(60) for _ in range(400)]), np.array([0, 0, 30, 78, 127, 400])
    value = np.array([0.5 + c for c in range(60)])[code]
    least = decontam._weakest(code + 100 * np.repeat(np.arange(5), np.diff(first)), value, first)
    for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
        sums = [sum(0.5 + c for c in set(code[x : min(x + decontam.WINDOW, b)].tolist())) for x in range(a, max(a + 1, b - decontam.WINDOW + 1))]
        assert a == b or abs(least[k] - min(sums)) < 1e-6


# ---- 7


def _components(sets, percent=80):
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_ngram_join(spark):
    rng = random.Random(8)
    texts = list(ODD)
    common = prose(rng, 50)
    for _ in range(25):
        base = prose(rng, rng.randrange(1, 90)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(["changed", "AND", "other"])
            texts.append(rng.choice([" ", "\n"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
        texts.append(common + " " + " ".join(base[:15]))
    ids = rng.sample(range(1000), len(texts))
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    groups = _components(sets)
    got = {r["doc_id"]: r for r in ngram_join.join(docs(spark, texts, ids)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), groups[i]) for i in ids}
    odd = ngram_join.join(docs(spark, ["a b c", "a b c", "a b c"], [None, 4, 4])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in odd) == [(0, 0), (4, 4), (4, 4)]
    assert ngram_join.join(docs(spark, texts, ids).where("false")).count() == 0


def _by_brute_force(texts, ids):
    sets = {}
    for k, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    groups = _components(sets)
    least = {}
    for k, g in groups.items():
        least[g] = min(least.get(g, ids[k]), ids[k])
    return sorted((ids[k], len(sets[k]), least[groups[k]] if sets[k] else ids[k]) for k in sets)


def _joined(spark, texts, ids):
    return sorted(tuple(r) for r in ngram_join.join(docs(spark, texts, ids)).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize(("rows", "hot", "block"), [(1, 16, 4096), (3, 2, 3), (1000, 2, 4)])
def test_join_by_batches_of_any_size(spark, monkeypatch, rows, hot, block):
    """Streams of many Arrow batches, hot hashes and hashes in several blocks; ids that stand on different texts."""
    rng = random.Random(rows)
    texts = [None, "", "same", "same"]
    for _ in range(6):
        base, family = prose(rng, 60).split(), prose(rng, 12).split()
        for k in range(9):
            copy = list(base)
            copy[rng.randrange(60)] = f"n{k}"
            texts += [" ".join(copy), " ".join([*family, *(f"u{rng.random()}" for _ in range(3))]), " ".join([f"v{k % 2}", *base[5:]])]
    ids = [rng.randrange(len(texts) // 2) for _ in texts]
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PART", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        assert _joined(spark, texts, ids) == _by_brute_force(texts, ids)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("width", [1, 5])
def test_heads_and_entries_of_a_part(width):
    """Hot entries go past their part, which still knows the hash; equal sums mean equal sets."""
    rng = np.random.default_rng(5)
    classes = np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8)
    passages = [" ".join(f"p{k}w{x}" for x in range(9)) for k in range(8)]
    texts = [" ".join([*(passages[k] for k in rng.permutation(8)[:3]), f"own{i} w{i % 7} z"]) for i in range(60)] + ["a b c d e f"] * 3 + ["a b c d e g"] * 2 + ["a b c d e h"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])

    class Shared:
        value = classes

    def run(size, hot):
        old, ngram_join.HOT = ngram_join.HOT, hot
        try:
            blobs = list(ngram_join._prefixes(width, 50, Shared, 4)(rows.slice(k, size) for k in range(0, len(texts), size)))
        finally:
            ngram_join.HOT = old
        whole = pa.Table.from_batches(blobs)
        out = [ngram_join._entries(whole.filter(pa.compute.equal(whole["part"], k)), classes).to_pydict() for k in range(4)]
        heads = [(h, s) for o in out for h, s, x in zip(o["hash"], o["same"], o["head"], strict=True) if x]
        entries = sorted({(h, d, p) for o in out for h, d, p, x in zip(o["hash"], o["set"], o["place"], o["head"], strict=True) if not x})
        return heads, entries

    of, places = collections.defaultdict(set), {}
    for _, sets in ngram_join.shingle_sets(rows["text"], width):
        for x in sets:
            low = ngram_join._fingerprint(x)[0]
            for k, h in enumerate(ngram_join.prefix(x, classes, 50).tolist()):
                key = int(np.array([h ^ (1 << 63)], np.uint64).view(np.int64)[0])
                of[key].add(low)
                places[key, low] = k
    shared = {h for h, x in of.items() if len(x) > 1}
    part = lambda h: int(blocks.mix(np.array([h], np.int64).view(np.uint64) ^ np.uint64(1 << 63))[0] % np.uint64(4))
    families = collections.defaultdict(list)
    for h in shared:
        families[part(h), frozenset(of[h])].append(h)
    firsts = sorted(min(x) for x in families.values())
    assert 10 < len(firsts) < len(shared)
    for size, hot in ((len(texts), 10**9), (1, 10**9), (7, 10**9), (7, 3), (66, 2), (30, 5)):
        heads, entries = run(size, hot)
        assert sorted(h for h, _ in heads) == firsts
        assert {(h, d, places[h, d]) for h in firsts for d in of[h]} <= set(entries) <= {(h, d, places[h, d]) for h in shared for d in of[h]}
        same = collections.defaultdict(set)
        for h, s in heads:
            same[s].add(frozenset(of[h]))
        assert all(len(x) == 1 for x in same.values())


def test_a_shingle_of_very_many(spark):
    """A shingle in the prefixes of 50,000 different sets, two of them near another."""
    n = 50_000
    hot = " ".join(f"h{k}" for k in range(12))
    texts = [f"a{k} b{k} {hot}" for k in range(n)] + [f"x b7 {hot}", f"a9 x {hot} {hot}"]
    frame = spark.range(n).selectExpr("id AS doc_id", f"concat('a', id, ' b', id, ' {hot}') AS text").union(spark.createDataFrame([(n, texts[n]), (n + 1, texts[n + 1])], "doc_id long, text string")).repartition(8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame).collect()}
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    assert near(shingles(texts[7]), shingles(texts[n])) and not near(shingles(texts[9]), shingles(texts[n + 1])) and not near(shingles(texts[1]), shingles(texts[2]))
    assert all(got[k] == (10, k) for k in range(n)) and got[n] == (10, 7) and got[n + 1][1] == n + 1


def test_rare_shingles_keep_their_order(spark):
    texts = []
    for k in range(80):
        own, shared = [f"w{k}x{i}" for i in range(24)], [f"s{k % 4}x{i}" for i in range(96)]
        texts += [" ".join(own + shared), " ".join(own + shared[:-20])]  # 96 of 116 shingles; 24 of them are rare
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[95] == got[100] == 90


# ---- 8


def test_chain():
    rng = random.Random(9)
    words = np.array([blocks.hash_of(f"w{i}".encode()) for i in range(200)], np.uint64)
    sets, y = [], []
    for _ in range(600):
        insult, threat = rng.random() < 0.3, rng.random() < 0.5
        own = set(rng.sample(range(20, 200), 30)) | ({rng.randrange(0, 6)} if insult else set()) | ({rng.randrange(6, 12)} if threat else set())
        sets.append(np.sort(words[sorted(own)]))
        y.append((insult, insult and threat))
    y = np.array(y, float)
    y[::50, 1] = np.nan
    chain = toxicity.fit_chain(["insult", "both"], sets[:450], y[:450], np.arange(450) % 5)
    assert chain.models[1][2][0] > 0  # the later model leans on the earlier one
    rows = np.repeat(np.arange(150), [len(s) for s in sets[450:]])
    p = chain.probabilities(rows, np.concatenate(sets[450:]), 150)
    known = ~np.isnan(y[450:, 1])
    assert ((p[:, 0] > 0.5) == (y[450:, 0] > 0.5)).mean() > 0.97 and ((p[known, 1] > 0.5) == (y[450:, 1][known] > 0.5)).mean() > 0.85


def test_toxicity(spark):
    rng = random.Random(10)
    texts = [prose(rng, 40) + (" you utter idiot and worthless scum" if i % 5 == 0 else "") for i in range(200)] + ODD
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), None if i % 9 == 0 else 1) for i in range(0, 200, 2)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(frame, labels, {"low": "quality = 0", "toxic": "toxic = 1"})
    got = {r["doc_id"]: r for r in toxicity.predict(frame.withColumn("p_toxic", F.lit("clash")), chain).collect()}
    assert all((got[i]["p_toxic"] >= 0.5) == (i % 5 == 0) for i in range(200)) and all(got[200 + i]["p_toxic"] < 0.5 for i in range(len(ODD)))
    empty = toxicity.fit(frame, labels.where("false"), {"toxic": "toxic = 1"})
    assert toxicity.predict(frame, empty).count() == len(texts) and toxicity.predict(frame.where("false"), chain).count() == 0


# ---- 9


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 99.5, 100.5, 1e6])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_lm(spark):
    rng = random.Random(11)
    texts = [*ODD[:8], *(prose(rng, rng.randrange(3, 30)) for _ in range(30)), ODD[-1], ODD[-1]]
    frame = docs(spark, texts).select("*", (langid.fold("doc_id", 7) == 2).alias("held_out"))
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*WORD.findall(t.translate(LOWER)), None]
    c = collections.Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for few in (False, True):
        got = {r["doc_id"]: r for r in lm.score(frame, **({"most_words": 3, "most_grams": 40} if few else {})).collect()}
        for i, t in enumerate(texts):
            own = tokens(t or "")
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(c[w] > 0 for w in own), n)
            assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-8
            assert abs(r["score"] - _ctw(train, t or "")) < 1e-6 * max(1, abs(r["score"]))
    assert lm.score(frame.where("false")).count() == 0
    none = lm.score(docs(spark, ["ab"]).withColumn("held_out", F.lit(True))).first()
    assert none["n_known"] == 0 and abs(none["score"] - 3 * math.log10(1 / 256)) < 1e-9


_memo: dict = {}


def _ctw(train, text):
    """Context-tree weighting by its definition: nodes of (context, decision), mixed from the leaves up."""
    key = tuple(train)
    if key not in _memo:
        nodes, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
        for t in train:
            s = b"\xff" * 4 + t.encode() + b"\xff"
            for i in range(4, len(s)):
                for k in range(8):
                    node, bit = (1 << k) | (s[i] >> (8 - k)), s[i] >> (7 - k) & 1
                    for d in range(5):
                        nodes[s[i - d : i], node][bit] += 1
                        if d:
                            kids[s[i - d + 1 : i], node].add(s[i - d : i])
        _memo.clear()
        _memo[key] = nodes, kids, {}
    nodes, kids, weights = _memo[key]
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixture(s, node):
        if (s, node) not in weights:
            e = kt(*nodes[s, node])
            if len(s) < 4:
                below = sum(mixture(x, node) for x in kids[s, node])
                e = max(e, below) + math.log((1 + math.exp(-abs(e - below))) / 2)
            weights[s, node] = e
        return weights[s, node]

    s, total = b"\xff" * 4 + text.encode() + b"\xff", 0.0
    for i in range(4, len(s)):
        for k in range(8):
            node, bit = (1 << k) | (s[i] >> (8 - k)), s[i] >> (7 - k) & 1
            left, p = 1.0, 0.0
            for d in range(5):
                n = nodes.get((s[i - d : i], node))
                stop = 1.0 if d == 4 else 0.5 if n is None else min(1.0, math.exp(kt(*n) - mixture(s[i - d : i], node) - math.log(2)))
                p += left * stop * (0.5 if n is None else (n[bit] + 0.5) / (sum(n) + 1))
                left *= 1 - stop
            total += math.log10(p)
    return total


# ---- 10


def test_gradients():
    net = langid.BiGRU(["x", "y", "z"], hidden=5)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = np.array([[97, 98, 99, 97], [100, 97, 98, 98]], np.uint8)
    target = np.array([[1.0, 0, 0], [0, 0.3, 0.7]])
    _, g = net.gradients(x, target)
    rng = np.random.default_rng(0)
    for k in net.p:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in net.p[k].shape)
            if k.endswith("x"):
                at = (int(rng.choice([97, 98, 99, 100])), at[1])
            old = net.p[k][at]
            net.p[k][at] = old + 1e-4
            up = net.gradients(x, target)[0]
            net.p[k][at] = old - 1e-4
            down = net.gradients(x, target)[0]
            net.p[k][at] = old
            assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3, k


def test_language_id(spark):
    rng = random.Random(12)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["éau", "oux", "è"]}
    langs = [rng.choice(sorted(syllables)) for _ in range(150)]
    texts = [" ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randrange(1, 4))) for _ in range(12)) for x in langs] + ODD
    frame = docs(spark, texts).select("*", F.element_at(F.array(*map(F.lit, [*langs, *[None] * len(ODD)])), F.col("doc_id").cast("int") + 1).alias("lang"))
    net = langid.fit(frame.where(langid.fold("doc_id", 4) != 2), steps=300)
    got = {r["doc_id"]: r for r in langid.predict(frame.withColumn("lang_pred", F.lit(1)), net).collect()}
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.95 * len(held)
    for i, t in enumerate(ODD, 150):
        letters = bool(t) and any(c.isalpha() for c in t)
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
    untrained = langid.predict(frame, langid.fit(frame.where("false"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in untrained] == [("und", 0.0)]
    assert langid.predict(frame.where("false"), net).count() == 0
    assert langid.score_texts(net, pa.array(["kalomi " * 3000]))[0][0] == 0


def test_least_score(spark):
    frame = lambda scores: spark.createDataFrame([("aa", float(x)) for x in scores] + [("und", 0.0)], "lang_pred string, score double")
    assert abs(langid.least_score(frame([0.9] * 9 + [0.1]), 4) - (0.25 + 0.2 * 0.65)) < 1e-3
    assert abs(langid.least_score(frame([]), 2) - 0.6) < 1e-9 and langid.least_score(frame([0.9]), 1) == 0
    assert langid.least_score(frame([0.2]), 4) == 0.25


@pytest.mark.parametrize("languages", [2, 3])
def test_unclear_languages_are_rejected(spark, languages):
    """Texts that are clear in no language go, clean ones stay, and columns with names of the stage's own come back."""
    import corpus_pipeline

    rng = random.Random(15)
    letters = {"aa": "kalomirt", "bb": "schungew", "cc": "dfvxyzpb", "zz": "j"}
    known = sorted(letters)[:languages]
    langs = [known[i % languages] for i in range(120)]
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randrange(3, 8)))
    texts = [" ".join(word(x) for _ in range(20)) for x in langs]
    # as much of each language as of the others: clear in none
    mixed = [" ".join(word(known[k % languages]) for k in range(20 * languages)) for _ in range(5)] if languages == 3 else []
    rows = [(i, t, x, 7, "own", i) for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(1000 + i, t, None, 7, "own", 0) for i, t in enumerate([*mixed, "123", None])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string, known int")
    out = corpus_pipeline.language_id(spark, frame, "")
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == sorted(rows[:120])


def test_sampled(spark):
    """The rows of the smallest hashes, also where ids repeat often."""
    ids = [1] * 500 + list(range(2, 300)) + [None] * 3
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    order = rows.select("id", F.xxhash64("id").alias("h")).orderBy("h").collect()
    for most in (1, 7, 299, 600, 801, 2000):
        assert sorted(str(r["id"]) for r in blocks.sampled(rows, "id", most).collect()) == sorted(str(r["id"]) for r in order[:most])
    assert blocks.sampled(rows.limit(0), "id", 5).collect() == []


# ---- queries and pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op2_chat_formatting", "op5_warc"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from seekframe.llm import queries

    con = duckdb.connect()
    for t in ("conversations", "pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, found = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    item = " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(20)).capitalize() + ". " + "Answer words come after that all right."
    body = [prose(rng, 40) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(body)]
    rows += [(40, body[0] + " tail", "en", "s", 1), (41, body[1], "en", "s", 1), (42, body[2] + " " + item, "en", "s", 1), (43, ' '.join(reversed(body[3].split())) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "en", "s", 1), (44, "12345 !!", "en", "s", 1), (45, None, None, None, None), (46, "", "en", "s", 0)]
    rows += [rows[5]]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == {*range(30), 43} and "[SECRET]" in got[43]["text"] and "04dbebab" not in got[43]["text"]
    assert got[43]["n_chars"] == len(got[43]["text"]) and all(got[i]["text"] == body[i] and got[i]["pieces"] for i in range(30))
    docs_in = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_in, d).columns == docs_in.columns, name


def test_near_duplicates_of_odd_rows(spark):
    """Clashing names, maps, repeated ids on different texts: one row of each group stays."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(5, a, 1, {"k": 2}), (5, a, 1, {"k": 1}), (2, b, 1, None), (5, b + " t", 1, {}), (5, c, 1, None), (9, c, 0, None), (None, a, 3, None), (None, a, 3, None), (7, None, 4, {"z": 0}), (8, " ", 4, None)]
    docs_in = spark.createDataFrame(rows, "doc_id long, text string, kept_id long, `row` map<string,int>").withColumns({"print": F.lit(1), "grp": F.lit("x"), "component_id": F.lit(0)})
    out = corpus_pipeline.near_duplicates(spark, docs_in, "")
    assert out.columns == docs_in.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["kept_id"], str(r["row"])) for r in out.collect())
    assert got == sorted([(5, a, 1, "{'k': 1}"), (2, b, 1, "None"), (5, c, 1, "None"), (0, a, 3, "None"), (0, a, 3, "None"), (7, "", 4, "{'z': 0}"), (8, " ", 4, "None")])
    assert corpus_pipeline.near_duplicates(spark, docs_in.limit(0), "").collect() == []


def test_spans_that_meet_base_spans():
    rng = random.Random(4)
    for _ in range(200):
        spans = [("hex", s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        taken = secrets._Taken(spans)
        for s in range(60):
            e = s + rng.randrange(1, 12)
            assert taken.meets(s, e) == any(s < y and x < e for _, x, y in spans)


def test_toxicity_of_repeated_ids(spark):
    """Labels and texts that repeat an id count by their order, not by the partitions they lie in."""
    good, bad = [prose(random.Random(k), 30) for k in range(40)], ["vile " + prose(random.Random(k + 99), 30) + " filth" for k in range(40)]
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(k, "zz other") for k in range(0, 80, 3)]
    marks = [(k, int(k >= 40)) for k in range(80)] + [(k, 1) for k in range(0, 80, 5)]
    chains = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        random.Random(seed + 5).shuffle(marks)
        d, m = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + 3 * seed), spark.createDataFrame(marks, "doc_id long, toxic int").repartition(2 + seed)
        chain = toxicity.fit(d, m, {"toxic": "toxic = 1"})
        chains.append([[np.asarray(x).tolist() for x in model] for model in chain.models])
    assert chains[0] == chains[1]


@pytest.mark.parametrize("k", [3, 4, 8])
def test_whole_queries_run(spark, k):
    """Queries without SQL, run over the smallest tables: a row for each document."""
    from seekframe.llm import queries

    name = next(n for n in queries.QUERIES if n.startswith(f"op{k}_"))
    ids = sorted(r["doc_id"] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_arrow_batches_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    """Long texts come in batches of a few megabytes, though far fewer than 10,000 rows; a session's own bound stays."""
    frame, log = type(spark.range(0)), str(tmp_path / "batches")

    def seen(self, run, *rest, plain=frame.mapInArrow):
        def counted(batches):
            for batch in run(b for b in batches if open(log, "a").write(f"{b.num_rows} {b.nbytes}\n")):
                yield batch

        return plain(self, counted, *rest)

    monkeypatch.setattr(frame, "mapInArrow", seen)
    rows = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 30_000).alias("text"))
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own in (None, str(1 << 20)):
        spark.conf.set(key, own) if own else spark.conf.unset(key)
        try:
            for step in (lambda: langid.predict(rows, langid.BiGRU(["de", "en"])), lambda: decontam.clean(rows, bench), lambda: secrets.redact(rows, secrets.Model({}, []))):
                open(log, "w").close()
                assert step().count() == 200
                sizes = [tuple(map(int, x.split())) for x in open(log)]
                assert sum(n for n, _ in sizes) == 200
                assert max(b for _, b in sizes) < int(own or 8 << 20) + (1 << 20)
        finally:
            spark.conf.unset(key)
