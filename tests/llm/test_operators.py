"""The ten operators and the pipeline on small tables: brute force, round trips, held-out accuracy, edge cases."""

import gzip
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinloom.llm import avi, base, crf, debruijn, langid, mixing, packing, simhash, suffix, vectors, warc
from kinloom.llm.components import components
from kinloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size long"
SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Documents with copies, near copies, shared passages, and every edge case."""
    rng = random.Random(3)
    passage, line = words(rng, 60), words(rng, 25)
    texts = [words(rng, rng.randint(20, 200)) for _ in range(24)]
    texts += [texts[0], texts[0], texts[1] + " x", texts[2][:-3]]
    texts += [f"{words(rng, 10)} {passage} {words(rng, 12)}" for _ in range(4)] + [f"{words(rng, 5)}\n{line}\n{words(rng, 9)}" for _ in range(4)]
    texts += [None, "", "   \n", "a", "A a", "ab " * 400, "日本語のテキスト ñandú é", "\x00\x1c\x85 z", "Straße.\r\nÜber|x", words(rng, 9000)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s0")[i % 4], None if t is None else len(t), 0.5, "k", 7) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "s1", 1, None, None, None), (5, texts[5], "de", "s1", 1, None, None, None), (5, "another text of document five", None, None, 1, None, None, None)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True)
def batches(spark):
    """Batch limits as they were: operators lower them, and so do tests."""
    was = {k: spark.conf.get(k) for k in base.BATCH}
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


# ---- components ----


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert len({(find(k), v) for k, v in got.items()}) == len({find(k) for k in got}) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1: quality ----


def test_line_features_and_chain():
    x, w = crf.line_features("A b.\n\nc | d | e\nA b.")
    assert x.shape == (4, 3 * crf.OWN + 3) and w.tolist() == [4, 1, 9, 4] and x[3, 17] == 1 and x[0, 17] == 0
    assert (x[1, crf.OWN : 2 * crf.OWN] == x[0, : crf.OWN]).all() and (x[1, 2 * crf.OWN : 3 * crf.OWN] == x[2, : crf.OWN]).all()
    assert crf.line_features(None)[0].shape[0] == 1
    rng = np.random.default_rng(0)
    scores, transition = rng.normal(size=(1, 6, 2)), rng.normal(size=(2, 2))
    scores[:, :, 0] = 0
    p, pairs, z = crf.Chains(np.array([6])).forward_backward(scores[0, :, 1], transition)
    total, marginal = 0.0, np.zeros(6)
    for path in np.ndindex(*[2] * 6):  # every labelling
        w = math.exp(sum(scores[0, i, s] for i, s in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
        total, marginal = total + w, marginal + w * np.array(path)
    assert math.log(total) == pytest.approx(z[0]) and p == pytest.approx(marginal / total) and pairs.sum() == pytest.approx(5)
    assert crf._chain(scores[0, :, 1], transition) == pytest.approx(marginal / total)


def test_likelihood_gradient():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 7, 4, 7])
    chains = crf.Chains(lengths)
    every = rng.normal(size=(lengths.sum(), 5))
    x, y, weight = every[chains.lines], np.array([1, 0, 0, 1, 1])[chains.order], rng.random(5) + 0.1
    params = rng.normal(size=9)
    loss, gradient = crf.likelihood(x, chains, y, weight, params)
    step = 1e-5
    near = [(crf.likelihood(x, chains, y, weight, params + step * e)[0] - crf.likelihood(x, chains, y, weight, params - step * e)[0]) / (2 * step) for e in np.eye(9)]
    assert gradient == pytest.approx(near, abs=1e-6)
    # the loss itself: every labelling of every chain, line by line as the texts have them
    brute, begin = 0.0, np.r_[0, np.cumsum(lengths)]
    transition = params[5:].reshape(2, 2)
    for k, c in enumerate(chains.order.tolist()):
        good = every[begin[c] : begin[c + 1]] @ params[:5]
        weigh = {path: sum(good[i] for i, s in enumerate(path) if s) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)) for path in np.ndindex(*[2] * len(good))}
        brute += weight[k] * (math.log(sum(map(math.exp, weigh.values()))) - weigh[(int(y[k]),) * len(good)])
    assert loss == pytest.approx(brute)


def plain_score(field, text):
    """A document's score by forward-backward in logarithms over the whole text, line after line."""
    x, w = crf.line_features(text)
    good = ((x - field.mean) / field.scale) @ field.weights
    t, n = field.transition, len(good)
    add = np.logaddexp
    f, b = [(0.0, good[0])], [(0.0, 0.0)]
    for i in range(1, n):
        p, q = f[-1]
        f.append((add(p + t[0, 0], q + t[1, 0]), add(p + t[0, 1], q + t[1, 1]) + good[i]))
    for i in range(n - 1, 0, -1):
        p, q = b[-1]
        b.append((add(t[0, 0] + p, t[0, 1] + good[i] + q), add(t[1, 0] + p, t[1, 1] + good[i] + q)))
    m = np.array([math.exp(x[1] + y[1] - add(x[0] + y[0], x[1] + y[1])) for x, y in zip(f, b[::-1], strict=True)])
    raw = (m * w).sum() / w.sum()
    raw = min(max(raw, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(field.slope * math.log(raw / (1 - raw)) + field.shift)))


def test_quality_equals_plain(spark):
    """The query's rows, held against the plain form: long chains, repeated rows, repeated and null ids, far code points."""
    rng = random.Random(9)
    line = lambda good: words(rng, 6).capitalize() + "." if good else " | ".join(words(rng, 5).split())
    rows = [(i, "\n".join(line(i % 2 if rng.random() < 0.8 else rng.random() < 0.5) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(200, "\n".join(line(rng.random() < 0.5) for _ in range(6000))), (201, "\U0001f600 \U00020000\n" * 3), (201, rows[4][1]), (4, rows[4][1]), (None, rows[5][1]), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(4, 0, 0)], "doc_id long, quality int, toxic int")
    field = crf.fit_quality(docs, labels)
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in crf.classify(docs, labels).collect()), key=str)
    want = sorted(((i, plain_score(field, t)) for i, t in rows), key=str)
    assert len(got) == len(want) and all(g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-9) and g[2] == int(g[1] >= 0.3) for g, w in zip(got, want, strict=True))
    assert len({s for i, s, _ in got if i == 4}) == 1
    # a line's marginal depends on lines beyond any block's end
    x, _ = crf.line_features(rows[120][1])
    assert len(field.marginals(x)) == 6000


def test_quality_held_out(spark, none):
    rng = random.Random(5)
    good = [(i, "\n".join(words(rng, 12).capitalize() + "." for _ in range(4))) for i in range(150)]
    bad = [(i, "\n".join(" | ".join(words(rng, 8).split()) for _ in range(4))) for i in range(150, 300)]
    docs = spark.createDataFrame([(i, t, None, None, 1, None, None, None) for i, t in [*good, *bad, (900, None), (901, "")]], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = crf.classify(docs, labels, per_class=60).collect()
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert len(held) > 30 and all(r["predicted"] == (r["doc_id"] < 150) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    kept = crf.good_documents(docs, labels, per_class=60)
    assert kept.columns == docs.columns and kept.filter("doc_id < 150").count() == 150 and kept.filter("doc_id between 150 and 299").count() == 0
    assert crf.classify(none, labels.limit(0)).count() == 0


# ---- 2: SimHash ----


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, none, monkeypatch):
    for chunk in (simhash.CHUNK, 2):  # also with every bucket dealt into cells
        monkeypatch.setattr(simhash.links, "__kwdefaults__", {"fp_col": "fp", "chunk": chunk})
        got = sorted(simhash.near_duplicates(docs).collect(), key=str)
        fps = [brute_fingerprint(r[1]) for r in ROWS]
        root = list(range(len(ROWS)))
        for i in range(len(ROWS)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                    a, b = root[i], root[j]
                    root = [b if x == a else x for x in root]
        least = {}
        for r, k in zip(ROWS, root, strict=True):
            if r[0] is not None:
                least[k] = min(least.get(k, r[0]), r[0])
        want = sorted(((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(ROWS, fps, root, strict=True)), key=str)
        assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_row_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (24, 25)").count() == 0 and kept.filter("doc_id = 0").count() == 1 and kept.filter("doc_id is null").count() == 0
    assert kept.count() == len(set(root)) and kept.filter("text = 'another text of document five'").count() == 1


def test_simhash_pigeonhole():
    rng = random.Random(0)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in (m & (1 << 64) - 1 for m in simhash._choices()))
    near = [rng.getrandbits(64)]
    near += [near[0] ^ (1 << i) for i in range(40)]
    a, b = simhash._forest(np.array(near, np.uint64))
    assert len(a) == 40


# ---- 3: packing ----


@pytest.mark.parametrize("keep", [None, 3])
def test_encoder_equals_tokenizer(monkeypatch, keep):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = ["it's a_b__c 12ab3 Don't ''s !!'t x'd", "Été ½ ² ª µ ß İstanbul ſ", "a b　c", "", "<|endoftext|> x", "é x", "don't.“hi”", "日本語", "a\x1cb\x85c​d", "\x00\x01 a", "_ __ _a 1_2", "ǅ ŉ Ⅷ", None] + [r[1] for r in ROWS]
    encoder = packing.Encoder(path)
    if keep:  # words are forgotten after every block
        monkeypatch.setattr(packing, "KEPT", keep)
        monkeypatch.setattr(packing, "SPARE", 0)
    for block in (1024, 7):
        got = encoder.encode(texts, block)
        assert all(g.tolist() == plain.encode(t or "", add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))


def test_plan_is_best_fit():
    from bisect import bisect_left, insort

    rng = random.Random(1)
    for _ in range(40):
        lengths = [min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(rng.randint(1, 400))]
        used = {}
        for n, a, b, first, each, base in packing.plan(dict(Counter(lengths)), 64):
            for r in range(a, b):
                used.setdefault(first + (r - a) // each, []).append((base + (r - a) % each * n, n))
        for slots in used.values():
            at = 0
            for offset, n in sorted(slots):
                assert offset == at
                at += n
            assert at <= 64
        rooms = []
        for n in sorted(lengths, reverse=True):  # one piece after the other
            i = bisect_left(rooms, n)
            insort(rooms, (rooms.pop(i) if i < len(rooms) else 64) - n)
        assert len(rooms) == len(used) and sum(map(len, used.values())) == len(lengths)


def test_packing(docs, none):
    got = packing.pack(docs, tokenizer_path(), limit=256).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in ROWS:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        for k in range(-(-len(ids) // 1024)):
            part = ids[k * 1024 : k * 1024 + 1024]
            want[r[0], k, k * 256, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in places.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(none, tokenizer_path()).count() == 0


# ---- 4: suffix arrays ----


def brute_windows(texts, span):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    return [[seen[t[i : i + span]] > 1 for i in range(len(t) - span + 1)] for t in texts]


def test_repeated_windows():
    rng = random.Random(0)
    letters = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    for _ in range(25):
        base = [letters(rng.randint(100, 700)) for _ in range(6)]
        texts = [b[i : i + rng.randint(200, 600)] + letters(rng.randint(0, 50)) for b in base for i in (0, rng.randint(0, 90))]
        texts = [t for t in texts if len(t) >= 200] + [b"ab" * 200, b"a" * 300, b"\0" * 210]
        flags, numbers = suffix.repeated_windows(texts)
        assert [g.tolist() for g in flags] == brute_windows(texts, 200)
        windows = [(t[i : i + 200], n) for t, own in zip(texts, numbers, strict=True) for i, n in enumerate(own.tolist())]
        assert len(set(windows)) == len({w for w, _ in windows}) == len({n for _, n in windows})
        data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(data))
        sa = suffix.suffix_array(data, left)
        suffixes = [bytes(data[i : i + left[i]]) for i in sa.tolist()]
        assert suffixes == sorted(suffixes)


def test_anchors(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(6000))
    for raw in (text, b"z" * 1000):
        pos, h, first, last = suffix.anchors(raw)
        assert first[0] == 0 and last[-1] == len(raw) - 200 and (first[1:] == last[:-1] + 1).all() and ((pos >= last) & (pos <= first + 168)).all()
    whole = suffix.anchors(text)
    monkeypatch.setattr(suffix, "_BLOCK", 1 << 11)
    assert all((a == b).all() for a, b in zip(whole[2:], suffix.anchors(text)[2:], strict=True))


@pytest.mark.parametrize("stretches", [suffix.STRETCHES, 1])
def test_suffix_dedup(docs, none, monkeypatch, stretches):
    monkeypatch.setattr(suffix, "STRETCHES", stretches)  # 1: every mixed anchor is dealt over shards
    texts = [(r[1] or "").encode() for r in ROWS]
    want = Counter()
    for r, raw, flags in zip(ROWS, texts, brute_windows(texts, 200), strict=True):
        gone = bytearray(len(raw))
        for i, f in enumerate(flags):
            if f:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want[r[0], len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix.dedup(docs)
    assert Counter(map(tuple, got.collect())) == want and sum(k[2] for k in want) > 0
    if stretches == 1:
        assert suffix.dedup(none).count() == 0
        cut = suffix.without_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == len(ROWS) and cut.filter("text is null").count() == 1
        assert sum(r["n"] for r in cut.select(F.octet_length("text").alias("n")).filter("n is not null").collect()) <= sum(k[1] * v - k[2] * v for k, v in want.items())


# ---- 5: De Bruijn ----


@pytest.mark.parametrize("held", [1 << 20, 1])
def test_debruijn(spark, docs, none, monkeypatch, held):
    """held = 1: every branching anchor is dealt out, texts are hashed one by one, and rows come to Python one by one."""
    monkeypatch.setattr(debruijn, "PATHS", min(held, debruijn.PATHS))
    monkeypatch.setattr(debruijn, "CHUNK_BYTES", min(held, debruijn.CHUNK_BYTES))
    if held == 1:
        monkeypatch.setattr(base, "BATCH", {"spark.sql.execution.arrow.maxRecordsPerBatch": 1})
    split = [WORD.findall(r[1] or "") for r in ROWS]
    first = {}
    for r, w in zip(ROWS, split, strict=True):
        for i in range(len(w) - 12):
            if r[0] is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    want = Counter()
    for r, w in zip(ROWS, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i : i + 13])] < r[0]:
                gone[i : i + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[r[0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    assert Counter(map(tuple, debruijn.dedup(docs).collect())) == want and sum(k[2] for k in want) > 100
    if held == 1:
        assert debruijn.dedup(none).count() == 0
        plain = {r[0]: w for r, w in zip(ROWS, split, strict=True) if r[0] not in (None, 5)}
        covered = {}
        for r in debruijn.repeated_spans(docs.filter("doc_id is not null and doc_id <> 5")).collect():
            n = r["to"] - r["from"]
            assert n >= 13 and r["source_doc_id"] < r["doc_id"] and plain[r["doc_id"]][r["from"] : r["to"]] == plain[r["source_doc_id"]][r["source_from"] : r["source_from"] + n]
            covered.setdefault(r["doc_id"], set()).update(range(r["from"], r["to"]))
        gone = {k[0]: k[2] for k in want if k[0] not in (None, 5) and k[2]}
        assert {k: len(v) for k, v in covered.items()} == gone


def test_spans_that_differ(spark):
    """Spans whose words aren't those of their source, as of hashes that met by chance, remove nothing."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "y " * 20 + text)], "doc_id long, text string")
    keyed = debruijn._keyed(docs, "doc_id", "text")
    rid = {r["doc_id"]: r["rid"] for r in keyed.collect()}
    spans = [(rid[2], 1, 40, rid[1], 0), (rid[3], 0, 13, rid[1], 0), (rid[3], 20, 15, rid[1], 0), (rid[3], 50, 13, rid[1], 30), (rid[3], 45, 20, rid[2], 30)]
    judged, rest = debruijn._verified(keyed, spark.createDataFrame(spans, "rid long, `from` int, n int, source long, source_from int"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in judged.collect()}
    assert got == {1: (40, 0), 2: (41, 40), 3: (60, 15)} and rest.count() == 0


def test_repeated_rows_and_long_texts(spark, monkeypatch):
    """Rows that are there several times, one text that repeats itself, and overlapping pieces of either."""
    rng = random.Random(8)
    long = words(rng, 30)
    rows = [(4, long), (4, long), (4, long), (2, " ".join([long] * 40)), (9, "a " * 300), (7, "a " * 50), (9, "a " * 300), (11, long + " " + "a " * 20), (None, long)]
    want = Counter()
    first = {}
    split = [WORD.findall(t) for _, t in rows]
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want[i, len(w), len(gone)] += 1
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, key int, source string")
    for n in (1, 3, 1000):
        monkeypatch.setattr(base, "BATCH", {"spark.sql.execution.arrow.maxRecordsPerBatch": n})
        got = debruijn.dedup(df.repartition(2)).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == want


def test_edges_of_very_many_documents(spark, monkeypatch):
    """Edges that thousands of documents have travel once for each batch, not once for each document."""
    rng, largest, met = random.Random(4), {}, debruijn._met
    shared = words(rng, 14).split()
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(15)] + shared + [f"b{i}x{j}" for j in range(15)])) for i in range(4000)]

    def watched(cut):
        for r in cut.filter("kind < 2").groupBy("kind", "key").count().groupBy("kind").max("count").collect():
            largest[r["kind"]] = r[1]
        return met(cut)

    monkeypatch.setattr(debruijn, "_met", watched)
    got = debruijn.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 14 if i else 0 for i, _ in rows}
    assert largest[1] <= 40 and largest.get(0, 0) <= debruijn.PATHS


def test_compacted_in_pieces(spark, monkeypatch):
    """A path that is alone before a cut still has its first document's places compared, and no others."""
    paths = [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6), (3, 2), (3, 7), (3, 8)]
    rows = [(0, 9, ch, doc, doc * 10, ch * 100, ch * 100 + 3, 0, 0) for ch, doc in paths] + [(0, 11, 5, 1, 10, 0, 1, 0, 0), (0, 11, 5, 2, 20, 0, 1, 0, 0)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in (1, 2, 4, 5, 100):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got = debruijn._compacted(spark.createDataFrame(rows, debruijn.ROWS)).collect()
        assert sorted((r["key"], r["ch"], r["doc_id"]) for r in got if r["kind"] == 2) == [(9, 1, 1), (9, 2, 4), (9, 3, 2)]
        assert sorted((r["ch"], r["doc_id"], r["source"]) for r in got if r["kind"] == 1) == [(1, 2, 10), (1, 3, 10), (2, 5, 40), (2, 6, 40), (3, 7, 20), (3, 8, 20), (5, 2, 10)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


# ---- 6: WARC ----


def test_warc(spark):
    page = "<html><head><title>T&amp;t</title><style>p{}</style></head><body><!-- c --><p>One <b>two</b></p><script>x</script><p>three<br>four</body>"
    assert warc.plain_text(page) == "T&t\nOne two\nthree\nfour"
    data = warc.response("http://x/", page, key=1, date="2024-01-01T00:00:00Z")
    (headers, block), = warc.parse(data)
    assert warc.record([h for h in headers if h[0] != "Content-Length"], block) == data
    (meta, lines), (conversion, text) = warc.derivatives(headers, block)
    source = warc.get(headers, "WARC-Record-ID")
    assert warc.get(meta, "WARC-Refers-To") == warc.get(conversion, "WARC-Refers-To") == source and text.decode() == warc.plain_text(page)
    assert f"source-warc-payload-digest: {warc.digest(page.encode())}".encode() in lines and warc.get(conversion, "WARC-Record-ID").encode() in lines
    assert b"payload-digest-valid: true" in lines and b"http-header-content-type: text/html; charset=utf-8" in lines
    pages = spark.createDataFrame([(1, "http://x/", page, "a"), (1, "http://x/", page, "a"), (None, None, None, None), (3, "u\r\nX: y", "<p>😀", "b")], "page_id long, url string, html string, warc string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert Counter(r["warc_type"] for r in rows) == {"metadata": 4, "conversion": 4} and rows[0]["record_id"] == rows[2]["record_id"]
    assert all(r["content_length"] == len(r["block"].encode()) and r["block_digest"] == warc.digest(r["block"].encode()) for r in rows)
    broken = spark.createDataFrame([(1, bytearray(data + data[:50])), (2, None), (3, bytearray(b"junk"))], "page_id long, warc binary")
    assert warc.derive(broken).count() == 2
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_codings_and_types(spark):
    """Chunks, gzip and deflate are undone; what isn't text has no conversion; gzip members read as plain records do."""
    page, chunked = "<p>hello</p> ä".encode(), lambda b: b"".join(b"%x;x=1\r\n%s\r\n" % (len(b[i : i + 5]), b[i : i + 5]) for i in range(0, len(b), 5)) + b"0\r\n\r\n"
    squeezed, raw = gzip.compress(page), zlib.compressobj(wbits=-15)
    html_, plain = ("Content-Type", "text/html; charset=utf-8"), ("Content-Type", "text/plain")
    cases = [
        ([html_], page, "hello\nä"), ([html_, ("Transfer-Encoding", "chunked")], chunked(page), "hello\nä"), ([html_, ("content-encoding", "GZIP")], squeezed, "hello\nä"),
        ([html_, ("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")], chunked(squeezed), "hello\nä"), ([html_, ("Content-Encoding", "deflate")], zlib.compress(page), "hello\nä"),
        ([html_, ("Content-Encoding", "deflate")], raw.compress(page) + raw.flush(), "hello\nä"), ([html_, ("Content-Encoding", "gzip")], squeezed + squeezed, "hello\nä\nhello\nä"),
        ([html_, ("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")], page, "hello\nä"), ([html_, ("Content-Encoding", "gzip")], gzip.compress(page * 9999)[:-9], None),
        ([plain], b"if a<b and c>d then x", "if a<b and c>d then x"), ([("Content-Type", "image/png")], b"\x89PNG\0\xff", ""), ([html_, ("Content-Encoding", "br")], b"zz", ""),
        ([], b" <b>x</b>", "x"), ([], b"a < b", "a < b"), ([], b"\0\1", ""), ([("Content-Type", "text/html")], '<meta charset="latin-1">\xe4'.encode("latin-1"), "ä"),
        ([plain], "\ufeffä".encode("utf-16-le"), "ä"), ([("Content-Type", "text/plain; charset=nope")], "ä".encode(), "ä"), ([("Content-Type", "text/html; charset=base64")], b"<p>x", "x"), ([html_], b"", ""),
    ]
    records = []
    for i, (fields, payload, want) in enumerate(cases):
        block = b"\r\n".join([b"HTTP/1.1 200 OK", *(f"{k}: {v}".encode() for k, v in fields)]) + b"\r\n\r\n" + payload
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Payload-Digest", warc.digest(payload))]
        records.append(warc.record(headers, block))
        made = warc.derivatives(headers, block)
        lines = made[0][1].decode()
        assert "payload-digest-valid: true" in lines
        if want == "" and payload:
            assert len(made) == 1 and "conversion-none: content" in lines and "conversion-record" not in lines, i
        elif want is None:  # cut short: what there is
            assert made[1][1].startswith("hello\nä\nhello".encode())
        else:
            assert made[1][1].decode() == want and f"conversion-digest: {warc.digest(want.encode())}" in lines, i
    joined = [("WARC-Type", "response"), ("WARC-Payload-Digest", warc.digest(page))]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(page)
    assert b"payload-digest-valid: true" in warc.derivatives(joined, block)[0][1]
    assert b"payload-digest-valid: false" in warc.derivatives([joined[0], ("WARC-Payload-Digest", "sha1:X")], block)[0][1]
    whole, members = b"".join(records), b"".join(map(gzip.compress, records))
    want = list(warc.parse(whole))
    assert len(want) == len(cases) and list(warc.parse(members)) == list(warc.parse(gzip.compress(whole))) == want
    table = spark.createDataFrame([(1, bytearray(whole), "k"), (2, bytearray(members), "k"), (3, bytearray(members[:-4]), "k"), (4, bytearray(b"\x1f\x8bjunk"), "k")], "page_id long, warc binary, record_id string")
    got = Counter()
    for r in warc.derive(table).collect():
        got[r["page_id"], r["warc_type"]] += 1
    assert got[1, "metadata"] == got[2, "metadata"] == len(cases) and got[1, "conversion"] == got[2, "conversion"] == len(cases) - 3 and got[3, "metadata"] == len(cases) - 1 and not got[4, "metadata"]


def test_warc_without_end_tags():
    """A head, svg, noscript or template without an end tag does not take the rest of the page with it."""
    for page, want in (
        ("<head><title>T</title><body><p>text", "T\ntext"),
        ("<head><meta charset=utf-8><title>T</title><script>'<p>no</p>'</script><p>text", "T\ntext"),
        ("<head><title>T</title>bare text", "T\nbare text"),
        ("<head><title>T</title></head><p>one<svg width='1'/>two", "T\none two"),
        ("<p>one<svg><path d=''/></svg>two<svg>three<p>four<svg><text>no</text></svg>", "one twothree\nfour"),
        ("<svg>a<svg>b</svg>c</svg>text", "text"),
        ("<template><p>one", "one"),
        ("<p>one<noscript>two<p>three", "onetwo\nthree"),
        ("<p>one<style>p{}<p>two", "one"),
        ("<p>one<script>x</p>", "one"),
    ):
        assert warc.plain_text(page) == want, page


# ---- 7: AVI ----


def test_avi_round_trip(docs, none):
    rng = np.random.default_rng(0)
    for n in (64, 128, 1024, 4096, 70016):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        data = avi.write_avi(payload)
        frames, step, length = avi.read_avi(data)
        assert avi.decode_frames(frames).tobytes()[:length] == payload and step == 0.04
        cut = data.index(b"idx1")
        plain = data[:4] + struct.pack("<I", cut - 8) + data[8:cut]  # without an index
        assert avi.read_avi(plain)[0] == frames
    info, raw = avi._segments(frames[0])
    assert (avi._slow_differences(info, raw).reshape(16, 64) == np.diff(np.c_[np.r_[128, avi.decode_frames(frames[:1])[0][:-1, 0]], avi.decode_frames(frames[:1])[0].astype(int)], axis=1)).all()
    got = {r["doc_id"]: r for r in avi.media_columns(docs.filter("doc_id is not null and doc_id <> 5")).collect()}
    for i, text, *_ in (r for r in ROWS if r[0] is not None and r[0] != 5):
        body = (text or "").encode()
        payload = body + b"\0" * (-len(body) % 64) if body else b"\0" * 64
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(avi.write_avi(payload)), hashlib.sha256(avi.write_avi(payload)).hexdigest())
    assert got[0]["feature"] == got[24]["feature"] and avi.media_columns(none).count() == 0


def test_shots(spark, docs):
    dark, light = np.full((10, 16, 64), 20, np.uint8), np.full((7, 16, 64), 200, np.uint8)
    assert avi.cuts(np.concatenate((dark, light, dark))).tolist() == [0, 10, 17] and avi.cuts(dark).tolist() == [0] and len(avi.cuts(dark[:0])) == 0
    media = [(1, bytearray(avi.write_avi(np.concatenate((dark, light)).tobytes()))), (2, None), (3, bytearray(b"RIFFxxxx"))]
    rows = avi.clips(spark.createDataFrame(media, "id long, media binary")).orderBy("clip").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 400, 10), (1, 1, 400, 680, 7)]
    assert avi.clips(avi.store_texts(docs)).select("id").distinct().count() == docs.select("doc_id").distinct().count()


def baseline(spark, image, quality=0.9):
    """A picture (grey, or red, green, blue) as the JVM's own writer codes it, and what its reader makes of that."""
    jvm = spark._jvm
    h, w = image.shape[:2]
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if image.ndim == 2 else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    picture = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            if image.ndim == 2:
                picture.getRaster().setSample(x, y, 0, int(image[y, x]))
            else:
                r, g, b = image[y, x].tolist()
                picture.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), param)
    writer.dispose()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if image.ndim == 2:
        return data, np.array([[back.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
    rgb = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return data, 0.299 * (rgb >> 16) + 0.587 * (rgb >> 8 & 255) + 0.114 * (rgb & 255)


def segments(frame):
    """Marker, begin and end of each segment up to the scan."""
    at = 2
    while frame[at + 1] != 0xDA:
        n = struct.unpack(">H", frame[at + 2 : at + 4])[0]
        yield frame[at + 1], at, at + 2 + n
        at += 2 + n


def motion_jpeg(frames, rate=10, sound=False, parts=1):
    """An AVI file of JPEG frames, with sound between them, in several RIFF parts."""
    chunk = avi._chunk
    head = lambda kind, scale, rate: struct.pack("<4s4sIHHIIIIIIII4H", kind, b"MJPG", 0, 0, 0, 0, scale, rate, 0, len(frames), 0, 0, 0, 0, 0, 0, 0)
    lists = [chunk(b"LIST", b"strl" + chunk(b"strh", head(b"auds", 1, 8000)))] if sound else []
    lists.append(chunk(b"LIST", b"strl" + chunk(b"strh", head(b"vids", 1, rate))))
    name, out = (b"01dc" if sound else b"00dc"), b""
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 1, *[0] * 13)) + b"".join(lists))
    for p in range(parts):
        movie, index, at = b"", b"", 4
        for f in frames[p::parts] if parts == 1 else frames[p * len(frames) // parts : (p + 1) * len(frames) // parts]:
            for c, body in [(b"00wb", b"\x01\x02\x03")] * sound + [(name, f)]:
                index += struct.pack("<4sIII", c, 0x10, at, len(body))
                movie += chunk(c, body)
                at = 4 + len(movie)
        out += chunk(b"RIFF", (b"AVI " + header if not p else b"AVIX") + chunk(b"LIST", b"movi" + movie) + (chunk(b"idx1", index) if not p else b""))
    return out


def test_baseline_frames(spark):
    from kinloom.llm import jpeg

    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:37, 0:51]
    soft = (np.sin(x / 7) * 60 + np.cos(y / 5) * 50 + 128).astype(np.uint8)
    noise = rng.integers(0, 256, (24, 33), dtype=np.uint8)
    colour = np.stack((soft, np.roll(soft, 9, 1), 255 - soft), axis=2)
    for image, quality, most in ((soft, 0.9, 1.01), (noise, 0.95, 1.01), (noise, 0.3, 1.01), (colour, 0.9, 6)):
        data, want = baseline(spark, image, quality)
        got = jpeg.decode(data).astype(float)
        assert got.shape == want.shape and np.abs(got - want).max() <= most and np.abs(got - want).mean() < most / 2
    # without its Huffman tables, which are the usual ones, as motion-JPEG frames come
    data, want = baseline(spark, soft)
    bare = bytearray(data)
    for marker, a, b in reversed(list(segments(data))):
        if marker == 0xC4:
            del bare[a:b]
    assert len(bare) < len(data) and np.abs(jpeg.decode(bytes(bare)).astype(float) - want).max() <= 1.01
    for broken in (b"", b"\xff\xd8", data[:200], data.replace(b"\xff\xc0", b"\xff\xc2"), data[:-300] + b"\xff\xd9"):
        with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
            jpeg.decode(broken)
    dark, light = (baseline(spark, np.full((16, 24), v, np.uint8))[0] for v in (20, 220))
    frames = [dark] * 12 + [light] * 8
    media = [(1, motion_jpeg(frames)), (2, motion_jpeg(frames, sound=True)), (3, motion_jpeg(frames, parts=2)), (None, motion_jpeg(frames[:3])), (4, motion_jpeg([data[:200]])), (5, motion_jpeg([])), (1, motion_jpeg(frames))]
    rows = [tuple(r) for r in avi.clips(spark.createDataFrame([(i, bytearray(m)) for i, m in media], "id long, media binary")).collect()]
    shots = [(0, 0, 1200, 12), (1, 1200, 2000, 8)]
    assert Counter(rows) == Counter([(i, *s) for i in (1, 2, 3, 1) for s in shots] + [(None, 0, 0, 300, 3)])


def test_media_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, None), (5, "x" * 100), (5, "y"), (5, "x" * 100), (6, "long " * 100_000)]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, id int, media string")
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) for r in avi.media_columns(df).collect())
    padded = [(i, (t or "").encode(), (t or "").encode() + b"\0" * (-len(t or "") % 64 or 64 * (not t))) for i, t in rows]
    assert got == Counter((i, len(b), len(p), hashlib.sha256(p).hexdigest()) for i, b, p in padded)


# ---- 8: languages ----


def test_language_id(spark, none):
    rng = random.Random(4)
    vocabulary = {"aa": "tor mal und sie gar nich wor".split(), "bb": "que los ella mente ción por".split(), "cc": "the ing and was hat ere".split()}
    rows = [(i, " ".join(rng.choice(v) + rng.choice(v) for _ in range(40)), lang, "s", 1, None, None, None) for i, (lang, v) in enumerate(list(vocabulary.items()) * 60)]
    rows += [(1000, None, "aa", None, 1, None, None, None), (1001, "12 --", None, None, 1, None, None, None), (1002, "", "bb", None, 1, None, None, None)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA), per_language=40).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] < 1000) and sum(r["held_out"] for r in got) > 40
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 1000} == {("und", 0.0)} and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none).count() == 0


def test_ngrams_and_distance():
    grams, counts = langid.ngram_counts("Ab, ab")
    chars, want = "\1ab\1ab\1", Counter()
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            g = chars[i : i + n]
            if g != "\1":
                v = 0
                for c in g:
                    v = v << 21 | ord(c)
                want[v] += 1
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want
    rank = {"x": langid._ranked(*langid.ngram_counts("abab ba"), 5), "y": langid._ranked(*langid.ngram_counts("zz zzy"), 5)}
    p = langid.Profiles(rank, 5)
    name, score = p.predict("abab")
    top = langid._ranked(*langid.ngram_counts("abab"), 5).tolist()
    cost = sum(abs(rank["x"].tolist().index(g) - i) if g in rank["x"].tolist() else 5 for i, g in enumerate(top))
    assert name == "x" and score == pytest.approx(1 - cost / (5 * len(top)))


# ---- 9: mixing ----


def shares(sizes, weights=(1, 2, 3)):
    """Targets by sharing what is left among sources below their caps, again and again."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = sum(sizes.values()), {}, set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        out |= {s: 3.0 * sizes[s] for s in full} or {s: share * weight[s] for s in free}
        left, free = left - sum(3 * sizes[s] for s in full), free - full if full else set()
    return out


def test_targets(spark):
    rng = random.Random(1)
    cases = [{"b": 100, "a": 1000, None: 100, "c": 10}, {"a": 0}, {"a": 5}, {None: 7, "z": 1}, {f"s{i}": rng.choice([0, 1, 10, 10**6]) for i in range(40)} | {"\U00010000": 9, "\uffff": 4, None: 0}]
    for sizes in cases:
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, n long")).collect()}
        assert got == pytest.approx(shares(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.targets(spark.createDataFrame([], "source string, n long")).count() == 0


@pytest.mark.parametrize("ranges", [1, 8, 4096])
def test_mix_takes_in_the_order_of_keys(spark, ranges):
    """What is taken, held against a walk through each source's documents in the order of their keys."""
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randint(0, 12)), rng.choice(["a", "b", "c", None])) for i in range(300)]
    rows += [(5, "same text", "d")] * 90 + [(6, "x y z", "d")] + [(None, words(rng, 5), "b")] * 7 + [(None, None, "b"), (7, None, "e"), (8, "", "a")]
    df = spark.createDataFrame([(*r, 1, 2.0, "r") for r in rows], "doc_id long, text string, source string, size long, key double, range string").repartition(5)
    keyed = [r.asDict() for r in mixing.keys(df).collect()]
    size = Counter()
    for r in keyed:
        size[r["source"]] += r["size"]
    aims, want = shares(dict(size)), Counter()
    for source, n in size.items():
        epochs = min(int(aims[source] // n), 3) if n else 0
        left = round(aims[source]) - epochs * n
        for r in sorted((r for r in keyed if r["source"] == source), key=lambda r: (r["key"], r["h"], r["size"])):
            part = min(r["size"], left)
            left -= part
            want[r["doc_id"], r["size"], n, epochs * r["size"] + part] += 1
    got = Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mixing.mix(df, ranges=ranges).collect())
    assert got == want


def test_mix(docs, none):
    got = mixing.mix(docs, ranges=8).collect()
    size = Counter()
    for r in ROWS:
        size[r[0], len(WORD.findall(r[1] or ""))] += 1
    assert Counter((r["doc_id"], r["size"]) for r in got) == size
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        key = r["target"], r["source_size"]
        by[key] = by.get(key, 0) + r["taken"]
    assert all(abs(aim - taken) <= 1 for (aim, _), taken in by.items()) and sum(by.values()) == pytest.approx(sum(r["size"] for r in got), abs=4)
    again = sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert again == sorted(map(str, mixing.mix(docs).collect())) and mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixed.filter("text is null").count() == 0


# ---- 10: vectors ----


def brute_links(rows):
    unit = [vectors._unit(v) for _, v, _ in rows]
    n = len(rows)
    link = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98 for j in range(n)] for i in range(n)]
    comp = [r[0] for r in rows]
    while True:
        new = [min([comp[i]] + [comp[j] for j in range(n) if link[i][j]]) for i in range(n)]
        if new == comp:
            return [(rows[i][0], sum(link[i]), comp[i], rows[i][0] == comp[i]) for i in range(n)]
        comp = new


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(i, base[i].tolist(), int(i % 2)) for i in range(30)]
    hot = base[0] + rng.normal(size=(90, 16)) * 0.08  # one large group of near copies
    rows += [(100 + i, v.tolist(), 0) for i, v in enumerate(hot)]
    rows += [(300 + i, base[1].tolist(), 1) for i in range(40)]  # exact copies
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] + [1.0] * 15, 0), (404, base[0].tolist(), None), (405, [], 1), (406, [1e300] * 16, 1), (407, [1.0] * 16, 1), (408, base[0].tolist()[:8], 0), (1, base[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vectors, "CELL", 32)  # large groups go through several cells
    got = sorted(map(tuple, vectors.near_duplicates(df, k=6, tables=4, leaf=16).collect()))
    assert got == sorted(brute_links(rows))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_weak_borders(spark):
    """Two tight groups of more than k vectors that only weaker links join: no list of k has room for those."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=64)
    a /= np.linalg.norm(a)
    side = rng.normal(size=64)
    side -= side @ a * a
    side /= np.linalg.norm(side)
    b = 0.985 * a + math.sqrt(1 - 0.985**2) * side
    rows = [(100 * g + i, (c + rng.normal(size=64) * 0.0028).tolist(), 0) for g, c in enumerate((a, b)) for i in range(20)]
    rows += [(500 + i, rng.normal(size=64).tolist(), 0) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(brute_links(rows))
    assert [r[1:] for r in want[:40]] == [(39, 0, i == 0) for i in range(40)]
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == want


def test_vectors_few_links(spark):
    """Links of few vectors among many, and one large group: all are found; from one round over tiny buckets, nine of ten at least."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 64))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(2000 + i, (base[i] + rng.normal(size=64) * 0.15).tolist(), 0) for i in range(40)]  # cosine about 0.989
    rows += [(3000 + i, (base[50] + rng.normal(size=64) * 0.02).tolist(), 0) for i in range(60)]  # most links are here
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"unit": F.lit("x"), "pid": F.lit(1), "root": F.lit(2)})
    want = sorted(brute_links(rows))
    assert sum(r[1] > 0 for r in want) > 120
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == want
    weak = sorted(map(tuple, vectors.near_duplicates(df, tables=1, leaf=2, rounds=1).collect()))
    share = [min(g[1] / w[1], 1) for g, w in zip(weak, want, strict=True) if w[1]]
    assert sum(share) / len(share) >= 0.9 and all(g[1] <= w[1] for g, w in zip(weak, want, strict=True))


def test_vectors_enlarged(spark):
    """Groups of more than k and fewer than k_most vectors: lists grow until they hold all links, and nothing is compared in blocks."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 32))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(1000 + 100 * g + i, (base[g] + rng.normal(size=32) * 0.05).tolist(), g % 3) for g in range(6) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(brute_links(rows))
    assert max(r[1] for r in want) == 25
    points = vectors._distinct(vectors._points(df, "vec_id", "embedding", "label"))[1]
    start = points.withColumns({"k": F.lit(5), "last": F.lit(-1.5)})
    lists = vectors._grown(vectors._first_lists(start, 4, 16, 1, 40), points, 5, 40, 0.978, 8, tables=4, leaf=16, seed=2)
    assert lists.filter("k = 40").count() >= 150 and lists.filter((F.size("near") >= F.col("k")) & (F.element_at("near", -1)["sim"] >= 0.978)).count() == 0
    assert sorted(map(tuple, vectors.near_duplicates(df, k=5, k_most=40, tables=4, leaf=16).collect())) == want


def test_vectors_recall_is_audited(spark):
    """A search that can't find links is told by the audit, and doesn't pass for whole."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(200, 16))
    rows = [(2 * i + j, (base[i] + rng.normal(size=16) * 0.1).tolist(), 0) for i in range(200) for j in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    points = vectors._distinct(vectors._points(df, "vec_id", "embedding", "label"))[1]
    lists = spark.createDataFrame([], "u long, k int, near array<struct<sim:double,v:long,new:int>>")
    assert vectors._audit(points, lists, spark.createDataFrame([], "pid long, n long"), 0.98) == 0.0
    with pytest.raises(RuntimeError, match="recall"):
        vectors.near_duplicates(df, tables=1, leaf=1, rounds=0, attempts=1)


# ---- pipeline ----


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no test tables")
    docs, counts = spark.read.parquet(str(source / "documents.parquet")), []
    columns = docs.columns
    for i, (_, function) in enumerate(pipeline.STAGES):
        before = docs
        function(spark, docs, str(source)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
    labels = spark.read.parquet(str(source / "labels.parquet"))
    first = spark.read.parquet(str(tmp_path / "0")).join(labels, "doc_id")
    assert first.filter("quality = 1").count() == labels.filter("quality = 1").count() and first.filter("quality = 0").count() <= 3
    assert counts[0] > counts[1] and docs.agg(F.max("length")).first()[0] <= 4096
    kept = spark.read.parquet(str(tmp_path / "1"))
    assert kept.count() == kept.select("text").distinct().count()


def test_pipeline_keeps_one_row_of_repeated_rows(spark):
    """Texts of repeated rows and of rows without an id come through the second and third stage once."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    t = [words(rng, 80) for _ in range(6)]
    pairs = [(1, t[0]), (1, t[0]), (2, t[1]), (None, t[1]), (None, t[2]), (None, t[2]), (3, t[3]), (3, t[3] + " x"), (4, t[4]), (7, t[5]), (6, t[5]), (6, t[5])]
    rows = [(i, text, "en", "s", len(text), None if n % 2 else 0.5, "k", n if i == 3 else 7) for n, (i, text) in enumerate(pairs)]
    rows[1] = rows[0]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    out = sorted((r["doc_id"] or 0, r["text"]) for r in pipeline.repeated_passages(spark, kept, "").collect())
    assert [i for i, _ in out] == [0, 1, 2, 3, 4, 6]
    assert all(text.removesuffix(" x") == t[{0: 2, 1: 0, 2: 1, 3: 3, 4: 4, 6: 5}[i]] for i, text in out)
    assert pipeline.near_copies(spark, docs.limit(0), "").count() == 0
