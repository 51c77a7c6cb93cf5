"""Queries held against second, plain implementations, and the pipeline on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from kinloom.llm import base, langid, simhash, suffix, warc

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(autouse=True)
def batches(spark):
    was = {k: spark.conf.get(k) for k in base.BATCH}
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


# ---- 6: page text by a parser ----


class Plain(HTMLParser):
    """The text of well-formed pages by the standard library's parser."""

    hidden = {"script", "style", "svg", "noscript", "template", "title", "head"}
    breaks = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self):
        super().__init__()
        self.open, self.out, self.title = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.open.append(tag)
            self.out.append("" if tag in ("title", "head") or self.open[:-1] else " ")
        elif tag in self.breaks and not self.open:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        elif tag in self.breaks and not self.open:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if not self.open:
            self.out.append("\n" if tag in self.breaks else " " if tag == "svg" else "")

    def handle_comment(self, data):
        if not self.open:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.open:
            self.out.append(data)
        elif self.open[-1] == "title" and self.title is None:
            self.title = data

    @classmethod
    def text(cls, page):
        p = cls()
        p.feed(page)
        p.close()
        whole = ("" if p.title is None else p.title + "\n") + "".join(p.out)
        return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", whole)).strip(" \n")


def some_page(rng):
    def inner(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randint(0, 9)
            text = words(rng, rng.randint(1, 5)) + rng.choice(["", " &amp; x", "&nbsp;", " &lt;b&gt;", "\n"])
            if kind < 4 or not depth:
                out.append(text)
            elif kind < 7:
                tag = rng.choice(["p", "div", "b", "li", "span", "h2", "a", "SECTION"])
                out.append(f"<{tag} class='x y'>{inner(depth - 1)}</{tag}>")
            elif kind == 7:
                out.append(rng.choice(["<br>", "<hr/>", "<svg width='1'/>", "<!-- <p>no</p> -->", "<img src=x>"]))
            elif kind == 8:
                tag = rng.choice(["svg", "noscript", "template"])
                out.append(f"<{tag} a=b>{inner(depth - 1)}</{tag} >")
            else:
                out.append(rng.choice(["<script>if (a < b) '<p>'</script>", "<style>p > b {}</style>"]))
        return "".join(out)

    head = f"<head>\n<meta charset=utf-8><title>{words(rng, 2)}</title> <style>x</style></head>" if rng.random() < 0.7 else ""
    return f"<!DOCTYPE html><html>{head}<body>{inner(4)}</body></html>"


def test_page_text_equals_a_parser():
    rng = random.Random(2)
    for _ in range(500):
        page = some_page(rng)
        assert warc.plain_text(page) == Plain.text(page), page


def test_page_text_of_long_and_broken_pages():
    """Text that isn't closed, and pages of megabytes, in time that grows with the page."""
    for page in ("<svg>" * 200_000 + "x", "<title>" * 200_000 + "x", "<svg>" * 100_000 + "</noscript>" * 100_000, "<!--" * 100_000, "<a " * 200_000, "<p>one</p>" * 1_000_000, "<script>" * 100_000, "<head>" * 100_000 + "<p>x"):
        text = warc.plain_text(page)
        assert len(text) <= len(page)
    assert warc.plain_text("<p>one</p>\n" * 1_000_000).count("one") == 1_000_000
    assert warc.plain_text("<title>A</title><p>b") == "A\nb" and warc.plain_text("<head><p>x") == "x" and warc.plain_text("<title>never closed <p>b") == "never closed\nb"


# ---- 8: languages by dictionaries ----


def plain_grams(text):
    letters, out = [], Counter()
    for c in (text or "").lower():
        if c.isalpha():
            letters.append(c)
        elif not letters or letters[-1] is not None:
            letters.append(None)
    if not any(letters):
        return out
    letters = [None] * (letters[0] is not None) + letters + [None] * (letters[-1] is not None)
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            g = tuple(letters[i : i + n])
            if g != (None,):
                out[g] += 1
    return out


def number(gram):
    v = 0
    for c in gram:
        v = v << 21 | (1 if c is None else ord(c))
    return v


def top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def test_language_sample_is_bounded(spark):
    """Rows without an id are drawn like others, and equal rows teach once, however many they are."""
    df = spark.range(15_000).selectExpr("case when id >= 5000 then id end as id", "case when id < 10000 then concat('text ', id) else 'same' end as text", "'aa' as lang")
    for rows, most in ((df.filter("id is null"), 140), (df.filter("id < 10000"), 140), (df.filter("text = 'same'"), 140), (df.filter("text = 'same'").withColumn("id", df["id"] * 0), 1)):
        assert langid._drawn(rows, 100).count() <= most
    assert langid._drawn(df.filter("id is null"), 100).count() >= 60 and langid._drawn(df, 20_000).count() == 15_000
    assert langid._drawn(df.limit(0), 5).count() == 0


def test_language_id_equals_plain(spark):
    """The query's rows, held against rank lists of dictionaries: very long texts, equal distances, repeated rows, far letters."""
    rng = random.Random(3)
    alphabet = {"aa": "abcde", "bb": "cdefg", "cc": "éèñßd", "dd": "\U00010400\U00010401ab"}
    some = lambda lang, n: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, some(lang, rng.randint(1, 30)), lang) for i, lang in enumerate(list(alphabet) * 30)]
    rows += [(500, some("aa", 30_000), None), (501, "xyz", None), (502, "xyz", None), (501, "xyz", "aa"), (None, some("bb", 5), "bb"), (503, "1 2 3", "cc"), (504, None, "aa"), (505, "", None)]
    got = langid.identify(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, score int"), size=40).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    learnt = {lang: Counter() for lang in alphabet}
    for i, text, lang in rows:
        # all rows are learnt from, as there are fewer than per_language
        if lang and text is not None and not held(i):
            learnt[lang].update(plain_grams(text))
    profiles = {lang: {g: r for r, g in enumerate(top(c, 40))} for lang, c in learnt.items()}
    want = []
    for i, text, _ in rows:
        mine = top(plain_grams(text), 40)
        costs = {lang: sum(abs(p[g] - r) if g in p else 40 for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(costs), key=costs.get)
        want.append((i, held(i), best if mine else "und", round(1 - costs[best] / (40 * len(mine)), 9) if mine else 0.0))
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == Counter(want)


# ---- pipeline ----

FULL = "doc_id long, text string, lang string, source string, n_chars long"


def brute_marks(texts):
    """For each text the bytes that a string of 200 bytes covers which also starts elsewhere."""
    raw, seen = [t.encode() for t in texts], Counter()
    for b in raw:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def test_anchor_of_several_shards(spark):
    """A passage in more documents than a shard holds stretches: what repeats is found across shards, with the usual settings."""
    rng = random.Random(5)
    passage = words(rng, 45)[:215]
    texts = [words(rng, 40)[-150:] + passage + words(rng, 40)[:150] for _ in range(2 * suffix.STRETCHES + 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = suffix._keyed(docs, "doc_id", "text")
    found = suffix._occurrences(keyed, 200).groupBy("ah").agg(F.countDistinct("ch").alias("kinds"))
    assert found.filter(F.col("kinds") > 2 * suffix.STRETCHES).count() > 0
    got = {r["doc_id"]: (r["n_bytes"] - r["n_removed"], r["kept_sha256"]) for r in suffix.dedup(docs).collect()}
    want = {i: (len(left), hashlib.sha256(left).hexdigest()) for i, left in enumerate(brute_marks(texts))}
    assert got == want and sum(n for n, _ in got.values()) < sum(map(len, texts)) - 200 * len(texts)


def awkward():
    rng = random.Random(11)
    good = ["\n".join(words(rng, 12).capitalize() + "." for _ in range(5)) for _ in range(60)]
    bad = ["\n".join(" | ".join(words(rng, 8).split()) for _ in range(5)) for _ in range(60)]
    passage = words(rng, 60)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)] + [(100 + i, t, "en", "s0", len(t)) for i, t in enumerate(bad)]
    rows += [(200, good[0], "en", "s1", 1), (200, good[0], "en", "s1", 1), (None, good[1], None, None, None), (None, good[1], None, None, None), (201, None, "en", "s1", None), (None, None, None, None, None), (202, "", "de", None, 0), (203, "  \n ", "de", "s1", 4)]
    rows += [(210 + i, "\n".join(words(rng, 10).capitalize() + "." for _ in range(4)) + "\n" + passage + ".", "en", "s2", 9) for i in range(4)]
    rows += [(300, "\n".join(words(rng, 12).capitalize() + "." for _ in range(3000)), "en", "s2", 9)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(60)] + [(None, 1, 0), (3, None, None)]
    return rows, labels


@pytest.mark.parametrize("kind", ["awkward", "empty", "nulls"])
def test_pipeline_run(spark, tmp_path, kind):
    """run() on repeated rows, null and repeated ids, very long texts, tables without rows, and columns of other names between."""
    rows, labels = awkward()
    rows = {"awkward": rows, "empty": [], "nulls": [(None, None, None, None, None)] * 3}[kind]
    labels = labels if kind == "awkward" else []
    docs = spark.createDataFrame([(*r, i, "k", 0.5) for i, r in enumerate(rows)], FULL + ", key int, `rank` string, score double")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    made, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    given = docs
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        docs = function(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        made[name] = docs
        if i < 4:
            assert docs.columns == given.columns
    whole = corpus_pipeline.run(spark, str(tmp_path))
    last = made["best-fit packing"]
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(same).collect())) == Counter(map(tuple, last.select(same).collect()))
    if kind == "empty":
        assert last.count() == 0
        return
    kept = [tuple(r)[:5] for r in made["quality classifier"].collect()]
    assert not Counter(kept) - Counter(rows)
    if kind == "nulls":
        return
    texts = {r[1] for r in kept}
    assert all(r[1] in texts for r in rows[:60]) and not any(r[1] in texts for r in rows[60:120])
    # stage 2: of every group of equal texts (and of near ones) one row, which is one of the rows that came in
    left = [tuple(r)[:5] for r in made["near-duplicate documents"].collect()]
    assert not Counter(left) - Counter(kept)
    groups = {}
    for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(t for _, t, *_ in kept)), "doc_id long, text string")).collect():
        groups.setdefault(r["component_id"], []).append(kept[r["doc_id"]])
    assert len(left) == len(groups) and all(sum(1 for r in left if r in g) >= 1 for g in groups.values())
    assert [r for r in left if r[1] == rows[1][1]] == [rows[1]]  # the copies without an id go
    # stage 3: the very bytes that brute force leaves
    assert sorted(r["text"].encode() for r in made["repeated passages"].filter("text is not null").collect()) == sorted(b for b in brute_marks([r[1] for r in left if r[1] is not None]) if b.strip(b" ") != b"")
    # stage 4: only rows of stage 3, at most as often as epochs allow
    third, fourth = (Counter(tuple(r)[:5] for r in made[n].collect()) for n in ("repeated passages", "source mix"))
    assert fourth and set(fourth) <= set(third) and all(n <= 3 * third[r] for r, n in fourth.items())
    size = lambda rows: sum(len((r[1] or "").split()) * n for r, n in rows.items())
    longest = max(len((r[1] or "").split()) for r in third)
    assert abs(size(fourth) - size(third)) <= 4 * longest
    # stage 5: every row's pieces
    assert last.filter("piece = 0").count() == sum(fourth.values())


def test_whole_stage_without_texts_of_its_own(spark):
    """Stages give each case a result when columns bear names that operators use inside."""
    docs = spark.createDataFrame([(1, "a b c " * 80, "x", 1, 2.0, b"z", "m")] * 2 + [(None, None, None, None, None, None, None)], "doc_id long, text string, source string, rid long, marks double, fp binary, root string")
    got = suffix.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == 3 and {r["text"] for r in got.collect()} == {"", None}
    one = simhash.one_row_of_each(docs)
    assert one.columns == docs.columns and one.count() == 2


def test_folder_needs_sharing():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        base.shared_folder(Cluster)


def test_numbered(spark):
    rng = random.Random(1)
    names = [rng.choice("abc") * rng.randint(0, 3) for _ in range(200)] + [None] * 5 + ["\U00010000", "￿"]
    got = base.numbered(spark.createDataFrame([(n,) for n in names], T.StructType([T.StructField("n", T.StringType())])).repartition(4), F.col("n").asc_nulls_last()).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(207)) and [r["n"] for r in got] == sorted((n for n in names if n is not None)) + [None] * 5


def test_documents_that_share_a_hash(spark, monkeypatch):
    """Two documents of one hash take another salt; equal rows don't."""
    docs = spark.createDataFrame([(1, "a" * 300), (2, "b" * 300), (2, "b" * 300)], "doc_id long, text string")
    assert suffix._salt(docs, "doc_id", "text") == 0
    real = suffix._rid
    monkeypatch.setattr(suffix, "_rid", lambda i, t, salt: F.lit(7) if salt in (0, 1) else real(i, t, salt))
    assert suffix._salt(docs, "doc_id", "text") == 2
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix.dedup(docs).collect())
    assert got == [(1, 300), (2, 300), (2, 300)]
