"""Substring dedup on a De Bruijn graph of words.

Windows of 13 consecutive words are the graph's edges, the 12 words that two consecutive windows share is the node
between them.  Only edges that several documents have matter, and they are found in compacted form:

* Every edge is assigned to the four words inside it whose hash is least (its anchor).  Equal edges have equal anchors,
  and consecutive edges of a document that have one anchor are a path.  Equal paths are brought together by anchor and
  hash; all but the smallest document's copies repeat as a whole.
* Where an anchor has several different paths the graph branches.  Those paths, one copy each, are fetched by joins with
  the documents they come from, taken apart into edges again, and compared edge by edge.  An edge that very many
  documents have is settled within each batch first, and what is left streams past its first copy.
* Each repeated piece names the document and the place of its first copy.  The pieces' ends are nodes of the graph that the
  document walks in its source's coordinates; nodes at which as many pieces end as begin don't branch, and the pieces
  around them are compacted into one span.  What is left are nodes at which spans begin or end.
* Spans are verified at their source's coordinates: a digest of the words there is joined with the digest of the words
  here, and a span that differs removes nothing.

Documents are known by a 64-bit hash of id and text; should two share one, verification keeps either from losing words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.base import arrow_schema, map_arrow, partitions, release, stage, trim
from kinloom.llm.suffix import _split, _texts, covered, least_positions

WINDOW, GRAM = 13, 4
PATHS = 128  # paths of one anchor that are compared whole
CHUNK_BYTES = 2 << 20  # texts whose words are hashed together, one text at least
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, run together, and where each text's words begin (with the end of the last)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes = coded.indices.to_numpy()
    h = each[codes]
    if b"" in words:  # what stands before the first and after the last white space of a text
        some = codes != words.index(b"")
        h, offsets = h[some], np.r_[0, np.cumsum(some)][offsets]
    return h, offsets


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of n consecutive words from each word."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    count = len(h) - n + 1
    while size <= n:  # runs of 1, 2, 4, ... words; n is a sum of such sizes
        if n & size:
            part = power[done : done + count]
            out = part.copy() if out is None else out * np.uint64(pow(_P, size, 1 << 64)) + part
            done += size
        if size * 2 <= n:
            power = power[:-size] * np.uint64(pow(_P, size, 1 << 64)) + power[size:]
        size *= 2
    return _mixed(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def paths(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor hash, path hash, first and last edge (counted within the text) of each path of texts whose word hashes are run together."""
    n = len(h) - WINDOW + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
    if not len(inside):
        return (np.zeros(0, np.int64),) * 5
    grams = _runs(h, GRAM)
    at = least_positions(grams, WINDOW - GRAM + 1)[inside]
    begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # an anchor lies in one text
    first, last, anchor = inside[begins], inside[np.r_[begins[1:], len(inside)] - 1], at[begins]
    # a polynomial of the words from first to last, moved to begin at the power 0
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_P, len(h)), dtype=np.uint64)))
    own = (upto[last + WINDOW] - upto[first]) * _powers(_INVERSE, len(h))[first]
    ch = _mixed(own + ((anchor - first) << 8 | (last - first)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    which = text[first]
    return which, grams[anchor].view(np.int64), ch.view(np.int64), first - offsets[which], last - offsets[which]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """texts in slices of about CHUNK_BYTES, each with the number of its first text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_BYTES, side="right")))
        yield i, texts[i:j]
        i = j


#: kind 0: a path to compare; 1: pieces that repeat; 2: one copy of a path whose anchor has others.
ROWS = "kind int,key long,ch long,doc_id long,rid long,first int,last int,source long,source_first int"
NAMES = [x.split()[0] for x in ROWS.split(",")]


def _join_pieces(rid: np.ndarray, first: np.ndarray, last: np.ndarray, source: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents with those joined that go on in the document as in the source."""
    if not len(rid):
        return rid, first, last, source, at
    order = np.lexsort((first, rid))
    rid, first, last, source, at = (x[order] for x in (rid, first, last, source, at))
    go = (rid[1:] == rid[:-1]) & (first[1:] == last[:-1] + 1) & (source[1:] == source[:-1]) & (at[1:] - at[:-1] == first[1:] - first[:-1])
    begins = np.flatnonzero(np.r_[True, ~go])
    ends = np.r_[begins[1:], len(rid)] - 1
    return rid[begins], first[begins], last[ends], source[begins], at[begins]


def _map_side(keyed: DataFrame) -> DataFrame:
    """Paths of each batch of documents; those that repeat an earlier document of their batch need no more comparison."""

    def rows(batch: pa.RecordBatch) -> dict:
        _, once = np.unique(batch.column("rid").to_numpy(), return_index=True)  # fully repeated rows tell nothing more
        batch = batch.take(pa.array(np.sort(once)))
        doc_id, rid, texts = batch.column("doc_id").to_numpy(), batch.column("rid").to_numpy(), batch.column("text")
        parts = []
        for i, some in _chunks(texts):
            which, *found = paths(*word_hashes(some))
            parts.append((doc_id[which + i], rid[which + i], *found))
        doc, rid, key, ch, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((first, doc, ch, key))
        doc, rid, key, ch, first, last = (x[order] for x in (doc, rid, key, ch, first, last))
        new = np.r_[True, (key[1:] != key[:-1]) | (ch[1:] != ch[:-1])] if len(key) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = doc > doc[head]
        own, joined = ~later, _join_pieces(*(x[later] for x in (rid, first, last)), rid[head][later], first[head][later])
        none, zero = np.zeros(len(joined[0]), np.int64), np.zeros(int(own.sum()), np.int64)
        # settled pieces are dealt out by document
        columns = ((zero, none + 1), (key[own], joined[0]), (ch[own], none), (doc[own], none), (rid[own], joined[0]), (first[own], joined[1]), (last[own], joined[2]), (zero, joined[3]), (zero, joined[4]))
        return {n: np.concatenate(c) for n, c in zip(NAMES, columns, strict=True)}

    return map_arrow(keyed.filter("doc_id is not null").select("doc_id", "rid", "text"), rows, ROWS)


class _Settler:
    """Rows of kind 0 in the order of key, ch, doc_id, rid, first, batch after batch.

    Of the last path only its first row is remembered, and the rows of its first document as long as the anchor has
    no other path: these are of kind 2 if another path follows.
    """

    def __init__(self) -> None:
        self.key = self.ch = None
        self.head = (0, 0, 0)  # document, key of the document, first edge
        self.several = False
        self.pending: list[dict[str, np.ndarray]] = []

    def take(self, a: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
        n = len(a["key"])
        goes_on = self.key is not None and a["key"][0] == self.key
        first_new = not goes_on or a["ch"][0] != self.ch
        new_key = np.r_[not goes_on, a["key"][1:] != a["key"][:-1]]
        new = new_key | np.r_[first_new, a["ch"][1:] != a["ch"][:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        old = at < 0  # rows of the path that the batch before ended with
        doc, rid, first = (np.where(old, h, a[c][at]) for h, c in zip(self.head, ("doc_id", "rid", "first"), strict=True))
        segment = np.cumsum(new_key) - (0 if goes_on else 1)
        kinds = np.bincount(segment, weights=new)
        if goes_on:
            kinds[0] += 1 + self.several
        later = a["doc_id"] > doc
        repeated = np.r_[False, (a["rid"][1:] == a["rid"][:-1]) & (a["first"][1:] == a["first"][:-1]) & ~new[1:]]  # the same row from another batch
        own, several = ~later & ~repeated, kinds[segment] > 1
        out = [{"kind": np.ones(int(later.sum()), np.int32), "source": rid[later], "source_first": first[later]} | {c: a[c][later] for c in NAMES[1:7]}]
        branching = own & several
        if branching.any():
            out.append({"kind": np.full(int(branching.sum()), 2, np.int32)} | {c: a[c][branching] for c in NAMES[1:]})
        if goes_on and kinds[0] > 1:
            out += self.pending
        if not goes_on or kinds[0] > 1 or len(kinds) > 1:
            self.pending = []
        alone = own & ~several & (segment == segment[-1])
        if alone.any():
            self.pending.append({"kind": np.full(int(alone.sum()), 2, np.int32)} | {c: a[c][alone] for c in NAMES[1:]})
        self.several = bool(kinds[-1] > 1)
        self.key, self.ch, self.head = a["key"][-1], a["ch"][-1], (doc[-1], rid[-1], first[-1])
        return out


def _compacted(mapped: DataFrame) -> DataFrame:
    """Equal paths brought together: rows of kind 1 and 2."""
    target = arrow_schema(ROWS)
    spread = mapped.repartition(partitions(mapped), "key").sortWithinPartitions("kind", "key", "ch", "doc_id", "rid", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        settler = _Settler()
        for batch in batches:
            zero = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            if zero:
                for out in settler.take({n: batch.column(n)[:zero].to_numpy() for n in NAMES}):
                    if len(out["kind"]):
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
            if zero < batch.num_rows:
                yield batch.slice(zero)
        trim()

    return spread.mapInArrow(run, ROWS)


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for sizes[0] numbers, then the same of the next, run together."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """values as binary strings, sizes[i] of them in the i-th."""
    offsets = np.r_[0, np.cumsum(sizes)] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


#: kind 0: a path of an anchor with few, its edges packed; 1: an edge (key) of an anchor with many; 2: a piece that repeats.
MEETING = "kind int,key long,doc_id long,rid long,edges binary,places binary,first int,last int,source long,source_first int"


class _Heads:
    """Edges in the order of edge, doc_id, rid, place, batch after batch: only the first row of the last edge is remembered."""

    def __init__(self) -> None:
        self.last: tuple | None = None

    def take(self, edge: np.ndarray, doc: np.ndarray, rid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Which edges a document with a smaller id has, and the pieces that they make up."""
        goes_on = self.last is not None and self.last[0] == edge[0]
        new = np.r_[not goes_on, edge[1:] != edge[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        before = self.last[1:] if goes_on else (0, 0, 0)
        first = [np.where(head < 0, h, x[head]) for h, x in zip(before, (doc, rid, at), strict=True)]
        later = doc > first[0]
        self.last = (edge[-1], *(x[-1] for x in first))
        return later, _join_pieces(rid[later], at[later], at[later], first[1][later], first[2][later])


def _ordered(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns in the order of the first, then the second, ..."""
    order = np.lexsort(columns[::-1])
    return tuple(c[order] for c in columns)


def _branches(keyed: DataFrame, copies: DataFrame) -> DataFrame:
    """rid, first, last, source, source_first: edges of branching paths that an earlier document has as well.

    Anchors of up to PATHS paths are compared whole.  Of an anchor with more, edges travel by themselves: those that an earlier
    document of the same batch has are settled before they do, and the others stream past their first row in order, so
    that no task holds an edge's rows, however many documents have it.
    """
    many = copies.groupBy("key").count().filter(F.col("count") > PATHS).select("key", F.lit(True).alias("large"))
    dealt = copies.join(stage(many, "large-anchors"), "key", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    asked = dealt.groupBy("rid").agg(F.collect_set(F.struct("key", "large", "first", "last")).alias("asked"))
    rids = stage(asked.select("rid"), "branching-documents")
    texts = _texts(keyed.filter("doc_id is not null"), rids).dropDuplicates(["rid"])
    cut = map_arrow(texts.join(asked, "rid").select("doc_id", "rid", "text", "asked"), _cut, MEETING)
    return _met(cut)


def _cut(batch: pa.RecordBatch) -> dict:
    """The edges that a batch of documents is asked for."""
    doc_id, rid, lists = batch.column("doc_id").to_numpy(), batch.column("rid").to_numpy(), batch.column("asked")
    flat, upto = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    key, large, first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "large", "first", "last"))
    packed, single = [], []
    for i, some in _chunks(batch.column("text")):
        h, offsets = word_hashes(some)
        edges, j = _runs(h, WINDOW), i + len(some)
        a, b = upto[i], upto[j]
        own = np.repeat(np.arange(i, j), np.diff(upto[i : j + 1]))
        sizes = last[a:b] - first[a:b] + 1
        place, row = _ragged(first[a:b].astype(np.int64), sizes), np.repeat(np.arange(b - a), sizes)
        edge, alone = edges[place + offsets[own[row] - i]], large[a:b][row]
        single.append((edge[alone], doc_id[own[row[alone]]], rid[own[row[alone]]], place[alone]))
        edge, place, row = edge[~alone], place[~alone], row[~alone]
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        sizes, at = np.diff(np.r_[begins, len(row)]), row[begins]
        packed.append((key[a:b][at], doc_id[own[at]], rid[own[at]], _binary(edge, sizes), _binary(place.astype(np.int32), sizes)))
    keys, docs, rids, edges, places = (list(c) for c in zip(*packed, strict=True))
    edge, doc, own_rid, at = _ordered(*(np.concatenate(c) for c in zip(*single, strict=True)))
    later, pieces = _Heads().take(edge, doc, own_rid, at) if len(edge) else (np.zeros(0, bool), (at,) * 5)
    edge, doc, own_rid, at = (c[~later] for c in (edge, doc, own_rid, at))
    counts = [sum(map(len, keys)), len(edge), len(pieces[0])]
    zeros = [np.zeros(n, np.int64) for n in counts]
    nulls = pa.nulls(counts[1] + counts[2], pa.binary())
    columns = {
        "key": (*keys, edge.view(np.int64), pieces[0]), "doc_id": (*docs, doc, zeros[2]), "rid": (*rids, own_rid, pieces[0]), "first": (zeros[0], at, pieces[1]),
        "last": (zeros[0], at, pieces[2]), "source": (zeros[0], zeros[1], pieces[3]), "source_first": (zeros[0], zeros[1], pieces[4]),
    }
    made = {n: np.concatenate(c) for n, c in columns.items()}
    return made | {"kind": np.repeat(np.arange(3), counts), "edges": pa.concat_arrays([*edges, nulls]), "places": pa.concat_arrays([*places, nulls])}


def _together(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Pieces of whole anchors' packed paths.  Equal edges have equal anchors, so that several anchors may be compared at once."""
    raw = table.column("edges").to_pylist()
    n = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
    edge, at = np.frombuffer(b"".join(raw), np.uint64), np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32)
    doc, rid = (np.repeat(table.column(c).to_numpy(), n) for c in ("doc_id", "rid"))
    return _Heads().take(*_ordered(edge, doc, rid, at))[1]


def _met(cut: DataFrame) -> DataFrame:
    """Rows of _cut brought together: pieces of documents that an earlier document has."""
    schema = "rid long,first int,last int,source long,source_first int"
    target = arrow_schema(schema)
    spread = cut.repartition(partitions(cut), "key").sortWithinPartitions("kind", "key", "doc_id", "rid", "first")

    def made(pieces: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        if len(pieces[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(pieces, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        heads, rest = _Heads(), None
        for batch in batches:
            a, b = np.searchsorted(batch.column("kind").to_numpy(), [1, 2]).tolist()
            if a:
                rest = pa.concat_tables([*([rest] if rest is not None else []), pa.Table.from_batches([batch.slice(0, a)])])
                key = rest.column("key").to_numpy()
                whole = rest.num_rows if a < batch.num_rows else int(np.searchsorted(key, key[-1]))  # the last anchor may go on
                if whole:
                    yield from made(_together(rest.slice(0, whole)))
                rest = rest.slice(whole) if whole < rest.num_rows else None
            elif rest is not None:
                yield from made(_together(rest))
                rest = None
            if b > a:
                some = batch.slice(a, b - a)
                yield from made(heads.take(*(some.column(c).to_numpy() for c in ("key", "doc_id", "rid", "first")))[1])
            if b < batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(n).slice(b) for n in PLACES], schema=target)
        if rest is not None:
            yield from made(_together(rest))
        trim()

    return spread.mapInArrow(run, schema)


PLACES = ["rid", "first", "last", "source", "source_first"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))


def _spans(keyed: DataFrame) -> DataFrame:
    """rid, from, n, source, source_from: maximal spans of n words that a document repeats from an earlier one, not verified yet.

    A piece is two ends of a path, nodes of the graph in the coordinates of document and source.  Where as many pieces
    begin as end the node doesn't branch; along the other nodes spans are open from where pieces begin to where as many
    have ended (repeated rows may have told of the same piece twice).
    """
    found = stage(_compacted(_map_side(keyed)), "paths")
    pieces = found.filter("kind = 1").select(*PLACES).union(_branches(keyed, found.filter("kind = 2")).select(*PLACES))
    # One shuffle: what follows is partitioned by rid and more.
    pieces = pieces.repartition(partitions(keyed), "rid").withColumn("shift", F.col("first") - F.col("source_first"))
    ends = F.array(F.struct(F.col("first").alias("node"), F.lit(1).alias("out")), F.struct((F.col("last") + 1).alias("node"), F.lit(-1).alias("out")))
    nodes = pieces.select("rid", "source", "shift", F.explode(ends).alias("end")).select("rid", "source", "shift", "end.*")
    degrees = nodes.groupBy("rid", "source", "shift", "node").agg(F.sum("out").alias("degree")).filter("degree <> 0")
    along = Window.partitionBy("rid", "source", "shift").orderBy("node")
    walked = degrees.withColumn("open", F.sum("degree").over(along)).filter("open = 0 or open = degree")
    spans = walked.withColumn("end", F.lead("node").over(along)).filter("open > 0")
    return spans.select("rid", F.col("node").alias("from"), (F.col("end") - F.col("node") + WINDOW - 1).cast("int").alias("n"), "source", (F.col("node") - F.col("shift")).alias("source_from"))


def _judge(docs: DataFrame) -> DataFrame:
    """doc_id, rid, spans, asked, and what is left of each document without its spans; own, read: digests of the words of spans and of asked."""
    spans = "array<struct<`from`:int,n:int,source:bigint,source_from:int>>"
    schema = f"doc_id long, rid long, n_words long, n_removed long, kept_sha256 string, spans {spans}, asked array<struct<source_from:int,n:int>>, own array<binary>, read array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "own": [], "read": []}
            for text, spans, asked in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "asked")), strict=True):
                words = words_of(text)
                runs = [(s["from"], s["from"] + s["n"]) for s in spans or []]
                for c, v in zip(out, (len(words), *_left(words, runs)), strict=False):
                    out[c].append(v)
                out["own"].append([_digest(words, a, b) for a, b in runs])
                out["read"].append([_digest(words, s["source_from"], s["source_from"] + s["n"]) for s in asked or []])
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "own": pa.list_(pa.binary()), "read": pa.list_(pa.binary())}
            made = {c: batch.column(c) for c in ("doc_id", "rid", "spans", "asked")} | {c: pa.array(v, kinds[c]) for c, v in out.items()}
            yield pa.RecordBatch.from_arrays([made[c] for c in names], names=names)
        trim()

    names = ["doc_id", "rid", "n_words", "n_removed", "kept_sha256", "spans", "asked", "own", "read"]
    return docs.select("doc_id", "rid", "text", F.col("spans").cast(spans).alias("spans"), "asked").mapInArrow(run, schema)


def _left(words: list[bytes], runs: list[tuple[int, int]]) -> tuple[int, str]:
    """How many words runs cover, and the digest of the others."""
    at = [0, *(x for r in covered(runs, len(words)) for x in r), len(words)]
    kept = [w for a, b in zip(at[::2], at[1::2], strict=True) for w in words[a:b]]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _digest(words: list[bytes], a: int, b: int) -> bytes | None:
    return hashlib.sha256(b" ".join(words[a:b])).digest() if 0 <= a < b <= len(words) else None


def _asks(spans: DataFrame) -> DataFrame:
    """rid, spans, asked: of each document its spans, and the places in it that spans of others name."""
    own = spans.groupBy("rid").agg(F.collect_list(F.struct("from", "n", "source", "source_from")).alias("spans"))
    asked = spans.groupBy(F.col("source").alias("rid")).agg(F.collect_set(F.struct("source_from", "n")).alias("asked"))
    return own.join(asked, "rid", "full")


def _differing(judged: DataFrame) -> DataFrame:
    """rid, from, n, source, source_from: spans whose words aren't those of their source.

    Spans of one place and digest are one row before they meet their source, however many documents have them.
    """
    here = judged.select("rid", F.explode(F.arrays_zip("spans", "own")).alias("x")).select("rid", "x.spans.*", F.col("x.own").alias("digest"))
    place = ["source", "source_from", "n"]
    kinds = here.groupBy(*place, "digest").agg(F.count(F.lit(1)).alias("documents"))
    there = judged.select(F.col("rid").alias("source"), F.explode(F.arrays_zip("asked", "read")).alias("x")).select("source", "x.asked.*", F.col("x.read").alias("truth"))
    there = there.groupBy(*place).agg(F.min("truth").alias("truth"))
    wrong = kinds.join(there, place, "left").filter("digest is null or truth is null or digest <> truth").select(*place, "digest")
    wrong = stage(wrong, "differing-places")
    if wrong.isEmpty():
        return wrong.select(F.col("source").alias("rid"), F.col("n").alias("from"), "n", "source", "source_from")
    same = [F.col(f"h.{c}") == F.col(f"w.{c}") for c in place] + [F.col("h.digest").eqNullSafe(F.col("w.digest"))]
    return here.alias("h").join(wrong.alias("w"), same).select("h.rid", "h.from", "h.n", "h.source", "h.source_from").distinct()


def _verified(keyed: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that have spans or are the source of some, judged by verified spans alone (staged), and the other documents."""
    touched, rest = _split(keyed, stage(_asks(spans), "spans-by-document"))
    judged = stage(_judge(touched), "judged")
    wrong = stage(_differing(judged), "differing-spans")
    if wrong.isEmpty():
        return judged, rest
    right = spans.join(wrong, ["rid", "from", "n", "source", "source_from"], "left_anti")
    touched, rest = _split(keyed, stage(_asks(right), "spans-by-document"))
    return stage(_judge(touched), "judged"), rest


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, from, to, source_doc_id, source_from: maximal spans of words that a document repeats from an earlier one.

    Spans are verified word by word, by digests, at their source's coordinates.
    """
    keyed = _keyed(docs, id_col, text_col)
    judged, _ = _verified(keyed, stage(_spans(keyed), "spans"))
    names = judged.select(F.col("rid").alias("source"), F.col("doc_id").alias("source_doc_id")).distinct()
    each = judged.select("rid", "doc_id", F.explode("spans").alias("s")).distinct().select("doc_id", "s.*").join(names, "source")
    return each.select("doc_id", "from", (F.col("from") + F.col("n")).alias("to"), "source_doc_id", "source_from")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per input row.

    A null text has no words.  Rows with equal ids are one document: they don't repeat each other.  Rows with a null
    id repeat nothing and are not repeated.  Other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    judged, rest = _verified(keyed, stage(_spans(keyed), "spans"))

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            for c, v in zip(out.values(), (len(words), *_left(words, [])), strict=True):
                c.append(v)
        return {"doc_id": batch.column("doc_id")} | out

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return judged.select(*names).union(map_arrow(rest.select("doc_id", "text"), rows, "doc_id long,n_words long,n_removed long,kept_sha256 string"))
