"""Suffix-array dedup: bytes covered by strings of 200 bytes that also start elsewhere.

Every window of 200 bytes is assigned to the 32-byte string inside it whose hash is least (its anchor).  Equal windows
have equal anchors, so repeats are looked for among the occurrences of an anchor alone:

* An occurrence is the stretch of windows that have it as their anchor.  Occurrences with equal stretches repeat as a
  whole; they are found by a digest of 128 bits of the stretch.
* Anchors with several different stretches go to shards, one copy of each stretch.  A shard sorts its suffixes by
  Larsson-Sadakane refinement, and Kasai's pass over the stretches gives the common prefixes of neighbours; windows
  with a common prefix of 200 bytes repeat.
* An anchor with more stretches than a shard should hold is dealt over several shards.  Each hands on a digest of 128 bits of
  each different window of its suffix array, sorted and cut into ranges, and the shards' runs of a range are looked up in each other by binary search.

Documents are known by a 64-bit hash of id and text; fully repeated rows stay rows of their own.  A second hash tells whether
two different documents share one, which takes another salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.base import bounded, map_arrow, partitions, release, stage, trim
from kinloom.llm.vectors import grouped

SPAN, GRAM = 200, 32
STRETCHES = 2048  # different stretches of one anchor that one shard holds
SHARD_BYTES = 1 << 20
_BLOCK = 1 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the GRAM bytes from each position."""
    h, p, n = data.astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(p) + h[n:]
        p, n = p * p & 0xFFFFFFFFFFFFFFFF, n * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """The position of the leftmost least of every width consecutive hashes.

    Hashes are compared by their upper 44 bits, the rest is a position; long arrays go in overlapping blocks.
    """
    found, low = [np.zeros(0, np.int64)], np.uint64(_BLOCK - 1)
    for i in range(0, len(h) - width + 1, _BLOCK - width):
        part = h[i : i + _BLOCK]
        least, n = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while n * 2 <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[: n - width], least[width - n :])
        found.append((least & low).astype(np.int64)[: _BLOCK - width] + i)
    return np.concatenate(found)


def minimizers(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leftmost least of every width consecutive hashes: its position, and the first and last window that have it."""
    at = least_positions(h, width)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def anchors(raw: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text: its position, its hash, and the first and last window (by start) that are assigned to it."""
    if len(raw) < span:
        return (np.zeros(0, np.int64),) * 4
    h = _grams(np.frombuffer(raw, np.uint8))
    pos, first, last = minimizers(h, span - GRAM + 1)
    return pos, h[pos].view(np.int64), first, last


def suffix_array(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of data in the order of the suffixes from them; equal suffixes come in the order of their positions.

    left: bytes from each position to the end of its stretch; suffixes end there.  Larsson-Sadakane: suffixes are
    grouped by their first 7 bytes, then every group that holds several is sorted by the groups of the suffixes h
    further on, h doubling; groups of one are left alone.  data has fewer than 2 ** 31 bytes.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(7, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(8) | np.where(left > i, padded[i : n + i], 0).astype(np.uint64)
    key = key << np.uint64(8) | np.minimum(left, 7).astype(np.uint64)  # one that ends comes before one that goes on with zeros
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h, depth = 7, int(left.max(initial=0))
    whole = np.flatnonzero(_several(new))
    while h < depth and len(whole):
        pos = sa[whole]
        # a suffix that has ended comes first in its group, and is equal to the others that have
        further = np.where(left[pos] > h, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        both = rank[pos] << 32 | further
        order = np.argsort(both)
        pos, both = pos[order], both[order]
        sa[whole] = pos
        begins = np.r_[True, both[1:] != both[:-1]]
        new[whole] = begins
        rank[pos] = whole[np.maximum.accumulate(np.where(begins, np.arange(len(whole)), 0))]
        still = _several(begins)
        # suffixes that have ended stay as they are
        whole = whole[still & (left[pos] > h)]
        h *= 2
    tied = np.flatnonzero(_several(new))
    pos = sa[tied]
    sa[tied] = pos[np.argsort(rank[pos] << 32 | pos)]
    return sa


def _several(new: np.ndarray) -> np.ndarray:
    """For each place in an order of groups that begin at ``new``: its group has several members."""
    return ~(new & np.r_[new[1:], True])


def common_prefixes(data: np.ndarray, starts: np.ndarray, left: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before it, most at most (0 for the first).

    Kasai's pass, in step over all stretches: from one position of a stretch to the next, a common prefix shrinks by
    one byte at most, and is extended from there.
    """
    n = len(data)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    before = np.where(rank > 0, sa[rank - 1], -1)
    out, shared = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((n,), "<u8", padded.tobytes(), strides=(1,))
    lengths = left[starts]
    live = np.arange(len(starts))
    for t in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > t]
        i = starts[live] + t
        j = before[i]
        got = np.maximum(shared[live] - 1, 0)
        got[j < 0] = 0
        limit = np.minimum(np.minimum(left[i], np.where(j < 0, 0, left[np.maximum(j, 0)])), most)
        got = np.minimum(got, limit)
        go = np.flatnonzero(got < limit)
        while len(go):
            a, b = eight[i[go] + got[go]], eight[j[go] + got[go]]
            x = a ^ b
            low = x & (~x + np.uint64(1))
            step = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            got[go] = np.minimum(got[go] + step, limit[go])
            go = go[(step == 8) & (got[go] < limit[go])]
        shared[live] = got
        out[rank[i]] = got
    return out


def repeated_windows(stretches: list[bytes], span: int = SPAN) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each stretch, a flag for each of its windows: the window is also elsewhere among the stretches; and a number of
    each window: the place in the suffix array of the first that is equal to it."""
    lengths = np.array([len(s) for s in stretches], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(stretches), np.uint8)
    left = np.repeat(ends, lengths) - np.arange(len(data))
    sa = suffix_array(data, left)
    shared = common_prefixes(data, ends - lengths, left, sa, span) >= span
    flag, number = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
    flag[sa] = shared | np.r_[shared[1:], False]
    number[sa] = np.maximum.accumulate(np.where(shared, 0, np.arange(len(data))))
    cut = [(e - n, e - span + 1) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return [flag[a:b] for a, b in cut], [number[a:b] for a, b in cut]


def covered(marks: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of n bytes that are covered by marks (from, to)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def _rid(id_col: str, text_col: str, salt: int) -> Column:
    """What a document is known by: a hash of its id and its text, a null text being empty."""
    return F.xxhash64(F.lit(salt), F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _salt(docs: DataFrame, id_col: str, text_col: str) -> int:
    """The first salt with which no two different documents have one hash, by a second hash."""
    salt = 0
    while True:
        both = docs.select(_rid(id_col, text_col, salt).alias("rid"), _rid(id_col, text_col, -1 - salt).alias("other"))
        if both.groupBy("rid").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least <> most").isEmpty():
            return salt
        salt += 1


def _keyed(docs: DataFrame, id_col: str, text_col: str, salt: int = 0) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _rid(id_col, text_col, salt).alias("rid"))


def _occurrences(keyed: DataFrame, span: int) -> DataFrame:
    """ah, ch, c2, rid, first, last, n: an anchor's hash, its stretch's digest, the document, the stretch's windows, copies.

    Stretches that a batch has several times repeat for certain: one row stands for them (n copies), and their windows,
    run together, come as rows with n = 0.  So a long periodic text or a group of copies gives few rows.
    """
    names = "ah long,ch long,c2 long,rid long,first int,last int,n int"

    def rows(batch: pa.RecordBatch) -> dict:
        got: dict[str, list] = {n: [] for n in ("ah", "ch", "c2", "rid", "first", "last")}
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            pos, h, first, last = anchors(raw, span)
            if len(pos):
                cut = zip(pos.tolist(), first.tolist(), last.tolist(), strict=True)
                ch = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a : b + span], p - a) for p, a, b in cut]), np.int64).reshape(-1, 2)
                for k, v in zip(got, (h, ch[:, 0], ch[:, 1], np.full(len(pos), rid), first, last), strict=True):
                    got[k].append(v)
        if not got["ah"]:
            return {x.split()[0]: [] for x in names.split(",")}
        a = {k: np.concatenate(v) for k, v in got.items()}
        order = np.lexsort((a["first"], a["rid"], a["c2"], a["ch"], a["ah"]))
        a = {k: v[order] for k, v in a.items()}
        starts = np.flatnonzero(np.r_[True, (a["ah"][1:] != a["ah"][:-1]) | (a["ch"][1:] != a["ch"][:-1]) | (a["c2"][1:] != a["c2"][:-1])])
        n = np.diff(np.r_[starts, len(order)])
        settled = np.repeat(n > 1, n)
        own = {k: v[settled] for k, v in a.items()}
        order = np.lexsort((own["first"], own["rid"]))
        rid, first, last = (own[k][order] for k in ("rid", "first", "last"))
        runs = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (first[1:] > last[:-1] + span)]) if len(rid) else np.zeros(0, np.int64)
        last = np.maximum.reduceat(last, runs) if len(runs) else last
        none = np.zeros(len(runs), np.int64)
        return {
            "ah": np.r_[a["ah"][starts], none], "ch": np.r_[a["ch"][starts], none], "c2": np.r_[a["c2"][starts], none], "rid": np.r_[a["rid"][starts], rid[runs]],
            "first": np.r_[a["first"][starts], first[runs]], "last": np.r_[a["last"][starts], last], "n": np.r_[n, none],
        }

    return map_arrow(keyed.select("rid", "text"), rows, names)


def _texts(keyed: DataFrame, rids: DataFrame) -> DataFrame:
    """rid and text of the documents in rids; a text that several rows share comes once for each."""
    return keyed.join(bounded(rids), "rid", "left_semi")


def _shards(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """ah, chunk, chunks, ch, rid, first, n, bytes: the stretches that wanted names, cut out of their texts."""
    asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("ah", "chunk", "chunks", "ch", "first", "last", "n")).alias("asked"))
    schema = "ah long,chunk int,chunks int,ch long,rid long,first int,n long,bytes binary"

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x.split()[0]: [] for x in schema.split(",")}
        for rid, text, asked in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "asked")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for a in asked:
                for k in ("ah", "chunk", "chunks", "ch", "first", "n"):
                    out[k].append(a[k])
                out["rid"].append(rid)
                out["bytes"].append(raw[a["first"] : a["last"] + span])
        return out

    return map_arrow(texts.dropDuplicates(["rid"]).join(asked, "rid").select("rid", "text", "asked"), rows, schema)


def _within_shards(stretches: DataFrame, span: int) -> DataFrame:
    """rid, from, to: bytes repeated in a shard; ah, range, run, digests, rids, starts: digests of the windows that are to be compared with the anchor's other shards.

    An anchor has as many ranges of digests as shards, so that a range has about as many windows as a shard.
    """
    target = pa.schema([("ah", pa.int64()), ("rid", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("range", pa.int32()), ("run", pa.int64()), ("digests", pa.binary()), ("rids", pa.binary()), ("starts", pa.binary())])
    spread = stretches.repartition(max(partitions(stretches), 12), "ah", "chunk").sortWithinPartitions("ah", "chunk", "ch")

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        flags, numbers = repeated_windows([r[7] for r in rows], span)
        runs: dict[tuple[int, int], list] = {}
        for row, flag, number in zip(rows, flags, numbers, strict=True):
            ah, chunk, chunks, _, rid, first, n, _ = row
            if n == 1:
                edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]))
                for a, b in edge.reshape(-1, 2).tolist():
                    yield None, rid, first + a, first + b - 1 + span, None, None, None, None, None
            if chunks > 1:  # what other shards have of this anchor isn't known here
                runs.setdefault((ah, chunk, chunks), []).append((row, number))
        for (ah, chunk, chunks), own in runs.items():
            made: dict[int, bytes] = {}  # digests of the different windows, by their numbers
            digests, rids, starts = [], [], []
            for (_, _, _, _, rid, first, n, raw), number in own:
                for i, x in enumerate(number.tolist()):
                    d = made.get(x)
                    if d is None:
                        d = made[x] = xxhash.xxh3_128_digest(raw[i : i + span], ah & 0xFFFFFFFF)
                    digests.append(d)
                rids.append(np.full(len(number), rid if n == 1 else 0))
                starts.append(first + np.arange(len(number)) if n == 1 else np.full(len(number), -1))
            digest, rid, start = np.array(digests, "S16"), np.concatenate(rids).astype(np.int64), np.concatenate(starts).astype(np.int32)
            order = np.argsort(digest, kind="stable")
            digest, rid, start = digest[order], rid[order], start[order]
            lead = digest.view(np.uint8).reshape(-1, 16)[:, :4].astype(np.int64) @ (1 << np.array([24, 16, 8, 0]))
            cut = np.searchsorted(lead * chunks >> 32, np.arange(chunks + 1)).tolist()
            for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if a < b:
                    yield ah, None, None, None, r, chunk, digest[a:b].tobytes(), rid[a:b].tobytes(), start[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_BYTES and row[:2] != held[-1][:2]:
                    yield packed(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield packed(held)
        trim()

    def packed(held: list[tuple]) -> pa.RecordBatch:
        made = list(shard(held))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)] if made else [pa.array([], type=f.type) for f in target], schema=target)

    return spread.mapInArrow(run, "ah long, rid long, `from` int, `to` int, range int, run long, digests binary, rids binary, starts binary")


def _across_shards(runs: DataFrame, span: int) -> DataFrame:
    """rid, from, to: windows that several shards of an anchor have.

    The shards' sorted runs of a range are merged, and each run's windows are found in the merged run, and in their own, by
    binary search: those that are there more often than here are another shard's as well.
    """

    def merge(table: pa.Table) -> Iterator[dict]:
        runs = [np.frombuffer(x, "S16") for x in table.column("digests").to_pylist()]
        rid, start = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("rids", np.int64), ("starts", np.int32)))
        merged = np.sort(np.concatenate(runs), kind="stable")
        times = lambda there, own: np.searchsorted(there, own, "right") - np.searchsorted(there, own, "left")
        hit = np.concatenate([times(merged, own) > times(own, own) for own in runs]) & (start >= 0)
        if hit.any():
            order = np.lexsort((start[hit], rid[hit]))
            rid, start = rid[hit][order], start[hit][order]
            begins = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + span)])  # what they cover together
            yield {"rid": rid[begins], "from": start[begins], "to": start[np.r_[begins[1:], len(rid)] - 1] + span}

    return grouped(runs, ["ah", "range"], merge, "rid long,from int,to int")


def marks(docs: DataFrame, salt: int, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The documents with their key (doc_id, text, rid), and staged rid, marks: bytes of each affected document that repeat."""
    keyed = _keyed(docs, id_col, text_col, salt)
    found = stage(_occurrences(keyed, span), "anchors")
    place = ["rid", F.col("first").alias("from"), (F.col("last") + span).alias("to")]
    settled, found = found.filter("n = 0").select(*place), found.filter("n > 0")
    shared = stage(found.groupBy("ah").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("ah"), "shared-anchors")
    found = stage(found.join(shared, "ah"), "shared-occurrences")
    kinds = stage(found.groupBy("ah", "ch", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "first", "last")).alias("one")), "stretches")
    whole = found.filter("n = 1").join(kinds.filter("n > 1").select("ah", "ch", "c2"), ["ah", "ch", "c2"]).select(*place)
    # anchors with different stretches, one copy of each; those with very many are dealt over shards
    mixed = kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("ah", F.ceil(F.col("kinds") / STRETCHES).cast("int").alias("chunks"))
    wanted = kinds.join(stage(mixed, "mixed-anchors"), "ah").select("ah", F.pmod(F.xxhash64("ch", "c2"), F.col("chunks")).cast("int").alias("chunk"), "chunks", "ch", "one.*", "n")
    wanted = stage(wanted, "wanted")
    rids = stage(wanted.select("rid").distinct(), "wanted-documents")
    out = stage(_within_shards(_shards(_texts(keyed, rids), wanted, span), span), "shards")
    inside = out.filter("range is null").select("rid", "from", "to")
    across = _across_shards(out.filter("range is not null").select("ah", "range", "run", "digests", "rids", "starts"), span)
    every = settled.union(whole).union(inside).union(across).groupBy("rid").agg(F.collect_set(F.struct("from", "to")).alias("marks"))
    return keyed, stage(every, "marks")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per input row.

    A null text counts as empty; texts shorter than span lose nothing.  Fully repeated rows repeat each other.  Null
    and repeated ids stay as they are.
    """
    keyed, marked = marks(docs, _salt(docs, id_col, text_col), id_col=id_col, text_col=text_col, span=span)
    names = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string"

    def rows(batch: pa.RecordBatch) -> dict:
        out = []
        for i, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            runs = covered([(m["from"], m["to"]) for m in found or []], len(raw))
            out.append((i, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
        return dict(zip((x.split()[0] for x in names.split(",")), zip(*out, strict=True), strict=True))

    touched, rest = _split(keyed, marked)
    empty = F.lit(0).cast("long")
    clean = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), empty.alias("n_removed"), empty.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return map_arrow(touched.select("doc_id", "text", "marks"), rows, names).union(clean)


def _split(keyed: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with marks, and those without; only the texts of the former are shuffled where the marks' ids can be broadcast."""
    rids = marked.select("rid")
    ids = bounded(rids)
    return keyed.join(ids, "rid", "left_semi").join(marked, "rid"), keyed.join(ids, "rid", "left_anti")


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """docs with repeated bytes taken out of the texts; a character that loses a byte goes whole.  Null texts stay null."""
    salt = _salt(docs, id_col, text_col)
    _, marked = marks(docs, salt, id_col=id_col, text_col=text_col, span=span)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = []
            for text, found in zip(batch.column("__kinloom_text").to_pylist(), batch.column("__kinloom_marks").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs = covered([(m["from"], m["to"]) for m in found], len(raw))
                texts.append(_kept(raw, runs).decode("utf-8", "ignore"))
            at = batch.schema.names.index("__kinloom_text")
            yield batch.set_column(at, "__kinloom_text", pa.array(texts, pa.string())).drop_columns(["__kinloom_marks"])

    known = marked.select(F.col("rid").alias("__kinloom_rid"), F.col("marks").alias("__kinloom_marks"))
    named = docs.withColumn("__kinloom_rid", _rid(id_col, text_col, salt)).withColumnRenamed(text_col, "__kinloom_text")
    rids = known.select("__kinloom_rid")
    ids = bounded(rids)
    rest = named.join(ids, "__kinloom_rid", "left_anti").drop("__kinloom_rid")
    touched = named.join(ids, "__kinloom_rid", "left_semi").join(known, "__kinloom_rid").drop("__kinloom_rid")
    cut = touched.mapInArrow(rows, rest.schema)
    return cut.union(rest).withColumnRenamed("__kinloom_text", text_col).select(*[F.col(f"`{c}`") for c in docs.columns])
