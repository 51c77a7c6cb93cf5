"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint of 64 bits is cut into six blocks.  Two fingerprints that differ in at most three bits agree on at least
three blocks, so they meet under one of the twenty choices of three blocks.  Fingerprints are brought together by the
bits of a choice, and every pair that meets is verified by its Hamming distance.  Of the links found among the fingerprints of one
bucket only a spanning forest is handed on, so that a large group of copies costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.base import arrow_schema, bounded, map_arrow, partitions, release, stage
from kinloom.llm.components import components

BITS, DISTANCE, BLOCKS, SHINGLE, SEED = 64, 3, 6, 3, 42
#: Fingerprints of one bucket that are compared in one go; larger buckets are dealt into cells of two chunks.
CHUNK = 4096


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text's word shingles (A-Z lower-cased; repeats count; fewer words than a shingle: all of them; none: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return hashed(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - SHINGLE + 1
    spans = zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    h = np.fromiter([hashed(flat[i:j], SEED) for i, j in spans], np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; also key, a long, if key_col names one."""
    keys = [F.col(key_col).alias("key")] if key_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys)

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)} | ({"key": batch.column("key")} if key_col else {})

    return map_arrow(rows, run, "doc_id long,fp long" + (",key long" if key_col else ""))


def _choices() -> list[int]:
    """A mask for each choice of BLOCKS - DISTANCE blocks."""
    edge = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(BLOCKS)]
    return [sum(c) for c in combinations(block, BLOCKS - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the distinct fingerprints that are within DISTANCE of each other."""
    n, root = len(fps), np.arange(len(fps))
    for i in range(0, n, 512):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + 512, None] ^ fps[None, i:]) <= DISTANCE)
        apart = a < b
        a, b = a[apart] + i, b[apart] + i
        while len(a):  # hook the larger root under the smaller, until both ends of every link have one root
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    other = np.flatnonzero(root != np.arange(n))
    return fps[other], fps[root[other]]


def links(fps: DataFrame, *, fp_col: str = "fp", chunk: int = CHUNK) -> DataFrame:
    """a, b: links among distinct fingerprints that join all those within DISTANCE of each other, directly or through others."""
    masks = [_signed(m) for m in _choices()]
    found = fps.select(F.col(fp_col).alias("fp")).filter("fp is not null").distinct()
    keyed = found.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits"))
    keyed = keyed.withColumn("key", F.xxhash64("choice", "bits")).select("key", "fp")
    # Buckets of more than a chunk are few: every such bucket has more than `chunk` rows.
    large = keyed.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    large = stage(large, "large-buckets")
    if large.isEmpty():
        celled = keyed.withColumn("cell", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        other = F.sequence(F.lit(0), F.col("chunks") - 1)
        cells = F.transform(other, lambda j: F.least(j, own) * F.col("chunks") + F.greatest(j, own))
        celled = keyed.join(large, "key", "left").select("key", "fp", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"))
    celled = celled.repartition(partitions(fps), "key", "cell").sortWithinPartitions("key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            rest = np.concatenate((rest, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "cell", "fp")], axis=1)))
            last = np.flatnonzero((rest[:, :2] != rest[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the batch's last bucket may go on
            yield from linked(rest[:cut])
            rest = rest[cut:]
        yield from linked(rest)

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        ends = np.r_[starts[1:], len(rows)]
        more = ends - starts > 1
        a, b = [], []
        for i, j in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            x, y = _forest(rows[i:j, 2].copy().view(np.uint64))
            a.append(x)
            b.append(y)
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=arrow_schema("a long,b long"))

    return celled.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable through links), one row per input row.

    Null and empty texts and those of white space alone have fingerprint zero, and are linked like others.  Rows of equal
    text are one component; rows with a null id stay, and a component of only such rows has a null component_id.
    """
    fps = stage(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    roots = components(links(fps))
    rooted = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = stage(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stage(rooted.join(least, "root").select("fp", "component_id"), "fp-components")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(by_fp, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def one_row_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of docs for each component, rows without an id among them.

    It has the component's smallest id, or none if no row has one; of several such rows the one with the smallest key
    stays.  A row's key is a 64-bit hash of all its columns, so rows of equal keys are equal rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__kinloom_key", F.xxhash64(*columns, *[c.isNull() for c in columns]))
    fps = stage(fingerprints(keyed, id_col=id_col, text_col=text_col, key_col="__kinloom_key"), "fingerprints")
    roots = components(links(fps))
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    rooted = stage(rooted, "roots")
    stays = rooted.groupBy("root").agg(F.min("first")["key"].alias("stays"))
    by_fp = stage(rooted.join(stays, "root").select("fp", "stays"), "fp-components")
    judged = fps.join(by_fp, "fp").groupBy("key", "stays").count().filter("key <> stays or count > 1")
    judged = stage(judged.select(F.col("key").alias("__kinloom_key"), (F.col("key") != F.col("stays")).alias("goes")), "near-copies")
    left = keyed.join(bounded(judged.filter("goes").select("__kinloom_key")), "__kinloom_key", "left_anti")
    several = judged.filter("not goes").select("__kinloom_key")
    if not several.isEmpty():
        several = bounded(several)
        once = left.join(several, "__kinloom_key", "left_semi").dropDuplicates(["__kinloom_key"])
        left = left.join(several, "__kinloom_key", "left_anti").unionByName(once)
    return left.select(*columns)
