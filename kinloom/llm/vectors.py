"""Embedding near-duplicates by NN-descent.

Vectors of one label get a first neighbour list from random-hyperplane buckets.  In every round each vector brings its
neighbours and a bounded sample of those that list it together, where one of them is new to it, and pairs among them that are nearer than
a list's last entry enter the list.  Rounds end when they find nothing more near the threshold.

* A list that is full and whose last entry still is a link is saturated: it may lack others.  It is enlarged to twice
  its length, up to ``k_most``.
* What is saturated at ``k_most`` lies in a group of very many.  The links inside such a group are counted exactly, by
  comparing its vectors in blocks of two chunks, without writing pairs out; for links to other groups its vectors get
  further lists, of vectors outside their group alone, which descend in the same way until no groups join any more.
* Entries are proposed in half precision and verified in double precision; those over the threshold are links.
* An audit compares a bounded sample of vectors, most of them with entries near the threshold, with all vectors of their
  labels.  Where recall falls short the search goes on from twice as many buckets; it fails if recall stays low.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.base import arrow_schema, bounded, map_arrow, partitions, release, stage, trim
from kinloom.llm.components import components

THRESHOLD, K, K_MOST, TABLES, LEAF, CELL = 0.98, 10, 20, 8, 64, 512
BLOCK = 1024  # vectors of one group that are compared with as many others in one go
SLACK = 0.002  # what half precision can take from a cosine, at most
CLOSE = 0.1  # rounds go on as long as they find entries that are so much below the threshold, or nearer
AUDITED, AUDITED_BYTES = 4096, 16 << 20  # vectors that an audit compares with all others, at most
RECALL, LEAST_RECALL = 0.99, 0.9  # what the search goes on for, and what it fails below
_log = logging.getLogger(__name__)


def _unit(values: list | None) -> np.ndarray | None:
    """A vector over its length; None if it is null, empty, zero, or has null or non-finite components."""
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _points(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, unit: the unit vector's doubles (null for vectors that link with nothing)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))

    def run(batch: pa.RecordBatch) -> dict:
        units = [None if label is None else _unit(v) for label, v in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True)]
        return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "unit": [None if u is None else (u + 0.0).tobytes() for u in units]}

    return map_arrow(rows, run, "vec_id long,label string,unit binary")


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id and pid of all rows, and the distinct vectors: pid, label, unit, half, times, least.

    Rows are grouped by the vectors themselves.  pid is a hash of them, salted anew in the unlikely case that two
    different vectors share one.
    """
    some = rows.filter("unit is not null").groupBy("label", "unit").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    some = stage(some, "distinct-vectors")
    salt = 0
    while not some.groupBy(F.xxhash64("label", "unit", F.lit(salt))).count().filter("count > 1").isEmpty():
        salt += 1
    pid = F.xxhash64("label", "unit", F.lit(salt))

    def halved(batch: pa.RecordBatch) -> dict:
        return {n: batch.column(n) for n in names} | {"half": [np.frombuffer(x).astype(np.float16).tobytes() for x in batch.column("unit").to_pylist()]}

    names = ["pid", "label", "unit", "times", "least"]
    points = map_arrow(some.select(pid.alias("pid"), "label", "unit", "times", "least"), halved, "pid long,label string,unit binary,times long,least long,half binary")
    return rows.select("vec_id", F.when(F.col("unit").isNotNull(), pid).alias("pid")), stage(points, "points")


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def grouped(df: DataFrame, keys: list[str], rows: Callable[[pa.Table], Iterator[dict]], schema: str, apart: bool = True) -> DataFrame:
    """Rows of one task, sorted by keys, group by group (several whole groups at once if not apart); groups have to be bounded by what makes the keys."""
    names = [x.split()[0] for x in schema.split(",")]
    target = arrow_schema(schema)
    spread = df.repartition(partitions(df), *keys).sortWithinPartitions(*keys)

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([table.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]).tolist() if apart else [0]
        for i, j in zip(starts, [*starts[1:], table.num_rows], strict=True):
            for out in rows(table.slice(i, j - i)):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=target.field(n).type) for n in names], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            key = np.stack([rest.column(k).to_numpy() for k in keys])
            other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            if len(other):  # the last group may go on
                cut = int(other[-1]) + 1
                yield from _together(made(rest.slice(0, cut)), target)
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from _together(made(rest), target)
        trim()

    return spread.mapInArrow(run, schema)


def _together(batches: Iterator[pa.RecordBatch], schema: pa.Schema, least: int = 5000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()


def _cells(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with chunk and chunks: members of keys with more than size rows are dealt into chunks of about size."""
    large = df.groupBy(key).count().filter(F.col("count") > size).select(key, F.ceil(F.col("count") / size).cast("int").alias("chunks"))
    dealt = df.join(large, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("pid", F.col(key)), F.col("chunks")).cast("int"))


def _blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with chunk, chunks and cell: each row once for every chunk of its key, in the cell of the two chunks."""
    dealt = _cells(df, key, size)
    chunks = F.col("chunks").cast("long")
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    return dealt.withColumn("cell", F.explode(F.transform(other, lambda j: F.least(j, F.col("chunk")) * chunks + F.greatest(j, F.col("chunk")))))


def _nearest(table: pa.Table) -> Iterator[dict]:
    """For each member of one cell its nearest others, as many as its list is long (k), if they enter it (are nearer than last).

    With a column saturated only members that are have a list, with a column root only others of another root count.
    """
    apart = "root" in table.column_names
    pid, k, last = (table.column(c).to_numpy() for c in ("pid", "k", "last"))
    n = len(pid)
    if n < 2:
        return
    rows = np.arange(n)
    if "saturated" in table.column_names:
        rows = np.flatnonzero(table.column("saturated").to_numpy(zero_copy_only=False))
    root = table.column("root").to_numpy() if apart else None
    if not len(rows) or apart and (root == root[0]).all():
        return
    v = _matrix(table.column("half"), np.float16).astype(np.float32)
    take = int(min(k[rows].max(), n - 1))
    sims = v[rows] @ v.T
    sims[pid[rows][:, None] == pid[None, :]] = -2
    if apart:
        sims[root[rows][:, None] == root[None, :]] = -2
    best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
    sim = np.take_along_axis(sims, best, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    best, sim = np.take_along_axis(best, order, 1), np.take_along_axis(sim, order, 1)
    keep = (np.arange(take)[None, :] < k[rows][:, None]) & (sim > last[rows][:, None])
    if keep.any():
        i, j = np.nonzero(keep)
        yield {"u": pid[rows][i], "v": pid[best[i, j]], "sim": sim[i, j].astype(np.float64), "k": k[rows][i], "new": np.ones(len(i), np.int32)}


_PROPOSED = "u long,v long,sim double,k int,new int"


def _best(edges: DataFrame, most: int) -> DataFrame:
    """u, k, near: the k best of the proposed neighbours of each u, best first (array of struct<sim, v, new>).

    Proposals are ranked by a window whose limit is also applied before its shuffle, so that a vector that very many
    others list brings few rows a task.
    """
    merged = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("k").alias("k"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    found = merged.withColumn("rank", rank).filter(F.col("rank") <= most).filter("rank <= k")
    return found.groupBy("u").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct("sim", "v", "new")), False).alias("near"))


def _first_lists(points: DataFrame, tables: int, leaf: int, seed: int, most: int) -> DataFrame:
    """Neighbours within buckets of random hyperplanes, as many planes as make buckets of about leaf vectors.

    points: pid, label, half, k, last (the least similarity that enters a list), and root or saturated where they count.
    """
    groups = points.groupBy("label", F.octet_length("half").alias("bytes")).count()
    deep = groups.select(F.col("label").alias("g_label"), "bytes", F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / leaf))).cast("int").alias("bits"))
    also = {c: t for c, t in (("root", "long"), ("saturated", "boolean")) if c in points.columns}
    with_bits = points.join(deep, (F.col("label") == F.col("g_label")) & (F.octet_length("half") == F.col("bytes")))
    with_bits = with_bits.select("pid", "half", "bits", F.xxhash64("label", "bytes").alias("g"), "k", "last", *also)

    def keys(batch: pa.RecordBatch) -> dict:
        bits, g = (batch.column(c).to_numpy() for c in ("bits", "g"))
        raw = batch.column("half").to_pylist()
        n, sizes = len(raw), np.array([len(x) // 2 for x in raw])
        out = np.empty((n, tables), np.int64)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            u = np.frombuffer(b"".join(raw[i] for i in at), np.float16).astype(np.float32).reshape(len(at), d)
            deepest = min(62, int(bits[at].max()))
            for t in range(tables):
                planes = np.random.default_rng([seed, t, d]).standard_normal((d, 62))[:, :deepest].astype(np.float32)
                side = ((u @ planes) > 0).astype(np.int64)
                side[np.arange(deepest)[None, :] >= bits[at][:, None]] = 0
                out[at, t] = side @ (1 << np.arange(deepest, dtype=np.int64)) if deepest else 0
        every = pa.array(np.repeat(np.arange(n), tables))
        return {c: batch.column(c).take(every) for c in ("pid", "half", "k", "last", *also)} | {"g": np.repeat(g, tables), "t": np.tile(np.arange(tables), n), "side": out.ravel()}

    schema = "pid long,half binary,k int,last double" + "".join(f",{c} {t}" for c, t in also.items())
    keyed = map_arrow(with_bits, keys, schema + ",g long,t long,side long")
    keyed = keyed.select("pid", "half", "k", "last", *also, F.xxhash64("g", "t", "side").alias("key"))
    return _best(grouped(_cells(keyed, "key", CELL), ["key", "chunk"], _nearest, _PROPOSED), most)


def _pairs(lists: DataFrame) -> DataFrame:
    """u, v, sim, k, new: the entries of lists, one a row; none of them is new any more."""
    return lists.select("u", "k", F.explode("near").alias("n")).select("u", F.col("n.v").alias("v"), F.col("n.sim").alias("sim"), "k", F.lit(0).alias("new"))


def _last(lists: DataFrame) -> DataFrame:
    """pid, k, last: the least similarity that enters the list of each vector that has one."""
    return lists.select(F.col("u").alias("pid"), "k", F.when(F.size("near") >= F.col("k"), F.element_at("near", -1)["sim"]).otherwise(-1.5).alias("last"))


def _descend(meeting: DataFrame, lists: DataFrame, points: DataFrame, k: int, most: int) -> DataFrame:
    """One round over lists: neighbours, and a sample of about 2 k reverse neighbours, of each vector of meeting meet.

    Where no neighbour is new they have met before.
    """
    forward = meeting.select(F.col("u").alias("w"), F.explode("near").alias("n")).select("w", F.col("n.v").alias("pid"), F.col("n.new").alias("new"))
    listed = forward.groupBy("pid").agg(F.count(F.lit(1)).alias("by"))
    chance = F.pmod(F.xxhash64("w", F.col("pid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    reverse = forward.join(listed, "pid").filter(chance < 2.0 * k / F.col("by")).select(F.col("pid").alias("w"), F.col("w").alias("pid"), "new")
    own = meeting.select(F.col("u").alias("w"), F.col("u").alias("pid"), F.lit(0).alias("new"))
    members = stage(forward.union(reverse).union(own).groupBy("w", "pid").agg(F.max("new").alias("new")), "members-of-lists")
    active = members.filter("new = 1").select("w").distinct()
    also = [c for c in ("root", "saturated") if c in points.columns]
    known = points.select("pid", "half", *also).join(_last(lists), "pid", "left").withColumns({"k": F.coalesce("k", F.lit(k)), "last": F.coalesce("last", F.lit(-1.5))})
    proposed = grouped(members.drop("new").join(active, "w", "left_semi").join(known, "pid"), ["w"], _nearest, _PROPOSED)
    return _best(proposed.union(_pairs(lists)), most)


def _enlarged(lists: DataFrame, least: float, most: int) -> DataFrame:
    """lists in which saturated ones that are shorter than most may be twice as long."""
    full = (F.size("near") >= F.col("k")) & (F.element_at("near", -1)["sim"] >= least)
    return lists.withColumn("k", F.when(full, F.least(F.col("k") * 2, F.lit(most))).otherwise(F.col("k")).cast("int"))


def _state(lists: DataFrame, least: float) -> tuple[int, int, int]:
    """Links in lists, their lengths, and entries that the last round found near the threshold."""
    many = lambda x: F.coalesce(F.sum(F.size(F.filter("near", x))), F.lit(0))
    r = lists.agg(many(lambda n: n["sim"] >= least).alias("links"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), many(lambda n: (n["new"] == 1) & (n["sim"] >= least - CLOSE)).alias("new")).first()
    return r["links"], r["k"], r["new"]


def _settled(lists: DataFrame, points: DataFrame, k: int, most: int, least: float, rounds: int) -> DataFrame:
    """lists after rounds of descent, until one changes no link and no length and finds nothing near the threshold."""
    before = _state(lists, least)
    for _ in range(rounds):
        lists = stage(_descend(lists, lists, points, k, most), "lists")
        now = _state(lists, least)
        if now[0] == before[0] and not now[2]:
            break
        before = now
    return lists


def _grown(lists: DataFrame, points: DataFrame, k: int, most: int, least: float, rounds: int, *, tables: int, leaf: int, seed: int) -> DataFrame:
    """Settled lists of which none is saturated that could be longer.

    What a longer list has room for may be in the buckets alone, as its vector's neighbours know only each other: it is
    filled up from there, and descends again.
    """
    lists = _settled(lists, points, k, most, least, rounds)
    turn = 0
    while True:
        turn += 1
        wide = stage(_enlarged(lists, least, most), "longer-lists")
        more = wide.join(lists.select("u", F.col("k").alias("was")), "u").filter("k > was").select(F.col("u").alias("pid"), F.lit(True).alias("saturated"))
        more = stage(more, "enlarged")
        if more.isEmpty():
            return lists
        start = points.select("pid", "label", "half").join(_last(wide), "pid", "left").withColumns({"k": F.coalesce("k", F.lit(k)), "last": F.coalesce("last", F.lit(-1.5))})
        start = start.join(more, "pid", "left").withColumn("saturated", F.coalesce("saturated", F.lit(False)))
        filled = _first_lists(start, tables, leaf, seed + turn, most)
        lists = stage(_best(_pairs(filled).withColumn("new", F.lit(1)).union(_pairs(wide)), most), "lists")
        lists = _settled(lists, points, k, most, least, rounds)


def _near(lists: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of entries whose similarity is least or more."""
    pairs = _pairs(lists).filter(F.col("sim") >= least)
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _rooted(points: DataFrame, links: DataFrame) -> DataFrame:
    """points with root: the same for all vectors of a component."""
    roots = components(links).withColumnRenamed("node", "pid")
    return stage(points.join(roots, "pid", "left").withColumn("root", F.coalesce("root", "pid")), "members")


def _joined_groups(members: DataFrame, lists: DataFrame, links: DataFrame, least: float, threshold: float, *, k: int, most: int, tables: int, leaf: int, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """members and links after saturated vectors have looked for links outside their components, until no components join.

    Saturated is here whatever list ends with a link, full or not, as its vector may have more.  They look among each other: a
    list that goes on below the threshold has all links of its vector, those with saturated ones among them.
    """
    full = stage(lists.filter(F.element_at("near", -1)["sim"] >= least).select(F.col("u").alias("pid"), F.lit(True).alias("full")), "saturated")
    if full.isEmpty():
        return members.withColumn("saturated", F.lit(False)), links
    flagged = lambda m: stage(m.join(full, "pid", "left").withColumn("saturated", F.coalesce("full", F.lit(False))).drop("full"), "flagged")
    members = flagged(members)
    near = stage(lists.join(full.select(F.col("pid").alias("u")), "u", "left_semi"), "saturated-lists")
    for turn in range(rounds):
        some = members.filter("saturated").select("pid", "label", "unit", "half", "root", "saturated")
        if some.agg(F.min("root") == F.max("root")).first()[0]:
            break
        across = stage(_first_lists(some.withColumns({"k": F.lit(k), "last": F.lit(-1.5)}), tables, leaf, seed + 1 + turn, most), "across")
        before = _state(across, least)
        for _ in range(rounds):
            across = stage(_descend(near.unionByName(across), across, some, k, most), "across")
            now = _state(across, least)
            if now[0] == before[0] and not now[2]:
                break
            before = now
        found = stage(_verified(_near(across, least), some, threshold), "links-across")
        if found.isEmpty():
            break
        links = stage(links.union(found).distinct(), "links")
        members = flagged(_rooted(members.drop("root", "saturated"), links))
    return members, links


def _inside(members: DataFrame, threshold: float) -> DataFrame:
    """pid, n: for each vector the vectors of its component that it links with, compared in blocks of two chunks."""
    celled = _blocks(members.select("root", "pid", "unit", "times"), "root", BLOCK)

    def count(table: pa.Table) -> Iterator[dict]:
        pid, u, chunk, times = table.column("pid").to_numpy(), _matrix(table.column("unit")), table.column("chunk").to_numpy(), table.column("times").to_numpy()
        cell, chunks = table.column("cell")[0].as_py(), table.column("chunks")[0].as_py()
        same, n = cell // chunks == cell % chunks, np.zeros(len(pid), np.int64)
        for i in range(0, len(pid), 256):
            linked = (u[i : i + 256] @ u.T) >= threshold
            linked[np.arange(len(linked)), np.arange(i, i + len(linked))] = False
            if not same:  # what meets within a chunk is counted in the chunk's own cell
                linked &= chunk[i : i + 256, None] != chunk[None, :]
            n[i : i + 256] = linked @ times
        yield {"pid": pid, "n": n}

    return grouped(celled, ["root", "cell"], count, "pid long,n long").groupBy("pid").agg(F.sum("n").alias("n"))


def _counts(members: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """pid, n: the other distinct vectors that each vector links with, weighted by their copies.

    Lists that are not saturated have all links of their vector; components with a saturated one are compared in blocks.
    """
    large = stage(members.filter("saturated").select("root").distinct(), "large-groups")
    blocked = members.join(bounded(large), "root", "left_semi")
    both = links.union(links.select("b", "a")).toDF("pid", "other").distinct()
    copies = members.join(bounded(large), "root", "left_anti").select(F.col("pid").alias("other"), "times")
    listed = both.join(copies, "other").groupBy("pid").agg(F.sum("times").alias("n"))
    return stage(listed.union(_inside(blocked, threshold)), "counts")


def _audit(points: DataFrame, lists: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Recall of links: AUDITED vectors at most, drawn by hash, against all vectors of their labels.

    A quarter is drawn from those with an entry near the threshold, the rest from all.  The lesser of the share of all
    their links that was found, and of the mean share of a vector's links among those drawn from all.
    """
    longest = points.agg(F.max(F.octet_length("unit"))).first()[0]
    most = max(64, min(AUDITED, AUDITED_BYTES // (longest or 8)))
    drawn = lambda df, n: df.orderBy(F.xxhash64("pid", F.lit(5)), "pid").limit(n)
    close = lists.filter(F.element_at("near", 1)["sim"] >= threshold - 0.05).select(F.col("u").alias("pid"))
    pids = drawn(points.select("pid"), most - most // 4).withColumn("any", F.lit(1)).union(drawn(close, most // 4).withColumn("any", F.lit(0))).groupBy("pid").agg(F.max("any").alias("any"))
    sample = points.join(F.broadcast(pids), "pid").join(counts, "pid", "left").select("pid", "label", "unit", "any", F.coalesce("n", F.lit(0)).alias("n")).collect()  # AUDITED rows at most
    if not sample:
        return 1.0
    kinds: dict[tuple[str, int], list] = {}
    for r in sample:
        kinds.setdefault((r["label"], len(r["unit"])), []).append((r["pid"], bytes(r["unit"])))

    def compare(batch: pa.RecordBatch) -> dict:
        label, pid, times = (batch.column(c) for c in ("label", "pid", "times"))
        label, pid, times, unit = label.to_pylist(), pid.to_numpy(), times.to_numpy(), batch.column("unit").to_pylist()
        out: dict[str, list] = {"pid": [], "n": []}
        at: dict[tuple[str, int], list[int]] = {}
        for i, x in enumerate(zip(label, map(len, unit), strict=True)):
            if x in kinds:
                at.setdefault(x, []).append(i)
        for x, rows in at.items():
            asked = np.array([p for p, _ in kinds[x]])
            here = np.frombuffer(b"".join(unit[i] for i in rows)).reshape(len(rows), -1)
            there = np.frombuffer(b"".join(u for _, u in kinds[x])).reshape(len(asked), -1)
            linked = ((there @ here.T) >= threshold) & (asked[:, None] != pid[rows][None, :])
            out["pid"] += asked.tolist()
            out["n"] += (linked @ times[rows]).tolist()
        return out

    true = {r["pid"]: r["n"] for r in map_arrow(points.select("label", "pid", "times", "unit"), compare, "pid long,n long").groupBy("pid").agg(F.sum("n").alias("n")).collect()}
    some = [(min(r["n"], true[r["pid"]]), true[r["pid"]], r["any"]) for r in sample if true.get(r["pid"])]
    shares = [f / t for f, t, drawn_from_all in some if drawn_from_all]
    return min(sum(f for f, _, _ in some) / sum(t for _, t, _ in some) if some else 1.0, sum(shares) / len(shares) if shares else 1.0)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, k: int = K, k_most: int = K_MOST, tables: int = TABLES, leaf: int = LEAF, rounds: int = 6, attempts: int = 5, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per input row.

    Vectors link if their labels are equal and not null, their lengths agree and their cosine is threshold or more.
    Vectors that are null, empty, zero or have null or non-finite components, and those without a label, link with
    nothing and are kept.  Equal vectors of one label link with each other, and are compared once.  component_id is the
    smallest vec_id of the component (of null ids alone: null, and not kept).  Links are verified; that few are missed is
    audited on AUDITED vectors: the search goes on while recall is below RECALL, and RuntimeError says that it is below
    LEAST_RECALL after all attempts.
    """
    rows, points = _distinct(stage(_points(vectors, id_col, vector_col, label_col), "vectors"))
    least, lists, start = threshold - SLACK, None, points.withColumns({"k": F.lit(k), "last": F.lit(-1.5)})
    for attempt in range(attempts):
        first = _first_lists(start, tables << attempt, leaf << attempt, seed + 100 * attempt, k_most)
        lists = stage(first if lists is None else _best(_pairs(first).union(_pairs(lists)), k_most), "lists")
        lists = _grown(lists, points, k, k_most, least, rounds, tables=tables << attempt, leaf=leaf << attempt, seed=seed + 100 * attempt + 50)
        links = stage(_verified(_near(lists, least), points, threshold), "links")
        members = _rooted(points, links)
        members, links = _joined_groups(members, lists, links, least, threshold, k=k, most=k_most, tables=tables << attempt, leaf=leaf << attempt, rounds=rounds, seed=seed + 100 * attempt)
        counts = _counts(members, links, threshold)
        recall = _audit(points, lists, counts, threshold)
        _log.info("recall of links in attempt %d: %.4f", attempt + 1, recall)
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall of links is {recall:.4f} after {attempts} attempts")
    if recall < RECALL:
        _log.warning("recall of links is %.4f after %d attempts", recall, attempts)
    several = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("component_id"))
    several = stage(several.filter("size > 1").select("root", "component_id"), "groups")
    known = members.select("pid", "root", "times", "least").join(bounded(several), "root", "left").join(counts, "pid", "left")
    known = known.select("pid", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    joined = rows.join(known, "pid", "left")
    component = F.when(F.col("pid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _verified(near: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision is threshold or more."""
    one, two = points.select(F.col("pid").alias("a"), F.col("unit").alias("x")), points.select(F.col("pid").alias("b"), F.col("unit").alias("y"))

    def run(batch: pa.RecordBatch) -> dict:
        xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        keep = np.array([float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in zip(xs, ys, strict=True)])
        return {n: batch.column(n).to_numpy()[keep] for n in ("a", "b")}

    return map_arrow(near.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a long,b long")
