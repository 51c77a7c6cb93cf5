"""Ranked lexical search by block-max pruning.

Documents are tokenised once to a forward index: a document's terms that any query has, with their frequencies.  Sorted
by doc_id and cut into ranges of BLOCK documents, it makes blocks, which also hold for each term the most that it adds
to the score of any of the block's documents.  A query's bound for a block is the sum of those maxima over its terms.

A search takes three steps.  Bounds alone (the columns of the maxima) tell each query's FIRST best blocks; they are
scored, and the tenth best score there is a threshold that the query's results can't fall below.  Then every task goes over
its blocks: for each query they are sorted by bound, and scored until a bound drops below the threshold, which rises with
what the task finds.  What is left of each task, ten rows a query at most, is ranked.  Equal scores go to smaller ids, so blocks whose
bound equals the threshold are scored as well; nothing that belongs in a result is left out.

Queries go to tasks in groups of about GROUP terms, which are counted first; larger sets of queries take more groups, each
with an index of its terms.  Scores are sums of whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.base import arrow_schema, map_arrow, partitions, release, small_batches, stage, trim

#: Documents of a block; blocks of a query that are scored for its first threshold.
BLOCK, FIRST = 64, 8
#: Terms of the queries of a group, in which each query counts as QUERY terms more.
GROUP, QUERY = 50_000, 50
#: Blocks that a task holds at a time, and bytes of their contributions laid out.
HELD, HELD_BYTES = 128, 64 << 20

#: What isn't part of a term, as ASCII, becomes a space; A-Z are lower-cased; bytes from 0x80 are as they are.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, repeats included, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_TERMS).split()


def query_terms(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term (binary): the different terms of all rows of an item."""

    def run(batch: pa.RecordBatch) -> dict:
        each = [sorted(set(terms(t))) for t in batch.column("text").to_pylist()]
        item = np.repeat(np.arange(len(each)), [len(x) for x in each])
        return {"item": batch.column("item").take(pa.array(item)), "term": [t for x in each for t in x]}

    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "item long,term binary").distinct()


def query_groups(found: DataFrame, most: int) -> Iterator[list]:
    """Rows (item, terms) of query_terms in groups of about `most` terms, dealt by a hash of the item and read one after another."""
    n_terms, n_items = found.agg(F.count(F.lit(1)), F.count_distinct("item")).first()
    groups = -(-(n_terms + QUERY * n_items) // most)
    for group in range(groups):
        yield found.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).groupBy("item").agg(F.collect_list("term").alias("terms")).orderBy("item").collect()


def forward(docs: DataFrame, vocabulary: list[bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (all terms), terms (numbers in the vocabulary, ascending), tfs; one row per input row."""
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batch: pa.RecordBatch) -> dict:
        n, at, tf = [], [], []
        for text in batch.column("text").to_pylist():
            words = terms(text)
            n.append(len(words))
            known = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
            which, times = np.unique(known[known >= 0], return_counts=True)
            at.append(which)
            tf.append(times.astype(np.int32))
        return {"doc_id": batch.column("doc_id"), "n": n, "terms": at, "tfs": tf}

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return map_arrow(rows, run, "doc_id long,n long,terms array<int>,tfs array<int>")


def weight(docs: int, df: int) -> int:
    """A term's weight, from the number of documents that have any term, and of those that have this one."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def contributions(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms of weights w add to the scores of documents of length norm m."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


BLOCKS = "block long,ids array<long>,norms array<long>,sizes array<int>,terms array<int>,tfs array<int>,max_terms array<int>,max_scores array<long>"
#: A null doc_id is the last.
NO_ID = (1 << 63) - 1


def blocks(index: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks of the documents of a forward index that have a term of the vocabulary, in the order of doc_id.

    The index is a written table with row, which tells rows of one doc_id apart, so that a task gets a part of them only.
    """
    target = arrow_schema(BLOCKS)

    def block(number: int, rows: list) -> pa.RecordBatch:
        ids, ns, at, tfs = zip(*rows, strict=True)
        sizes, norms = np.array([len(x) for x in at], np.int32), np.array([10 + 90 * n * n_docs // n_terms for n in ns], np.int64)
        flat, tf = np.concatenate(at), np.concatenate(tfs)
        which, to = np.unique(flat, return_inverse=True)
        most = np.zeros(len(which), np.int64)
        np.maximum.at(most, to, contributions(weights[flat], tf.astype(np.int64), np.repeat(norms, sizes)))
        made = [number, list(ids), norms, sizes, flat, tf, which.astype(np.int32), most]
        return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(made, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        number, rows = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            lists = [(c.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in (batch.column("terms"), batch.column("tfs"))]
            for i, (d, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                rows.append((NO_ID if d is None else d, n, *(flat[b[i] : b[i + 1]] for flat, b in lists)))
                if len(rows) == BLOCK:
                    yield block(number, rows)
                    number, rows = number + 1, []
        if rows:
            yield block(number, rows)
        trim()

    small_batches(index.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = index.filter(F.size("terms") > 0).repartitionByRange(partitions(index), *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "n", "terms", "tfs").mapInArrow(run, BLOCKS)


class Queries:
    """The queries of a group as numbers of terms in the vocabulary."""

    def __init__(self, each: list[np.ndarray], vocabulary: int):
        self.each, self.vocabulary = each, vocabulary

    def bounds(self, max_terms: list[np.ndarray], max_scores: list[np.ndarray]) -> np.ndarray:
        """(query, block): the sum of the block's maxima over the query's terms."""
        columns, table = self._table(np.repeat(np.arange(len(max_terms)), [len(x) for x in max_terms]), np.concatenate(max_terms), np.concatenate(max_scores), len(max_terms))
        return np.stack([table[columns[q]].sum(axis=0) for q in self.each])

    def _table(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A column's number for each term of the vocabulary (0, of zeros, where there is none), and values by column and row."""
        present = np.unique(at)
        columns = np.zeros(self.vocabulary, np.int32)
        columns[present] = np.arange(1, len(present) + 1)
        table = np.zeros((len(present) + 1, n), np.int64)
        table[columns[at], rows] = values
        return columns, table


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    c = batch.column(name)
    flat, ends = c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1])


class Best:
    """The k best (score, id) of each query, and the least score that still counts."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.scores = [np.zeros(0, np.int64) for _ in least]
        self.ids = [np.zeros(0, np.int64) for _ in least]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        counts = scores >= self.least[q]
        if counts.any():
            s, d = np.r_[self.scores[q], scores[counts]], np.r_[self.ids[q], ids[counts]]
            first = np.lexsort((d, -s))[: self.k]
            self.scores[q], self.ids[q] = s[first], d[first]
            if len(first) == self.k:
                self.least[q] = max(self.least[q], self.scores[q][-1])


class Block:
    """A block of the forward index, its contributions laid out by term once a query asks for them."""

    def __init__(self, queries: Queries, weights: np.ndarray, ids, norms, sizes, at, tfs):
        self.queries, self.weights, self.parts, self.ids, self.made = queries, weights, (norms, sizes, at, tfs), ids, None

    def scores(self, q: int) -> np.ndarray:
        if self.made is None:
            norms, sizes, at, tfs = self.parts
            rows = np.repeat(np.arange(len(self.ids)), sizes)
            self.made = self.queries._table(rows, at, contributions(self.weights[at], tfs.astype(np.int64), norms[rows]), len(self.ids))
        columns, table = self.made
        return table[columns[self.queries.each[q]]].sum(axis=0)


def _read(batch: pa.RecordBatch, queries: Queries, weights: np.ndarray) -> list[Block]:
    return [Block(queries, weights, *x) for x in zip(*(_lists(batch, n) for n in ("ids", "norms", "sizes", "terms", "tfs")), strict=True)]


FOUND = "query int,score long,doc_id long"


def _found(best: Best) -> pa.RecordBatch:
    sizes = [len(x) for x in best.ids]
    columns = [np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate(best.scores), np.concatenate(best.ids)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema(FOUND), strict=True)], schema=arrow_schema(FOUND))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of as many blocks as are held at a time."""
    for batch in batches:
        weigh = np.cumsum(batch.column("max_terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * BLOCK * 8)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(weigh, (weigh[at - 1] if at else 0) + HELD_BYTES, "right"))
            end = min(max(end, at + 1), at + HELD)
            yield batch.slice(at, end - at)
            at = end


def first_blocks(made: DataFrame, queries: Queries, first: int) -> DataFrame:
    """block, query for the blocks of greatest bound of each query; reads the maxima alone."""
    schema = arrow_schema("query int,bound long,block long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        top = Best(first, np.ones(len(queries.each), np.int64))
        for batch in _slices(batches):
            bounds, number = queries.bounds(_lists(batch, "max_terms"), _lists(batch, "max_scores")), batch.column("block").to_numpy()
            for q in range(len(queries.each)):
                top.add(q, bounds[q], number)
        yield pa.RecordBatch.from_arrays(_found(top).columns, schema=schema)

    bounds = made.select("block", "max_terms", "max_scores").mapInArrow(run, "query int,bound long,block long")
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    return bounds.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= first).select("block", "query")


def thresholds(made: DataFrame, queries: Queries, weights: np.ndarray, *, k: int, first: int) -> np.ndarray:
    """For each query the k-th best score within its first blocks (1 if they have fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        best = Best(k, np.ones(len(queries.each), np.int64))
        for batch in batches:
            for block, asked in zip(_read(batch, queries, weights), _lists(batch, "queries"), strict=True):
                for q in asked.tolist():
                    best.add(q, block.scores(q), block.ids)
        yield _found(best)

    # A few rows for each query of a group.
    asked = F.broadcast(first_blocks(made, queries, first).groupBy("block").agg(F.collect_list("query").alias("queries")))
    scored = made.join(asked, "block").select("ids", "norms", "sizes", "terms", "tfs", "queries").mapInArrow(run, FOUND)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    least = np.ones(len(queries.each), np.int64)
    for r in scored.withColumn("at", place).filter(F.col("at") == k).collect():  # a row for each query of a group
        least[r["query"]] = r["score"]
    return least


def search_blocks(made: DataFrame, queries: Queries, weights: np.ndarray, least: np.ndarray, *, k: int) -> DataFrame:
    """query, score, doc_id: up to k rows of each query and task, among which are the k best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        best = Best(k, least)
        for batch in _slices(batches):
            held = _read(batch, queries, weights)
            bounds = queries.bounds(_lists(batch, "max_terms"), _lists(batch, "max_scores"))
            order = np.argsort(-bounds, axis=1, kind="stable")
            for q in np.nonzero(bounds.max(axis=1) >= best.least)[0].tolist():
                for b in order[q].tolist():
                    if bounds[q, b] < best.least[q]:
                        break
                    best.add(q, held[b].scores(q), held[b].ids)
        yield _found(best)
        trim()

    return made.select("ids", "norms", "sizes", "terms", "tfs", "max_terms", "max_scores").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", group: int = GROUP, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0, equal scores by ascending doc_id.

    Null texts have no terms; items without terms, or without a document that has any, give no row.  Rows of one item_id
    are one item with all their terms, and rows without item_id are one as well.  Every row of docs is a document: rows with
    one doc_id are ranked each for itself, rows without doc_id after others of their score.  Empty tables give no row.
    Other columns are not read.
    """
    spark, out = docs.sparkSession, None
    asked = stage(query_terms(items, item_col=item_col, text_col=text_col), "query-terms")
    for found in query_groups(asked, group):
        vocabulary = sorted({bytes(t) for r in found for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        queries = Queries([np.array(sorted(place[bytes(t)] for t in r["terms"]), np.int32) for r in found], len(vocabulary))
        index = stage(forward(docs, vocabulary, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "forward")
        n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term of a group
            weights[r["term"]] = weight(n_docs, r["df"])
        made = stage(blocks(index, weights, n_docs, n_terms), "blocks")
        least = thresholds(made, queries, weights, k=k, first=first)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(found)], "query int, item_id long")
        ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        top = search_blocks(made, queries, weights, least, k=k).withColumn("rank", ranked).filter(F.col("rank") <= k)
        rows = top.join(F.broadcast(names), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")  # names: of a group
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


#: The same in SQL.
SEARCH_SQL = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, big_n),
c AS (SELECT q.item_id, d.doc_id, f.r, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * d.n * s.big_n) // s.big_l))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
