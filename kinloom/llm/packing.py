"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenised and cut into pieces of at most one sequence.  Only the count of pieces of each length goes to
the driver (at most as many rows as a sequence has tokens), where best-fit decreasing runs over counts: lengths from the
longest on, each into the open sequences with the least room that is enough.  Sequences with equal room are one range of
numbers, so that a thousand pieces of one length take one step.  The plan gives ranks within a length their slots;
pieces are ranked within their length and take the slots by a join.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.base import kept, map_arrow, partitions, stage

LIMIT, END_ID = 4096, 1
#: Words, and parts of words, whose ids a worker keeps for good, and those it has besides until it forgets them.
KEPT, SPARE = 150_000, 150_000
#: Parts that are encoded in one call, as one text.
TOGETHER = 1000

#: The vocabulary's own split of a text into parts (a fixed value of its file), for letters up to U+024F.
_PARTS = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
_PLAIN = bytes([*range(9, 14), *range(32, 127)])
_FAR = re.compile("[^\t-\r -~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\u012f\u0131-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01ef\u01f4-\u024f]|<\\|")


class Encoder:
    """Ids of texts as the tokenizer at path gives them, with a memory of words' parts.

    The tokenizer splits a text into runs of letters, single digits and runs of other signs, and encodes every part by
    itself; so a part's ids don't depend on what stands around it.  Texts with characters for which that split isn't
    certain go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Parts are lower-cased and split already: what is left of the tokenizer is its model over their bytes.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # Of each known word: where its ids begin in the run of all ids, and how many there are.
        self.known: dict[str, int] = {}
        self.begins, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, run together, and where each part's end.  Many are encoded as one text; every part ends in an id that ends a word."""
        texts = [" ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(parts):
            return ids, cut
        each = [self._whole(p) for p in parts]
        return np.concatenate(each), np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Words whose ids, run together, end at ends become known."""
        begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.begins = np.concatenate((self.begins, begins + len(self.ids)))
        self.sizes = np.concatenate((self.sizes, (ends - begins).astype(np.int32)))
        self.ids = np.concatenate((self.ids, ids))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words, run together, and where each word's end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        place = np.repeat(self.begins[at] - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.ids[place], ends

    def _places(self, words: list[str]) -> np.ndarray:
        """The numbers of words; those that aren't known are learnt."""
        known = self.known
        new = [w for w in words if w not in known]
        split = {w: ps for w in new if not w.isalpha() and len(ps := _PARTS.findall(w)) != 1}
        parts = list(set(new).difference(split).union(*split.values()).difference(known))
        if parts:
            self._add(parts, *self._encode_parts(parts))
        if split:
            counts = np.cumsum(np.fromiter(map(len, split.values()), np.int64, len(split)))
            ids, ends = self._gather(np.fromiter((known[p] for ps in split.values() for p in ps), np.int64, int(counts[-1])))
            self._add(list(split), ids, np.concatenate((np.zeros(1, np.int64), ends))[counts])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _forget(self) -> None:
        """Only the KEPT words that were known first stay."""
        self.known = dict(islice(self.known.items(), KEPT))
        self.begins, self.sizes = self.begins[:KEPT], self.sizes[:KEPT]
        self.ids = self.ids[: int(self.begins[-1] + self.sizes[-1])].copy()

    def encode(self, texts: list[str | None], block: int = 1024) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text; a null text counts as empty."""
        out: list[np.ndarray] = []
        for i in range(0, len(texts), block):
            own = [t or "" for t in texts[i : i + block]]
            plain = [_is_plain(t) for t in own]
            words = pc.ascii_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(own, plain, strict=True)], pa.large_string()))
            coded = words.flatten().dictionary_encode()
            places = self._places(coded.dictionary.to_pylist())
            ids, ends = self._gather(places[coded.indices.to_numpy()])
            cut = np.concatenate((np.zeros(1, np.int64), ends))[words.offsets.to_numpy()].tolist()
            out += [ids[a:b] if p else self._whole(t) for t, p, a, b in zip(own, plain, cut, cut[1:], strict=False)]
            if len(self.known) > KEPT + SPARE:
                self._forget()
        return out


def _is_plain(text: str) -> bool:
    """The split of words is certain: characters that _FAR doesn't name, in composed form."""
    if text.isascii():
        return not text.encode().translate(None, _PLAIN) and "<|" not in text
    return not _FAR.search(text) and unicodedata.is_normalized("NFC", text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


kept(encoder.cache_clear)


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a text's ids and end_id, cut into runs of at most limit."""
    names = "doc_id long,piece int,start long,length long,ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    def rows(batch: pa.RecordBatch) -> dict:
        out = []
        for i, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(batch.column("text").to_pylist()), strict=True):
            raw = ids.tobytes() + end
            for k, at in enumerate(range(0, len(raw), 4 * limit)):
                part = raw[at : at + 4 * limit]
                out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
        return dict(zip((x.split()[0] for x in names.split(",")), zip(*out, strict=True), strict=True))

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, names, keeps=True)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for the pieces of each length: (length, first rank, end rank, first sequence, pieces a sequence, offset).

    The piece of rank r takes sequence ``first sequence + (r - first rank) // pieces a sequence``, at ``offset`` plus
    its place among them times length.  Best-fit decreasing: a piece goes where least room is left over, and opens a
    sequence if it fits none.

    The plan is bounded whatever the counts are: a length splits at most two ranges of sequences, and a range that is
    filled loses more than half of its room, so there are at most 2 * limit * log2(limit) + limit slots (102,400).
    """
    rooms: list[int] = []  # sorted room sizes of open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    out, fresh = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, (first, n) = limit, (fresh, -(-left // (limit // length)))
                fresh += n
            else:
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, limit - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last sequence gets what is left
                out.append((length, rank, rank + left, first + full, left, limit - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                left = 0
            else:
                put(room, first + full, n - full)
    return out


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A null or empty text is one piece, the end id alone.  Rows with equal or null ids are documents of their own; which
    of the pieces of one length takes which slot follows id and piece, and is open among rows equal in both.
    An empty table gives an empty result.
    """
    cut = stage(pieces(docs, path, id_col=id_col, text_col=text_col, limit=limit, end_id=end_id), "pieces")
    # Ranks within a length without sorting a length in one task: parts of a length are counted, then ranked each.
    parts = max(64, partitions(docs))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "length-parts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    slots = docs.sparkSession.createDataFrame(plan(histogram, limit), "length long, rank_from long, rank_to long, first long, each long, base long")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(counts.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan's rows are bounded by limit, not by documents (see plan).
    placed = ranked.join(F.broadcast(slots), "length").filter("rank >= rank_from and rank < rank_to")
    place = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + place % F.col("each") * F.col("length")).cast("long").alias("offset")
    )
