"""Secret scans: strong patterns by themselves, and parts of one credential that are linked where they stand together.

Strong (base) findings are assignments to a secret's name, access identifiers and long hexadecimal runs.  A credential is often spread
over parts that say little alone: a short password, an identifier, an endpoint.  Parts found in a text are rows; the
reaches of a text's identifiers are merged to scopes, intervals that don't overlap; parts join the scope they start in by
(document, stretch of text) and their place, so that each part meets one scope at most and no two parts are ever paired.
A scope with an identifier and a secret, one of them strong or with an endpoint beside them, is a credential, and its weak
parts are reported.  Anywhere else weak parts are not.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.base import map_arrow, stage

#: Kinds in the order in which spans of one start are told; the first three are strong.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
STRONG = 3
ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT = range(len(KINDS))
#: What a part is of a credential.
IDENTIFIERS, SECRETS = (ACCESS, WEAK_ID), (ASSIGN, HEX, WEAK_SECRET)

LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
ASSIGNED = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS_ID = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
NAMED_ID = re.compile(r"""(?<![a-z0-9])(?:client|account|app|tenant|key|access_?key)_?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}|(?<![a-z0-9])(?:username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
MIXED_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SITE = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+:[0-9]{2,5}(?![0-9])")

#: A text without a match of these has no such finding: RE2 passes over whole batches.
HAS_ASSIGN, HAS_ACCESS, HAS_HEX, HAS_NAMED = r"(?i)(password|passwd|secret|token|api_?key)", "AKIA", r"[0-9a-f]{32}", r"(?i)(_?id|username|login)[\"']?\x20*[:=]"

#: Code points on either side of an identifier that its credential may reach over, and the length of a stretch that the join deals by.
REACH, STRETCH = 400, 4096


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong findings in code points, ordered; the flags leave out what is known to be absent."""
    found = [(m.start(), ASSIGN, m.end()) for m in ASSIGNED.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if assign else []
    if access:
        found += [(m.start(), ACCESS, m.end()) for m in ACCESS_ID.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if hexes:
        found += [(m.start(), HEX, m.end()) for m in HEX_RUN.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(found)


def _mixed(run: str) -> bool:
    """Small and capital letters and digits."""
    return any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run) and any("0" <= c <= "9" for c in run)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak parts, none of which overlaps a strong one; of weak ones that overlap the first by kind stays.

    Identifiers: short access identifiers, and values of names such as client_id.  Secrets: short assignments, hexadecimal
    runs of 16 to 31, runs of 20 or more with small and capital letters and digits.  Endpoints: web addresses, and hosts with a port.
    """
    found = [(m.start(), WEAK_ID, m.end()) for m in ACCESS_ID.finditer(text) if len(m[0]) < LEAST_ACCESS]
    found += [(m.start(), WEAK_ID, m.end()) for m in NAMED_ID.finditer(text)]
    found += [(m.start(), WEAK_SECRET, m.end()) for m in ASSIGNED.finditer(text) if len(m[2]) < LEAST_ASSIGN]
    found += [(m.start(), ENDPOINT, m.end()) for m in SITE.finditer(text)]
    found += [(m.start(), WEAK_SECRET, m.end()) for m in HEX_RUN.finditer(text) if len(m[0]) < LEAST_HEX]
    found += [(m.start(), WEAK_SECRET, m.end()) for m in MIXED_RUN.finditer(text) if _mixed(m[0])]
    order = {WEAK_ID: 0, ENDPOINT: 1, WEAK_SECRET: 2}  # a host or a path may look like a secret
    ranked = [(0, s, e, k) for s, k, e in base] + [(1 + order[k], s, e, k) for s, k, e in found]
    kept: list[tuple[int, int, int]] = []
    reached, open_ = -1, []
    for rank, s, e, k in sorted(ranked, key=lambda x: (x[1], x[0], -x[2])):  # groups of spans that overlap
        if s >= reached and open_:
            kept += _apart(open_)
            open_ = []
        open_.append((rank, s, e, k))
        reached = max(reached, e)
    return sorted(kept + _apart(open_))


def _apart(group: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak spans of a group of overlapping ones, by rank and place, that overlap nothing taken before."""
    if len(group) == 1:
        return [(s, k, e) for rank, s, e, k in group if rank]
    taken: list[tuple[int, int]] = []  # apart from each other, by place
    out = []
    for rank, s, e, k in sorted(group):
        at = bisect_left(taken, (s, e))
        free = (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e)
        if free or rank == 0:
            taken.insert(at, (s, e))
            if rank:
                out.append((s, k, e))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCANNED = "doc_id long,n_assign long,n_access long,n_hex long,base_sha256 string,starts array<long>,kinds array<int>,ends array<long>,part_starts array<long>,part_kinds array<int>,part_ends array<long>"


def _scan(batch: pa.RecordBatch) -> dict:
    texts = batch.column("text")
    has = [pc.match_substring_regex(texts, p).to_pylist() for p in (HAS_ASSIGN, HAS_ACCESS, HAS_HEX, HAS_NAMED)]
    out: dict[str, list] = {x.split()[0]: [] for x in SCANNED.split(",")[1:]}
    for text, assign, access, hexes, named in zip(texts.to_pylist(), *has, strict=True):
        base = base_spans(text, assign, access, hexes) if assign or access or hexes else []
        # Without an identifier there is no scope, and weak parts need not be looked for.
        parts = weak_spans(text, base) if access or named else []
        parts = sorted(parts + base) if any(k in IDENTIFIERS for _, k, _ in (*parts, *base)) else []
        for name, kind in (("n_assign", ASSIGN), ("n_access", ACCESS), ("n_hex", HEX)):
            out[name].append(sum(k == kind for _, k, _ in base))
        out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
        for prefix, spans in (("", base), ("part_", parts)):
            for name, i in (("starts", 0), ("kinds", 1), ("ends", 2)):
                out[prefix + name].append([x[i] for x in spans])
    return {"doc_id": batch.column("doc_id")} | out


def scopes(parts: DataFrame) -> DataFrame:
    """row, scope, low, high: the merged reaches of each row's identifiers; scopes of a row don't overlap."""
    own = Window.partitionBy("row").orderBy("low", "high")
    reach = parts.filter(F.col("kind").isin(*IDENTIFIERS)).select("row", (F.col("start") - REACH).alias("low"), (F.col("end") + REACH).alias("high"))
    before = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = reach.withColumn("begins", F.coalesce(F.col("low") >= before, F.lit(True)).cast("int"))
    numbered = begins.withColumn("scope", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "scope").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def credentials(parts: DataFrame) -> DataFrame:
    """row, start, kind, end of the weak parts (and endpoints) that stand in a scope which makes a credential."""
    stretch = lambda c: F.floor(F.greatest(c, F.lit(0)) / STRETCH)
    where = scopes(parts).withColumn("stretch", F.explode(F.sequence(stretch(F.col("low")), stretch(F.col("high")))))
    inside = (F.col("start") >= F.col("low")) & (F.col("start") < F.col("high"))
    met = parts.withColumn("stretch", stretch(F.col("start"))).join(where, ["row", "stretch"]).filter(inside)
    kind = F.col("kind")
    told_by = {"has_id": kind.isin(*IDENTIFIERS), "has_secret": kind.isin(*SECRETS), "has_strong": kind < STRONG, "has_site": kind == ENDPOINT}
    whole = met.groupBy("row", "scope").agg(*[F.max(c).alias(n) for n, c in told_by.items()]).filter("has_id and has_secret and (has_strong or has_site)")
    return met.join(whole.select("row", "scope"), ["row", "scope"], "left_semi").filter(kind >= STRONG).select("row", "start", "kind", "end")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_linked (spans beside the strong ones), one row per input row.

    Spans are ``kind:start:end`` in code points, by start and kind.  Null and empty texts have none.  Rows with the same
    or no doc_id are scanned each for itself; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The number of a row is written with it, and so stays what it is.
    scanned = stage(map_arrow(rows, _scan, SCANNED).withColumn("row", F.monotonically_increasing_id()), "secrets")
    zipped = F.arrays_zip(F.col("part_starts").alias("start"), F.col("part_kinds").alias("kind"), F.col("part_ends").alias("end"))
    parts = scanned.filter(F.size("part_starts") > 1).select("row", F.inline(zipped))
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    linked = credentials(parts).groupBy("row").agg(F.collect_list(span).alias("linked"))  # of one text
    strong = F.transform(F.arrays_zip(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end")), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    both = F.array_sort(F.concat(strong, F.coalesce("linked", F.array().cast(linked.schema["linked"].dataType))))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(both, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    kept = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    return scanned.join(linked, "row", "left").select(*kept, text.alias("spans"), F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"))
