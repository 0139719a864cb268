"""Secret scan with corpus-wide ownership frequency.

Each text is scanned for base kinds (assignments, access keys, long hex strings) and for generic random-looking strings.
Hashes of all candidate values are counted by distinct repositories and distinct owners over the whole corpus. A value
seen with few owners is specific to them and live; a value seen with many owners is a copied example. The base kinds say
by their pattern that a value is a secret, so ownership alone decides there, at any length and with or without digits;
generic strings are candidates only if they look random, and become spans (kind ``owned``) only when they are live.

Defined cases: a null text is empty; a null owner or repository is one of its own; positions are code points, the end
exclusive; repeated rows are scanned each and count once for their repository; an empty table gives no rows; columns
other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import append, saved, texts

# Fixed patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")

GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BITS = 3.0  # least entropy per character of a random-looking generic string
SPANS = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("start", T.LongType()), ("rank", T.IntegerType()), ("end", T.LongType()), ("hash", T.StringType()))])
)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def random_looking(value: str) -> bool:
    return entropy(value) >= BITS and any(c.isdigit() for c in value)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, value) of every candidate, by start and kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e, _ in found)
    at, reach = 0, -1  # base spans that begin before the generic string's end, and how far they reach
    for m in GENERIC.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][1]), at + 1
        if reach <= m.start() and any(c.isalpha() for c in m[0]) and random_looking(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _scanner():
    def scan(piece):
        spans, counts, digests = [], [[], [], []], []
        for text in texts(piece, "text"):
            found = find(text or "")
            base = [f for f in found if f[1] < 3]
            for k in range(3):
                counts[k].append(sum(f[1] == k for f in base))
            listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
            digests.append(hashlib.sha256(listed.encode()).hexdigest())
            spans.append([{"start": s, "rank": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for s, k, e, v in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("hash", pa.string())]))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, kind)]

    return scan


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over all candidates. Each step sums before it shuffles, so a hot value is never gathered."""
    rows = found.select("owner", "repo", F.explode("spans.hash").alias("hash"))
    repos = rows.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def name(*parts: Column) -> Column:
    """One text for the parts of an owner's or repository's name; null differs from every text."""
    return F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])


def scan_secrets(
    docs: DataFrame, owner: Column, repo: Column, doc: str = "doc_id", text: str = "text", copied_owners: int = 3, keep: tuple[Column, ...] = ()
) -> DataFrame:
    """doc_id, base counts, base_sha256, spans: start, end, kind, value's hash, n_owners, n_repos, copied, live.

    ``copied``: at least ``copied_owners`` owners have the value. ``live``: fewer do. ``keep`` names further columns of each
    row to carry along.
    """
    longs = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    fields = [*longs, T.StructField("base_sha256", T.StringType()), T.StructField("spans", SPANS)]
    rows = docs.select(F.col(doc).alias("doc_id"), name(owner).alias("owner"), name(repo).alias("repo"), *keep, F.col(text).alias("text"))
    found = append(rows, fields, _scanner, "text", keep=[c for c in rows.columns if c != "text"])
    found = saved(found.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    counts = saved(ownership(found), "ownership")
    spans = found.select("_row", F.explode("spans").alias("s")).select("_row", "s.*")
    # both sides are plain scans, so adaptive execution can split a hot value
    spans = spans.join(counts, "hash")
    copied = F.col("n_owners") >= copied_owners
    spans = spans.withColumn("copied", copied).withColumn("live", ~copied)
    spans = spans.filter((F.col("rank") < 3) | F.col("live"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    entry = F.struct("start", "rank", "end", kind.alias("kind"), "hash", "n_owners", "n_repos", "copied", "live")
    lists = spans.groupBy("_row").agg(F.sort_array(F.collect_list(entry)).alias("_spans"))
    empty = F.array().cast(lists.schema["_spans"].dataType)
    return found.drop("spans").join(lists, "_row", "left").select(
        *[c for c in found.columns if c not in ("_row", "spans", "owner", "repo")], F.coalesce("_spans", empty).alias("spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _masker(mark: str):
    def make():
        def mask(piece):
            out = []
            for text, spans in zip(texts(piece, "text"), piece.column("_mask").to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans or []:
                    if s["end"] > at:
                        parts += [text[at : max(at, s["start"])], mark]
                        at = s["end"]
                out.append(text if not parts else "".join(parts) + text[at:])
            return [pa.array(out, pa.string())]

        return mask

    return make


def mask_live(docs: DataFrame, owner: Column, repo: Column, doc: str = "doc_id", text: str = "text", mark: str = "[secret]", copied_owners: int = 3) -> DataFrame:
    """``docs`` with every live span replaced by ``mark``; copied examples stay. All columns are kept, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).alias("id"), F.col(text).alias("text"), owner.alias("owner"), repo.alias("repo"))
    key = F.xxhash64("text").alias("key")
    found = scan_secrets(rows, F.col("owner"), F.col("repo"), "id", "text", copied_owners, keep=(key,))
    live = F.filter("spans", lambda s: s["live"])
    masks = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_mask"))
    # equal rows have equal spans: one of them is enough
    masks = saved(masks.filter(F.size("_mask") > 0).groupBy("_id", "_key").agg(F.first("_mask").alias("_mask")), "masks")
    joined = rows.select("row", "id", "text", key).join(masks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    masked = append(joined.select("row", "text", "_mask"), [T.StructField("masked", T.StringType())], _masker(mark), "text", ["row", "_mask"])
    return masked.select(*[F.col("masked").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
