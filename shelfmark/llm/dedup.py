"""Near-duplicate detection with DartMinHash sketches and banded joining.

A text is the weighted set of its shingles (runs of ``words`` lower-cased words, weighted by how often they occur; a
shorter text is one shingle). Two texts are linked when the weighted Jaccard similarity of their sets is at least
``threshold``; classes are the connected components of the links.

1. Texts with equal sets collapse to the one with the least id, so copies are never paired with each other.
2. Sketches of the others are cut into bands; texts that agree in a band share a bucket.
3. In each bucket the most central member, that with the most company over all its buckets, is compared with all others
   (a star, linear in the bucket) by the exact similarity of the texts.
4. Members of different components around one centre are compared further, in pairs of blocks of members, where the
   triangle inequality of the Jaccard distance and the sizes of the sets leave a link possible, again by exact
   similarity. No bucket is cut or skipped, and no pairs but the links found are given out.

Only the search is approximate: with 32 bands of 5 coordinates a pair at the threshold is missed with a probability of
3e-6. Step 4 leaves out pairs whose sketches agree in less than the threshold by six standard deviations.

Ids are numbers. Defined cases: null texts and texts without words are alone in their class; rows with a null id are alone and have a
null class; rows that repeat an id are one document (its text must be the same; if it is not, one of them counts); an
empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import darts
from shelfmark.llm.common import append, pieces, saved, texts
from shelfmark.llm.graph import components

BATCH = 1 << 16  # darts and shingles handled at once


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    block: int = 512

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def shingles(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    tokens = (text or "").lower().encode("utf-8", "replace").split()
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(crc32, tokens), np.uint32, len(tokens)).astype(np.uint64)
    h += np.fromiter(map(len, tokens), np.uint64, len(tokens)) << np.uint64(32)
    width = min(words, len(h))
    code = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        code = darts.mix(code) * darts.ODD + h[i : len(h) - width + 1 + i]
    return np.unique(darts.mix(code + np.uint64(width)), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of :func:`shingles`."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


SKETCH = [("size", T.LongType()), ("print1", T.LongType()), ("print2", T.LongType()), ("sketch", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]


def _sketcher(s: Settings):
    def make():
        def run(piece):
            sets = [shingles(t, s.words) for t in texts(piece, "text")]
            size = np.array([c.sum() for _, c in sets], np.int64)
            print1, print2 = (np.array([int((darts.mix(h + np.uint64(salt)) * c.astype(np.uint64)).sum()) if len(h) else 0 for h, c in sets], np.uint64).view(np.int64) for salt in (1, 2))
            found = np.zeros((len(sets), s.coordinates), np.uint64)
            order, start = np.argsort(size, kind="stable"), 0
            while start < len(order):  # sets of like size together: they need as many throws
                stop, work = start, 0
                while stop < len(order) and (stop == start or work < BATCH):
                    work += len(sets[order[stop]][0]) + 7 * s.coordinates
                    stop += 1
                part = order[start:stop]
                elements = np.concatenate([sets[i][0] for i in part])
                weights = np.concatenate([sets[i][1] for i in part]).astype(np.float64)
                owner = np.repeat(np.arange(len(part)), [len(sets[i][0]) for i in part])
                found[part] = darts.sketches(elements, weights, owner, len(part), s.coordinates)
                start = stop
            key = np.broadcast_to(np.arange(s.bands, dtype=np.uint64), (len(sets), s.bands)).copy()
            for i in range(s.rows):
                key = darts.mix(key * darts.ODD + found[:, i :: s.rows])
            small = (found >> np.uint64(20)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, s.bands, dtype=np.int32)), pa.array(key.ravel().view(np.int64)))
            return [pa.array(size), pa.array(print1), pa.array(print2), pa.array([row.tobytes() for row in small], pa.binary()), lists]

        return run

    return make


def sketch(docs: DataFrame, s: Settings, doc: str, text: str) -> DataFrame:
    """id, size, two fingerprints of the set, one byte per coordinate of the sketch, bucket numbers."""
    rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    return append(rows, [T.StructField(n, t) for n, t in SKETCH], _sketcher(s), "text", ["id"])


def _compare(pairs: DataFrame, s: Settings) -> DataFrame:
    """a, b, similarity. ``pairs`` has a, b and their texts ta, tb; texts met again soon are cut into shingles once."""
    kept = ["a", "b"]
    schema = T.StructType([*pairs.select(*kept).schema.fields, T.StructField("similarity", T.DoubleType())])

    def run(batches):
        cache: OrderedDict = OrderedDict()

        def of(key, text):
            if key not in cache:
                cache[key] = shingles(text, s.words)
                if len(cache) > 64:
                    cache.popitem(last=False)
            cache.move_to_end(key)
            return cache[key]

        for batch in batches:
            for piece in pieces(batch, "tb"):
                columns = [texts(piece, c) for c in ("a", "b", "ta", "tb")]
                values = [similarity(of(a, ta), of(b, tb)) for a, b, ta, tb in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(values, pa.float64())], names=schema.names)

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, schema)


def _block_linker(s: Settings):
    """Links between different components among the members of two blocks around one centre.

    A pair is compared only if the triangle inequality, the sizes and the sketches leave a link possible, the most alike
    sketches first, and only while its two sides are in different components: at most one link per merge is given.
    """
    far = 1 - s.threshold
    least = s.threshold - 6 * np.sqrt(s.threshold * (1 - s.threshold) / s.coordinates)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        ids, labels, own = frame["id"].tolist(), frame["label"].to_numpy(), frame["own"].to_numpy()
        d, size, text = frame["d"].to_numpy(), frame["size"].to_numpy(), frame["text"].tolist()
        marks = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
        across = frame["low"].iloc[0] != frame["high"].iloc[0]
        found = []
        for i in range(len(frame) - 1):
            rest = slice(i + 1, None)
            ok = (labels[rest] != labels[i]) & (np.abs(d[rest] - d[i]) <= far + 1e-9)
            ok &= np.minimum(size[rest], size[i]) >= s.threshold * np.maximum(size[rest], size[i]) - 1e-9
            if across:  # pairs within a block belong to that block's own group
                ok &= own[rest] != own[i]
            at = np.flatnonzero(ok) + i + 1
            alike = (marks[at] == marks[i]).mean(axis=1)
            found += [(-v, i, j) for v, j in zip(alike.tolist(), at.tolist(), strict=True) if v >= least]
        parent = {x: x for x in labels.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets, out = {}, []
        for _, i, j in sorted(found):
            x, y = root(labels[i]), root(labels[j])
            if x != y:
                one, two = (sets[k] if k in sets else sets.setdefault(k, shingles(text[k], s.words)) for k in (i, j))
                value = similarity(one, two)
                if value >= s.threshold:
                    parent[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[j], value))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return run


def _with_texts(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The second text is joined first: of the two joins the last leaves the pairs in the order of ``a``."""
    a = bodies.select(F.col("id").alias("_a"), F.col("text").alias("ta"))
    b = bodies.select(F.col("id").alias("_b"), F.col("text").alias("tb"))
    return pairs.join(b, F.col("b") == F.col("_b")).join(a, F.col("a") == F.col("_a"))


def links(sketches: DataFrame, docs: DataFrame, s: Settings, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between texts with different sets, and the copies: id, of (the representative)."""
    own = sketches.filter(F.col("id").isNotNull() & (F.col("size") > 0))
    same = ["size", "print1", "print2"]
    first = saved(own.groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "representatives")
    copied = first.filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same], "rep")
    match = (F.col("size") == F.col("_size")) & (F.col("print1") == F.col("_print1")) & (F.col("print2") == F.col("_print2"))
    copies = own.select("id", *same).join(copied, match).filter("id <> rep").select("id", F.col("rep").alias("of")).distinct()
    copies = saved(copies, "copies")
    reps = own.join(copies.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti").dropDuplicates(["id"])
    reps = saved(reps.select("id", "size", "sketch", "bands"), "reps")

    members = reps.select("id", F.explode("bands").alias("bucket"))
    shared = saved(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = saved(members.join(shared, "bucket"), "members")
    company = saved(members.groupBy("id").agg(F.sum("n").alias("company")), "company")
    centre = members.join(company, "id").groupBy("bucket").agg(F.max(F.struct(F.col("company"), -F.col("id"))).alias("m"))
    centre = saved(centre.select("bucket", (-F.col("m.col2")).alias("centre")), "centres")
    stars = members.join(centre, "bucket").filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = saved(stars, "stars")

    wanted = company.select(F.col("id").alias("_id"))
    bodies = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(wanted, F.col("id") == F.col("_id"), "left_semi")
    bodies = saved(bodies.dropDuplicates(["id"]), "bodies")
    stars = saved(_compare(_with_texts(stars, bodies), s), "star_similarity")
    near = stars.filter(F.col("similarity") >= s.threshold)
    labels = components(near).withColumnRenamed("id", "_id")

    # step 4: around one centre, members of different components
    spot = stars.join(labels, F.col("b") == F.col("_id"), "left").select(
        F.col("a").alias("centre"), F.col("b").alias("id"), F.coalesce("label", "b").alias("label"), (1 - F.col("similarity")).alias("d")
    )
    mixed = spot.groupBy("centre").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.filter("low <> high")
    centres = spot.join(saved(mixed.select(F.col("centre").alias("_centre"), "n"), "mixed"), F.col("centre") == F.col("_centre"))
    centres = centres.join(reps.select(F.col("id").alias("_id"), "size", "sketch"), F.col("id") == F.col("_id")).drop("_id", "_centre")
    centres = saved(centres, "spots")
    # blocks of about block members; each pair of blocks of a centre is one group
    count = F.ceil(F.col("n") / F.lit(s.block)).cast("int")
    block = F.pmod(F.xxhash64("id"), count).cast("int")
    others = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(block, j).alias("low"), F.greatest(block, j).alias("high")))
    spread = centres.withColumn("own", block).select("*", F.inline(others)).drop("n")
    spread = spread.join(bodies.select(F.col("id").alias("_id"), "text"), F.col("id") == F.col("_id")).drop("_id")
    more = spread.groupBy("centre", "low", "high").applyInPandas(_block_linker(s), near.schema)
    return saved(near.unionAll(more), "links"), copies


def classes(docs: DataFrame, s: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of the class), one row per id that is not alone in its class and not the least."""
    sketches = saved(sketch(docs, s, doc, text), "sketches")
    found, copies = links(sketches, docs, s, doc, text)
    labels = saved(components(found), "classes").withColumnRenamed("id", "_id")
    of_copies = copies.join(labels, F.col("of") == F.col("_id"), "left").select("id", F.coalesce("label", "of").alias("label"))
    joined = labels.select(F.col("_id").alias("id"), "label").unionAll(of_copies)
    return joined.filter("id <> label").select(F.col("id").alias("doc_id"), F.col("label").alias("class_id"))


def near_duplicates(docs: DataFrame, s: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id for every row; documents without near copy are their own class."""
    found = saved(classes(docs, s, doc, text), "found").withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(doc).alias("doc_id"))
    return rows.join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, s: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns, whatever their names; it is the one with the least id.

    Rows whose id has several texts, is null, or is no whole number are told apart by a hash of id and text (from 2^62 on,
    so that other ids win): only rows whose texts are in one class collapse, and equal rows to one."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).alias("id"), F.col(text).alias("text"))
    made = F.shiftrightunsigned(F.xxhash64("id", "text"), 2) + F.lit(1 << 62)
    print_ = F.xxhash64("text")
    repeated = rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(print_).alias("low"), F.max(print_).alias("high"))
    repeated = saved(repeated.filter("n > 1").select(F.col("id").alias("_id"), (F.col("low") != F.col("high")).alias("_made")), "repeated")
    if not isinstance(docs.schema[doc].dataType, T.IntegralType):
        keyed = rows.select("row", "text", F.lit(True).alias("again"), made.alias("key"))
    elif repeated.isEmpty() and rows.filter("id is null").isEmpty():
        keyed = rows.select("row", "text", F.lit(False).alias("again"), F.col("id").cast("long").alias("key"))
    else:
        own = F.when(F.col("_made"), made).otherwise(F.col("id").cast("long"))
        known = rows.filter("id is not null").join(repeated, F.col("id") == F.col("_id"), "left")
        keyed = known.select("row", "text", F.col("_id").isNotNull().alias("again"), own.alias("key"))
        keyed = keyed.unionByName(rows.filter("id is null").select("row", "text", F.lit(True).alias("again"), made.alias("key")))
    gone = saved(classes(keyed, s, "key", "text"), "gone").select(F.col("doc_id").alias("_key"))
    kept = keyed.join(gone, F.col("key") == F.col("_key"), "left_anti")
    # rows that are equal in id and text; most tables have none
    once = kept.filter("again").dropDuplicates(["key"])
    return kept.filter(~F.col("again")).unionAll(once).select("row.*")
