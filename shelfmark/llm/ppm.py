"""Language-model scoring by prediction by partial matching.

The text is coded as its lower-cased words with one space between them and an end mark, byte by byte. A trie of byte
contexts up to ``order`` is counted over the training corpus. A byte is predicted in the longest context that the trie
has; if it was not seen there, an escape is paid (method C: as many escapes as distinct bytes) and the next shorter
context predicts it with the bytes already ruled out excluded; the last resort is uniform over the bytes left. Bytes
seen in a context are also seen in its suffixes, so what is ruled out after an escape is just the longer context's own
set, and each node can hold the sums it needs: scoring is table lookups over whole batches.

The trie covers the whole training corpus and grows with it. Its common contexts, those counted at least some power of
two times, at most ``max_entries`` entries for each length above two (shorter ones are bounded by nature), are sent to
the tasks. A byte whose context is not among them is left open there: the distinct open contexts meet the counts of all
contexts with the same last bytes in a shuffle, are scored by the whole trie, and are joined back. So ``max_entries``
bounds memory and has no influence on a score. The base score is an add-0.1 unigram model of words: words counted at least
some power of two times, ``max_words`` at most, are looked up in the tasks, all others by a shuffled join.

Defined cases: null texts are empty (the end mark alone); repeated rows are counted and scored each; an empty corpus
gives a uniform model; an empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import append, pieces, saved, utf8

END = b""  # the word that ends a text
BREAK = 10  # the byte that ends a text; no word holds it
FLUSH_WORDS, FLUSH_GRAMS = 1 << 19, 1 << 21
SLICE = 1 << 17  # positions scored at once: their arrays stay in cache
SHORT = 2  # contexts up to this length are held whole by every task: 2^24 entries at most
BUCKET_GRAMS = 1 << 18  # average number of grams scored together; the contexts with the same 3 last bytes have 2^24 at most


@dataclass(frozen=True)
class Settings:
    order: int = 5
    max_entries: int = 1 << 20
    max_words: int = 1 << 18
    addend: float = 0.1


def words_of(text: bytes) -> list[bytes]:
    """ASCII-lower-cased words; bytes.split() splits at exactly 0x09-0x0D and 0x20."""
    return text.lower().split()


def coded(batch: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch, positions to predict, and the number of them per text. Each text follows ``order`` end marks."""
    lead = bytes([BREAK]) * order
    parts = [lead + b" ".join(w) + b"\n" for w in batch]
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    wanted = np.ones(len(data), bool)
    starts = np.cumsum(sizes) - sizes
    wanted[(starts[:, None] + np.arange(order)[None, :]).ravel()] = False
    return data, np.flatnonzero(wanted), sizes - order


def gram_codes(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The context and byte at each position as one number, the byte lowest."""
    total = data[order:].astype(np.uint64)
    for i in range(1, order + 1):
        total |= data[order - i : len(data) - i].astype(np.uint64) << np.uint64(8 * i)
    return total[at - order]


# -- hash tables of numbers ------------------------------------------------------------------------------------------
class Table:
    """Number -> position in the arrays it was built with, or -1; open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.at[place] < 0
            self.at[place[free]] = left[free]
            done = self.at[place] == left
            self.keys[place[done]] = keys[left[done]]
            left, place = left[~done], (place[~done] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        found = self.at[place]
        open_ = np.flatnonzero((found >= 0) & (self.keys[place] != keys))
        place = place[open_]
        while len(open_):
            place = (place + 1) & ((1 << self.bits) - 1)
            here = self.at[place]
            found[open_] = here
            more = (here >= 0) & (self.keys[place] != keys[open_])
            open_, place = open_[more], place[more]
        return found


# -- the model -------------------------------------------------------------------------------------------------------
@dataclass
class Level:
    """One context length. Per entry: log10 of its share with escapes counted, and of its count. Per node: log10 of
    its escape, and, for the next shorter context with this node's bytes excluded, log10 of the sum and of the escape."""

    entries: Table
    share: np.ndarray
    count: np.ndarray
    nodes: Table
    escape: np.ndarray
    rest: np.ndarray
    rest_escape: np.ndarray


@dataclass
class Sums:
    """What the next longer contexts are built on: counts of the entries, sums and kinds of the nodes."""

    counts: np.ndarray
    entries: Table
    total: np.ndarray
    kinds: np.ndarray
    nodes: Table


@dataclass
class Model:
    order: int
    levels: dict[int, Level] = field(default_factory=dict)
    missing: float = -math.log10(256)  # log10 of one of the bytes that were never seen
    whole: bool = True  # False: contexts of full length may be missing although the corpus has them


def build(
    order: int, tables: dict[int, tuple[np.ndarray, np.ndarray]], base: tuple[Model, Sums] | None = None
) -> tuple[Model, Sums | None]:
    """The model of the sorted gram numbers and counts of each length, and the sums of its longest one.

    A length may lack rare contexts, but every context's suffixes are there. With ``base``, a model of the shorter
    lengths and its sums, ``tables`` holds the longer ones."""
    model, below = Model(order), None
    if base is not None:
        model, below = Model(order, dict(base[0].levels), base[0].missing), base[1]
    elif len(tables[0][0]):
        model.missing = -math.log10(256 - len(tables[0][0])) if len(tables[0][0]) < 256 else 0.0
    for n in sorted(tables):
        grams, counts = tables[n]
        if not len(grams):
            break
        context = grams >> np.uint64(8)
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        total, kinds = np.add.reduceat(counts, starts), np.diff(np.append(starts, len(grams)))
        node = np.cumsum(np.append(0, context[1:] != context[:-1]))
        rest = rest_escape = np.zeros(len(starts))
        if n:
            same = below.counts[below.entries.find(grams & np.uint64((1 << (8 * n)) - 1))]
            parent = below.nodes.find(context[starts] & np.uint64((1 << (8 * (n - 1))) - 1))
            free = below.kinds[parent] - kinds
            rest = below.total[parent] - np.add.reduceat(same, starts) + free
            rest_escape = np.where(free > 0, np.log10(np.maximum(free, 1)) - np.log10(np.maximum(rest, 1)), 0.0)
            rest = np.log10(np.maximum(rest, 1))
        entries, nodes = Table(grams), Table(context[starts])
        share = np.log10(counts) - np.log10((total + kinds)[node])
        escape = np.log10(kinds) - np.log10(total + kinds)
        model.levels[n] = Level(entries, share, np.log10(counts), nodes, escape, rest, rest_escape)
        below = Sums(counts, entries, total, kinds, nodes)
    return model, below


def score_codes(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the byte of each gram number after its context, and where it is open: there it is 0."""
    out, left = np.zeros(len(codes)), np.arange(len(codes))
    escaped = np.zeros(len(codes), bool)
    rest, rest_escape = np.zeros(len(codes)), np.zeros(len(codes))
    open_ = np.arange(0)
    for n in range(model.order, -1, -1):
        level = model.levels.get(n)
        if level is None:
            if n == model.order and not model.whole:
                return out, left
            continue
        code = codes[left] & np.uint64((1 << (8 * (n + 1))) - 1)
        entry = level.entries.find(code)
        hit = entry >= 0
        done, e, was = left[hit], entry[hit], escaped[hit]
        out[done] += np.where(was, level.count[e] - rest[hit], level.share[e])
        left, code, escaped, rest, rest_escape = left[~hit], code[~hit], escaped[~hit], rest[~hit], rest_escape[~hit]
        node = level.nodes.find(code >> np.uint64(8))
        known = node >= 0
        k, b = np.flatnonzero(known), node[known]
        out[left[k]] += np.where(escaped[k], rest_escape[k], level.escape[b])
        escaped[k], rest[k], rest_escape[k] = True, level.rest[b], level.rest_escape[b]
        if n == model.order and not model.whole:
            open_ = left[~known]
            left, escaped, rest, rest_escape = left[known], escaped[known], rest[known], rest_escape[known]
    out[left] += model.missing
    return out, open_


# -- counting --------------------------------------------------------------------------------------------------------
COUNTS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(grams)).astype(np.int64)


def count_corpus(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(word or gram, n): words with the end word, and bytes with ``order`` bytes of context. Summed per task, then by key."""
    if not 0 <= order <= 6:
        raise ValueError("the order is 0 to 6")

    def emit(words: Counter, grams: list):
        if words:
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64())], names=COUNTS.names)
        if grams:
            codes, counts = _merged(grams)
            for i in range(0, len(codes), 1 << 16):
                part = codes[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part.astype(np.int64)), pa.array(counts[i : i + (1 << 16)])], names=COUNTS.names)

    def run(batches):
        words, grams = Counter(), []
        for batch in batches:
            for piece in pieces(batch, text):
                lists = [words_of(t) for t in utf8(piece, text)]
                for w in lists:
                    words.update(w)
                words[END] += len(lists)
                data, at, _ = coded(lists, order)
                grams.append(np.unique(gram_codes(data, at, order), return_counts=True))
                if len(grams) > 1 and sum(len(g[0]) for g in grams) > FLUSH_GRAMS:
                    grams = [_merged(grams)]
                if len(words) > FLUSH_WORDS or (grams and len(grams[0][0]) > FLUSH_GRAMS):
                    yield from emit(words, grams)
                    words, grams = Counter(), []
        yield from emit(words, grams)

    partial = docs.select(text).mapInArrow(run, COUNTS)
    return partial.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _floor(groups: DataFrame, amount: Column, limit: int) -> int:
    """The least power of two such that the groups counted at least so often amount to at most ``limit``."""
    sizes = groups.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.sum(amount).alias("k")).collect()  # 64 rows at most
    kept, power = 0, 64
    for r in sorted(sizes, key=lambda r: -r["p"]):
        if kept + r["k"] > limit:
            break
        kept, power = kept + r["k"], r["p"]
    else:
        power = 0
    return 1 << power if power < 63 else (1 << 63) - 1


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("gram", "n").toArrow()
    grams, counts = table["gram"].to_numpy().astype(np.uint64), table["n"].to_numpy().astype(np.float64)
    order = np.argsort(grams)
    return grams[order], counts[order]


def fit_trie(counts: DataFrame, settings: Settings) -> tuple[Model, tuple[Model, Sums | None]]:
    """The trie of common contexts from the counts of :func:`count_corpus`, and the whole one of the short lengths."""
    grams = counts.filter(F.col("gram").isNotNull()).select("gram", "n")
    tables, least = {}, 1
    for n in range(settings.order + 1):
        own = grams
        if n < settings.order:
            own = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (n + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        if n > SHORT:
            contexts = own.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
            contexts = saved(contexts, f"contexts-{n}")
            # a context may only be sent where its suffixes are
            least = max(least, _floor(contexts, F.col("k"), settings.max_entries))
            if least > 1:
                kept = contexts.filter(F.col("n") >= least).select("context")
                own = own.join(kept, F.shiftright("gram", 8) == F.col("context"), "left_semi")
        tables[n] = _arrays(own)
    short = build(min(SHORT, settings.order), {n: t for n, t in tables.items() if n <= SHORT})
    common, _ = build(settings.order, {n: t for n, t in tables.items() if n > SHORT}, short)
    common.whole = least == 1
    return common, short


def score_open(codes: DataFrame, counts: DataFrame, n_grams: int, short: tuple[Model, Sums], order: int) -> DataFrame:
    """``code, logp`` of distinct gram numbers ``code`` by the whole trie.

    A context's suffixes and the counts of all of them end in the same bytes, so the contexts with the same last bytes
    are scored together and apart from all others."""
    buckets = F.lit(max(1, n_grams // BUCKET_GRAMS))
    bucket = lambda c: F.pmod(F.xxhash64(F.shiftright(c, 8).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))), buckets)
    sent = codes.sparkSession.sparkContext.broadcast(short)  # lengths up to SHORT

    def run(grams: pa.Table, wanted: pa.Table) -> pa.Table:
        wanted = wanted["code"].to_numpy()
        gram, n = grams["gram"].to_numpy().astype(np.uint64), grams["n"].to_numpy()
        tables = {}
        for length in range(SHORT + 1, order + 1):
            own, total = _merged([(gram & np.uint64((1 << (8 * (length + 1))) - 1), n)]) if len(gram) else (gram, n)
            tables[length] = own, total.astype(np.float64)
        model, _ = build(order, tables, sent.value)
        values = [score_codes(model, wanted[i : i + SLICE].astype(np.uint64))[0] for i in range(0, len(wanted), SLICE)]
        return pa.table({"code": wanted, "logp": np.concatenate([np.zeros(0), *values])})

    grams = counts.filter(F.col("gram").isNotNull()).select(bucket(F.col("gram")).alias("bucket"), "gram", "n")
    asked = codes.select(bucket(F.col("code")).alias("bucket"), "code")
    return grams.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, "code bigint, logp double")


def score(docs: DataFrame, train: Column, doc: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, learned from the rows where ``train`` (over the id) holds."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    counts = saved(count_corpus(rows.filter(train), "text", settings.order), "counts")
    words = counts.filter(F.col("word").isNotNull()).select("word", "n")
    totals = counts.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.count("word"), F.count("gram")).first()
    all_, kinds = totals[0] or 0, totals[1]
    share = all_ + settings.addend * (kinds + 1)
    least = _floor(words, F.lit(1), settings.max_words)
    common = words.filter(F.col("n") >= least).toArrow()  # max_words at most
    table = dict(zip(common["word"].to_pylist(), common["n"].to_numpy().tolist(), strict=True))
    model, short = fit_trie(counts, settings)
    sent = docs.sparkSession.sparkContext.broadcast((model, table))  # bounded by max_entries and max_words

    def make():
        model, table = sent.value
        logs = {w: math.log10((n + settings.addend) / share) for w, n in table.items()}

        def run(piece):
            lists = [words_of(t) for t in utf8(piece, "text")]
            data, at, sizes = coded(lists, model.order)
            codes = gram_codes(data, at, model.order)
            parts = [score_codes(model, codes[i : i + SLICE]) for i in range(0, len(codes), SLICE)]
            starts = np.cumsum(sizes) - sizes
            scores = np.add.reduceat(np.concatenate([p[0] for p in parts]), starts)
            left = np.concatenate([p[1] + i * SLICE for i, p in enumerate(parts)])
            row = (np.searchsorted(starts, left, side="right") - 1).astype(np.uint64)
            order = np.lexsort((codes[left], row))
            row, code = row[order], codes[left][order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.arange(0)
            times = np.diff(np.append(first, len(row))).astype(np.int32)
            ends = pa.array(np.searchsorted(row[first], np.arange(len(lists) + 1)), pa.int32())
            open_codes = pa.ListArray.from_arrays(ends, pa.array(code[first].astype(np.int64)))
            open_times = pa.ListArray.from_arrays(ends, pa.array(times))
            n_tokens, n_common, base, rare = [], [], [], []
            for w in lists:
                w.append(END)
                found = list(map(logs.get, w))
                others = Counter(x for x, f in zip(w, found, strict=True) if f is None) if None in found else {}
                n_tokens.append(len(w))
                n_common.append(len(w) - sum(others.values()))
                base.append(math.fsum(f for f in found if f is not None))
                rare.append([{"word": x, "k": k} for x, k in others.items()])
            kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))
            return [pa.array(n_tokens, pa.int64()), pa.array(n_common, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, kind), open_codes, open_times]

        return run

    rare_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.LongType())]))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("_common", T.LongType()), T.StructField("_base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("_rare", rare_type)]
    fields += [T.StructField("_codes", T.ArrayType(T.LongType())), T.StructField("_times", T.ArrayType(T.IntegerType()))]
    scored = append(rows, fields, make, "text", ["doc_id"])
    scored = saved(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.inline("_rare")).join(words.filter(F.col("n") < least), "word", "left")
    n = F.coalesce("n", F.lit(0))
    log = F.log10((n + F.lit(settings.addend)) / F.lit(float(share if share else 1)))
    rare = rare.groupBy("_row").agg(F.sum(log * F.col("k")).alias("_more"), F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("_known"))
    zero = F.lit(0)
    if not model.whole:
        left = scored.select("_row", F.inline(F.arrays_zip(F.col("_codes").alias("code"), F.col("_times").alias("k"))))
        values = saved(score_open(left.select("code").distinct(), counts, totals[2], short, settings.order), "open")
        left = left.join(values, "code").groupBy("_row").agg(F.sum(F.col("logp") * F.col("k")).alias("_open"))
        scored = scored.drop("_codes", "_times").join(left, "_row", "left")
        scored = scored.withColumn("score", F.col("score") + F.coalesce("_open", F.lit(0.0)))
    return scored.join(rare, "_row", "left").select(
        "doc_id", "n_tokens", (F.col("_common") + F.coalesce("_known", zero)).cast("long").alias("n_known"),
        F.lit(all_).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score",
    )
