"""Removal of passages that repeat across documents, by a logarithmic family of suffix arrays.

Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id; strings never cross documents, and are judged on the input.

1. Sampling. Of each string of ``length`` bytes the run of 24 bytes with the least hash is its anchor, so equal strings have
   equal anchors wherever they are. One position in 14 is an anchor. Anchors that only one document has cannot match; the
   first round finds the others by their hashes, dealt to ranges of hashes.
2. Index. Around each anchor left, the suffixes that it is the anchor of go to the task of its range, in batches of whole
   slices of the corpus. Each batch gets its suffix array (the suffixes in the order of their first ``length`` bytes, equal
   ones with the least id); it becomes the lowest level of the family, and as long as two levels have equal size they
   merge into one of the next size, so a suffix is merged a logarithmic number of times.
3. Scan. The sorted batches are merged against every level; a suffix that a level has with a smaller id is a match. Matches
   go back to their slices, are united per document, and cut from the text.

Inside a slice a string that several documents have is sent once, with the least id; the other documents have their match
at once. A passage that a third of all documents share is thus sent once per slice, not once per document.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; rows with a null id neither lose bytes
nor take any from others; rows that repeat an id are documents of equal rank, so they take nothing from each other;
an empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import saved

ANCHOR = 24  # bytes
CHUNK = 1 << 17
SLICE_BYTES, SLICE_ROWS = 8 << 20, 1 << 15
RANGE_BYTES = 1 << 20  # of text per range of anchors, on average
BATCH = 1 << 16  # suffixes per batch of the index
TURN = 1 << 18  # suffixes of a range in memory at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFF)


@dataclass(frozen=True)
class Plan:
    length: int
    ranges: int
    width: int  # bytes of an anchor's hash that are sent


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each run of ANCHOR bytes: of 8 and 16 bytes by doubling, then of both together."""
    h, w, half = (data.astype(np.uint64) + np.uint64(1)) * _ODD, 1, None
    while w < 16:
        half = h if w == 8 else None
        h = (h[:-w] ^ (h[:-w] >> np.uint64(31))) * _MIX + h[w:]
        w *= 2
    h = (h[:-8] ^ (h[:-8] >> np.uint64(31))) * _MIX + half[16:]
    h ^= h >> np.uint64(32)
    h *= _ODD
    h ^= h >> np.uint64(29)
    return h * _MIX


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, hash, first suffix) of each run of neighbouring suffixes with the same anchor, over all texts;
    a run's last suffix is before the next run's first or the text's last, so the fourth array gives the number."""
    total = len(data) - length + 1
    if total <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    valid = np.zeros(total + 1, np.int8)
    enough = ends - starts >= length
    np.add.at(valid, starts[enough], 1)
    np.add.at(valid, ends[enough] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    span = length - ANCHOR + 1
    places, hashes, firsts, counts = [], [], [], []
    for low in range(0, total, CHUNK):
        high = min(total, low + CHUNK)
        h = _hashes(data[low : high + length - 1])
        m, w = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1
        while w * 2 <= span:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < span:
            m = np.minimum(m[: len(m) - (span - w)], m[span - w :])
        at = (m & _LOW).astype(np.int64)
        ok = valid[low:high]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        # a run ends where the next begins, or where the text does
        stop = np.flatnonzero(np.concatenate((new[1:] | ~ok[1:], [True])) & ok) + 1
        places.append(at[first] + low)
        hashes.append(h[at[first]])
        firsts.append(first + low)
        counts.append(stop - first)
    return tuple(np.concatenate(x) for x in (places, hashes, firsts, counts))


def _slices(batches, columns: list[str]) -> Iterator[dict]:
    """Whole rows in slices of bounded size: the columns as lists, with the texts as bytes."""
    held, size = {c: [] for c in columns}, 0
    for batch in batches:
        lists = [batch.column(i).to_pylist() for i in range(len(columns))]
        for row in zip(*lists, strict=True):
            for c, v in zip(columns, row, strict=True):
                held[c].append(v)
            size += len(row[columns.index("text")] or b"")
            if size >= SLICE_BYTES or len(held["text"]) >= SLICE_ROWS:
                yield held
                held, size = {c: [] for c in columns}, 0
    if held["text"]:
        yield held


def _joined(held: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = [t or b"" for t in held["text"]]
    sizes = np.array([len(t) for t in data], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(data), np.uint8), ends - sizes, ends


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The upper half of a hash deals it out, the rest tells it from others in its range."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def _short(hashes: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes of each hash, as rows."""
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _long(rows: bytes, width: int) -> np.ndarray:
    full = np.zeros((len(rows) // width, 8), np.uint8)
    full[:, :width] = np.frombuffer(rows, np.uint8).reshape(-1, width)
    return full.view("<u8").ravel()


# rows that travel: to a range of anchors or back to a slice; kind 0 names the documents of a slice, 1 asks, 2 answers
MESSAGE = T.StructType([T.StructField("to", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("slice", T.LongType())]
                       + [T.StructField(n, T.BinaryType()) for n in ("a", "b", "c", "d")])
_ARROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("slice", pa.int64())] + [(n, pa.binary()) for n in "abcd"])


def _messages(df: DataFrame, function, schema: T.StructType = MESSAGE, arrow: pa.Schema = _ARROW) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for row in function(batches):
            held.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, bytes))
            if size >= 1 << 20 or len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return df.mapInArrow(run, schema)


def _message(to: int, kind: int, of: int, a=b"", b=b"", c=b"", d=b"") -> dict:
    return {"to": to, "kind": kind, "slice": of, "a": a, "b": b, "c": c, "d": d}


def _groups(batches) -> Iterator[list[dict]]:
    """Consecutive rows with the same receiver."""
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["to"] != row["to"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _received(messages: DataFrame) -> DataFrame:
    """Each receiver's messages next to each other, in a fixed order."""
    return messages.repartition(F.col("to")).sortWithinPartitions("to", "kind", "slice")


def _slice_id(keys: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def _dealt(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(order_by, kind="stable")
    values, first = np.unique(order_by[order], return_index=True)
    return order, values, np.append(first, len(order))


def _ask_anchors(plan: Plan):
    """Round one, from texts: each anchor hash of a slice once, to its range."""

    def run(batches):
        for held in _slices(batches, ["key", "doc", "text"]):
            keys, docs = np.array(held["key"], np.int64), np.array(held["doc"], np.int64)
            data, starts, ends = _joined(held)
            of = _slice_id(keys)
            place, h, _, _ = anchors(data, starts, ends, plan.length)
            owner = np.searchsorted(ends, place, side="right")
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])[: len(h)]
            group = np.cumsum(new) - 1
            low = np.minimum.reduceat(docs[owner], np.flatnonzero(new)) if len(h) else docs[:0]
            high = np.maximum.reduceat(docs[owner], np.flatnonzero(new)) if len(h) else docs[:0]
            many = low != high
            yield _message(of, 0, of, keys.tobytes())
            mine = many[group] if len(h) else np.zeros(0, bool)
            if mine.any():
                yield _message(of, 2, of, _pack(owner[mine].astype(np.uint16)), _pack(h[mine]))
            h, owner = h[new], owner[new]
            order, ranges, first = _dealt(_range_of(h, plan.ranges))
            for r, low_, high_ in zip(ranges.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                chosen = order[low_:high_]
                yield _message(r, 1, of, owner[chosen].astype(np.uint16).tobytes(), _short(h[chosen], plan.width).tobytes(), np.packbits(many[chosen]).tobytes())

    return run


def _answer_anchors(plan: Plan):
    """Round one, in a range: the hashes that several slices or documents have, back to the slices."""

    def run(batches):
        for rows in _groups(batches):
            asks = [r for r in rows if r["kind"] == 1]
            yield from (r for r in rows if r["kind"] != 1)
            if not asks:
                continue
            hashes = [_long(r["b"], plan.width) for r in asks]
            many = [np.unpackbits(np.frombuffer(r["c"], np.uint8))[: len(h)].astype(bool) for r, h in zip(asks, hashes, strict=True)]
            values, times = np.unique(np.concatenate(hashes), return_counts=True)
            shared = times > 1
            for r, h, known in zip(asks, hashes, many, strict=True):
                told = shared[np.searchsorted(values, h)] & ~known
                if told.any():
                    yield _message(r["slice"], 2, r["slice"], _pack(np.frombuffer(r["a"], np.uint16)[told]), _pack(h[told]))

    return run


FLAGS = T.StructType([T.StructField("key", T.LongType()), T.StructField("flags", T.BinaryType())])


def _flags(batches):
    """Round one, per slice: the anchors of each document that others have too."""
    for rows in _groups(batches):
        keys = np.frombuffer(next(r["a"] for r in rows if r["kind"] == 0), np.int64)
        told = [r for r in rows if r["kind"] == 2]
        if not told:
            continue
        owner = np.concatenate([_unpack(r["a"], np.uint16) for r in told]).astype(np.int64)
        h = np.concatenate([_unpack(r["b"], np.uint64) for r in told])
        order, owners, first = _dealt(owner)
        for o, low, high in zip(owners.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield {"key": int(keys[o]), "flags": h[order[low:high]].tobytes()}


def _ask_suffixes(plan: Plan):
    """Round two, from texts: the suffixes around flagged anchors, each string of a slice once, to the anchor's range."""
    widest = 2 * plan.length - ANCHOR

    def run(batches):
        seen = set()
        for held in _slices(batches, ["key", "doc", "text", "flags"]):
            fresh = []
            for i, pair in enumerate(zip(held["key"], held["doc"], strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    fresh.append(i)
            held = {c: [v[i] for i in fresh] for c, v in held.items()}
            if not fresh:
                continue
            docs = np.array(held["doc"], np.int64)
            data, starts, ends = _joined(held)
            place, h, first, count = anchors(data, starts, ends, plan.length)
            owner = np.searchsorted(ends, place, side="right")
            # what was sent of a hash, mixed with its document; a rare chance agreement only sends a string in vain
            sent = _long(_short(h, plan.width).tobytes(), plan.width) * _ODD ^ owner.astype(np.uint64) * _MIX
            flags = [np.frombuffer(f, np.uint64) for f in held["flags"]]
            flagged = _long(_short(np.concatenate(flags), plan.width).tobytes(), plan.width)
            keep = np.isin(sent, flagged * _ODD ^ np.repeat(np.arange(len(flags)), [len(f) for f in flags]).astype(np.uint64) * _MIX)
            place, h, first, count, owner = place[keep], h[keep], first[keep], count[keep], owner[keep]
            keys = np.array(held["key"], np.int64)
            of = _slice_id(np.concatenate((keys, docs)))
            yield _message(of, 0, of, docs.tobytes(), keys.tobytes())
            # equal strings: the first byte is the number of suffixes, so zero bytes at the end are told apart
            column = np.arange(widest)
            size = count + plan.length - 1
            whole = np.zeros((len(first), widest + 1), np.uint8)
            whole[:, 0] = count
            for low in range(0, len(first), 1 << 15):
                part = slice(low, low + (1 << 15))
                at = np.minimum(first[part, None] + column, len(data) - 1)
                whole[part, 1:] = np.where(column < size[part, None], data[at], 0)
            text = whole.view(f"S{widest + 1}").ravel()
            order = np.lexsort((docs[owner], text))
            new = np.append(True, text[order][1:] != text[order][:-1])[: len(order)]
            least = docs[owner[order]][new] if len(order) else docs[:0]
            later = docs[owner[order]] != least[np.cumsum(new) - 1] if len(order) else np.zeros(0, bool)
            known, asking = order[later], order[~later]
            if len(known):
                start = first[known] - starts[owner[known]]
                yield _message(of, 2, of, _pack(owner[known].astype(np.uint16)), _pack(start), _pack(start + size[known]))
            ranges = _range_of(h[asking], plan.ranges)
            deal, values, border = _dealt(ranges)
            for r, low, high in zip(values.tolist(), border[:-1].tolist(), border[1:].tolist(), strict=True):
                chosen = asking[deal[low:high]]
                start = first[chosen] - starts[owner[chosen]]
                body = whole[chosen]
                body = body[:, 1:][column < size[chosen][:, None]]
                head = np.stack((owner[chosen], start, docs[owner[chosen]]), axis=1)
                yield _message(r, 1, of, _pack(head), _pack(count[chosen].astype(np.uint8)), _pack(body), _pack((place[chosen] - first[chosen]).astype(np.uint8)))

    return run


class Family:
    """Suffix arrays of growing size: sorted distinct strings with the least id of each."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # (rank, strings, least ids), largest first

    @staticmethod
    def array(strings: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct strings with the least id of each, and which of them each given string is."""
        order = np.argsort(strings, kind="stable")
        strings, ids = strings[order], ids[order]
        new = np.append(True, strings[1:] != strings[:-1])[: len(strings)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return strings[first], np.minimum.reduceat(ids, first), which

    def add(self, strings: np.ndarray, ids: np.ndarray) -> None:
        """A new batch: sorted distinct strings. Two levels of equal rank merge; the stable sort only merges sorted runs."""
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, older, oldest = self.levels.pop()
            strings, ids, _ = self.array(np.concatenate((older, strings)), np.concatenate((oldest, ids)))
            rank += 1
        self.levels.append((rank, strings, ids))

    def least(self, strings: np.ndarray) -> np.ndarray:
        """The least id that any level has with each of the sorted ``strings``."""
        out = np.full(len(strings), np.iinfo(np.int64).max)
        for _, known, least in self.levels:
            at = np.minimum(np.searchsorted(known, strings), len(known) - 1)
            out = np.where(known[at] == strings, np.minimum(out, least[at]), out)
        return out


@dataclass
class Asked:
    """One message: strings with the suffixes they hold, and which of these have matched."""

    row: dict
    head: np.ndarray  # owner, start in the text, owner's id
    count: np.ndarray
    before: np.ndarray  # bytes before the anchor
    body: np.ndarray
    entry: np.ndarray
    offset: np.ndarray
    hit: np.ndarray

    @staticmethod
    def of(row: dict) -> Asked:
        count = _unpack(row["b"], np.uint8).astype(np.int64)
        entry = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        head = _unpack(row["a"], np.int64).reshape(-1, 3)
        return Asked(row, head, count, _unpack(row["d"], np.uint8), _unpack(row["c"], np.uint8), entry.astype(np.int32), offset.astype(np.int16), np.zeros(len(entry), bool))

    def suffixes(self, length: int, passes: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, string, owner's id) of the suffixes whose distance to the anchor is of this turn."""
        which = np.flatnonzero((self.before[self.entry] - self.offset) % passes == turn) if passes > 1 else np.arange(len(self.entry))
        size = self.count + length - 1
        at = (np.cumsum(size) - size)[self.entry[which]] + self.offset[which]
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.body, length)[at]).view(f"S{length}").ravel()
        return which, strings, self.head[self.entry[which], 2]


def _scan(asks: list[Asked], length: int, passes: int, turn: int) -> None:
    """Batches into a family, then each against all its levels."""
    family, batches, held, size = Family(), [], [], 0
    for i, ask in enumerate(asks):
        held.append((ask, *ask.suffixes(length, passes, turn)))
        size += len(held[-1][1])
        if size >= BATCH or i == len(asks) - 1:
            strings, ids, which = family.array(*(np.concatenate([h[j] for h in held]) for j in (2, 3)))
            if len(strings):
                family.add(strings, ids)
                batches.append((strings, which, [(h[0], h[1], h[3]) for h in held]))
            held, size = [], 0
    for strings, of, members in batches:
        smallest, at = family.least(strings)[of], 0
        for ask, which, ids in members:
            ask.hit[which] = smallest[at : at + len(ids)] < ids
            at += len(ids)


def _answer_suffixes(plan: Plan):
    """Round two, in a range: matches go back to their slices. Equal suffixes have equal distances to their anchors, so a
    range with many suffixes takes them in turns by this distance, and one of a frequent anchor stays bounded."""

    def run(batches):
        for rows in _groups(batches):
            yield from (r for r in rows if r["kind"] != 1)
            asks = [Asked.of(r) for r in rows if r["kind"] == 1]
            passes = min(plan.length - ANCHOR + 1, -(-sum(len(a.entry) for a in asks) // TURN))
            for turn in range(passes):
                _scan(asks, plan.length, passes, turn)
            for ask in asks:
                if ask.hit.any():
                    yield _matches(ask, plan.length)

    return run


def _matches(ask: Asked, length: int) -> dict:
    """The runs of matching suffixes of one message as runs of bytes, to its slice."""
    hit, same = ask.hit, ask.entry[1:] == ask.entry[:-1]
    start = ask.head[ask.entry, 1] + ask.offset
    begins = hit & ~np.append(False, hit[:-1] & same)
    stops = hit & ~np.append(hit[1:] & same, False)
    owner = ask.head[ask.entry[begins], 0].astype(np.uint16)
    return _message(ask.row["slice"], 2, ask.row["slice"], _pack(owner), _pack(start[begins]), _pack(start[stops] + length))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("key", T.LongType()), T.StructField("starts", T.BinaryType()), T.StructField("ends", T.BinaryType())])


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the intervals cover; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])[: len(starts)]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(first) else ends


def _spans(batches):
    """Round two, per slice: the bytes that each document loses."""
    for rows in _groups(batches):
        named = next(r for r in rows if r["kind"] == 0)
        docs, keys = np.frombuffer(named["a"], np.int64), np.frombuffer(named["b"], np.int64)
        told = [r for r in rows if r["kind"] == 2]
        if not told:
            continue
        owner = np.concatenate([_unpack(r["a"], np.uint16) for r in told]).astype(np.int64)
        start, end = (np.concatenate([_unpack(r[c], np.int64) for r in told]) for c in "bc")
        order, owners, first = _dealt(owner)
        for o, low, high in zip(owners.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            s, e = united(start[order[low:high]], end[order[low:high]])
            yield {"doc": int(docs[o]), "key": int(keys[o]), "starts": s.tobytes(), "ends": e.tobytes()}


CUT = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())]


def _cut(batches):
    names = ["doc_id", "n_bytes", "spans", "kept"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for low in range(0, whole.num_rows, 256):
            batch = whole.slice(low, 256)
            texts, starts, ends = (batch.column(i).to_pylist() for i in (1, 2, 3))
            sizes, spans, kept = [], [], []
            for text, s, e in zip(texts, starts, ends, strict=True):
                text = text or b""
                s, e = (np.frombuffer(b"".join(v or []), np.int64) for v in (s, e))
                s, e = united(s, e)
                bounds = np.concatenate(([0], np.stack((s, e), axis=1).ravel(), [len(text)])).astype(int).tolist()
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=names)


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the runs of bytes removed), kept (the bytes left) of every row."""
    if length < 2 * ANCHOR or length - ANCHOR + 1 > 255:
        raise ValueError(f"length must be from {2 * ANCHOR} to {254 + ANCHOR} bytes")
    kind = docs.schema[doc].dataType
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # hashes are sent with twelve bits more than it takes to number the anchors
    plan = Plan(length, max(1, -(-size // RANGE_BYTES)), min(8, -(-(int(size).bit_length() + 8) // 8)))
    named = rows.filter(F.col("doc_id").isNotNull()).select("key", F.col("doc_id").cast("long").alias("doc"), "text")
    asked = _messages(named, _ask_anchors(plan))
    answers = saved(_messages(_received(asked), _answer_anchors(plan)), "anchors")
    flags = _messages(_received(answers), _flags, FLAGS, pa.schema([("key", pa.int64()), ("flags", pa.binary())]))
    flags = flags.groupBy("key").agg(F.array_join(F.collect_list(F.hex("flags")), "").alias("flags"))
    flagged = named.join(flags, "key").select("key", "doc", "text", F.unhex("flags").alias("flags"))
    asked = _messages(flagged, _ask_suffixes(plan))
    answers = saved(_messages(_received(asked), _answer_suffixes(plan)), "suffixes")
    found = _messages(_received(answers), _spans, FOUND, pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())]))
    found = found.groupBy("doc", "key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    both = rows.join(found, (F.col("doc_id").cast("long") == F.col("doc")) & (rows["key"] == found["key"]), "left").select("doc_id", "text", "starts", "ends")
    return both.mapInArrow(_cut, T.StructType([T.StructField("doc_id", kind), *CUT]))
