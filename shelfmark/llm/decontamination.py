"""Benchmark decontamination: passages of documents that are within a small edit distance of a benchmark item.

Texts are sequences of lower-cased words, where scripts written without spaces (Chinese, Japanese, Thai and the like) give
a word per character, with its marks; the edit distance is over words, and a passage matches an item of n words when
it is at most floor(max_share * n). For every item length, windows of that many words start at every word of a document.

1. Gate: windows without enough of the rarest words of any item of their length cannot match and are not read on.
2. The random-walk embedding (see ``walks``) turns windows and items into strings whose Hamming distance stands for the
   edit distance; tables of sampled symbols bring together windows and items that agree in one. The number of walks is set
   per length and number of edits by the recall measured at exactly that many edits, ``target`` or more.
3. Candidates are verified by the exact distance of the item to the best passage around the window.

``exhaustive`` verifies all windows that have all but the allowed number of the item's words instead of 2: a condition that
every match meets, so nothing is lost. It is what the tests compare with.

The items are a stated query set: they are read in blocks of about ``block`` items, each a pass over all documents
without any shuffle.

Defined cases: null and empty texts have no matches; items without a word, or with fewer than ``min_words``, and null
items never match; items of fewer words than one edit needs (five at a share of 0.2) match verbatim only;
overlapping matches of one item in one document are reduced to the closest, then first; repeated documents and items
match each; empty tables give no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import walks
from shelfmark.llm.common import append, texts

# Scripts written without spaces between words: iteration marks, kana, bopomofo, Han; Thai, Lao, Myanmar, Khmer, Tai, Ahom.
HAN = "\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303c\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff"
HAN += "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U000323af"
TAI = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0x11700, 0x1174F)]


def _mixed() -> re.Pattern:
    tai = [chr(c) for low, high in TAI for c in range(low, high + 1)]
    single = HAN + "".join(c for c in tai if c.isalnum())
    marks = "\u302a-\u302f\u3099\u309a" + "".join(c for c in tai if unicodedata.category(c)[0] == "M")
    return re.compile(rf"[{single}][{marks}]*|[^\W{single}]+")


WORD, MIXED, HIGH = re.compile(r"\w+"), _mixed(), re.compile("[\u0e00-\U0010ffff]")


@dataclass(frozen=True)
class Settings:
    max_share: float = 0.2
    min_words: int = 1
    block: int = 4096
    target: float = 0.998
    exhaustive: bool = False


def lowered(text: str) -> str:
    """Lower case with the same positions: the few letters that would grow stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_matches(text: str | None):
    low = lowered(text or "")
    return (MIXED if HIGH.search(low) else WORD).finditer(low)  # below HIGH both give the same, and WORD is faster


def words_of(text: str | None) -> list[str]:
    return [m[0] for m in word_matches(text)]


def allowed(n: int, max_share: float) -> int:
    return int(np.floor(max_share * n + 1e-9))


UNIT = 1 << 40  # distances are multiples of it, positions are below it
PIECE = 1 << 12  # words of a text that are compared with an item at once


def ends_of(item: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end in ``around`` (0 to its length) the least edit distance of ``item`` to a passage that ends there, and
    the last start of such a passage."""
    m = len(around)
    # the distance is the high part, the start (last is best) the low part, so that one minimum serves both
    row = (UNIT - 1 - np.arange(m + 1)).astype(np.int64)
    ramp = np.arange(m + 1, dtype=np.int64) * UNIT
    for word in item:
        new = row + UNIT
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(around == word, 0, UNIT))
        row = np.minimum.accumulate(new - ramp) + ramp
    return row // UNIT, UNIT - 1 - row % UNIT


def closest(item: np.ndarray, around: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any passage of ``around``, with the passage's start and end: among the closest
    passages the one that ends first, and of those the one that starts last."""
    distance, start = ends_of(item, around)
    end = int(np.argmin(distance))
    return int(distance[end]), int(start[end]), end


def disjoint(item: np.ndarray, k: int, around: np.ndarray) -> list[tuple[int, int, int]]:
    """(distance, start, end) of disjoint passages of ``around`` within ``k`` edits: the closest, then the first, is taken
    again and again from what the others leave free on either side.

    A passage within k edits has at most n + k words, so pieces that overlap by as many give the same ends as the whole,
    and taking a passage changes the free ends of the next n + k words only."""
    n, m = len(item), len(around)
    distance, start = np.full(m + 1, k + 1, np.int64), np.zeros(m + 1, np.int64)
    for at in range(0, m + 1, PIECE):
        low, high = max(0, at - n - k), min(m, at + PIECE - 1)
        d, s = ends_of(item, around[low:high])
        distance[at : high + 1], start[at : high + 1] = d[at - low :], s[at - low :] + low
    near = np.flatnonzero(distance <= k)
    best = list(zip(distance[near].tolist(), near.tolist(), strict=True))
    heapq.heapify(best)
    taken = np.zeros(m + 2, bool)  # ends that are inside a passage taken
    found = []
    while best:
        d, b = heapq.heappop(best)
        if taken[b] or distance[b] != d:
            continue
        a = int(start[b])
        found.append((d, a, b))
        taken[a + 1 : b + 1] = True
        # the free ends behind it whose passages overlap it begin anew at its end
        stop = np.flatnonzero(taken[b + 1 : min(m, b + n + k) + 1])
        stop = b + int(stop[0]) if len(stop) else min(m, b + n + k)
        later = slice(b + 1, stop + 1)
        if ((distance[later] <= k) & (start[later] < b)).any():
            old = distance[later].copy()
            new, s = ends_of(item, around[b:stop])
            distance[later], start[later] = new[1:], s[1:] + b
            for e in (np.flatnonzero((distance[later] != old) & (distance[later] <= k)) + b + 1).tolist():
                heapq.heappush(best, (int(distance[e]), e))
    return found


def efforts_of(items: list[tuple[int, str]], settings: Settings) -> dict[int, walks.Effort]:
    """The walks for each length of the items."""
    sizes = {len(words_of(text)) for _, text in items}
    return {n: walks.effort(n, allowed(n, settings.max_share), settings.target) for n in sorted(sizes) if n >= max(1, settings.min_words)}


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings, efforts: dict[int, walks.Effort] | None = None):
        self.s, self.vocabulary, self.items = settings, {}, []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= settings.min_words:
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                self.items.append((item_id, np.array(numbers, np.int32)))
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.edits = np.array([allowed(n, settings.max_share) for n in self.sizes.tolist()], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.width = len(self.vocabulary) + 1
        counted = [np.unique(w, return_counts=True) for _, w in self.items]
        kinds = [k for k, _ in counted]
        none = np.zeros(0, np.int64)
        spread = np.bincount(np.concatenate([none, *kinds]), minlength=self.width)
        # of an item's rarest kinds of words, all but the allowed edits must be in a window
        rare = [k[np.lexsort((k, spread[k]))][: e + max(2, -(-n // 4))] for k, e, n in zip(kinds, self.edits.tolist(), self.sizes.tolist(), strict=True)]
        self.need = np.array([max(1, len(r) - e) for r, e in zip(rare, self.edits.tolist(), strict=True)], np.int64)
        owner, word = np.repeat(np.arange(len(rare)), [len(r) for r in rare]), np.concatenate([none, *rare])
        order = np.argsort(word, kind="stable")
        self.posted, self.first = owner[order], np.searchsorted(word[order], np.arange(self.width + 1))
        self.members = np.concatenate([none, *[i * self.width + k.astype(np.int64) for i, k in enumerate(kinds)]])
        # how often the item has each member; 0 for words that are none
        self.times = np.concatenate([none, *[c for _, c in counted], np.zeros(1, np.int64)])
        self.efforts = {} if settings.exhaustive else efforts or efforts_of(items, settings)
        self.tables = {n: self._table(n) for n in self.efforts}

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the items of ``n`` words, and whose they are."""
        mine = np.flatnonzero(self.sizes == n)
        symbols = np.concatenate([self.items[i][1] for i in mine.tolist()])
        start = np.arange(len(mine)) * n
        keys = walks.keys(symbols, start, start + n, self.efforts[n], 0)
        keys, owner = keys.ravel(), np.broadcast_to(mine, keys.shape).ravel()
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        return keys[keys != 0], owner[keys != 0]

    def _near(self, numbers: np.ndarray) -> np.ndarray:
        """(item, start) of the windows that agree with an item in a table of sampled symbols."""
        items, starts = self._windows(numbers)
        numbers = np.concatenate((numbers, np.zeros(self.longest, np.int32)))
        span, out = len(numbers), [np.zeros(0, np.int64)]
        for n, (keys, owner) in self.tables.items():
            start = np.unique(starts[self.sizes[items] == n])
            for i in range(0, len(start), 1 << 12):
                part = start[i : i + (1 << 12)]
                asked = walks.keys(numbers, part, part + n, self.efforts[n], 1)
                low = np.searchsorted(keys, asked.ravel(), side="left")
                count = np.searchsorted(keys, asked.ravel(), side="right") - low
                found = owner[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                at = np.repeat(np.broadcast_to(part, asked.shape).ravel(), count)
                out.append(np.unique(found * span + at))
        both = np.unique(np.concatenate(out))
        return np.stack((both // span, both % span), axis=1)

    def _windows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows with enough of an item's rarest words. Only places of such words are looked at."""
        at = np.flatnonzero(numbers)
        low = self.first[numbers[at]]
        count = self.first[numbers[at] + 1] - low
        place = np.repeat(at, count)
        item = self.posted[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(place))]
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        last = np.minimum(np.arange(len(item)) + self.need[item] - 1, len(item) - 1)
        full = (item[last] == item) & (place[last] - place < self.sizes[item]) & (last - np.arange(len(item)) == self.need[item] - 1)
        item, low, high = item[full], (place[last] - self.sizes[item] + 1)[full], place[full]
        count = high - low + 1
        start = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        span = len(numbers) + self.longest
        both = np.unique(np.repeat(item, count) * span + np.maximum(start, 0))
        return both // span, both % span

    def _candidates(self, numbers: np.ndarray) -> np.ndarray:
        """(item, start) of the windows that have all but the allowed number of the item's words."""
        items, starts = self._windows(numbers)
        numbers = np.concatenate((numbers, np.zeros(self.longest, np.int32)))
        out = []
        for n in np.unique(self.sizes).tolist():
            chosen = np.flatnonzero(self.sizes[items] == n)
            for i in range(0, len(chosen), 1 << 12):
                item, start = items[chosen[i : i + (1 << 12)]], starts[chosen[i : i + (1 << 12)]]
                key = item[:, None] * self.width + numbers[start[:, None] + np.arange(n)[None, :]]
                member = np.searchsorted(self.members, key)
                found = self.members[np.minimum(member, len(self.members) - 1)] == key
                least = n - self.edits[item]
                enough = found.sum(axis=1) >= least
                item, start, least = item[enough], start[enough], least[enough]
                # the same with each word counted as often as the item has it
                member = np.sort(np.where(found, member, len(self.members))[enough], axis=1)
                at = np.broadcast_to(np.arange(n), member.shape)
                again = np.zeros(member.shape, bool)
                again[:, 1:] = member[:, 1:] == member[:, :-1]
                rank = at - np.maximum.accumulate(np.where(again, 0, at), axis=1)
                enough = (rank < self.times[member]).sum(axis=1) >= least
                out.append(np.stack((item[enough], start[enough]), axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def matches(self, batch: list[str | None]) -> list[list[tuple]]:
        """Per text (item_id, distance, start, end) in code points."""
        out = [[] for _ in batch]
        if not self.items:
            return out
        get = self.vocabulary.get
        lists = [[get(w, 0) for w in words_of(t)] for t in batch]
        gap = [0] * self.longest  # no window with enough known words reaches over it
        joined, firsts = [], []
        for numbers in lists:
            firsts.append(len(joined))
            joined += numbers
            joined += gap
        numbers, firsts = np.array(joined, np.int32), np.array(firsts, np.int64)
        areas = {}  # candidates of an item close to each other are verified together
        for item, start in (self._candidates(numbers) if self.s.exhaustive else self._near(numbers)).tolist():
            n, k = int(self.sizes[item]), int(self.edits[item])
            of = int(np.searchsorted(firsts, start, side="right")) - 1
            low, high = max(int(firsts[of]), start - k), min(int(firsts[of]) + len(lists[of]), start + n + 2 * k)
            known = areas.setdefault((of, item), [])
            if known and low <= known[-1][1]:
                known[-1][1] = max(high, known[-1][1])
            else:
                known.append([low, high])
        for (of, item), known in areas.items():
            words, k = self.items[item][1], int(self.edits[item])
            found = [(d, low + a, low + b) for low, high in known for d, a, b in disjoint(words, k, numbers[low:high])]
            if found:
                spans = [m.span() for m in word_matches(batch[of])]
                first = int(firsts[of])
                out[of] += [(self.items[item][0], d, spans[a - first][0], spans[b - first - 1][1]) for d, a, b in found]
        return [sorted(m) for m in out]


FOUND = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "distance", "start", "end")]))


def annotate(docs: DataFrame, items: list[tuple[int, str]], settings: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``matches``: item_id, distance, start, end of each passage found, for one block of items."""

    efforts = {} if settings.exhaustive else efforts_of(items, settings)  # measured once, here

    def make():
        matcher = Matcher(items, settings, efforts)
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "start", "end")]))

        def run(piece):
            found = matcher.matches(texts(piece, text))
            return [pa.array([[dict(zip(("item_id", "distance", "start", "end"), m, strict=True)) for m in ms] for ms in found], kind)]

        return run

    return append(docs, [T.StructField("matches", FOUND)], make, text, keep)


def blocks(benchmark: DataFrame, settings: Settings, item: str = "item_id", text: str = "text"):
    """The items in blocks of about ``block``, chosen by a hash of id and text."""
    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    count = max(1, -(-rows.count() // settings.block))
    for b in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r))


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end: one row per passage of a document that matches an item."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    parts = [annotate(rows, items, settings, "text", ["doc_id"]).select("doc_id", F.inline("matches")) for items in blocks(benchmark, settings)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The documents in which no passage matches an item, with all their columns, whatever their names; one pass per block."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    for items in blocks(benchmark, settings):
        rows = annotate(rows, items, settings).filter(F.size("matches") == 0).drop("matches")
    return rows.select("row.*")
