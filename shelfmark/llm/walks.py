"""Random-walk embedding of sequences (CGK) and bit sampling: sequences that are few edits apart get strings that often agree.

A walk reads a sequence with a pointer: at each step it writes the symbol under the pointer, and a random bit of (walk, step,
symbol) tells whether the pointer moves on. Two sequences read with the same bits write the same symbols until an edit;
behind it their pointers meet again after some steps, so the edit distance becomes a Hamming distance. A table samples a
few steps of one walk; sequences that agree in all samples of any table are candidates.

How many walks a length needs for a target recall at exactly k edits is measured once, on pairs of random sequences.

Defined cases: sequences shorter than the steps taken write PAD behind their end; an empty sequence writes PAD only; equal
sequences always agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

PAD = -1
MOST_WALKS = 32
TABLES, SAMPLES = 16, 2  # tables per walk, steps sampled per table
TRIALS = 600
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _moves(symbols: np.ndarray, walk: np.ndarray, step: int) -> np.ndarray:
    """A random bit of each symbol in each walk at this step."""
    h = (symbols.astype(np.uint64) + np.uint64(2)) * _A ^ (walk[:, None].astype(np.uint64) * np.uint64(1 << 20) + np.uint64(step)) * _B
    h = (h ^ (h >> np.uint64(29))) * _B
    return ((h ^ (h >> np.uint64(32))) * _A >> np.uint64(63)).astype(np.int64)


def trace(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, walks: int, steps: int) -> np.ndarray:
    """(step, walk, sequence): what each walk writes for the sequences ``symbols[start:end]``."""
    walk = np.arange(walks)
    at = np.broadcast_to(start, (walks, len(start))).copy()
    out = np.empty((steps, walks, len(start)), np.int32)
    padded = np.append(symbols, PAD)
    for j in range(steps):
        read = np.where(at < end, padded[np.minimum(at, len(symbols))], PAD)
        out[j] = read
        at += _moves(read, walk, j)
    return out


@dataclass(frozen=True)
class Effort:
    walks: int
    steps: np.ndarray  # (walk, table, sample): the steps sampled
    recall: float  # measured


def _keys(traced: np.ndarray, steps: np.ndarray, void: int) -> np.ndarray:
    """(walk, table, sequence): a hash of the sampled symbols with walk and table; ``void`` if a sample is behind the end,
    where all sequences agree."""
    walks, tables, samples = steps.shape
    h = (np.arange(walks)[:, None, None].astype(np.uint64) << np.uint64(8)) + np.arange(tables)[None, :, None].astype(np.uint64) + np.uint64(1)
    h = np.broadcast_to(h * _A, (walks, tables, traced.shape[2])).copy()
    ended = np.zeros(h.shape, bool)
    for s in range(samples):
        values = traced[steps[:, :, s], np.arange(walks)[:, None]]  # (walk, table, sequence)
        h = (h ^ (values.astype(np.uint64) + np.uint64(2))) * _B
        h ^= h >> np.uint64(31)
        ended |= values == PAD
    h[ended] = void
    return h


def keys(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, effort: Effort, void: int) -> np.ndarray:
    """Keys of sequences; those without a value are ``void``, which has to differ between the two sides."""
    return _keys(trace(symbols, start, end, effort.walks, int(effort.steps.max()) + 1), effort.steps, void)


def edited(rng: np.random.Generator, words: np.ndarray, k: int) -> np.ndarray:
    """A copy with ``k`` random edits at different places, new words being none of the old."""
    out, places = [], set(rng.choice(len(words), min(k, len(words)), replace=False).tolist())
    for i, w in enumerate(words.tolist()):
        kind = rng.integers(3) if i in places else 3
        if kind != 1:
            out.append(w if kind != 0 else int(rng.integers(1 << 28, 1 << 30)))
        if kind == 2:
            out.append(int(rng.integers(1 << 28, 1 << 30)))
    return np.array(out, np.int64)


@cache
def effort(n: int, k: int, target: float) -> Effort:
    """Walks for sequences of ``n`` symbols at ``k`` edits: as many as find the share ``target`` of the trials, and as many
    again, so that what the trials cannot tell is on the safe side."""
    rng = np.random.default_rng(n * 1009 + k)
    steps = rng.integers(0, max(1, n + n // 2), (MOST_WALKS, TABLES, SAMPLES))
    if k == 0:
        return Effort(1, np.zeros((1, 1, SAMPLES), np.int64), 1.0)
    items = rng.integers(1, 1 << 28, (TRIALS, n))
    copies = [edited(rng, w, k) for w in items]
    ends = np.cumsum([len(c) for c in copies])
    starts = ends - np.array([len(c) for c in copies])
    top = int(steps.max()) + 1
    first = np.arange(TRIALS) * n
    missing, walks = np.ones(TRIALS, bool), 0
    a = _keys(trace(items.ravel(), first, first + n, MOST_WALKS, top), steps, 0)
    # a window has the item's length, however long the passage is
    b = _keys(trace(np.concatenate(copies), starts, np.minimum(starts + n, ends), MOST_WALKS, top), steps, 1)
    need = MOST_WALKS
    while walks < min(MOST_WALKS, 2 * need):
        missing &= ~(a[walks] == b[walks]).any(axis=0)
        walks += 1
        if missing.mean() <= 1 - target:
            need = min(need, walks)
    return Effort(walks, steps[:walks], float(1 - missing.mean()))
