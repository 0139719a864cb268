"""DartMinHash sketches of weighted sets.

Every element has a region as wide as its weight. Darts are thrown at all regions by hashing alone: along the rank axis
they arrive at each unit of weight as a Poisson process, each with a hashed place within the unit and a hashed
coordinate of the sketch. A dart counts if its place lies inside the element's weight. Of the darts of a coordinate the
one with the least rank is kept, so two sets agree in a coordinate with the probability of their weighted Jaccard
similarity. Only ranks up to a bound that gives about ``k ln k + 2k`` darts are looked at; sets with a coordinate left
empty are thrown at again with twice the bound, which leaves the darts found before as they are.
"""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers with well-spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _units(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray):
    """One row per unit of weight: its hash, its set, and how much of it the element covers."""
    cells = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    covered = np.minimum(1.0, weights[of] - cell)
    return mix(elements[of] + (cell.astype(np.uint64) + np.uint64(1)) * ODD), sets[of], covered


def sketches(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, count: int, k: int) -> np.ndarray:
    """Sketches (count x k dart numbers) of ``count`` sets given as rows of element hash, positive weight, set number.

    A set without elements keeps zeros.
    """
    units, of, covered = _units(elements, weights, sets)
    total = np.bincount(sets, weights=weights, minlength=count)
    bound = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    rank, out = np.full(count * k, np.inf), np.zeros(count * k, np.uint64)
    need = total > 0
    while need.any():
        chosen = need[of]
        at, place, inside = units[chosen], of[chosen], covered[chosen]
        rank.reshape(count, k)[need] = np.inf
        found_at, found_rank, found_dart = [], [], []
        time, throw = np.zeros(len(at)), 0
        while len(at):
            throw += 1
            dart = mix(at ^ mix(np.full(1, throw, np.uint64)))
            time = time - np.log(_uniform(dart))
            live = time < bound[place]
            at, place, inside, time, dart = at[live], place[live], inside[live], time[live], dart[live]
            dart = mix(dart + ODD)
            hit = inside >= 1 if inside.size and inside.min() >= 1 else _uniform(mix(dart + ODD)) < inside
            found_at.append((place * k + (dart % np.uint64(k)).astype(np.int64))[hit])
            found_rank.append(time[hit])
            found_dart.append(dart[hit])
        where, ranks, darts = map(np.concatenate, (found_at, found_rank, found_dart))
        np.minimum.at(rank, where, ranks)
        first = ranks == rank[where]
        out[where[first]] = darts[first]
        need &= ~np.isfinite(rank.reshape(count, k)).all(axis=1)
        bound[need] *= 2
    return out.reshape(count, k)
