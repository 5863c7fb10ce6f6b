"""DartMinHash signatures of weighted sets, in numpy.

Every element owns the region [0, weight) x [0, infinity), cut along the weights at 1, 3, 7, 15 and so on.  Darts hit
each part as a Poisson process whose rate is its width: a part has its own hashed sequence of arrival times and places, so
two sets throw the same darts wherever their regions overlap, and an element has as many parts as the logarithm of its
weight.  A dart goes to one hashed coordinate, and each coordinate keeps its earliest dart.  The chance that two sets
agree in a coordinate is their weighted Jaccard similarity.  Darts later than a set's horizon are never made: the
horizon is set for a few more darts than coordinates need (k log k), and doubled for sets that left a coordinate empty.
"""

from __future__ import annotations

import math

import numpy as np

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: An odd base and its inverse modulo 2**64, for hashes of byte spans.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """Hashes of byte spans from prefix sums; the powers are kept and grow with the longest buffer."""

    def __init__(self):
        self.up = self.down = np.ones(1, "u8")

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            n = max(len(data), 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(n - 1, b, "u8"), dtype="u8")]) for b in (_BASE, _INVERSE))
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * self.up[: len(data)], dtype="u8")])
        return mix((sums[end] - sums[start]) * self.down[start])


def shingles(texts: list[str | None], width: int, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, times) of every distinct shingle of ``width`` words; a shorter text is one shingle of all its words.

    Words are parted by ASCII white space."""
    norm = [b" ".join((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
    full = [i for i, b in enumerate(norm) if b]
    if not full:
        return np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i8")
    data = np.frombuffer(b" ".join(norm[i] for i in full) + b" ", "u1")
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.array([norm[i].count(b" ") + 1 for i in full])
    first = np.cumsum(counts) - counts
    n = np.maximum(1, counts - width + 1)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    last = np.minimum(at + width - 1, np.repeat(first + counts - 1, n))
    h, owner = hasher(data, starts[at], ends[last]), np.repeat(np.array(full), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def signatures(n_sets: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """(n_sets, k) array of 32-bit dart names.  Sets without weight get zeros."""
    out = np.zeros((n_sets, k), "u4")
    parts = np.maximum(1, np.ceil(np.log2(np.maximum(weight, 0) + 1))).astype("i8")
    at = np.repeat(np.arange(len(element)), parts)
    part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    width = np.exp2(part)
    total = np.bincount(owner, weights=weight, minlength=n_sets)
    owner, units = owner[at], mix(element[at] + part.astype("u8") * _C[0])
    share = np.minimum(1.0, (weight[at] - (width - 1)) / width)  # of the part's width that belongs to the region
    open_ = np.flatnonzero(total > 0)
    horizon = np.zeros(n_sets)
    horizon[open_] = k * (math.log(k) + 3) / total[open_]
    live = np.isin(owner, open_) if len(open_) < n_sets else np.ones(len(owner), bool)
    while live.any():
        own, u, s, wide = owner[live], units[live], share[live], width[live]
        best, names = np.full(n_sets * k, np.inf), np.zeros(n_sets * k, "u4")
        when, i, thrown = np.zeros(len(u)), 0, []
        while len(u):
            r = mix(u + np.uint64((i * int(_C[0])) % (1 << 64)))
            when = when - np.log(((r >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / wide
            keep = when <= horizon[own]
            own, u, s, wide, when, r = own[keep], u[keep], s[keep], wide[keep], when[keep], mix(r[keep] + _C[2])
            slot = own * k + (r % np.uint64(k)).astype("i8")
            name = mix(r + _C[1])
            inside = ((name & np.uint64(0xFFFFFF)).astype("f8") + 0.5) * 2.0**-24 < s if (s < 1).any() else slice(None)
            thrown.append((slot[inside], when[inside], (name[inside] >> np.uint64(32)).astype("u4")))
            i += 1
        slot, when, name = (np.concatenate(x) for x in zip(*thrown))
        np.minimum.at(best, slot, when)
        first = when == best[slot]
        names[slot[first]] = name[first]
        best = best.reshape(n_sets, k)
        full = np.isfinite(best).all(axis=1)
        done = np.intersect1d(open_, np.flatnonzero(full))
        out[done] = names.reshape(n_sets, k)[done]
        open_ = np.setdiff1d(open_, done)
        horizon[open_] *= 2
        live = np.isin(owner, open_)
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """(n_sets, bands) 63-bit hashes of consecutive coordinates."""
    n, k = signature.shape
    rows = signature.reshape(n, bands, k // bands).astype("u8")
    h = np.broadcast_to(np.arange(1, bands + 1, dtype="u8") * _C[0], (n, bands)).copy()
    for j in range(rows.shape[2]):
        h = mix(h ^ (rows[:, :, j] + _C[1]))
    return (h >> np.uint64(1)).astype("i8")
