"""PartEnum signatures of shingle sets (numpy, over whole batches of texts inside tasks).

Sets are grouped by size into bands; band i pairs with itself and with band i + 1. Two sets that
reach the similarity and whose smaller one is in band i differ in at most k elements. The domain of
elements is cut into n parts and each part into three cells. As at most k / 2 parts can hold two
differing elements or more, at least n - k / 2 parts differ in one cell at most, so two of their
three cells are equal. Every part's subsets of two cells are enumerated, and the hash of a set's elements in such
a subset is a signature.

Equal empty subsets say nothing, so they are no signatures. A part in which a set fills two cells
has no empty subset; a set that fills so in more than k / 2 parts has a signature in common with each of its
partners. Sets with fewer such parts are enumerated again over more parts, of a single cell each,
and in the end over single elements; if two partners have only empty subsets in common, both of
them are enumerated again, so no pair is lost.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .wordhash import SPACED, STEP, U, coded, mix, starts_of

#: A set's 128-bit name, as two numbers.
NAME = np.dtype([("high", "<u8"), ("low", "<u8")])


class Bands:
    """Bands of set sizes for a similarity of num / den (4 / 5: 0.8)."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    @cache  # noqa: B019
    def top(self, band: int) -> int:
        """Largest size in a band; band 0 is size 1."""
        return 1 if band == 0 else max(self.top(band - 1) + 1, self.partner(self.top(band - 1) + 1))

    def partner(self, size: int) -> int:
        """Largest size that a set of this size can have as a partner."""
        return size * self.den // self.num

    def differing(self, band: int) -> int:
        """A bound on the elements in which two partners differ, the smaller one being in this band.

        Two sets of together n elements that reach num / den share at least num / (num + den) of n."""
        both = self.top(band) + self.partner(self.top(band))
        return both * (self.den - self.num) // (self.den + self.num)

    def tops(self, largest: int) -> np.ndarray:
        """The largest sizes of the bands up to one that holds this size."""
        out = [1]
        while out[-1] < largest:
            out.append(self.top(len(out)))
        if 4 * len(out) > TAG_MASK:
            raise ValueError("the similarity is too close to 1 for sets of this size")
        return np.array(out)


#: The low bits of a signature hold 4 * band + level.
TAG_BITS = 12
TAG_MASK = (1 << TAG_BITS) - 1
#: The subsets of two of a part's three cells, by the cell left out.
SUBSETS = ((1, 2), (0, 2), (0, 1))


def _sealed(hashes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return (mix(hashes) & ~U(TAG_MASK)) | tags.astype(U)


def _cells(elements: np.ndarray, row: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The filled cells of each set, as numbers that run on from set to set (set i has n[i]), and a hash of the elements in each."""
    at = (((elements >> U(32)) * n[row].astype(U)) >> U(32)).astype(np.int64) + starts_of(n)[row]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(mix(elements + U(level)), first)


def signatures(elements: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of many sets that lie side by side (each ascending, none empty), and the set of each; then, for each
    set and tag it is enumerated under: set, tag, and the least number of signatures that it has in
    common with any partner under that tag (0 or less: no promise)."""
    sigs: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    promises: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    tops = bands.tops(int(sizes.max()))
    differing = np.array([bands.differing(i) for i in range(len(tops))])
    own = np.searchsorted(tops, sizes)
    reach = tops * bands.den // bands.num
    with np.errstate(over="ignore"):
        for below in (0, 1):
            rows = np.arange(len(sizes)) if not below else np.flatnonzero((own > 0) & (sizes <= reach[np.maximum(own - 1, 0)]))
            for level in (0, 1, 2):
                if not len(rows):
                    break
                band = own[rows] - below
                k, tag = differing[band], band * 4 + level
                chosen = np.zeros(len(sizes), bool)
                chosen[rows] = True
                its = elements if len(rows) == len(sizes) else elements[np.repeat(chosen, sizes)]
                row = np.repeat(np.arange(len(rows)), sizes[rows])
                if level == 0:
                    parts = k // 2 + k // 16 + 2
                    at, sums = _cells(its, row, 3 * parts, 0)
                    cells = np.zeros(3 * int(parts.sum()), U)
                    cells[at] = sums | U(1)  # 0: empty
                    cells = cells.reshape(-1, 3)
                    of = np.repeat(np.arange(len(rows)), parts)
                    place = np.arange(len(cells)) - starts_of(parts)[of]
                    for out, (i, j) in enumerate(SUBSETS):
                        filled = np.flatnonzero(cells[:, i] | cells[:, j])
                        o = of[filled]
                        h = cells[filled, i] * U(0xFF51AFD7ED558CCD) + mix(cells[filled, j] + U(out)) + (place[filled] * 3 + out).astype(U) * U(STEP) + tag[o].astype(U) * U(0xC4CEB9FE1A85EC53)
                        sigs.append(_sealed(h, tag[o]))
                        owners.append(rows[o])
                    thick = (cells != 0).sum(axis=1) >= 2
                    common = np.bincount(of[thick], minlength=len(rows)) - k // 2
                elif level == 1:
                    parts = 3 * k + 3
                    at, sums = _cells(its, row, parts, 1)
                    of = np.searchsorted(np.cumsum(parts), at, "right")
                    h = sums ^ mix((at - starts_of(parts)[of]).astype(U) * U(4096) + tag[of].astype(U))
                    sigs.append(_sealed(h, tag[of]))
                    owners.append(rows[of])
                    common = np.bincount(of, minlength=len(rows)) - k
                else:
                    sigs.append(_sealed(its ^ mix(tag[row].astype(U)), tag[row]))
                    owners.append(rows[row])
                    common = sizes[rows] - k
                promises.append((rows, tag, common))
                rows = rows[common <= 0]
    of, tags, common = (np.concatenate(x) for x in zip(*promises, strict=True))
    return np.concatenate(sigs), np.concatenate(owners), of, tags, common


def names_of(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit names of sets that lie side by side (none empty)."""
    out = np.zeros(len(sizes), NAME)
    first = starts_of(sizes)
    with np.errstate(over="ignore"):
        for part, salt in (("high", 0x9E3779B97F4A7C15), ("low", 0xC2B2AE3D27D4EB4F)):
            out[part] = mix(np.add.reduceat(mix(elements ^ U(salt)), first) + sizes.astype(U) * U(STEP))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of word shingles of texts (bytes of text i: offsets[i] to offsets[i + 1]), side by side as ascending 64-bit hashes, and their sizes.

    A text of fewer words is one shingle; a text without words has an empty set."""
    offsets = np.asarray(offsets, np.int64)
    codes, doc = coded(data, offsets, SPACED)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    out, of = [], []
    with np.errstate(over="ignore"):
        factors = np.cumprod(np.full(length, STEP, U))
        for n in range(1, length + 1):
            if n < length:  # whole texts of n words
                first = starts_of(n_words)[n_words == n]
            else:
                first = np.flatnonzero(doc[length - 1 :] == doc[: max(0, len(doc) - length + 1)])
            if len(first):
                out.append(mix(sum(codes[first + i] * factors[i] for i in range(n)) + U(n)))
                of.append(doc[first])
    if not out:
        return np.zeros(0, U), np.zeros(len(n_words), np.int64)
    shingles, of = np.concatenate(out), np.concatenate(of)
    if len(out) > 1:
        order = np.argsort(of, kind="stable")
        shingles, of = shingles[order], of[order]
    bounds = np.searchsorted(of, np.arange(len(n_words) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        shingles[a:b].sort()
    kept = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])])
    return shingles[kept], np.bincount(of[kept], minlength=len(n_words))


def bucket_of(sigs: np.ndarray, buckets: int) -> np.ndarray:
    return (((sigs >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def shared(sigs: np.ndarray, owners: np.ndarray, few: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of one bucket's signatures: (owner, owner, tag, count) of the pairs that share signatures which at most few
    owners have, and (owner, first owner, tag, signature) of all owners of the others."""
    order = np.lexsort((owners, sigs))
    sigs, owners = sigs[order], owners[order]
    new = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (owners[1:] != owners[:-1])])
    sigs, owners = sigs[new], owners[new]
    start = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    size = np.diff(np.append(start, len(sigs)))
    left, right, tags = [], [], []
    for z in range(2, few + 1):
        at = start[size == z]
        for i in range(z):
            for j in range(i + 1, z):
                left.append(owners[at + i])
                right.append(owners[at + j])
                tags.append((sigs[at] & U(TAG_MASK)).astype(np.int64))
    a, b, t = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, tags))
    order = np.lexsort((t, b, a))
    a, b, t = a[order], b[order], t[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])])) if len(a) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(a)))
    many = np.repeat(size > few, size)
    hubs = np.repeat(owners[start], size)[many]
    return (a[first], b[first], t[first], counts), (owners[many], hubs, (sigs[many] & U(TAG_MASK)).astype(np.int64), sigs[many].view(np.int64))


def forest(flat: np.ndarray, sizes: np.ndarray, groups: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (places in the list) that join sets, side by side in flat, into the same groups as all links do: |A & B| * den >= |A | B| * num.

    groups are what is joined already. Every set is compared with all later ones that are not yet in its group."""
    order = np.argsort(sizes, kind="stable")
    starts = starts_of(sizes)
    flat = np.unique(flat, return_inverse=True)[1]
    flat = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in order])
    sizes = sizes[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(flat.max() + 1, np.int32)
    group = groups[order].copy()
    out = []
    for i in range(len(sizes)):
        end = int(np.searchsorted(sizes, sizes[i] * den // num, "right"))  # larger ones cannot reach it
        if end <= i + 1 or (group[i + 1 : end] == group[i]).all():
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[starts[i + 1] : starts[end]]], starts[i + 1 : end] - starts[i + 1])
        mark[own] = 0
        linked = both * den >= (sizes[i] + sizes[i + 1 : end] - both) * num
        for j in np.flatnonzero(linked & (group[i + 1 : end] != group[i])) + i + 1:
            if group[j] != group[i]:
                out.append((int(order[i]), int(order[j])))
                group[group == group[j]] = group[i]
    return out
