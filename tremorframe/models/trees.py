"""Histogram trees in NumPy on one shard of binned rows, all trees of a step level by level.

A shard only knows its own rows. What has to be summed over all rows goes through ``add``: the identity where one shard has
them all, an exchange between tasks otherwise. Gradients are rounded to a fixed grid first, so sums are exact and the trees do
not depend on how the rows are dealt.
"""

from __future__ import annotations

import hashlib
import io
import mmap
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np

Add = Callable[[list[np.ndarray]], list[np.ndarray]]
GRID = float(1 << 20)
#: Rows that are worked on at a time: what they need in between stays in the processor's cache.
CHUNK = 1 << 15
#: Cells of the nodes whose cuts are weighed at a time, likewise.
CELLS = 1 << 15


class Room:
    """Where arrays of rows lie: in memory, or in nameless files of ``folder``, whose pages are handed back while rows are worked on."""

    EVERY = 16  # chunks

    def __init__(self, folder: str | None = None):
        self.folder, self.maps, self.free, self.chunks = folder, [], {}, 0

    def empty(self, shape: tuple[int, ...], kind: type) -> np.ndarray:
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        if self.folder is None or not size:
            return np.empty(shape, kind)
        unused = self.free.get(size)
        if unused:
            held = unused.pop()
        else:
            with tempfile.TemporaryFile(dir=self.folder) as f:
                f.truncate(size)
                held = mmap.mmap(f.fileno(), size)
            self.maps.append(held)
        return np.frombuffer(held, kind).reshape(shape)

    def back(self, *arrays: np.ndarray | None) -> None:
        """These may be given out again; nobody reads them any more."""
        for a in arrays if self.folder else ():
            while isinstance(a, np.ndarray | memoryview):
                a = a.obj if isinstance(a, memoryview) else a.base
            if isinstance(a, mmap.mmap):
                self.free.setdefault(len(a), []).append(a)

    def rest(self) -> None:
        """After each chunk of rows."""
        self.chunks += 1
        if self.maps and self.chunks % self.EVERY == 0:
            for held in self.maps:
                held.madvise(mmap.MADV_DONTNEED)


@dataclass(frozen=True)
class Size:
    """How much is fitted. ``bagged`` makes a forest: rows drawn with replacement, whole leaves, the mean of all trees."""

    rounds: int = 500
    depth: int = 7
    rate: float = 0.02
    row_share: float = 0.8
    column_share: float = 0.7
    node_columns: float = 1.0
    least: float = 5.0
    l1: float = 0.05
    l2: float = 1.5
    gain: float = 0.1
    bagged: bool = False
    seed: int = 42

    def with_(self, values: dict | None) -> Size:
        return replace(self, **(values or {}))


@dataclass
class Work:
    """One model: labels (NaN where a row does not train), weights, and what is learned."""

    objective: str  # squared, late, logistic or classes
    size: Size
    labels: np.ndarray
    weights: np.ndarray | None  # none: all one
    classes: int = 1
    late_weight: float = 2.0
    leaf_edges: np.ndarray | None = None  # a forest also counts its labels by leaf and bin
    active: np.ndarray | None = None  # rows whose predictions are asked for beside those that train; none given: all


@dataclass
class Model:
    """Trees one after the other: a node with feature -1 is a leaf; values above ``cut`` go to ``left + 1``."""

    objective: str
    base: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    output: list[int] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: bool = False
    leaf_edges: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: list[np.ndarray] = field(default_factory=list)  # of each tree (node, bin, weight) lines

    def write(self) -> bytes:
        sizes = [len(f) for f in self.feature]
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        out = io.BytesIO()
        np.savez_compressed(
            out, objective=np.array(self.objective), base=self.base, gains=self.gains, mean=np.array(self.mean), sizes=np.array(sizes, np.int32),
            output=np.array(self.output, np.int16), feature=join(self.feature, np.int16), cut=join(self.cut, np.float64),
            left=join(self.left, np.int32), value=join(self.value, np.float64), leaf_edges=self.leaf_edges,
            lines=np.array([len(c) for c in self.counts], np.int32), counts=np.concatenate(self.counts) if self.counts else np.zeros((0, 3)))
        return out.getvalue()

    @staticmethod
    def read(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as held:
            ends = np.cumsum(held["sizes"])[:-1]
            parts = {n: list(np.split(held[n], ends)) if len(held["sizes"]) else [] for n in ("feature", "cut", "left", "value")}
            counts = list(np.split(held["counts"], np.cumsum(held["lines"])[:-1])) if len(held["lines"]) else []
            return Model(str(held["objective"]), held["base"], output=held["output"].tolist(), gains=held["gains"], mean=bool(held["mean"]),
                         leaf_edges=held["leaf_edges"], counts=counts, **parts)

    def _leaf(self, number: int, x: np.ndarray) -> np.ndarray:
        feature, cut, left = self.feature[number], self.cut[number], self.left[number]
        node, at = np.zeros(len(x), np.int32), np.arange(len(x))
        while (inner := feature[node] >= 0).any():
            here = at[inner]
            n = node[here]
            node[here] = left[n] + (x[here, feature[n]] > cut[n])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Rows x outputs: values, or probabilities of the classes."""
        raw = np.repeat(self.base[None, :], len(x), axis=0)
        for number, (value, k) in enumerate(zip(self.value, self.output, strict=True)):
            raw[:, k] += value[self._leaf(number, x)]
        return finished(self.objective, self.mean, raw, len(self.feature))

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Rows x label bins: the mean over all trees of the label distribution of the leaf that a row falls into."""
        bins = len(self.leaf_edges) - 1
        out = np.zeros((len(x), bins))
        for number, lines in enumerate(self.counts):
            table = np.zeros((len(self.feature[number]), bins))
            table[lines[:, 0].astype(int), lines[:, 1].astype(int)] = lines[:, 2]
            table /= np.maximum(table.sum(axis=1, keepdims=True), 1e-300)
            out += table[self._leaf(number, x)]
        return out / max(len(self.counts), 1)


def finished(objective: str, mean: bool, raw: np.ndarray, trees: int) -> np.ndarray:
    if mean:
        return raw / max(trees, 1)
    if objective == "logistic":
        return 1.0 / (1.0 + np.exp(-raw))
    if objective == "classes":
        top = np.exp(raw - raw.max(axis=1, keepdims=True))
        return top / top.sum(axis=1, keepdims=True)
    return raw


def gradients(objective: str, labels: np.ndarray, raw: np.ndarray, late_weight: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the raw score (rows x outputs)."""
    if objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-raw))
        return p - labels[:, None], np.maximum(p * (1.0 - p), 1e-6)
    if objective == "classes":
        p = finished(objective, False, raw, 0)
        return p - (labels[:, None] == np.arange(raw.shape[1])), np.maximum(p * (1.0 - p), 1e-6)
    if objective == "late":  # squared error of expm1 of both sides, dearer where the prediction is late; Gauss-Newton curvature
        slope = np.exp(np.clip(raw, -50.0, 50.0))
        error = np.expm1(np.clip(raw, -50.0, 50.0)) - np.expm1(labels)[:, None]
        weight = np.where(error > 0, late_weight, 1.0)
        return 2.0 * weight * error * slope, np.maximum(2.0 * weight * slope * slope, 1e-6)
    return raw - labels[:, None], np.ones_like(raw)


def _hashed(ids: np.ndarray, *salts: int) -> np.ndarray:
    """53 bits from row numbers: the same wherever the row lies."""
    h = ids.astype(np.uint64)
    for salt in salts:
        h += np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    h >>= np.uint64(11)
    return h


def spread(ids: np.ndarray, *salts: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row numbers: the same wherever the row lies."""
    return _hashed(ids, *salts) / float(1 << 53)


#: Chances of at most 0, 1, 2, ... draws of a row with replacement.
_DRAWS = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
_DRAW_BITS = [np.uint64(np.ceil(d * float(1 << 53))) for d in _DRAWS]


def steps(n: int, size: int) -> list[slice]:
    return [slice(a, min(a + size, n)) for a in range(0, n, size)]


def twins(codes: np.ndarray, room: Room | None = None) -> np.ndarray:
    """For each line of ``codes`` the first with the same bins: a count and its rate have the same ones, so they are summed once."""
    found: dict[bytes, int] = {}

    def digest(line: np.ndarray) -> bytes:
        out = hashlib.blake2b()
        for s in steps(len(line), 1 << 20):
            out.update(line[s])
            (room or Room()).rest()
        return out.digest()

    return np.array([found.setdefault(digest(line), k) for k, line in enumerate(codes)], np.int64)


class _Rows:
    """What a model keeps of the shard's rows: those from ``lo`` to ``hi``, outside which none trains or is scored."""

    def __init__(self, work: Work, codes: np.ndarray, ids: np.ndarray, same: np.ndarray, room: Room | None = None):
        self.same, self.room = same, room or Room()
        trains, first, last = self.room.empty((len(ids),), bool), len(ids), 0
        for s in steps(len(ids), CHUNK):
            np.logical_not(np.isnan(work.labels[s]), out=trains[s])
            used = np.flatnonzero(trains[s] | work.active[s]) if work.active is not None else ()
            if len(used):
                first, last = min(first, s.start + int(used[0])), s.start + int(used[-1]) + 1
            self.room.rest()
        self.lo, self.hi = (0, len(ids)) if work.active is None else (first, last) if last else (0, 0)
        part = slice(self.lo, self.hi)
        self.trains, self.ids, self.codes, self.whole = trains[part], ids[part], codes[:, part], codes
        self.n = self.hi - self.lo
        self.y, labels, weight, ones = self.room.empty((self.n,), float), work.labels[part], None if work.weights is None else work.weights[part], True
        for s in self.steps(CHUNK):
            self.y[s] = np.where(self.trains[s], labels[s], 0.0)
            ones = ones and (weight is None or bool((weight[s][self.trains[s]] == 1.0).all()))
            self.room.rest()
        self.weight = None if ones else weight
        self.bins: np.ndarray | None = None
        self.drops: np.ndarray | None = None  # labels on the gradient grid, below zero

    def steps(self, size: int) -> list[slice]:
        return steps(self.n, size)

    def totals(self, work: Work) -> np.ndarray:
        parts = np.zeros((1, work.classes if work.objective == "classes" else 2))
        for s in self.steps(CHUNK if self.room.folder else max(self.n, 1)):
            trains, y, weight = self.trains[s], self.y[s], np.ones(s.stop - s.start) if self.weight is None else self.weight[s]
            if work.objective == "classes":
                parts += [[weight[trains & (y == k)].sum() for k in range(work.classes)]]
            else:
                parts += [[(weight[trains] * y[trains]).sum(), weight[trains].sum()]]
            self.room.rest()
        return np.rint(parts * GRID) / GRID


class _Draws:
    """What the steps draw of the shard's rows. Models with the same seed and way draw the same: it is found once for all of them."""

    def __init__(self, ids: np.ndarray, works: list[Work], room: Room):
        self.ids, self.room, self.users, self.held = ids, room, {}, {}
        for w in works:
            self.users[self._way(w.size)] = self.users.get(self._way(w.size), 0) + 1

    @staticmethod
    def _way(size: Size) -> tuple:
        return size.seed, None if size.bagged else size.row_share

    def of(self, size: Size, number: int, lo: int, hi: int) -> np.ndarray:
        """Of the rows from ``lo`` to ``hi``: how often a forest's tree draws each, or whether a step does."""
        way = self._way(size)
        before = self.held.setdefault(way, {})
        if self.users[way] == 1:
            if not before:
                before[0] = self.room.empty((hi - lo,), np.uint8 if size.bagged else bool)
            return self._drawn(size, number, self.ids[lo:hi], before[0])
        if number not in before:
            for old in [k for k in before if k < number - 1]:  # the groups are a step apart at most
                self.room.back(before.pop(old))
            before[number] = self._drawn(size, number, self.ids, self.room.empty((len(self.ids),), np.uint8 if size.bagged else bool))
        return before[number][lo:hi]

    def _drawn(self, size: Size, number: int, ids: np.ndarray, out: np.ndarray) -> np.ndarray:
        limit = np.uint64(np.ceil(min(size.row_share, 1.0) * float(1 << 53)))
        for a in range(0, len(out), CHUNK):
            at, part = _hashed(ids[a:a + CHUNK], size.seed, number), out[a:a + CHUNK]
            if size.bagged:
                part[:] = 0
                for bits in _DRAW_BITS:
                    part += (at >= bits).view(np.uint8)
            else:
                np.less(at, limit, out=part)
            self.room.rest()
        return out


class _Tree:
    """A tree that grows: gradients of its rows, and the node of every row of its model."""

    def __init__(self, work: Work, number: int, output: int, rows: _Rows, mask: np.ndarray, g: np.ndarray, h: np.ndarray | None):
        """``mask`` says which rows it learns from; ``g`` (in steps of the grid) and ``h`` are zero in the others; no ``h`` means one for each."""
        features = len(rows.codes)
        rng = np.random.default_rng((work.size.seed, number))
        take = max(1, round(work.size.column_share * features))
        self.columns = np.sort(rng.choice(features, take, replace=False)) if take < features else np.arange(features)
        # one column of each group of twins, and the place of every column's group
        _, self.summed, self.group = np.unique(rows.same[self.columns], return_index=True, return_inverse=True)
        self.rng, self.size, self.output, self.rows, self.mask = rng, work.size, output, rows, mask
        self.l1, self.l2 = (0.0, 0.0) if work.size.bagged else (work.size.l1, work.size.l2)
        self.rate = 1.0 if work.size.bagged else work.size.rate
        self.node = rows.room.empty((rows.n,), np.uint8 if work.size.depth <= 7 else np.uint16 if work.size.depth <= 15 else np.int32)
        for s in rows.steps(CHUNK):
            self.node[s] = 0
            rows.room.rest()
        self.feature, self.cut, self.left, self.value = np.array([-1]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)
        self.wanted = np.array([0])  # nodes whose histograms are summed from rows
        self.others = np.zeros(0, np.int64)  # their siblings, by subtraction from the parents' sums
        self.grown = np.zeros(0, np.int64)  # nodes whose rows still have to move to the children
        self.held: np.ndarray | None = None
        self.g, self.h, self.scale = g, h, 0.0
        if h is None or h.dtype == np.uint8:
            self._pack()

    def _pack(self) -> None:
        """Whole h and gradients on the grid share one number, so that one sum adds both: exact while the sums of CHUNK rows fit."""
        most, count = 0.0, 0
        for s in self.rows.steps(CHUNK):
            most = max(most, float(np.abs(self.g[s]).sum()))
            count = max(count, int(np.count_nonzero(self.mask[s]) if self.h is None else self.h[s].sum(dtype=np.int64)))
            self.rows.room.rest()
        scale = 2.0 ** np.ceil(np.log2(2.0 * most + 2.0))
        if most < np.inf and count * scale + most < 2.0 ** 53:
            self.scale = scale
            for s in self.rows.steps(CHUNK):
                self.g[s] += self.mask[s] * scale if self.h is None else self.h[s] * scale
                self.rows.room.rest()
            self.rows.room.back(self.h)
            self.h = None
        else:
            whole, self.h = self.h, self.rows.room.empty((self.rows.n,), float)
            for s in self.rows.steps(CHUNK):
                self.h[s] = self.mask[s] if whole is None else whole[s]
                self.rows.room.rest()
            self.rows.room.back(whole)

    def histogram(self, bins: int) -> np.ndarray:
        """Sums of g and h by wanted node, column and bin, over the shard's rows, which move to the last split's children first."""
        width, root = len(self.summed), len(self.feature) == 1
        if self.size.depth == 0:
            width, bins = 1, 1
        cells = len(self.wanted) * bins
        wide = cells > CHUNK // 4  # many cells: longer stretches, so that clearing cells does not cost more than the rows
        slot = np.full(len(self.feature), -1)
        slot[self.wanted] = np.arange(len(self.wanted)) * bins
        move, packed = self._mover(), self.scale > 0.0
        out = np.zeros((2, width, cells))
        sums = np.empty((width, cells))
        for s in self.rows.steps(max(CHUNK, min(8 * cells, 1 << 20) // CHUNK * CHUNK) if wide else CHUNK):
            self.rows.room.rest()
            move(s)
            place_of = None if root else slot.take(self.node[s].astype(np.int64), mode="clip")
            picked = np.flatnonzero(self.mask[s] if root else np.logical_and(place_of >= 0, self.mask[s]))
            if not len(picked):
                continue
            everything = len(picked) == s.stop - s.start
            g = self.g[s] if everything else self.g[s].take(picked, mode="clip")
            h = None if packed else self.h[s] if everything else self.h[s].take(picked, mode="clip")
            if packed and wide:
                h = np.rint(g / self.scale)
                g = g - h * self.scale
            base = None if root else place_of.take(picked, mode="clip")
            for k in range(width):
                if bins == 1:
                    place = np.zeros(len(picked), np.int64)
                else:
                    column = self.rows.codes[self.columns[self.summed[k]], s]
                    place = column if everything else column.take(picked, mode="clip")
                    if base is not None:
                        place = base + place
                if h is None:
                    sums[k] = np.bincount(place, g, cells)
                else:
                    out[0, k] += np.bincount(place, g, cells)
                    out[1, k] += np.bincount(place, h, cells)
            if h is None:
                count = np.rint(sums / self.scale)
                out[1] += count
                sums -= count * self.scale
                out[0] += sums
        out[0] /= GRID
        self.grown = self.grown[:0]
        out = out.reshape(2, width, len(self.wanted), bins)
        if self.size.depth and width < len(self.columns):
            out = out[:, self.group]
        return np.ascontiguousarray(out.transpose(0, 2, 1, 3))

    def _mover(self) -> Callable[[slice], None]:
        """Moves the rows of a stretch from the grown nodes to their children."""
        grown, codes, kind = self.grown, self.rows.codes, self.node.dtype
        if len(grown) <= (8 if kind == np.uint8 else 4):  # a comparison per node
            steps = [(kind.type(j), self.feature[j], self.cut[j], (self.left[j] - j).astype(kind)) for j in grown]

            def few(s: slice) -> None:
                node = self.node[s]
                for j, feature, cut, shift in steps:
                    here = (node == j).view(np.uint8)
                    child = (codes[feature, s] > cut).view(np.uint8).astype(kind, copy=False)
                    child += shift
                    child *= here
                    node += child

            return few
        offset, cut, left = np.zeros(len(self.feature), np.int64), np.full(len(self.feature), 255, np.uint8), np.arange(len(self.feature))
        flat = self.rows.whole.reshape(-1)
        offset[grown], cut[grown], left[grown] = self.feature[grown] * self.rows.whole.shape[1] + self.rows.lo, self.cut[grown], self.left[grown]

        def many(s: slice) -> None:
            node = self.node[s].astype(np.int64)
            at = offset.take(node, mode="clip")
            at += np.arange(s.start, s.stop)
            above = flat.take(at, mode="clip") > cut.take(node, mode="clip")
            child = left.take(node, mode="clip")
            child += above
            self.node[s] = child

        return many

    def _score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        kept = np.abs(g)
        kept -= self.l1
        kept = np.maximum(kept, 0.0)
        kept *= kept
        weight = h + self.l2
        weight += 1e-300
        kept /= weight
        return kept

    def _weight(self, total: np.ndarray) -> np.ndarray:
        return -np.sign(total[0]) * np.maximum(np.abs(total[0]) - self.l1, 0.0) / (total[1] + self.l2 + 1e-300) * self.rate

    def split(self, sums: np.ndarray, gains: np.ndarray, last: bool) -> None:
        """Best split of each node of the level; the children of the ``last`` split stay leaves, with the sums of its two sides."""
        nodes = np.concatenate([self.wanted, self.others])
        if len(self.others):  # each parent's sums were kept in the order of its children
            sums = np.concatenate([sums, self.held - sums], axis=1)
        total = sums[:, :, 0, :].sum(axis=2)
        self.value[nodes] = self._weight(total)
        self.wanted = self.others = np.zeros(0, np.int64)
        if self.size.depth == 0:
            return
        barred = None
        if self.size.node_columns < 1.0:
            width = len(self.columns)
            draw = self.rng.random((len(nodes), width))
            keep = max(1, round(self.size.node_columns * width))
            barred = draw > np.partition(draw, keep - 1, axis=1)[:, keep - 1:keep]
        best, top, low = np.empty(len(nodes), np.int64), np.empty(len(nodes)), np.empty((2, len(nodes)))
        for s in steps(len(nodes), max(CELLS // (sums.shape[2] * sums.shape[3]), 1)):
            best[s], top[s], low[:, s] = self._best(sums[:, s], total[:, s], None if barred is None else barred[s])
        grown = np.flatnonzero(top > max(2.0 * (0.0 if self.size.bagged else self.size.gain), 1e-9))
        column, cut = np.divmod(best[grown], sums.shape[3])
        node, child = nodes[grown], len(self.feature) + 2 * np.arange(len(grown))
        self.feature[node], self.cut[node], self.left[node] = self.columns[column], cut, child
        np.add.at(gains, self.columns[column], top[grown])
        below = low[:, grown]
        above = total[:, grown] - below
        more = 2 * len(grown)
        self.feature = np.concatenate([self.feature, np.full(more, -1)])
        self.cut, self.left, self.value = (np.concatenate([v, np.zeros(more, v.dtype)]) for v in (self.cut, self.left, self.value))
        self.grown = node
        if last:
            self.value[child], self.value[child + 1], self.held = self._weight(below), self._weight(above), None
            return
        lighter = below[1] <= above[1]
        self.held, self.wanted, self.others = sums[:, grown], np.where(lighter, child, child + 1), np.where(lighter, child + 1, child)

    def _best(self, sums: np.ndarray, total: np.ndarray, barred: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some nodes the first best place among columns and bins, its gain, and the sums below the cut."""
        left = np.cumsum(sums, axis=3)
        right = total[:, :, None, None] - left
        gain = self._score(left[0], left[1])
        gain += self._score(right[0], right[1])
        gain -= self._score(*total)[:, None, None]
        gain[(left[1] < self.size.least) | (right[1] < self.size.least)] = -np.inf
        if barred is not None:
            gain[barred] = -np.inf
        best = gain.reshape(len(gain), -1).argmax(axis=1)
        node, (column, cut) = np.arange(len(gain)), np.divmod(best, sums.shape[3])
        return best, gain[node, column, cut], left[:, node, column, cut]

    def settle(self, scores: np.ndarray) -> None:
        """Rows reach their leaves, whose values are added to the model's scores."""
        move = self._mover()
        for s in self.rows.steps(CHUNK):
            move(s)
            scores[s, self.output] += self.value.take(self.node[s].astype(np.int64), mode="clip")
            self.rows.room.rest()
        self.rows.room.back(self.g, self.h)
        self.g = self.h = self.held = None

    def leave(self, others: list[_Tree]) -> None:
        """Nothing asks for the rows' nodes any more."""
        self.rows.room.back(self.node, None if self.mask is self.rows.trains or any(t.mask is self.mask for t in others) else self.mask)


def _later(add: Add, parts: list[np.ndarray]) -> Callable[[], list[np.ndarray]]:
    """Hands in the parts; their sums are asked for later, if ``add`` can wait."""
    return add.post(parts) if hasattr(add, "post") else lambda: add(parts)


def _grow(trees: list[_Tree], bins: int, add: Add, gains: list[np.ndarray]) -> Iterator[None]:
    """Grows level by level; yields where sums are on their way."""
    for level in range(max(max(t.size.depth for t in trees), 1)):
        open_ = [k for k, t in enumerate(trees) if len(t.wanted)]
        if not open_:
            return
        sums = _later(add, [trees[k].histogram(bins) for k in open_])
        yield
        for k, s in zip(open_, sums(), strict=True):
            trees[k].split(s, gains[k], level + 1 >= trees[k].size.depth)


def _bagged(work: Work, number: int, rows: _Rows, draws: _Draws) -> _Tree:
    """A tree of a forest: rows drawn with replacement."""
    room, drawn = rows.room, draws.of(work.size, number, rows.lo, rows.hi)
    mask, g, count = room.empty((rows.n,), bool), room.empty((rows.n,), float), room.empty((rows.n,), np.uint8)
    h = None if rows.weight is None else room.empty((rows.n,), float)
    if rows.drops is None:
        rows.drops = room.empty((rows.n,), float)
        for s in rows.steps(CHUNK):
            rows.drops[s] = -rows.y[s] * GRID
            room.rest()
    for s in rows.steps(CHUNK):
        room.rest()
        np.multiply(drawn[s], rows.trains[s].view(np.uint8), out=count[s])
        times = count[s] if h is None else count[s] * np.where(rows.trains[s], rows.weight[s], 0.0)
        np.greater(times, 0, out=mask[s])
        np.multiply(rows.drops[s], times, out=g[s])
        np.rint(g[s], out=g[s])
        if h is not None:
            h[s] = np.rint(times * GRID) / GRID * mask[s]
            g[s] *= mask[s]
    if h is not None:
        room.back(count)
    return _Tree(work, number, 0, rows, mask, g, count if h is None else h)


def _boosted(work: Work, step: int, rows: _Rows, scores: np.ndarray, draws: _Draws) -> list[_Tree]:
    """The trees of a round: one for each output."""
    outputs = scores.shape[1]
    whole = work.objective == "squared" and rows.weight is None
    mask = rows.trains
    if work.size.row_share < 1:
        mask, drawn = rows.room.empty((rows.n,), bool), draws.of(work.size, step, rows.lo, rows.hi)
    g = [rows.room.empty((rows.n,), float) for _ in range(outputs)]
    h = None if whole else [rows.room.empty((rows.n,), float) for _ in range(outputs)]
    for s in rows.steps(CHUNK):
        rows.room.rest()
        if work.size.row_share < 1:
            np.logical_and(drawn[s], rows.trains[s], out=mask[s])
        if whole:
            v = np.subtract(scores[s, 0], rows.y[s], out=g[0][s])
            v *= GRID
            np.rint(v, out=v)
            v *= mask[s]
            continue
        found = gradients(work.objective, rows.y[s], scores[s], work.late_weight)
        for target, values, unit in ((g, found[0], 1.0), (h, found[1], GRID)):
            for k in range(outputs):
                v = values[:, k] * GRID if rows.weight is None else values[:, k] * rows.weight[s] * GRID
                np.rint(v, out=v)
                if unit != 1.0:
                    v /= unit
                target[k][s] = np.where(mask[s], v, 0.0)
    return [_Tree(work, step * outputs + k, k, rows, mask, g[k], None if h is None else h[k]) for k in range(outputs)]


def fit(codes: np.ndarray, ids: np.ndarray, edges: list[np.ndarray], works: list[Work], add: Add = lambda parts: parts,
        together: int = 1, room: Room | None = None) -> list[tuple[Model, np.ndarray]]:
    """The models and their predictions of all rows of the shard, those included that do not train.

    ``codes`` are bin numbers (rows x features), ``ids`` row numbers that decide what is sampled. ``together`` trees of a forest
    grow side by side, for an ``add`` that costs more than the memory of their rows. ``room`` is where arrays of rows lie.
    """
    bins = max((len(e) for e in edges), default=0) + 1
    table = np.array([np.pad(e, (0, bins - len(e)), constant_values=np.inf) for e in edges]).reshape(len(edges), bins)
    n, features = codes.shape
    by_column = np.ascontiguousarray(codes.T)
    room = room or Room()
    same = twins(by_column, room) if room.folder else twins(by_column)
    state = [_Rows(w, by_column, ids, same, room) for w in works]
    models, scores, done = [], [], []
    for w, sums in zip(works, add([r.totals(w) for r, w in zip(state, works, strict=True)]), strict=True):
        if w.objective == "classes":
            share = sums[0] / max(sums[0].sum(), 1e-300)
            base = np.where(share > 0, np.log(np.maximum(share, 1e-300)), -np.inf)  # a class that no row has stays at 0
            constant = (share > 0).sum() < 2
        else:
            mean = float(sums[0, 0] / sums[0, 1]) if sums[0, 1] > 0 else 0.0
            constant = sums[0, 1] <= 0 or (w.objective == "logistic" and mean in (0.0, 1.0))
            if w.objective == "logistic":
                mean = (np.inf if mean else -np.inf) if constant else float(np.log(mean) - np.log(1.0 - mean))
            base = np.array([mean])
        bagged = w.size.bagged and not constant
        models.append(Model(w.objective, np.zeros(1) if bagged else base, gains=np.zeros(features), mean=bagged))
        scores.append(room.empty((n, len(base)), float))
        for s in steps(n, CHUNK):
            scores[-1][s] = models[-1].base
            room.rest()
        done.append(bool(constant))
    draws = _Draws(ids, works, room)

    def rounds(chosen: list[int]) -> Iterator[None]:
        for step in range(max((works[k].size.rounds for k in chosen), default=0)):
            trees, owner = [], []
            for k in chosen:
                w, rows = works[k], state[k]
                first = step * together if w.size.bagged else step
                if done[k] or first >= w.size.rounds:
                    continue
                part = [_bagged(w, number, rows, draws) for number in range(first, min(first + together, w.size.rounds))] if w.size.bagged \
                    else _boosted(w, step, rows, scores[k][rows.lo:rows.hi], draws)
                trees += part
                owner += [k] * len(part)
            if not trees:
                return
            yield from _grow(trees, bins, add, [models[k].gains for k in owner])
            for t, k in zip(trees, owner, strict=True):
                m = models[k]
                m.feature.append(t.feature.astype(np.int16))
                m.cut.append(np.where(t.feature >= 0, table[t.feature, np.minimum(t.cut, table.shape[1] - 1)], 0.0))
                m.left.append(t.left.astype(np.int32))
                m.value.append(t.value)
                m.output.append(t.output)
                t.settle(scores[k][state[k].lo:state[k].hi])
            yield from _count_leaves(trees, owner, works, state, models, add)
            for at, t in enumerate(trees):
                t.leave(trees[at + 1:])

    # two groups in turn: while the sums of one are on their way, the rows of the other are counted
    turns = [rounds(list(range(first, len(works), 2))) for first in (0, 1)]
    while turns:
        turns = [t for t in turns if next(t, turns) is not turns]
    for m, found in zip(models, scores, strict=True):
        for s in steps(n, CHUNK):
            found[s] = finished(m.objective, m.mean, found[s], len(m.feature))
            room.rest()
    for rows in state:
        room.back(rows.trains, rows.y, rows.bins, rows.drops)
    for found in draws.held.values():
        room.back(*found.values())
    return list(zip(models, scores, strict=True))


def _count_leaves(trees: list[_Tree], owner: list[int], works: list[Work], state: list[_Rows], models: list[Model], add: Add) -> Iterator[None]:
    """Training labels by leaf and bin, of the trees of this step whose model asks for it."""
    asked = [(t, k) for t, k in zip(trees, owner, strict=True) if works[k].leaf_edges is not None]
    if not asked:
        return
    parts = []
    for t, k in asked:
        rows, bins = state[k], len(works[k].leaf_edges) - 1
        if rows.bins is None:  # one cell behind all others takes the rows that do not train
            rows.bins = rows.room.empty((rows.n,), np.int32)
            for s in rows.steps(CHUNK):
                rows.bins[s] = np.where(rows.trains[s], label_bin(rows.y[s], works[k].leaf_edges), -1)
                rows.room.rest()
        cells = len(t.feature) * bins
        table = np.zeros(cells + 1)
        for s in rows.steps(max(CHUNK, 4 * cells)):
            place = t.node[s].astype(np.int64)
            place *= bins
            place += rows.bins[s]
            place[~rows.trains[s]] = cells
            rows.room.rest()
            table += np.bincount(place, None if rows.weight is None else np.rint(rows.weight[s] * rows.trains[s] * GRID) / GRID, cells + 1)
        parts.append(table[:-1].reshape(-1, bins))
    sums = _later(add, parts)
    yield
    for (t, k), table in zip(asked, sums(), strict=True):
        node, bin_ = np.nonzero(table)
        models[k].leaf_edges = works[k].leaf_edges
        models[k].counts.append(np.stack([node, bin_, table[node, bin_]], axis=1))


def label_bin(y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin below the first edge that is not smaller; the least value itself is in the first bin."""
    return np.clip(np.searchsorted(edges, y, "left") - 1, 0, len(edges) - 2)


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many edges are smaller than the value."""
    out = np.zeros(x.shape, np.uint8, order="F")
    for k, e in enumerate(edges):
        out[:, k] = np.searchsorted(e, x[:, k], "left")
    return out
