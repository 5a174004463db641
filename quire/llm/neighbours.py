"""The k most similar vectors of every vector, by navigable small-world graphs.

The vectors are divided into shards, each with a hierarchical small-world graph of its own: a level is drawn for every
vector (1/M of them reach the next one), the graph of a level is a flat array of neighbour numbers, and a search goes
down from the first level that is small enough to scan, keeping a beam of the best vectors met and opening the
neighbours of the best unopened ones until none is left in the beam. Vectors are inserted in batches that double the graph, so that all searches of a batch run
in lockstep as array operations; neighbours are chosen for diversity, with links back.

Shards are cells around centres, fitted on a bounded sample of vectors by hash: CELL_SAMPLE a cell, from ``SAMPLE`` up to
``SAMPLE_MOST``; many centres are fitted and looked up in two levels. Every vector is indexed in the shard of its nearest
centre. A cell that the sample shows to hold more than ``SHARD`` vectors, which happens to dense ones and to all beyond
SAMPLE_MOST / CELL_SAMPLE cells, is divided by hash into several shards. Each vector is then searched in all shards of
its ``probes`` nearest centres and the results merged. Vectors of a shard find each other while it is built; only guests
are searched for. Where the sample shows more than ``GUESTS`` guests for a shard, they are divided by hash, and each
division gets the shard's vectors: no task holds more than a shard and a division, however many vectors lie near one
centre. Shards are laid into tasks by the load that the sample shows, so that no task gets many by chance.

Similarity is cosine. Defined results: vectors that are null, of another length, all zero or not finite are not usable
and have no neighbours; a repeated key counts once; ties are by key; a vector is not its own neighbour, but another key
with the same vector is; with fewer than k others, all of them are given. Recall is tested against brute force.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.session import shuffle_width

SAMPLE, SAMPLE_MOST, CELL_SAMPLE = 20_000, 400_000, 8
SHARD, PROBES, GUESTS = 16_384, 3, 131_072
M, EF = 10, 12
#: The search of stated queries: degree, beams of building and of searching, and one in so many cells is visited, no fewer than SEARCH_PROBES.
SEARCH_M, SEARCH_BUILD, SEARCH_EF, SEARCH_SHARE, SEARCH_PROBES = 12, 24, 96, 2, 8
#: Unopened vectors of a beam opened at once.
OPEN = 3
#: A level of at most SCAN vectors is scanned whole for the ENTRIES best to go down from.
SCAN, ENTRIES = 2048, 4
#: The exact search: shards of CELL vectors, growing with the collection up to CELL_MOST, and as many of the nearest;
#: of more cells than 128, one in CELL_SHARE, so that those visited stay the same share of the collection.
CELL, CELL_MOST, CELL_PROBES, CELL_SHARE = 2048, 32_768, 16, 8


# ---- the graph of one shard


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first."""
    if ids.shape[1] > k:
        part = np.argpartition(sims, ids.shape[1] - k, axis=1)[:, -k:]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on one level for all rows of q in lockstep: ids and similarities of the ef best met (-1 where fewer). entry: starting numbers of each row, -1 for none."""
    out_ids = np.full((len(q), ef), -1, np.int32)
    out_sims = np.full((len(q), ef), -np.inf, np.float32)
    n = len(x)
    step = max(64, min(step, 8_000_000 // max(n, 1)))
    for low in range(0, len(q), step):
        own, start = q[low : low + step], entry[low : low + step]
        b = len(own)
        seen = np.zeros(b * n, np.int32)
        rows, cols = np.nonzero(start >= 0)
        flat = start[rows, cols].astype(np.int64)
        first = np.full(start.shape, -np.inf, np.float32)
        first[rows, cols] = np.einsum("ij,ij->i", own[rows], x[flat])
        seen[rows * n + flat] = 1
        ids, sims = _top(start.astype(np.int32), first, ef)
        if ids.shape[1] < ef:
            pad = ef - ids.shape[1]
            ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
        opened = ids < 0
        alive = np.arange(b)
        while len(alive):
            i, s, o = ids[alive], sims[alive], opened[alive]
            pick = np.argsort(o, axis=1, kind="stable")[:, :OPEN]  # the best unopened, as rows are sorted
            fresh = ~np.take_along_axis(o, pick, 1)
            nodes = np.where(fresh, np.take_along_axis(i, pick, 1), 0)
            np.put_along_axis(o, pick, True, 1)
            near = np.where(fresh[:, :, None], links[nodes], -1).reshape(len(alive), -1)
            rows, cols = np.nonzero(near >= 0)
            flat = near[rows, cols].astype(np.int64)
            at = alive[rows] * n + flat
            new = seen[at] == 0
            rows, cols, flat, at = rows[new], cols[new], flat[new], at[new]
            stamp = np.arange(1, len(at) + 1, dtype=np.int32)
            seen[at] = stamp
            one = seen[at] == stamp  # of a vector met twice at once, the last
            rows, cols, flat = rows[one], cols[one], flat[one]
            more = np.full(near.shape, -np.inf, np.float32)
            more[rows, cols] = np.einsum("ij,ij->i", own[alive[rows]], x[flat])
            near[more == -np.inf] = -1
            every, scores, known = np.concatenate([i, near], 1), np.concatenate([s, more], 1), np.concatenate([o, near < 0], 1)
            part = np.argpartition(scores, scores.shape[1] - ef, axis=1)[:, -ef:]
            order = np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1), 1)
            ids[alive], sims[alive], opened[alive] = (np.take_along_axis(a, order, 1) for a in (every, scores, known))
            alive = alive[~opened[alive].all(1)]
        out_ids[low : low + b], out_sims[low : low + b] = ids, sims
    return out_ids, out_sims


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) at most ``most`` that are nearer to the row than to one chosen before; free places go to the best of the rest."""
    b, k = ids.shape
    near = x[np.maximum(ids, 0)]
    among = near @ near.transpose(0, 2, 1)
    chosen = np.zeros((b, k), bool)
    closest = np.full((b, k), -np.inf, np.float32)  # similarity of each candidate to the nearest chosen one
    count = np.zeros(b, np.int64)
    for r in range(k):
        take = (ids[:, r] >= 0) & (closest[:, r] < sims[:, r]) & (count < most)
        chosen[:, r] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, among[:, r]), closest)
    rank = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, rank, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


class Graph:
    """Levels as flat arrays of neighbour numbers. Vectors are numbered so that higher levels come first: level l is the first size[l] vectors."""

    def __init__(self, x: np.ndarray, m: int = M, ef: int = EF, keep: int = 10, seed: int = 7) -> None:
        n = len(x)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x, self.m, self.ef = np.ascontiguousarray(x[self.order]), m, ef
        top = int(level.max()) if n else 0
        self.sizes = [int((level >= l).sum()) for l in range(top + 1)]
        # the first level that is small enough is scanned whole, so no level from there on needs links
        self.top = next((l for l, size in enumerate(self.sizes) if l and size <= SCAN), top + 1)
        self.links = [np.full((s, 2 * m if l == 0 else m), -1, np.int32) for l, s in enumerate(self.sizes[: self.top])]
        self.best_ids, self.best_sims = np.full((n, keep), -1, np.int32), np.full((n, keep), -np.inf, np.float32)
        done = min(n, 1)
        while done < n:
            high = min(n, done + max(16, min(done, 2048)))
            self._insert(done, high)
            done = high

    def _descend(self, q: np.ndarray, built: int, to: int) -> np.ndarray:
        size = min(self.sizes[self.top], built) if self.top < len(self.sizes) else 0
        if size > 1:
            entry = np.empty((len(q), min(ENTRIES, size)), np.int32)
            for low in range(0, len(q), 2048):
                sims = q[low : low + 2048] @ self.x[:size].T
                entry[low : low + 2048] = np.argpartition(sims, size - entry.shape[1], axis=1)[:, size - entry.shape[1] :]
        else:
            entry = np.zeros((len(q), 1), np.int32)
        for l in range(self.top - 1, to, -1):
            size = min(self.sizes[l], built)
            if size > 1:
                entry = walk(self.x[:size], self.links[l][:size], q, entry, 4)[0]
        return entry

    def _insert(self, low: int, high: int) -> None:
        for l in range(self.top):  # upwards, as the way down leads over levels without the batch
            top = min(high, self.sizes[l])
            if low >= top:
                continue
            own = np.arange(low, top)
            q = self.x[low:top]
            ids, sims = walk(self.x[:low], self.links[l][:low], q, self._descend(q, low, l), self.ef)
            # the batch's own members, which the graph does not have yet
            k = min(self.ef, len(own) - 1)
            if k > 0:
                mutual = q @ q.T
                np.fill_diagonal(mutual, -np.inf)
                part = np.argpartition(mutual, len(own) - k, axis=1)[:, -k:]
                ids, sims = np.concatenate([ids, (part + low).astype(np.int32)], 1), np.concatenate([sims, np.take_along_axis(mutual, part, 1)], 1)
            ids, sims = _top(ids, sims, self.ef)
            if l == 0:
                self._remember(np.repeat(own, ids.shape[1]), ids.ravel(), sims.ravel())
            links = self.links[l]
            for a in range(0, len(own), 512):
                part = slice(a, min(a + 512, len(own)))
                links[low + part.start : low + part.stop, : self.m] = diverse(self.x, ids[part], sims[part], self.m)
            self._back(links, low, top)

    def _back(self, links: np.ndarray, low: int, high: int) -> None:
        """Links back from the neighbours of low..high."""
        src = np.repeat(np.arange(low, high), links.shape[1])
        dst = links[low:high].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sims = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-sims, dst))
        src, dst = src[order], dst[order]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = links.shape[1]
        place = np.arange(len(dst)) - np.repeat(first, count)
        keep = place < width
        new = np.full((len(node), min(width, int(count.max()) if len(count) else 0)), -1, np.int32)
        new[np.repeat(np.arange(len(node)), count)[keep], place[keep]] = src[keep]
        for a in range(0, len(node), 512):
            at = node[a : a + 512]
            every = np.concatenate([links[at], new[a : a + 512]], 1)
            sims = np.where(every >= 0, np.einsum("ij,ikj->ik", self.x[at], self.x[np.maximum(every, 0)]), -np.inf).astype(np.float32)
            by = np.argsort(every, axis=1, kind="stable")  # a link may be there already
            twice = np.zeros(every.shape, bool)
            ordered = np.take_along_axis(every, by, 1)
            np.put_along_axis(twice, by[:, 1:], (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0), 1)
            every, sims = np.where(twice, -1, every), np.where(twice, -np.inf, sims)
            full = (every >= 0).sum(1) > width
            ids, scores = _top(every, sims, every.shape[1])
            out = ids[:, :width].copy()
            if full.any():
                out[full] = diverse(self.x, ids[full], scores[full], width)
            links[at] = out

    def _remember(self, a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> None:
        """Pairs met, for both."""
        ok = b >= 0
        a, b, sims = a[ok], b[ok], sims[ok]
        # the batch's mutual pairs stand there from both sides, the others need their mirror image
        low = a.min() if len(a) else 0
        old = b < low
        src, dst, s = np.concatenate([a, b[old]]), np.concatenate([b, a[old]]), np.concatenate([sims, sims[old]])
        keep = self.best_ids.shape[1]
        better = s > self.best_sims[src, -1]
        src, dst, s = src[better], dst[better], s[better]
        order = np.lexsort((-s, src))
        src, dst, s = src[order], dst[order], s[order]
        node, first, count = np.unique(src, return_index=True, return_counts=True)
        place = np.arange(len(src)) - np.repeat(first, count)
        row = np.repeat(np.arange(len(node)), count)
        fit = place < keep
        ids, sims = np.full((len(node), keep), -1, np.int32), np.full((len(node), keep), -np.inf, np.float32)
        ids[row[fit], place[fit]], sims[row[fit], place[fit]] = dst[fit], s[fit]
        self.best_ids[node], self.best_sims[node] = _top(np.concatenate([self.best_ids[node], ids], 1), np.concatenate([self.best_sims[node], sims], 1), keep)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of the graph's own vectors, by their numbers in the input."""
        ids, sims = np.full_like(self.best_ids, -1), np.full_like(self.best_sims, -np.inf)
        ids[self.order] = np.where(self.best_ids >= 0, self.order[np.maximum(self.best_ids, 0)], -1)
        sims[self.order] = self.best_sims
        return ids, sims

    def query(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best for each row of q, by numbers in the input."""
        if not len(self.x):
            return np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        ids, sims = walk(self.x, self.links[0], q, self._descend(q, len(self.x), 0), max(k, ef))
        return np.where(ids[:, :k] >= 0, self.order[np.maximum(ids[:, :k], 0)], -1), sims[:, :k]


# ---- shards

#: Centres are looked up in two levels beyond FLAT, in the TOPS nearest of the upper one.
FLAT, TOPS = 2048, 24


def centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    c = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[low : low + 8192] @ c.T, axis=1) for low in range(0, len(sample), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c.astype(np.float32)


class Centres:
    """Centres of cells; many of them in two levels, the lower ones fitted to the part of the sample that each upper one has."""

    def __init__(self, sample: np.ndarray, cells: int, flat: int = FLAT) -> None:
        if cells <= flat:
            self.tops, self.groups = None, [np.arange(cells)]
            self.all = centres(sample, cells) if cells else np.empty((0, sample.shape[1]), np.float32)
            return
        self.tops = centres(sample, math.ceil(math.sqrt(cells)))
        near = np.concatenate([np.argmax(sample[low : low + 8192] @ self.tops.T, axis=1) for low in range(0, len(sample), 8192)])
        lower, self.groups, n = [], [], 0
        for t in range(len(self.tops)):
            own = sample[near == t]
            if len(own):
                lower.append(centres(own, max(1, min(len(own), round(cells * len(own) / len(sample))))))
                self.groups.append(np.arange(n, n + len(lower[-1])))
                n += len(lower[-1])
            else:
                self.groups.append(np.arange(0))
        self.all = np.concatenate(lower)

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the k nearest centres of each row, nearest first."""
        k = min(k, len(self.all))
        out = np.empty((len(x), k), np.int64)
        for low in range(0, len(x), 4096):
            out[low : low + 4096] = self._nearest(x[low : low + 4096], k)
        return out

    def _nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        if self.tops is None:
            ids, sims = np.broadcast_to(self.groups[0], (len(x), len(self.all))), x @ self.all.T
            return _top(ids, sims, k)[0]
        sims = x @ self.tops.T
        # as many upper centres as k cells may lie in
        wide = min(len(self.tops), max(TOPS, math.ceil(2 * k * len(self.tops) / len(self.all))))
        tops = np.argpartition(sims, sims.shape[1] - wide, axis=1)[:, -wide:]
        width = max(len(g) for g in self.groups)
        ids, scores = np.full((len(x), wide * width), -1, np.int64), np.full((len(x), wide * width), -np.inf, np.float32)
        for t in np.unique(tops):
            rows, place = np.nonzero(tops == t)
            g = self.groups[t]
            if len(g):
                at = (place * width)[:, None] + np.arange(len(g))
                ids[rows[:, None], at], scores[rows[:, None], at] = g, x[rows] @ self.all[g].T
        best = _top(ids, scores, k)[0]
        if (best < 0).any():  # fewer cells under these upper centres than asked for
            short = np.flatnonzero((best < 0).any(1))
            best[short] = _top(np.broadcast_to(np.arange(len(self.all)), (len(short), len(self.all))), x[short] @ self.all.T, k)[0]
        return best


def unit(values: pa.Array, length: int) -> np.ndarray:
    flat = values.flatten() if isinstance(values, pa.ListArray) else values
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, length)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(df: DataFrame, key: str, vector: str, length: int, asked: Column | None = None) -> DataFrame:
    """key, vec, asked of usable vectors; a key stands as often as it was delivered."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("vec"), (F.lit(False) if asked is None else F.coalesce(asked, F.lit(False))).alias("asked")).where("key is not null and vec is not null")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where((F.size("vec") == length) & finite & F.exists("vec", lambda v: v != 0))


_NOTHING = np.empty(0, np.int64)
_FOUND_SCHEMA = "key string, neighbour string, similarity float"


@dataclass
class Plan:
    """Where vectors go: cells by their centres, the shards of each cell, the divisions of its guests, and the task of each shard."""

    centres: Centres
    visits: int
    parts: np.ndarray
    divisions: np.ndarray
    first: np.ndarray
    task: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, count: int, cells: int, visits: int, shard: int, guests: int, asked: float, tasks: int) -> Plan:
        """asked: the share of vectors that are searched in the cells they visit."""
        c = Centres(sample, cells)
        cells = len(c.all)
        visits = min(visits, cells)
        near = c.nearest(sample, visits)
        held = np.bincount(near[:, 0], minlength=cells) / len(sample) * count
        visited = np.bincount(near.ravel(), minlength=cells) / len(sample) * count * asked
        parts = np.maximum(1, np.ceil(held / shard)).astype(np.int64)
        divisions = np.maximum(1, np.ceil((visited - held / parts * (asked == 1)) / guests)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(parts * divisions)])
        load = np.repeat(held / parts + visited / divisions, parts * divisions)
        task, filled = np.empty(len(load), np.int32), [(0.0, t) for t in range(min(tasks, len(load)))]
        for s in np.argsort(-load):  # the heaviest first, into the lightest task
            weight, t = heapq.heappop(filled)
            task[s] = t
            heapq.heappush(filled, (weight + float(load[s]) + 1, t))
        return Plan(c, visits, parts, divisions, first, task)

    def route(self, length: int, every: bool):
        """Rows (task, shard, key, vec, home) of (key, vec, asked, spread): at home, and as guests: with ``every`` each in the other shards it visits, else the asked ones in all they visit."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, divisions, first = self.parts, self.divisions, self.first
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = self.centres.nearest(unit(batch.column(1), length), self.visits)
                asked, spread = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
                rows, shards, home = [], [], []

                def send(at: np.ndarray, to: np.ndarray, own: bool, rows=rows, shards=shards, home=home) -> None:
                    rows.append(at)
                    shards.append(to)
                    home.append(np.full(len(at), own))

                for j in range(near.shape[1]):
                    cell = near[:, j]
                    for p in range(int(parts[cell].max())):
                        there = parts[cell] > p
                        lives = there & (j == 0) & (spread % parts[cell] == p)
                        guest = np.flatnonzero(there & ~lives if every else there & asked)
                        c = cell[guest]
                        send(guest, first[c] + p * divisions[c] + spread[guest] // parts[c] % divisions[c], False)
                        for d in range(int(divisions[cell[lives]].max()) if lives.any() else 0):
                            each = np.flatnonzero(lives & (divisions[cell] > d))
                            send(each, first[cell[each]] + p * divisions[cell[each]] + d, True)
                rows, shards, home = np.concatenate(rows), np.concatenate(shards), np.concatenate(home)
                for low in range(0, len(rows), 50_000):
                    part = slice(low, low + 50_000)
                    take = pa.array(rows[part])
                    yield pa.RecordBatch.from_arrays([pa.array(self.task[shards[part]]), pa.array(shards[part].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(home[part])], names=["task", "shard", "key", "vec", "home"])

        return run

    def leads(self) -> set[int]:
        """The division of each shard that gives the shard's own neighbours."""
        return {int(self.first[c] + p * self.divisions[c]) for c in range(len(self.parts)) for p in range(int(self.parts[c]))}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, from rows sorted by shard; one shard is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        low, ids = 0, batch.column(0).to_numpy()
        for cut in [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]:
            if cut > low:
                if held and held[0].column(0)[0].as_py() != int(ids[low]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(low, cut - low))
                low = cut
    if held:
        yield pa.Table.from_batches(held)


def _found(keys: pa.Array, src: np.ndarray, dst: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.take(pa.array(src)), keys.take(pa.array(dst)), pa.array(sims.astype(np.float32))], names=["key", "neighbour", "similarity"])


def _scan(x: np.ndarray, own: np.ndarray, asking: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 nearest of own for each of asking, by comparing with all."""
    home, out = x[own], [(_NOTHING, _NOTHING, np.empty(0, np.float32))]
    for low in range(0, len(asking), 1024):
        these = asking[low : low + 1024]
        sims = x[these] @ home.T
        width = min(k + 1, len(own))  # one may be the vector itself
        part = np.argpartition(sims, len(own) - width, axis=1)[:, -width:]
        out.append((np.repeat(these, width), own[part.ravel()], np.take_along_axis(sims, part, 1).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _graph(x: np.ndarray, own: np.ndarray, asking: np.ndarray, k: int, leads: bool, m: int, build: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of own for each of asking, and (leads) those of own for own, by a graph of own."""
    index = Graph(x[own], m=m, ef=build, keep=k)
    out = [(_NOTHING, _NOTHING, np.empty(0, np.float32))]
    if leads:
        ids, sims = index.own()
        out.append((np.repeat(own, ids.shape[1]), ids.ravel(), sims.ravel()))
    if len(asking):
        ids, sims = index.query(x[asking], k + 1, ef)  # one may be the vector itself
        out.append((np.repeat(asking, ids.shape[1]), ids.ravel(), sims.ravel()))
    src, dst, sims = (np.concatenate(c) for c in zip(*out, strict=True))
    good = dst >= 0
    return src[good], own[dst[good]], sims[good]


def _near(df: DataFrame, find, *, key: str, vector: str, length: int, k: int, shard: int, visits, sample: int, guests: int, least: float, asked: Column | None = None) -> DataFrame:
    """Routes all vectors, applies find(x, own, others, leads) to each shard and merges what it gives. visits: of the number of cells, how many are visited."""
    vectors = usable(df, key, vector, length, asked)
    count, questions = vectors.agg(F.count("*"), F.count_if("asked")).first()
    spark = df.sparkSession
    if not count or asked is not None and not questions:
        return spark.createDataFrame([], _FOUND_SCHEMA)
    cells = max(1, math.ceil(count / shard * 2))
    size = min(max(sample, cells * CELL_SAMPLE), SAMPLE_MOST)
    # a share of the keys by hash first, half as many again as are wanted, so that few rows go to the task that takes them
    share = min(1 << 30, math.ceil((1 << 30) * 1.5 * size / count))
    few = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share)
    taken = few.orderBy(F.xxhash64("key"), "key").limit(size).select("vec").toArrow()
    fitted = unit(taken.column("vec").combine_chunks(), length)
    cells = min(cells, math.ceil(len(fitted) / CELL_SAMPLE))
    width = max(4 * shuffle_width(spark), spark.sparkContext.defaultParallelism)
    plan = Plan.fit(fitted, count, cells, visits(cells), shard, guests, 1.0 if asked is None else questions / count, width)
    lead, every = plan.leads(), asked is None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            # repeated rows of a key take the same ways, so each shard can drop them by itself; as its own and as a guest it stands for two
            at_home = rows.column("home").to_numpy()
            number = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) * 2 + at_home
            rows = rows.take(pa.array(np.unique(number, return_index=True)[1]))
            keys, x, home = rows.column("key").combine_chunks(), unit(rows.column("vec").combine_chunks(), length), rows.column("home").to_numpy()
            own, others = np.flatnonzero(home), np.flatnonzero(~home)
            if not len(own):
                continue
            src, dst, sims = find(x, own, others, every and int(rows.column("shard")[0].as_py()) in lead)
            good = sims >= least
            yield _found(keys, src[good], dst[good], sims[good])

    routed = vectors.select("key", "vec", "asked", F.abs(F.xxhash64("key") % 65_536).alias("spread")).mapInArrow(plan.route(length, every), "task int, shard int, key string, vec array<float>, home boolean")
    laid = routed.repartitionById(int(plan.task.max()) + 1, "task").select("shard", "key", "vec", "home").sortWithinPartitions("shard")
    found = laid.mapInArrow(each, _FOUND_SCHEMA).where("key <> neighbour")
    best = found.groupBy("key").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("far"), "neighbour"))), 1, k).alias("best"))
    return best.select("key", F.explode("best").alias("b")).select("key", F.col("b.neighbour").alias("neighbour"), (-F.col("b.far")).alias("similarity"))


def similar(df: DataFrame, *, key: str = "chunk_id", vector: str = "vector_values", length: int = 64, k: int = 10, probes: int = PROBES, shard: int = SHARD, ef: int = EF, least: float = -2.0, sample: int = SAMPLE, guests: int = GUESTS) -> DataFrame:
    """key, neighbour, similarity: the k most similar other keys of every usable vector, those of at least ``least``, by small-world graphs.

    The defaults are made for pairs of high similarity: of the ten nearest, whatever their similarity, they find 0.56
    over check_l (see README). search() finds more, for stated queries.
    """

    def find(x: np.ndarray, own: np.ndarray, others: np.ndarray, leads: bool):
        return _graph(x, own, others, k, leads, M, ef, ef)

    return _near(df, find, key=key, vector=vector, length=length, k=k, shard=shard, visits=lambda cells: probes, sample=sample, guests=guests, least=least)


def search(df: DataFrame, asked: Column, *, key: str = "chunk_id", vector: str = "vector_values", length: int = 64, k: int = 10, shard: int = SHARD, probes: int = SEARCH_PROBES, share: int = SEARCH_SHARE, m: int = SEARCH_M, build: int = SEARCH_BUILD, ef: int = SEARCH_EF, least: float = -2.0, sample: int = SAMPLE, guests: int = GUESTS) -> DataFrame:
    """key, neighbour, similarity: the k most similar of all other keys for the usable vectors of rows that are ``asked``, by small-world graphs of better build and wider beam.

    Every vector is indexed, once; only the asked ones travel further, to one in ``share`` cells, so recall does not fall
    as the cells grow in number. Recall of the ten nearest is at least 0.9, by test.
    """

    def find(x: np.ndarray, own: np.ndarray, others: np.ndarray, leads: bool):
        return _graph(x, own, others, k, False, m, build, ef) if len(others) else (_NOTHING, _NOTHING, np.empty(0, np.float32))

    return _near(df, find, key=key, vector=vector, length=length, k=k, shard=shard, visits=lambda cells: max(probes, math.ceil(cells / share)), sample=sample, guests=guests, least=least, asked=asked)


def exact(df: DataFrame, *, key: str = "chunk_id", vector: str = "vector_values", length: int = 64, k: int = 10, probes: int = CELL_PROBES, share: int = CELL_SHARE, cell: int = CELL, least: float = -2.0, sample: int = SAMPLE, guests: int = GUESTS) -> DataFrame:
    """key, neighbour, similarity like similar(), by comparing with every vector of the shards visited, which finds more of the vectors that are similar to no one in particular.

    Shards grow with the collection from ``cell`` up to CELL_MOST; at least one in ``share`` is visited, so recall does
    not fall as they grow in number.
    """
    count = usable(df, key, vector, length).count()

    def find(x: np.ndarray, own: np.ndarray, others: np.ndarray, leads: bool):
        return _scan(x, own, np.arange(len(x)) if leads else others, k)

    return _near(df, find, key=key, vector=vector, length=length, k=k, shard=max(cell, min(CELL_MOST, math.ceil(count / 64))), visits=lambda cells: max(probes, math.ceil(cells / share)), sample=sample, guests=guests, least=least)
