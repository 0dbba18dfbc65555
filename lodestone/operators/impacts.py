"""Sizes of impacts within one task: strongly connected components, then bit sets over what no heavy component explains.

Everything here works on arrays of numbers; ``graph.impact_sizes`` brings the edges and takes what is too wide for a task.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: 64-bit words of reach sets that the task holds at a time, and all those of a part that it works out itself.
CHUNK_WORDS, PART_WORDS = 1 << 22, 1 << 28
FIELDS = ("id", "n", "up", "comp", "own")
SCHEMA = ", ".join(f"{x} bigint" for x in FIELDS)


def numbers(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, places of src, places of dst)."""
    ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
    return ids, np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32)


class Out:
    """Successors of nodes 0 to n - 1."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        order = np.argsort(a, kind="stable")
        self.to = b[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])

    def of(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(origin, successor) of all edges out of ``front``."""
        first, many = self.start[front], self.start[front + 1] - self.start[front]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(front, many), self.to[at]

    def reached(self, front: np.ndarray) -> np.ndarray:
        """Whether each node is in ``front`` or below it."""
        seen = np.zeros(len(self.start) - 1, dtype=bool)
        seen[front] = True
        while len(front):
            step = self.of(front)[1]
            front = np.unique(step[~seen[step]])
            seen[front] = True
        return seen


def weak(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each one's connected part, directions aside."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # roots hang below smaller roots
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A member of each node's strongly connected component, the same for all members.

    What lies on no cycle is peeled off; then the component of the busiest node is what it reaches and is reached from; the
    rest is taken in one depth-first search."""
    comp = np.arange(n)
    keep = a != b
    a, b = a[keep], b[keep]
    for turn in range(16):
        while len(a):  # an edge on a cycle starts where something arrives, and ends where something leaves
            into, out = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            into[b], out[a] = True, True
            keep = into[a] & out[b]
            few = keep.sum() > 0.9 * len(a)
            a, b = a[keep], b[keep]
            if few:
                break
        if len(a) < 100_000 or turn == 15:
            break
        busy = int(np.argmax(np.bincount(a, minlength=n).astype(float) * np.bincount(b, minlength=n)))
        pivot = np.array([busy])
        own = Out(a, b, n).reached(pivot) & Out(b, a, n).reached(pivot)
        comp[own] = busy
        keep = ~own[a] & ~own[b]
        many = (~keep).sum() > 0.05 * len(a)
        a, b = a[keep], b[keep]
        if not many:
            break
    if len(a):
        ids, x, y = numbers(a, b)
        comp[ids] = ids[_tarjan(x, y, len(ids))]
    return comp


def _tarjan(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(a, kind="stable")
    out = array("i", b[order].astype(np.int32).tobytes())
    start = array("q", np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).astype(np.int64).tobytes())
    seen, low, comp = (array("i", [-1]) * n for _ in range(3))
    stack, clock = array("i"), 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack.append(root)
        work, at = [root], [start[root]]
        while work:
            v, i = work[-1], at[-1]
            if i < start[v + 1]:
                at[-1] = i + 1
                w = out[i]
                if seen[w] < 0:
                    seen[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    work.append(w)
                    at.append(start[w])
                elif comp[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            work.pop()
            at.pop()
            if work:
                low[work[-1]] = min(low[work[-1]], low[v])
            if low[v] == seen[v]:
                while True:
                    w = stack.pop()
                    comp[w] = v
                    if w == v:
                        break
    return np.frombuffer(comp, dtype=np.int32)


def _ranks(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of an acyclic graph: the most edges that lead to each node."""
    left, out, rank = np.bincount(b, minlength=n), Out(a, b, n), np.zeros(n, dtype=np.int64)
    front, k = np.flatnonzero(left == 0), 0
    while len(front):
        rank[front] = k
        step, times = np.unique(out.of(front)[1], return_counts=True)
        left[step] -= times
        front, k = step[left[step] == 0], k + 1
    return rank


def acyclic(a: np.ndarray, b: np.ndarray, weight: np.ndarray, counts: np.ndarray, part_words: int = PART_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(n, part): the summed weight of the nodes in or above each one that ``counts`` marks, by bit sets, over an acyclic graph.
    Where the sets of a connected part take more than ``part_words``, n is 0 and part names it; else part is -1."""
    n = len(weight)
    total, open_ = np.where(counts, weight, 0), np.full(n, -1)
    if len(a):  # what nothing counted leads to stays 0
        live = Out(a, b, n).reached(np.flatnonzero(counts))
        a, b = a[live[a]], b[live[a]]
    if not len(a):
        return total, open_
    label = weak(a, b, n)
    used = np.zeros(n, dtype=bool)
    used[a] = used[b] = True
    member = np.flatnonzero(used & counts)
    by = member[np.argsort(label[member], kind="stable")]
    parts, first, many = np.unique(label[by], return_index=True, return_counts=True)
    bit = np.full(n, -1)
    bit[by] = np.arange(len(by)) - np.repeat(first, many)
    words = np.zeros(n, dtype=np.int64)  # by part
    words[parts] = -(-many // 64)
    nodes = np.bincount(label[used], minlength=n)
    wide = words * nodes > part_words
    open_[used & wide[label]] = label[used & wide[label]]
    total[open_ >= 0] = 0
    known = np.flatnonzero((words > 0) & ~wide)
    known = known[np.argsort(words[known], kind="stable")]
    rank = _ranks(a, b, n)
    # parts of like width go together, as many as fit
    group, k, size, width = np.full(n, -1), 0, 0, 1
    widths: list[int] = [1]
    for p, w, m in zip(known.tolist(), words[known].tolist(), nodes[known].tolist()):
        if size and (w > 2 * width or (size + m) * w > CHUNK_WORDS):
            k, size = k + 1, 0
            widths.append(w)
        if not size:
            width = w
        widths[k], size = max(widths[k], w), size + m
        group[p] = k
    own = group[label]
    edges = np.lexsort((rank[a], own[a]))
    edges = edges[own[a[edges]] >= 0]
    places = np.flatnonzero(used & (own >= 0))
    places = places[np.lexsort((label[places], own[places]))]
    bounds, ends = np.searchsorted(own[places], np.arange(k + 2)), np.searchsorted(own[a[edges]], np.arange(k + 2))
    at = np.full(n, -1)
    for g in range(k + 1):
        here, e = places[bounds[g] : bounds[g + 1]], edges[ends[g] : ends[g + 1]]
        if not len(here):
            continue
        at[here] = np.arange(len(here))
        x, y = at[a[e]], at[b[e]]
        cuts = np.flatnonzero(np.diff(rank[a[e]], prepend=-1))
        held = here[bit[here] >= 0]
        plain = bool((weight[held] == 1).all())
        step = max(1, min(widths[g], CHUNK_WORDS // len(here)))
        found = np.zeros(len(here), dtype=np.int64)
        for low in range(0, widths[g], step):
            many = min(step, widths[g] - low)
            some = held[(bit[held] >= 64 * low) & (bit[held] < 64 * (low + many))]
            state = np.zeros((len(here), many), dtype=np.uint64)
            state[at[some], bit[some] // 64 - low] = np.uint64(1) << (bit[some] % 64).astype(np.uint64)
            for i, c in enumerate(cuts):
                end = cuts[i + 1] if i + 1 < len(cuts) else len(x)
                np.bitwise_or.at(state, y[c:end], state[x[c:end]])
            if plain:
                found += np.bitwise_count(state).sum(axis=1, dtype=np.int64)
            else:
                found += _weighed(state, at[some], bit[some] - 64 * low, weight[some], label[here])
        total[here] = found
    return total, open_


def _weighed(state: np.ndarray, place: np.ndarray, bit: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The weights of the bits of each row; rows of a part lie together, and only its own bits are set in them."""
    found = np.bitwise_count(state).sum(axis=1, dtype=np.int64)
    heavy = np.flatnonzero(weight > 1)
    heavy = heavy[np.argsort(place[heavy], kind="stable")]
    part = label[place[heavy]]
    for k in np.split(heavy, np.flatnonzero(np.diff(part)) + 1) if len(heavy) else ():
        low, high = np.searchsorted(label, label[place[k[0]]], "left"), np.searchsorted(label, label[place[k[0]]], "right")
        more = np.zeros(64 * state.shape[1])
        more[bit[k]] = weight[k] - 1
        rows = max(1, CHUNK_WORDS // (8 * state.shape[1]))
        for i in range(low, high, rows):
            bits = np.unpackbits(state[i : min(i + rows, high)].view(np.uint8), axis=1, bitorder="little")
            found[i : min(i + rows, high)] += (bits @ more).astype(np.int64)
    return found


def sizes(a: np.ndarray, b: np.ndarray, weight: np.ndarray, part_words: int = PART_WORDS, depth: int = 12) -> tuple[np.ndarray, ...]:
    """The summed weight of the nodes in or above each one of an acyclic graph, as (n, of, own, u, v): ``n`` as far as it is known,
    and a graph (u, v) of what is left open, whose nodes stand for those named in ``of`` and count where ``own`` says so.

    In every connected part the heaviest node is the pivot.  Below it, all that lies above the pivot counts as one sum; so
    the sets only tell what isn't above it, and, for nodes that aren't below it, what is.  These are two smaller graphs: the
    nodes that don't lead to a pivot, and those that none leads to.  Parts of them that are too wide are cut again."""
    n = len(weight)
    label = weak(a, b, n)
    pivots = np.lexsort((np.bincount(a, minlength=n) + np.bincount(b, minlength=n), weight, label))
    pivots = pivots[np.append(np.diff(label[pivots]) != 0, True)]
    above, below = Out(b, a, n).reached(pivots), Out(a, b, n).reached(pivots)
    mass = np.bincount(label[above], weights=weight[above], minlength=n).astype(np.int64)
    one, two = ~above[a] & ~above[b], ~below[a] & ~below[b]
    x, y = np.concatenate([a[one], a[two] + n]), np.concatenate([b[one], b[two] + n])
    heavy = np.concatenate([np.where(above, 0, weight), np.where(above & ~below, weight, 0)])
    total, part = acyclic(x, y, heavy, heavy > 0, part_words)
    left = (part[x] >= 0) & (part[y] >= 0)
    ids, u, v = numbers(x[left], y[left])
    of, own = ids % max(n, 1), heavy[ids] > 0
    if len(u) and depth and len(u) < 0.98 * len(a):
        more, inner, own, u, v = sizes(u, v, heavy[ids], part_words, depth - 1)
        total[ids] += more
        of = of[inner]
    return total[:n] + total[n:] + np.where(below, mass[label], 0), of, own, u, v


def impact_task(part_words: int = PART_WORDS):
    """Rows of ``SCHEMA`` from edges (src, dst) in one task.  (id, n): a node and the size of its impact, as far as it is known.
    Of parts that are left open come the edges (up, comp), and (id, comp, own): the members of their nodes, and whether they count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        ids, a, b = numbers(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        del parts
        names, comp = np.unique(strong(a, b, len(ids)), return_inverse=True)
        c = len(names)
        weight = np.bincount(comp, minlength=c)
        cycle = weight > 1
        cycle[comp[a[a == b]]] = True
        x, y = comp[a], comp[b]
        pairs = np.unique((x * c + y)[x != y])
        n, of, own, left, right = sizes(pairs // c, pairs % c, weight, part_words)
        n = n - ~cycle  # a node that lies on no cycle isn't among its own origins

        def rows(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            long = len(next(iter(columns.values())))
            for i in range(0, long, 1 << 20):
                some = {k: pa.array(v[i : i + (1 << 20)].astype(np.int64)) for k, v in columns.items()}
                yield pa.RecordBatch.from_arrays([some.get(k, pa.nulls(min(1 << 20, long - i), pa.int64())) for k in FIELDS], list(FIELDS))

        yield from rows(id=ids, n=n[comp])
        if len(left):
            yield from rows(up=left, comp=right)
            member = Out(comp, np.arange(len(ids)), c)
            for k in range(0, len(of), 1 << 18):  # a component may stand in several open nodes
                held = member.of(of[k : k + (1 << 18)])[1]
                node = np.repeat(np.arange(k, min(k + (1 << 18), len(of))), weight[of[k : k + (1 << 18)]])
                yield from rows(id=ids[held], comp=node, own=own[node])

    return run
