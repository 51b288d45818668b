"""Members of shared groups within a task: which hang together, and walks of four steps from all of them as bits, in a memory that a part's edges bound and not the pairs that meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Links that are collected before they are made into stars.
LINKS = 1_000_000
#: Words of 64 bits that a walk's states have at most, over all members of a part (three states are held).
WORDS = 4_000_000
#: Edges that are folded together at least; more if a group has them.
PIECE = 1_000_000
#: Below so many rows to fold at once, each is folded by itself.
FEW = 32


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, first, members) of (group, member) sorted by both: a group's different members in one row or several, and the first of them all."""
    group = first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g, m = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.concatenate(([g[0] != group or m[0] != last], (g[1:] != g[:-1]) | (m[1:] != m[:-1])))
        g, m = g[new], m[new]
        if not len(g):
            continue
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        lead = m[begin]
        if g[0] == group:
            lead[0] = first
        group, first, last = g[-1], lead[-1], m[-1]
        members = pa.ListArray.from_arrays(pa.array(np.append(begin, len(m)).astype(np.int32)), pa.array(m))
        yield pa.RecordBatch.from_arrays([pa.array(g[begin]), pa.array(lead), members], names=["group", "first", "members"])


class Stars:
    """Which numbers are linked, straight or by others: each with the least one of those that it hangs together with."""

    def __init__(self) -> None:
        self.known, self.root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def _of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return x, np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        seen = self.known[at] == x
        return np.where(seen, self.root[at], x), seen

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links of each of a with the one of b; of a number that is alone, one with itself."""
        (x, seen), (y, _) = self._of(a), self._of(b)
        new = (x != y) | ~seen
        self.links.append((a[new], b[new]))
        self.held += int(new.sum())
        if self.held > LINKS:
            self._join()

    def _join(self) -> None:
        a, b = (np.concatenate(x) for x in zip((self.known, self.root), *self.links))
        self.known, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, root = at[: len(a)], at[len(a) :], np.arange(len(self.known))
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while not np.array_equal(up := root[root], root):
                root = up
        self.root, self.links, self.held = self.known[root], [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._join()
        for i in range(0, len(self.known), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(self.known[i : i + 100_000]), pa.array(self.root[i : i + 100_000])], names=["member", "part"])


def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, part) of (member, part): what the task's links join."""
    stars = Stars()
    for batch in batches:
        stars.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    yield from stars.rows()


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, part) of (first, members): what the task's groups join."""
    stars = Stars()
    for batch in batches:
        first, members = batch.column(0).to_numpy(), batch.column(1)
        stars.add(members.flatten().to_numpy(), np.repeat(first, members.value_lengths().to_numpy()))
    yield from stars.rows()


class Folds:
    """For each of some rows the bits of all rows of another table that it names: flat holds the names, `counts` of them a row."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        self.flat, self.order, self.less, self.begin = flat, *(x.astype(np.int32) for x in (order, -counts[order], (np.cumsum(counts) - counts)[order]))

    def of(self, bits: np.ndarray) -> np.ndarray:
        """Rows by falling counts: the first names of all, then the second ones of those that have two, and so on."""
        out, j = bits[self.flat[self.begin]], 1
        while (live := int(np.searchsorted(self.less, np.int32(-j)))) > FEW:
            out[:live] |= bits[self.flat[self.begin[:live] + j]]
            j += 1
        for i in range(live):
            out[i] |= np.bitwise_or.reduce(bits[self.flat[self.begin[i] + j : self.begin[i] - self.less[i]]], axis=0)
        return out


def _set(bits: np.ndarray, every: np.ndarray) -> np.ndarray:
    """In how many rows each bit is set; rows in which all are needn't be spread out."""
    full = (bits == every).all(axis=1)
    found = np.unpackbits(every.view(np.uint8), bitorder="little").astype(np.int64) * int(full.sum())
    rest = bits[~full]
    for i in range(0, len(rest), 4096):
        found += np.unpackbits(rest[i : i + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return found


class Part:
    """A part's groups, from which nothing leads to other parts, and the walks from its members."""

    def __init__(self) -> None:
        self.known, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []  # of whole groups: members, and how many each group has
        self.group: int | None = None
        self.open, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)  # the same of what isn't a piece yet

    def add(self, groups: np.ndarray, sizes: np.ndarray, members: np.ndarray) -> None:
        """Rows sorted by group; a group may go on in the next call."""
        at = np.minimum(np.searchsorted(self.known, members), max(0, len(self.known) - 1))
        new = np.unique(members[self.known[at] != members] if len(self.known) else members)
        if len(new):
            number = np.concatenate([self.number, np.arange(len(new)) + len(self.known)])
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.number = known[order], number[order]
            at = np.searchsorted(self.known, members)
        found = self.number[at].astype(np.int32)
        begin = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        counts = np.add.reduceat(sizes, begin)
        if groups[0] == self.group:
            counts[0] += self.counts[-1]
            self.counts = self.counts[:-1]
        self.group, self.open, self.counts = groups[-1], np.concatenate([self.open, found]), np.concatenate([self.counts, counts])
        if (done := len(self.open) - int(self.counts[-1])) >= PIECE:
            self._cut(done, len(self.counts) - 1)

    def _cut(self, edges: int, groups: int) -> None:
        """Numbers take no more bytes than the members known so far need."""
        self.pieces.append((self.open[:edges].astype(np.min_scalar_type(len(self.known))), self.counts[:groups]))
        self.open, self.counts = self.open[edges:], self.counts[groups:]

    def walked(self, share: int, shares: int) -> Iterator[pa.RecordBatch]:
        """(member, n, closed) of the members in every `shares`-th block of them; see paths.shared_reach."""
        self._cut(len(self.open), len(self.counts))
        size = len(self.known)
        ways = np.zeros(size, np.int64)
        kept = []
        while self.pieces:
            found, counts = self.pieces.pop()
            of = np.repeat(np.arange(len(counts)), counts)
            ways += np.bincount(found, weights=counts[of] - 1, minlength=size).astype(np.int64)
            order = np.argsort(found, kind="stable")
            here, times = np.unique(found, return_counts=True)
            down = Folds(found, counts)
            place = np.empty(len(counts), np.min_scalar_type(len(counts)))
            place[down.order] = np.arange(len(counts))
            up = Folds(place[of[order]], times)
            kept.append((down, up, here[up.order]))
        names = np.empty(size, np.int64)
        names[self.number] = self.known
        words = -(-size // 64)
        wide = max(1, min(-(-words // shares), WORDS // size))
        for block in range(share, -(-words // wide), shares):
            asked = self.number[block * wide * 64 : (block + 1) * wide * 64]  # by known order, the same in each share
            k = np.arange(len(asked), dtype=np.uint64)
            bit = np.left_shift(np.uint64(1), k % np.uint64(64))
            now, every = np.zeros((size, wide), np.uint64), np.zeros(wide, np.uint64)
            now[asked, k // np.uint64(64)] = bit
            np.bitwise_or.at(every, k // np.uint64(64), bit)
            two = np.zeros_like(now)
            for down, up, here in kept:
                two[here] |= up.of(down.of(now))
            now[:] = 0
            groups = np.zeros(wide * 64, np.int64)
            for down, up, here in kept:
                groups += _set(three := down.of(two), every)
                now[here] |= up.of(three)
            others, members = (_set(x, every)[: len(asked)] - 1 for x in (two, now))
            closed = ways[asked] > others
            yield pa.RecordBatch.from_arrays([pa.array(names[asked]), pa.array(groups[: len(asked)] + members + closed), pa.array(closed)], names=["member", "n", "closed"])


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, n, closed) of (part, share, shares, group, members) sorted by part, share and group."""
    now, part = None, Part()
    for batch in batches:
        if not batch.num_rows:
            continue
        of, share, shares, group = (batch.column(i).to_numpy() for i in range(4))
        members = batch.column(4)
        sizes, offsets, flat = members.value_lengths().to_numpy().astype(np.int64), members.offsets.to_numpy(), members.values.to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (share[1:] != share[:-1]), [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = (of[a], share[a], shares[a])
            if key != now:
                if now is not None:
                    yield from part.walked(int(now[1]), int(now[2]))
                now, part = key, Part()
            part.add(group[a:b], sizes[a:b], flat[offsets[a] : offsets[b]])
    if now is not None:
        yield from part.walked(int(now[1]), int(now[2]))
