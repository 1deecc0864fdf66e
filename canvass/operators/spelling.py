"""Nearest names by a search in memory, for the names of addresses that hold many.

The names of a group form a trie, kept by level.  Leads walk it together, each
with the band of its edit distances to the text of the place that it is at
(``2 d + 1`` cells); a place is left when no cell is within ``d``.  Of at most
``d`` edits, at most ``d // 2`` lie in the first half of the lead, or less than
``d - d // 2`` behind it, so the trie is walked from the front with few edits
allowed in the first half, and a trie of the reversed names with few in the
second: the many places near the root are never all visited.  Leads without a
name within ``d`` go on with ``d + 1``.

A walk looks at about ``ROWS`` places at a time and takes the others later, so
its memory does not depend on how many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 1 << 18        # places of a trie looked at together
TOGETHER = 1 << 16    # rows of small groups searched together
NEVER = 0xFFFFFFFF    # no character


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and each text's length."""
    return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32),
            np.fromiter(map(len, texts), np.int64, len(texts)))


def _trie(texts: list[str], group: np.ndarray, groups: int) -> list[tuple]:
    """By level: the places' characters, where their children begin in the next level, and the first name that ends there or -1."""
    codes, length = _codes(texts)
    start = np.cumsum(length) - length
    alive, place = np.arange(len(texts)), group
    char, n, levels = np.zeros(groups, np.uint32), groups, []
    while True:
        ended = length[alive] == len(levels)
        ends = np.full(n, -1, np.int64)
        ends[place[ended][::-1]] = alive[ended][::-1]
        alive, place = alive[~ended], place[~ended]
        children, place = np.unique(place << 32 | codes[start[alive] + len(levels)], return_inverse=True)
        levels.append((char, np.searchsorted(children >> 32, np.arange(n + 1)), ends))
        if not len(alive):
            return levels
        char, n = (children & NEVER).astype(np.uint32), len(children)


def _padded(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts with room around each for a band to reach out, where each begins, its length."""
    codes, length = _codes(texts)
    room = 5 * k + 5
    begin = np.cumsum(length + room) - length - room + k + 1
    out = np.full(int(length.sum()) + room * len(texts), NEVER, np.uint32)
    out[np.arange(len(codes)) + np.repeat(begin - (np.cumsum(length) - length), length)] = codes
    return out, begin, length


def _walk(levels, leads, todo, group, half, d: int, low: int, best, names: int) -> None:
    """Lowers ``best`` of the leads ``todo`` to distance * names + name, for all names within ``d`` edits of
    which at most ``low`` lie in the lead's first ``half`` characters."""
    codes, begin, length = leads
    first_cells = np.arange(-d, d + 1, dtype=np.int8)[:, None]
    cells = np.where((first_cells < 0) | (first_cells > low) & (first_cells <= half[todo]), d + 1, first_cells).astype(np.int8)
    work = [(0, todo, group[todo], cells)]
    while work:
        depth, q, at, cells = work.pop()
        _, first, ends = levels[depth]
        count = first[at + 1] - first[at]
        total = int(count.sum())
        if total > ROWS and len(q) > 1:
            cut = len(q) // 2
            work += [(depth, q[cut:], at[cut:], cells[:, cut:]), (depth, q[:cut], at[:cut], cells[:, :cut])]
            continue
        name, o = ends[at], length[q] - depth + d
        hit = np.flatnonzero((name >= 0) & (o >= 0) & (o <= 2 * d))
        if len(hit):
            dist = cells[o[hit], hit]
            hit, dist = hit[dist <= d], dist[dist <= d].astype(np.int64)
            np.minimum.at(best, q[hit], dist * names + name[hit])
        if not total:
            continue
        parent = np.repeat(np.arange(len(q)), count)
        at = np.arange(total) + np.repeat(first[at] - (np.cumsum(count) - count), count)
        char, q = levels[depth + 1][0][at], q[parent]
        old, ahead, few = np.take(cells, parent, axis=1), begin[q] + depth, half[q] - depth - 1
        cells = np.empty_like(old)
        for o in range(2 * d + 1):
            cell = old[o] + (codes[ahead + (o - d)] != char)
            if o < 2 * d:
                np.minimum(cell, old[o + 1] + np.int8(1), out=cell)
            if o:
                np.minimum(cell, cells[o - 1] + np.int8(1), out=cell)
            np.putmask(cell, (cell > low) & (few >= o - d), d + 1)
            np.minimum(cell, d + 1, out=cells[o])
        stay = np.flatnonzero(cells.min(axis=0) <= d)
        if len(stay):
            work.append((depth + 1, q[stay], at[stay], cells[:, stay]))


def nearest_names(names: list[str], name_group: np.ndarray, leads: list[str], lead_group: np.ndarray,
                  k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each lead the index of the nearest name of its group within ``k`` edits, and the edits.

    Of equally near names it is the first; -1 where there is none.
    """
    none = np.iinfo(np.int64).max
    best = np.full(len(leads), none)
    groups = int(max(name_group.max(initial=-1), lead_group.max(initial=-1))) + 1
    ways = []
    for turn in (1, -1):
        padded = _padded([t[::turn] for t in leads], k)
        # Counted from the back, edits between the halves are the first half's.
        half = padded[2] // 2 if turn == 1 else padded[2] - padded[2] // 2 - 1
        ways.append((_trie([t[::turn] for t in names], name_group, groups), padded, half))
    for d in range(1, k + 1):
        todo = np.flatnonzero(best == none)
        for (levels, padded, half), low in zip(ways, (d // 2, d - d // 2 - 1), strict=True):
            _walk(levels, padded, todo, lead_group, half, d, low, best, max(len(names), 1))
    found = best < none
    return np.where(found, best % max(len(names), 1), -1), np.where(found, best // max(len(names), 1), -1)


def _whole_groups(batches):
    """Tables of whole cells, small ones together; rows come ordered by cell."""
    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column(0).to_numpy()
        start = int(np.searchsorted(cell, cell[-1]))
        if size + start >= TOGETHER and (start or last != cell[0]):
            yield pa.Table.from_batches([*held, b.slice(0, start)])
            held, size, b = [], 0, b.slice(start)
        held.append(b)
        size, last = size + b.num_rows, cell[-1]
    if held:
        yield pa.Table.from_batches(held)


def searcher(k: int):
    """For ``mapInArrow``: of rows (cell, lead or name, address, text) ordered by cell, names first and the better
    ones before the others, the nearest name of the cell and address of each lead that has one within ``k`` edits."""

    def run(batches):
        for t in _whole_groups(batches):
            t = t.combine_chunks()
            cell, lead = t["_cell"].to_numpy(), t["_lead"].to_numpy()
            place = pc.dictionary_encode(t["_ka"]).combine_chunks()
            _, cell = np.unique(cell, return_inverse=True)
            _, group = np.unique(cell * len(place.dictionary) + place.indices.to_numpy(), return_inverse=True)
            texts = [x.decode("utf-8", "surrogateescape") for x in t["_kn"].to_pylist()]
            is_lead, is_name = np.flatnonzero(lead), np.flatnonzero(~lead)
            name, distance = nearest_names([texts[i] for i in is_name], group[is_name],
                                           [texts[i] for i in is_lead], group[is_lead], k)
            found = name >= 0
            rows = pa.array(is_lead[found])
            yield pa.RecordBatch.from_arrays(
                [*(t[c].combine_chunks().take(rows) for c in ("_kn", "_ka")),
                 t["_kn"].combine_chunks().take(pa.array(is_name[name[found]])), pa.array(distance[found], pa.int32())],
                names=["_kn", "_ka", "_ckn", "distance"])

    return run
