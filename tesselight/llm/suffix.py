"""Suffix sorting by linear grouping, for many small texts at once.

The construction has two phases. Phase 1 groups suffixes by their longest Lyndon prefix: groups
start as first symbols and are processed from the highest to the lowest; for each suffix of a group
the previous suffix in a lower group is found over pointers that higher groups have left, and those
previous suffixes move into new groups directly above their old ones, by how many of the group
point at them. Phase 2 walks the order from its lowest suffix and emits, for each, the suffix
before it and what that one's pointers lead to, each at the front of its group. No substring is
ever renamed and no part is sorted recursively.

Texts are dealt into buckets; a bucket's texts are sorted together, and all buckets advance step by
step together, so each step is a few operations on arrays. Each text ends with a terminator of its
own, below all bytes; terminators are ordered by place.
"""

from __future__ import annotations

import numpy as np


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.empty(len(keys[0]), bool)
    new[0] = True
    np.not_equal(keys[0][1:], keys[0][:-1], out=new[1:])
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _gaps(heads: np.ndarray, end: int) -> np.ndarray:
    """Lengths of the runs that begin at ``heads``."""
    out = np.empty_like(heads)
    np.subtract(heads[1:], heads[:-1], out=out[:-1])
    out[-1] = end - heads[-1]
    return out


def bucket_orders(texts: list[bytes], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes of each bucket's texts.

    ``bucket`` holds each text's bucket and ascends. Returns the suffixes' places in the joined
    texts (each text followed by one terminator) in bucket order and suffix order within it,
    where each text starts, and the joined bytes with zeros at terminators.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    total = int(lengths.sum())
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    ends = starts + lengths - 1
    stop = np.zeros(total, bool)
    stop[ends] = True
    first_text = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    low = starts[first_text]  # where each bucket begins
    high = np.append(low[1:], total)
    # first groups: by bucket and symbol, terminators lowest; places shift by one for a barrier at 0
    symbol = data.astype(np.int64) + 1
    symbol[ends] = 0
    of = np.repeat(np.arange(len(low)), high - low)
    key = of * 512 + symbol
    perm = np.argsort(key, kind="stable")
    slot = np.empty(total, np.int64)
    slot[perm] = np.arange(total)
    key = key[perm]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    head |= stop[perm]  # each terminator is alone
    head_at = np.flatnonzero(head)
    del symbol, of, key, head
    group = np.empty(total, np.int64)
    group[perm] = np.repeat(head_at, np.diff(np.append(head_at, total)))
    end_of = np.zeros(total + 1, np.int64)
    end_of[head_at] = np.append(head_at[1:], total)
    terminators = np.add.reduceat(stop.astype(np.int64), low)
    prev = np.full(total, -1, np.int64)
    moving = np.zeros(total, bool)

    # phase 1
    floor, top, active = low + terminators, high.copy(), np.flatnonzero(low + terminators < high)
    while len(active):
        begin = group[perm[top[active] - 1]]
        size = top[active] - begin
        top[active] = begin
        skip = np.cumsum(size) - size
        members = perm[np.repeat(begin - skip, size) + np.arange(int(size.sum()))]
        own = np.repeat(begin, size)
        at = members - 1
        open_ = np.arange(len(members))
        while True:
            here = at[open_]
            inside = here >= 0
            g = np.where(inside, group[here], -1)
            # a text's own start stops at the terminator before it, whatever its number
            on = inside & ~stop[here] & (g >= own[open_])
            if not on.any():
                break
            open_, here, g = open_[on], here[on], g[on]
            at[open_] = np.where(g > own[open_], prev[here], here - 1)
        prev[members] = at
        real = at >= 0
        real[real] = ~stop[at[real]]
        parents = at[real]
        prev[members[~real]] = -1
        if len(parents):
            parents.sort()
            run = _heads(parents)
            parents, count = parents[run], _gaps(run, len(parents))
            old = group[parents]
            order = np.argsort(old * (len(members) + 1) + count, kind="stable")
            parents, count, old = parents[order], count[order], old[order]
            run = _heads(old)
            many = _gaps(run, len(old))
            limit = end_of[old[run]]
            target = np.repeat(limit - many - run, many) + np.arange(len(old))
            moving[parents] = True
            sits = perm[target]
            displaced = sits[~moving[sits]]
            moving[parents] = False
            left = slot[parents]
            vacated = left[left < np.repeat(limit - many, many)]
            perm[vacated] = displaced
            slot[displaced] = vacated
            perm[target] = parents
            slot[parents] = target
            end_of[old[run]] = limit - many
            split = _heads(old, count)
            length = _gaps(split, len(old))
            group[parents] = np.repeat(target[split], length)
            end_of[target[split]] = target[split] + length
        active = active[top[active] > floor[active]]

    del perm, slot, end_of, moving

    # phase 2
    out = np.full(total, -1, np.int64)
    out[low.repeat(terminators) + np.arange(int(terminators.sum())) - np.repeat(np.cumsum(terminators) - terminators, terminators)] = np.flatnonzero(stop)
    placed = stop.copy()
    front = np.arange(total, dtype=np.int64)  # next free place of the group that begins here
    by_size = np.argsort(low - high, kind="stable")
    low_, size_ = low[by_size], (high - low)[by_size]
    for rank in range(int(size_.max(initial=0))):
        live = int(np.searchsorted(-size_, -rank, "left"))
        s = out[low_[:live] + rank] - 1
        s = s[s >= 0]
        s = s[~placed[s]]
        while len(s):
            g = group[s]
            f = front[g]
            out[f] = s
            front[g] = f + 1
            placed[s] = True
            s = prev[s]
            s = s[s >= 0]
            s = s[~placed[s]]
    return out, starts, data
