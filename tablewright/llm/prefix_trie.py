"""Walk of a prefix tree over globally ordered sets that finds, for every stored set, the probes alike enough.

The sets of a group are stored in a tree by their tokens in one global order, frequent tokens first, so that sets which are alike
share long paths. The tree is walked depth-first with all probes of the group at once: a node carries the overlap of each live
probe with the path that leads to it, which all sets below share. A probe is dropped from a subtree when its overlap, with
what the longest path below and the probe itself have left, stays under what the smallest fitting set below asks for; a
subtree without live probes is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens of an edge that are added up between two looks at the bound.
EDGE = 64


def least_size(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * size // 100)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common tokens for 100 * common >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


@dataclass
class Sets:
    """group: what may meet; size: of the whole set; token: ranks in the global order, sorted in each set; edge: where sets begin."""

    group: np.ndarray
    size: np.ndarray
    token: np.ndarray
    edge: np.ndarray

    def __len__(self) -> int:
        return len(self.group)

    def only(self, keep: np.ndarray) -> Sets:
        """Without the tokens that keep (by rank) does not mark, renumbered: they are in no other set."""
        ok = keep[self.token]
        return Sets(self.group, self.size, (np.cumsum(keep) - 1)[self.token[ok]], np.r_[0, np.cumsum(ok)][self.edge])


class Walk:
    def __init__(self, stored: Sets, probes: Sets | None, percent: int):
        """probes: None to hold the stored sets against each other."""
        self.same, self.percent, self.cut, self.nodes = probes is None, percent, 0, 0
        other = stored if probes is None else probes
        kinds = 1 + max(int(stored.token.max(initial=0)), int(other.token.max(initial=0)))
        if self.same:
            keep = np.bincount(stored.token, minlength=kinds) > 1
        else:
            keep = (np.bincount(stored.token, minlength=kinds) > 0) & (np.bincount(other.token, minlength=kinds) > 0)
        self.stored = stored.only(keep)
        self.probes = p = self.stored if self.same else other.only(keep)
        self.kinds = max(1, int(keep.sum()))
        self.left = np.diff(p.edge)
        of = np.repeat(np.arange(len(p)), self.left)
        self.flat = of * self.kinds + p.token
        by_token = np.argsort(p.token, kind="stable")
        self.posting, self.at = of[by_token], np.searchsorted(p.token[by_token], np.arange(self.kinds + 1))
        self.by_group = np.argsort(p.group, kind="stable")

    def _overlap(self, path: np.ndarray) -> np.ndarray:
        """How many tokens of the path each probe holds."""
        lo = self.at[path]
        n = self.at[path + 1] - lo
        which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.posting[which], minlength=len(self.probes))

    def _along(self, path, depth, live, seen, least, most, longest):
        """Live probes and their overlaps at the end of an edge of a subtree whose set sizes are least to most, its paths longest at most."""
        p = self.probes
        ok = (least_size(least, self.percent) <= p.size[live]) & (most >= least_size(p.size[live], self.percent))
        live, seen = live[ok], seen[ok]
        need = least_overlap(np.maximum(least, least_size(p.size[live], self.percent)), p.size[live], self.percent)
        for at in range(0, len(path), EDGE):
            if not len(live):
                break
            part = path[at : at + EDGE]
            seen = seen + self._overlap(part)[live]
            ahead = p.edge[live] + self.left[live] - np.searchsorted(self.flat, live * self.kinds + part[-1], "right")
            ok = seen + np.minimum(ahead, longest - depth - at - len(part)) >= need
            live, seen, need = live[ok], seen[ok], need[ok]
        return live, seen

    def found(self):
        """(stored set, probes that reach the threshold with it) for each stored set with any."""
        s, p = self.stored, self.probes
        n = np.diff(s.edge)
        big = s.token.astype(">u4")
        raw = [big[a:b].tobytes() for a, b in zip(s.edge[:-1], s.edge[1:], strict=True)]
        order = np.array(sorted(range(len(s)), key=lambda i: (s.group[i], raw[i])), np.int64)
        group, size, length = s.group[order], s.size[order], n[order]
        path = [s.token[s.edge[i] : s.edge[i + 1]] for i in order]
        shared = np.zeros(len(order) + 1, np.int64)  # by the set and the one before it
        for i in range(1, len(order)):
            m = min(length[i - 1], length[i])
            apart = np.flatnonzero(path[i - 1][:m] != path[i][:m])
            shared[i] = apart[0] if len(apart) else m
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        probe_group = p.group[self.by_group]
        for lo, hi in zip(starts, np.append(starts[1:], len(group)), strict=True):
            a, b = np.searchsorted(probe_group, [group[lo], group[lo] + 1])
            live = np.sort(self.by_group[a:b])
            stack = [(lo, hi, 0, live, np.zeros(len(live), np.int64))]
            while stack:
                lo_, hi_, depth, live, seen = stack.pop()
                self.nodes += 1
                alone = hi_ - lo_ == 1
                end = int(length[lo_]) if alone else int(shared[lo_ + 1 : hi_].min())
                if self.same and alone:  # a set is no partner of its own
                    live, seen = live[live != order[lo_]], seen[live != order[lo_]]
                live, seen = self._along(path[lo_][depth:end], depth, live, seen, size[lo_:hi_].min(), size[lo_:hi_].max(), int(length[lo_:hi_].max()))
                if not len(live):
                    self.cut += 1
                    continue
                while lo_ < hi_ and length[lo_] == end:
                    ok = seen >= least_overlap(size[lo_], p.size[live], self.percent)
                    if self.same:
                        ok &= live != order[lo_]
                    if ok.any():
                        yield int(order[lo_]), live[ok]
                    lo_ += 1
                if lo_ < hi_:
                    child = np.r_[lo_, lo_ + 1 + np.flatnonzero(shared[lo_ + 1 : hi_] == end), hi_]
                    stack += [(int(x), int(y), end, live, seen) for x, y in zip(child[-2::-1], child[:0:-1], strict=True)]


def joined(stored: Sets, probes: Sets | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set (the stored, then the probes), and the least set that it reaches by them."""
    walk = Walk(stored, probes, percent)
    n = len(stored) + (0 if probes is None else len(probes))
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i, alike in walk.found():
        j = alike if probes is None else alike + len(stored)
        links[i] += len(j)
        if probes is not None:
            links[j] += 1
        meets = np.unique(np.r_[label[i], label[j]])
        if len(meets) > 1:
            label[np.isin(label, meets[1:])] = meets[0]
    return links, label


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) but the least of its component, and that one."""
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(x):
        p, q = label[x], label[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    i = np.flatnonzero(label != np.arange(len(names)))
    return names[i], names[label[i]]
