"""A prefix tree over globally ordered sets, and the join that walks it with many probes at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Elements of a path that are walked between two looks at the bounds.
STEP = 64
#: Bytes of the tables of a group of probes.
PROBE_BYTES = 64 << 20


@dataclass(frozen=True)
class Likeness:
    """Two sets link when ``den * |A and B| >= num * |A or B|``; shingles have ``words`` words."""

    words: int = 4
    num: int = 85
    den: int = 100

    def overlap(self, total):
        """The least common elements of linked sets of this total size."""
        return -(-self.num * total // (self.num + self.den))

    def spare(self, size):
        """The most elements of a set of this size that a linked set may lack."""
        return size - -(-self.num * size // self.den)


class PrefixTree:
    """Sets as the paths of a tree: ``paths`` hold ascending element numbers, ``sizes`` the sizes of the whole sets.

    The paths in lexicographic order are the leaves in depth-first order, and what neighbours have in common tells
    where they part: the leaves ``low .. high`` share a node of the depth of their least common beginning.
    """

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(paths)), key=lambda k: paths[k].astype(">u4").tobytes())
        self.paths = [paths[k] for k in self.order]
        self.sizes = sizes[self.order]
        self.lengths = np.array([len(p) for p in self.paths], np.int64)
        self.common = np.array([0] + [_beginning(x, y) for x, y in zip(self.paths, self.paths[1:])], np.int64)

    def links(self, probes: list[np.ndarray], probe_sizes: np.ndarray, elements: int, like: Likeness, apart):
        """Walk the tree once with all probes; yield (leaf, probes that link with it).

        The overlaps of a node's path are counted once and handed to all nodes below it. A subtree is left when no
        probe can reach the threshold there: the overlap so far and the shorter of the two remaining lengths are too
        few. ``apart(leaves, probes)`` tells which of the probes are still of interest to any of the leaves.
        """
        holds = np.zeros((elements, len(probes)), bool)
        for k, probe in enumerate(probes):
            holds[probe, k] = True
        passed = np.zeros((elements + 1, len(probes)), np.int32)  # elements of a probe up to a number
        np.cumsum(holds, axis=0, out=passed[1:])
        lengths = passed[-1]
        everyone = np.arange(len(probes))
        ahead = [(0, len(self.paths), 0, everyone, np.zeros(len(probes), np.int64))] if self.paths else []
        while ahead:
            low, high, depth, alive, overlap = ahead.pop()
            wanted = apart(self.order[low:high], alive)
            alive, overlap = alive[wanted], overlap[wanted]
            path, longest, least = self.paths[low], int(self.lengths[low:high].max()), int(self.sizes[low:high].min())
            end = int(self.common[low + 1 : high].min()) if high - low > 1 else len(path)
            while len(alive):
                rest = np.minimum(longest - depth, lengths[alive] - passed[path[depth - 1] + 1 if depth else 0, alive])
                good = overlap + rest >= like.overlap(least + probe_sizes[alive])
                alive, overlap = alive[good], overlap[good]
                if depth == end:
                    break
                some = path[depth : depth + min(STEP, end - depth)]
                overlap = overlap + holds[np.ix_(some, alive)].sum(0)
                depth += len(some)
            if not len(alive):
                continue
            if high - low == 1:
                yield self.order[low], alive
                continue
            parts = [low, *(np.flatnonzero(self.common[low + 1 : high] == end) + low + 1).tolist(), high]
            ahead.extend((a, b, end, alive, overlap) for a, b in zip(parts[-2::-1], parts[:0:-1]))


def _beginning(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


def join(sets: list[np.ndarray], sizes: np.ndarray, like: Likeness, label: np.ndarray | None = None, leaf: np.ndarray | None = None, probe: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the sets (ascending elements of one global order) that join all that any links join.

    ``sizes`` counts elements that no other set has as well, which ``sets`` may leave out. Sets of equal ``label``
    (each its own, if none are given) are joined already; two sets are compared until they are. ``leaf`` and
    ``probe`` tell which sets are in the tree and which walk it (all, if not given).
    """
    everyone = np.ones(len(sets), bool)
    leaf, probe = everyone if leaf is None else leaf, everyone if probe is None else probe
    label = np.arange(len(sets)) if label is None else label.copy()
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    _, number, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    common = counts > 1
    rank = np.cumsum(common) - 1
    paths = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        here = number[a:b]
        paths.append(rank[here[common[here]]])
    able = np.array([len(p) for p in paths], np.int64) >= sizes - like.spare(sizes)
    leaves, walkers = np.flatnonzero(leaf & able), np.flatnonzero(probe & able)
    if not len(leaves) or not len(walkers):
        return []
    tree = PrefixTree([paths[k] for k in leaves], sizes[leaves])
    elements, found = int(common.sum()), []
    width = max(1, PROBE_BYTES // (5 * (elements + 1)))
    for at in range(0, len(walkers), width):
        some = walkers[at : at + width]

        def apart(below: list[int], alive: np.ndarray) -> np.ndarray:
            labels = label[leaves[below]]
            return label[some[alive]] != labels[0] if (labels == labels[0]).all() else np.ones(len(alive), bool)

        for k, linked in tree.links([paths[p] for p in some], sizes[some], elements, like, apart):
            one = int(leaves[k])
            for other in some[linked].tolist():
                if label[other] != label[one]:
                    found.append((one, other))
                    label[label == label[other]] = label[one]
    return found
