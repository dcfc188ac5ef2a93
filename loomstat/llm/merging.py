"""Byte-pair merging of many sequences at a time, in ragged numpy arrays."""

from __future__ import annotations

import numpy as np

_NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class RankMerger:
    """A byte-level BPE's merges as sorted arrays. ``model`` has vocab, merges and end_of_word_suffix."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_letters()], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank, self.made = pairs[order], order.astype(np.int64), made[order]

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (or never) and the id that it merges into."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], _NEVER), self.made[at]

    def merged(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids that survive, of all sequences one after the other, and their number in each.

        Each round applies the lowest-ranked pair of every sequence, wherever it occurs in it, and
        looks up anew only the pairs beside a merge.
        """
        sizes = np.array([len(s) for s in sequences], np.int64)
        counts = np.zeros(len(sequences), np.int64)
        owner = np.flatnonzero(sizes)  # the sequence that each active run of ids belongs to
        if not len(owner):
            return np.zeros(0, np.int64), counts
        sizes = sizes[owner]
        signs = np.frombuffer(b"".join(sequences), np.uint8)
        ids = self.first[signs]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[signs[ends]]
        rank, into = np.full(len(ids), _NEVER), np.zeros(len(ids), np.int64)
        rank[:-1], into[:-1] = self._look_up(ids[:-1], ids[1:])
        rank[ends] = _NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(owner):
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(rank, starts)
            alive = lowest < _NEVER
            if not alive.all():
                keep = np.repeat(alive, sizes)
                counts[owner[~alive]] = sizes[~alive]
                done.append((np.repeat(owner[~alive], sizes[~alive]), ids[~keep]))
                ids, rank, into, sizes, owner, lowest = ids[keep], rank[keep], into[keep], sizes[alive], owner[alive], lowest[alive]
                if not len(owner):
                    break
            merge = np.flatnonzero(rank == np.repeat(lowest, sizes))
            if len(merge) > len(owner):  # of pairs that overlap (one symbol repeated), every second one merges
                begin = np.flatnonzero(np.concatenate(([True], np.diff(merge) != 1)))
                since = np.arange(len(merge)) - np.repeat(begin, np.diff(np.append(begin, len(merge))))
                merge = merge[since % 2 == 0]  # runs never touch: a run's last id begins no pair
            ids[merge] = into[merge]
            keep = np.ones(len(ids), bool)
            keep[merge + 1] = False
            where = np.cumsum(keep) - 1
            lost = np.add.reduceat(~keep, np.cumsum(sizes) - sizes, dtype=np.int64)
            ids, rank, into, sizes = ids[keep], rank[keep], into[keep], sizes - lost
            new = where[merge]
            last = np.zeros(len(ids), bool)
            last[np.cumsum(sizes) - 1] = True
            beside = np.concatenate([new, new[new > 0] - 1])
            rank[beside] = _NEVER
            beside = beside[~last[beside]]
            rank[beside], into[beside] = self._look_up(ids[beside], ids[beside + 1])
        owners, found = (np.concatenate(x) for x in zip(*done))
        return found[np.argsort(owners, kind="stable")], counts
