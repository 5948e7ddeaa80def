"""Counters of terms inside one task: occurrences and records, in whole-array steps."""

from __future__ import annotations

import numpy as np


class Counters:
    """Per term occurrences and records. Tokens come in the order of their records, so that a record counts when it
    differs from the one last seen for the term; no term keeps a set of records."""

    def __init__(self, held: int) -> None:
        """``held`` is how many counters a task keeps before it passes them on."""
        self.most, self.parts, self.held = held, [], 0

    def add(self, key: np.ndarray, record: np.ndarray, letters: np.ndarray | None = None) -> None:
        """``record`` ascends. A stable sort by key keeps that order inside every term. ``letters`` are the code points of
        each token where ``key`` does not tell them."""
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        k, r = key[order], record[order]
        other = np.append(True, k[1:] != k[:-1])
        starts = np.flatnonzero(other)
        fresh = (other | np.append(True, r[1:] != r[:-1])).astype(np.int64)  # the last record seen for the term is another one
        spelled = () if letters is None else (letters[order[starts]],)
        self.parts.append((k[starts], np.diff(np.append(starts, len(k))), np.add.reduceat(fresh, starts), *spelled))
        self.held += len(starts)

    def full(self) -> bool:
        """Whether the counters are to be passed on: too many are held, also after merging."""
        if self.held > self.most and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])
        return 2 * self.held > self.most and len(self.parts) == 1

    def merged(self) -> tuple[np.ndarray, ...]:
        """``(key, occurrences, records, letters if there are any)``, ascending."""
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        k, o, r, *letters = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(k, kind="stable")
        k, o, r = k[order], o[order], r[order]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        return k[starts], np.add.reduceat(o, starts), np.add.reduceat(r, starts), *(x[order[starts]] for x in letters)

    def passed_on(self) -> tuple[np.ndarray, ...]:
        """The counters; none are held any more."""
        out = self.merged()
        self.parts, self.held = [], 0
        return out
