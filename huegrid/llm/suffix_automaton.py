"""A generalised suffix automaton with weighted occurrence counts."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """States of all substrings of the added sequences; count is the weighted number of places a substring ends at."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self._counted = False

    def add(self, sequence: Sequence, weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._clone(last, q, c)
                last = q
                count[q] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p != -1 and (q := nxt[p].setdefault(c, cur)) == cur:
                p = link[p]
            if p != -1:
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c) -> int:
        """A state for the strings of q that extend those of p by c."""
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def finish(self) -> "SuffixAutomaton":
        """Sum the counts up the suffix links, longest strings first."""
        if not self._counted:
            length, link, count = self.length, self.link, self.count
            for s in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
                count[link[s]] += count[s]
            self._counted = True
        return self

    def matching(self, sequence: Sequence, most: int):
        """For each place: the length, at most `most`, of the longest suffix there that occurs in the automaton, and its count."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state = long = 0
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                long = length[state]
            state = nxt[state].get(c, 0)
            long = long + 1 if state else 0
            if long >= most:
                long = most
                while length[link[state]] >= most:
                    state = link[state]
            yield long, count[state] if state else 0
