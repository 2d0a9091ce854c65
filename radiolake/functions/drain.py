"""Mining templates of log lines with a fixed-depth parse tree (He, Zhu, Zheng and Lyu, ICWS 2017)."""

from __future__ import annotations

WILD = "<*>"


class DrainTree:
    """Groups of token sequences of one length that agree in their first tokens and in at least ``similarity`` of all.

    A sequence joins the group of its leaf that is most alike (of equal ones that with more wildcards) and turns the tokens on which they
    differ into wildcards. Tokens with digits go the wildcard's way down; a node with ``most_children`` sends new tokens there too. Beyond ``most_groups``
    the group used longest ago is forgotten.
    """

    def __init__(self, depth: int = 4, similarity: float = 0.4, most_children: int = 100, most_groups: int = 1024):
        self.levels, self.similarity, self.most_children, self.most_groups = max(1, depth - 2), similarity, most_children, most_groups
        self.root: dict = {}
        self.groups: dict[int, list[str]] = {}
        self.leaves: dict[int, list[int]] = {}
        self.made = 0

    def _leaf(self, tokens: list[str]) -> list[int]:
        node = self.root.setdefault(len(tokens), {})
        for token in tokens[: self.levels]:
            if any(c.isdigit() for c in token):
                token = WILD
            if token not in node:
                if token != WILD and len(node) + (WILD not in node) >= self.most_children:
                    token = WILD
                node.setdefault(token, {})
            node = node[token]
        return node.setdefault("", [])  # no token is empty

    def add(self, body: str) -> tuple[int, bool, str]:
        """(group, whether it is new, its template now) of a line's body."""
        tokens = body.split() or [""]
        leaf = self._leaf(tokens)
        leaf[:] = [g for g in leaf if g in self.groups]
        best, rank = None, (-1.0, -1)
        for g in leaf:
            held = self.groups[g]
            wild = held.count(WILD)
            same = sum(a == b for a, b in zip(held, tokens))
            if (same / len(tokens), wild) > rank:
                best, rank = g, (same / len(tokens), wild)
        if best is None or rank[0] < self.similarity:
            self.made += 1
            best = self.made
            leaf.append(best)
            if len(self.groups) >= self.most_groups:
                self.groups.pop(next(iter(self.groups)))
            self.groups[best] = tokens
            return best, True, " ".join(tokens)
        merged = [a if a == b else WILD for a, b in zip(self.groups.pop(best), tokens)]
        self.groups[best] = merged  # moves to the end: used last
        return best, False, " ".join(merged)
