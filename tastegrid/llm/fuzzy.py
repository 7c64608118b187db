"""Misspelled lexicon terms: Levenshtein automata intersected with a trie of the terms.

The trie and the automata of all its terms are one automaton, whose states are sets of
(trie node, edits so far); it is made deterministic as far as words walk through it.
Most words leave it after a few letters.
"""

from dataclasses import dataclass, field


def edits_allowed(term: str) -> int:
    """Edits with which a word still counts as ``term``; a stem, which ends in *, may be
    followed by anything and so is taken more strictly."""
    if term.endswith("*"):
        return 1 if len(term) > 7 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass
class Trie:
    """Terms as a trie: children, and at a node the term that ends there."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, str] = field(default_factory=dict)
    stems: dict[int, str] = field(default_factory=dict)
    edits: list[int] = field(default_factory=lambda: [0])

    def add(self, term: str) -> None:
        letters, node = term.removesuffix("*"), 0
        allowed = edits_allowed(term)
        for letter in letters:
            self.edits[node] = max(self.edits[node], allowed)
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.edits.append(0)
            node = self.children[node][letter]
        self.edits[node] = max(self.edits[node], allowed)
        (self.stems if term.endswith("*") else self.ends)[node] = term


class Automaton:
    """``match(word)`` is (edits, term) of the nearest term, or None.

    An edit is a letter put in, left out, changed, or swapped with the next one. No
    edit changes the first letter's place in the trie for free: every path starts at
    the root, so the distance is that of whole words, or of a word's start for stems.
    """

    #: Deterministic states held before they are made anew; bounds what a worker holds.
    MOST_STATES = 50_000

    def __init__(self, terms):
        self.trie = Trie()
        for term in sorted(set(terms)):
            self.trie.add(term)
        self._clear()

    def _clear(self):
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.whole: list[tuple[int, str] | None] = []
        self.open: list[tuple[int, str] | None] = []
        self.start = self._state({(0, 0, "")})

    def _closed(self, items: set) -> frozenset:
        """With the letters that may have been left out. An item is (node, edits,
        letter that must come next after a swap)."""
        trie, todo = self.trie, list(items)
        while todo:
            node, edits, swap = todo.pop()
            if swap:
                continue
            for child in trie.children[node].values():
                item = (child, edits + 1, "")
                if edits < trie.edits[child] and item not in items:
                    items.add(item)
                    todo.append(item)
        return frozenset(items)

    def _state(self, items: set) -> int:
        key = self._closed(items)
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.whole.append(self._best(key, self.trie.ends))
            self.open.append(self._best(key, self.trie.stems))
        return self.number[key]

    def _best(self, items: frozenset, terms: dict[int, str]):
        found = [
            (edits, terms[node]) for node, edits, swap in items
            if not swap and node in terms and edits <= edits_allowed(terms[node])
        ]
        return min(found, default=None)

    def _step(self, state: int, letter: str) -> int:
        trie, items = self.trie, set()
        for node, edits, swap in self.states[state]:
            if swap:
                if letter == swap:
                    items.add((node, edits, ""))
                continue
            for want, child in trie.children[node].items():
                if want == letter:
                    items.add((child, edits, ""))
                elif edits < trie.edits[child]:
                    items.add((child, edits + 1, ""))
                    after = trie.children[child].get(letter)
                    if after is not None and edits < trie.edits[after]:
                        items.add((after, edits + 1, want))
            if edits < trie.edits[node]:
                items.add((node, edits + 1, ""))
        to = self._state(items)
        self.next[state][letter] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        if len(self.states) > self.MOST_STATES:
            self._clear()
        state, best = self.start, None
        for letter in word:
            after = self.next[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state < 0:
                return best
            found = self.open[state]
            if found is not None and (best is None or found < best):
                best = found
        found = self.whole[state]
        return found if found is not None and (best is None or found < best) else best
