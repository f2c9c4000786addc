"""Byte-pair encoding as a deterministic transducer that reads left to right.

Byte-pair encoding has a prefix property: every prefix of a symbol sequence
has one encoding, and a list of tokens is an encoding exactly if each adjacent
pair of tokens is the encoding of its own concatenation.  So the last token of
the encoding of ``x + c`` is the one token that ends there and forms a valid
pair with the last token of what stands before it.  What the future can depend
on is small: those earlier boundaries at which a longer token may still have
begun, with their place in the token trie and the last token before them.
That is the state here.  States and transitions are compiled when first met, up to a bound;
beyond it, ``walk`` does the same steps without keeping the states.
"""

from __future__ import annotations

START = -1
#: Keys of a trie node besides symbols: the token that ends here, and the depth.
TOKEN, DEPTH = "", "##"


class State:
    """A state of the transducer.

    ``live``: (trie node, last token before it, emitted tokens there less those
    here) from the longest to the shortest; ``next``: symbol to (state, change
    of the number of emitted tokens, last token).
    """

    __slots__ = ("live", "next")

    def __init__(self, live):
        self.live, self.next = live, {}


class PrefixBpe:
    """``merge(a, b)`` gives (rank, token) of the merge of two tokens, or None.

    ``spell``: token to its tuple of symbols.  Tokens that byte-pair encoding
    never yields for their own symbols are left out.  ``max_states`` bounds the
    compiled states, ``max_pairs`` the remembered pairs.
    """

    def __init__(self, spell: dict, merge, max_states: int = 25_000, max_pairs: int = 350_000):
        self.merge, self.spell, self.max_states, self.max_pairs = merge, spell, max_states, max_pairs
        self.base = {s[0]: t for t, s in spell.items() if len(s) == 1}
        self.trie, self.longest = {DEPTH: 0}, 1
        for token, symbols in spell.items():
            if len(symbols) > 1 and self.plain(symbols) != [token]:
                continue
            node = self.trie
            for c in symbols:
                node = node.setdefault(c, {DEPTH: node[DEPTH] + 1})
            node[TOKEN], self.longest = token, max(self.longest, len(symbols))
        self.pairs: dict = {}
        self.states: dict = {}
        self.start = State(((self.trie, START, 0),))

    def plain(self, symbols) -> list:
        """The encoding by its definition: the best merge first, the leftmost of equals."""
        tokens = [self.base[c] for c in symbols]
        while len(tokens) > 1:
            best = min(((m[0], i, m[1]) for i in range(len(tokens) - 1) if (m := self.merge(tokens[i], tokens[i + 1]))), default=None)
            if best is None:
                break
            tokens[best[1] : best[1] + 2] = [best[2]]
        return tokens

    def valid(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow token ``a``."""
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            found = self.pairs[key] = self.plain(self.spell[a] + self.spell[b]) == [a, b]
        return found

    def walk(self, live, symbols, back: list):
        """Read ``symbols`` from a state's ``live``; the last token of each place goes to ``back``.

        Returns the new ``live`` with counts from where the old one stood.
        Raises KeyError at a symbol without a token.
        """
        pairs, root = self.pairs.get, self.trie
        for c in symbols:
            after, token, count = [], None, 0
            for node, last, n in live:
                child = node.get(c)
                if child is None:
                    continue
                if token is None:
                    t = child.get(TOKEN)
                    if t is not None:
                        ok = True if last < 0 else pairs(last << 24 | t)
                        if ok or (ok is None and self.valid(last, t)):
                            token, count = t, n + 1
                            if len(child) == 2:  # no longer token
                                continue
                after.append((child, last, n))
            if token is None:
                raise KeyError(c)
            after.append((root, token, count))
            back.append(token)
            live = after
        return live

    def step(self, state: State, symbol):
        """The transition of ``state`` on ``symbol``, compiled; None if there are too many states."""
        if len(self.states) >= self.max_states:
            return None
        back: list = []
        live = self.walk(state.live, (symbol,), back)
        change = live[-1][2]
        live = tuple((n, t, c - change) for n, t, c in live if len(n) > 1 + (TOKEN in n))
        key = tuple((id(n), t, c) for n, t, c in live)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(live)
        found = state.next[symbol] = (to, change, back[0])
        return found
