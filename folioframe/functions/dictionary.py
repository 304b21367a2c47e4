"""Replacing the terms of a large dictionary one after the other, with one automaton instead of one pass a term."""

from __future__ import annotations


class Replacer:
    """Gives the text that remains when every term of a list, none twice, is replaced in the order of the list; an empty term is passed over.

    A term changes a text only if it is there at its turn. An automaton finds all terms of a text in one scan. If their places
    lie so far apart that no term can touch two of them, and no term is found again on what was put in, the order does not
    matter and all are replaced at once. Else the terms are taken in order: the first that is there is replaced, and what it
    made is scanned again for the ones after it. Both ways give what a loop over the whole list gives.
    """

    def __init__(self, terms: list[tuple[str, str]]):
        import ahocorasick

        if len({cn for cn, _ in terms}) < len(terms):
            raise ValueError("a term is there twice")
        self.terms = terms
        self.longest = max((len(cn) for cn, _ in terms), default=0)
        self.automaton = ahocorasick.Automaton()
        for order, (cn, _) in enumerate(terms):
            if cn:
                self.automaton.add_word(cn, order)
        self.automaton.make_automaton()

    def _found(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, order) of all terms in a text."""
        return [(end + 1 - len(self.terms[order][0]), end + 1, order) for end, order in self.automaton.iter(text)]

    def __call__(self, text: str) -> str:
        if not len(self.automaton):
            return text
        found = self._found(text)
        if not found:
            return text
        made = self._at_once(text, sorted(found))
        return self._in_order(text, found) if made is None else made

    def _at_once(self, text: str, found: list[tuple[int, int, int]]) -> str | None:
        out, at, size, put = [], 0, 0, []
        for start, end, order in found:
            if put and start - at < self.longest - 1:
                return None
            new = self.terms[order][1]
            size += start - at
            out += [text[at:start], new]
            put.append((size, size + len(new)))
            size += len(new)
            at = end
        made = "".join([*out, text[at:]])
        k = 0
        for start, end, _ in sorted(self._found(made)):
            while k < len(put) and put[k][1] <= start:
                k += 1
            if any(a < end and start < b for a, b in put[k : k + 1]):
                return None
        return made

    def _in_order(self, text: str, found: list[tuple[int, int, int]]) -> str:
        done = -1
        while True:
            order = min((o for _, _, o in found if o > done), default=None)
            if order is None:
                return text
            text = text.replace(*self.terms[order])
            done, found = order, self._found(text)
