"""Whole texts as pieces that a tokenizer treats alike wherever they stand.

Both public tokenizers split a text before any merge is tried, and no split part
holds white space after another character. A text may therefore be cut before
every run of white space, and the encoding of a piece be kept for its next
occurrence. Texts in which rarer white space meets these cuts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import batched

#: White space before, then other characters; or white space at the end.
PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Characters that some engine counts as white space and PIECE does not.
RARE_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200E)))
SPACE_OF_ANY = frozenset(RARE_SPACE + " \t\n\x0b\x0c\r")
#: A run of letters and the punctuation behind it, which the tokenizers split there.
#: Without U+0130: in lower case it ends in a mark, which joins the punctuation.
CORE = re.compile(r"([ \t-\r]*[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]+)")
#: What stands between two blanks, if it is letters and then perhaps such punctuation.
PART = re.compile(CORE.pattern.replace(r"[ \t-\r]*", "").removesuffix("+)") + "*)")
#: Pieces of a long text that are looked at together, and the characters from which a text is long.
RUN, LONG = 500_000, 8 << 20
#: Bytes that each table of a worker may come to, an entry counted with its key, value and place; then the older half goes.
KEPT_BYTES, ENTRY_BYTES = 36 << 20, 220
ABSENT = object()


class Recent(dict):
    """What `make` makes of a key, made once while it is remembered: the keys of now, and before them those in `old`."""

    def __init__(self, make: Callable, kept: int = 0):
        super().__init__()
        self.make, self.kept, self.old, self.size = make, kept or KEPT_BYTES, {}, 0

    def __missing__(self, key: str):
        value = self.old.get(key, ABSENT)
        if value is ABSENT:
            value = self.make(key)
        self[key] = value
        self.size += ENTRY_BYTES + len(key) + len(value or b"")
        return value

    def trim(self) -> None:
        """Between texts: forget what was not asked for lately."""
        if self.size > self.kept:
            self.old, self.size = dict(self), 0
            self.clear()


class PieceCache:
    """Values (bytes) of the pieces of texts, each made once while it is remembered.

    `encode` gives the value of a piece, `encode_word` that of letters behind a
    blank, and `join` that of two pieces side by side. A value of None says that
    the text has to be encoded whole.
    """

    def __init__(self, encode: Callable[[str], object], encode_word: Callable[[str], object], join: Callable, kept: int = 0):
        self.encode, self.join = encode, join
        self.words, self.pieces, self.parts = Recent(encode_word, kept), Recent(self.piece, kept), Recent(self.part, kept)

    def piece(self, piece: str):
        """Value of a piece: letters and the punctuation behind them apart."""
        if m := CORE.fullmatch(piece):
            return self.join(self.pieces[m[1]], self.pieces[m[2]])
        return self.encode(piece)

    def part(self, part: str):
        """Value of a blank and what stands between it and the next one.

        A part that is empty or ends in white space would lend it to the next one: None.
        """
        if m := PART.fullmatch(part):
            value = self.words[m[1]]
            return self.join(value, self.pieces[m[2]]) if m[2] else value
        if not part or part[-1] in SPACE_OF_ANY:
            return None
        return self.together(PIECE.findall(" " + part))

    def together(self, pieces: list[str]):
        """Value of some pieces side by side."""
        value = self.pieces[pieces[0]]
        for piece in pieces[1:]:
            other = self.pieces[piece]
            value = None if value is None or other is None else self.join(value, other)
        return value

    def values(self, texts: list[str]) -> Iterator[list]:
        """For each text, the values of its pieces in order; [None] for a text to be encoded whole."""
        for text in texts:
            for table in (self.words, self.pieces, self.parts):
                table.trim()
            if len(text) < LONG:
                first, *parts = text.split(" ")
                found = [self.together(PIECE.findall(first))] if first else []
                found += map(self.parts.__getitem__, parts)
                if None not in found and not (first and first[-1] in SPACE_OF_ANY):
                    yield found
                    continue
            yield self.slowly(text)

    def slowly(self, text: str) -> list:
        """By pieces, some at a time: for texts with runs of white space, and very long ones."""
        found = []
        for pieces in batched((m.group() for m in PIECE.finditer(text)), RUN):
            found += map(self.pieces.__getitem__, pieces)
            self.pieces.trim()
        return [None] if None in found else found
