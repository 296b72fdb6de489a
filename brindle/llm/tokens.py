"""Tokenizing whole texts quickly with the tokenizers library.

The tokenizers library spends about a microsecond a byte.  Words repeat, so each
task keeps a two-generation table from a piece of text to its ids, and only pieces
that it has not seen go to the library.  Pieces are cut where the pre-tokenizer
cuts in any case:

* ``space`` mode (byte-level BPE): before a single space that has no white space
  beside it, and before a single newline.  A text with any other white space at a
  piece's edge goes to the library whole.
* ``drop`` mode (a pre-tokenizer that drops white space): at white space.

Words of plain Latin letters are one pre-token each, so they go to the library's model
alone, past its normalizer and pre-tokenizer, whose work on single letters is tabled.
A text that holds a special token's own spelling goes to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .common import KEPT

#: Id that ends each document in the contracts of packing and binary output.
END_ID = 2

_EDGE = re.compile(r"^\s|\s$|[\x1c-\x1f]")
#: A word of plain letters with marks behind it: pre-tokenizers cut between the two.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = {"space": re.compile(rf"\x00?[{_LETTERS}]+\Z"), "drop": re.compile(rf"[{_LETTERS}]+\Z")}
_MARKED = re.compile(r"(\n?)(\x00?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)\Z|(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)\Z")
#: A comma or stop that is not between a plain letter or digit and white space.
_TIGHT = re.compile(rf"[,.](?:(?<![0-9{_LETTERS}][,.])|(?!\s|\Z))")
#: White space for Python alone.
_CONTROL = re.compile(r"[\x1c-\x1f]")


def tokenizer_path(name_or_path: str) -> str:
    """A path as given, or the place of a public vocabulary file by its name."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class PieceEncoder:
    """Ids of whole texts as little-endian bytes; ``width`` bytes an id (2 if the vocabulary allows)."""

    def __init__(self, path: str, mode: str, generation: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(path))
        added = self.tok.get_added_tokens_decoder().values()
        # Marks that the library looks for before anything else; one that is sought in normalized text is met in any case.
        marks = sorted({t.content for t in added if t.content}, key=lambda c: (-len(c), c))
        self.special = re.compile("|".join(map(re.escape, marks)), re.I) if marks else None
        self.vocabulary = self.tok.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.vocabulary <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.id_bytes = [i.to_bytes(self.width, "little") for i in range(self.vocabulary)]
        self.mode, self.generation = mode, generation
        self.plain = self._letter_table()
        self.pieces = _Pieces(self._make)

    def _letter_table(self) -> dict[int, str] | None:
        """What normalizer and pre-tokenizer make of each plain letter; None if the model needs more than that."""

        def shown(c: str) -> str:
            for part in filter(None, (self.tok.normalizer,)):
                c = part.normalize_str(c)
            return "".join(x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(c))

        letters = [chr(c) for c in range(256) if _PLAIN[self.mode].match(chr(c))]
        table = {ord(c): shown(c) for c in letters}
        if self.mode == "space":
            table[32] = shown(" a")[: -len(shown("a"))]
        trial = ["".join(letters[i::7]) for i in range(7)] + ["Straße", "été", "TheÀ", "a", *letters]
        lead = " " if self.mode == "space" else ""
        ok = all(self._model(lead + w, table) == ids for w, ids in zip(trial, self._raw([lead + w for w in trial]), strict=True))
        return table if ok else None

    def _model(self, word: str, table: dict[int, str]) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in self.tok.model.tokenize(word.translate(table))])

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _make(self, p: str) -> bytes | None:
        """Ids of a piece that the tables lack; None if they depend on what stands beside it."""
        spaced = self.mode == "space"
        if self.plain and _PLAIN[self.mode].match(p):
            word = p[1:] if p[0] == "\x00" else " " + p if spaced else p
            found = self.tok.model.tokenize(word.translate(self.plain))
            return self.id_bytes[found[0].id] if len(found) == 1 else b"".join([self.id_bytes[t.id] for t in found])
        if p == "\x00\n":  # cut off before a word
            return self._raw(["\n"])[0]
        if not p or p == "\n" or spaced and _EDGE.search(p[1:] if p[0] in "\n\x00" else p):
            return None
        if m := _MARKED.match(p):
            line, word, marks = (m[4], m[5], "") if m[4] else (m[1], m[2], m[3])
            parts = [line and "\x00\n", "\x00" + word if line and spaced else word, marks and "\x00" + marks if spaced else marks]
            return b"".join([self.pieces[x] for x in parts if x])
        text = (p if p[0] == "\n" else p[1:] if p[0] == "\x00" else " " + p) if spaced else p
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _cut(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            return [""]
        loose = not _TIGHT.search(text)  # then commas and stops are pieces of their own
        if self.mode == "drop":
            if _CONTROL.search(text):
                return [""]
            return text.replace(",", " ,").replace(".", " .").split() if loose else text.split()
        if "\x00" in text:  # the mark of a piece without a space before it
            return [""]
        if loose:
            text = text.replace(",", " \x00,").replace(".", " \x00.")
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\x00" + pieces[0]  # no space before the first one
        return pieces

    def encode(self, texts: list[str]) -> list[bytes]:
        """One byte string of ids per text, without an end id."""
        out: list[bytes | None] = []
        find = self.pieces.__getitem__
        for t in texts:
            pieces = self._cut(t)
            try:
                out.append(b"".join(map(find, pieces)))
            except TypeError:  # a piece that depends on what stands beside it
                out.append(None)
            if len(self.pieces) > 2 * self.generation:
                self.pieces.age()
        whole = [i for i, p in enumerate(out) if p is None]
        if whole:
            for i, ids in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
                out[i] = ids
        return out


class _Pieces(dict):
    """From pieces to their ids, made when first asked for; what an age did not ask for is forgotten with the next one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes | None:
        known = self.old.get(piece, 0)
        if known == 0:
            known = self.make(piece)
        self[piece] = known
        return known

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


@lru_cache(maxsize=1)
def encoder(path: str, mode: str, generation: int = 300_000) -> PieceEncoder:
    """The worker process's encoder: what one task has learned serves the next.

    Its tables hold four times ``generation`` pieces at most, of about 250 bytes each.
    """
    return PieceEncoder(path, mode, generation)


KEPT["tokens"] = encoder.cache_clear
