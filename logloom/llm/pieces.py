"""Texts as pieces whose token ids are found once for many texts.

The pre-tokenizing pattern of byte-level BPE ends a match before a lone space or newline
between other characters, so a text may be cut there: its ids are those of its pieces, one
after another. Arrow cuts many texts and numbers their different pieces; only these are
encoded, and numpy puts the ids of all texts together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import release

#: Pieces whose ids a worker keeps before it begins anew, the longest piece kept, and the
#: bytes of texts encoded together. Bounds of memory only.
KEPT, KEPT_CHARS, BATCH_BYTES = 800_000, 64, 24 << 20
#: White space in a row, which the pattern may see as one, or the mark that cuts are made at:
#: such texts are cut by the pattern itself.
_ODD = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]{2}|\x00"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Pieces:
    """Ids of texts, by an encoder of lists of pieces to little-endian 32-bit integers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str, most: int = KEPT, size: int = BATCH_BYTES, special: tuple[str, ...] = ()):
        """``most``: pieces kept, from one Arrow batch to the next, before all are let go. ``size``: the
        bytes of texts encoded together. ``special``: strings that are a token wherever they
        stand, and part what is before them from what follows."""
        self.encode, self.pattern, self.most, self.size, self.kept = encode, regex.compile(pattern), most, size, {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def matches(self, text: str) -> list[str]:
        """The pattern's matches, those of each part between special strings by themselves."""
        if self.special is None:
            return self.pattern.findall(text)
        return [m for k, part in enumerate(self.special.split(text)) for m in ([part] if k % 2 else self.pattern.findall(part))]

    def cut(self, texts: pa.Array) -> pa.Array:
        """A list of pieces for each text: a line's first word, a space and a word, a newline."""
        odd = pc.match_substring_regex(texts, _ODD)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(marked, "\0")
        if not pc.any(odd).as_py():
            return lists
        kind = pa.list_(pa.string())
        by_pattern = pa.array([self.matches(t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], kind)
        return pc.if_else(odd, by_pattern, lists.cast(kind))

    def bare(self, piece: str) -> str:
        """The piece without marks after its word, which are a match of their own; else itself."""
        word = piece.rstrip(_MARKS)
        return word if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) else piece

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, of which new ones are encoded."""
        kept = self.kept
        if len(kept) > self.most:
            kept.clear()
        new = [p for p in pieces if p not in kept]
        parts = {p: (w, p[len(w) :]) for p in new if p and (w := self.bare(p)) != p}
        fresh = list({p for p in new if p not in parts}.union(x for pair in parts.values() for x in pair) - kept.keys())
        kept.update(zip(fresh, self.encode(fresh), strict=True))
        kept.update((p, kept[w] + kept[marks]) for p, (w, marks) in parts.items())
        out = [kept[p] for p in pieces]
        for p in new:
            if len(p) > KEPT_CHARS:
                kept.pop(p, None)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, and where each text's end."""
        lists = self.cut(texts)
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        ids = self.known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), "<u4")
        sizes = size[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return gather(table, (np.cumsum(size) - size)[which], sizes), upto[offsets[1:]]

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``batch`` of slices of ``texts`` of about ``size`` bytes; null is empty, invalid
        UTF-8 is read with replacement characters."""
        if pa.types.is_binary(texts.type):
            try:
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:
                texts = pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.size)))
            # a slice is copied to an array of its own, so that offsets begin at 0
            yield self.batch(pa.concat_arrays([texts.slice(at, stop - at)]))
            at = stop
        if len(self.kept) > self.most:
            self.kept = {}
        release()

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for ids, ends in self.batches(texts):
            yield from np.split(ids, ends[:-1])
