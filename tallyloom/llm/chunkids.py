"""Token ids of whole texts, encoding each distinct piece of text once per batch.

A text is cut where the tokenizer always cuts too, so ids of the pieces, one after another, are ids of the text.
Repeated pieces are looked up by a 64-bit hash in a bounded table per worker; the rest go through the tokenizer, many
pieces in one input.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from tallyloom.llm.textbatch import SPACE, Texts

#: Distinct pieces that a worker remembers at most; about 25 bytes each plus their ids.
MEMO = 500_000

#: Bytes of text per call of an encoder: larger slices look fewer pieces up twice.
CALL_BYTES = 1 << 20

#: Pieces that the tokenizer gets as one input: an input of its own for every piece costs twice the time.
JOINED = 256

#: All ids of some pieces in order, and how many each piece has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def at_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For tokenizers that drop white space: each word is a piece."""
    starts, ends = texts.words()
    return starts, ends, None


#: White space of Unicode beyond the six bytes of SPACE, as UTF-8: fixed values of the Unicode standard.
WIDE_SPACE = [
    b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\x80", b"\xe2\x80\x81",
    b"\xe2\x80\x82", b"\xe2\x80\x83", b"\xe2\x80\x84", b"\xe2\x80\x85", b"\xe2\x80\x86", b"\xe2\x80\x87",
    b"\xe2\x80\x88", b"\xe2\x80\x89", b"\xe2\x80\x8a", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf",
    b"\xe2\x81\x9f", b"\xe3\x80\x80",
]


def before_space(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For byte-level tokenizers: cut where a run of white space starts. Texts with wider white space stay whole."""
    d = texts.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    space = SPACE[d]
    first = space.copy()
    first[1:] &= ~space[:-1]
    odd = None
    rare = np.flatnonzero(np.isin(d, [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]))
    if len(rare):
        hit = [p for p in rare.tolist() if any(d[p : p + len(w)].tobytes() == w for w in WIDE_SPACE)]
        if hit:
            odd = np.zeros(len(texts), bool)
            odd[texts.owner(np.array(hit))] = True
            first &= ~np.repeat(odd, np.diff(texts.offsets))
    return _cut(texts, first) + (odd,)


def before_blank(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For pieces that can hold a blank only in front: cut where a run of blanks starts."""
    d = texts.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    blank = d == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    return _cut(texts, first) + (None,)


def _cut(texts: Texts, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    filled = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    first[filled] = True
    starts = np.flatnonzero(first)
    return starts, np.concatenate((starts[1:], [len(texts.data)]))


def flat(made: list[list[int]], dtype=np.uint16) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces that were encoded one by one, as an Encode returns them."""
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    return np.fromiter((x for ids in made for x in ids), dtype, int(sizes.sum())), sizes


class JoinedEncode:
    """Encodes pieces with a ``tokenizers.Tokenizer``, many joined by ``glue`` into one input.

    ``glue`` is text between two pieces at which the tokenizer cuts and which gives no ids. Where the ids of a piece end
    follows from the bytes that each id stands for. Pieces that might not be cut off from their neighbours, and inputs
    whose ids don't end where their pieces end, are encoded piece by piece.
    """

    def __init__(self, tokenizer, glue: str):
        self.tokenizer, self.glue = tokenizer, glue
        suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.uint16 if max(vocabulary.values(), default=0) < 1 << 16 else np.uint32
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():  # one sign of a token stands for one byte
            self.bytes_of[number] = len(token.removesuffix(suffix))

    def _apart(self, piece: str) -> bool:
        """Whether a piece must have an input of its own: without glue it has to start with white space and end without."""
        return "<|" in piece or (not self.glue and (piece[0] not in " \t\n\x0b\x0c\r" or piece[-1].isspace()))

    def _bytes(self, piece: str) -> int:
        """Bytes of a piece as the model sees it."""
        if piece.isascii():
            return len(piece)
        normal = self.tokenizer.normalizer
        return len((normal.normalize_str(piece) if normal else piece).encode())

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)], self.dtype)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        apart = np.fromiter(map(self._apart, pieces), bool, len(pieces))
        together = np.flatnonzero(~apart)
        parts, sizes = [], np.zeros(len(pieces), np.int64)
        order = [together]
        for at in range(0, len(together), 16 * JOINED):
            groups = [together[a : a + JOINED] for a in range(at, min(at + 16 * JOINED, len(together)), JOINED)]
            texts = [self.glue.join([pieces[i] for i in g.tolist()]) for g in groups]
            for group, made in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(made.ids, self.dtype)
                ends = np.cumsum([self._bytes(pieces[i]) for i in group.tolist()])
                upto = np.cumsum(self.bytes_of[ids])
                last = np.searchsorted(upto, ends)
                if len(upto) and last[-1] == len(upto) - 1 and np.array_equal(upto[last], ends):
                    parts.append(ids)
                    sizes[group] = np.diff(last, prepend=-1)
                else:
                    ids, sizes[group] = self._each([pieces[i] for i in group.tolist()])
                    parts.append(ids)
        alone = np.flatnonzero(apart)
        if len(alone):
            ids, sizes[alone] = self._each([pieces[i] for i in alone.tolist()])
            parts.append(ids)
            order.append(alone)
        ids = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        # back to the order of the pieces
        place = np.concatenate(order)
        begin = np.zeros(len(pieces), np.int64)
        begin[place] = np.cumsum(sizes[place]) - sizes[place]
        ends = np.cumsum(sizes)
        return ids[np.repeat(begin - ends + sizes, sizes) + np.arange(len(ids))], sizes


class ChunkEncoder:
    """Encodes batches of texts; keeps ids of pieces seen before, up to MEMO of them."""

    def __init__(self, cut, encode: Encode, dtype=np.uint16, memo: int = MEMO):
        self.cut, self.encode, self.dtype, self.memo = cut, encode, dtype, memo
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keeps only pieces that were met again since the last time, at most half of MEMO."""
        kept = np.flatnonzero(self.again[self.slot])
        if len(kept) > self.memo // 2:
            kept = kept[:0]
        slot = self.slot[kept]
        self.keys, size = self.keys[kept], self.size[slot]
        begin = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.begin[slot] - begin, size) + np.arange(size.sum())]
        self.slot, self.begin, self.size = np.arange(len(kept)), begin, size
        self.again = np.zeros(len(kept), bool)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch in order, and the number of ids per text."""
        starts, ends, _ = self.cut(texts)
        n = len(texts)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        keys, where, back = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
        slots = self._slots(texts, keys, starts[where], ends[where])
        slot = slots[back]
        sizes = self.size[slot]
        upto = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.begin[slot] - upto + sizes, sizes) + np.arange(upto[-1])]
        pieces = np.searchsorted(starts, texts.offsets)
        upto = np.concatenate(([0], upto))
        return ids, upto[pieces[1:]] - upto[pieces[:-1]]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def _slots(self, texts: Texts, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at, known = self._find(keys)
        if len(self.keys) and len(self.keys) + np.count_nonzero(~known) > self.memo:
            self._forget()
            at, known = self._find(keys)
        self.again[self.slot[at[known]]] = True
        new = np.flatnonzero(~known)
        if len(new):
            data = texts.data.tobytes()
            words = [data[a:b].decode("utf-8") for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            made, size = self.encode(words)
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
            slot = np.arange(len(self.size) - len(new), len(self.size))
            self.ids = np.concatenate((self.ids, made))
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.slot = np.insert(self.slot, at[new], slot)
            at = np.searchsorted(self.keys, keys)
        return self.slot[at]
