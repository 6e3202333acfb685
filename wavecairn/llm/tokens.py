"""Token ids of whole texts: every distinct piece is encoded once per worker by the tokenizer's model.

The public word tokenizer lowers the case, drops white space and cuts texts into runs of letters, single
digits and runs of other characters before its model sees them. Texts of plain characters are cut that way
for a whole batch at once; all others go through the complete tokenizer, chunk by white-space separated
chunk. Both give the ids of the tokenizer itself, which the tests compare.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[str, "Encoder"] = {}

#: The cut of the tokenizer files that the fast way reproduces.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]

_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of every byte of a plain text; bytes of U+00C0 to U+00FF count as letters."""
    kinds, lower = np.full(256, _HARD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kinds[0x21:0x7F] = _OTHER
    for a, b in ("az", "AZ"):
        kinds[ord(a) : ord(b) + 1] = _LETTER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kinds[0x80:0xC0] = _LETTER
    kinds[0xC3] = _LETTER
    kinds[ord("'")] = _HARD  # may begin a contraction
    lower[ord("A") : ord("Z") + 1] += 32
    return kinds, lower


_KINDS, _LOWER = _byte_kinds()


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others count up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(rest)}


def default_tokenizer() -> str:
    """The place of the public word tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> "Encoder":
    """The worker's encoder for a tokenizer file (null: the public word tokenizer of this machine)."""
    path = path or default_tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Known:
    """Ids of the keys seen so far, as one flat array with places."""

    def __init__(self):
        self.number: dict = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts, self.counts = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def add(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.number)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(keys) > len(self.starts):
            self.starts, self.counts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.counts))
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[first : first + len(keys)] = counts
        self.starts[first : first + len(keys)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.number.update(zip(keys, range(first, first + len(keys))))

    def expand(self, coded: pa.DictionaryArray, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all elements in a row, and how many each has."""
        number = np.fromiter(map(self.number.__getitem__, keys), dtype=np.int64, count=len(keys))
        chosen = number[coded.indices.to_numpy(zero_copy_only=False)] if keys else np.empty(0, dtype=np.int64)
        counts = self.counts[chosen]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[chosen] - (ends - counts), counts) + np.arange(total)], counts


class Encoder:
    """``kept``: pieces remembered at most; the memory is started anew beyond that."""

    def __init__(self, path: str, kept: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        made = json.loads(self.tokenizer.to_str())
        steps, cuts = (made["normalizer"] or {}).get("normalizers", []), (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.fast = [s["type"] for s in steps] == _NORMAL and cuts[0].get("pattern", {}).get("Regex") == _CUT and cuts[-1].get("type") == "ByteLevel"
        self.pieces, self.chunks = _Known(), _Known()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; a null text has none."""
        texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
        if not self.fast:
            return self._by_chunk(texts)
        data, bounds = self._bytes(texts)
        hard = self._hard(data)
        marks = np.concatenate([[0], np.cumsum(hard)])[bounds]
        plain = marks[1:] == marks[:-1]
        if plain.all():
            return self._by_piece(data, bounds)
        a, na = self._by_piece(*self._bytes(texts.filter(pa.array(plain))))
        b, nb = self._by_chunk(texts.filter(pa.array(~plain)))
        counts = np.empty(len(texts), dtype=np.int64)
        counts[plain], counts[~plain] = na, nb
        ids = np.empty(len(a) + len(b), dtype=np.uint32)
        mine = np.repeat(plain, counts)
        ids[mine], ids[~mine] = a, b
        return ids, counts

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
        return raw[bounds[0] : bounds[-1]], bounds - bounds[0]

    @staticmethod
    def _hard(data: np.ndarray) -> np.ndarray:
        """Bytes that only the complete tokenizer may judge: controls, apostrophes, other scripts, signs, special tokens."""
        hard = _KINDS[data] == _HARD
        if len(data) > 1:
            second = data[1:]
            hard[1:] |= (data[:-1] == 0xC3) & ((second == 0x97) | (second == 0xB7))
            hard[1:] |= (data[:-1] == ord("<")) & (second == ord("|"))
        return hard

    def _by_piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, low = _KINDS[data], _LOWER[data]
        if len(data) > 1:
            wide = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
            low[1:][wide] += 32
        begins = kinds != _SPACE
        shown = low[begins]
        same = np.zeros(len(data), dtype=bool)
        same[1:] = (kinds[1:] == kinds[:-1]) & (kinds[1:] != _DIGIT)
        same[bounds[:-1][bounds[:-1] < len(data)]] = False
        first = np.flatnonzero(begins & ~same)
        offsets = np.append(np.cumsum(begins, dtype=np.int32)[first] - 1, len(shown)).astype(np.int64)
        n = len(offsets) - 1
        array = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(shown))])
        coded = array.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces.number) + len(keys) > self.kept:
            self.pieces = _Known()
        known = self.pieces.number
        new = [k for k in keys if k not in known]
        if new:
            tokenize, letters = self.model.tokenize, self.letters
            found = [[t.id for t in tokenize(k.decode() if k.isascii() else k.decode("latin-1").translate(letters))] for k in new]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.pieces.add(new, np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(counts.sum())), counts)
        ids, counts = self.pieces.expand(coded, keys)
        at = np.concatenate([[0], np.cumsum(counts)])
        pieces = np.searchsorted(first, bounds)
        return ids, at[pieces[1:]] - at[pieces[:-1]]

    def _by_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.chunks.number) + len(keys) > self.kept // 4:
            self.chunks = _Known()
        new = [k for k in keys if k not in self.chunks.number]
        for begin in range(0, len(new), 4096):
            part = new[begin : begin + 4096]
            encoding = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(encoding.word_ids, dtype=np.int64), minlength=len(part))
            self.chunks.add(part, np.array(encoding.ids, dtype=np.uint32), counts)
        ids, counts = self.chunks.expand(coded, keys)
        at = np.concatenate([[0], np.cumsum(counts)])
        borders = np.concatenate([[0], np.cumsum(per_text)])
        return ids, at[borders[1:]] - at[borders[:-1]]
