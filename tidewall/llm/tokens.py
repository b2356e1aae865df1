"""Encoding of whole texts with a public tokenizer, each distinct piece once.

The tokenizer's normaliser and splitter never look across ASCII white space nor across an edge between an ASCII
letter and an ASCII mark other than the apostrophe, so the ids of a text are the ids of its pieces
in order. The pieces of a batch are found by array operations, and only pieces that the worker has
not met go through the tokenizers library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tidewall.llm import arrays as A

CHUNK = 2_000_000  # bytes encoded at once
KNOWN_PIECES = 1_000_000  # pieces remembered by a worker
LETTER, MARK, SPACE, OTHER = 1, 2, 0, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 13, 32]] = SPACE
KIND[np.r_[65:91, 97:123]] = LETTER
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = MARK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the UTF-8 bytes of a Latin letter in a byte-level vocabulary: a byte
    that prints as itself in Latin-1 stands for itself, the others follow from 256 on in their order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


AS_BYTES = _byte_letters()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of whole texts. ``file`` names a vocabulary whose normaliser lowers the case and drops white space.

    A text that holds one of the vocabulary's added tokens, which may span pieces, goes to the library whole.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary(file))
        self.merges = self.tok.model
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pieces
        self.at = np.zeros(0, np.int64)  # where each one's ids start in ids
        self.n = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        pieces = [raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        found: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if LATIN(piece):  # one run of letters, already composed: only the merges are left to do
                found[i] = [t.id for t in self.merges.tokenize(piece if piece.isascii() else piece.translate(AS_BYTES))]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._library([raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in rest]), strict=True):
            found[i] = ids
        n = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter((i for f in found for i in f), np.uint32, int(n.sum()))
        at = np.cumsum(n, dtype=np.int64) - n + len(self.ids)
        slot = np.searchsorted(self.keys, hashes)  # both are sorted
        self.keys = np.insert(self.keys, slot, hashes)
        self.at, self.n = np.insert(self.at, slot, at), np.insert(self.n, slot, n)
        self.ids = np.concatenate([self.ids, ids])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, and the number of ids of each."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind = KIND[data]
        first = kind != SPACE
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        before[offsets[(offsets > 0) & (offsets < len(data))]] = SPACE
        edge = (before == SPACE) | ((kind == LETTER) & (before == MARK)) | ((kind == MARK) & (before == LETTER))
        starts = np.flatnonzero(first & edge)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        stop = np.flatnonzero(edge | ~first)
        stop = np.append(stop, len(data))
        ends = stop[np.searchsorted(stop, starts, "right")]
        low = LOWER[data]
        hashes = A.run_hashes(A.BYTE_CODE[low], starts, ends, A.BYTES)
        keys, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(slot, len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) + int(new.sum()) > KNOWN_PIECES:
                self.clear()
                new[:] = True
            pick = sample[new]
            self._learn(data, keys[new], starts[pick], ends[pick])
            slot = np.searchsorted(self.keys, keys)
        at, n = self.at[slot][back], self.n[slot][back].astype(np.int64)
        total = np.cumsum(n)
        ids = self.ids[np.repeat(at - (total - n), n) + np.arange(int(total[-1]))]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more entry than texts)."""
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in A.chunks(offsets, CHUNK):
            part = data[offsets[lo] : offsets[hi]]
            where = offsets[lo : hi + 1] - offsets[lo]
            raw = part.tobytes()
            if any(s in raw for s in self.special):
                for i in range(hi - lo):
                    one = part[where[i] : where[i + 1]]
                    text = one.tobytes()
                    if any(s in text for s in self.special):
                        ids = np.array(self._library([text.decode("utf-8", "replace")])[0], np.uint32)
                        parts.append(ids)
                        counts.append(np.array([len(ids)]))
                    else:
                        ids, n = self._plain(one, np.array([0, len(one)]))
                        parts.append(ids)
                        counts.append(n)
            else:
                ids, n = self._plain(part, where)
                parts.append(ids)
                counts.append(n)
        n = np.concatenate(counts)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(file: str = "word_bpe_49k.json") -> PieceEncoder:
    """The worker's encoder for a vocabulary; it keeps what it has learnt from task to task."""
    if file not in _ENCODERS:
        _ENCODERS[file] = PieceEncoder(file)
    return _ENCODERS[file]
