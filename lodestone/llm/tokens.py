"""Byte-level BPE encoding of whole texts in Arrow batches.

A byte-level vocabulary never lets a token cross the place before a space that follows a character
which is not white space.  Texts are cut there, each distinct piece of a batch is encoded once by the
tokenizers library, many in one text, and the ids are gathered with numpy.  Texts in which white space stands before a
space are encoded in one go instead, so the ids are those of the whole text in every case.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space (or a control that some definitions count as such) before a space.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
_KEPT_PIECES = 400_000
#: How a byte-level vocabulary writes a space, and words encoded as one text.
_SPACE, _TOGETHER = "\u0120", 1000
#: Bytes of text encoded at a time.
BATCH_BYTES = 12 << 20
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes Arrow string arrays; keeps the ids of the first ``_KEPT_PIECES`` pieces it meets."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(_SPACE)]] = True
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lens.sum())), lens

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words behind a space each: many are one text, and a token with a space in front begins a word."""
        out, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), _TOGETHER):
            part = words[a:a + _TOGETHER]
            got = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids
            got = np.array(got, np.uint32)
            first = np.flatnonzero(self.spaced[got])
            size = np.diff(first, append=len(got))
            if len(first) != len(part):  # the vocabulary has other tokens with a space in front
                got, size = self._encode([" " + w for w in part])
            out.append(got)
            lens.append(size)
        return np.concatenate(out), np.concatenate(lens)

    def _pieces(self, words: list[str], lead: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All known ids, and the start and length in them of each word behind a space, and of each word that
        begins a text."""
        keys = words + [" " + x for x in lead]  # no word has a space
        at = np.fromiter(map(self.place.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0).tolist()
        ids, ends = self.ids, self.ends
        if new:
            plain = [i for i in new if i < len(words) and keys[i] and not keys[i][-1].isspace()]
            rest = sorted(set(new).difference(plain))
            fresh, lens = self._words([keys[i] for i in plain])
            more, more_lens = self._encode([" " + keys[i] if i < len(words) else keys[i][1:] for i in rest])
            new = plain + rest
            ids = np.concatenate([ids, fresh, more])
            ends = np.concatenate([ends, ends[-1] + np.cumsum(np.concatenate([lens, more_lens]))])
            at[new] = len(self.ends) - 1 + np.arange(len(new))
            if room := min(len(new), _KEPT_PIECES - len(self.place)):
                self.place.update(zip((keys[i] for i in new[:room]), range(len(self.ends) - 1, len(self.ends) - 1 + room)))
                self.ids, self.ends = ids[: ends[len(self.ends) - 1 + room]].copy(), ends[: len(self.ends) + room].copy()
        return ids, ends[at], ends[at + 1] - ends[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and the end of each text's ids."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(texts, odd)
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy()
        bounds = bounds - bounds[0]
        flat = words.flatten().dictionary_encode()
        code, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
        lead = np.unique(code[bounds[:-1]]) if len(texts) else np.zeros(0, code.dtype)
        ids, start, size = self._pieces(names, [names[i] for i in lead])
        code = code.astype(np.int64)
        code[bounds[:-1]] = len(names) + np.searchsorted(lead, code[bounds[:-1]])
        lens = size[code]
        ends = np.cumsum(lens)
        take = np.repeat(start[code] - (ends - lens), lens)
        take += np.arange(len(take))
        return ids[take], np.concatenate([[0], ends])[bounds[1:]]

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, plain_ends = self.encode(texts.filter(pa.array(~odd)))
        whole, whole_lens = self._encode(texts.filter(pa.array(odd)).to_pylist())
        lens = np.zeros(len(texts), np.int64)
        lens[~odd], lens[odd] = np.diff(plain_ends, prepend=0), whole_lens
        ends = np.cumsum(lens)
        out, is_odd = np.empty(int(lens.sum()), np.uint32), np.repeat(odd, lens)
        out[~is_odd], out[is_odd] = plain, whole
        return out, ends


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
