"""WordPiece and byte-pair tokenizers of embedding models, as kernels and as Arrow functions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

ENCODED = "struct<input_ids: array<int>, attention_mask: array<int>>"
#: Ids of special tokens where the vocabulary has none.
UNK, CLS, SEP, PAD = 100, 101, 102, 0
#: Fixed value: the pre-tokenizer pattern.
BPE_SPLIT = regex.compile(r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+")


class TextTokenizer(Protocol):
    padding_side: str

    def encode(self, text: str) -> tuple[list[int], list[int]]: ...


def is_punctuation(c: str) -> bool:
    v = ord(c)
    return 33 <= v <= 47 or 58 <= v <= 64 or 91 <= v <= 96 or 123 <= v <= 126 or unicodedata.category(c) == "Po"


def basic_tokens(text) -> Column:
    """Lower-cased words, and each punctuation mark by itself, JVM-side."""
    mark = r"[!-/:-@\[-`{-~\p{Po}]"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({mark}|[^\s\x85\p{{Z}}!-/:-@\[-`{{-~\p{{Po}}]+)"), 1)


def pad(ids: list[int], mask: list[int], length: int, side: str = "right", fill: int = 0) -> tuple[list[int], list[int]]:
    """To a fixed length: cut at the end, or filled on one side."""
    if len(ids) >= length:
        return ids[:length], mask[:length]
    more = length - len(ids)
    if side == "left":
        return [fill] * more + ids, [0] * more + mask
    return ids + [fill] * more, mask + [0] * more


class WordPiece:
    """Greedy longest pieces; a word with an unknown rest is one unknown token."""

    padding_side = "right"

    def __init__(self, vocab: dict[str, int], max_length: int = 512):
        self.vocab, self.max_length = vocab, max_length
        self.unk, self.cls, self.sep, self.pad = (vocab.get(k, d) for k, d in (("[UNK]", UNK), ("[CLS]", CLS), ("[SEP]", SEP), ("[PAD]", PAD)))

    @classmethod
    def from_text(cls, vocab_txt: str, max_length: int = 512) -> "WordPiece":
        """A line's number is its token's id; blank lines only count."""
        lines = (line.strip(" \t\r") for line in vocab_txt.split("\n"))
        return cls({t: i for i, t in enumerate(lines) if t}, max_length)

    def words(self, text: str) -> list[str]:
        out, word = [], ""
        for c in text.lower():
            gap = c.isspace()
            if (gap or is_punctuation(c)) and word:
                out.append(word)
                word = ""
            if gap:
                continue
            if is_punctuation(c):
                out.append(c)
            else:
                word += c
        return out + [word] * bool(word)

    def pieces(self, word: str) -> list[str]:
        if word in self.vocab:
            return [word]
        out, at = [], 0
        while at < len(word):
            lead = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in self.vocab), None)
            if end is None:
                return ["[UNK]"]
            out.append(lead + word[at:end])
            at = end
        return out or ["[UNK]"]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        tokens = [p for w in self.words(text) for p in self.pieces(w)][: max(0, self.max_length - 2)]
        ids = [self.cls, *(self.vocab.get(t, self.unk) for t in tokens), self.sep]
        return pad(ids, [1] * len(ids), self.max_length, "right", self.pad)


def byte_letters() -> dict[int, str]:
    """A printable letter for every byte: visible Latin-1 bytes stand for themselves, the others get the
    code points from 256 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or (161 <= b and b != 173):
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


class BytePair:
    """Byte-level pair merging with the special tokens of a template around the content."""

    padding_side = "left"

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], max_length: int = 512, before: list[int] = (), after: list[int] = ()):
        self.vocab, self.max_length, self.before, self.after = vocab, max_length, list(before), list(after)
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.letters = byte_letters()

    @classmethod
    def from_json(cls, text: str, max_length: int = 512) -> "BytePair":
        root = json.loads(text)
        model = root.get("model") or {}
        if model.get("type", "BPE") != "BPE" or "vocab" not in model:
            raise ValueError("not a byte-pair model")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        return cls(model["vocab"], merges, max_length, *template(root.get("post_processor")))

    def merge(self, token: str) -> list[str]:
        parts = list(token)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), len(self.rank)), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        room, ids = max(0, self.max_length - len(self.before) - len(self.after)), []
        for m in BPE_SPLIT.finditer(text):
            letters = "".join(self.letters[b] for b in m[0].encode())
            ids += [self.vocab[p] for p in self.merge(letters) if p in self.vocab]
            if len(ids) >= room:
                break
        ids = self.before + ids[:room] + self.after
        return ids, [1] * len(ids)


def template(node) -> tuple[list[int], list[int]]:
    """Ids that a template, at any depth of processors, puts before and after the content."""
    if not isinstance(node, dict):
        return [], []
    if node.get("type") != "TemplateProcessing":
        found = (template(p) for p in node.get("processors") or [])
        return next((f for f in found if f != ([], [])), ([], []))
    sides: tuple[list[int], list[int]] = ([], [])
    after = False
    for item in node.get("single") or []:
        if "Sequence" in item:
            after = True
        elif "SpecialToken" in item:
            entry = (node.get("special_tokens") or {}).get(item["SpecialToken"].get("id")) or {}
            sides[after].extend(int(i) for i in entry.get("ids") or [])
    return sides


def encode(text, tokenizer: TextTokenizer, length: int | None = None) -> Column:
    """struct(input_ids, attention_mask) of a text column, in Arrow batches."""

    @F.pandas_udf(ENCODED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [tokenizer.encode(t or "") for t in part]
            if length is not None:
                rows = [pad(i, m, length, tokenizer.padding_side) for i, m in rows]
            yield pd.DataFrame({"input_ids": [r[0] for r in rows], "attention_mask": [r[1] for r in rows]})

    return run(text)
