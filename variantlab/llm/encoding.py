"""Token ids of whole texts by the tokenizers library, each distinct word of a task encoded once.

A tokenizer whose pre-tokenizer drops white space and marks word ends gives a text the ids of its
white-space separated words in order, since no piece spans white space; so the words of a task are
kept with their ids. Words of letters, digits and ASCII punctuation, whose normal form is their
lower case, go to the model in bulk; any other word goes through the whole tokenizer. A text of such
words only is cut into its runs of letters, digits and punctuation at once, of which there are far fewer.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, repeat

import numpy as np

_MAX_WORDS = 300_000
#: Letters that NFC leaves as they are and that have a one-letter lower case, single digits, runs of punctuation without '.
_UNIT = "[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+|[0-9]|[!-&(-/:-@\\[-`{-~]+"
_SIMPLE = "[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž0-9!-&(-/:-@\\[-`{-~ \t\n\r\x0b\x0c]*+"
_KEPT: dict[str, WordEncoder] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bulk = Tokenizer.from_file(path)
        end = getattr(self.bulk.model, "end_of_word_suffix", None)
        if not end:
            raise ValueError("the tokenizer must mark word ends")
        self.bulk.normalizer = normalizers.Sequence([])
        self.bulk.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith(end)]] = True
        self.plain = re.compile(f"(?:{_UNIT})+")
        self.split = re.compile(_UNIT)
        self.simple = re.compile(_SIMPLE)
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes | str, int] = {}
        self.units: dict[str, bytes] = {}
        self.ids, self.begin, self.size = array("I"), array("q"), array("q")

    def _bulk(self, units: list[str]):
        """(units, ids, ends of each unit's ids) for parts of the units."""
        for at in range(0, len(units), 2000):
            part = units[at : at + 2000]
            line = " ".join(part)
            if not line.isascii():
                line = " ".join([u if u.isascii() else u.encode().decode("latin-1").translate(self.letters) for u in part])
            ids = np.array(self.bulk.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a word without a word end")
            yield part, ids, ends

    def _learn_units(self, units: list[str]) -> None:
        for part, ids, ends in self._bulk(units):
            self.units.update(zip(part, (x.tobytes() for x in np.split(ids, ends[:-1])), strict=True))

    def _learn_runs(self, runs: list[str]) -> None:
        for part, ids, ends in self._bulk(runs):
            first = len(self.begin)
            begin = np.concatenate(([0], ends[:-1]))
            self.begin.frombytes((begin + len(self.ids)).astype(np.int64).tobytes())
            self.size.frombytes((ends - begin).astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
            self.index.update(zip(part, range(first, first + len(part)), strict=True))

    def _learn(self, words: set[bytes | str]) -> None:
        if len(self.units) > _MAX_WORDS:
            self.units = {}
        self._learn_runs([w for w in words if isinstance(w, str)])
        plain: dict[bytes, list[str]] = {}
        other: list[bytes] = []
        for w in words:
            if isinstance(w, str):
                continue
            text = w.decode(errors="replace")
            if self.plain.fullmatch(text) and "<|" not in text:
                plain[w] = self.split.findall(text.lower())
            else:
                other.append(w)
        self._learn_units([u for u in dict.fromkeys(chain.from_iterable(plain.values())) if u not in self.units])
        known = [(w, b"".join([self.units[u] for u in us])) for w, us in plain.items()]
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            got = self.whole.encode_batch([w.decode(errors="replace") for w in part], add_special_tokens=False)
            known += [(w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(part, got, strict=True)]
        for w, ids in known:
            self.index[w] = len(self.begin)
            self.begin.append(len(self.ids))
            self.size.append(len(ids) // 4)
            self.ids.frombytes(ids)

    def _cut(self, text: str) -> list:
        """The runs of a simple text, as str, or the words of any other, as bytes."""
        if "<|" not in text and self.simple.fullmatch(text):
            return self.split.findall(text.lower())
        return text.encode().split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (None: none), as the library gives them without added special tokens."""
        words = [self._cut(t or "") for t in texts]
        flat = list(chain.from_iterable(words))
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        if (new := np.flatnonzero(at < 0)).size:
            if len(self.index) > _MAX_WORDS:
                self.clear()
                new = np.arange(len(flat))
            fresh = [flat[i] for i in new.tolist()]
            self._learn(set(fresh))
            at[new] = [self.index[w] for w in fresh]
        size = np.array(np.frombuffer(self.size, np.int64)[at]) if len(at) else np.zeros(0, np.int64)
        begin = np.frombuffer(self.begin, np.int64)[at] if len(at) else size
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(begin - ends + size, size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        stops = np.concatenate(([0], ends))[np.cumsum([len(w) for w in words])] if words else []
        return np.split(ids, stops[:-1]) if len(words) else []


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept between tasks."""
    if path not in _KEPT:
        _KEPT[path] = WordEncoder(path)
    return _KEPT[path]


def encoded(batches, path: str, text: str = "text", rows: int = 256):
    """Slices of the batches with the ids of their texts."""
    tool = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, tool.encode(part.column(text).to_pylist())
