"""Byte-level BPE over Arrow batches, by the vocabulary file's own library, with a bounded cache of chunks."""

from __future__ import annotations

import codecs
import functools
import json
import re
from array import array

import numpy as np

from . import common

#: Chunks kept by one Python worker, and the longest that is kept: some 75 MB, 150 MB at most.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 64
#: As many where ids are kept and no other cache is beside them: twice that memory.
ID_ENTRIES = 600_000
#: Marks that stand alone behind letters, and the first letter whose class may differ between Unicode versions.
MARKS, PLAIN = frozenset(".,!?;:"), "\u0530"
#: A space before white space or at the end: there a cut before each space is not safe.
UNSAFE = re.compile(r" (?:\s|\Z)")


class Chunks(dict):
    """What `work` gives for each chunk, remembered. When full, the newer half goes: frequent chunks came early."""

    def __init__(self, work, entries: int | None = None):
        super().__init__()
        self.work, self.entries = work, entries or CACHE_ENTRIES

    def __missing__(self, chunk):
        if len(chunk) > CACHE_LENGTH:
            return self.work(chunk)
        if len(self) >= self.entries:
            for old in list(self)[self.entries // 2 :]:
                del self[old]
        value = self[chunk] = self.work(chunk)
        return value


class ByteBpe:
    """Encodes texts as the tokenizers library does for a byte-level BPE file.

    The file's pre-tokenizer always starts a token at a space that has no white space after it, and nothing before
    the space depends on what follows. So a text falls into chunks at such spaces, and each chunk is encoded alone,
    once. Texts with other spaces or with a special string go through the library whole.
    """

    def __init__(self, path: str, entries: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        before = spec["pre_tokenizer"] or {}
        self.chunked = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.chunked else None
        self.merge = self.tokenizer.model.tokenize
        self.counts: Chunks | None = None
        self.entries = entries or ID_ENTRIES

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def chunks(self, text: str) -> list[str] | None:
        """What stands before the text's first space, then its other chunks without their space; None if it has to go whole."""
        if not self.chunked or UNSAFE.search(text) or any(s in text for s in self.special):
            return None
        return text.split(" ")

    def plain(self, line: str, space: str) -> list[str] | None:
        """The pre-tokens of letters, with one mark behind them or none, after a space (in byte-level letters) or none."""
        body, last = (line[:-1], line[-1:]) if line[-1:] in MARKS else (line, "")
        if (body := self.lettered(body)) is None:
            return None
        return [space + body, last] if last else [space + body]

    def lettered(self, word: str) -> str | None:
        """A word of plain letters in byte-level letters, else None."""
        if not word.isalpha():
            return None
        if word.isascii():
            return word
        return codecs.charmap_decode(word.encode(), "strict", self.letter_table)[0] if max(word) < PLAIN else None

    def words(self, chunk: str) -> list[str]:
        """A chunk's pre-tokens in byte-level letters. A space with letters, or those with one mark, need no search;
        nor do more such lines behind it: a line feed between characters that are not white space stands alone."""
        if chunk[:1] == " ":
            out: list[str] = []
            for k, line in enumerate(chunk[1:].split("\n")):
                if (found := self.plain(line, "" if k else "\u0120")) is None:
                    break
                out += ["\u010a", *found] if k else found
            else:
                return out
        return [word for word, _ in self.split(chunk)]

    @functools.cached_property
    def letters(self) -> dict[int, str]:
        """The letter that stands for each byte: itself if it prints, else the next from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    @functools.cached_property
    def letter_table(self) -> str:
        return "".join(self.letters[b] for b in range(256))

    def ids_of(self, chunk: str) -> bytes:
        whole, out = self.whole_ids, []
        for word in self.words(chunk):
            if (known := whole.get(word)) is not None:
                out.append(known)
            else:
                out += [t.id for t in self.merge(word)]
        return array("I", out).tobytes()

    @functools.cached_property
    def whole_ids(self) -> dict[str, int]:
        """The id of each whole token."""
        return {s: self.merge(s)[0].id for s in self.single()}

    @functools.cached_property
    def mark_ids(self) -> dict[str, bytes]:
        return {mark: self.ids_of(mark) for mark in MARKS}

    @functools.cached_property
    def _ids(self) -> Chunks:
        return Chunks(self.ids_after_space, self.entries)

    def ids_after_space(self, rest: str) -> bytes:
        """The ids of a space and `rest`. One mark behind letters stands alone, so the letters are merged once for all marks."""
        if rest[-1:] in MARKS and self.lettered(rest[:-1]) is not None:
            return self._ids[rest[:-1]] + self.mark_ids[rest[-1]]
        if (word := self.lettered(rest)) is None:
            return self.ids_of(" " + rest)
        known = self.whole_ids.get(word := "\u0120" + word)
        return array("I", [t.id for t in self.merge(word)] if known is None else [known]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        parts = self.chunks(text)
        if parts is None:
            return np.array(self.whole(text), "<u4").tobytes()
        return self.ids_of(parts[0]) + b"".join(map(self._ids.__getitem__, parts[1:]))

    def single(self) -> frozenset[str]:
        """Whole tokens, proved here: the vocabulary strings (in byte-level letters) that alone merge to one token."""
        return frozenset(s for s in self.tokenizer.get_vocab(with_added_tokens=False) if len(self.merge(s)) == 1)

    def count_of(self, single: frozenset[str], chunk: str) -> int:
        """Pre-tokens that are whole tokens count 1; only the rest are merged."""
        return sum(1 if word in single else len(self.merge(word)) for word in self.words(chunk))

    def counter(self, single: frozenset[str]):
        """A function from text to its number of tokens; its cache is kept between calls."""
        counts = self.counts = self.counts or Chunks(lambda rest: self.count_of(single, " " + rest))

        def count(text: str) -> int:
            parts = self.chunks(text)
            if parts is None:
                return len(self.whole(text))
            return self.count_of(single, parts[0]) + sum(map(counts.__getitem__, parts[1:]))

        return count


@common.remembered
def byte_bpe(path: str, entries: int | None = None) -> ByteBpe:
    """One per Python worker and file, with up to `entries` chunks whose ids are remembered; kept between tasks."""
    return ByteBpe(path, entries)
