"""Token ids of whole texts by a public tokenizer, with a bounded store of the words met before.

The tokenizer drops white space and never merges over it, so a text's ids are its blank-separated chunks' ids in turn.
Chunks come from one split of many texts; each is looked up once, and only new ones are encoded. A text that holds the
start of a special token, and any vocabulary that keeps white space, is encoded as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from skein.llm.common import of_worker

#: A task has one core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Marks that, after a word, are one piece of their own. Not the apostrophe, which may begin a contraction.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: A word of Latin letters without combining marks, whose lower case is one letter each.
LETTERS = "^[" + "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and chr(c).lower().isalpha()) + "]+$"

#: Bytes of text that are split and looked up together, and of new words that the model gets at a time.
TEXT, NEW = 4 << 20, 1 << 18


def listed(strings: pa.StringArray) -> list[bytes]:
    return strings.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def runs(strings: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive strings of about ``most`` bytes together, each counted as 16 more; a longer one is in a run with few others."""
    sizes = pc.binary_length(strings).to_numpy().astype(np.int64) + 16
    first = np.flatnonzero(np.diff((sizes.cumsum() - sizes) // most, prepend=-1)).tolist()
    return zip(first, [*first[1:], len(strings)], strict=False)


def gathered(ids: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ids that follow one another, with these sizes: the picked ones, and where each of them ends."""
    n = sizes[picked]
    ends = n.cumsum()
    at = np.repeat((sizes.cumsum() - sizes)[picked] - (ends - n), n)
    at += np.arange(len(at))
    return ids[at], ends


class WordIds:
    """``ids(text)``: little-endian ids of a text's bytes; equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, name: str, most: int = 1_000_000) -> None:
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        self.encode, self.batch = whole.encode, whole.encode_batch_fast
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65_536 and all(t["id"] < 65_536 for t in spec["added_tokens"]) else "<u4")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_chunk = any(p.get("behavior") == "Removed" and p.get("invert") for p in steps)
        self.lower = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        suffix = model.get("end_of_word_suffix") or ""
        self.by_word = self.by_chunk and self.lower and bool(suffix) and any(p["type"] == "ByteLevel" for p in steps)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if self.by_word:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # the same model behind a plain split at blanks, for words that are normal already
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []})).encode_batch_fast
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_level = {b: 256 + k for k, b in enumerate(hidden)}
        self.specials = tuple({t["content"][:2].encode() for t in spec["added_tokens"]})
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: bytes) -> bytes:
        return self.many(pa.array([text.decode()]))[0].tobytes()

    def many(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another and each text's with ``end`` after them, and their number by text.

        A word is looked up once, however many of the texts hold it; new words go to the model together.
        """
        apart = np.full(len(texts), not self.by_chunk)
        for s in self.specials:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        split = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts) if self.lower else texts
        chunks = pc.ascii_split_whitespace(pc.if_else(pa.array(apart), "", split))
        words, after = chunks.flatten().dictionary_encode(), chunks.offsets.to_numpy()[1:]
        ids, sizes = self._chunks(words.dictionary)
        whole = {i: self.whole(texts[i].as_py()) + end for i in np.flatnonzero(apart).tolist()}
        last = np.full(len(texts), len(sizes))
        last[list(whole)] = len(sizes) + 1 + np.arange(len(whole))
        more, more_sizes = self._joined([end, *whole.values()])
        ids, ends = gathered(np.append(ids, more), np.append(sizes, more_sizes), np.insert(words.indices.to_numpy(), after, last))
        return ids, np.diff(ends[after + np.arange(len(texts))], prepend=0)

    def _joined(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each one's."""
        return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, one after another, and their numbers. A word and marks after it are looked up apart."""
        if not self.by_word:
            return self._joined(self._found(chunks))
        heads = pc.ascii_rtrim(chunks, MARKS.decode())
        heads = pc.if_else(pc.match_substring_regex(heads, LETTERS), heads, chunks).dictionary_encode()
        cut = pc.binary_length(heads.dictionary).to_numpy()[heads.indices.to_numpy()]
        parted = np.flatnonzero(cut < pc.binary_length(chunks).to_numpy())
        marks = [c[n:] for c, n in zip(listed(chunks.take(pa.array(parted))), cut[parted].tolist(), strict=True)]
        marks = pa.array(marks, pa.binary()).cast(pa.string()).dictionary_encode()
        ids, sizes = self._joined([*self._found(heads.dictionary), *self._found(marks.dictionary)])
        picked = np.insert(heads.indices.to_numpy(), parted + 1, len(heads.dictionary) + marks.indices.to_numpy())
        ids, ends = gathered(ids, sizes, picked)
        rows = np.ones(len(chunks), np.int64)
        rows[parted] = 2
        return ids, np.diff(ends[rows.cumsum() - 1], prepend=0)

    def _found(self, words: pa.StringArray) -> list[bytes]:
        """The ids of different words."""
        keys = listed(words)
        found = list(map(self.known.get, keys))
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            words = words.take(pa.array(new))
            for lo, hi in runs(words, NEW):
                got = self._encoded(words.slice(lo, hi - lo))
                if len(self.known) + len(got) <= self.most:
                    self.known.update(got)
                for i in new[lo:hi]:
                    found[i] = got[keys[i]]
        return found

    def _encoded(self, words: pa.StringArray) -> dict[bytes, bytes]:
        """Of new words: those of Latin letters go to the model as one text, and are told apart by their last tokens."""
        got: dict[bytes, bytes] = {}
        if self.by_word:
            plain = pc.match_substring_regex(words, LETTERS)
            lower, words = words.filter(plain), words.filter(pc.invert(plain))
            keys = listed(lower)
            ids = np.array(self.words([self._shown(" ".join(pc.utf8_lower(lower).to_pylist()))], add_special_tokens=False)[0].ids, self.dtype)
            at = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            if len(at) == len(keys):
                got = {c: raw[a:b] for c, a, b in zip(keys, [0, *at], at, strict=False)}
            else:  # a word's last token does not end it, or another one does: each by itself
                got = {c: self.whole(c.decode()) for c in keys}
        odd = words.to_pylist()
        got.update((c.encode(), np.array(e.ids, self.dtype).tobytes()) for c, e in zip(odd, self.batch(odd, add_special_tokens=False), strict=True))
        return got

    def _shown(self, words: str) -> str:
        """Words of Latin letters as the model sees them: a character for each byte."""
        if words.isascii():
            return words
        words = words.encode().decode("latin-1")
        for b, c in self.byte_level.items():
            if b > 127:
                words = words.replace(chr(b), chr(c))
        return words


def word_ids(name: str) -> WordIds:
    """One store a Python worker, used by all its tasks until the worker comes to another operator."""
    return of_worker(("words", name), lambda: WordIds(name))
