"""Token ids of whole texts with a public tokenizer, by their different words.

The tokenizer splits texts at white space before it merges, so a text's ids are those of its white-space separated parts, one
after the other. Arrow splits some texts and numbers their words, each different word is encoded once, without the signs after
its letters, and the ids are gathered by number, so no Python runs for a word; frequent words are kept for the next texts. A text
with unusual white space or control characters, where two definitions of white space may differ, goes through the tokenizer whole,
and so does one with the string of an added token, which the tokenizer finds before it splits and turns into that token's id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that str.split() takes as white space and that are not plain space, tab, newline or carriage return; and letters
#: for which str.lower() knows a lower case and the tokenizer, with an older Unicode, does not.
UNUSUAL = re.compile(
    "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff"
    "\u1c89\ua7cb\ua7cc\ua7ce\ua7d2\ua7d4\ua7da\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]"
)
#: Its lower case depends on the place in the word for str.lower() only.
SIGMA = "\u03a3"
#: Signs that end a word, up to so many; after letters a run of them is a part of its own.
SIGNS, MOST_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 8
#: Words of letters that are encoded as one text.
TOGETHER = 512
#: Bytes of texts whose words are numbered together.
TEXTS = 12 << 20
#: Words that came so often in some texts are kept for the next ones, up to so many and so many bytes long; it only saves time.
OFTEN, MOST_KEPT, LONGEST_KEPT = 2, 1 << 18, 32


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # In lower case, as a text's words are; what holds none of these has no added token.
        self.added = [" ".join(x.content.lower().split()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        steps = str(self.tokenizer.normalizer)
        # Then texts are lower-cased here, and their words need no other normalisation.
        self.lowered = steps.count("(") <= 5 and all(x in steps for x in ("NFC", "Replace", "Lowercase"))
        model = self.tokenizer.model  # held once for all
        self.words = Tokenizer(model)  # without added tokens: lower-cased words may look like one
        self.words.pre_tokenizer = self.tokenizer.pre_tokenizer
        if not self.lowered:
            self.words.normalizer = self.tokenizer.normalizer
        # Words of letters are one part each for this splitting rule, and go to the merges as they are.
        rule = str(self.tokenizer.pre_tokenizer)
        self.by_letters = self.lowered and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in rule
        self.letters = Tokenizer(model)
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(model)  # these letters stand for their own bytes
        self.ascii.pre_tokenizer = WhitespaceSplit()
        # The ids that end a word, where the merges mark them: then many words are encoded as one text.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        # Words that are kept; their ids are the first ones.
        self.kept = pa.array([], pa.large_string())
        self.kept_start = self.kept_size = np.empty(0, np.int64)
        self.ids, self.used = np.empty(0, np.uint32), 0

    def _keep(self, words: pa.LargeStringArray, at: np.ndarray) -> None:
        """Keeps the words numbered ``at`` as well, and forgets all others."""
        at = at[: MOST_KEPT - len(self.kept)]
        flat, size, before = self._gather(at), self.size[at], int(self.kept_size.sum())
        self.kept = pa.concat_arrays([self.kept, words.take(pa.array(at))])
        self.kept_start = np.append(self.kept_start, before + np.cumsum(size) - size)
        self.kept_size = np.append(self.kept_size, size)
        self.ids = np.append(self.ids[:before], flat)
        self.used = len(self.ids)

    def _learn(self, words: pa.LargeStringArray, times: np.ndarray) -> tuple[int, pa.LargeStringArray, np.ndarray]:
        """Numbers different words, sets start and size of their ids; the first word's number, and what to keep: ``_keep``'s.

        A word of letters with signs after it is put together from the two; its letters are looked up and kept without them.
        """
        n = len(words)
        bare = pc.utf8_rtrim(words, SIGNS)
        signs = (pc.binary_length(words).to_numpy() - pc.binary_length(bare).to_numpy()) if self.by_letters else np.full(n, MOST_SIGNS + 1)
        letters = np.asarray(pc.utf8_is_alpha(bare)) & (signs <= MOST_SIGNS)
        stem = pc.if_else(pa.array(letters), bare, words).dictionary_encode()
        del bare
        stems, stem = stem.dictionary, stem.indices.to_numpy()
        ended = [np.flatnonzero(letters & (signs == k)) for k in range(1, MOST_SIGNS + 1)]
        end = [pc.utf8_slice_codeunits(words.take(pa.array(at)), -k) for k, at in enumerate(ended, 1)]
        end, ended = pa.concat_arrays(end).dictionary_encode(), np.concatenate(ended)
        first_end = len(stems)
        first = first_end + len(end.dictionary)
        self.start, self.size = np.zeros((2, first + n), np.int64)
        self._store(first_end + np.arange(len(end.dictionary)), self.words, end.dictionary.to_pylist())

        place = pc.index_in(stems, self.kept)
        new = np.asarray(place.is_null())
        at, old = np.flatnonzero(~new), place.drop_null().to_numpy()
        self.start[at], self.size[at] = self.kept_start[old], self.kept_size[old]
        by_letters, plain = np.zeros(len(stems), bool), np.asarray(pc.string_is_ascii(stems))
        by_letters[stem[letters]] = True
        self._store_letters(np.flatnonzero(new & by_letters & plain), self.ascii, stems)
        self._store_letters(np.flatnonzero(new & by_letters & ~plain), self.letters, stems)
        others = np.flatnonzero(new & ~by_letters)
        self._store(others, self.words, stems.take(pa.array(others)).to_pylist())

        self.start[first:], self.size[first:] = self.start[stem], self.size[stem]
        left, right = stem[ended], first_end + end.indices.to_numpy()
        both = np.stack([left, right], axis=1).reshape(-1)
        self._append(first + ended, self.size[left] + self.size[right], self._gather(both))
        short = pc.binary_length(stems).to_numpy() <= LONGEST_KEPT
        return first, stems, np.flatnonzero(new & short & (np.bincount(stem, times, len(stems)) >= OFTEN))

    def _store_letters(self, at: np.ndarray, tokenizer, words: pa.LargeStringArray) -> None:
        """Words of letters, many in one text: the ids that end a word part them again."""
        if not len(at):
            return
        words = words.take(pa.array(at))
        parts = pa.ListArray.from_arrays(np.append(np.arange(0, len(words), TOGETHER), len(words)).astype(np.int32), words)
        texts = pc.binary_join(parts, pa.scalar(" ", words.type)).to_pylist()
        found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(found)
        last = np.flatnonzero(self.ends[flat])
        if len(last) == len(words) and last[-1] == len(flat) - 1:
            self._append(at, np.diff(last, prepend=-1), flat)
        else:  # no such ids in this vocabulary
            self._store(at, tokenizer, words.to_pylist())

    def _store(self, at: np.ndarray, tokenizer, words: list[str]) -> None:
        if words:
            found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._append(at, sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def _append(self, at: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.used += len(flat)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        sizes = self.size.take(at)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        place = np.arange(total, dtype=kind)
        place += np.repeat((self.start.take(at) - (ends - sizes)).astype(kind), sizes)
        return self.ids.take(place)

    def encode(self, column: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has. Null is the empty text."""
        column = column if isinstance(column, pa.Array) else pa.array(column, pa.large_string())
        unusual, texts = pc.match_substring_regex(column, UNUSUAL.pattern).to_pylist(), column.to_pylist()
        parts: list[str] = []
        whole: list[int] = []
        for k, text in enumerate(texts):
            part = ""
            if text:
                if unusual[k] or self.lowered and (SIGMA in text or not is_normalized("NFC", text)):
                    whole.append(k)
                else:
                    lowered = text.lower()
                    if any(x in lowered or " " in x and x in " ".join(lowered.split()) for x in self.added):
                        whole.append(k)
                    else:
                        part = lowered if self.lowered else text
            parts.append(part)
        # White space at the ends gives empty words, which have no ids.
        split = pc.ascii_split_whitespace(pa.array(parts, pa.large_string()))
        number, ends = split.values.dictionary_encode(), split.offsets.to_numpy()[1:]
        del parts, split  # each is as large as the texts
        at = number.indices.to_numpy()
        first, *keep = self._learn(number.dictionary, np.bincount(at, minlength=len(number.dictionary)))
        at = at + np.int32(first)
        del number
        if whole:  # each takes the place of its one empty word
            own = len(self.start) + np.arange(len(whole))
            self.start, self.size = (np.append(a, np.zeros(len(whole), np.int64)) for a in (self.start, self.size))
            self._store(own, self.tokenizer, [texts[k] for k in whole])
            at = at.astype(np.int64)
            at[ends[whole] - 1] = own
        upto = np.append(0, np.cumsum(self.size.take(at)))[ends]
        ids = self._gather(at)
        self._keep(*keep)
        return ids, np.diff(upto, prepend=0)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    b = np.empty(max(n, 2 * len(a)), a.dtype)
    b[: len(a)] = a
    return b


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def some_texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch by the size of their ``text``: as few as go together well and fit into a worker."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // TEXTS
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    for a, n in zip(begin.tolist(), np.diff(begin, append=len(size)).tolist()):
        yield batch.slice(a, n)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    out = np.full(len(ids) + len(sizes), end, ids.dtype)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(sizes + 1) - 1] = False
    out[kept] = ids
    return out, sizes + 1
