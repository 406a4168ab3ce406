"""Whole-text tokenization with the tokenizers library, words encoded once.

A text is the sequence of its *words*: a run of blanks and what follows it up
to the next blank.  Both byte-level pre-tokenizers in use never join a
character with a blank that follows it, so the ids of a text are the ids of its
words in order, and a worker encodes each different word once.  Texts with
other white space than blank, tab, newline and return (which a pre-tokenizer
could join with a run of blanks) are encoded as a whole.

Both also cut between a letter and marks like ``.,;:!?*``, so a new word that ends
in marks after a Latin letter is its stem and its marks, and a word of Latin
letters alone goes to the merge model as it is.  Words are remembered in
two generations: a hit brings a word to the young one, and when that is full the
old one goes, so frequent words stay and words of one text don't.

``encode_column`` cuts an Arrow column into words, and words before marks, on its
bytes and looks up each different one of some megabytes of text once.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgernet.llm.common import ranges, steps, text_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_WORDS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+\Z")
_OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words that a worker remembers (about 230 bytes each), and their longest.
REMEMBERED, LONGEST = 1_000_000, 64
_MARKS, _LATIN = ".,;:!?*&$#%", "\u0250"
#: Text whose words ``encode_column`` looks up together.
WORD_BYTES = 8_000_000
#: Letters whose lower case could depend on the library; either that or other space.
_BEYOND = re.compile("[^\x00-\u012f]")
_UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0]|[^\x00-\u012f]")
#: Words that are one pre-token, and the signs that byte-level vocabularies have
#: for bytes (bytes that print stand for themselves, the others follow from 256 on).
_PLAIN = re.compile("( ?)[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+")
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}
#: The same other white space for Arrow's regular expressions.
_OTHER_SPACE_RE2 = (r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_BLANK, _LETTER, _MARK = (np.isin(np.arange(256), list(some.encode())) for some in (
    " \n\t\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _MARKS))
_LOADED: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    def __init__(self, path: str, remembered: int):
        self.remembered = remembered
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        model = self.tokenizer.model
        self.merge, suffix = model.tokenize, model.end_of_word_suffix or ""
        #: Bytes that a token stands for (in byte-level vocabularies a character is a byte).
        self.length = np.zeros(self.size, np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.length[k] = len(token.removesuffix(suffix))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: White space goes and case with it: words need neither.
        self.folds = self._ids(" \n") == b"" and self._ids("Ab") == self._ids("ab")

        #: Whether plain words may go to the model directly.
        self.direct = all(self._plain(w) == self._ids(w) for w in ("ab", "Ab", "é", "Straße", "Ĝ", "xqzjkw")) and (
            self.folds or self._plain(" Ab") == self._ids(" Ab"))

    def _plain(self, word: str) -> bytes:
        word = word.lower() if self.folds else word
        if word.isascii():
            signs = "\u0120" + word[1:] if word[0] == " " else word
        else:
            signs = word.encode().decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in self.merge(signs)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words and the place after each word's last one."""
        found = self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends, bounds = np.cumsum(self.length[ids]), np.cumsum([len(w.encode()) for w in words])
        if len(ends) and ends[-1] == bounds[-1]:
            last = np.searchsorted(ends, bounds)
            if (ends[last] == bounds).all():
                return ids, last + 1
        # normalising changed some lengths: ask for the words of the ids
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, "<u4"), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(1, len(words) + 1))

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        if self.direct:
            plain = [w for w in words if _PLAIN.fullmatch(w) and not (self.folds and w[0] == " ")]
            out = {w: self._plain(w) for w in plain}
            words = [w for w in words if w not in out]
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            ids, ends = self._cut(some)
            flat, ends = ids.tobytes(), (4 * ends).tolist()
            for word, a, z in zip(some, [0, *ends], ends):
                out[word] = flat[a:z]
        return out

    def _parts(self, word: str) -> tuple[str, ...]:
        """Words that a new word's ids are made of."""
        if not self.folds and word[0] == "\n" and _PLAIN.match(word, 1) and word[1] != " ":
            return "\n", *self._parts(word[1:])  # a line end before a letter is a pre-token
        stem = word.rstrip(_MARKS)
        if stem and stem != word and stem[-1].isalpha() and stem[-1] < _LATIN:
            parts: tuple[str, ...] = (stem, word[len(stem):])
        else:
            parts = (word,)
        return tuple(p.lower() if p.isascii() else p for p in parts) if self.folds else parts

    def _recall(self, words: set[str] | list[str]) -> None:
        """Brings words that the young generation lacks to it; parts of new
        words are encoded and remembered too."""
        young, old = self.young, self.old
        made, new = {}, set()
        for word in words:
            if word in old:
                young[word] = old[word]
                continue
            if word[-1:].isalpha() and word[0] != "\n":  # no marks at its end
                new.add(word)
                continue
            made[word] = parts = self._parts(word)
            for p in parts:
                if p in old:
                    young[p] = old[p]
                elif p not in young:
                    new.add(p)
        young.update(self._learn(list(new)))
        for word, parts in made.items():
            young[word] = b"".join([young[p] for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split: Callable[[str], list[str]] = str.split if self.folds else _WORDS.findall
        words = []
        for t in texts:
            unusual = _UNUSUAL.search(t)
            if unusual and _OTHER_SPACE.search(t):
                words.append(None)
            else:
                words.append(split(t.lower() if self.folds and not (unusual and _BEYOND.search(t)) else t))
        if len(self.young) > self.remembered // 2:
            self.old, self.young = self.young, {}
        young = self.young
        missing = {w for some in words if some for w in some if w not in young}
        self._recall(missing)
        get = young.__getitem__
        out = [self._ids(t) if some is None else b"".join(map(get, some)) for t, some in zip(texts, words)]
        for word in missing:
            if len(word) > LONGEST:
                del young[word]
        return out

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For row ranges ``i, j`` of a text column their ids one after the
        other, and how many each row has; null is empty."""
        if self.folds:
            raise ValueError("words of this vocabulary are not cut on bytes")
        other = pc.match_substring_regex(column, _OTHER_SPACE_RE2).fill_null(False).to_numpy(zero_copy_only=False)
        buf, offsets = text_buffer(column)
        for i, j in steps(offsets, WORD_BYTES):
            lo = int(offsets[i])
            rows, data = offsets[i:j + 1] - lo, buf[lo:int(offsets[j])]
            blank = _BLANK[data]
            starts = np.zeros(len(data), bool)
            starts[1:] = (blank[1:] & ~blank[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
            for k in np.flatnonzero(other[i:j]):
                starts[rows[k]:rows[k + 1]] = False  # encoded as a whole
            starts[rows[:-1][np.diff(rows) > 0]] = True
            at = np.flatnonzero(starts)
            bounds = np.append(at, len(data))
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
            found, flat, lengths = words.dictionary.to_pylist(), b"", np.zeros(0, np.int64)
            which = words.indices.to_numpy()
            if found:
                whole = np.flatnonzero(other[i:j])
                encoded = self._look_up(found, {found[k] for k in which[np.searchsorted(at, rows[whole])]})
                flat, lengths = b"".join(encoded), np.array(list(map(len, encoded))) >> 2
            counts = lengths[which]
            ids = np.frombuffer(flat, "<u4")[ranges((np.cumsum(lengths) - lengths)[which], counts)]
            before = np.concatenate([[0], np.cumsum(counts)])
            yield i, j, ids, np.diff(before[np.searchsorted(at, rows)])

    def _look_up(self, words: list[str], whole: set[str]) -> list[bytes]:
        """Ids of different words; those of ``whole`` are texts."""
        if len(self.young) > self.remembered // 2:
            self.old, self.young = self.young, {}
        young = self.young
        missing = [w for w in words if w not in young and w not in whole]
        self._recall(missing)
        out = [self._ids(w) if w in whole else young[w] for w in words] if whole else list(map(young.__getitem__, words))
        for word in missing:
            if len(word) > LONGEST:
                del young[word]
        return out


def tokenizer(path: str, remembered: int = REMEMBERED) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path, remembered)
    return _LOADED[path]
