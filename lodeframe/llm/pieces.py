"""Token ids of whole texts by a byte-level tokenizer of the tokenizers library, most of them looked up by word."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 1_500_000
#: Words joined to one string for the library.
JOINED = 256
#: Characters of a text that must reach the library whole, handed over at once where it can be cut.
PART_CHARS = 1 << 16

_TAIL = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~'"""
_SAFE = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


class TokenIds:
    """A function from texts to their ids.

    A byte-level file's pattern always cuts before a single space, and around a single line end, that
    stands between two characters that are no white space, and between a letter and ASCII punctuation. So a
    text is the words between such places (each with its space or line end before it), which Arrow splits and numbers; a word is cut again before the
    punctuation that ends it; only new words reach the library: ASCII letters, which its pattern leaves whole, its model,
    others joined by line ends. Texts with other
    white space at a word's edge or with a special token's opening go to the library whole; so does every text if the
    file is of another kind.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocabulary = self.tok.get_vocab_size(with_added_tokens=True)
        kind = json.loads(self.tok.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.by_words = kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_words = self.by_words and all("<|" in t["content"] and not t["lstrip"] for t in kind["added_tokens"])
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.by_words = self.by_words and len(line) == 1
        self.line, self.cache_words = line[-1] if line else 0, cache_words
        self._forget()

    def _forget(self) -> None:
        self.words, self.known = defaultdict(itertools.count().__next__), 1  # the first `known` numbers have ids
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size, self.odd = (np.zeros(1 << 14, t) for t in (np.int64, np.int32, bool))
        self.lone = self.words["\n"]  # a line end with nothing after it
        self.flat[0], self.used, self.size[self.lone], self.odd[self.lone] = self.line, 1, 1, True

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> np.ndarray:
        """A text's ids by the library, in parts if it is long and holds places where it is always cut."""
        parts, start = [], 0
        while len(text) - start > PART_CHARS and self.by_words and (cut := _SAFE.search(text, start + PART_CHARS)):
            parts.append(text[start : cut.start()])
            start = cut.start()
        got = [self._library([p])[0] for p in [*parts, text[start:]]]
        return np.concatenate(got) if len(got) > 1 else got[0]

    def _room(self, ids: int) -> None:
        numbers = len(self.words)
        if numbers > len(self.at):
            self.at, self.size, self.odd = (np.resize(x, max(2 * len(x), numbers)) for x in (self.at, self.size, self.odd))
        if self.used + ids > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + ids))

    def _keep(self, number: np.ndarray, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Stores the ids of words, which begin at `at`."""
        self._room(len(ids))
        self.at[number], self.size[number] = self.used + at, size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        """Ids of the words seen for the first time since the last call."""
        words, tokenize = self.words, self.tok.model.tokenize
        cut, cores, tails = [], [], []
        plain = lambda w: w[1:] if w[0] in "\n " else " " + w
        while self.known < len(words):  # a word's core and its end may be new words too
            base, self.known = self.known, len(words)
            fresh = list(itertools.islice(reversed(words), self.known - base))[::-1]
            letters, odd, items = [], [], []
            for n, word in enumerate(fresh, base):
                if word.isalpha() and word.isascii():
                    letters.append(n)
                    continue
                body = word[1:] if word[:1] in ("\n", " ") else word
                if not body or body[0].isspace() or body[-1].isspace() or "<|" in word:
                    odd.append(n)
                    continue
                core = word.rstrip(_TAIL)
                if core != word and "A" <= core[-1:].upper() <= "Z":
                    cut.append(n)
                    cores.append(words[core])
                    tails.append(words[" " + word[len(core) :]])  # no space before it; no word of a text begins so
                else:
                    items.append(n)
            self._room(0)
            self.odd[base : self.known] = False
            self.odd[odd] = True
            for i in range(0, len(letters), JOINED * 64):
                number = letters[i : i + JOINED * 64]
                got = [[t.id for t in tokenize("\u0120" + fresh[n - base])] for n in number]  # a byte-level file's sign for a space
                size = np.fromiter(map(len, got), np.int64, len(got))
                ids = np.fromiter(itertools.chain.from_iterable(got), np.int32, int(size.sum()))
                self._keep(np.array(number), ids, np.cumsum(size) - size, size)
            for i in range(0, len(items), JOINED * 64):
                numbers = [items[k : k + JOINED] for k in range(i, min(i + JOINED * 64, len(items)), JOINED)]
                groups = [[fresh[n - base] for n in some] for some in numbers]
                for number, group, ids in zip(numbers, groups, self._library(["\n" + "\n".join(map(plain, g)) for g in groups]), strict=True):
                    ends = np.flatnonzero(ids == self.line)
                    if len(ends) != len(group):  # a word's own ids look like a line end: each by itself
                        ids = [np.append(self.line, x) for x in self._library(list(map(plain, group)))]
                        ends = np.cumsum([0, *map(len, ids[:-1])])
                        ids = np.concatenate(ids)
                    lead = np.fromiter((w[0] == "\n" for w in group), np.int64, len(group))  # its line end is the one before it
                    self._keep(np.array(number), ids, ends + 1 - lead, np.diff(ends, append=len(ids)) - 1 + lead)
        if cut:
            both = np.array([cores, tails]).T.ravel()
            size, at = self.size[both].astype(np.int64), self.at[both]
            ends = np.cumsum(size)
            self._room(int(ends[-1]))
            self.flat[self.used : self.used + ends[-1]] = self.flat[np.repeat(at - ends + size, size) + np.arange(ends[-1])]
            self.at[cut] = self.used + np.append(0, ends[1:-1:2])
            self.size[cut] = size[0::2] + size[1::2]
            self.used += int(ends[-1])

    def __call__(self, column: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text of a string column, and end_id after them; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        after = [] if end_id is None else [end_id]
        alone = lambda k: np.append(self.whole(column[k].as_py()), np.array(after, np.int32))
        if not self.by_words:
            return [alone(k) for k in range(len(column))]
        if len(self.words) > self.cache_words:
            self._forget()
        # a line end of ours goes before each text, so that a word after it has no space; its id makes room for end_id
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), column, pa.scalar("", pa.large_string())), "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = lists.flatten().dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        self._learn()
        number = number[found.indices.to_numpy()]
        odd, last = self.odd[number], bounds[1:] - 1
        odd[bounds[:-1]] = False  # what is before our line end
        odd[last] &= number[last] != self.lone  # a text may end with a line end
        size = self.size[number].astype(np.int64)
        size[bounds[:-1]] = 0
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bad = np.add.reduceat(odd, bounds[:-1]) if len(odd) else np.zeros(0)
        to = ends[last]
        since = np.append(0, to[:-1])
        if end_id is None:
            return [alone(k) if bad[k] else ids[a + 1 : b] for k, (a, b) in enumerate(zip(since.tolist(), to.tolist(), strict=True))]
        ids[:-1] = ids[1:].copy()
        ids[to - 1] = end_id
        return [alone(k) if bad[k] else ids[a:b] for k, (a, b) in enumerate(zip(since.tolist(), to.tolist(), strict=True))]


@functools.cache
def encoder(path: str) -> TokenIds:
    """One a Python worker, whose words later tasks find again."""
    return TokenIds(path)
