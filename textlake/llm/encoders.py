"""Token ids and counts as the public tokenizers give them, with a memory for words.

Texts repeat their words, and both tokenizers treat what stands between two spaces apart
from its neighbours. So a text of words between single spaces and line ends is cut at
its spaces and only words not met before are encoded. Any other text is encoded whole."""

from __future__ import annotations

import json
import re
from itertools import chain, repeat

import numpy as np

# words remembered by one worker; with so many, further ones are encoded anew each time
MEMORY = 700_000
PLAIN = re.compile(r"[^\s▁\u0000- ]+(?:[ \n][^\s▁\u0000- ]+)*")
# how byte-level files split a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# before a word that opens its text; plain texts do not hold it
OPENING = "\0"


class Memory:
    """Numbers of words. What a worker meets first, it remembers; as frequent words come
    early, a full memory still serves most of a text."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.limit = MEMORY

    def places(self, words: list[str], learn) -> tuple[np.ndarray, bool]:
        """The number of each word, and whether those met first are remembered. `learn`
        takes words without one and gives their numbers."""
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        lasting = True
        if len(missing):
            fresh = [words[i] for i in missing.tolist()]
            numbers = learn(list(dict.fromkeys(fresh)))
            found[missing] = np.fromiter(map(numbers.__getitem__, fresh), np.int64, len(fresh))
            lasting = len(self.index) + len(numbers) <= self.limit
            if lasting:
                self.index.update(numbers)
        return found, lasting


class Store:
    """Rows of ids of different lengths in one growing array."""

    def __init__(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[self.rows + 1:self.rows + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.rows += len(sizes)
        self.used += len(ids)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows, one after the other, and how many of each."""
        start = self.starts[at]
        size = self.starts[at + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], size


class ByteLevel:
    """Ids of a byte-level BPE file for `tokenizers`. Texts that hold an added token go
    through that library. Others get the same ids from its merges by way of `tiktoken`,
    which is several times faster."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)")
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the printable stand-ins of bytes: visible Latin-1 signs for themselves, the rest from 256 on
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in vocabulary.items() if piece not in added}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.line_end = ranks[b"\n"]
        self.memory = Memory()
        self.store = Store()

    def learn(self, words: list[str]) -> dict[str, int]:
        """Words that open a text or hold a line end are encoded one by one, all others
        as one text with a line end after each, where its id marks the end."""
        single = [w for w in words if w[0] == OPENING or "\n" in w]
        rest = [w for w in words if w[0] != OPENING and "\n" not in w]
        rows = [self.encode(w[1:] if w[0] == OPENING else " " + w) for w in single]
        self.store.add(np.fromiter(chain.from_iterable(rows), np.uint32),
                       np.fromiter(map(len, rows), np.int64, len(rows)))
        for a in range(0, len(rest), 10_000):
            part = rest[a:a + 10_000]
            ids = np.array(self.encode(" " + "\n ".join(part) + "\n"), np.uint32)
            ends = np.flatnonzero(ids == self.line_end)
            self.store.add(np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)
        return dict(zip(single + rest, range(self.store.rows - len(words), self.store.rows), strict=True))

    def whole(self, texts: list[str]) -> list[list[int]]:
        """As the library itself gives them."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many of each."""
        parts: list[list[str]] = []
        odd: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            if self.special.search(text):
                odd[i] = self.whole([text])[0]
                parts.append([])
            elif PLAIN.fullmatch(text):
                parts.append((OPENING + text).split(" "))
            else:
                odd[i] = self.encode(text)
                parts.append([])
        words = list(chain.from_iterable(parts))
        before = self.store.rows, self.store.used
        found, lasting = self.memory.places(words, self.learn)
        ids, size = self.store.get(found)
        if not lasting:
            self.store.rows, self.store.used = before
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        counts = np.bincount(owner, size, len(texts)).astype(np.int64)
        if odd:
            cuts = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in odd.items():
                cuts[i] = np.array(own, np.uint32)
                counts[i] = len(own)
            ids = np.concatenate(cuts)
        return ids, counts


class Pieces:
    """Token counts of a `sentencepiece` model, without begin and end."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # no piece may reach over a space, or words would not be apart
        self.apart = not any(
            "▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))
        self.memory = Memory()
        self.sizes = np.zeros(1 << 14, np.int64)

    def learn(self, words: list[str]) -> dict[str, int]:
        n = len(self.memory.index)
        while n + len(words) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[n:n + len(words)] = self.whole(words)
        return dict(zip(words, range(n, n + len(words)), strict=True))

    def whole(self, texts: list[str]) -> list[int]:
        """As the library itself gives them."""
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def counts(self, texts: list[str]) -> np.ndarray:
        parts = [t.split(" ") if self.apart and PLAIN.fullmatch(t) else [] for t in texts]
        words = list(chain.from_iterable(parts))
        found, _ = self.memory.places(words, self.learn)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        counts = np.bincount(owner, self.sizes[found], len(texts)).astype(np.int64)
        odd = [i for i, p in enumerate(parts) if not p]
        counts[odd] = self.whole([texts[i] for i in odd])
        return counts


_loaded: dict[tuple[str, str], object] = {}


def load(kind: type, path: str, memory: int = MEMORY):
    """One encoder per worker process and file, which remembers so many words."""
    key = (kind.__name__, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
        _loaded[key].memory.limit = memory
    return _loaded[key]


def public(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
