"""Byte-pair encoding of whole partitions at once, over an index from each pair to all its positions."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text encoded together, and distinct words kept from one block to the next.
BLOCK_CHARS, KEPT_WORDS = 4_000_000, 200_000

#: The word pattern of this family of vocabularies, for lower-cased text of the Latin blocks.
LATIN_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼-¾]|[^\t-\r a-z0-9ªµºÀ-ÖØ-öø-ſ²³¹¼-¾]+"
)
#: Beyond this letter, or with the one whose lower case is two letters, the library's own normaliser and pattern are used.
_LAST_LATIN, _DOTTED = "ſ", "İ"
#: White space as the vocabulary's pattern has it; str.split() also cuts at the four separators below.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


class PairIndexEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.text_of = {i: s for s, i in (vocab | self.special).items()}
        self.number_of = {i: str(i) for i in self.text_of}
        self.width = len(vocab)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.left, self.right = keys // self.width, keys % self.width
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        letters = byte_letters()
        self.letters = {b: c for b, c in letters.items() if chr(b) != c}
        self.inner, self.last = np.zeros(512, np.int32), np.zeros(512, np.int32)
        for c in letters.values():
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + self.end]
        self.known: dict[str, tuple[str, str]] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 if it never merges."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all pieces (laid end to end, beginning at ``starts``): the symbols left, and their places.

        ``index`` maps the rank of each pair to lists of the positions of its left
        symbol. Ranks are applied in ascending order to all their positions at once;
        positions whose pair has changed meanwhile are passed over, and the pairs
        that a merge creates join their lists. A new pair may rank lower than the one
        at hand, so active ranks wait in a heap.
        """
        n = len(symbols)
        symbols = symbols.astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        before[starts] = -1
        after[np.r_[starts[1:], n] - 1] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self._rank(symbols[at], symbols[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, some in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(waiting, r)
                index[r].append(some)

        add(np.flatnonzero(after >= 0).astype(np.int32))
        while waiting:
            rank = heapq.heappop(waiting)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else _distinct(np.concatenate(found))
            at = at[alive[at] & (symbols[at] == self.left[rank]) & (after[at] >= 0)]
            at = at[symbols[after[at]] == self.right[rank]]
            if not len(at):
                continue
            if self.left[rank] == self.right[rank]:  # of a run of equal symbols every other pair, from the left
                fresh = np.r_[True, at[1:] != after[at[:-1]]]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[rank]
            alive[gone] = False
            onward = after[gone]
            after[at] = onward
            before[onward[onward >= 0]] = at[onward >= 0]
            add(_distinct(np.concatenate([before[at][before[at] >= 0], at[onward >= 0]])))
        place = np.flatnonzero(alive)
        return symbols[place], place

    def _split(self, word: str) -> list[str]:
        """The pieces of one word without white space, each byte written as its letter."""
        if max(word) <= _LAST_LATIN and _DOTTED not in word:
            low = word.lower()
            found = LATIN_PIECES.findall(low)
            if low.isascii() and low.isprintable():
                return found
            return [p.encode().decode("latin-1").translate(self.letters) for p in found]
        return [p for p, _ in self.pieces(self.normalize(word))]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words that are not known yet."""
        pieces: list[str] = []
        first: list[int] = []  # piece at which each word begins
        for word in words:
            first.append(len(pieces))
            pieces += self._split(word)
        starts = np.cumsum([0, *map(len, pieces)])
        symbols = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
        first = starts[np.array([*first, len(pieces)], dtype=np.int64)]
        if len(symbols):
            coded = self.inner[symbols]
            coded[starts[1:] - 1] = self.last[symbols[starts[1:] - 1]]
            ids, place = self.merge(coded, starts[:-1])
        else:
            ids, place = np.empty(0, np.int64), np.empty(0, np.int64)
        bounds = np.searchsorted(place, first).tolist()
        numbers = list(map(self.number_of.__getitem__, ids.tolist()))
        texts = list(map(self.text_of.__getitem__, ids.tolist()))
        for word, a, b in zip(words, bounds[:-1], bounds[1:], strict=True):
            self.known[word] = (" ".join(numbers[a:b]), " ".join(texts[a:b]))

    def _words(self, text: str) -> list[str]:
        found = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                found.append(part)
            elif _SEPARATORS.search(part):
                found += filter(None, _SPACE.split(part))
            else:
                found += part.split()
        return found

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text its ids and its decoded form: token texts joined by blanks, as no decoder is named.

        New words of all texts are learned together first. Texts are split again when their turn comes, so that
        no more than one text's words and no form of another text are held.
        """
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        for content, number in self.special.items():
            self.known[content] = (str(number), content)
        self.learn(list(set(w for t in texts for w in self._words(t or "") if w not in self.known)))
        known = self.known
        for t in texts:
            words = self._words(t or "")
            numbers, letters = zip(*map(known.__getitem__, words), strict=True) if words else ((), ())
            yield " ".join(numbers), " ".join(letters)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(docs: DataFrame, path: str, digests: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id`` and the encoding of each whole text, in one pass without a shuffle.

    With ``digests`` (n_tokens, ids_sha256, decoded_sha256), else (ids, decoded).
    ``path``: the vocabulary file, at the same place on every executor. Special
    tokens inside texts are taken as such, none is added. Null texts are empty: no
    tokens. Repeated rows and null ids are kept; other columns are not looked at; an
    empty table stays empty.
    """
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(path)

        def made(ids: list, texts: list) -> pa.RecordBatch:
            found = encoder.encode(texts)
            numbers = pa.array(ids, pa.int64())
            if digests:
                count, of_ids, of_text = zip(*[(a.count(" ") + 1 if a else 0, _sha(a), _sha(b)) for a, b in found], strict=True)
                rest = [pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                found = list(found)
                rest = [pa.array([[int(i) for i in a.split()] for a, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found], pa.string())]
                names = ["ids", "decoded"]
            return pa.RecordBatch.from_arrays([numbers, *rest], ["doc_id", *names])

        for part in parts:
            ids, texts, size = [], [], 0
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                ids.append(doc.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= block_chars:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, f"doc_id long, {kinds}")
