"""Tokenizer access: chunk caches, the segment-tree merge loop, and encoders built on both.

A *chunk* is a stretch of text that can be tokenized by itself: no pre-token of either vocabulary crosses its
borders.  Prose repeats its chunks, so each worker process keeps a bounded chunk -> packed-ids cache and only the
misses of a batch are encoded.  Ids travel as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of each of the two generations of a chunk cache (some 350 bytes each).  When the young one is full it
#: becomes the old one; what is still in use comes back from there.
CACHE_ENTRIES = 400_000
#: Chunks above this many characters are encoded but never cached.
CACHE_CHUNK_CHARS = 64
_NONE = np.iinfo(np.int64).max
_PY_ONLY_SPACE = re.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\s+")
#: A full stop or comma that belongs to a longer run of marks: it must not be cut off.
_JOINED_STOP = re.compile(r"[.,](?=\s)(?<=[^\s\w].|_.)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class SegmentTreeBPE:
    """BPE over one vocabulary file; merges are found with a segment tree over the ranks of adjacent pairs.

    Leaf i holds (rank of the pair that starts at symbol i, i) as one integer, inner nodes the smaller child, so
    the root is the leftmost pair of lowest rank.  A merge changes three leaves and their paths.  Words of like
    length run side by side as the rows of one NumPy array; single long words use a plain-list tree.
    """

    SCALAR_FROM = 128

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens: list[str] = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] << 20 | vocab[right], (rank, vocab[left + right]))
        self.keys = np.array(sorted(self.merges), np.int64)
        self.ranks = np.array([self.merges[int(k)][0] for k in self.keys], np.int64)
        self.made = np.zeros(len(model["merges"]) + 1, np.int64)
        for rank, new in self.merges.values():
            self.made[rank] = new
        # open addressing with a power-of-two table: most probes end at the first slot
        self.bits = 19
        self.slots = np.full(1 << self.bits, -1, np.int64)
        pending, at = np.arange(len(self.keys)), self._slot(self.keys)
        self.probes = 0
        while len(pending):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = pending[free]
            lost = self.slots[at] != pending
            pending, at = pending[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at, out = self._slot(key), np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            entry = self.slots[at]
            hit = (entry >= 0) & (self.keys[entry] == key[todo])
            out[todo[hit]] = self.ranks[entry[hit]]
            more = (entry >= 0) & ~hit
            if not more.any():
                break
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-tokenized word (non-empty UTF-8 bytes)."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > self.SCALAR_FROM):
            out[i] = self._encode_long(words[i])
        width = 1
        while width <= self.SCALAR_FROM:
            rows = np.flatnonzero((sizes <= width) & (sizes > width // 2))
            for at in range(0, len(rows), 65536):
                self._encode_block(words, rows[at : at + 65536], sizes, width, out)
            width *= 2
        return out

    def _encode_block(self, words, rows, sizes, width, out) -> None:
        if not len(rows):
            return
        n, size = len(rows), sizes[rows]
        raw = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)
        live = np.arange(width) < size[:, None]
        symbol = np.zeros((n, width + 1), np.int64)
        symbol[:, :width][live] = self.inner[raw]
        ends = np.cumsum(size) - 1
        symbol[np.arange(n), size - 1] = self.final[raw[ends]]
        if width > 1:
            after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
            before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
            after[np.arange(n), size - 1] = width
            tree = np.full((n, 2 * width), _NONE, np.int64)
            r, c = np.nonzero(np.arange(width) < size[:, None] - 1)
            rank = self.pair_rank(symbol[r, c], symbol[r, c + 1])
            found = rank >= 0
            tree[r[found], width + c[found]] = rank[found] * width + c[found]
            level = width // 2
            while level:
                tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
                level //= 2
            alive = np.flatnonzero(tree[:, 1] != _NONE)
            while len(alive):
                top = tree[alive, 1]
                i = top % width
                j = after[alive, i]
                symbol[alive, i] = self.made[top // width]
                k = after[alive, j]
                after[alive, i] = k
                inside = k < width
                before[alive[inside], k[inside]] = i[inside]
                live[alive, j] = False
                tree[alive, width + j] = _NONE
                h = before[alive, i]
                right, left = np.flatnonzero(inside), np.flatnonzero(h >= 0)
                rank = self.pair_rank(
                    np.concatenate([symbol[alive[right], i[right]], symbol[alive[left], h[left]]]),
                    np.concatenate([symbol[alive[right], k[right]], symbol[alive[left], i[left]]]),
                )
                at = np.full(len(alive), _NONE, np.int64)
                got = rank[: len(right)]
                at[right] = np.where(got >= 0, got * width + i[right], _NONE)
                tree[alive, width + i] = at
                got = rank[len(right) :]
                tree[alive[left], width + h[left]] = np.where(got >= 0, got * width + h[left], _NONE)
                for w, leaf in ((alive, i), (alive, j), (alive[left], h[left])):
                    node = (width + leaf) >> 1
                    while node[0] if len(node) else 0:
                        tree[w, node] = np.minimum(tree[w, 2 * node], tree[w, 2 * node + 1])
                        node >>= 1
                alive = alive[tree[alive, 1] != _NONE]
        flat = symbol[:, :width][live].astype(np.uint32)
        stops = np.cumsum(live.sum(1))
        for row, ids in zip(rows, np.split(flat, stops[:-1]), strict=True):
            out[row] = ids

    def _encode_long(self, word: bytes) -> np.ndarray:
        symbol = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbol[-1] = int(self.final[word[-1]])
        n, width = len(symbol), 1
        while width < len(symbol):
            width *= 2
        merges, none = self.merges, (1 << 62)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            pair = merges.get(symbol[i] << 20 | symbol[i + 1])
            if pair:
                tree[width + i] = pair[0] * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        def value(i: int, j: int) -> int:
            pair = merges.get(symbol[i] << 20 | symbol[j])
            return pair[0] * width + i if pair else none

        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            symbol[i], symbol[j] = int(self.made[rank]), -1
            k = after[i] = after[j]
            put(j, none)
            if k < n:
                before[k] = i
                put(i, value(i, k))
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                put(h, value(h, i))
        return np.array([s for s in symbol if s >= 0], np.uint32)

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, as the library does for a vocabulary file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class ChunkEncoder:
    """Texts to packed ids through a bounded cache of chunks.  Subclasses say how misses are encoded."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        self.entries = entries
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def rotate(self) -> None:
        if len(self.cache) > self.entries:
            self.old = dict(self.cache)
            self.cache.clear()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, in order.  Null texts count as empty."""
        for at in range(0, len(texts), 256):
            part = [self.chunks(t) if t else [] for t in texts[at : at + 256]]
            self.rotate()
            cache, old, fresh = self.cache, self.old, []
            for chunk in set().union(*part).difference(cache):
                if chunk in old:
                    cache[chunk] = old[chunk]
                else:
                    fresh.append(chunk)
            long = {}
            for chunk, ids in zip(fresh, self.encode_chunks(fresh), strict=True):
                (cache if len(chunk) <= CACHE_CHUNK_CHARS else long)[chunk] = ids
            find = (lambda c: long[c] if c in long else cache[c]) if long else cache.__getitem__
            for chunks in part:
                yield b"".join(map(find, chunks))


def white_chunks(text: str) -> list[str]:
    """Split for a vocabulary that composes, lower-cases and drops white space, none of which crosses a chunk.

    Where it is safe the whole text is lower-cased and single stops are cut off, which makes for fewer chunks.
    U+001C to U+001F are white space to Python but not to the vocabulary.
    """
    if _PY_ONLY_SPACE.search(text):
        return [c for c in _WHITE.split(text) if c]
    if "\u03a3" not in text and "<|" not in text and unicodedata.is_normalized("NFC", text):
        lower = text.lower()
        # what a letter becomes may belong to the stop behind it, so stops are only cut off lower-cased texts
        if unicodedata.is_normalized("NFC", lower):
            text = lower
            if not _JOINED_STOP.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
    return text.split()


class SegmentTreeWordEncoder(ChunkEncoder):
    """The lower-casing word-end vocabulary by :class:`SegmentTreeBPE`: composes, lower-cases, splits, merges.

    Python and the library need not know the same version of Unicode, so words with characters from ``FOREIGN`` on
    are composed, lower-cased and split by the library."""

    FOREIGN = "\u0530"

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.bpe = SegmentTreeBPE(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.specials))) + ")")
        self.chunks = white_chunks  # type: ignore[method-assign]

    def pieces(self, part: str) -> list[bytes]:
        """The pre-tokens of a word without special tokens."""
        if not part.isascii():
            if max(part) >= self.FOREIGN:
                mapped = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))
                return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in mapped]
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        return [p.encode() for p in self.piece.findall(part.lower())]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        index: dict[bytes, int] = {}
        plans: list[list[int]] = []
        for chunk in chunks:
            plan: list[int] = []
            for part in self.special.split(chunk) if "<|" in chunk else (chunk,):
                if part in self.bpe.specials:
                    plan.append(-1 - self.bpe.specials[part])
                elif part:
                    plan += [index.setdefault(p, len(index)) for p in self.pieces(part)]
            plans.append(plan)
        words = [i.tobytes() for i in self.bpe.encode_words(list(index))]
        return [b"".join([words[i] if i >= 0 else (-1 - i).to_bytes(4, "little") for i in plan]) for plan in plans]


class _Misses(dict):
    """Encodes a chunk when it is first asked for; long chunks are not kept."""

    def __init__(self, owner: LibraryEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        ids = self.owner.old.get(chunk)
        if ids is None:
            ids = self.owner.encode_chunk(chunk)
        if len(chunk) <= CACHE_CHUNK_CHARS:
            self[chunk] = ids
        return ids


class LibraryEncoder(ChunkEncoder):
    """Any tokenizers file by the library itself.  ``spaced``: blanks belong to the chunks, for a vocabulary that keeps them."""

    def __init__(self, path: str, spaced: bool, entries: int = CACHE_ENTRIES):
        super().__init__(entries)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: Control characters and white space but for the blank and the line feed, as one set, which scans fast.
        self.odd = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.safe = re.compile(r"(?<=\S)(?= \S)")
        self.chunks = self._spaced if spaced else white_chunks  # type: ignore[method-assign]
        self.spaced = spaced
        self.cache = _Misses(self)
        self.model = self.library.model
        self.alphabet = dict(enumerate(byte_alphabet()))

    def _spaced(self, text: str) -> list[str]:
        """Pieces of the text itself, each with the blank before it.

        Cuts fall where the vocabulary's own pattern always cuts: before a single blank, before a stop that ends a
        word, and on both sides of a single line feed.  The cuts of a plain text are written as U+0001, which such a
        text does not hold.
        """
        if (
            text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
            or self.odd.search(text) or _JOINED_STOP.search(text)
        ):
            return self.safe.split(text)
        text = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").replace(".\x01", "\x01.\x01").replace(",\x01", "\x01,\x01")
        if "\x01 \x01" in text:  # a blank before a stop belongs to it
            text = text.replace("\x01 \x01", "\x01 ")
        return text.split("\x01")

    def encode_chunk(self, chunk: str) -> bytes:
        # a run of letters is one pre-token, which the library's model takes as it is
        if self.spaced:
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                return self._pre_token(chunk.encode())
        elif chunk.isalpha() and chunk == chunk.lower() and unicodedata.is_normalized("NFC", chunk):
            return self._pre_token(chunk.encode())
        return array("I", self.library.encode(chunk, None, False, False).ids).tobytes() if chunk else b""

    def _pre_token(self, raw: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.alphabet))]).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            self.rotate()
            yield b"".join(map(self.cache.__getitem__, self.chunks(text))) if text else b""
