"""Tokenising with the tokenizers library through a bounded cache of chunks.

A text is cut where the tokenizer's own pre-tokenizer always splits: where white space begins, and between letters and
ASCII punctuation other than apostrophes. So encoding the chunks one by one gives the ids of the whole text. The distinct
chunks of a group of texts are found by Arrow; only those are looked up, and only those that the cache lacks reach the
library. Ids live in one flat numpy pool and are gathered by index. When the cache is full, the less used half of its
entries goes.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

#: Entries of a worker's cache: at some 200 bytes each, about 50 MB.
MAX_ENTRIES = 250_000
#: Bytes of text whose chunks are in memory at once; a longer text stands alone.
GROUP_BYTES = 2 << 20
#: Chunks longer than this are not kept.
LONGEST = 128
#: White space other than ASCII's, and separators on which regex engines disagree: texts with these go to the library whole.
ODD_SPACE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LETTER, PUNCTUATION = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = PUNCTUATION
#: Chunks that are one pre-token: at most a space, then letters up to U+00FF.
PLAIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}


def breaks(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 bytes may be cut between a letter (ASCII or Latin-1) and ASCII punctuation."""
    kind = KIND[data]
    left, right = kind.copy(), kind
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # a character of two bytes
    left[1:][latin], right[:-1][latin] = LETTER, LETTER
    out = np.zeros(len(data), bool)
    out[1:] = left[:-1] + right[1:] == LETTER + PUNCTUATION
    out[1:] &= (left[:-1] != 0) & (right[1:] != 0)
    return out


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ChunkCache:
    def __init__(self, path: str, most: int = MAX_ENTRIES):
        self.lib, self.most = tokenizer(path), most
        self.lower = "</w>" == getattr(self.lib.model, "end_of_word_suffix", None)  # this vocabulary has lower case alone, and no white space
        self.letters = byte_letters()
        self.mark, self.mark_id = next((t.content, i) for i, t in self.lib.get_added_tokens_decoder().items() if t.content == "<|endoftext|>")
        # Texts with the string of a special token, in any case as some vocabularies lower it: no cut but white space leaves those whole.
        self.special = "(?i)" + "|".join(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values())
        self.is_special = re.compile(self.special).search
        self.index: dict[str, int] = {}
        self.start, self.length, self.uses = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _shrink(self) -> None:
        """Keep the half of the entries that was used most; their counts are halved, so that old fame fades."""
        n = len(self.index)
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.most // 2])
        at, size = self.start[keep], self.length[keep]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        pool = self.pool[np.arange(total) + np.repeat(at - (ends - size), size)]
        chunks = list(self.index)
        self.index = {chunks[k]: i for i, k in enumerate(keep.tolist())}
        self.start, self.length, self.uses = ends - size, size, self.uses[keep] // 2
        self.pool, self.used = pool, total

    def _put(self, n0: int, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of entries n0 and on."""
        n = n0 + len(sizes)
        if (more := self.used + len(flat) - len(self.pool)) > 0:
            self.pool = np.concatenate([self.pool, np.zeros(max(more, len(self.pool) // 2), np.uint32)])
        if n > len(self.start):
            pad = np.zeros(max(n - len(self.start), len(self.start) // 2), np.int64)
            self.start, self.length, self.uses = (np.concatenate([x, pad]) for x in (self.start, self.length, self.uses))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[n0:n], self.length[n0:n], self.uses[n0:n] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += len(flat)

    def _encoded(self, chunks: list[str]):
        """(flat ids, sizes) of a list of chunks, in order. Plain ones are looked up in the vocabulary; of others, many go in one call:
        a special token between them parts them again; chunks that may hold one go alone."""
        part: list[str] = []
        flat: list[int] = []
        sizes: list[int] = []

        def plain():
            out = np.array(flat, np.uint32), np.array(sizes, np.int64)
            flat.clear()
            sizes.clear()
            return out

        def batch():
            ids = np.array(self.lib.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark_id)
            out = np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            part.clear()
            return out

        for c in chunks:
            if PLAIN.fullmatch(c):
                if part:
                    yield batch()
                if self.lower:
                    c = c.strip().lower()
                got = self.lib.model.tokenize(c.encode().decode("latin-1").translate(self.letters))
                flat.extend(t.id for t in got)
                sizes.append(len(got))
                continue
            if sizes:
                yield plain()
            if self.is_special(c):
                if part:
                    yield batch()
                ids = np.array(self.lib.encode(c, add_special_tokens=False).ids, np.uint32)
                yield ids, np.array([len(ids)])
            else:
                part.append(c)
                if len(part) == 5_000:
                    yield batch()
        if sizes:
            yield plain()
        if part:
            yield batch()

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text (a list or an Arrow column; null: none), as the library's encode(text, add_special_tokens=False) gives them."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column.cast(pa.string()), "")
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        out, first, held = [], 0, 0
        for k, n in enumerate(size.tolist()):
            if k > first and held + n > GROUP_BYTES:
                out += self._encode(column.slice(first, k - first))
                first, held = k, 0
            held += n
        return out + self._encode(column.slice(first)) if first < len(column) else out

    def _encode(self, column: pa.StringArray) -> list[np.ndarray]:
        offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        base, total = int(offset[0]), int(offset[-1] - offset[0])
        if not total:
            return [np.zeros(0, np.uint32)] * len(column)
        data = np.frombuffer(column.buffers()[2], np.uint8)[base : base + total]
        bounds = (offset - base).astype(np.int64)
        white = WHITE[data]
        begins, finer = np.empty(total, bool), breaks(data)
        begins[0], begins[1:] = True, white[1:] & ~white[:-1]
        marked = np.flatnonzero(pc.match_substring_regex(column, self.special).to_numpy(zero_copy_only=False))
        for k in marked:
            finer[bounds[k] : bounds[k + 1]] = False
        begins |= finer
        for k in np.flatnonzero(pc.match_substring_regex(column, ODD_SPACE).to_numpy(zero_copy_only=False)):
            begins[bounds[k] : bounds[k + 1]] = False
        if self.lower:
            upper = (data >= 65) & (data <= 90)
            for k in marked:
                upper[bounds[k] : bounds[k + 1]] = False
            data = data + np.uint8(32) * upper
        begins[bounds[:-1][bounds[:-1] < total]] = True
        cut = np.append(np.flatnonzero(begins), total).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(data)).dictionary_encode()
        names = chunks.dictionary.to_pylist()
        slots = np.fromiter((self.index.get(c, -1) for c in names), np.int64, len(names))
        new, n0, kept = np.flatnonzero(slots < 0), len(self.index), 0
        if len(new):
            size = pc.binary_length(chunks.dictionary).to_numpy()[new]
            plain = np.fromiter((PLAIN.fullmatch(names[k]) is not None for k in new.tolist()), bool, len(new))
            new = np.concatenate([new[(size <= LONGEST) & plain], new[(size <= LONGEST) & ~plain], new[size > LONGEST]])  # those to keep come first, and of them the plain ones
            kept = int((size <= LONGEST).sum())
            slots[new] = n0 + np.arange(len(new))
            self.index.update(zip((names[k] for k in new[:kept]), range(n0, n0 + kept), strict=True))
            at = n0
            for flat, sizes in self._encoded([names[k] for k in new]):
                self._put(at, flat, sizes)
                at += len(sizes)
        where = chunks.indices.to_numpy()
        own = slots[where]
        sizes = self.length[own]
        ends = np.cumsum(sizes)
        flat = self.pool[np.arange(int(ends[-1])) + np.repeat(self.start[own] - (ends - sizes), sizes)]
        upto = np.concatenate([[0], ends])[np.searchsorted(cut, bounds)]
        self.uses[slots] += np.bincount(where, minlength=len(names))
        if len(new) > kept:
            self.used = int(self.start[n0 + kept])
        if len(self.index) > self.most or self.used > 8 * self.most:
            self._shrink()
        return np.split(flat, upto[1:-1])


@functools.lru_cache(maxsize=2)
def cache(path: str) -> ChunkCache:
    return ChunkCache(path)


@functools.lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a byte-level vocabulary: all tokens' bytes in one array, and each id's start and length there."""
    lib = tokenizer(path)
    back = {c: b for b, c in byte_letters().items()}
    special = {i: t.content for i, t in lib.get_added_tokens_decoder().items()}
    words = []
    for i in range(lib.get_vocab_size(with_added_tokens=True)):
        t = lib.id_to_token(i)
        words.append(special[i].encode() if i in special else bytes(back[c] for c in t or ""))
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


def decode_bytes(path: str, ids: np.ndarray) -> bytes:
    """What the library's decode(ids, skip_special_tokens=False) returns, in UTF-8: malformed bytes become U+FFFD."""
    data, start, size = byte_table(path)
    n = size[ids]
    ends = np.cumsum(n)
    flat = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[ids] - (ends - n), n)].tobytes()
    return flat.decode("utf-8", "replace").encode()


def _clear() -> None:
    cache.cache_clear()
    byte_table.cache_clear()
    tokenizer.cache_clear()


CACHES["tokens"] = _clear
