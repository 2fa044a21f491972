"""Encoding and decoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of a public vocabulary on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_pattern() -> str:
    """The expression that cuts a text into the pieces tokens never cross."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Bpe:
    """A backtracking encoder.

    The longest tokens at each place come from one Aho-Corasick pass over a segment; the encoder takes them greedily,
    accepts a token after another only if the pair is compatible (merging their bytes gives just these two), tries shorter
    prefixes otherwise, and steps back where none fits. Ranks are ids. Pieces are cut further at places no token of the
    vocabulary can cross, so segments are short and repeat; every distinct segment and piece is encoded once per task.
    """

    def __init__(self, path: str, pattern: str, cache: int = 400_000):
        self.tokens: list[bytes] = []
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as file:
            for line in file:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern).findall
        self.longest = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.longest.add_word(token.decode("latin-1"), rank)
        self.longest.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.crossings: set[tuple[bytes, bytes]] = set()
        for token in ranks:
            for i in range(1, len(token)):
                self.crossings.add((token[max(0, i - 4) : i], token[i : i + 4]))
        self.crosses: dict[str, bool] = {}
        self.segments: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def merged(self, data: bytes) -> list[int]:
        """The ids of `data` by definition: the adjacent pair of least rank is merged until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token, None for a single byte."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], token)) < token)
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two when their bytes are encoded together.

        The later of the two merges next to the boundary is undone, step by step; the pair breaks if what then touches
        the boundary could have merged before that.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right, before, ranks, tokens = a, b, len(self.tokens), self.ranks, self.tokens
        fits = True
        while True:
            if ranks.get(tokens[left] + tokens[right], before) < before:
                fits = False
                break
            undone = None
            if left > right:
                undone = self.split(left)
                if undone:
                    before, left = left, undone[1]
            if not undone:
                undone = self.split(right)
                if undone:
                    before, right = right + 1, undone[0]
                elif left <= right and (undone := self.split(left)):
                    before, left = left, undone[1]
            if not undone:
                break
        if len(self.fits) >= 2_000_000:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of the token, -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = self.shorter[token] = next((self.ranks[data[:i]] for i in range(len(data) - 1, 0, -1) if data[:i] in self.ranks), -1)
        return known

    def backtrack(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        longest = [-1] * len(data)
        for end, token in self.longest.iter(data.decode("latin-1")):
            longest[end + 1 - len(self.tokens[token])] = token  # ends rise, so the longest is written last
        open_at = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(data):
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.tokens[token])
                if open_at[end] and (last < 0 or self.pair_fits(last, token)):
                    break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(data) else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(self.tokens[token])
        return out

    def may_cross(self, pair: str) -> bool:
        """Whether a token can hold the end of the first character together with the start of the second."""
        known = self.crosses.get(pair)
        if known is None:
            a, b = pair[0].encode(), pair[1].encode()
            known = any(self._meets(a, left) and self._starts(b, right) for left, right in self._crossing_list(a, b))
            self.crosses[pair] = known
        return known

    @functools.cached_property
    def _by_bytes(self) -> dict[tuple[int, int], list[tuple[bytes, bytes]]]:
        out: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for left, right in self.crossings:
            out.setdefault((left[-1], right[0]), []).append((left, right))
        return out

    def _crossing_list(self, a: bytes, b: bytes) -> list[tuple[bytes, bytes]]:
        return self._by_bytes.get((a[-1], b[0]), [])

    @staticmethod
    def _meets(char: bytes, left: bytes) -> bool:
        return char.endswith(left) or left.endswith(char)

    @staticmethod
    def _starts(char: bytes, right: bytes) -> bool:
        return char.startswith(right) or right.startswith(char)

    def piece(self, text: str) -> bytes:
        """The ids of a piece as packed 32-bit integers."""
        if len(text) < 2 or text.isascii():
            return self.segment(text)
        out, start, crosses = [], 0, self.crosses
        for i in range(1, len(text)):
            pair = text[i - 1 : i + 1]
            c = crosses.get(pair)
            if c is None:
                c = self.may_cross(pair)
            if not c:
                out.append(self.segment(text[start:i]))
                start = i
        out.append(self.segment(text[start:]))
        return b"".join(out)

    def segment(self, text: str) -> bytes:
        known = self.segments.get(text)
        if known is None:
            known = np.array(self.backtrack(text.encode()), np.int32).tobytes()
            if len(self.segments) >= self.cache:
                self.segments.clear()
            self.segments[text] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        known, out = self.known, []
        for p in self.pieces(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(known) >= self.cache:
                    known.clear()
                if len(p) < 64:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes in a row and where each starts."""
        offsets = np.zeros(len(self.tokens) + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=offsets[1:])
        return np.frombuffer(b"".join(self.tokens), np.uint8), offsets

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: each is copied from its place in the table."""
        data, offsets = self.table
        ids = np.asarray(ids, np.int64)
        sizes = offsets[ids + 1] - offsets[ids]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[ids] - (ends - sizes), sizes)
        return data[index].tobytes()


@functools.cache
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode(docs: DataFrame, key: str, text: str = "text", path: str | None = None, pattern: str | None = None, max_ids: int = 4_000_000) -> DataFrame:
    """(key, ids): the token ids of each text, one row per row. Null and empty texts have an empty list.

    Special-token strings are ordinary text. There is no exchange; `path` must be the same on all executors. A batch of
    rows is given out in parts of about `max_ids` ids.
    """
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)

        def out(b: pa.RecordBatch, start: int, packed: list[bytes]) -> pa.RecordBatch:
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(packed), np.int32), pa.int32())
            return pa.record_batch([b.column(0).slice(start, len(packed)), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[key, "ids"])

        for b in batches:
            packed, held, start = [], 0, 0
            for i, t in enumerate(b.column(1).to_pylist()):
                packed.append(bpe.encode(t) if t else b"")
                held += len(packed[-1]) // 4
                if held >= max_ids:
                    yield out(b, start, packed)
                    packed, held, start = [], 0, i + 1
            if packed:
                yield out(b, start, packed)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, text): the text of each list of ids; a null list gives null, an empty one ''. Broken UTF-8 gives U+FFFD."""
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for b in batches:
            texts = [None if not x.is_valid else bpe.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
