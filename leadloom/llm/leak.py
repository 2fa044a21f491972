"""Evaluation texts leaking into training text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_NO_LETTER = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """The letters and digits of a text, of one width and without case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NO_LETTER.sub("", text.casefold())


class BlockShifts:
    """Wu-Manber search for every window of `width` characters of the items.

    A block is `block` characters. Its shift says how far the window may move when the block ends it: as far as the
    block's nearest place in any window is from the window's end, or past the block if no item holds it. At shift 0 the
    block's bucket names the places in the items that end with it, and the characters before are compared.
    """

    def __init__(self, items: Iterable[tuple[int, str]], width: int, block: int):
        self.width, self.block = width, block
        self.items: list[tuple[int, str]] = [(i, t) for i, t in items if len(t) >= width]
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for end in range(block, len(text) + 1):
                gram = text[end - block : end]
                left = max(0, width - end)
                if left < self.shift.get(gram, width):
                    self.shift[gram] = left
                if not left:
                    self.bucket.setdefault(gram, []).append((n, end))

    def found(self, text: str) -> set[int]:
        """The ids of the items that share `width` characters in a row with the text."""
        width, block, shift, out = self.width, self.block, self.shift.get, set()
        end, last, past = width, len(text), width - block + 1
        while end <= last:
            gram = text[end - block : end]
            by = shift(gram, past)
            if by:
                end += by
                continue
            window = text[end - width : end]
            for n, at in self.bucket[gram]:
                key, item = self.items[n]
                if key not in out and item[at - width : at] == window:
                    out.add(key)
            end += 1
        return out


def _gathered(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[list[tuple]]:
    """(key, letters) of the documents, as many at a time as hold about so many characters."""
    held, n = [], 0
    for b in batches:
        for key, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.append((key, letters(doc)))
            n += len(held[-1][1])
            if n >= chars:
                yield held
                held, n = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", width: int = 40, block: int = 8, block_chars: int = 4_000_000, held_chars: int = 32_000_000) -> DataFrame:
    """(doc_key, item_key): the document shares at least `width` letters and digits in a row with the item.

    Null, empty and shorter texts share nothing. An item id that has several rows leaks if one of them does. The items
    are searched in blocks of about `block_chars` characters, so the tables a task holds stay bounded however many items
    there are; each block is a broadcast of that size, and no item stays with the driver. The documents are read once: a
    task holds about `held_chars` of them at a time and takes the blocks in turn.
    """
    doc_type, item_type = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    held = items.where(F.col(text).isNotNull()).select(F.col(item_key).alias("k"), F.col(text).alias("t"))
    blocks, now, n = [], [], 0
    share = docs.sparkSession.sparkContext.broadcast
    for r in held.toLocalIterator():
        now.append((r["k"], letters(r["t"])))
        n += len(now[-1][1])
        if n >= block_chars:
            blocks.append(share(now))
            now, n = [], 0
    if now or not blocks:
        blocks.append(share(now))
    kinds = pa.schema([(doc_key, to_arrow_type(docs.schema[doc_key].dataType)), (item_key, to_arrow_type(items.schema[item_key].dataType))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at, order = None, -1, range(len(blocks))
        for group in _gathered(batches, held_chars if len(blocks) > 1 else 1_000_000):
            hits: list[tuple] = []
            for i in order:
                if i != at:
                    table, at = BlockShifts(blocks[i].value, width, block), i
                for key, doc in group:
                    hits += ((key, item) for item in sorted(table.found(doc)))
            order = order[::-1]  # the last block's tables come first
            if hits:
                yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*hits), kinds)], schema=kinds)

    source = docs.where(F.length(text) >= width // 18).select(doc_key, text)
    return source.mapInArrow(search, f"`{doc_key}` {doc_type}, `{item_key}` {item_type}").distinct()
