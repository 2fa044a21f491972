"""Long exact spans shared between records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.sources.tables import cut

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(codes: np.ndarray, gram: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of all grams of a text (code points): a rolling sum, then mixed. up, down: powers of the base and of its inverse."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    done, low = 1, h
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    return np.minimum(low[: len(low) - (width - done)], low[width - done :]) if done < width else low


class Anchors:
    """Grams chosen by content: each span of `span` characters has one, and it depends on those characters alone."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram = span, gram
        self.up, self.down = _powers(_BASE, 1 << 14), _powers(_BACK, 1 << 14)

    def hashes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        while len(self.up) < len(codes):
            self.up, self.down = _powers(_BASE, 2 * len(self.up)), _powers(_BACK, 2 * len(self.down))
        return gram_hashes(codes, self.gram, self.up, self.down)

    def of(self, text: str) -> np.ndarray:
        """The distinct anchors of a text, as hashes."""
        if len(text) < self.span:
            return np.empty(0, np.int64)
        low = window_minima(self.hashes(text), self.span - self.gram + 1)
        return np.unique(low).view(np.int64)

    def texts(self, text: str, wanted: np.ndarray) -> list[tuple[str, int]]:
        """The text of each wanted anchor, with its hash."""
        h = self.hashes(text).view(np.int64)
        values, first = np.unique(h, return_index=True)
        return [(text[i : i + self.gram], int(v)) for v, i in zip(values, first) if v in wanted]


def anchors(docs: DataFrame, key: str, text: str, span: int, gram: int) -> DataFrame:
    """(h, doc): the anchors of each document, each once; texts shorter than the span and null ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = Anchors(span, gram)
        for b in batches:
            found = [pick.of(t) for t in b.column(1).to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            if counts.sum():
                at = pa.array(np.repeat(np.arange(len(found)), counts))
                yield pa.record_batch([pa.array(np.concatenate(found)), b.column(0).take(at)], names=["h", "doc"])

    rows = docs.where(F.length(text) >= span).select(F.col(key).alias("doc"), text)
    return rows.mapInArrow(run, f"h bigint, doc {docs.schema[key].dataType.simpleString()}")


def occurrences(docs: DataFrame, recurring: DataFrame, key: str, text: str, span: int, gram: int, shard_docs: int = 2000, pair_docs: int = 64) -> DataFrame:
    """(h, w, doc, at, before, after): every occurrence of every recurring anchor, with its place and the characters that a span may add to it.

    recurring: (h, doc, home, n), an anchor, a document that has it, the smallest one that has it and how many have it.
    Anchors of one home make one shard, so a document goes to few shards. Documents of a shard with more than `shard_docs`
    are split among several tasks, each with the shard's automaton; the automaton holds one document's anchors at most.
    An anchor that more than `pair_docs` documents have isn't to be compared in pairs: it gives the spans around it
    instead, each by a 128-bit hash (h and w) and without characters, so only documents that share a whole span meet.
    `at` counts code points from 0.
    """
    reach = span - gram
    kind = docs.schema[key].dataType.simpleString()
    routes = recurring.select("home", "doc").distinct()
    sizes = routes.groupBy("home").agg(F.ceil(F.count("*") / shard_docs).cast("int").alias("parts"))
    routed = routes.join(sizes, "home").select("home", "doc", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).otherwise(0).alias("part"), "parts")
    body = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= span)
    none = F.lit(None).cast("array<bigint>")
    streamed = routed.join(body, "doc").select("home", "part", F.lit(1).alias("kind"), "doc", "text", none.alias("hs"), none.alias("hot"))
    own = recurring.where("doc = home").groupBy("home").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("n") > pair_docs, F.col("h"))).alias("hot")).join(sizes, "home")
    own = own.join(body, F.col("home") == body["doc"]).select("home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), body["doc"].alias("doc"), "text", "hs", "hot")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pick, automaton, shard, hot = Anchors(span, gram), None, None, set()
        names = ["h", "w", "doc", "at", "before", "after"]
        for frame in frames:
            rows: list[tuple] = []
            for home, part, what, doc, body, hs, hot_ in frame.itertuples(index=False):
                if what == 0:
                    shard, automaton, hot = (home, part), ahocorasick.Automaton(), set(map(int, hot_))
                    for passage, h in pick.texts(body, set(map(int, hs))):
                        automaton.add_word(passage, h)
                    automaton.make_automaton()
                    continue
                assert shard == (home, part)
                whole: dict[int, bytes] = {}
                for end, h in automaton.iter(body):
                    end += 1
                    start = end - gram
                    around = body[max(0, start - reach) : end + reach]
                    if h in hot:
                        first = max(0, start - reach)
                        for i in range(len(around) - span + 1):
                            if first + i not in whole:
                                whole[first + i] = hashlib.blake2b(around[i : i + span].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    else:
                        rows.append((h, "", doc, start, body[max(0, start - reach) : start][::-1], body[end : end + reach]))
                rows += [(int.from_bytes(x[:8], "little", signed=True), x[8:].hex(), doc, i, None, None) for i, x in whole.items()]
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    together = streamed.unionAll(own.select(streamed.columns)).repartition("home", "part").sortWithinPartitions("home", "part", "kind")
    return together.mapInPandas(run, f"h bigint, w string, doc {kind}, at int, before string, after string")


def _common(a: str, b: str) -> int:
    """How many first characters are the same."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        low, n = (mid, n) if a[:mid] == b[:mid] else (low, mid)
    return low


def shared_spans(docs: DataFrame, key: str, text: str = "text", span: int = 120, gram: int = 64, pair_docs: int = 64) -> DataFrame:
    """(doc_a, doc_b): documents whose texts have `span` code points in a row in common, verbatim; doc_a < doc_b.

    1. Each document gives anchors, grams of `gram` characters chosen so that every span has at least one; anchors of two
       documents or more recur. 2. The recurring ones are compiled into Aho-Corasick automata, one per shard, and the
       documents that have any are streamed through their shards to locate all occurrences. 3. Documents that share an
       anchor are compared around it; the pair stays if the common text is long enough. An anchor of more than `pair_docs`
       documents, such as a common phrase, is replaced by the spans around it, so no pairs are tried in vain.
    Null, empty and short texts share nothing; a document never pairs with itself, also when its row is repeated.
    """
    met = _met(_found(docs, key, text, span, gram, pair_docs)).where("doc_a < doc_b")
    kind = docs.schema[key].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, keep = set(), []
            columns = [c.to_pylist() for c in b.columns]
            for i, (x, y, ba, aa, bb, ab) in enumerate(zip(*columns)):
                if (x, y) not in known and (ba is None or _common(ba, bb) + gram + _common(aa, ab) >= span):
                    known.add((x, y))
                    keep.append(i)
            if keep:
                yield pa.record_batch([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], names=["doc_a", "doc_b"])

    return met.select("doc_a", "doc_b", "ba", "aa", "bb", "ab").mapInArrow(verify, f"doc_a {kind}, doc_b {kind}").distinct()


def _found(docs: DataFrame, key: str, text: str, span: int, gram: int, pair_docs: int) -> DataFrame:
    """The occurrences of the anchors that two documents or more have."""
    fingerprints = anchors(docs, key, text, span, gram)
    homes = fingerprints.groupBy("h").agg(F.min("doc").alias("home"), F.max("doc").alias("top"), F.count("*").alias("n")).where("home <> top").drop("top")
    recurring = cut(fingerprints.join(homes, "h"))
    return cut(occurrences(docs, recurring, key, text, span, gram, pair_docs=pair_docs))


def _met(found: DataFrame) -> DataFrame:
    """Occurrences of one anchor (or span) in two documents: doc_a, ba, aa and doc_b, bb, ab, the characters around them."""
    left = found.select("h", "w", F.col("doc").alias("doc_a"), F.col("before").alias("ba"), F.col("after").alias("aa"))
    right = found.select("h", "w", F.col("doc").alias("doc_b"), F.col("before").alias("bb"), F.col("after").alias("ab"))
    return left.join(right, ["h", "w"])


def shared_stretches(rows: list[tuple], gram: int, reach: int) -> list[tuple]:
    """(doc, start, end): what each occurrence of one anchor shares with occurrences in other documents, by the windows of full length around it.

    rows: doc, at, and the characters before (nearest first) and after. Windows are looked up, not compared in pairs.
    """
    around: dict[tuple[str, str], list[tuple]] = {}
    for doc, at, before, after in rows:
        around.setdefault((before, after), []).append((doc, at))
    holders: list[dict[tuple[str, str], tuple]] = [{} for _ in range(reach + 1)]
    for (before, after), places in around.items():
        low, high = min(d for d, _ in places), max(d for d, _ in places)
        for j in range(max(0, reach - len(after)), min(reach, len(before)) + 1):
            window = (before[:j], after[: reach - j])
            a, b = holders[j].get(window, (low, high))
            holders[j][window] = (min(a, low), max(b, high))
    out = []
    for (before, after), places in around.items():
        shared = [j for j in range(max(0, reach - len(after)), min(reach, len(before)) + 1) if (x := holders[j][before[:j], after[: reach - j]])[0] != x[1]]
        for doc, at in places if shared else []:
            out.append((doc, at - shared[-1], at + gram + reach - shared[0]))
    return out


def shared_amounts(docs: DataFrame, key: str, text: str = "text", span: int = 120, gram: int = 64, pair_docs: int = 64) -> DataFrame:
    """(doc, spans, shared): how many characters of a document lie in spans of `span` or more that another document has, and in how many pieces.

    Documents that share nothing have no row. Every shared character lies in a window of `span` characters that has an
    anchor, so the windows around the anchors cover just what is shared. No pairs are made: the occurrences of an anchor,
    which at most `pair_docs` documents have, are read in turn and their windows looked up; of the spans around other
    anchors those count that two documents have, by an aggregate with map-side combining. A span repeated within one
    document only isn't shared; a repeated row is one document.
    """
    found = _found(docs, key, text, span, gram, pair_docs)
    kind = docs.schema[key].dataType.simpleString()

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for f in frames:
            out: list[tuple] = []
            for h, *row in f.itertuples(index=False):
                if h != now:
                    out += shared_stretches(held, gram, span - gram)
                    now, held = h, []
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["doc", "start", "end"])
        yield pd.DataFrame(shared_stretches(held, gram, span - gram), columns=["doc", "start", "end"])

    near = found.where("before IS NOT NULL").select("h", "doc", "at", "before", "after").repartition("h").sortWithinPartitions("h")
    hot = found.where("before IS NULL").select("h", "w", "doc", "at")
    common = hot.groupBy("h", "w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("h", "w")
    pieces = near.mapInPandas(stretches, f"doc {kind}, start int, end int").unionAll(hot.join(common, ["h", "w"], "left_semi").select("doc", F.col("at").alias("start"), F.expr(f"at + {span}").alias("end")))
    longest = pieces.groupBy("doc", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy("doc").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    fresh = longest.withColumn("before", before).withColumn("new", F.col("before").isNull() | (F.col("start") > F.col("before")))
    gained = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("before", "start")), F.lit(0))
    return fresh.groupBy("doc").agg(F.count_if("new").alias("spans"), F.sum(gained).alias("shared"))
