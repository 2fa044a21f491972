import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import encode, leak, looks, spans

BPE = encode.Bpe(encode.vocabulary_path(), encode.split_pattern())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_merging(text):
    text = text.encode("utf-8", "ignore").decode()
    want = [i for p in BPE.pieces(text) for i in BPE.merged(p.encode())]
    ids = np.frombuffer(BPE.encode(text), np.int32)
    assert ids.tolist() == want
    assert BPE.decode(ids).decode() == text


def test_encoder_equals_a_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=encode.split_pattern(), mergeable_ranks=BPE.ranks, special_tokens={})
    rng = random.Random(3)
    letters = "ab the's 12 \n\tあいうカーン本日龍é😀ß‍русский<|endoftext|>"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(80)))
        assert np.frombuffer(BPE.encode(text), np.int32).tolist() == other.encode_ordinary(text)


def test_pairs_fit_by_definition():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        assert BPE.pair_fits(a, b) == (BPE.merged(BPE.tokens[a] + BPE.tokens[b]) == [a, b])


def test_encode_frame(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "日本 abc", "z"), (3, "日本 abc", "z"), (4, "あ" * 300_000, None), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = encode.encode(df, "doc_id", max_ids=1000)
    got = sorted(((r["doc_id"] or 0), len(r["ids"])) for r in out.collect())
    assert [g for g in got if g[0] in (1, 2)] == [(1, 0), (2, 0)] and len(got) == 6 and out.schema["ids"].dataType.simpleString() == "array<int>"
    back = {r["doc_id"]: r["text"] for r in encode.decode(out, "doc_id").collect()}
    assert back[3] == "日本 abc" and back[4] == "あ" * 300_000 and back[1] == ""
    assert encode.encode(df.where("false"), "doc_id").count() == 0


# leaks


def brute_leaks(docs, items, width):
    norm = lambda s: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s or "").casefold())
    return {(d, i) for d, t in docs for i, q in items for a in [norm(t)] for b in [norm(q)] if any(b[k : k + width] in a for k in range(len(b) - width + 1))}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcあいう、 1") for _ in range(n))
    items = [(i, text(rng.randrange(0, 40))) for i in range(12)] + [(90, None), (91, ""), (3, text(30))]
    docs = []
    for d in range(60):
        t = text(rng.randrange(0, 60))
        if rng.random() < 0.7:
            q = rng.choice(items)[1] or ""
            k = rng.randrange(len(q) + 1)
            t += q[k : k + rng.randrange(5, 30)].upper().replace("a", "ａ") + text(5)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "x" * 400_000 + (items[5][1] or "")), (5, docs[5][1])]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    want = brute_leaks(docs, items, 12)
    assert want
    for block_chars in (4_000_000, 100):
        got = leak.leaks(a, b, "doc_id", "item_id", width=12, block=4, block_chars=block_chars)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert leak.leaks(a.where("false"), b, "doc_id", "item_id").count() == 0
    assert leak.leaks(a, b.where("false"), "doc_id", "item_id").count() == 0


# spans


def brute_spans(docs, span):
    grams = {}
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            grams.setdefault(t[k : k + span], set()).add(d)
    return {(a, b) for g in grams.values() for a in g for b in g if a < b}


def test_spans_equal_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abあ😀") for _ in range(n))
    shared = [text(60) for _ in range(6)]
    docs = []
    for d in range(80):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            k = rng.randrange(30)
            parts += [s[k : k + rng.randrange(15, 45)], text(rng.randrange(20))]
        docs.append((d, "".join(parts)))
    docs += [(200, None), (201, ""), (202, shared[0] + "y" * 50_000), (3, docs[3][1]), (203, shared[0]), (None, shared[0])]
    df = spark.createDataFrame([(d, t, "clash", d) for d, t in docs], "doc_id bigint, text string, h string, doc bigint")
    want = brute_spans([(d, t) for d, t in docs if d is not None], 24)
    assert want
    for pair_docs in (64, 2):
        got = spans.shared_spans(df, "doc_id", span=24, gram=12, pair_docs=pair_docs)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert spans.shared_spans(df.where("false"), "doc_id").count() == 0
    texts = {d: t for d, t in docs if d is not None and t}
    owners = {}
    for d, t in texts.items():
        for k in range(len(t) - 23):
            owners.setdefault(t[k : k + 24], set()).add(d)
    amounts = {d: len({i for k in range(len(t) - 23) if len(owners[t[k : k + 24]]) > 1 for i in range(k, k + 24)}) for d, t in texts.items()}
    for pair_docs in (64, 2):
        out = spans.shared_amounts(df, "doc_id", span=24, gram=12, pair_docs=pair_docs)
        assert {r["doc"]: r["shared"] for r in out.collect()} == {d: n for d, n in amounts.items() if n}


def test_hot_passage_is_split(spark):
    rng = random.Random(2)
    hot = "".join(rng.choice("abcdefgh") for _ in range(40))
    docs = [(d, "".join(rng.choice("ijklmnop") for _ in range(30)) + hot) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = spans.anchors(df, "doc_id", "text", 24, 12)
    homes = found.groupBy("h").agg(F.min("doc").alias("home"), F.count("*").alias("n"))
    out = spans.occurrences(df, found.join(homes, "h"), "doc_id", "text", 24, 12, shard_docs=7)
    whole = spans.occurrences(df, found.join(homes, "h"), "doc_id", "text", 24, 12)
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.collect())) and out.select("doc").distinct().count() == 40


# looks

SAME = [("ｶﾞﾗｽ", "ガラス"), ("Café", "Café"), ("a​b", "ab"), ("a　b", "a b"), (" a\xa0", "a"), ("⾧本", "長本"), ("Ｎｏ１", "No1"), ("Аuto", "Auto"), ("ル一ム", "ルーム"), ("テ才", "テオ"), ("1－2", "1‐2"), ("Cafе\u0301", "Café"), ("八ﾞ", "バ")]
OTHER = [("a b", "ab"), ("A", "a"), ("a  b", "a b"), ("㈱", "(株)"), ("a", "b")]


def test_one_form():
    for a, b in SAME:
        assert looks.one_form(a) == looks.one_form(b), (a, b)
    for a, b in OTHER:
        assert looks.one_form(a) != looks.one_form(b), (a, b)


def test_look_alikes(spark):
    rows = [
        ("1", "ガラス", "03-1234-5678", "東京都港区芝1-2"), ("2", "ｶﾞﾗｽ", "03－1234－5678", "東京都港区芝1-2"), ("3", "ガラス", "03-1234-", "東京都港区芝 2F"), ("4", None, "０３－１２３４－", "東京都港区芝　2F"),
        ("5", "", "なし", None), ("6", "なし", " なし", "〒100-0001 港区芝"), ("2", "ｶﾞﾗｽ", None, "〒100-0001\xa0港区芝"), (None, "ｶﾞﾗｽ", None, None), ("7", "あ" * 100_000, None, None), ("8", "あ" * 100_000 + "​", None, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, name string, phone string, address string, v string")
    out = looks.look_alikes(df, "id", ["name", "phone", "address"])
    assert sorted(map(tuple, out.collect())) == [("1", "2", "name"), ("1", "2", "phone"), ("2", "3", "name"), ("7", "8", "name")]
    assert looks.look_alikes(df.where("false"), "id", ["name"]).count() == 0
