"""The methods against brute force on whole small tables, and on a vocabulary that nothing was fitted to."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import address, history, leak, looks, names, survivor
from leadloom.llm.pairs import COUNTERS, Rarity
from leadloom.sources.tables import table

SF = "/root/testdata/sf0.01"


# a vocabulary nothing was fitted to

SURNAMES = "佐藤 鈴木 渡辺 伊藤 中村 小林 加藤 吉田 佐々木 斎藤 渋谷 恵比寿 目黒 品川 新宿 池袋 上野 浅草 横浜 川越".split()
WORDS = "サクラ ヤマト ミライ アオゾラ ヒマワリ ツバサ ノゾミ カナデ イブキ ホノカ マコト ユメ キズナ ワカバ スバル".split()
KINDS = "法律事務所 薬局 ベーカリー 幼稚園 動物病院 写真館 書店 農園 酒造 行政書士事務所".split()


def counted(tokens):
    counts = np.zeros(COUNTERS, np.int64)
    for t in tokens:
        counts[t % COUNTERS] += 1
    return counts


# names


def test_candidates_hold_every_like_pair(spark):
    """All typed names against all stored ones, at sf0.01: what the verification would accept is a candidate."""
    c = {n: F.col(n) for n in ("name", "industry", "area", "phone", "address")}
    typed = table(spark, SF, "sheet_row").where("id IS NULL").select("row_no", F.col("会社名").alias("name"), F.col("業種").alias("industry"), F.when(F.col("row_no") % 7 > 0, F.col("エリア")).alias("area"), F.col("電話番号").alias("phone"), F.col("住所").alias("address"))
    rows = names._parsed(table(spark, SF, "companies"), "id", c).withColumn("org", F.xxhash64("place", "core", "trade", "area"))
    orgs, hands = rows.select("org", "place", "core", "trade", "area").distinct(), names._parsed(typed, "row_no", c).withColumnRenamed("row_no", "hand")
    met = {(r["h"]["hand"], r["o"]["org"]) for r in names.candidates(orgs, hands).collect()}
    stored = [(o["org"], names.Name(o["place"], o["core"], o["trade"], ""), o["area"]) for o in orgs.collect()]
    rarity = Rarity(counted(t for _, n, _ in stored for t in names.parts(n)), len(stored))
    want = set()
    for h in hands.collect():
        n = names.Name(h["place"], h["core"], h["trade"], "")
        for org, o, area in stored:
            if (not h["area"] or not area or h["area"] == area) and (n.place or n.core == o.core) and names.likeness(n, o, rarity) >= 0.75:
                want.add((h["hand"], org))
    assert len(want) > 100 and want <= met
    assert len(met) < len(stored) * 4  # and not much else


def test_rare_parts_weigh_more():
    common, rare = names.Name("akiba", "kotefuu", "歯科", ""), names.Name("kitaoka", "kotefuu", "歯科", "")
    stored = [common] * 900 + [rare] * 2 + [names.Name("x", f"w{i}", "歯科", "") for i in range(98)]
    rarity = Rarity(counted(t for n in stored for t in names.parts(n)), len(stored))
    slip = lambda n: n._replace(core="koteruu")
    assert names.likeness(common, common, rarity) == 1.0
    assert 0.7 < names.likeness(slip(common), common, rarity) < names.likeness(slip(rare), rare, rarity) < 1
    assert names.likeness(slip(common), common, rarity, sure=True) > names.likeness(slip(common), common, rarity)
    assert names.likeness(rare, common, rarity) == 0.0


def test_probes_are_the_rarest():
    n = names.Name("akiba", "kotefuukora", "", "")
    all_ = [names.hash64(f"大阪府|akiba|{g}") for g in names.grams(n.core)]
    counts = counted(t for i, t in enumerate(all_) for _ in range(i))
    assert sorted(names.probes(n, ["大阪府"], counts)) == sorted(all_[: names.CHANGED + 1])
    assert names.probes(n._replace(place=""), ["大阪府"], counts) == [names.hash64("大阪府||kotefuukora")]


def test_no_name_is_dropped():
    for text in ("山田太郎法律事務所", "歯科", "株式会社", "佐藤", "?", "渋谷", "(株)", "ABC"):
        assert names.parse(text).core, text
    assert names.parse("").core == names.parse(None).core == names.parse(" 　").core == ""
    assert names.parse("株式会社山田太郎法律事務所") [:3] == names.parse("山田太郎法律事務所")[:3]


def test_parts_run_together():
    want = {
        "医療法人DCNishinoUokisa": ("nishino", "uokisa", "歯科"), "MinamimiyaSUNEYATA歯科医院": ("minamimiya", "suneyata", "歯科"), "りほはしきたぞの歯科クリニック": ("kitazono", "rihohashi", "歯科"),
        "梅台八口ノネへアサ口ン一般社団法人": ("umedai", "haronone", "美容室"), "合同会社Tsukitani建設アロ": ("tsukitani", "aro", "工務店"), "梅門才二八工 珈琲店": ("umekado", "onihae", "カフェ"),
        "FujihashiKITOHAI有限会社": ("fujihashi", "kitohai", ""), "えさせね ヘアサロン": ("", "esasene", "美容室"),
    }
    assert {t: names.parse(t)[:3] for t in want} == want


def test_a_phone_of_many_organisations(spark):
    """A place-holder's number that very many have: met through the names."""
    cols = "name string, industry string, area string, phone string, address string"
    word = lambda i: "".join("アカサタナハマヤラワ"[int(x)] for x in f"{i:04d}")
    stored = [(str(i), f"秋葉{word(i)}歯科", "歯科", "大阪府", "0312345678", "") for i in range(200)]
    typed = [(1, f"{word(7)}歯科", "", "大阪府", "03-1234-5678", ""), (2, "ミミミミ歯科", "", "大阪府", "03-1234-5678", "")]
    c = {n: F.col(n) for n in ("name", "industry", "area", "phone", "address")}
    got = names.same_organisations(spark.createDataFrame(stored, f"id string, {cols}"), spark.createDataFrame(typed, f"row_no bigint, {cols}"), "id", "row_no", c, c)
    assert [tuple(r) for r in got.collect()] == [("7", 1)]


# addresses


def test_places_equal_all_pairs(spark):
    """All typed addresses against all stored ones, at sf0.01."""
    a = table(spark, SF, "companies").select("id", "address")
    b = table(spark, SF, "sheet_row").where("id IS NULL").select("row_no", F.col("住所").alias("text"))
    got = {tuple(r) for r in address.same_places(a, b, "id", "row_no", "address", "text").collect()}
    left = [(r["id"], address.parse(r["address"])) for r in a.collect()]
    right = [(r["row_no"], address.parse(r["text"])) for r in b.collect()]
    distinct = {p for _, p in left if p.lot}
    rarity = Rarity(counted(t for p in distinct for t in [*address.tokens(p), *(address.part(k, v) for k, v in address.parts(p).items())]), len(distinct))
    want = {(i, n) for i, p in left if p.lot for n, q in right if p.lot == q.lot and address.same_place(p, q, rarity)}
    assert want == got and len(got) > 100


def test_missing_parts(spark):
    a = [("1", "東京都渋谷区恵比寿1-2-3"), ("2", "千葉県白森市紺屋野110-9"), ("3", "大阪府梅根市紺屋野110-9"), ("4", "大阪府梅根市緑中央8-38-22-5-6"), ("5", "青森県青市")]
    b = [(1, "恵比寿1-2-3"), (2, "渋谷区1-2-3"), (3, "紺屋野110-9"), (4, "白森市紺屋野110-9"), (5, "梅根市緑中央8-38-22-5-7"), (6, "梅根市緑中央8丁目38-22-5-6"), (7, "1-2-3"), (8, "千葉県紺屋野110-9"), (9, "恵比寿1-2-3サンビル")]
    got = address.same_places(spark.createDataFrame(a, "id string, address string"), spark.createDataFrame(b, "row_no bigint, t string"), "id", "row_no", "address", "t")
    found = {n: {i for i, m in map(tuple, got.collect()) if m == n} for n in range(1, 10)}
    # 3 lies in two towns of that name; 8 has the prefecture to tell them apart
    assert found == {1: {"1"}, 2: {"1"}, 3: set(), 4: {"2"}, 5: set(), 6: {"4"}, 7: set(), 8: {"2"}, 9: {"1"}}


def test_common_tokens_prove_little():
    p = address.parse("大阪府梅根市紺屋野1-1")
    others = [address.Place("大阪府", "梅根市", f"町{i}", "1-1", p.city_read, f"町{i}") for i in range(5000)]
    rarity = Rarity(counted(t for q in [p, *others] for t in [*address.tokens(q), *(address.part(k, v) for k, v in address.parts(q).items())]), 5001)
    assert address.prefix(p, rarity, 0.3) == [address.tokens(p)[1]]  # the municipality's 1-1 is everywhere
    assert len(address.prefix(p, Rarity(np.ones(COUNTERS, np.int64), 5001), 0.3)) == 2
    assert address.containment(p, p, rarity) == 1.0 and address.containment(p, address.NOWHERE, rarity) == 0.0


# looks

PAIRS = [
    ("ɡ", "g"), ("ԝ", "w"), ("Օ", "O"), ("〇", "○"), ("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("х", "x"), ("у", "y"), ("і", "i"), ("ј", "j"), ("ѕ", "s"), ("һ", "h"), ("А", "A"), ("В", "B"), ("Е", "E"),
    ("К", "K"), ("М", "M"), ("Н", "H"), ("О", "O"), ("Р", "P"), ("С", "C"), ("Т", "T"), ("Х", "X"), ("Α", "A"), ("Β", "B"), ("Ε", "E"), ("Ζ", "Z"), ("Η", "H"), ("Ι", "I"), ("Κ", "K"), ("Μ", "M"), ("Ν", "N"), ("Ο", "O"),
    ("Ρ", "P"), ("Τ", "T"), ("Υ", "Y"), ("Χ", "X"), ("ο", "o"), ("ν", "v"), ("ո", "n"), ("օ", "o"), ("ց", "g"), ("Ѕ", "S"), ("Ј", "J"), ("ı", "i"), ("ɑ", "a"), ("ƍ", "g"), ("ӏ", "i"), ("ᴏ", "o"), ("ᴡ", "w"), ("ꓳ", "O"),
    ("Ａ", "A"), ("ｚ", "z"), ("１", "1"), ("ｶ", "カ"), ("ｶﾞ", "ガ"), ("が", "が"), ("é", "é"), ("ニ", "二"), ("エ", "工"), ("カ", "力"), ("タ", "夕"), ("ト", "卜"), ("ロ", "口"), ("ハ", "八"), ("へ", "ヘ"), ("オ", "才"),
    ("ー", "一"), ("－", "-"), ("–", "-"), ("—", "―"), ("‑", "-"), ("a​b", "ab"), ("a﻿b", "ab"), ("a⁠b", "ab"), ("a b", "a b"), ("a　b", "a b"), (" a", "a "), ("⽇", "日"), ("㈠", "㈠"), ("ノ", "丿"),
]
APART = [("l", "I"), ("l", "1"), ("O", "0"), ("I", "1"), ("a", "A"), ("土", "士"), ("未", "末"), ("a b", "ab"), ("人", "入"), ("シ", "ツ"), ("ソ", "ン"), ("rn", "m"), ("a.b", "a,b"), ("大", "太"), ("あ", "お")]


def test_look_alike_pairs(spark):
    alike = looks.confusables(spark)
    form = lambda x: looks.one_form(x, alike)
    assert [p for p in PAIRS if form(p[0]) != form(p[1])] == []
    assert [p for p in APART if form(p[0]) == form(p[1])] == []
    assert len(alike) < 5000 and all(len(v) == 1 for v in alike.values())


# consensus


def test_large_groups_are_treated_like_small_ones(spark):
    rng = random.Random(3)
    word = "株式会社秋葉コテフウ美容室大阪店"
    slip = lambda: "".join(rng.choice("あいう") if rng.random() < 0.08 else c for c in word)
    values = [slip() for _ in range(400)] + [word]
    df = spark.createDataFrame([("g", str(i), v) for i, v in enumerate(values)], "g string, id string, v string")
    for parts in (1, 8, 64):
        assert [r["value"] for r in survivor.consensus(df, "g", "id", "v", parts=parts).collect()] == [word]


def misspelt(rng, text):
    """One token of a text changed, left out, doubled, or added at either end."""
    tokens = survivor.tokens_of(text)
    i = rng.randrange(len(tokens))
    way = rng.randrange(4)
    if way == 0:
        tokens[i] = rng.choice(["サロン", "田", "x", "2"])
    elif way == 1:
        del tokens[i]
    elif way == 2:
        tokens.insert(i, tokens[i])
    else:
        tokens.insert(rng.choice([0, len(tokens)]), rng.choice(["本店", "(有)", " ", "様"]))
    return "".join(tokens)


def test_consensus_of_planted_groups(spark):
    """Groups with a known best spelling: once as it is, the other rows misspelt each in a way of its own; and by recency."""
    rng = random.Random(31)
    truth, rows = {}, []
    for g in range(300):
        best = f"{rng.choice(['株式会社', '', '合同会社'])}{rng.choice(SURNAMES)}{rng.choice(WORDS)}{rng.choice(WORDS)}{rng.choice(KINDS)}"
        truth[f"{g:03d}-0"] = best
        values = [best, *(misspelt(rng, best) for _ in range(rng.randint(2, 6)))]
        rows += [(f"g{g}", f"{g:03d}-{i}", v, rng.randint(0, 3)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, id string, v string, age int")
    got = {r["keep_id"]: r["value"] for r in survivor.consensus(df, "g", "id", "v").collect()}
    right = sum(got[k] == v for k, v in truth.items())
    print("consensus of planted groups:", right, "of", len(truth))
    assert right > 0.9 * len(truth)
    newest = spark.createDataFrame([("g", "1", "03-1111-2222", 0), ("g", "2", "03-1111-2222", 0), ("g", "3", "03-3333-4444", 1)], "g string, id string, v string, t int")
    pick = lambda w: survivor.consensus(newest, "g", "id", "v", w).first()["value"]
    assert pick(None) == "03-1111-2222" and pick(F.pow(F.lit(4.0), F.col("t"))) == "03-3333-4444"


# history


def test_an_index_of_many_buckets(spark, tmp_path, monkeypatch):
    """Buckets by token and compaction change nothing."""
    monkeypatch.setattr(history.Index, "BUCKET_ROWS", 3)
    rng = random.Random(8)
    url = lambda p: rng.choice(["", None, *(f"https://{p}{i}.example/x" for i in range(15))])
    schema, kinds = "id string, form_url string, hp_url string, ord bigint", {"form": "form_url", "home": "hp_url"}
    past = spark.createDataFrame([(f"p{i}", url("f"), url("h"), 0) for i in range(12)], schema)
    runs = [spark.createDataFrame([(f"b{k}{i}", url("f"), url("h"), 100 * k + i) for i in range(9)], schema) for k in range(2)]
    want = {tuple(r) for r in history.repeats(past, runs[0].unionAll(runs[1]), "id", kinds, "ord").collect()}
    index = history.Index.create(past, "id", kinds, str(tmp_path / "a"))
    got = {tuple(r) for r in index.admit(runs[0], "id", kinds, "ord", "one").collect()}
    index = index.compacted(str(tmp_path / "b"))
    got |= {tuple(r) for r in index.admit(runs[1], "id", kinds, "ord", "two").collect()}
    assert index.buckets > 1 and got == want and want
    empty = history.Index.create(past.where("false"), "id", kinds, str(tmp_path / "c"))
    assert empty.admit(runs[0].where("false"), "id", kinds, "ord", "one").count() == 0


# leaks


def test_items_in_several_blocks(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(i, text(100)) for i in range(30)] + [(3, text(60)), (40, None), (41, "")]
    docs = [(i, text(50) + items[rng.randrange(31)][1][10 : 10 + rng.choice([39, 40, 55])] + text(50)) for i in range(60)] + [(60, None), (61, "")]
    want = {(d, i) for d, t in docs if t for i, x in items if x and any(x[k : k + 40] in t for k in range(len(x) - 39))}
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for more in ({}, {"block_chars": 500, "held_chars": 1000}):
        assert {tuple(r) for r in leak.leaks(a, b, "doc_id", "item_id", **more).collect()} == want and want
    assert leak.leaks(a, b.where("false"), "doc_id", "item_id").count() == leak.leaks(a.where("false"), b, "doc_id", "item_id").count() == 0


def spellings(rng, place, word, kind):
    """(way, spelling) of one name, none of whose parts is in any list of the package."""
    slip = list(word)
    slip[rng.randrange(1, len(slip))] = rng.choice("ルレロヌムメ")
    return [
        ("alike", f"{place}{word}{kind}"), ("legal form", f"(株){place}{word}{kind}"), ("spaces", f"{place}　{word} {kind}"), ("width", f"{place}{word}{kind}　".replace("サ", "ｻ").replace("ヤ", "ﾔ")),
        ("hiragana", place + "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in word) + kind), ("slip", place + "".join(slip) + kind), ("no kind", place + word),
        ("cut short", place + word[:3] + kind), ("reordered", f"{kind} {place} {word}"), ("no place", word + kind),
    ]


def test_names_of_another_vocabulary(spark):
    """Recall by the way a name is written; the figures are in the README."""
    rng = random.Random(17)
    orgs = list({(rng.choice(SURNAMES), rng.choice(WORDS) + rng.choice(WORDS), rng.choice(KINDS)) for _ in range(300)})
    cols = "name string, industry string, area string, phone string, address string"
    stored = [(str(i), f"株式会社{p}{w}{k}", "", "東京都", "", "") for i, (p, w, k) in enumerate(orgs)]
    typed = [(i * 10 + j, text, "", "東京都", "", "") for i, o in enumerate(orgs) for j, (_, text) in enumerate(spellings(rng, *o))]
    ways = [w for w, _ in spellings(rng, *orgs[0])]
    c = {n: F.col(n) for n in ("name", "industry", "area", "phone", "address")}
    got = {tuple(r) for r in names.same_organisations(spark.createDataFrame(stored, f"id string, {cols}"), spark.createDataFrame(typed, f"row_no bigint, {cols}"), "id", "row_no", c, c).collect()}
    hits = Counter(ways[n % 10] for i, n in got if int(i) == n // 10)
    wrong = sum(int(i) != n // 10 for i, n in got)
    print("names of another vocabulary:", {w: round(hits[w] / len(orgs), 2) for w in ways}, "wrong", wrong, "of", len(got))
    for way in ("alike", "legal form", "spaces", "width"):
        assert hits[way] > 0.95 * len(orgs), way
    assert wrong < 0.03 * len(got)


def test_addresses_of_another_vocabulary(spark):
    """Recall by the way an address is written; the figures are in the README."""
    rng = random.Random(23)
    cities = "横浜市西区 渋谷区 四日市市 川越市 さいたま市浦和区 八王子市 町田市 武蔵村山市 廿日市市 糸魚川市".split()
    towns = "恵比寿 諏訪町 高島 みなとみらい 元住吉 四谷 百合丘 緑が丘 大字古谷上 三番町".split()
    places = list({("東京都", rng.choice(cities), rng.choice(towns), (rng.randint(1, 9), rng.randint(1, 40), rng.randint(1, 60))) for _ in range(300)})
    kanji = lambda n: ("" if n < 10 else ("" if n < 20 else "一二三四五六七八九"[n // 10 - 1]) + "十") + ("一二三四五六七八九"[n % 10 - 1] if n % 10 else "")
    ways = {
        "alike": lambda p, c, t, n: f"{p}{c}{t}{n[0]}-{n[1]}-{n[2]}", "units": lambda p, c, t, n: f"{p}{c}{t}{n[0]}丁目{n[1]}番{n[2]}号", "no prefecture": lambda p, c, t, n: f"{c}{t}{n[0]}-{n[1]}-{n[2]}",
        "kanji numbers": lambda p, c, t, n: f"{p}{c}{t}{kanji(n[0])}丁目{kanji(n[1])}番{kanji(n[2])}号", "building": lambda p, c, t, n: f"〒150-0001 {p}{c}{t}{n[0]}-{n[1]}-{n[2]} サンビル3F", "spaces": lambda p, c, t, n: f"{p} {c} {t} {n[0]}-{n[1]}-{n[2]}",
    }
    stored = [(str(i), f"{p}{c}{t}{n[0]}-{n[1]}-{n[2]}") for i, (p, c, t, n) in enumerate(places)]
    typed = [(i * 10 + j, f(*x)) for i, x in enumerate(places) for j, f in enumerate(ways.values())]
    got = {tuple(r) for r in address.same_places(spark.createDataFrame(stored, "id string, a string"), spark.createDataFrame(typed, "row_no bigint, t string"), "id", "row_no", "a", "t").collect()}
    hits = Counter(list(ways)[n % 10] for i, n in got if int(i) == n // 10)
    wrong = sum(int(i) != n // 10 for i, n in got)
    print("addresses of another vocabulary:", {w: round(hits[w] / len(places), 2) for w in ways}, "wrong", wrong, "of", len(got))
    for way in ("alike", "units", "no prefecture", "spaces"):
        assert hits[way] > 0.95 * len(places), way
    assert wrong < 0.02 * len(got)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("1", None)], [("1", "")]])
def test_places_of_nothing(spark, rows):
    a = spark.createDataFrame(rows, "id string, address string")
    b = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "row_no bigint, address string")
    assert address.same_places(a, b, "id", "row_no", "address", "address").count() == 0
