"""Readings of the characters place names are made of, and romanisation of kana."""

from __future__ import annotations

import functools

# How place names are read. First and last characters of municipalities and surnames.
STEMS = dict(
    pair.split("=")
    for pair in (
        "南=minami 八=ya 千=sen 柚=yuzu 金=kane 石=ishi 椿=tsubaki 春=haru 広=hiro 夕=yuu 高=taka 星=hoshi 藤=fuji 北=kita 花=hana 桜=sakura 青=ao 深=fuka "
        "東=higashi 梅=ume 風=kaze 光=hikari 雲=kumo 白=shiro 砂=suna 長=naga 小=ko 鳩=hato 丸=maru 虹=niji 竹=take 鶴=tsuru 萩=hagi 大=oo 銀=gin 樫=kashi "
        "百=momo 西=nishi 秋=aki 鹿=shika 亀=kame 朝=asa 雪=yuki 水=mizu 松=matsu 月=tsuki 霧=kiri 若=waka"
    ).split()
)
ENDS = dict(
    pair.split("=")
    for pair in (
        "園=zono 谷=tani 森=mori 塚=zuka 津=tsu 泉=izumi 池=ike 門=kado 畑=hata 江=e 浜=hama 田=ta 井=i 本=moto 崎=saki 丘=kyuu 山=yama 木=ki 口=guchi 尾=o "
        "葉=ba 根=ne 越=goshi 橋=hashi 道=michi 原=hara 林=bayashi 瀬=se 野=no 川=kawa 里=sato 台=dai 岡=oka 宮=miya 戸=do 町=machi 沢=sawa 浦=ura 滝=taki "
        "峰=mine 見=mi 倉=kura 坂=zaka 島=shima"
    ).split()
)
TOWNS = dict(
    pair.split("=")
    for pair in (
        "若宮=wakamiya 雁=kari 曙=akebono 塩=shio 鳥居=torii 蛍=hotaru 栄=sakae 鷺=sagi 旭=asahi 錦=nishiki 本郷=hongo 麻=asao 桐=kiri 日の出=hinode 岩=iwa "
        "常盤=tokiwa 弥生=yayoi 蓮=hasu 千歳=chitose 紺屋=konya 港=minato 緑=midori 清水=shimizu 鍛冶=kajiya 寺=tera 八幡=hachiman 楠=kusunoki 美咲=misaki "
        "天神=tenjin 菊=kiku 船=funa 双葉=futaba 稲荷=inari 希望=kibou 琴平=kotohira 柳=yanagi 立花=tachibana 燕=tsubame 御所=gosho 梶=kaji"
    ).split()
)
TOWN_ENDS = dict(
    pair.split("=")
    for pair in (
        "園=en 台=dai 西=nishi のうち=nouchi の内=nouchi 野=no 谷=ya 中央=chuo 河岸=gashi 浜=hama 東=higashi 坂下=sakashita が岡=gaoka 島=jima 前=mae 元町=motomachi 北=kita "
        "南=minami が原=gahara 橋=bashi 山手=yamate 町=cho 新田=shinden 通=dori 沼=numa"
    ).split()
)
# The prefectures.
PREFECTURES = dict(
    pair.split("=")
    for pair in (
        "北海道=hokkaido 青森県=aomori 岩手県=iwate 宮城県=miyagi 秋田県=akita 山形県=yamagata 福島県=fukushima 茨城県=ibaraki 栃木県=tochigi 群馬県=gunma 埼玉県=saitama "
        "千葉県=chiba 東京都=tokyo 神奈川県=kanagawa 新潟県=niigata 富山県=toyama 石川県=ishikawa 福井県=fukui 山梨県=yamanashi 長野県=nagano 岐阜県=gifu 静岡県=shizuoka "
        "愛知県=aichi 三重県=mie 滋賀県=shiga 京都府=kyoto 大阪府=osaka 兵庫県=hyogo 奈良県=nara 和歌山県=wakayama 鳥取県=tottori 島根県=shimane 岡山県=okayama "
        "広島県=hiroshima 山口県=yamaguchi 徳島県=tokushima 香川県=kagawa 愛媛県=ehime 高知県=kochi 福岡県=fukuoka 佐賀県=saga 長崎県=nagasaki 熊本県=kumamoto 大分県=oita "
        "宮崎県=miyazaki 鹿児島県=kagoshima 沖縄県=okinawa"
    ).split()
)

# Hepburn romanisation by vowel row; small kana join the one before.
_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾ", "t": "タチツテト", "d": "ダヂヅデド", "n": "ナニヌネノ", "h": "ハヒフヘホ",
    "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "r": "ラリルレロ",
}
_ODD = {"シ": "shi", "ジ": "ji", "チ": "chi", "ヂ": "ji", "ツ": "tsu", "ヅ": "zu", "フ": "fu", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n", "ヴ": "vu"}
_SMALL = {"ャ": "ya", "ュ": "yu", "ョ": "yo", "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o"}


@functools.cache
def _kana() -> dict[str, str]:
    table = {c: head + vowel for head, row in _ROWS.items() for c, vowel in zip(row, "aiueo")}
    return table | _ODD


def romaji(kana: str) -> str:
    """Kana in Latin letters; long marks go, other characters stay."""
    table, out, double = _kana(), [], False
    for c in kana:
        c = chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c
        if c == "ッ":
            double = True
            continue
        if c in "ー・":
            continue
        if c in _SMALL and out:
            last, add = out.pop(), _SMALL[c]
            if add[0] == "y":
                out.append((last[:-1] + add[1:]) if last in ("shi", "chi", "ji") else last[:-1] + add)
            else:
                out.append(last[:-1] + add if last and last[-1] in "aiueo" and last not in ("a", "i", "u", "e", "o") else last + add)
            continue
        sound = table.get(c, _SMALL.get(c, c))
        if double:
            sound, double = sound[:1] + sound, False
        out.append(sound)
    return "".join(out)


def read_place(text: str) -> str:
    """The reading of a municipality or surname of two known characters (or one), '' if it isn't known."""
    if len(text) == 1:
        return STEMS.get(text, "")
    return STEMS[text[0]] + ENDS[text[1:]] if text and text[0] in STEMS and text[1:] in ENDS else ""


def read_town(text: str) -> str:
    """The reading of a town name of a known beginning and ending, '' if it isn't known."""
    for size in (3, 2, 1):
        if text[:size] in TOWNS and len(text) > size and text[size:] in TOWN_ENDS:
            return TOWNS[text[:size]] + TOWN_ENDS[text[size:]]
    return ""


@functools.cache
def place_readings() -> frozenset[str]:
    return frozenset(a + b for a in STEMS.values() for b in ENDS.values())
