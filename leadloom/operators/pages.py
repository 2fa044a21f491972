"""Fetched pages: their links with places, forms, structured data; link scores; checks of form pages; the choice of a form.

One Arrow pass reads a page into plain facts (`page_facts`); all that follows is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions import contact, lists, urls
from leadloom.functions.text import let, or_else
from leadloom.sources.tables import cut

_GO = re.compile(r"""(?:window\.)?location(?:\.href)?\s*=\s*["']([^"']+)""")
_LINK = "struct<pos:int,kind:string,url:string,text:string,in_footer:boolean,in_nav:boolean>"
_FACTS = f"links array<{_LINK}>, embeds array<struct<kind:string,url:string>>, forms array<string>, ld_email string, ld_phone string, ld_address string, base string"


class _Reader(HTMLParser):
    """Collects what later steps ask for, in one pass over the tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.embeds: list[dict] = []
        self.starts: list[int] = []
        self.blocks: list[str] = []
        self.open: dict | None = None
        self.inside = {"footer": 0, "nav": 0}
        self.ld: list[str] | None = None
        self.base = self.canonical = ""
        self.lines = [0]

    def read(self, html: str) -> None:
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in self.inside:
            self.inside[tag] += 1
        elif tag == "a":
            self.finish()
            href = next((h for h in (a.get("href", ""), a.get("data-href", ""), a.get("data-url", ""), a.get("data-link", "")) if h and not h.startswith("#")), "")
            href = href or ((m := _GO.search(a.get("onclick", ""))) and m[1]) or ""
            self.open = {"kind": "a", "href": href.strip(), "texts": [], "notes": [x for x in (a.get("aria-label"), a.get("title")) if x]}
        elif tag in ("button", "div", "span", "li") and (m := _GO.search(a.get("onclick", ""))):
            self.finish()
            self.open = {"kind": "onclick", "href": m[1].strip(), "texts": [], "notes": []}
        elif tag == "img" and self.open and a.get("alt"):
            self.open["notes"].append(a["alt"])
        elif tag == "base" and a.get("href") and not self.base:
            self.base = a["href"]
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and a.get("href") and not self.canonical:
            self.canonical = a["href"]
        elif tag == "form":
            line, col = self.getpos()
            self.starts.append(self.lines[line - 1] + col)
            if a.get("action"):
                self.embeds.append({"kind": "action", "url": a["action"]})
        elif tag in ("iframe", "script") and a.get("src"):
            self.embeds.append({"kind": tag, "url": a["src"]})
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.ld = []

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside[tag] = max(0, self.inside[tag] - 1)
        elif self.open and (tag == "a" and self.open["kind"] == "a" or self.open["kind"] == "onclick" and tag in ("button", "div", "span", "li")):
            self.finish()
        elif tag == "script" and self.ld is not None:
            self.blocks.append("".join(self.ld))
            self.ld = None

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        elif self.open:
            self.open["texts"].append(data)

    def finish(self):
        if self.open and self.open["href"] and not re.match(r"(?i)javascript|tel:|mailto:", self.open["href"]):
            text = re.sub(r"\s+", " ", " ".join(["".join(self.open["texts"]), *self.open["notes"]])).strip()
            self.links.append({"pos": len(self.links), "kind": self.open["kind"], "url": self.open["href"], "text": text, "in_footer": self.inside["footer"] > 0, "in_nav": self.inside["nav"] > 0})
        self.open = None


def resolve(base: str, link: str) -> str:
    """The absolute address of a link without fragment, its scheme in lower case, '' if it can't be one. [UR-07]"""
    try:
        return urlunsplit(urlsplit(urldefrag(urljoin(base, link.strip())).url))
    except ValueError:
        return ""


def origin(url: str) -> tuple[str, str]:
    """Scheme and authority of an address, '' where it can't be read. [UR-08]"""
    try:
        return urlsplit(url)[:2]
    except ValueError:
        return "", ""


def _structured(blocks: list[str]) -> dict[str, str]:
    """The first e-mail, phone and address of the page's JSON-LD; a malformed block is passed over. [CX-07]"""
    out = {"ld_email": "", "ld_phone": "", "ld_address": ""}

    def take(name: str, value) -> None:
        if not out[name] and isinstance(value, str):
            out[name] = value

    for block in blocks:
        try:
            found = json.loads(block)
        except ValueError:
            continue
        for entry in found if isinstance(found, list) else [found]:
            if not isinstance(entry, dict):
                continue
            take("ld_email", entry.get("email"))
            take("ld_phone", entry.get("telephone"))
            place = entry.get("address")
            if isinstance(place, dict):
                code = str(place.get("postalCode") or "").removeprefix("〒")
                parts = ["〒" + code if code else "", *(str(place.get(k) or "") for k in ("addressRegion", "addressLocality", "streetAddress"))]
                place = " ".join(p for p in parts if p)
            take("ld_address", place)
            points = entry.get("contactPoint") or []
            for point in points if isinstance(points, list) else [points]:
                if isinstance(point, dict):
                    take("ld_email", point.get("email"))
                    take("ld_phone", point.get("telephone"))
    return out


def read_page(html: str | None, url: str | None, before: int = 800, after: int = 5000) -> dict:
    """The facts of one page. Null or empty HTML has none."""
    html, url = html or "", url or ""
    reader = _Reader()
    try:
        reader.read(html)
        reader.finish()
    except (AssertionError, ValueError):  # the parser gives up on some broken declarations; what was read stays
        pass
    base = resolve(url, reader.canonical) if reader.canonical else url
    base = base if base and origin(base) == origin(url) else url  # another origin's canonical address is a mirror's
    base = resolve(base, reader.base) or base if reader.base else base
    for x in (*reader.links, *reader.embeds):
        x["url"] = resolve(base, x["url"])
    forms = [html[max(0, at - before) : at + after] for at in reader.starts]
    return {"links": [x for x in reader.links if x["url"]], "embeds": [x for x in reader.embeds if x["url"]], "forms": forms, **_structured(reader.blocks), "base": base}


def page_facts(pages: DataFrame, key: str, url: str = "url", html: str = "html", keep_html: bool = True) -> DataFrame:
    """(key, url, html and the facts of each page); keep_html: whether the text comes out again. [TX-08..10, UR-07, UR-08, CX-07]

    `base` is what relative links start from: the address, or a canonical one of the same origin, and what a base tag makes of it.
    """
    kind = pages.schema[key].dataType.simpleString()
    names = [p.split(" ")[0] for p in ("links", "embeds", "forms", "ld_email", "ld_phone", "ld_address", "base")]
    types = [
        pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("url", pa.string()), ("text", pa.string()), ("in_footer", pa.bool_()), ("in_nav", pa.bool_())])),
        pa.list_(pa.struct([("kind", pa.string()), ("url", pa.string())])), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(),
    ]
    kept = ["url", "html"] if keep_html else ["url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = [read_page(h, u) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch([*b.columns[: 1 + len(kept)], *(pa.array([f[n] for f in facts], t) for n, t in zip(names, types))], names=[key, *kept, *names])

    return pages.select(key, F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, f"`{key}` {kind}, " + "".join(f"{c} string, " for c in kept) + _FACTS)


_LD_BLOCK = re.compile(r"""<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script""", re.I | re.S)


def structured_facts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(the columns, ld_email, ld_phone, ld_address): what the JSON-LD of each page says, for those who need no other facts. [CX-07]"""
    names = ["ld_email", "ld_phone", "ld_address"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(html)).to_pylist()
            found = [_structured(_LD_BLOCK.findall(t)) if t and "ld+json" in t.lower() else {} for t in texts]
            yield pa.record_batch([*b.columns, *(pa.array([f.get(n, "") for f in found], pa.string()) for n in names)], names=[*b.schema.names, *names])

    return pages.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", " + ", ".join(f"{n} string" for n in names))


def contacts(facts: DataFrame, key: str, *also: str) -> DataFrame:
    """(key, email, phone, address and the columns `also`) of each page: JSON-LD, then microdata (not for e-mail), then the text. [CX-01, CX-03, CX-06]"""
    h = F.col("html")
    email, address = or_else(F.col("ld_email"), contact.email(h)), or_else(F.col("ld_address"), or_else(contact.item_address(h), contact.postal_address(h)))
    return facts.select(key, email.alias("email"), contact.page_phone(h, F.col("ld_phone")).alias("phone"), address.alias("address"), *also)


def link_rows(facts: DataFrame, key: str) -> DataFrame:
    """One row per link of each page, with its host. [FL-19]"""
    rows = facts.select(key, F.col("base").alias("page_url"), F.explode("links").alias("l")).select(key, "page_url", "l.*")
    return rows.withColumn("host", urls.host_key(F.col("url"))).where("host <> ''")


def scored_links(links: DataFrame) -> DataFrame:
    """The links that may lead to a form, with their score of 8 or more. [CL-01, CL-02, FL-19..22, UR-09, UR-10, UR-13]"""
    add = lambda c, n: F.when(c, n).otherwise(0)

    def judged(x: Column) -> Column:
        """The score of a link that may be taken, null of another. x: what its tests share, computed once."""
        text, url, host, internal = x["text"], x["url"], x["host"], x["internal"]
        strong, usual = x["strong"], x["usual"]
        path = url.rlike(lists.CONTACT_PATH)
        booking = urls.holds_any(text, lists.BOOKING_WORDS) | urls.holds_any(url, lists.BOOKING_WORDS)
        inquiry = strong | urls.holds_any(text, lists.USUAL_WORDS[:10])
        word = F.when(strong, 12).when(usual, 10).when(urls.holds_any(text, lists.LOOSE_WORDS), 6).otherwise(0)
        score = (
            word
            + add(path | url.rlike(lists.CONTACT_CODED), 8)
            + add(urls.holds_any(x["reads"], lists.JAPANESE_PATH_WORDS), 8)
            + add(urls.holds_any(url, lists.JAPANESE_PATH_WORDS[:4]), 8)
            + add(url.rlike(r"/cgi(-bin)?/.*form"), 12)
            + add(url.rlike(r"/(mailform|form[_-]?mail|contact[_-]?form|inquiry|toiawase)\.(?:cgi|pl|php|aspx?)(?:\?|$)"), 10)
            + add(~internal, 15)
            + add(internal & urls.contact_subdomain(url), 8)
            + add(F.col("in_footer"), 4)
            + add(F.col("in_nav"), 2)
        ).cast("int")
        reachable = internal | urls.holds_host(host, lists.FORM_HOSTS)
        wanted = ~(urls.holds_host(host, lists.BOOKING_HOSTS) | (booking & ~inquiry)) & ~url.rlike(lists.OTHER_PATH) & ~url.rlike(lists.DONE_PATH)
        linked = let(score, lambda n: F.when((n >= 8) & ~urls.on_hosts(host, lists.REJECTED_HOSTS) & wanted, n))
        return F.when(reachable, F.when(F.col("kind") == "onclick", F.when(path | strong | usual, 10)).otherwise(linked))

    text, url = F.lower("text"), F.lower("url")
    shared = F.struct(
        text.alias("text"), url.alias("url"), F.col("host").alias("host"), urls.is_internal(F.col("url"), F.col("page_url")).alias("internal"), F.coalesce(urls.decoded(url), F.lit("")).alias("reads"),
        urls.holds_any(text, lists.STRONG_WORDS).alias("strong"), urls.holds_any(text, lists.USUAL_WORDS).alias("usual"),
    )
    return links.withColumn("score", let(shared, judged)).where("score IS NOT NULL")


def best_links(scored: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The best links of each page, each target once; equal scores keep the page's order. [CL-03, WN-07, WN-09]"""
    keyed = scored.withColumn("target", urls.link_key(F.col("url")))
    order = (F.desc("score"), F.col("kind"), F.col("pos"))
    once = keyed.withColumn("_n", F.row_number().over(W.partitionBy(key, "target").orderBy(*order))).where("_n = 1")
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select(key, "rank", "url", F.substring("text", 1, 80).alias("text"), "score")


# What the window around a form says about it. A kind with True is refused also beside an inquiry word.
_INQUIRY = r"(?iu)お問い合わせ|ご連絡|ご相談|inquiry|contact"
FORM_KINDS = {
    "purchase": r"(?iu)数量|カート|ショッピング|購入する|ご購入|注文内容|決済|クレジットカード|お支払い方法|配送先住所",
    "application": r"(?iu)志望動機|職種|採用.*フォーム|application form|job application|apply for|応募フォーム|履歴書",
    "comment": r"(?iu)コメント|comment|leave a reply|返信する|reply to",
    "newsletter": r"(?iu)subscribe|newsletter|メルマガ|メールマガジン|登録する|email.*sign.?up|sign.?up.*email|配信登録|お知らせ登録",
    "event": r"(?iu)イベント.*(?:申し込み|参加登録|お申し込み|登録フォーム)|セミナー.*(?:申し込み|参加登録|お申し込み|登録フォーム)|説明会.*(?:申し込み|参加登録)|勉強会.*(?:申し込み|参加登録)|event.*(?:registration|signup|sign.?up|apply)|seminar.*(?:registration|apply)|webinar.*(?:register|registration)",
    "survey": r"(?iu)アンケート|survey|questionnaire|ご意見募集|意見収集",
    "account": r"(?iu)会員登録|新規登録|アカウント作成|ユーザー登録|membership.*(?:register|sign.?up)|create.*account|register.*account|sign.?up.*account",
    "download": r"(?iu)資料ダウンロード|ホワイトペーパー.*ダウンロード|事例集.*ダウンロード|whitepaper.*download|ebook.*download|download.*(?:pdf|resource|guide|report)|無料ダウンロード|カタログ.*ダウンロード",
    "review": r"(?iu)(?:レビュー|口コミ|お客様の声).*(?:投稿|フォーム|を書く|を入力)|(?:review|testimonial).*(?:form|submit|write|leave)|rate.*(?:us|this)|rating.*form",
    "trial": r"(?iu)無料トライアル|free.*trial.*(?:form|sign.?up|start)|trial.*(?:register|signup|start)|(?:start|begin).*free.*trial|お試し登録|体験版.*申し込み",
    "donation": r"(?iu)寄付(?:フォーム|をする|する|のお申し込み|金額|額)|ご寄付(?:のお申し込み|をいただく|をお願い)|donate(?:\s*now)?|donation(?:\s*form)?|fundrais(?:ing|e)|支援金|クラウドファンディング.*(?:支援|寄付)|ご支援をお願い",
    "appointment": r"(?iu)診察予約|診療予約|ご予約フォーム.*(?:受診|来院|初診|外来|クリニック)|初診(?:予約|申し込み)|来院(?:予約|申し込み)|web予約システム|ネット受付|オンライン診療予約",
    "prize": r"(?iu)キャンペーン(?:への)?応募|懸賞(?:に)?応募|プレゼント(?:に)?応募|抽選(?:に)?応募|contest.*entry|sweepstake|campaign.*entry|応募(?:フォーム|する|してください)|当選者",
    "petition": r"(?iu)署名(?:フォーム|活動|運動|を集め|にご協力)|petition|ご署名|署名する|賛同者",
}
_COMMENT_BOX = r"""(?iu)(?:class|id)=["'][^"']*(?:comment[-_]?form|wp-comment|respond|leave[-_]?a[-_]?reply)[^"']*["']"""
_SEATS = r"(?iu)定員(?:に達し|超過|オーバー|まで|[0-9])|残席[^。]{0,20}[0-9]|残り[^。]{0,10}席|満席|キャンセル待ち|お席の確保|席数限定"
_ATTEND = r"(?iu)(?:参加|出席|申込|お申込)(?:フォーム|登録|申し込み|する)|参加者(?:情報|氏名|名前)"
_RESERVE = r"(?iu)予約フォーム|ご予約フォーム|ネット予約|来店予約|席の予約|席予約|テーブル予約|完全予約制|ご予約日時|希望日時|reservation form|booking form|book now|book a (?:table|seat|room|visit|appointment)"
_ASKS = r"(?iu)お問い合わせ|ご連絡|ご相談|お問合|inquiry|contact us|contact form|ご質問|お問い合わせ内容|お問合せ内容|メッセージ内容|ご意見"
_ASKS_SHORT = r"(?iu)お問い合わせ|ご連絡|ご相談|お問合|inquiry|contact us|contact form|ご質問|お問い合わせ内容|ご相談フォーム"

# Fields and buttons of a form, by their attributes.
_USER_INPUT = r"""(?i)<input[^>]+type=["']?(text|email|tel|number|search|url)"""
_PASSWORD = r"""(?i)type=["']?password"""
_NAME_INPUT = r"""(?iu)<input[^>]+(name|id)=["']?(?:name|your[_-]?name|お名前|namae)"""
_MAIL_INPUT, _TEL_INPUT, _TEXT_INPUT, _IMAGE_INPUT = (rf"""(?iu)<input[^>]+type=["']?{t}""" for t in ("email", "tel", "text", "image"))
_MAIL_LIKE_INPUT = r"""(?iu)<input[^>]+(name|id)=["']?(?:e-?mail|mail|メール|your.?mail|your.?email|yourmail)"""
_SUBMIT = r"""(?i)<(input|button)[^>]*type=["']?submit"""
_BUTTON = r"""(?i)<button(?![^>]*type=["']?(?:button|reset)["'])[^>]*>"""


def form_is_inquiry(window: Column) -> Column:
    """Whether the text around a form (800 characters before its tag, 5000 after) shows a form for inquiries. [CL-10]"""
    return let(F.lower(window), _shows_inquiry)


def _holds(text: Column, pattern: str) -> Column:
    """Whether a lower-case text matches a pattern written for any case."""
    return text.rlike(re.sub(r"^\(\?iu?\)", "", pattern))


def _shows_inquiry(window: Column) -> Column:
    asks = _holds(window, _INQUIRY)
    area = F.contains(window, F.lit("textarea"))
    user = area | _holds(window, _USER_INPUT)
    refused = _holds(window, _PASSWORD) | _holds(window, _COMMENT_BOX)
    topical = _holds(window, _SEATS) & _holds(window, _ATTEND)
    for pattern in FORM_KINDS.values():
        topical |= _holds(window, pattern)
    at = F.instr(window, "<form")
    inside = F.when(at > 0, F.substring(window, at, F.length(window))).otherwise(window)
    tight = F.when(at > 1, F.substring(window, F.greatest(at - 200, F.lit(1)), at - F.greatest(at - 200, F.lit(1)))).otherwise("")
    name, mail, tel, text, mail_like, submit = (_holds(window, p) for p in (_NAME_INPUT, _MAIL_INPUT, _TEL_INPUT, _TEXT_INPUT, _MAIL_LIKE_INPUT, _SUBMIT))
    sends = submit | _holds(window, _IMAGE_INPUT) | _holds(window, _BUTTON)
    two_texts = F.size(F.regexp_extract_all(window, F.lit(_TEXT_INPUT), F.lit(0))) >= 2
    message = area & (_holds(inside, _ASKS) | _holds(tight, _ASKS) | (name & mail) | (text & mail & sends) | (sends & two_texts & mail_like) | (sends & tel & name))
    reserves = area & _holds(window, _RESERVE) & ~asks
    bare = (mail | tel) & submit & _holds(inside, _ASKS_SHORT)
    return user & ~refused & (asks | ~topical) & ~reserves & (message | bare)


# Titles and marks of form pages.
_CONTACT_TITLE = (
    r"お問い合わせ(?:フォーム|窓口|ページ)?|ご相談(?:フォーム)?|ご連絡(?:フォーム)?|お問合せ(?:フォーム)?|お問合わせ(?:フォーム)?|メールフォーム|問い合わせフォーム|ご相談・お問い合わせ|お問い合わせ・ご相談|"
    r"お問い合わせ・ご連絡|otoiawase|toiawase|contact|inquiry|contact.?us|contact.?form|inquiry.?form|get.?in.?touch|send.?message"
)
_DONE_TITLE = r"送信完了|ありがとうございます|受け付けました|thank you|submission complete|success"
_OTHER_TITLE = (
    r"ニュース|news|プレスリリース|お知らせ一覧|アクセス|access|採用|recruit|サービス一覧|実績|ブログ|blog|プライバシー|privacy|利用規約|terms|サイトマップ|sitemap|会社概要|ギャラリー|gallery|イベント一覧|"
    r"セミナー一覧|webinar|workshop|会員登録|メンバー登録|資料ダウンロード|ホワイトペーパー|whitepaper|free.*download|無料ダウンロード"
)
_WIDGET = (
    r"(?i)hbspt\.forms\.create\s*\(|window\.intercomSettings\s*=|zE\s*\(\s*['\"]webWidget|Freshdesk\s*\.|tayori(?:\.com)?.*init|kintoneapp.*(?:form|init)|wpcf7.*(?:init|ajaxurl|\.js)|"
    r"contact-form-7['\"/]|elfsight-app.*contact|eapps-form-builder|n-form\.jp/form|webto\.salesforce\.com|app\.zendesk\.com/hc.*contact|crisp\.chat|LiveChatInc|tawk\.to"
)


def has_widget(html: Column) -> Column:
    """Whether scripts put a contact form into the page."""
    return html.rlike(_WIDGET)


def is_form_page(html: Column, forms: Column) -> Column:
    """Whether a page holds a form for inquiries. forms: the windows of all its forms. [CL-09]"""
    h = F.coalesce(html, F.lit(""))
    services = "|".join(x.replace(".", r"\.") for x in lists.FORM_HOSTS if not x.endswith(("lin.ee", "line.me", "adobe.com")) and x != "docs.google.com")
    sure = h.rlike(rf"(?i)docs\.google\.com/forms|{services}") | h.rlike(lists.LINE_ANYWHERE) | has_widget(h)
    sure |= h.rlike(r"""(?i)itemtype=["'][^"']*schema\.org/ContactPage["']""") | h.rlike(r'(?i)"@type"\s*:\s*"ContactPage"')
    title, form = F.lower(H.title(h)), h.rlike(r"(?i)<form[\s>]")
    named = title.rlike(rf"^({_CONTACT_TITLE})(\s*[|｜\-–—/・]|\s*$)") | title.rlike(rf"[|｜\-–—/・\s]\s*({_CONTACT_TITLE})\s*$")
    return F.when(sure, True).when(~form, False).when(named, True).otherwise(F.exists(forms, form_is_inquiry))


def refused_without_form(html: Column) -> Column:
    """Why a page without a form isn't looked at further: 'done', 'other', 'kind' or ''. [CL-09]"""
    title = F.lower(H.title(html))
    return F.when(title.rlike(_DONE_TITLE), "done").when(title.rlike(_OTHER_TITLE), "other").when(H.og_type(html).rlike(r"^(article|news|blog|product|video\.other|music\.song)$"), "kind").otherwise("")


def has_inline_form(html: Column) -> Column:
    """A form with a message field, or with an address field, a button and an inquiry word. [CL-05]"""
    h = F.coalesce(html, F.lit(""))
    fields = h.rlike(r"""(?i)<input[^>]+type=["']?(email|tel)""") & h.rlike(r"""(?i)<(input|button)[^>]*type=["']?submit""") & h.rlike(_INQUIRY)
    return h.rlike(r"(?i)<form[\s>]") & (h.rlike("(?i)textarea") | fields)


def form_url(facts: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """(key, form_url, source): where a page's form is: the best link, the page itself, a form action, a frame, a script's page, a widget. [CL-07]"""

    def embedded(kind: str) -> Column:
        found = F.filter("embeds", lambda e: (e["kind"] == kind) & urls.holds_host(urls.host_key(e["url"]), lists.FORM_HOSTS))
        return F.try_element_at(found, F.lit(1))["url"]

    first = best.where("rank = 1").select(key, F.col("url").alias("link"))
    steps = [
        ("link", F.col("link")), ("inline", F.when(has_inline_form(F.col("html")), F.col("url"))), ("action", embedded("action")), ("iframe", embedded("iframe")),
        ("script", F.when(embedded("script").isNotNull(), F.col("url"))), ("widget", F.when(has_widget(F.coalesce("html", F.lit(""))), F.col("url"))),
    ]
    out = F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("form_url"), F.lit(n).alias("source"))) for n, c in steps))
    return facts.join(first, key, "left").select(key, out.alias("o")).select(key, "o.form_url", "o.source")


def type_hint(form: Column, html: Column) -> Column:
    """What a form is for: chat link, booking host, booking words without an inline form, else inquiry where there is one. [CL-08]"""
    text = F.lower(F.coalesce(html, F.lit("")))
    there = F.coalesce(form, F.lit("")) != ""
    return (
        F.when(there & F.coalesce(form, F.lit("")).rlike(lists.LINE_ANYWHERE), "LINE").when(there & urls.holds_host(urls.host_key(form), lists.BOOKING_HOSTS), "booking")
        .when(urls.holds_any(text, lists.BOOKING_WORDS) & ~has_inline_form(html), "booking").when(there | has_inline_form(html), "inquiry")
    )


def verified_targets(targets: DataFrame, fetched: DataFrame, key: str, base: str = "base_url") -> DataFrame:
    """(key, rank, url, final_url, valid) of candidate addresses, by the pages fetched for them. [CL-11, CL-12, JN-15]

    targets: key, rank, url, base_url, is_shell (the site is rendered by scripts). fetched: url, final_url, status_code,
    html, forms. A form service needs no page; errors, redirects to other services or home, and thank-you pages are refused.
    """
    pages = fetched.select(F.col("url").alias("u"), "final_url", "status_code", F.col("html").alias("page"), F.col("forms").alias("windows"))
    both = targets.join(pages, targets["url"] == F.col("u"), "left").drop("u")
    final = F.coalesce("final_url", "url")
    moved = F.coalesce(F.col("final_url") != F.col("url"), F.lit(False))
    service = urls.on_hosts(urls.host_key(F.col("url")), lists.FORM_HOSTS) | (moved & urls.on_hosts(urls.host_key(final), lists.FORM_HOSTS))
    refused = (F.col("status_code") >= 400) | (moved & urls.on_hosts(urls.host_key(final), lists.REDIRECT_HOSTS)) | (moved & urls.same_page(final, F.col(base)))
    done = F.lower(urls.path(final)).rlike(lists.SENT_PATH)
    size = F.length(H.short_text(F.col("page"), 1000))
    shell = F.col("is_shell") & F.lower("url").rlike(lists.CONTACT_PATH) & (size >= 20) & (size < 800)
    valid = F.when(service, True).when(F.coalesce(refused | done, F.lit(False)) | (F.coalesce("page", F.lit("")) == ""), False).otherwise(is_form_page(F.col("page"), F.col("windows")) | shell)
    return both.select(key, "rank", "url", final.alias("final_url"), F.coalesce(valid, F.lit(False)).alias("valid"))


def first_valid(verified: DataFrame, key: str) -> DataFrame:
    """(key, form_url): the valid candidate of least rank, without tracking parameters. [CL-13, CL-23]"""
    best = verified.where("valid").groupBy(key).agg(F.min_by("final_url", "rank").alias("u"))
    return best.select(key, urls.without_tracking(F.col("u")).alias("form_url"))


#: Ranks of the stages of `found_forms`; links and probes count on from theirs.
_STAGES = {"primary": 0, "fallback": 1, "inline": 100, "probe": 200}


def found_forms(homes: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """(key, form_url, stage): the form of each site, by the stages a crawler goes through. [CL-13, CL-23]

    homes: key, url, final_url, html (null or '' where the page couldn't be fetched). fetched: url, final_url, status_code,
    html of the pages that links and probes lead to; a page that isn't there counts as an error.

    1. 'redirect': the home page was redirected to a booking service. 2. 'line': the link opens a chat. 3. 'primary': the
    best link, or the page's own form, is verified; 4. 'fallback': the other links in order; 5. 'inline': the page's own
    form. 6. 'probe': paths sites often have, in order, until five in a row aren't pages of their own. 7. 'booking': the
    address itself is a booking service's. Each stage sees only the sites that the ones before left; sites without a form
    have no row.
    """
    homes = homes.withColumns({"final_url": F.coalesce("final_url", "url"), "html": F.coalesce("html", F.lit(""))})
    early = booking_redirect(homes.where("html <> ''"), key)
    there = homes.where("html <> ''").join(early.select(key), key, "left_anti")
    facts = cut(page_facts(there, key, "final_url").withColumn("is_shell", H.rendered_by_script(F.col("html"))))
    best = cut(best_links(scored_links(link_rows(facts.select(key, "base", "links"), key)), key))
    forms = form_url(facts, best, key).where("form_url IS NOT NULL").select(key, "form_url")
    line = forms.where(F.col("form_url").rlike(lists.LINE_ANYWHERE)).select(key, "form_url", F.lit("line").alias("stage"))
    at_home = F.col("form_url").isin(F.col("base"), F.col("home"))
    sites = facts.select(key, "base", "is_shell", F.col("url").alias("home"))
    primary = cut(forms.join(line.select(key), key, "left_anti").join(sites, key).withColumn("at_home", at_home))
    # of the home pages only those are checked that may be the form's page themselves
    asked = facts.select(key, "html", "forms", has_inline_form(F.col("html")).alias("inline")).join(primary.select(key, "form_url", "base", "at_home"), key).where("at_home OR inline")
    own = cut(asked.select(key, "form_url", "base", "at_home", "inline", is_form_page(F.col("html"), F.col("forms")).alias("ok"))).where("ok")
    by_itself = own.where("at_home").select(key, F.lit(_STAGES["primary"]).alias("rank"), F.col("form_url").alias("final_url"))
    first = primary.where("NOT at_home").select(key, F.lit(_STAGES["primary"]).alias("rank"), F.col("form_url").alias("url"), F.col("base").alias("base_url"), "is_shell")
    others = best.join(primary.select(key, "form_url", "base", "is_shell"), key).where("url <> form_url").select(key, (F.lit(_STAGES["fallback"]) + F.col("rank")).alias("rank"), "url", F.col("base").alias("base_url"), "is_shell")
    read = page_facts(fetched.withColumn("_page", F.col("url")), "_page").select("url", "html", "forms")
    pages = cut(read.join(fetched.select("url", "final_url", "status_code"), "url"))
    verified = verified_targets(first.unionByName(others), pages, key).where("valid").select(key, "rank", "final_url")
    inline = own.where("inline").select(key, F.lit(_STAGES["inline"]).alias("rank"), F.col("base").alias("final_url"))
    won = verified.unionAll(by_itself).unionAll(inline).groupBy(key).agg(F.min(F.struct("rank", "final_url")).alias("w"))
    stage = F.when(F.col("w.rank") == _STAGES["primary"], "primary").when(F.col("w.rank") < _STAGES["inline"], "fallback").otherwise("inline")
    settled = cut(won.select(key, urls.without_tracking(F.col("w.final_url")).alias("form_url"), stage.alias("stage")).unionAll(line))
    probed = probed_forms(facts.join(settled.select(key), key, "left_anti"), best, pages, key)
    found = cut(settled.unionAll(probed).unionAll(early.select(key, "form_url", F.lit("redirect").alias("stage"))))
    left = there.join(found.select(key), key, "left_anti")
    booking = booking_fallback(left.select(key, "url", F.lit("").alias("form_url")), "url", "form_url").where("by_booking").select(key, "form_url", F.lit("booking").alias("stage"))
    return found.unionAll(booking)


def probed_forms(facts: DataFrame, best: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, form_url, stage): the first probed path of each site that is a form page. [CL-14, CL-15, WN-06, SL-08]"""
    tried = best.groupBy(key).agg(F.array_sort(F.collect_set(urls.tried_path(F.col("url")))).alias("tried"))
    sites = facts.select(key, "base", "is_shell", H.builder(F.col("html")).alias("builder")).join(tried, key, "left").withColumn("tried", F.coalesce("tried", F.array().cast("array<string>")))
    sites = cut(sites.withColumn("kind", F.xxhash64("builder", "tried")))
    # a plan for each kind of site, not for each site
    plan = probe_plan(sites.select("kind", "builder", "tried").dropDuplicates(["kind"]), "kind", "builder", "tried")
    root = F.regexp_extract("base", r"^([^:/?#]+://[^/?#]+)", 1)
    asked = sites.select(key, "kind", "base", "is_shell", root.alias("root")).join(plan, "kind").withColumn("asked", F.concat("root", "path"))
    got = cut(asked.join(pages.select(F.col("url").alias("asked"), "final_url", "status_code", "html", "forms"), "asked", "left").withColumn("final", F.coalesce("final_url", "asked")).drop("final_url", "root", "kind"))
    # the home page is compared with what came back; most probes bring nothing
    empty = F.coalesce("html", F.lit("")) == ""
    back = got.where(~empty).join(facts.select(key, F.col("html").alias("home_html")), key)
    why = soft_404({"url": F.col("base"), "html": F.col("home_html")}, {"url": F.col("final"), "html": F.col("html"), "status_code": F.col("status_code"), "asked": F.col("asked")}, F.col("is_shell"))
    nothing = got.where(empty).withColumn("why", F.when(F.col("status_code") >= 500, "neutral").otherwise("error"))
    reasons = cut(back.withColumn("why", why).drop("home_html").unionByName(nothing))
    judged = before_abort(reasons, key, "ord", F.col("why") != "", counts=F.col("why") != "neutral").where("why = ''")
    shell = F.col("is_shell") & F.lower("path").rlike(lists.CONTACT_PATH) & (F.length(H.short_text(F.col("html"), 1000)) < 800)
    good = judged.where(is_form_page(F.col("html"), F.col("forms")) | shell)
    return good.groupBy(key).agg(F.min_by("final", "ord").alias("u")).select(key, urls.without_tracking(F.col("u")).alias("form_url"), F.lit("probe").alias("stage"))


def near_length(a: Column, b: Column) -> Column:
    """Whether two texts of more than 200 characters differ in length by less than 3 %. [MD-06]"""
    la, lb = F.length(a), F.length(b)
    return F.coalesce((la > 200) & (lb > 200) & (F.abs(la - lb) / F.greatest(la, lb) < 0.03), F.lit(False))


def soft_404(home: dict[str, Column], probe: dict[str, Column], shell: Column) -> Column:
    """Why a probed page isn't one of its own: 'error', 'home', 'host', 'title', 'length', 'short', 'same' or 'text'; '' if it is. [CL-14, MD-06]

    home, probe: url (final), html; probe also status_code and asked (the address probed). A server error is 'neutral'.
    """
    strip = lambda h: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(h, F.lit("")), r"<[^>]+>", ""), r"[\s\x{3000}]+", " "))
    a, b, t = H.title(home["html"]), H.title(probe["html"]), strip(probe["html"])
    empty = F.coalesce(probe["html"], F.lit("")) == ""
    return (
        F.when(F.coalesce(probe["status_code"] >= 500, F.lit(False)), "neutral").when(empty | F.coalesce(probe["status_code"] >= 400, F.lit(False)), "error")
        .when(urls.same_page(probe["url"], home["url"]), "home").when((probe["url"] != probe["asked"]) & urls.on_hosts(urls.host_key(probe["url"]), lists.REDIRECT_HOSTS), "host")
        .when(((a != "") & (F.lower(a) == F.lower(b))) | b.rlike(lists.GONE_TITLE), "title").when(near_length(home["html"], probe["html"]), "length")
        .when(F.length(t) < F.when(shell, 10).otherwise(300), "short").when((F.length(F.substring(strip(home["html"]), 1, 400)) > 100) & (F.substring(t, 1, 400) == F.substring(strip(home["html"]), 1, 400)), "same")
        .when(F.substring(t, 1, 600).rlike(lists.GONE_TEXT), "text").otherwise("")
    )


def before_abort(probes: DataFrame, key: str, order: str, bad: Column, most: int = 5, counts: Column | None = None) -> DataFrame:
    """The probes of each site up to `most` bad ones in a row; `counts` marks those that count (others leave the row as it is). [WN-06, SL-08]"""
    w = W.partitionBy(key).orderBy(order)
    counts = F.lit(True) if counts is None else counts
    marked = probes.withColumn("_bad", (bad & counts).cast("int")).withColumn("_good", (~bad & counts).cast("int"))
    islands = marked.withColumn("_island", F.sum("_good").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inside = W.partitionBy(key, "_island").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = islands.withColumn("_run", F.sum("_bad").over(inside))
    over = runs.withColumn("_over", F.coalesce(F.max((F.col("_run") >= most).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return over.where("_over = 0").drop("_bad", "_good", "_island", "_run", "_over")


def probe_plan(sites: DataFrame, key: str, builder: str, tried: str, most: int = 28) -> DataFrame:
    """(key, ord, path): the paths to probe, without those the site's builder can't have and those tried already. [CL-15, SL-08, UR-15]"""
    shops = F.col(builder).isin("shopify", "stores")
    clean = F.col(builder).isin("jimdo", "wix", "squarespace", "studio")
    rows = sites.select(key, builder, tried, F.posexplode(F.array(*map(F.lit, lists.PROBES))).alias("o", "path"))
    pages_path = F.startswith("path", F.lit("/pages/"))
    plain = F.regexp_replace(F.lower("path"), "/$", "")
    file = F.col("path").rlike(r"(?i)\.(cgi|pl|php|html?|aspx?)(\?|$)|/cgi(-bin)?/")
    skip = ((shops | clean) & file) | ((clean | (F.col(builder) == "wordpress")) & pages_path) | F.array_contains(tried, plain)
    first = F.when(shops & pages_path, 0).otherwise(1)
    kept = rows.where(~F.coalesce(skip, F.lit(False))).withColumn("same", plain).withColumn("first", first)
    once = kept.withColumn("_n", F.row_number().over(W.partitionBy(key, "same").orderBy("first", "o"))).where("_n = 1")
    ranked = once.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("first", "o")).cast("bigint"))
    return ranked.where(F.col("ord") <= most).select(key, "ord", "path")


def booking_fallback(df: DataFrame, url: str, form: str) -> DataFrame:
    """Sites that are a booking service themselves have that address as their form. [CL-16]"""
    hit = (F.coalesce(form, F.lit("")) == "") & urls.on_hosts(urls.host_key(F.col(url)), lists.BOOKING_HOSTS)
    return df.withColumn("by_booking", hit).withColumn(form, F.when(hit, F.col(url)).otherwise(or_else(F.col(form), "")))


def booking_redirect(homes: DataFrame, key: str, url: str = "url", final: str = "final_url") -> DataFrame:
    """(key, form_url, hint) of the home pages that were redirected to a booking or social service: that address, 'booking'.

    This comes before any link is followed; the other sites have no row. [CL-13, early booking redirect]
    """
    moved = F.coalesce(F.col(final), F.lit("")) != F.coalesce(F.col(url), F.lit(""))
    hit = moved & urls.on_hosts(urls.host_key(F.col(final)), lists.REDIRECT_HOSTS)
    return homes.where(F.coalesce(hit, F.lit(False))).select(key, F.col(final).alias("form_url"), F.lit("booking").alias("hint"))


def simple_link_score(text: Column, url: Column, words: list[str]) -> Column:
    """The plain score of a link: 10 per word in its text, 5 per word in its address, 8 for either pattern. [CL-04, FL-23]"""
    a, b = F.lower(text), F.lower(url)
    return 10 * urls.count_of(a, words) + 5 * urls.count_of(b, words) + F.when(b.rlike("contact|inquiry|form|mail|message"), 8).otherwise(0) + F.when(b.rlike("toiawase"), 8).otherwise(0)


def form_elements(html: Column, selectors: dict[str, str]) -> Column:
    """Whether a page has one of the elements, each given as a pattern. [CL-06]"""
    out = F.lit(False)
    for pattern in selectors.values():
        out |= F.coalesce(html, F.lit("")).rlike(pattern)
    return out
