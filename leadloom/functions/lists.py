"""Word lists, hosts and patterns that results depend on."""

# Words of contact links, by how sure they are.
STRONG_WORDS = ["お問い合わせ", "お問合わせ", "お問合せ", "問い合わせフォーム", "ご相談フォーム", "メールフォーム", "お問い合わせフォーム", "お問合せフォーム"]
USUAL_WORDS = [
    "otoiawase", "contact us", "contact form", "inquiry form", "inquiry", "enquiry", "ご相談", "メール送信", "renraku", "goiken", "ご連絡", "無料相談", "資料請求",
    "send message", "write to us", "get in touch", "お申し込み", "ご依頼", "お見積もり", "見積もり依頼", "メールでのお問合",
]
LOOSE_WORDS = ["contact", "feedback", "お問合", "toiawase"]
BOOKING_WORDS = [
    "予約", "ご予約", "reservation", "booking", "ネット予約", "hotpepper", "reserve", "yoyaku", "minimo", "beauty.hotpepper", "ご来店予約", "来店予約", "席の予約",
    "テーブル予約", "席予約", "ご予約はこちら", "ご来店はこちら", "予約フォーム",
]

# Hosts.
REJECTED_HOSTS = [
    "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "tiktok.com", "youtube.com", "pinterest.com", "maps.google.com",
    "google.co.jp", "google.com", "maps.apple.com", "amazon.co.jp", "amazon.com", "rakuten.co.jp", "yahoo.co.jp", "drive.google.com", "dropbox.com", "onedrive.com", "apple.com",
]
BOOKING_HOSTS = [
    "coubic.com", "airreserve.net", "reserva.be", "minimo.io", "tablecheck.com", "ebica.jp", "toreta.in", "hotpepper.jp", "beauty.hotpepper.jp", "select-type.com",
    "icalendar.jp", "reservestock.jp", "reservia.jp", "epark.jp", "eparkeclinic.jp", "reservawith.google.com", "business.google.com", "caresul.jp", "freqy.jp",
    "benri-yoyaku.jp", "chouseisan.com", "jalan.net", "ikyu.com", "hotels.com", "booking.com", "agoda.com", "airbnb.com", "airbnb.jp", "tabelog.com", "gnavi.co.jp",
    "gurunavi.com", "tripadvisor.com", "tripadvisor.jp", "yelp.com", "retty.me", "loco.yahoo.co.jp", "salon-board.jp", "salonconnect.jp", "yoyakucast.com",
    "reserve.relo-system.com", "yoyaku.yahoo.co.jp", "ozmall.co.jp", "venue-search.com", "r.gnavi.co.jp", "calendly.com", "cal.com", "acuityscheduling.com", "doodle.com",
    "tidycal.com", "oncehub.com", "appointlet.com", "bookafy.com", "setmore.com", "10to8.com", "vcita.com", "booksy.com", "squareup.com", "classpass.com", "vagaro.com",
    "b.hpr.jp", "riyou.jp", "stekina.com", "ekiten.jp", "navitime.co.jp", "haisha-yoyaku.jp", "eparkdentist.com", "dentamap.jp", "b-merit.jp", "airrsv.net",
]
FORM_HOSTS = [
    "docs.google.com", "forms.gle", "form.run", "formrun.com", "tayori.com", "form.kintoneapp.com", "kintone.com", "formzu.net", "freeml.net", "formmailer.jp",
    "formstack.com", "typeform.com", "jotform.com", "tally.so", "paperform.co", "wufoo.com", "surveymonkey.com", "cognito-forms.com", "share.hsforms.com",
    "forms.hubspot.com", "share.formsite.com", "app.getresponse.com", "lin.ee", "page.line.me", "accountpage.line.me", "liff.line.me", "mailchimp.com", "zoho.com",
    "forms.office.com", "forms.microsoft.com", "123formbuilder.com", "formassembly.com", "forms.app", "tripetto.app", "mfcontact.com", "mfcontacts.com", "mailform.jp",
    "gmomakeform.com", "formhub.jp", "questant.jp", "sendinblue.com", "brevo.com", "f-formz.com", "ws.formzu.net", "spiral.ne.jp", "spiral-forms.net", "webcas.net",
    "n-form.jp", "secure.n-form.jp", "webto.salesforce.com", "elfsight.com", "plus.form-mailer.jp", "experience.adobe.com",
]
REDIRECT_HOSTS = [
    "coubic.com", "airreserve.net", "reserva.be", "minimo.io", "tablecheck.com", "ebica.jp", "toreta.in", "hotpepper.jp", "beauty.hotpepper.jp", "select-type.com",
    "icalendar.jp", "reservestock.jp", "reservia.jp", "epark.jp", "eparkeclinic.jp", "reservawith.google.com", "business.google.com", "caresul.jp", "freqy.jp",
    "benri-yoyaku.jp", "chouseisan.com", "jalan.net", "ikyu.com", "hotels.com", "booking.com", "agoda.com", "airbnb.com", "airbnb.jp", "tabelog.com", "gnavi.co.jp",
    "gurunavi.com", "tripadvisor.com", "tripadvisor.jp", "yelp.com", "retty.me", "loco.yahoo.co.jp", "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com",
    "tiktok.com", "youtube.com", "pinterest.com", "maps.google.com", "calendly.com", "cal.com", "acuityscheduling.com", "doodle.com", "tidycal.com", "oncehub.com",
    "appointlet.com", "setmore.com", "squareup.com", "classpass.com", "vagaro.com", "b.hpr.jp", "riyou.jp", "stekina.com", "ekiten.jp", "haisha-yoyaku.jp",
    "eparkdentist.com", "dentamap.jp", "b-merit.jp", "airrsv.net",
]
SKIPPED_DOMAINS = [
    "jalan.net", "tabelog.com", "hotpepper.jp", "ekiten.jp", "townpage.ntt.co.jp", "navitime.co.jp", "navitime.jp", "mapion.co.jp", "its-mo.com", "yelp.com", "yelp.co.jp",
    "retty.me", "gurunavi.com", "gnavi.co.jp", "google.com", "google.co.jp", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "wikipedia.org",
    "linkedin.com", "tiktok.com", "recruit.co.jp", "indeed.com", "wantedly.com", "yahoo.co.jp", "rakuten.co.jp", "amazon.co.jp", "beauty.hotpepper.jp", "minimo.io",
    "hairbook.jp", "riyou.jp", "epark.jp", "homemate-research.com", "zehitomo.com", "baseconnect.in",
]
WORKFLOW_SKIPPED = [
    "jalan.net", "tabelog.com", "hotpepper.jp", "ekiten.jp", "townpage.ntt.co.jp", "navitime.co.jp", "navitime.jp", "mapion.co.jp", "its-mo.com", "iphone.jorudan.co.jp",
    "yelp.com", "yelp.co.jp", "retty.me", "gurunavi.com", "gnavi.co.jp", "r.gnavi.co.jp", "google.com", "facebook.com", "instagram.com", "twitter.com", "x.com",
    "youtube.com", "wikipedia.org", "linkedin.com", "tiktok.com", "pinterest.com", "maps.apple.com", "maps.google.com", "recruit.co.jp", "indeed.com", "wantedly.com",
    "yahoo.co.jp", "rakuten.co.jp", "amazon.co.jp", "beauty.hotpepper.jp", "minimo.io", "hairbook.jp", "riyou.jp", "bestsalonreport.jp", "beauty-park.jp", "minimodel.jp",
    "cuts.jp", "hairsalon-map.com", "9483.jp", "styledesigner.net", "kotomise.jp", "repicolle.jp", "hair.socie.jp", "beautysalon.jp-book.store", "beautysalon.potatoo.jp",
    "epark.jp", "homemate-research.com", "iryou.teikyouseido.mhlw.go.jp", "jhdac.org", "kiyose.or.jp", "katusika-e-toko.com", "judo-ch.jp", "body-care.expert",
    "karadarefre.jp", "zehitomo.com", "baseconnect.in", "pathee.com", "hair-land.jp", "seahorsejp.com", "web-zest.co.jp", "people-brand.com", "palanjp.com",
    "beauty.mirai-agent.jp", "aderans.co.jp", "kinujo.jp", "am-shuuemura.jp", "el.e-shops.jp", "modshair.co.jp", "salon.tbmg.jp", "higasiyamatotida.wixsite.com",
]
AGGREGATORS = [
    "hotpepper.jp", "beauty.hotpepper.jp", "minimo.io", "rakuten.co.jp", "tabelog.com", "jalan.net", "booking.com", "airbnb.com", "tripadvisor", "indeed.com", "recruit.co.jp",
    "townwork.net", "baito.com", "instagram.com", "facebook.com", "twitter.com", "x.com", "youtube.com", "ameblo.jp", "cookpad.com", "gurunavi.com", "eparkbeauty.com",
]

# Query parameters that are left out of a key; one list per use.
STORE_KEY_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "from", "_ga", "_gl", "yclid", "twclid", "openqrmodal",
    "oat_content", "oat__ck", "skin", "site_code", "page_id",
]
STRIP_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "from", "_ga", "_gl", "yclid", "twclid"]
LINK_KEY_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "from"]

# Path patterns, for lower-case URLs.
CONTACT_PATH = (
    r"(?:^|/)(contact|inquiry|enquiry|enquire|inquire|toiawase|otoiawase|mailform|formmail|form[-_]mail|ask-us|askus|feedback|renraku|goiken|iawase|gorenraku|gosodan|soudan|meiru|"
    r"consultation|message|contactus|contactform|inquiryform|mailsend|sendmail|getintouch|get-in-touch|write-to-us|writeto|formcontact|contactmail|otoiawase[-_]form|"
    r"toiawase[-_]form|form[-_]otoiawase|form[-_]toiawase|free[-_]consultation|online[-_]inquiry|web[-_]inquiry|online[-_]contact|web[-_]contact)(?:/|\.|\?|_|-|$)"
)
CONTACT_CODED = r"%e3%81%8a%e5%95%8f%e3%81%84%e5%90%88%e3%82%8f%e3%81%9b|%e5%95%8f%e3%81%84%e5%90%88%e3%82%8f%e3%81%9b|%e3%81%94%e7%9b%b8%e8%ab%87|%e3%81%94%e9%80%a3%e7%b5%a1|cgi-bin|cgi/"
OTHER_PATH = (
    r"/(privacy[-_]?(?:policy)?|terms?(?:[-_]of[-_]service)?|sitemap|blog|news|articles?|posts?|column|archive|categories?|shop|cart|login|sign[-_]?up|register|logout|faq|"
    r"access(?:map)?|recruit(?:ment)?(?:[-_]\w+)?|career|jobs?|about(?:-us)?|company|profile|gallery|works|portfolio|media|press|staff|team|members?|events?|downloads?|videos?|"
    r"photos?|voices?|search|checkout|products?|services?|features?|pricing|plans?|case[-_]?stud(?:y|ies)|testimonials?|partners?|investors?|ir|sustainability|csr|history|"
    r"overview|mission|vision|values?|reviews?|interviews?|seminars?|workshops?|awards?|flow|guides?|howto|how[-_]to|notifications?|releases?|legal|policy|cookie(?:[-_]policy)?|"
    r"disclaimer|terms[-_]?conditions?|tags?|topics?|authors?|category|page/\d|feed|rss|wp-admin|wp-login|wp-json|404|500|sitemap\.xml)(?:/|\.|\?|$)"
)
DONE_PATH = r"/(thanks?|thankyou|thank[-_]you|completed?|completion|sent|finish(?:ed)?|success|entry[-_]?complete)(?:/|\.|\?|$)"
LINE_URL = r"(?i)^https?://(?:(?:www\.)?(?:lin\.ee|page\.line\.me|accountpage\.line\.me)|liff\.line\.me)/"
LINE_ANYWHERE = r"(?i)lin\.ee/|page\.line\.me/|accountpage\.line\.me/|liff\.line\.me/"
JAPANESE_PATH_WORDS = ["お問い合わせ", "問い合わせ", "ご相談", "ご連絡", "お問合せ"]

# Words of the two rule classifiers.
RULE_BOOKING = ["予約", "reservation", "booking", "ご予約", "ネット予約", "calendar", "カレンダー", "来店予約", "施術予約", "日時"]
RULE_INQUIRY = ["お問い合わせ", "contact", "問い合わせ", "相談", "inquiry", "ご質問", "資料請求", "見積もり", "申し込み"]
PAGE_BOOKING = ["予約", "ご予約", "来店予約", "施術予約", "日時を選択", "カレンダー", "時間帯", "reservation", "booking", "ホットペッパー", "hot pepper", "楽天ビューティー", "calendar", "datepicker", "timepicker"]
PAGE_INQUIRY = ["お問い合わせ", "ご質問", "ご相談", "お見積もり", "資料請求", "contact", "inquiry", "メッセージ", "ご意見"]

# Query suffixes and exclusions.
SUFFIXES = ["お問い合わせ", "公式サイト", "contact", "予約", "申込み"]
EXCLUSIONS = ["ホットペッパー", "じゃらん", "求人", "採用", "indeed", "楽天ビューティー"]

# Synonyms of an industry.
SYNONYMS = {
    "美容室": ["ヘアサロン", "美容院", "hair salon", "ビューティーサロン"],
    "整骨院": ["接骨院", "柔道整復師"],
    "歯科": ["歯医者", "デンタルクリニック", "dental clinic"],
    "中古車": ["中古自動車", "中古車販売店", "中古車販売", "中古車ショップ", "中古車センター", "中古車ディーラー", "used car"],
    "学習塾": ["塾", "個別指導塾", "予備校"],
}

# Local parts of addresses meant for contact.
CONTACT_LOCAL = (
    r"(?i)^(info|contact|inquiry|enquiry|otoiawase|toiawase|ask|support|mail|office|reception|hellocontact|hello|general|service|help|webmaster|admin|postmaster|reach|connect|"
    r"sales|cs|pr|hr)([._+-]|$)"
)

# The 14 columns of the localised view.
LOCALISED = {
    "会社名": "name", "HP URL": "hp_url", "フォームURL": "form_url", "電話番号": "phone", "メールアドレス": "email", "住所": "address", "業種": "industry", "エリア": "area",
    "フォーム種別": "form_type", "収集日時": "collected_at", "ステータス": "status", "備考": "notes", "プロジェクトID": "project_id", "実行ID": "run_id",
}

# Paths that are probed where a page leads to no form, in order.
PROBES = [
    "/contact", "/inquiry", "/contact/", "/inquiry/",
    "/otoiawase", "/toiawase", "/otoiawase/", "/toiawase/",
    "/mailform", "/mailform/", "/form", "/renraku", "/goiken",
    "/%E3%81%8A%E5%95%8F%E3%81%84%E5%90%88%E3%82%8F%E3%81%9B", "/%E5%95%8F%E3%81%84%E5%90%88%E3%82%8F%E3%81%9B", "/%E3%81%8A%E5%95%8F%E5%90%88%E3%81%9B",
    "/%E3%81%94%E7%9B%B8%E8%AB%87", "/%E3%81%94%E9%80%A3%E7%B5%A1",
    "/otoiawase-form", "/toiawase-form", "/form/otoiawase", "/form/toiawase",
    "/contact.html", "/inquiry.html", "/contact.php", "/inquiry.php", "/contact/index.html", "/inquiry/index.html", "/contact/index.php", "/inquiry/index.php",
    "/mailform/index.html", "/mailform/index.php",
    "/mail.php", "/send.php", "/post.php", "/form.html", "/form.php",
    "/cgi-bin/contact.cgi", "/cgi-bin/inquiry.cgi", "/cgi-bin/form.cgi", "/cgi-bin/mailform.cgi", "/cgi-bin/contact.pl", "/cgi-bin/form.pl", "/cgi-bin/mail.cgi", "/cgi-bin/post.cgi",
    "/contact-us", "/contact-us/", "/contact_us", "/contactus", "/get-in-touch", "/send-message", "/contact-form", "/contact-form/",
    "/inquiry-form", "/inquiry_form", "/contactform", "/message", "/message/", "/ask", "/consultation", "/consultation/", "/free-consultation", "/free-consultation/",
    "/soudan", "/soudan/", "/meiru", "/meiru/",
    "/pages/contact", "/pages/inquiry", "/pages/contact-us", "/pages/message", "/pages/form", "/pages/mailform",
    "/cgi-bin/toiawase.cgi", "/cgi-bin/otoiawase.cgi", "/cgi-bin/contactus.cgi", "/cgi-bin/mailsend.cgi", "/cgi/contact.cgi", "/cgi/inquiry.cgi",
    "/contact-page", "/inquiry-page", "/contact-1", "/contact-2",
    "/contact.asp", "/inquiry.asp", "/contact.aspx", "/inquiry.aspx", "/form.asp", "/form.aspx", "/mail.asp", "/mail.aspx",
    "/otoiawase.html", "/toiawase.html", "/otoiawase.php", "/toiawase.php",
    "/email", "/write", "/reach-us", "/reach",
    "/contact/form", "/inquiry/form", "/form/contact", "/form/inquiry", "/support/contact", "/support/inquiry", "/help/contact",
    "/online-inquiry", "/online-contact", "/web-inquiry", "/web-contact", "/online_inquiry", "/online_contact", "/web_inquiry", "/web_contact",
    "/ja/contact", "/ja/inquiry", "/jp/contact", "/jp/inquiry", "/en/contact", "/en/inquiry",
    "/renraku.html", "/goiken.html",
]
# Paths of pages that come after a form; titles and first words of pages that say there is no such page.
SENT_PATH = (
    r"/(thanks?|thankyou|thank[-_]you|complete[d]?|completion|sent|finish(?:ed)?|done|success|confirm(?:ation)?|entry[-_]?complete|sousin[-_]?kanryo|kanryo|okini[-_]nyuuri)(?:/|\.|\?|$)"
)
GONE_TITLE = (
    r"(?iu)\b404\b|not.?found|ページが見つかりません|お探しのページ.*見つかりません|ページが存在しません|エラーが発生|お探しのページ|ご指定.*ページ.*存在|page.?not.?found|error.?404|"
    r"アクセスエラー|お探しのページはございません|存在しないページ|削除されたページ"
)
GONE_TEXT = (
    r"(?iu)お探しのページ.*見つかり|このページ.*存在しません|ページが見つかりません|存在しないページ|page not found|404 error|ご指定のページ.*見つかり|お探しのページは.*見つかりません|"
    r"お探しのページはございません|アクセスしようとしたページは.*存在しません|削除.*移動.*変更.*可能性|URLが間違っている可能性"
)
# Patterns of e-mail addresses, phone and fax numbers and postal addresses in pages.
MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PLAIN_MAIL = r"[a-zA-Z0-9._%+\-]{3,}@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,6}"
HIDDEN_MAIL = r"(?i)([a-zA-Z0-9._%+\-]{2,})\s*(?:\[at\]|\(at\)|【at】|＠|\s+at\s+|@)\s*([a-zA-Z0-9.\-]{2,}\.[a-zA-Z]{2,6})"
DASHED_PHONE = r"0\d{1,4}[\-–—(]\d{1,4}[)–—\-]\d{3,4}"
FAX_LABEL = r"(?i)(?:fax|ファックス|ファクシミリ|F\.?)[\s\x{3000}:：\-.]*"
PHONE_LABEL = r"(?i)(?:tel|電話|お電話)[\s\x{3000}:：\-.]*"
CODED_ADDRESS = r"〒\s*(\d{3}[－\-]\d{4}|\d{7})\s*([^<]{5,80}(?:都|道|府|県)[^<]{0,60})"
LABELLED_ADDRESS = r"(?i)(?:所在地|住所|本社所在地|事務所|拠点|所在地・アクセス|address)[\s\x{3000}]*[：:]\s*([^<]{8,100}(?:都|道|府|県)[^<]{0,60})"
BARE_ADDRESS = (
    r"(?:^|>|\s)((?:北海道|東京都|大阪府|京都府|(?:青森|岩手|宮城|秋田|山形|福島|茨城|栃木|群馬|埼玉|千葉|神奈川|新潟|富山|石川|福井|山梨|長野|岐阜|静岡|愛知|三重|滋賀|兵庫|奈良|和歌山|"
    r"鳥取|島根|岡山|広島|山口|徳島|香川|愛媛|高知|福岡|佐賀|長崎|熊本|大分|宮崎|鹿児島|沖縄)県)[^<]{5,60}(?:市|区|町|村|丁目|番地|番|号)[^<]{0,40})"
)
