"""DuckDB SQL of the core's queries, written apart from their plans."""

from __future__ import annotations

from leadloom.functions import lists


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


def _re(c: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(to)}, 'g')"
    return c


def _x(c: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract({c}, {_q(pattern)}, {group}, {_q('s' + flags)})"


def _m(c: str, pattern: str, flags: str = "s") -> str:
    return f"regexp_matches({c}, {_q(pattern)}, {_q(flags)})"


def _or(c: str, default: str) -> str:
    return f"coalesce(nullif({c}, ''), {default})"


def _n(c: str) -> str:
    return f"coalesce({c}, '')"


# addresses

_HEAD = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?"


def _text(c: str) -> str:
    return _re(_n(c), (r"^[\x00-\x20]+", ""), (r"[\x00-\x20]+$", ""), (r"[\t\n\r]", ""))


def _host(c: str) -> str:
    return f"lower({_x(_text(c), _HEAD + '([^/?#:\\s]+)')})"


def _host_key(c: str) -> str:
    return _re(_host(c), (r"^www\.", ""))


def _raw_host(c: str) -> str:
    return _re(_x(_text(c), "^https?://([^/?#]+)"), (r"^www\.", ""))


def _path(c: str) -> str:
    return _x(_text(c), _HEAD + "[^/?#]+([^?#]*)")


def _kept(c: str, dropped, low: bool = False) -> str:
    name = "split_part(x, '=', 1)"
    name = f"lower({name})" if low else name
    query = _x(_text(c), "^[^?#]*\\?([^#]*)")
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT list_contains({_list(dropped)}, {name})), '&')"
    if low:  # the store key leaves a query without such parameters as it is
        kept = f"(CASE WHEN len(list_filter(string_split({query}, '&'), lambda x: list_contains({_list(dropped)}, {name}))) > 0 THEN {kept} ELSE {query} END)"
    return f"(CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"


def _coded(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN ord(x) > 126 THEN url_encode(x) WHEN x = ' ' THEN '%20' ELSE x END), '')"


def _store_key(c: str) -> str:
    u = f"regexp_replace({_n(c)}, '&amp;', '&', 'gi')"
    key = _re(f"lower({_host(u)} || {_coded(_re(_path(u), ('/+$', ''), ('/{2,}', '/')))} || {_coded(_kept(u, lists.STORE_KEY_PARAMS, True))})", (r"^www\.", ""))
    return f"CASE WHEN {_host(u)} <> '' THEN {key} ELSE trim(lower({_text(u)})) END"


def _page_key(c: str) -> str:
    scheme = _x(_text(c), r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://")
    return f"(CASE WHEN {_host(c)} <> '' THEN lower({scheme}) || '://' || {_host(c)} || {_re(_path(c), ('/$', ''))} ELSE {_text(c)} END)"


def _stripped(c: str) -> str:
    u = _text(c)
    return f"CASE WHEN {_host(c)} <> '' THEN {_x(u, '^([^?#]*)')} || {_kept(c, lists.STRIP_PARAMS)} || {_x(u, '(#.*)$')} ELSE {u} END"


def _link_key(c: str) -> str:
    key = f"lower({_host(c)} || {_re(_path(c), ('/$', ''))} || {_kept(c, lists.LINK_KEY_PARAMS)})"
    return _re(f"(CASE WHEN {_host(c)} <> '' THEN {key} ELSE {_re(f'lower({_text(c)})', ('/$', ''), ('^https?://', ''))} END)", (r"^www\.", ""))


def _display(c: str) -> str:
    p = _re(_path(c), ("/+$", ""))
    return f"CASE WHEN {_host(c)} <> '' THEN {_host_key(c)} || CASE WHEN length({p}) > 20 THEN {p}[1:20] || '…' ELSE {p} END ELSE {_re(_text(c), ('^https?://', ''))}[1:35] END"


def _line(c: str) -> str:
    return _m(_text(c), r"^https?://((www\.)?(lin\.ee|page\.line\.me|accountpage\.line\.me)|liff\.line\.me)/", "i")


def _has_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w.lower())})" for w in words) + ")"


def _count(c: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({c}, {_q(w.lower())}) THEN 1 ELSE 0 END" for w in words) + ")"


def _on(c: str, hosts) -> str:
    return "(" + " OR ".join(f"{c} = {_q(h)} OR suffix({c}, {_q('.' + h)})" for h in hosts) + ")"


_DECODED = f"coalesce(try(url_decode(replace({_text('form_url')}, '+', '%2B'))), '')"

# times

_T = "replace(trim(collected_at), '/', '-')"
_T = _re(f"({_T})", (r"-(\d)-", r"-0\1-"), (r"-(\d)-", r"-0\1-"), (r"-(\d) ", r"-0\1 "), (r" (\d):", r" 0\1:"))
_ZONED = f"CASE WHEN {_m(_T, '(Z|[+-][0-9]{2}:?[0-9]{2})$', 'i')} AND contains({_T}, ':') THEN {_T} ELSE {_T} || '+09:00' END"
_AT = f"try_cast(({_ZONED}) AS timestamptz)"

# pages

_PAGE = (
    "('<html><head><title>' || coalesce(name, '') || ' &amp; お問い合わせ</title><script>var a = 1;</script></head><body><h1>' || coalesce(industry, '') || '</h1>' || chr(10) || '<nav><a href=\"'"
    " || coalesce(form_url, '') || '\">お問い合わせ</a></nav><h2> ' || coalesce(area, '') || ' </h2><p>TEL: ' || coalesce(phone, '') || ' FAX: 03-9999-0000</p><p>住所：' || coalesce(address, '')"
    " || '</p><p>' || coalesce(notes, '') || '&nbsp;</p><footer><a href=\"mailto:' || coalesce(email, '') || '\">mail</a></footer></body></html>')"
)
_WITH_PAGE = f"WITH c AS (SELECT *, {_PAGE} AS h FROM companies)"
_SP = r"[\s\x{3000}\x{A0}\x{0B}]+"


def _tidy(c: str) -> str:
    return f"trim({_re(c, (_SP, ' '))}, ' ')"


_VISIBLE = _tidy(_re("h", (r"(?is)<script\b.*?</script\s*>", ""), ("(?s)<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')))
_TITLE = _tidy(_re(_x("h", "(?is)<title[^>]*>(.*?)</title>"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")))
_HEADS = f"array_to_string(list_filter(list_transform(regexp_extract_all(h, '(?is)<h[12]\\b[^>]*>(.*?)</h[12]>', 1), lambda x: {_tidy(_re('x', ('<[^>]+>', ' ')))}), lambda t: t <> '')[1:3], ' / ')"
_SHORT = _tidy(_re("h", (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", ""), ("(?s)<[^>]+>", " ")))

# contacts

_MAIL, _PLAINMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"[a-zA-Z0-9._%+\-]{3,}@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,6}"
_DASHED = r"0\d{1,4}[\-–—(]\d{1,4}[)–—\-]\d{3,4}"


def _best(found: str) -> str:
    local = lists.CONTACT_LOCAL
    return f"coalesce(list_filter({found}, lambda e: {_m('split_part(e, chr(64), 1)', local)})[1], ({found})[1], '')"


def _email(h: str) -> str:
    t = _re(h, ("<[^>]+>", " "))
    linked = _best(f"regexp_extract_all({h}, {_q(f'(?i)mailto:({_MAIL})')}, 1)")
    plain = _best(f"list_filter(regexp_extract_all({t}, {_q(_PLAINMAIL)}), lambda e: NOT {_m('e', r'[.](js|css|png|jpg)$')})")
    p = r"(?i)([a-zA-Z0-9._%+\-]{2,})\s*(?:\[at\]|\(at\)|【at】|＠|\s+at\s+|@)\s*([a-zA-Z0-9.\-]{2,}\.[a-zA-Z]{2,6})"
    one, two = _x(t, p, 1), _x(t, p, 2)
    hidden = f"CASE WHEN {one} <> '' AND NOT {_m(two, r'[.](js|css|png)$')} THEN {_re(f'({one} || chr(64) || {two})', (r'\s+', ''))} ELSE '' END"
    return f"CASE WHEN {linked} <> '' THEN {linked} WHEN {plain} <> '' THEN {plain} ELSE {hidden} END"


def _half(h: str) -> str:
    return f"translate({h}, '０１２３４５６７８９（）－', '0123456789()-')"


def _faxes(h: str) -> str:
    return f"list_transform(regexp_extract_all({_half(h)}, {_q(rf'(?i)(?:fax|ファックス|ファクシミリ|F\.?)[\s\x{{3000}}:：\-.]*({_DASHED}|0[0-9]{{9,10}})')}, 1), lambda x: {_re('x', (r'\D', ''))})"


def _phone(h: str) -> str:
    w, label = _half(h), r"(?i)(?:tel|電話|お電話)[\s\x{3000}:：\-.]*"
    tries = [r"(?i)tel:([\d\-+\s()]{7,20})", rf"{label}({_DASHED})", rf"{label}(0[0-9]{{9,10}})", rf"({_DASHED})", r"(0[0-9]{9,10})", r"(\+81[-\s\d]{8,16})"]
    found = "coalesce(" + ", ".join(f"nullif({_x(w, p)}, '')" for p in tries) + ", '')"
    tidy = _re(f"translate({found}, '（）－–—', '()---')", (r"\s+", ""))
    digits = _re(tidy, (r"\D", ""))
    return f"CASE WHEN ({_m(digits, '^0[0-9]{9,10}$')} AND NOT list_contains({_faxes(h)}, {digits})) OR starts_with({tidy}, '+81') THEN {tidy} ELSE '' END"


def _first_phone(h: str) -> str:
    tries = [_re(_x(h, p), (r"\s", "")) for p in (r"(?i)tel:([0-9\-+\s()]{10,15})", r"(\d{2,4}[-\s]?\d{2,4}[-\s]?\d{3,4})")]
    return "CASE " + " ".join(f"WHEN length({_re(t, ('[-+()]', ''))}) >= 10 THEN {t}" for t in tries) + " ELSE '' END"


def _address(h: str) -> str:
    b = _re(h, (r"(?i)<br\s*/?>", " "), (r"\n+", " "))
    tidy = lambda c: f"trim({_re(c, (r'[\s\x{3000}\x{0B}]+', ' '))}, ' ')"
    coded = r"〒\s*(\d{3}[－\-]\d{4}|\d{7})\s*([^<]{5,80}(?:都|道|府|県)[^<]{0,60})"
    labelled = _x(b, r"(?i)(?:所在地|住所|本社所在地|事務所|拠点|所在地・アクセス|address)[\s\x{3000}]*[：:]\s*([^<]{8,100}(?:都|道|府|県)[^<]{0,60})")
    bare = _x(b, r"(?:^|>|\s)((?:北海道|東京都|大阪府|京都府|(?:青森|岩手|宮城|秋田|山形|福島|茨城|栃木|群馬|埼玉|千葉|神奈川|新潟|富山|石川|福井|山梨|長野|岐阜|静岡|愛知|三重|滋賀|兵庫|奈良|和歌山|鳥取|島根|岡山|広島|山口|徳島|香川|愛媛|高知|福岡|佐賀|長崎|熊本|大分|宮崎|鹿児島|沖縄)県)[^<]{5,60}(?:市|区|町|村|丁目|番地|番|号)[^<]{0,40})")
    code = _x(b, coded, 1)
    return f"(CASE WHEN {code} <> '' THEN '〒' || replace({code}, '－', '-') || ' ' || {tidy(_x(b, coded, 2))} WHEN {tidy(labelled)} <> '' THEN {tidy(labelled)} ELSE {tidy(bare)} END)[1:100]"


# list, runs

_LOCAL = ", ".join(f'coalesce({c}, \'\') AS "{n}"' for n, c in lists.LOCALISED.items())
_GOOD = "('success', 'completed')"
_KIDS = (
    "SELECT id AS parent_id, unnest(child_run_ids) AS child_id FROM project_runs UNION SELECT parent_run_id, id FROM project_runs WHERE parent_run_id IS NOT NULL"
)
_TREE = f"SELECT id AS run_id, id AS member_id FROM project_runs WHERE parent_run_id IS NULL UNION SELECT k.parent_id, k.child_id FROM ({_KIDS}) k JOIN project_runs r ON r.id = k.parent_id AND r.parent_run_id IS NULL"
_TAB = _re("label", (r"[\\/?*\[\]:]", "_")) + "[1:100]"
_ROLLED = f"""
SELECT p.id, CASE WHEN bool_or(c.status IN {_GOOD}) THEN 'success' ELSE 'error' END AS status, sum(coalesce(c.items_written, 0))::bigint AS items_written,
  nullif(sum(coalesce(c.tokens_input, 0)), 0)::bigint AS tokens_input, nullif(sum(coalesce(c.tokens_output, 0)), 0)::bigint AS tokens_output,
  nullif(sum(coalesce(c.raw_search_count, 0)), 0)::bigint AS raw_search_count, count(*) AS n_children
FROM (SELECT id, unnest(child_run_ids) AS child_id FROM project_runs) p JOIN project_runs c ON c.id = p.child_id
GROUP BY p.id HAVING bool_and(c.status IN ('success', 'completed', 'error'))"""
_SECS = "floor((epoch_ms(try_cast(completed_at AS timestamptz)) - epoch_ms(try_cast(created_at AS timestamptz))) / 1000)::bigint"
_DURATION = f"coalesce(CASE WHEN {_SECS} < 0 THEN '-' WHEN {_SECS} >= 3600 THEN ({_SECS} // 3600) || '時間' || (({_SECS} // 60) % 60) || '分' ELSE ({_SECS} // 60) || '分' || ({_SECS} % 60) || '秒' END, '-')"
_W = "CASE WHEN raw_search_count > 0 THEN items_written / raw_search_count END"
_F = "CASE WHEN results.\"afterDedup\" > 0 THEN 100 * results.\"formFoundCount\" / results.\"afterDedup\" END"


def _band(c: str, high: float, middle: float) -> str:
    return f"CASE WHEN ({c}) >= {high} THEN 'high' WHEN ({c}) >= {middle} THEN 'middle' WHEN ({c}) IS NOT NULL THEN 'low' END"




def _edges(c: str) -> str:
    return _re(c, (r"^[\s\x{3000}\x{A0}\x{0B}]+", ""), (r"[\s\x{3000}\x{A0}\x{0B}]+$", ""))


_EDGES = _edges("phone")
_LD = "'<script type=\"application/ld+json\">' || to_json({email: 'ld.' || coalesce(email, ''), telephone: coalesce(phone, ''), address: {addressRegion: coalesce(area, ''), streetAddress: coalesce(address, '')}})::varchar || '</script>'"
_ITEMS = (
    "'<p itemprop=\"telephone\">' || coalesce(phone, '') || '</p><div itemprop=\"address\" itemscope><b itemprop=\"addressRegion\">' || coalesce(area, '') || '</b><b itemprop=\"streetAddress\">' || coalesce(address, '')"
    " || '</b></div>'"
)
#: Pages with JSON-LD (0), microdata (1) or both (2).
_WITH_LD = f"WITH k AS (SELECT *, ascii(right(id, 1)) % 3 AS k FROM companies), w AS (SELECT *, {_PAGE} || CASE k WHEN 0 THEN {_LD} WHEN 1 THEN {_ITEMS} ELSE {_LD} || {_ITEMS} END AS h FROM k)"
#: The one link of a page, to its form.
_LINK = f"""WITH r AS (SELECT id, {_re(f"regexp_replace({_edges(_n('form_url'))}, '&amp;', '&', 'gi')", ('[\\t\\n\\r]', ''), ('#.*$', ''), ('[?]$', ''))} AS u, hp_url FROM companies),
u AS (SELECT id, lower(regexp_extract(u, '^([a-zA-Z]*:)?', 0)) || regexp_replace(u, '^([a-zA-Z]*:)?', '') AS url, hp_url FROM r WHERE u <> ''),
l AS (SELECT *, {_host_key('url')} AS host, {_host_key('hp_url')} AS home FROM u WHERE {_host_key('url')} <> '')"""
_INSIDE = "(host = home OR suffix(host, '.' || home))"
_SCORED = f"""{_LINK}, d AS (SELECT *, lower(url) AS w, coalesce(try(url_decode(replace(lower(url), '+', '%2B'))), '') AS reads FROM l),
b AS (SELECT id, url, 12 + 2 + CASE WHEN {_m('w', lists.CONTACT_PATH)} OR {_m('w', lists.CONTACT_CODED)} THEN 8 ELSE 0 END + CASE WHEN NOT contains(reads, '�') AND {_has_any('reads', lists.JAPANESE_PATH_WORDS)} THEN 8 ELSE 0 END
  + CASE WHEN {_has_any('w', lists.JAPANESE_PATH_WORDS[:4])} THEN 8 ELSE 0 END + CASE WHEN {_m('w', '/cgi(-bin)?/.*form')} THEN 12 ELSE 0 END
  + CASE WHEN {_m('w', r'/(mailform|form[_-]?mail|contact[_-]?form|inquiry|toiawase)[.](cgi|pl|php|aspx?)([?]|$)')} THEN 10 ELSE 0 END + CASE WHEN {_INSIDE} THEN 0 ELSE 15 END
  + CASE WHEN {_INSIDE} AND split_part({_host('w')}, '.', 1) IN ('contact', 'inquiry', 'form', 'mail', 'toiawase', 'otoiawase') THEN 8 ELSE 0 END AS score
  FROM d WHERE NOT {_on('host', lists.REJECTED_HOSTS)} AND ({_INSIDE} OR {_has_any('host', lists.FORM_HOSTS)}) AND NOT {_has_any('host', lists.BOOKING_HOSTS)}
  AND NOT {_m('w', lists.OTHER_PATH)} AND NOT {_m('w', lists.DONE_PATH)})"""

_REQ = "SELECT id, search_target.keywords AS words, search_target.area AS area, search_target.industry AS industry FROM project_runs"
_UPSERT = """
WITH old AS (SELECT id, coalesce(normalized_form_url, '') AS f, coalesce(normalized_hp_url, '') AS h, coalesce(form_url, '') AS url FROM companies),
new AS (SELECT id, ord, coalesce(normalized_form_url, '') AS f, coalesce(normalized_hp_url, '') AS h, coalesce(form_url, '') AS url FROM company_batches),
a AS (SELECT *, f = '' OR (row_number() OVER (PARTITION BY f ORDER BY ord, id) = 1 AND f NOT IN (SELECT f FROM old WHERE f <> '')) AS survives FROM new),
b AS (SELECT *, survives AND (h = '' OR (row_number() OVER (PARTITION BY h, survives ORDER BY ord, id) = 1 AND h NOT IN (SELECT h FROM old WHERE h <> ''))) AS inserts FROM a),
s AS (SELECT *, CASE WHEN inserts THEN 'insert' WHEN survives AND f <> '' AND url <> '' THEN 'candidate' ELSE 'duplicate' END AS state FROM b),
t AS (SELECT h, id AS target_id, row_number() OVER (PARTITION BY h ORDER BY late, o, id) AS k FROM (
  SELECT h, id, 0 AS late, 0 AS o FROM old WHERE url = '' AND h <> '' UNION ALL SELECT h, id, 1, ord FROM s WHERE state = 'insert' AND url = '' AND h <> '')),
k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ord, id) AS k FROM s WHERE state = 'candidate'),
plan AS (SELECT id, state AS decision, '' AS target_id FROM s WHERE state <> 'candidate'
  UNION ALL SELECT k.id, CASE WHEN t.target_id IS NULL THEN 'duplicate' ELSE 'upgrade' END, coalesce(t.target_id, '') FROM k LEFT JOIN t ON t.h = k.h AND t.k = k.k)
"""
_PROBES = f"SELECT unnest({_list(lists.PROBES)}) AS path, unnest(range({len(lists.PROBES)})) AS o"
_BOOKING = [h for h in lists.BOOKING_HOSTS if h != "coubic.com"]
_MOVED = "CASE WHEN area = '東京都' THEN replace(form_url, 'form-box.example', 'airrsv.net') ELSE form_url END"
_NAME_PARTS = r"list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), '\s*[|｜\-–—]\s*'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_LONGEST = f"list_max(list_transform({_NAME_PARTS}, lambda x: length(x)))"
_EXCLUDED = list(dict.fromkeys([*lists.EXCLUSIONS, "求人", "口コミ"]))

SQL = {
    "url_keys": f"SELECT id, {_store_key('form_url')} AS store_key, {_page_key('form_url')} AS page_key, {_host_key('hp_url')} AS host, {_raw_host('hp_url')} AS raw_host, {_stripped('form_url')} AS stripped, {_link_key('form_url')} AS link_key, {_display('form_url')} AS display, {_re(f'lower({_path("form_url")})', ('/$', ''))} AS tried_path FROM companies",
    "url_flags": f"""SELECT id, {_line('form_url')} AS line, {_host_key('form_url')} = {_host_key('hp_url')} OR suffix({_host_key('form_url')}, '.' || {_host_key('hp_url')}) AS internal,
        split_part({_host('form_url')}, '.', 1) IN ('contact', 'inquiry', 'form', 'mail', 'toiawase', 'otoiawase') AS contact_host, lower({_page_key('form_url')}) = lower({_page_key('hp_url')}) AS same_page,
        starts_with({_text('form_url')}, 'http') AS fetchable, NOT contains({_DECODED}, '�') AND {_has_any(_DECODED, lists.JAPANESE_PATH_WORDS)} AS japanese, {_m('lower(form_url)', lists.CONTACT_PATH)} AS contact_path FROM companies""",
    "stored_keys_agree": f"SELECT count(*) AS n, count(*) FILTER ({_store_key('form_url')} = coalesce(normalized_form_url, '')) AS form_agrees, count(*) FILTER ({_store_key('hp_url')} = coalesce(normalized_hp_url, '')) AS home_agrees FROM companies",
    "host_counts": f"SELECT {_host_key('form_url')} AS host, count(*) AS n FROM companies GROUP BY 1",
    "host_top": f"SELECT {_host_key('form_url')} AS host, count(*) AS n FROM companies GROUP BY 1 HAVING host <> '' ORDER BY n DESC, host LIMIT 20",
    "grid_page": "SELECT id, name, area, form_url FROM companies WHERE industry = '歯科' AND coalesce(form_url, '') <> '' ORDER BY name ASC NULLS LAST, id LIMIT 50 OFFSET 50",
    "grid_search": "SELECT id, name, phone FROM companies WHERE status = '未送信' AND coalesce(phone, '') <> '' AND contains(lower(concat_ws(chr(31), name, hp_url, form_url, phone, email, address, notes)), 'hair')",
    "grid_counts": "SELECT count(*) AS total, count(*) FILTER (coalesce(form_url, '') <> '') AS forms, count(*) FILTER (coalesce(phone, '') <> '') AS phones, count(*) FILTER (coalesce(email, '') <> '') AS emails FROM companies WHERE area = '東京都'",
    "grid_in_runs": "SELECT count(*) AS total, count(*) FILTER (coalesce(form_url, '') <> '') AS forms, count(*) FILTER (coalesce(phone, '') <> '') AS phones, count(*) FILTER (coalesce(email, '') <> '') AS emails FROM companies WHERE run_id IN (SELECT DISTINCT run_id FROM companies WHERE run_id IS NOT NULL ORDER BY run_id LIMIT 2)",
    "facet_industry": "SELECT DISTINCT industry AS value FROM companies WHERE coalesce(industry, '') <> ''",
    "facet_area": "SELECT DISTINCT area AS value FROM companies WHERE coalesce(area, '') <> ''",
    "status_counts": f"SELECT {_or('status', _q('不明'))} AS value, count(*) AS n FROM companies GROUP BY 1",
    "type_counts": f"SELECT {_or('form_type', _q('unknown'))} AS value, count(*) AS n FROM companies GROUP BY 1",
    "type_by_industry": "SELECT industry, form_type, count(*) AS n FROM companies GROUP BY CUBE (industry, form_type)",
    "project_stats": """SELECT p.id, (SELECT count(*) FROM companies c WHERE c.project_id = p.id) AS companies, (SELECT count(*) FROM companies c WHERE c.project_id = p.id AND coalesce(c.form_url, '') <> '') AS forms,
        (SELECT count(*) FROM project_runs r WHERE r.project_id = p.id AND r.parent_run_id IS NULL) AS runs FROM projects p""",
    "form_keys": "SELECT DISTINCT normalized_form_url FROM companies WHERE coalesce(normalized_form_url, '') <> ''",
    "home_keys": "SELECT normalized_hp_url FROM companies WHERE coalesce(normalized_hp_url, '') <> ''",
    "localised_rows": f"SELECT id, {_LOCAL} FROM companies",
    "imported_rows": """SELECT coalesce("会社名", '') AS name, "フォームURL" AS form_url, coalesce(nullif("ステータス", ''), '未送信') AS status, coalesce("実行ID", '') AS run_id, true AS imported_from_sheets FROM sheet_row WHERE coalesce("フォームURL", '') <> ''""",
    "bulk_update": "SELECT CASE WHEN industry = 'カフェ' THEN 'スキップ' ELSE status END AS status, count(*) AS n FROM companies GROUP BY 1",
    "run_deleted": "SELECT project_id, count(*) AS n FROM companies WHERE run_id IS DISTINCT FROM (SELECT min(run_id) FROM companies) GROUP BY 1",
    "pruned": f"SELECT id FROM companies WHERE NOT coalesce({_AT} < TIMESTAMPTZ '2026-04-01 00:00:00+00' AND status IN ('送信済み', 'スキップ', 'エラー'), false)",
    "collected_at": f"SELECT id, coalesce(epoch_ms({_AT}), -1) AS ms FROM companies",
    "csv_lines": "SELECT id, " + " || ',' || ".join(f"'\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"'" for c in lists.LOCALISED.values()) + " AS line FROM companies",
    "tab_counts": f"SELECT tab, count(*) AS n FROM (SELECT '全件' AS tab FROM companies UNION ALL SELECT {_TAB} FROM ({_TREE}) t JOIN project_runs r ON r.id = t.run_id JOIN companies c ON c.run_id = t.member_id) GROUP BY tab",
    "run_history": f"SELECT r.id, coalesce(p.name, r.project_id) AS project_name, label, status, r.created_at, {_DURATION.replace('created_at', 'r.created_at')} AS duration FROM project_runs r LEFT JOIN projects p ON p.id = r.project_id WHERE r.parent_run_id IS NULL",
    "run_tree": _TREE,
    "run_children": _KIDS,
    "batch_rollup": f"SELECT id, status, items_written, coalesce(tokens_input, -1) AS tokens_input, coalesce(tokens_output, -1) AS tokens_output, coalesce(raw_search_count, -1) AS raw_search_count, n_children FROM ({_ROLLED})",
    "rollup_needed": f"SELECT x.id, x.status, x.items_written FROM ({_ROLLED}) x JOIN project_runs r ON r.id = x.id WHERE NOT coalesce(r.status IN {_GOOD} AND r.items_written IS NOT DISTINCT FROM x.items_written AND r.completed_at IS NOT NULL, false)",
    "conversion": f"SELECT id, round(100 * ({_W}), 1) AS written_rate, {_band(_W, 0.1, 0.05)} AS written_band, round({_F}, 1) AS found_rate, {_band(_F, 50, 20)} AS found_band FROM project_runs",
    "success_share": f"SELECT count(*) AS n, count(*) FILTER (status IN {_GOOD}) AS good, round(100.0 * count(*) FILTER (status IN {_GOOD}) / count(*))::bigint AS percent FROM (SELECT * FROM project_runs ORDER BY created_at DESC, id LIMIT 10)",
    "queue_position": "SELECT r.id, coalesce(w.n, 0) AS position FROM project_runs r LEFT JOIN (SELECT id, row_number() OVER (ORDER BY created_at, id) AS n FROM project_runs WHERE status = 'pending') w ON w.id = r.id",
    "newest_runs": "SELECT id, project_id FROM project_runs WHERE status IN ('success', 'completed', 'error') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY coalesce(completed_at, created_at) DESC NULLS LAST, id) <= 3",
    "stale_runs": "SELECT id, status, coalesce((status = 'running' AND try_cast(created_at AS timestamptz) < TIMESTAMPTZ '2026-06-30 22:00:00+00') OR (status = 'pending' AND try_cast(created_at AS timestamptz) < TIMESTAMPTZ '2026-06-30 00:00:00+00'), false) AS stale FROM project_runs",
    "next_project": "SELECT 'proj-20260105-' || lpad((coalesce(max(regexp_extract(id, '([0-9]+)$', 1)::int), 0) + 1)::varchar, 3, '0') AS next_id FROM projects WHERE starts_with(id, 'proj-20260105-')",
    "token_totals": "SELECT project_id, sum(coalesce(tokens_input, 0))::bigint AS tokens_input, sum(coalesce(tokens_output, 0))::bigint AS tokens_output, sum(coalesce(items_written, 0))::bigint AS items_written FROM project_runs GROUP BY 1",
    "actual_counts": "SELECT r.id, CASE WHEN n > 0 THEN n ELSE coalesce(items_written, 0) END AS items FROM project_runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM companies GROUP BY 1) c ON c.run_id = r.id",
    "child_targets": "SELECT id AS parent_id, i - 1 AS ord, search_target.areas[i] AS area, search_target.industry AS industry FROM (SELECT *, unnest(range(1, len(search_target.areas) + 1)) AS i FROM project_runs WHERE len(search_target.areas) > 1)",
    "retries": "SELECT id AS run_id, search_target.industry AS industry, search_target.area AS area, CASE WHEN coalesce(len(search_target.keywords), 0) > 0 THEN array_to_string(search_target.keywords, ',') ELSE search_target.industry END AS keywords, search_target.\"maxResults\" AS max_results FROM project_runs WHERE status = 'error'",
    "file_names": f"SELECT id, coalesce({_re('label', (r'[\s/:]', '_'))}, '企業リスト') || '_2026-07-01.csv' AS name, {_TAB} AS tab FROM project_runs",
    "query_expand": f"""SELECT id, ((ki - 1) * 5 + si - 1) * 3 + page - 1 AS ord, words[ki] AS keyword, page, words[ki] || ' ' || area || ' ' || suffixes[si] AS query
        FROM (SELECT *, unnest(range(1, 4)) AS page FROM (SELECT *, unnest(range(1, 6)) AS si FROM (SELECT *, {_list(lists.SUFFIXES)} AS suffixes, unnest(range(1, len(words) + 1)) AS ki FROM ({_REQ}))))""",
    "query_together": f"""SELECT id, (si - 1) * 2 + page - 1 AS ord, array_to_string(words, ' ') || ' ' || area || CASE WHEN si = 1 THEN ' contact' ELSE '' END AS query
        FROM (SELECT *, unnest(range(1, 3)) AS page FROM (SELECT *, unnest(range(1, 3)) AS si FROM ({_REQ}) WHERE len(words) > 0))""",
    "query_excluded": f"SELECT id, industry || ' ' || area || ' お問い合わせ' || {_q(''.join(f' -{w}' for w in _EXCLUDED))} AS query FROM ({_REQ})",
    "area_parts": f"""WITH parts AS (SELECT area, industry AS part, dense_rank() OVER (PARTITION BY area ORDER BY industry) AS ord FROM (SELECT DISTINCT area, industry FROM companies WHERE coalesce(area, '') <> '' AND coalesce(industry, '') <> ''))
        SELECT r.id, r.area, coalesce(p.part, r.area) AS part, coalesce(p.ord, 0) AS ord FROM ({_REQ}) r LEFT JOIN parts p ON p.area = r.area""",
    "organic_results": f"SELECT doc_id, host FROM (SELECT doc_id, {_raw_host('url')} AS host FROM documents) WHERE host <> '' AND NOT {_on('host', [*lists.SKIPPED_DOMAINS, 'machi-navi.example'])}",
    "organic_workflow": f"SELECT doc_id, host FROM (SELECT doc_id, {_raw_host('url')} AS host FROM documents) WHERE host <> '' AND NOT {_on('host', [*lists.WORKFLOW_SKIPPED, 'machi-navi.example'])}",
    "not_aggregated": f"SELECT id, host FROM (SELECT id, {_host('hp_url')} AS host FROM companies) WHERE host <> '' AND NOT {_has_any('host', lists.AGGREGATORS)}",
    "result_names": f"SELECT doc_id, coalesce(CASE WHEN {_LONGEST} > 5 THEN list_filter({_NAME_PARTS}, lambda x: length(x) = {_LONGEST})[1] ELSE {_NAME_PARTS}[1] END, '') AS name, trim({_re(_n('title'), (r'\s*[|｜]\s*.+$', ''), (r'\s*[-–—]\s*.+$', ''), ('【[^】]*】', ''))}, ' ') AS clean FROM documents",
    "area_density": f"""SELECT tier, count(*) AS n, max(CASE tier WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END)::bigint AS most FROM (SELECT CASE WHEN a IN ('港区', '中央区', '広島市') THEN 'high' WHEN a IN ('長野市', '静岡市') THEN 'medium'
        WHEN {_m('a', '[都道府県]$')} THEN 'high' ELSE 'low' END AS tier FROM (SELECT coalesce(area, '') AS a FROM companies)) GROUP BY tier""",
    "first_forms": "SELECT id FROM companies QUALIFY coalesce(normalized_form_url, '') = '' OR row_number() OVER (PARTITION BY normalized_form_url ORDER BY id) = 1",
    "unknown_forms": "SELECT id FROM company_batches b WHERE coalesce(normalized_form_url, '') = '' OR normalized_form_url NOT IN (SELECT normalized_form_url FROM companies WHERE normalized_form_url IS NOT NULL)",
    "known_homes": "SELECT id, coalesce(normalized_hp_url <> '' AND normalized_hp_url IN (SELECT normalized_hp_url FROM companies WHERE normalized_hp_url IS NOT NULL), false) AS known FROM company_batches",
    "merged_sources": f"""SELECT id, host, source_rank FROM (SELECT id, {_host_key('hp_url')} AS host, 0::bigint AS source_rank FROM companies UNION ALL SELECT id, {_host_key('hp_url')}, 1 FROM company_batches)
        QUALIFY host = '' OR row_number() OVER (PARTITION BY host ORDER BY source_rank, id) = 1""",
    "places_once": f"""WITH a AS (SELECT id, coalesce(phone, '') AS place, {_host_key('hp_url')} AS host FROM companies QUALIFY row_number() OVER (PARTITION BY coalesce(phone, '') ORDER BY id) = 1)
        SELECT id FROM a QUALIFY host = '' OR row_number() OVER (PARTITION BY host ORDER BY id) = 1""",
    "batch_report": f"""WITH b AS (SELECT ord, {_host_key('hp_url')} AS host FROM company_batches), k AS (SELECT DISTINCT {_host_key('hp_url')} AS host FROM companies),
        u AS (SELECT ord FROM b WHERE host = '' OR host NOT IN (SELECT host FROM k) QUALIFY host = '' OR row_number() OVER (PARTITION BY host ORDER BY ord) = 1)
        SELECT t AS total, n AS unique_rows, t - n AS duplicate_rows, CASE WHEN t > 0 THEN round(100.0 * (t - n) / t)::bigint ELSE 0 END AS duplicate_rate FROM (SELECT (SELECT count(*) FROM b) AS t, (SELECT count(*) FROM u) AS n)""",
    "last_sheet_rows": "SELECT id, max(row_no) AS row_no FROM sheet_row WHERE id IS NOT NULL GROUP BY id",
    "keys_once": f"SELECT id, {_host_key('hp_url')} AS host FROM companies",
    "upsert_plan": _UPSERT + "SELECT id, decision, target_id FROM plan",
    "upsert_counts": _UPSERT + "SELECT count(*) FILTER (decision = 'insert') AS added, count(*) FILTER (decision = 'upgrade') AS upgraded, count(*) FILTER (decision = 'duplicate') AS duplicates FROM plan",
    "upserted_types": _UPSERT + """, full_ AS (SELECT coalesce(form_url, '') AS form_url, coalesce(phone, '') AS phone, coalesce(address, '') AS address, id FROM companies UNION ALL
        SELECT coalesce(form_url, ''), coalesce(phone, ''), coalesce(address, ''), b.id FROM company_batches b JOIN plan p ON p.id = b.id AND p.decision = 'insert')
        SELECT count(*) AS n, count(*) FILTER (f.form_url <> '' OR b.form_url <> '') AS forms, count(*) FILTER (f.phone <> '' OR b.phone <> '') AS phones, count(*) FILTER (f.address <> '' OR b.address <> '') AS addresses
        FROM full_ f LEFT JOIN (SELECT p.target_id, x.form_url, x.phone, x.address FROM plan p JOIN company_batches x ON x.id = p.id WHERE p.decision = 'upgrade' AND p.target_id IN (SELECT id FROM companies)) b ON b.target_id = f.id""",
    "document_contacts": f"SELECT doc_id, {_email('t')} AS email, {_phone('t')} AS phone, {_address('t')} AS address FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "page_texts": f"{_WITH_PAGE} SELECT id, {_TITLE} AS title, {_VISIBLE} AS text, {_HEADS} AS headings, ({_SHORT})[1:80] AS short FROM c",
    "page_contacts": f"""{_WITH_PAGE} SELECT id, {_email('h')} AS email, CASE WHEN {_x('h', f'(?i)mailto:({_MAIL})')} <> '' THEN {_x('h', f'(?i)mailto:({_MAIL})')} WHEN {_m(_x('h', f'(?i)({_MAIL})'), 'noreply|no-reply|example|test', 'i')} THEN '' ELSE {_x('h', f'(?i)({_MAIL})')} END AS email2,
        {_phone('h')} AS phone, {_first_phone('h')} AS first_phone, len({_faxes('h')}) AS faxes, {_address('h')} AS address FROM c""".replace("email2", "first_email"),
    "structured_contacts": f"""{_WITH_LD}, v AS (SELECT *, CASE WHEN k <> 1 AND coalesce(phone, '') <> '' THEN phone WHEN k <> 0 AND {_m(_re('phone', (r'\D', '')), '^0[0-9]{9,10}$')} THEN {_EDGES} ELSE '' END AS p FROM w),
        t AS (SELECT *, {_re("translate(p, '（）－–—', '()---')", (r'[\s\x{3000}\x{A0}\x{0B}]+', ''))} AS q FROM v)
        SELECT id, CASE WHEN k <> 1 THEN 'ld.' || coalesce(email, '') ELSE {_email('h')} END AS email,
        CASE WHEN q = '' THEN {_phone('h')} WHEN {_m(_re('q', (r'\D', '')), '^0[0-9]{9,10}$')} OR starts_with(q, '+81') THEN q ELSE '' END AS phone,
        CASE WHEN k <> 1 AND coalesce(area, '') || coalesce(address, '') <> '' THEN array_to_string(list_filter([area, address], lambda x: x <> ''), ' ')
          WHEN {_n(_edges('area'))} <> '' AND {_n(_edges('address'))} <> '' THEN {_edges('area')} || ' ' || {_edges('address')} ELSE {_address('h')} END AS address FROM t""",
    "page_links": f"{_LINK} SELECT id, 0 AS pos, url, 'お問い合わせ' AS text, false AS in_footer, true AS in_nav, host FROM l",
    "best_links": f"{_SCORED} SELECT id, 1 AS rank, url, 'お問い合わせ' AS text, score FROM b",
    "page_forms": f"{_SCORED} SELECT c.id, b.url AS form_url, CASE WHEN b.url IS NOT NULL THEN 'link' END AS source FROM companies c LEFT JOIN b ON b.id = c.id",
    "page_checks": f"""{_WITH_PAGE}, t AS (SELECT id, h, lower({_TITLE}) AS title FROM c) SELECT id, {_m('h', r'lin[.]ee/|page[.]line[.]me/|accountpage[.]line[.]me/|liff[.]line[.]me/', 'i')} AS form_page,
        CASE WHEN {_m('title', '送信完了|ありがとうございます|受け付けました|thank you|submission complete|success')} THEN 'done'
          WHEN {_m('title', 'ニュース|news|プレスリリース|お知らせ一覧|アクセス|access|採用|recruit|サービス一覧|実績|ブログ|blog|プライバシー|privacy|利用規約|terms|サイトマップ|sitemap|会社概要|ギャラリー|gallery|イベント一覧|セミナー一覧|webinar|workshop|会員登録|メンバー登録|資料ダウンロード|ホワイトペーパー|whitepaper|free.*download|無料ダウンロード')} THEN 'other' ELSE '' END AS refused, false AS inline FROM t""",
    "type_hints": f"""{_WITH_PAGE} SELECT id, CASE WHEN coalesce(form_url, '') <> '' AND {_m(_n('form_url'), r'lin[.]ee/|page[.]line[.]me/|accountpage[.]line[.]me/|liff[.]line[.]me/', 'i')} THEN 'LINE'
        WHEN coalesce(form_url, '') <> '' AND {_has_any(_host_key('form_url'), lists.BOOKING_HOSTS)} THEN 'booking' WHEN {_has_any('lower(h)', lists.BOOKING_WORDS)} THEN 'booking' WHEN coalesce(form_url, '') <> '' THEN 'inquiry' END AS hint FROM c""",
    "probe_plans": f"""WITH s AS (SELECT id, CASE WHEN sheets_id IS NULL THEN 'wix' ELSE '' END AS b FROM projects), p AS ({_PROBES}),
        r AS (SELECT s.id, p.path, p.o, regexp_replace(lower(p.path), '/$', '') AS same FROM s, p WHERE regexp_replace(lower(p.path), '/$', '') <> '/contact'
          AND NOT (s.b = 'wix' AND ({_m('p.path', r'[.](cgi|pl|php|html?|aspx?)([?]|$)|/cgi(-bin)?/', 'i')} OR starts_with(p.path, '/pages/')))),
        u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id, same ORDER BY o) = 1)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) AS ord, path FROM u QUALIFY ord <= 28""",
    "word_classes": f"SELECT doc_id, CASE WHEN a > b THEN 'booking' WHEN b > 0 THEN 'inquiry' ELSE 'unknown' END AS label FROM (SELECT doc_id, {_count('t', lists.RULE_BOOKING)} AS a, {_count('t', lists.RULE_INQUIRY)} AS b FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))",
    "page_classes": f"""SELECT doc_id, CASE WHEN a >= 2 THEN 'booking' WHEN b > 0 THEN 'inquiry' ELSE 'unknown' END AS label FROM (SELECT doc_id, {_count('h', lists.PAGE_BOOKING)} AS a, {_count('t', lists.PAGE_INQUIRY)} AS b
        FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(text, '')) || chr(31) || lower(coalesce(title, '')) AS h FROM documents))""",
    "reclassified": f"""SELECT id, coalesce(CASE WHEN {_line('u')} THEN 'LINE' WHEN ({_on(_host_key('u'), _BOOKING)} OR ({_on(_host_key('u'), ['coubic.com'])} AND {_m(f'lower({_path("u")})', '/(book|express)')})) AND coalesce(form_type, '') IN ('inquiry', 'unknown', '')
        THEN 'reservation' ELSE form_type END, '') AS new_type FROM (SELECT *, {_MOVED} AS u FROM companies)""",
    "stored_types": f"SELECT CASE WHEN {_line('form_url')} THEN 'LINE' ELSE coalesce(form_type, '') END AS form_type, count(*) AS n FROM companies GROUP BY 1",
    "model_identity": "SELECT id, coalesce(form_type, '') AS type FROM companies",
    "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_sessions": """SELECT user_id, session, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::bigint AS session
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY 1, 2""",
    "events_in_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "longest_runs": """SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) FILTER (hit) AS n FROM (SELECT user_id, event_type <> 'click' AS hit,
        sum(CASE WHEN event_type <> 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) GROUP BY 1, 2) GROUP BY 1""",
    "latest_values": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(CASE WHEN value > 50 THEN event_id END) AS big FROM events GROUP BY 1",
    "event_props": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events",
    "newest_projects": "SELECT id, created_at FROM projects ORDER BY created_at DESC NULLS LAST, id LIMIT 20",
    "oldest_unsent": "SELECT id, collected_at FROM companies WHERE status = '未送信' ORDER BY collected_at ASC NULLS LAST, id LIMIT 25",
    "run_lookup": "SELECT id, project_id FROM project_runs WHERE project_id = (SELECT min(project_id) FROM project_runs) ORDER BY created_at DESC NULLS LAST, id LIMIT 1",
    "runs_of_project": "SELECT id, created_at FROM project_runs WHERE project_id = (SELECT DISTINCT project_id FROM project_runs WHERE project_id IS NOT NULL ORDER BY project_id LIMIT 1 OFFSET 1)",
    "queue_idle": "SELECT count(*) FILTER (status IN ('running', 'pending')) = 0 AS idle FROM project_runs",
    "sheet_hosts": f"SELECT DISTINCT host FROM (SELECT {_host_key('"HP URL"')} AS host FROM sheet_row) WHERE host <> ''",
    "full_pages": "SELECT project_id, id, coalesce(raw_search_count, 0) AS size FROM project_runs QUALIFY coalesce(max(CASE WHEN coalesce(raw_search_count, 0) < 600 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0",
    "enough_runs": "SELECT project_id, id, coalesce(items_written, 0) AS items FROM project_runs QUALIFY coalesce(sum(coalesce(items_written, 0)) OVER (PARTITION BY project_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2000",
    "known_areas": """SELECT row_no, coalesce("エリア", '') = '' OR "エリア" IN (SELECT area FROM companies WHERE area IS NOT NULL) AS valid FROM sheet_row""",
    "run_payloads": """SELECT run_id, part, count(*) AS n, md5(string_agg(id || '=' || coalesce(name, ''), ',' ORDER BY id)) AS digest
        FROM (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY id) - 1) // 100 AS part FROM companies) GROUP BY run_id, part""",
    "events_limited": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, n, true AS accepted, [t] AS log FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.n, len(list_filter(r.log, lambda x: x > e.t - 86400000000)) < 2,
            CASE WHEN len(list_filter(r.log, lambda x: x > e.t - 86400000000)) < 2 THEN list_append(list_filter(r.log, lambda x: x > e.t - 86400000000), e.t) ELSE list_filter(r.log, lambda x: x > e.t - 86400000000) END
          FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT event_id, accepted FROM r""",
    "sending_gates": "SELECT CASE WHEN coalesce(form_url, '') = '' THEN 'no form' WHEN form_type = 'reservation' THEN 'reservation' WHEN status = '送信済み' THEN 'sent' ELSE 'else' END AS gate, count(*) AS n FROM companies GROUP BY 1",
    "history_search": "SELECT r.id, label FROM project_runs r LEFT JOIN projects p ON p.id = r.project_id WHERE parent_run_id IS NULL AND status = 'success' AND (contains(lower(label), '東京都') OR contains(lower(coalesce(p.name, r.project_id)), '東京都'))",
    "recovered_jobs": f"SELECT 'job-' || id AS id, CASE WHEN run_type = 'single' THEN CASE WHEN status IN {_GOOD} THEN 'completed' WHEN status = 'error' THEN 'failed' ELSE 'active' END ELSE 'waiting' END AS status FROM project_runs",
    "run_metrics": """SELECT count(*) AS total, count(*) FILTER (coalesce(hp_url, '') <> '') AS success, count(*) FILTER (coalesce(hp_url, '') = '') AS errors, count(*) FILTER (coalesce(form_url, '') <> '') AS found,
        round(100.0 * count(*) FILTER (coalesce(form_url, '') <> '') / count(*))::bigint AS rate, count(*) FILTER (form_type = 'inquiry') AS inquiry, count(*) FILTER (form_type = 'reservation') AS booking, count(*) FILTER (form_type = 'LINE') AS line, 0::bigint AS avg_ms FROM companies""",
    "outcome_counts": "SELECT CASE WHEN coalesce(form_url, '') = '' THEN 'no_form' WHEN form_type = 'reservation' THEN 'skipped_booking' ELSE 'written' END AS outcome, count(*) AS n FROM companies GROUP BY 1",
    "target_count": "SELECT sum(coalesce(len(search_target.keywords), 0) * greatest(coalesce(len(search_target.areas), 0), 1))::bigint AS targets FROM project_runs",
    "run_speed": "SELECT id, coalesce(CASE WHEN m > 0 THEN floor(items_written * 60000 / m)::bigint END, -1) AS per_minute FROM (SELECT *, epoch_ms(try_cast(completed_at AS timestamptz)) - epoch_ms(try_cast(created_at AS timestamptz)) AS m FROM project_runs)",
    "top_form_hosts": f"""WITH h AS (SELECT {_host_key('form_url')} AS host, count(*) AS n FROM companies GROUP BY 1 HAVING host <> '')
        SELECT host, n, round(100.0 * n / (SELECT sum(n) FROM h))::bigint AS percent FROM h ORDER BY n DESC, host LIMIT 15""",
    "type_shares": "SELECT industry, " + ", ".join(f"count(*) FILTER (coalesce(form_type, '') = {_q(v)}) AS n_{v.lower() or 'none'}" for v in ("inquiry", "LINE", "reservation", "unknown", "")) + ", count(*) AS n FROM companies GROUP BY industry",
    "area_coverage": """SELECT e.area, coalesce(s.n, 0) AS stored, e.estimate, round(100.0::double * coalesce(s.n, 0) / e.estimate, 1) AS percent FROM (SELECT area, count(*) * 2 + 1 AS estimate FROM companies GROUP BY area) e
        LEFT JOIN (SELECT area, count(*) AS n FROM companies WHERE form_url <> '' GROUP BY area) s ON s.area = e.area""",
    "label_suggestions": "SELECT DISTINCT label AS value FROM project_runs WHERE contains(lower(label), '歯科') ORDER BY value LIMIT 8",
    "project_run_ids": "SELECT unnest(run_ids) AS id FROM projects",
    "edited_ids": "SELECT id, array_to_string(list_concat(run_ids[2:], ['run-new']), ',') AS ids FROM projects",
    "capped_texts": "SELECT doc_id, coalesce(text[1:80], '') AS head FROM documents",
}
