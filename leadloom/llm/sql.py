"""DuckDB SQL of the queries SQL can express."""

import unicodedata

# Fixed values, written here again so that the SQL doesn't lean on the operator's: characters drawn alike, values that stand for none.
_ALIKE = [
    "-‐‑‒–—―−⁃－ーｰ一", "〇○◯",
    "オ才", "タ夕", "ト卜", "ロ口", "ハ八", "ヘへ", "ベべ", "ペぺ", "ニ二", "エ工", "カ力", "ノ丿", "ヒ匕", "ム厶", "日曰",
    "AΑА", "BΒВ", "CСϹ", "EΕЕ", "HΗН", "IΙІ", "JЈ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "SЅ", "TΤТ", "XΧХ", "YΥҮ", "ZΖ",
    "aа", "cсϲ", "eе", "hһ", "iі", "jј", "oοо", "pр", "sѕ", "vν", "xх", "yу",
]
_PLACEHOLDERS = "'', '-', 'なし', '無し', '無', '非公開', '不明', '未定', '未設定', 'フォームのみ', 'フォームより', 'none', 'null', 'n/a', 'na', 'unknown'"

_L = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"


def _canon(c: str) -> str:
    c = f"coalesce({c}, '')"
    base, query, fragment = (f"regexp_extract({c}, '{p}', 1, 's')" for p in ("^([^?#]*)", r"^[^?#]*\?([^#]*)", "#(.*)$"))
    return f"{_L.format(base)} || array_to_string(list_sort(list_transform(string_split({query}, '&'), lambda x: {_L.format('x')})), '') || {_L.format(fragment)}"


_COPIES = f"WITH c AS (SELECT id, {_canon('form_url')} || chr(31) || {_canon('hp_url')} AS k FROM companies)"

_WHEN = r"""
CASE WHEN regexp_matches(t, '(?i)(Z|UTC|GMT|[+-]\d{1,2}:?\d{2})$') AND regexp_matches(t, ':\d') THEN t ELSE
  CASE WHEN regexp_matches(t, '^\d{4}[-/]\d{1,2}[-/]\d{1,2}$') THEN t || ' 00:00:00' ELSE t END || '+09:00' END
"""

_P2 = rf"""
WITH r AS (SELECT id, normalized_form_url AS g, trim(collected_at) AS t, phone, lower(trim(email)) AS email, form_type,
    regexp_replace(regexp_replace(translate(phone, '０１２３４５６７８９＋', '0123456789+'), '[^0-9+]', '', 'g'), '^\+81', '0') AS p
  FROM companies WHERE normalized_form_url <> ''),
s AS (SELECT *, coalesce(epoch_us(try_cast(regexp_replace(regexp_replace(replace({_WHEN}, '/', '-'), '-(\d)([- ])', '-0\1\2', 'g'), ' (\d):', ' 0\1:') AS timestamptz)), -4611686018427387904) AS ts,
    regexp_matches(p, '^[0-9]{{10,11}}$') AND regexp_matches(p, '[1-9]') AS ok_p,
    regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s.]+$') AND NOT regexp_matches(email, '\.(jpg|jpeg|png|gif|webp|svg|bmp|ico|avif|tif|tiff)$')
      AND NOT regexp_matches(email, '^no-?reply') AS ok_e,
    coalesce(form_type, '') NOT IN ('', 'unknown') AS ok_t FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY coalesce(ok_p, false) DESC, ts DESC, id) AS rp,
    row_number() OVER (PARTITION BY g ORDER BY coalesce(ok_e, false) DESC, ts DESC, id) AS re,
    row_number() OVER (PARTITION BY g ORDER BY ok_t DESC, ts DESC, id) AS rt FROM s)
SELECT min(id) AS keep_id, max(CASE WHEN rp = 1 AND ok_p THEN id ELSE '' END) AS phone_id,
  max(CASE WHEN re = 1 AND ok_e THEN id ELSE '' END) AS email_id, max(CASE WHEN rt = 1 AND ok_t THEN id ELSE '' END) AS form_type_id
FROM o GROUP BY g HAVING count(*) > 1
"""

_P10 = """
WITH g AS (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM documents WHERE length(text) >= 120),
w AS (SELECT DISTINCT doc_id, substring(text, i, 120) AS s FROM g)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id
"""

def _one_width(c: str) -> str:
    """Full-width ASCII and half-width kana as usual, by their compatibility forms."""
    kana = [chr(k) for k in range(0xFF66, 0xFF9E)]
    voiced = [(k + m, f) for k in kana for m in "\uff9e\uff9f" if len(f := unicodedata.normalize("NFKC", k + m)) == 1]
    for pair, one in voiced:
        c = f"replace({c}, '{pair}', '{one}')"
    single = [*kana, *(chr(k) for k in range(0xFF01, 0xFF5F))]
    to = "".join(unicodedata.normalize("NFKC", k) for k in single).replace("'", "''")
    return f"nfc_normalize(translate({c}, '{''.join(single)}', '{to}'))"


_BARE = rf"regexp_replace(lower({_one_width('text')}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_P9 = f"""
WITH i AS (SELECT item_id, {_BARE} AS t FROM benchmark), d AS (SELECT doc_id, {_BARE} AS t FROM documents),
iw AS (SELECT DISTINCT item_id, substring(t, k, 40) AS s FROM (SELECT *, unnest(range(1, length(t) - 38)) AS k FROM i WHERE length(t) >= 40)),
dw AS (SELECT doc_id, substring(t, k, 40) AS s FROM (SELECT *, unnest(range(1, length(t) - 38)) AS k FROM d WHERE length(t) >= 40))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.s = iw.s
"""

def _look(c: str) -> str:
    radicals = [chr(k) for k in range(0x2F00, 0x2FD6)]
    alike = {x: g[0] for g in _ALIKE for x in g[1:] if x != g[0]}
    c = rf"regexp_replace(regexp_replace({c}, '\p{{Cf}}', '', 'g'), '[\p{{Z}}\s\x{{0B}}\x{{85}}]', ' ', 'g')"
    c = f"translate({_one_width(c)}, '{''.join(radicals)}', '{''.join(unicodedata.normalize('NFKC', k) for k in radicals)}')"
    return f"trim(nfc_normalize(translate({c}, '{''.join(alike)}', '{''.join(alike.values())}')), ' ')"


_NO_VALUE = [_look(v.strip()) for v in _PLACEHOLDERS.split(",")]
_DIGITS = r"regexp_replace(regexp_replace(regexp_replace(look, '[^0-9+]', '', 'g'), '^\+81', '0'), '\+', '', 'g')"
_CASES = rf"""
WITH v AS (SELECT id, 'name' AS field, name AS value FROM companies UNION ALL SELECT id, 'phone', phone FROM companies UNION ALL SELECT id, 'address', address FROM companies),
l AS (SELECT id, field, value, {_look('value')} AS look FROM v WHERE value IS NOT NULL),
c AS (SELECT * FROM l WHERE lower(look) NOT IN ({", ".join(_NO_VALUE)})
  AND (field <> 'phone' OR (regexp_matches({_DIGITS}, '^[0-9]{{10,11}}$') AND regexp_matches({_DIGITS}, '[1-9]')))
  AND (field <> 'address' OR regexp_matches(regexp_replace(look, '^[〒T]?\s*[0-9]{{3}}[-ー ]?[0-9]{{4}}\s*', ''), '^[^0-9\s]+[0-9]')))
"""
_P3 = _CASES + "SELECT DISTINCT a.id AS id_a, b.id AS id_b, a.field FROM c a JOIN c b ON a.field = b.field AND a.look = b.look AND a.value <> b.value AND a.id < b.id"


_SHARED = """
WITH g AS (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM documents WHERE length(text) >= 120),
w AS (SELECT doc_id, i, md5(substring(text, i, 120)) AS s FROM g),
m AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 120)) AS pos FROM w SEMI JOIN m ON m.s = w.s)
SELECT doc_id, count(*) FILTER (pos - p > 1 OR p IS NULL) AS spans, count(*) AS shared FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM c) GROUP BY doc_id
"""

# Fixed values of p5's SQL, written here again so that it doesn't lean on the operator's.
_NO_PAGE = (
    "utm_[^=]*|fbclid|gclid|msclkid|ref|from|_ga|_gl|yclid|twclid|openqrmodal|oat_content|oat__ck|skin|site_code|page_id|igshid|igsh|mc_cid|mc_eid|srsltid|_hsenc|_hsmi|wbraid|gbraid|"
    "gad_source|gad_campaignid|dclid|ttclid|li_fat_id|_openstat|vero_id|mkt_tok|s_cid|ldtag_cl|phpsessid|jsessionid|sid|sessionid|session_id|aspsessionid|cfid|cftoken"
)


def _page(c: str) -> str:
    """The page of an address: host, path, other parameters in order."""

    def sub(c: str, *rules: tuple[str, str]) -> str:
        for a, b in rules:
            c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
        return c

    decoded = lambda c: f"coalesce(try(url_decode(replace({c}, '+', '%2B'))), {c})"
    u = sub(f"coalesce({c}, '')", (r"[\s\p{Z}\p{Cf}\p{Cc}]+", ""), ("(?i)&(amp;)+", "&"), ("#.*$", ""))
    u = sub(f"lower({u})", (r"^([a-z][a-z0-9+.-]*:)?/+", ""), (r"^[^/?@]*@", ""), (r"^www\.", ""), (r"^([^/?:]+):(80|443)?($|[/?])", r"\1\3"), (r"^([^/?]+)\.($|[/?])", r"\1\2"))
    path = decoded(f"regexp_extract({u}, '^([^?]*)', 1)")
    path = sub(f"lower({path})", (";[a-z]*sess(ion)?id=[^/]*", ""), (r"/(\./)+", "/"), ("/{2,}", "/"), (r"/(index|default)\.([sx]?html?|php\d?|aspx?|jsp|cgi)$", ""), ("/+$", ""))
    given = f"list_filter(regexp_split_to_array(regexp_extract({u}, '[?](.*)$', 1), '[&?]'), lambda p: p <> '' AND NOT regexp_matches(p, '^({_NO_PAGE})(=|$)'))"
    query = f"array_to_string(list_sort(list_distinct(list_transform({given}, lambda p: lower({decoded('p')})))), '&')"
    return f"CASE WHEN regexp_matches({path}, '^[^/]+\\.[^/]+') THEN {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END ELSE '' END"


#: Rows in order of arrival, one by one: what has been accepted so far is a list of pages.
_P5 = f"""
WITH RECURSIVE p AS (SELECT id, ord, kind || '|' || page AS page FROM (
  SELECT id, -1 AS ord, 'form' AS kind, {_page('form_url')} AS page FROM companies UNION ALL SELECT id, -1, 'home', {_page('hp_url')} FROM companies
  UNION ALL SELECT id, ord, 'form', {_page('form_url')} FROM company_batches UNION ALL SELECT id, ord, 'home', {_page('hp_url')} FROM company_batches) WHERE page <> ''),
known AS (SELECT DISTINCT n.id AS id_a, o.id AS id_b FROM p n JOIN p o ON n.page = o.page AND n.ord >= 0 AND o.ord < 0),
fresh AS (SELECT id, row_number() OVER (ORDER BY ord, id) AS turn, pages FROM (SELECT id, ord, list(page) AS pages FROM p WHERE ord >= 0 AND id NOT IN (SELECT id_a FROM known) GROUP BY id, ord)),
run AS (SELECT 0::bigint AS turn, ''::varchar AS id, false AS accepted, []::varchar[] AS taken
  UNION ALL SELECT f.turn, f.id, NOT list_has_any(r.taken, f.pages), CASE WHEN list_has_any(r.taken, f.pages) THEN r.taken ELSE list_concat(r.taken, f.pages) END FROM run r JOIN fresh f ON f.turn = r.turn + 1),
one AS (SELECT f.turn, f.id, unnest(pages) AS page FROM fresh f), won AS (SELECT one.* FROM one JOIN run ON run.id = one.id AND run.accepted)
SELECT id_a, id_b FROM known UNION SELECT one.id, won.id FROM one JOIN won ON won.page = one.page AND won.turn < one.turn
"""

SQL = {
    "p5_found": _P5,
    "p10_shared": _SHARED,
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p3_found": _P3,
    "p3_classes": _CASES + "SELECT DISTINCT c.id, c.field, m.class_id FROM c JOIN (SELECT field, look, min(id) AS class_id FROM c GROUP BY field, look HAVING count(DISTINCT value) > 1) m ON m.field = c.field AND m.look = c.look",
    "p9_found": _P9,
    "p10_found": _P10,
    "p2_found": _P2,
    "p7_found": _COPIES + " SELECT a.id AS id_a, b.id AS id_b FROM c a JOIN c b ON a.k = b.k AND a.id < b.id",
    "p7_members": _COPIES + " SELECT id, min(id) OVER (PARTITION BY k) AS keep_id FROM c QUALIFY count(*) OVER (PARTITION BY k) > 1",
    "p7_copies": _COPIES + " SELECT min(id) AS keep_id, count(*) AS copies FROM c GROUP BY k",
}
