"""DuckDB SQL of the queries over made-up sites: what comes out of each kind is written down by hand, rule by rule."""

from __future__ import annotations

_SITES = """
WITH s AS (SELECT id, ascii(right(id, 1)) % 12 AS k, CASE WHEN ascii(right(id, 1)) % 12 = 7 THEN 'https://coubic.com/' || id ELSE 'https://www.' || replace(id, '_', '-') || '.example/' END AS h,
  replace(id, '_', '-') || '.example' AS host FROM companies)
"""

# (kind, pos, tag, address, text, footer, nav, host)
_LINKS = """(VALUES
  (0, 0, 'a', '{h}contact/', 'お問い合わせ', true, false, ''), (1, 0, 'a', '{h}ja/inquiry.html?utm_source=x', 'Contact us', false, true, ''),
  (2, 0, 'onclick', '{h}toiawase/', 'お問い合わせ', false, false, ''), (2, 1, 'a', 'https://form.run/@x', 'フォーム 資料請求', false, false, 'form.run'),
  (3, 0, 'a', '{h}recruit/entry', '採用エントリー', false, false, ''), (5, 0, 'a', 'https://lin.ee/abc', 'LINEでお問い合わせ', false, false, 'lin.ee'), (6, 0, 'a', '{h}blog/', 'ブログ', false, false, ''),
  (8, 0, 'a', '{h}contact/', 'お問い合わせ', false, false, ''), (8, 1, 'a', '{h}mailform/', 'メール送信', false, false, ''),
  (9, 0, 'a', 'https://x.com/a', 'お問い合わせ', false, false, 'x.com'), (9, 1, 'a', '{h}yoyaku', 'ご予約', false, false, ''), (10, 0, 'a', '{h}contact', 'お問い合わせ', false, false, '')
) g(k, pos, kind, url, text, in_footer, in_nav, other)"""

# Scores: strong word 12 and path 8 and footer 4; usual word 10, path 8, navigation 2; usual word 10 and form service 15; a button's fixed 10; strong word 12 and service 15.
# Left out: recruitment and blog paths, a rejected host, a booking word.
_BEST = """(VALUES
  (0, 1, '{h}contact/', 'お問い合わせ', 12 + 8 + 4), (1, 1, '{h}ja/inquiry.html?utm_source=x', 'Contact us', 10 + 8 + 2), (2, 1, 'https://form.run/@x', 'フォーム 資料請求', 10 + 15),
  (2, 2, '{h}toiawase/', 'お問い合わせ', 10), (5, 1, 'https://lin.ee/abc', 'LINEでお問い合わせ', 12 + 15), (8, 1, '{h}contact/', 'お問い合わせ', 12 + 8), (8, 2, '{h}mailform/', 'メール送信', 10 + 8),
  (10, 1, '{h}contact', 'お問い合わせ', 12 + 8)
) g(k, rank, url, text, score)"""

_FORMS = """(VALUES
  (0, '{h}contact/', 'link'), (1, '{h}ja/inquiry.html?utm_source=x', 'link'), (2, 'https://form.run/@x', 'link'), (3, '{h}', 'inline'), (4, '', ''), (5, 'https://lin.ee/abc', 'link'), (6, '', ''),
  (7, '', ''), (8, '{h}contact/', 'link'), (9, '', ''), (10, '{h}contact', 'link'), (11, '{h}', 'script')
) g(k, form_url, source)"""

# 8: the best link is gone, the next is a form; 6: the third probe is the first page of its own; 9: nothing.
_FOUND = """(VALUES
  (0, '{h}contact/', 'primary'), (1, '{h}ja/inquiry.html', 'primary'), (2, 'https://form.run/@x', 'primary'), (3, '{h}', 'primary'), (4, 'https://beauty.hotpepper.jp/sln/x/', 'redirect'),
  (5, 'https://lin.ee/abc', 'line'), (6, '{h}otoiawase/', 'probe'), (7, '{h}', 'booking'), (8, '{h}mailform/', 'fallback'), (10, '{h}contact', 'primary'), (11, '{h}', 'primary')
) g(k, form_url, stage)"""

# (kind, path, final path, valid as a target, why it is no page of its own)
_PAGES = """(VALUES
  (0, 'contact/', 'contact/', true, ''), (1, 'ja/inquiry.html?utm_source=x', 'ja/inquiry.html?utm_source=x', true, ''), (2, 'toiawase/', '', false, 'home'), (6, 'contact', 'contact', false, 'error'),
  (6, 'otoiawase', 'otoiawase/?utm_source=a', true, ''), (6, 'inquiry', 'inquiry', false, 'title'), (8, 'contact/', 'contact/', false, 'error'), (8, 'mailform/', 'mailform/', true, ''), (10, 'contact', 'contact', true, '')
) g(k, path, final, valid, why)"""

_MARKS = """(VALUES
  (0, '', false, '', '', '', ''), (1, '', false, '', '', '/ja/', ''), (2, '', false, '', '', '', ''), (3, '', false, '', '', '', ''), (4, '', false, '', '', '', ''), (5, '', false, '', '', '', ''),
  (6, '', false, '', 'website', '', ''), (7, '', false, '/top.html', '', '', ''), (8, 'wordpress', false, '', '', '', ''), (9, '', false, '', '', '', ''), (10, '', true, '', '', '', ''), (11, '', false, '', '', '', '/index/')
) g(k, builder, shell, refresh, og_type, base, canonical)"""

# A page is sure to be a form's if it names a form service (2, 5, 11); 3 has a form of its own.
_CHECKS = """(VALUES
  (0, false, false, '{h}'), (1, false, false, '{h}ja/'), (2, true, false, '{h}'), (3, true, true, '{h}'), (4, false, false, '{h}'), (5, true, false, '{h}'), (6, false, false, '{h}'), (7, false, false, '{h}'),
  (8, false, false, '{h}'), (9, false, false, '{h}'), (10, false, false, '{h}'), (11, true, false, '{h}index/')
) g(k, form_page, inline, base)"""

# Plain form; purchase; purchase words beside an inquiry word; password; comment box; inquiry word with a phone field; reservation; a search box before a form.
_FORM_CASES = "(VALUES (0, true), (1, false), (2, true), (3, false), (4, false), (5, true), (6, false), (7, true)) g(k, form_page)"

_DONE, _OTHER = (
    "送信完了|ありがとうございます|受け付けました|thank you|submission complete|success",
    "ニュース|news|プレスリリース|お知らせ一覧|アクセス|access|採用|recruit|サービス一覧|実績|ブログ|blog|プライバシー|privacy|利用規約|terms|サイトマップ|sitemap|会社概要|ギャラリー|gallery|イベント一覧|セミナー一覧|"
    "webinar|workshop|会員登録|メンバー登録|資料ダウンロード|ホワイトペーパー|whitepaper|free.*download|無料ダウンロード",
)


def _of(golden: str, columns: str) -> str:
    return f"{_SITES} SELECT {columns} FROM s JOIN {golden} USING (k)"


def _at(c: str) -> str:
    return f"replace({c}, '{{h}}', h) AS {c}"


SQL = {
    "site_links": _of(_LINKS, f"id, pos, kind, {_at('url')}, text, in_footer, in_nav, CASE WHEN other = '' THEN host ELSE other END AS host"),
    "site_best_links": _of(_BEST, f"id, rank, {_at('url')}, text, score"),
    "site_forms": _of(_FORMS, f"id, {_at('form_url')}, source"),
    "site_found_forms": _of(_FOUND, f"id, {_at('form_url')}, stage"),
    "site_targets": _of(_PAGES, "h || path AS id, h || final AS final_url, valid"),
    "site_probes": _of(_PAGES, "h || path AS url, why"),
    "site_marks": _of(_MARKS, "id, builder, shell, refresh, og_type, base, canonical"),
    "site_checks": _of(_CHECKS, f"id, form_page, inline, {_at('base')}"),
    "form_checks": f"SELECT id, form_page FROM companies JOIN {_FORM_CASES} ON k = ascii(right(id, 1)) % 8",
    "refused_pages": f"SELECT doc_id, CASE WHEN regexp_matches(t, '{_DONE}') THEN 'done' WHEN regexp_matches(t, '{_OTHER}') THEN 'other' ELSE '' END AS refused FROM (SELECT doc_id, lower(coalesce(title, '')) AS t FROM documents)",
    "simple_scores": """SELECT id, 10 * (contains(n, 'contact')::int + contains(n, 'inquiry')::int + contains(n, 'hair')::int + contains(n, '美容')::int) + 5 * (contains(u, 'contact')::int + contains(u, 'inquiry')::int + contains(u, 'hair')::int
        + contains(u, '美容')::int) + CASE WHEN regexp_matches(u, 'contact|inquiry|form|mail|message') THEN 8 ELSE 0 END + CASE WHEN contains(u, 'toiawase') THEN 8 ELSE 0 END::bigint AS score
        FROM (SELECT id, lower(coalesce(name, '')) AS n, lower(coalesce(form_url, '')) AS u FROM companies)""",
    "form_element_pages": r"SELECT doc_id, regexp_matches(coalesce(text, ''), '\d{2,4}-\d{2,4}-\d{4}') OR contains(coalesce(text, ''), '円') OR regexp_matches(coalesce(text, ''), 'mail', 'i') AS hit FROM documents",
    "booking_fallbacks": """SELECT id, CASE WHEN f = '' AND b THEN 'https://www.coubic.com/' || id ELSE f END AS form_url, f = '' AND b AS by_booking
        FROM (SELECT id, CASE WHEN area = '東京都' THEN coalesce(form_url, '') ELSE '' END AS f, ascii(right(id, 1)) % 3 = 0 AS b FROM companies)""",
    "length_ratios": """SELECT b.doc_id, length(a.t) > 200 AND length(b.t) > 200 AND abs(length(a.t) - length(b.t)) < 0.03 * greatest(length(a.t), length(b.t)) AS near
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) a JOIN (SELECT doc_id, coalesce(text, '') AS t FROM documents) b ON b.doc_id = a.doc_id + 1""",
    "followed_pages": """WITH RECURSIVE h AS (SELECT id AS url, coalesce(parent_run_id, project_id) AS location FROM project_runs UNION ALL SELECT id, NULL FROM projects),
        w AS (SELECT url, url AS place, 0 AS hops FROM h UNION ALL SELECT w.url, h.location, w.hops + 1 FROM w JOIN h ON h.url = w.place WHERE h.location IS NOT NULL)
        SELECT 'https://r.example/' || url AS url, 'https://r.example/' || arg_max(place, hops) AS final_url, max(hops) AS hops FROM w GROUP BY url""",
    "page_bytes": """SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 THEN '<meta charset="UTF-8">' ELSE '' END || coalesce(text, '')) AS digest FROM documents""",
}
