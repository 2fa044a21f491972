"""DuckDB SQL of the queries of what comes in and goes out, written apart from their plans."""

from __future__ import annotations

from leadloom.plans.core_sql import _AT, _store_key

_K = "ascii(right(id, 1))"
_LAT, _LNG = f"(35.0::double + {_K} / 100.0::double)", "(139.0::double + ascii(id[-2]) / 100.0::double)"
_ENDED, _BUSY = ("(SELECT min(id) FROM project_runs WHERE status NOT IN ('running', 'pending'))", "(SELECT min(id) FROM project_runs WHERE status IN ('running', 'pending'))")

SQL = {
    "config_read": "SELECT id, search_target.industry AS industry, coalesce(len(search_target.areas), 0) AS areas, status = 'success' AS enabled FROM project_runs",
    "config_edited": """WITH c AS (SELECT 'run-' || replace(id[10:17], '-', '') AS id, name AS label, description IS NOT NULL AS enabled FROM projects)
        SELECT id, label, CASE WHEN id = 'run-0113002' THEN NOT enabled ELSE enabled END AS enabled FROM c WHERE id <> 'run-0105001'
        UNION ALL SELECT 'run-' || (max(replace(id, 'run-', '')::int) + 1), '新規', true FROM c""",
    "callbacks": f"SELECT id, coalesce(name, '') AS name, coalesce(hp_url, '') AS hp_url, coalesce(phone, '') AS phone FROM companies WHERE {_K} % 7 <> 0 AND (trim(coalesce(name, ''), ' ') <> '' OR trim(coalesce(hp_url, ''), ' ') <> '')",
    "search_jobs": f"SELECT id, CASE WHEN {_K} % 2 = 0 THEN 'done' ELSE 'running' END AS status, CASE WHEN {_K} % 2 = 0 THEN 1 ELSE 0 END::bigint AS n, CASE WHEN {_K} % 2 = 0 THEN coalesce(hp_url, '') ELSE '' END AS link FROM companies",
    "arrivals": "SELECT run_id, count(*) AS n FROM company_batches GROUP BY run_id",
    "appended": "SELECT CASE WHEN ord % 2 = 0 THEN 'a' ELSE 'b' END AS batch, count(*) AS n, sum(ord)::bigint AS ords FROM company_batches GROUP BY 1",
    "control_table": "SELECT id, name FROM projects WHERE id > 'proj-20260110'",
    "csv_export": "SELECT 1::bigint AS headers, count(*) + 1 AS lines, 1::bigint AS marked FROM companies",
    "camel_rows": 'SELECT id, hp_url AS "hpUrl", form_url AS "formUrl", normalized_form_url AS "normalizedFormUrl", collected_at AS "collectedAt" FROM companies',
    "defaulted": "SELECT id, coalesce(nullif(status, ''), '未送信') AS status, coalesce(nullif(form_type, ''), 'unknown') AS form_type, coalesce(phone, '') AS phone, coalesce(notes, '') AS notes FROM companies",
    "request_defaults": """SELECT id, coalesce(nullif(search_target."keywordMode", ''), 'or') AS mode, coalesce(nullif(search_target."searchMode", ''), 'area') AS search, coalesce(nullif(search_target.area, ''), '東京都') AS area,
        CASE WHEN len(search_target.keywords) > 0 THEN array_to_string(search_target.keywords, ',') ELSE coalesce(search_target.industry, '') END AS words FROM project_runs""",
    "keyword_lists": "SELECT id, array_to_string(list_filter([trim(industry, ' '), trim(area, ' '), trim(form_type, ' ')], lambda w: w <> ''), '|') AS words FROM companies",
    # the industry goes before proposed words that don't hold it; synonyms of a word before are left out; three words at most
    "proposed_words": f"""SELECT id, CASE WHEN k = 3 THEN industry WHEN industry = head THEN CASE k WHEN 5 THEN '税理士|会計事務所|税理士' ELSE head END
          ELSE industry || '|' || CASE k WHEN 5 THEN '税理士|会計事務所' ELSE head END END AS words
        FROM (SELECT id, industry, {_K} % 6 AS k FROM companies WHERE coalesce(industry, '') <> '') JOIN (VALUES (0, '歯科'), (1, '美容室'), (2, '整骨院'), (3, ''), (4, 'カフェ'), (5, '税理士')) h(k, head) USING (k)""",
    "words_once": f"SELECT id, words FROM (SELECT id, {_K} % 6 AS k FROM companies) JOIN (VALUES (0, '歯科'), (1, '美容室'), (2, '整骨院'), (3, ''), (4, 'カフェ'), (5, '税理士|会計事務所|税理士')) h(k, words) USING (k)",
    "merged_contacts": """SELECT c.id, coalesce(nullif(s.p, ''), c.phone, '') AS newer, coalesce(nullif(c.phone, ''), s.p, '') AS gaps
        FROM companies c JOIN (SELECT id, "電話番号" AS p FROM sheet_row WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1) s ON s.id = c.id""",
    "model_replies": f"SELECT id, CASE {_K} % 4 WHEN 0 THEN CASE WHEN form_type IN ('inquiry', 'booking', 'LINE', 'recruitment', 'unknown') THEN form_type ELSE 'unknown' END WHEN 1 THEN 'booking' ELSE 'unknown' END AS type FROM companies",
    "model_types": "SELECT id, CASE WHEN contains(coalesce(notes, ''), '送信') THEN 'booking' ELSE coalesce(form_type, '') END AS type FROM companies",
    "model_candidates": "SELECT id FROM companies WHERE coalesce(form_url, '') <> '' AND coalesce(form_type, '') NOT IN ('LINE', 'booking', 'recruitment')",
    "random_ids": "SELECT count(*) AS rows, count(*) AS ids, count(*) AS prefixed FROM companies",
    "near_points": f"""SELECT id, printf('%.4f', {_LAT}) || ', ' || printf('%.4f', {_LNG}) AS point,
        acos(least(1.0, sin(radians({_LAT})) * sin(radians(35.681236)) + cos(radians({_LAT})) * cos(radians(35.681236)) * cos(radians({_LNG} - 139.767125)))) * 6371.0 <= 20.0 AS near FROM companies""",
    "rekeyed": f"SELECT id, fresh_key FROM (SELECT id, {_store_key('form_url')} AS fresh_key FROM companies) QUALIFY fresh_key = '' OR row_number() OVER (PARTITION BY fresh_key ORDER BY id) = 1",
    "query_limits": """SELECT id, CASE WHEN coalesce(search_target."maxResults", 0) <= 0 THEN 60 ELSE ceil(search_target."maxResults"::double / greatest(coalesce(len(search_target.areas), 0), 1) / greatest(coalesce(len(search_target.keywords), 0), 1))::bigint END AS most FROM project_runs""",
    "capped_queries": "SELECT id FROM companies QUALIFY row_number() OVER (PARTITION BY industry, area ORDER BY id) <= 40",
    "concatenated_parts": "SELECT id, 0::bigint AS part FROM companies WHERE industry = '歯科' UNION ALL SELECT id, 1 FROM companies WHERE industry = 'カフェ' UNION ALL SELECT id, 2 FROM companies WHERE industry = '歯科'",
    "areas_with_failures": """SELECT row_no, coalesce(a, '') = '' OR row_no % 2 = 0 OR a IN (SELECT area FROM companies WHERE area IS NOT NULL) AS valid
        FROM (SELECT row_no, "エリア" || CASE WHEN row_no % 3 = 0 THEN 'x' ELSE '' END AS a FROM sheet_row)""",
    "grid_without": "SELECT count(*) AS total, 0::bigint AS forms, 0::bigint AS phones, count(*) FILTER (coalesce(email, '') <> '') AS emails FROM companies WHERE coalesce(form_url, '') = ''",
    "update_affected": "SELECT count(*) AS affected FROM companies WHERE status = '未送信' AND coalesce(form_url, '') <> ''",
    "maintained_idle": f"SELECT count(*) FILTER (NOT coalesce({_AT} < TIMESTAMPTZ '2026-04-01 00:00:00+00' AND status IN ('送信済み', 'スキップ', 'エラー'), false)) AS n, 0::bigint AS part FROM companies UNION ALL SELECT count(*), 1 FROM companies",
    "runs_removed": f"SELECT {_ENDED} AS run_id, count(*) AS affected FROM companies WHERE run_id = {_ENDED}",
    "rows_after_removal": f"SELECT run_id, count(*) AS n FROM companies WHERE run_id IS DISTINCT FROM {_ENDED} GROUP BY run_id",
    "next_project_by_count": "SELECT 'proj-202601' || lpad((count(*) + 1)::varchar, 3, '0') AS next_id FROM projects WHERE starts_with(id, 'proj-202601')",
    "execution_tokens": f"SELECT id, CASE WHEN {_K} % 5 > 1 THEN coalesce(tokens_input, 0) + 11 ELSE -1 END AS tokens_input, CASE WHEN {_K} % 5 > 1 THEN coalesce(tokens_output, 0) + 2 ELSE -1 END AS tokens_output FROM project_runs",
}
