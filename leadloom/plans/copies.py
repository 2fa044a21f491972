"""Problem 1 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.copies import Compared, differences
from leadloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, difference) between `companies` and `sheet_row`."""
    store, sheet = table(spark, sf_dir, "companies"), table(spark, sf_dir, "sheet_row")
    values = [Compared("status", store["status"], sheet["ステータス"]), Compared("run_id", store["run_id"], sheet["実行ID"])]
    return differences(store, sheet, store["id"], sheet["id"], values, "not_in_sheet", "not_in_companies", right_order=sheet["row_no"])


_WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"


def _clean(c: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', ''), '')"


P1_SQL = f"""
WITH s AS (
  SELECT id, {_clean('"ステータス"')} AS status, {_clean('"実行ID"')} AS run_id
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS rn FROM sheet_row WHERE id IS NOT NULL) WHERE rn = 1),
c AS (SELECT id, {_clean('status')} AS status, {_clean('run_id')} AS run_id FROM companies)
SELECT c.id, 'not_in_sheet' AS difference FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = c.id)
UNION ALL SELECT s.id, 'not_in_companies' FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE s.id = c.id)
UNION ALL SELECT c.id, 'status' FROM c JOIN s ON s.id = c.id WHERE c.status <> s.status
UNION ALL SELECT c.id, 'run_id' FROM c JOIN s ON s.id = c.id WHERE c.run_id <> s.run_id
"""
