"""Registry and the SQL forms of the standard views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CELLS = """cells AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                       CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d'))) AS event_id,
         'F' || l_suppkey AS file_origin,
         l_suppkey % 10 AS patient_id,
         CASE WHEN CAST(round(l_discount * 100) AS INT) >= l_partkey % 11 THEN 'Pathologique' ELSE 'Sain' END AS condition,
         l_partkey % 110 AS node_id,
         (l_partkey % 110) % 10 AS metacluster,
         l_extendedprice AS FSC_A,
         l_extendedprice * (1 - l_discount) AS FSC_H,
         l_quantity AS SSC_A,
         l_discount * 100 AS CD45,
         l_tax * 100 AS CD34,
         l_extendedprice / l_quantity AS HLA_DR
  FROM lineitem)"""

ACQ = """acq AS (
  SELECT event_id, event_type AS sample_id, user_id, ts, epoch_us(ts) / 1e6 AS time, value AS signal FROM events)"""

NODES = """counts AS (
  SELECT patient_id, node_id, count(*) AS n_total,
         count(*) FILTER (condition = 'Sain') AS n_sain,
         count(*) FILTER (condition = 'Pathologique') AS n_patho
  FROM cells GROUP BY 1, 2),
shares AS (
  SELECT *, CAST(sum(n_sain) OVER (PARTITION BY patient_id) AS BIGINT) AS total_sain,
         CAST(sum(n_patho) OVER (PARTITION BY patient_id) AS BIGINT) AS total_patho,
         100.0 * n_sain / n_total AS pct_sain, 100.0 * n_patho / n_total AS pct_patho,
         100.0 * n_sain / greatest(sum(n_sain) OVER (PARTITION BY patient_id), 1) AS pct_sain_global,
         n_patho / n_total AS node_purity
  FROM counts),
nodes AS (
  SELECT *, pct_patho > 10 AND pct_sain_global < 2.0 AS is_mrd_jf,
         CASE WHEN pct_sain > 0
              THEN pct_patho > pct_sain * 2.0 * greatest(total_sain / greatest(total_patho, 1), 1.0)
              ELSE n_patho >= 50 END AS is_mrd_flo,
         n_total >= 50 AND pct_patho > pct_sain AS is_mrd_eln
  FROM shares),
summary AS (
  SELECT patient_id, CAST(sum(n_patho) AS BIGINT) AS total_patho, CAST(sum(n_sain) AS BIGINT) AS total_sain,
         CAST(sum(n_patho) AS BIGINT) AS denominator,
         CAST(coalesce(sum(n_patho) FILTER (is_mrd_jf), 0) AS BIGINT) AS mrd_cells_jf,
         CAST(coalesce(sum(n_patho) FILTER (is_mrd_flo), 0) AS BIGINT) AS mrd_cells_flo,
         CAST(coalesce(sum(n_patho) FILTER (is_mrd_eln), 0) AS BIGINT) AS mrd_cells_eln,
         count(*) FILTER (is_mrd_jf) AS n_nodes_jf, count(*) FILTER (is_mrd_flo) AS n_nodes_flo,
         count(*) FILTER (is_mrd_eln) AS n_nodes_eln,
         100.0 * mrd_cells_jf / denominator AS mrd_pct_jf, 100.0 * mrd_cells_flo / denominator AS mrd_pct_flo,
         100.0 * mrd_cells_eln / denominator AS mrd_pct_eln,
         mrd_pct_eln >= 0.1 AS eln_positive, mrd_cells_eln > 0 AND mrd_pct_eln < 0.1 AS eln_low_level
  FROM nodes GROUP BY patient_id)"""


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` is the statement that must give the same rows."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def rounded(value, digits: int):
    """Rounded column without negative zero; in SQL ``round(x, d) + 0.0``."""
    return F.round(value, digits) + F.lit(0.0)
