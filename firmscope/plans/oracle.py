"""Independent SQL statements of the deterministic pipeline core, written for
DuckDB over the driver's tables. They brute-force what the Spark plans do at
scale (e.g. nearest neighbours by full distance ranking), so a match is an
independent check of the Spark operators.

``with_prepared(select)`` prefixes a statement with the CTE chain that ends in
``prepared`` (one row per company, every pipeline column except k-means and
forest outputs).
"""

from __future__ import annotations

ADAPTER_SQL = """
o AS (
  SELECT o_custkey, COUNT(*) AS n_orders, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS tot
  FROM orders GROUP BY o_custkey),
raw AS (
SELECT c.c_custkey AS company_id, c.c_name AS company_name, r.r_name AS region, n.n_name AS country,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(1000 + (c.c_custkey * 37) % 8900 AS VARCHAR(8)) END AS sic_code,
  'Industry ' || c.c_mktsegment AS sic_description,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 5 = 0 THEN 'Parent' WHEN c.c_custkey % 5 IN (1,2) THEN 'Subsidiary'
       WHEN c.c_custkey % 5 = 3 THEN 'Branch' WHEN c.c_custkey % 10 = 9 THEN 'Headquarters' ELSE 'Single Location' END AS entity_type,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'Parent#' || CAST(c.c_custkey % 97 AS VARCHAR(8)) END AS parent_company,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE CAST(1900 + (c.c_custkey * 7) % 126 AS VARCHAR(8)) END AS year_found,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'Yes' WHEN c.c_custkey % 4 = 1 THEN 'No' WHEN c.c_custkey % 28 = 2 THEN '1' END AS is_domestic_ultimate,
  CASE WHEN c.c_custkey % 6 = 5 THEN NULL
       ELSE '$' || CAST(CAST(o.tot * CASE c.c_custkey % 6 WHEN 0 THEN 0.01 WHEN 1 THEN 0.1 WHEN 2 THEN 1 WHEN 3 THEN 10 ELSE 100 END AS DECIMAL(18,2)) AS VARCHAR(32)) END AS revenue_usd,
  CASE WHEN c.c_custkey % 7 = 0 THEN '0' ELSE CAST(o.n_orders * (1 + c.c_custkey % 40) AS VARCHAR(16)) END AS employees_total,
  CAST(1 + c.c_custkey % 40 AS VARCHAR(16)) AS employees_single_site,
  CAST((c.c_custkey * 13) % 250 AS VARCHAR(16)) AS corporate_family_members,
  CASE WHEN c.c_acctbal > 6000 THEN CAST(CAST(c.c_acctbal AS DECIMAL(18,2)) AS VARCHAR(32)) END AS market_value_usd,
  CASE WHEN c.c_custkey % 8 < 3 THEN CAST((c.c_custkey % 900) * 1000 AS VARCHAR(16)) END AS it_spend
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN o ON o.o_custkey = c.c_custkey)"""

_NUM = "TRY_CAST(regexp_replace({c}, '[^0-9.]', '', 'g') AS DOUBLE)"

CORE_SQL = (
    "WITH "
    + ADAPTER_SQL
    + f""",
c1 AS (
  SELECT *,
    {_NUM.format(c='revenue_usd')} AS revenue_raw,
    {_NUM.format(c='employees_total')} AS employees_raw,
    COALESCE({_NUM.format(c='employees_single_site')}, 0.0) AS employees_site_clean,
    COALESCE({_NUM.format(c='corporate_family_members')}, 0.0) AS corporate_family_size,
    CASE WHEN lower(is_domestic_ultimate) IN ('yes', 'true', '1') THEN 1 ELSE 0 END AS is_domestic_ultimate_clean,
    TRY_CAST(year_found AS DOUBLE) AS year_found_clean,
    COALESCE({_NUM.format(c='market_value_usd')}, 0.0) AS market_value_clean,
    COALESCE({_NUM.format(c='it_spend')}, 0.0) AS it_spend_clean,
    CAST(CASE entity_type WHEN 'Parent' THEN 3 WHEN 'Subsidiary' THEN 2 WHEN 'Branch' THEN 1 ELSE 1 END AS DOUBLE) AS entity_score,
    CAST(CASE entity_type WHEN 'Headquarters' THEN 4 WHEN 'Parent' THEN 3 WHEN 'Single Location' THEN 3
                          WHEN 'Subsidiary' THEN 2 WHEN 'Branch' THEN 1 ELSE 1 END AS DOUBLE) AS entity_ord,
    CAST(parent_company IS NOT NULL AS INTEGER) AS has_parent,
    COALESCE(substring(sic_code, 1, 2), 'na') AS sic2
  FROM raw),
c2 AS (
  SELECT *,
    (revenue_raw IS NULL OR revenue_raw = 0) AS is_revenue_missing,
    (employees_raw IS NULL OR employees_raw = 0) AS is_employees_missing,
    CASE WHEN revenue_raw <> 0 THEN ln(1 + revenue_raw) END AS log_rev_in,
    CASE WHEN employees_raw <> 0 THEN ln(1 + employees_raw) END AS log_emp_in
  FROM c1),
sc AS (
  SELECT avg(log_rev_in) AS ma, stddev_pop(log_rev_in) AS sa, avg(log_emp_in) AS mb, stddev_pop(log_emp_in) AS sb,
         avg(entity_ord) AS mo, stddev_pop(entity_ord) AS so FROM c2),
z AS (
  SELECT company_id AS id, log_rev_in AS va, log_emp_in AS vb,
         (log_rev_in - ma) / sa AS za, (log_emp_in - mb) / sb AS zb, (entity_ord - mo) / so AS zo
  FROM c2, sc),
cand_a AS (
  SELECT r.id AS rid, d.id AS did, d.va AS t,
         CASE WHEN r.zb IS NOT NULL AND d.zb IS NOT NULL THEN 1.5 * ((r.zb - d.zb) * (r.zb - d.zb) + (r.zo - d.zo) * (r.zo - d.zo))
              ELSE 3.0 * ((r.zo - d.zo) * (r.zo - d.zo)) END AS d2
  FROM z r JOIN z d ON r.va IS NULL AND d.va IS NOT NULL),
imp_a AS (
  SELECT rid, avg(t) AS imp FROM (
    SELECT rid, t, row_number() OVER (PARTITION BY rid ORDER BY d2, did) AS rk FROM cand_a) WHERE rk <= 5 GROUP BY rid),
cand_b AS (
  SELECT r.id AS rid, d.id AS did, d.vb AS t,
         CASE WHEN r.za IS NOT NULL AND d.za IS NOT NULL THEN 1.5 * ((r.za - d.za) * (r.za - d.za) + (r.zo - d.zo) * (r.zo - d.zo))
              ELSE 3.0 * ((r.zo - d.zo) * (r.zo - d.zo)) END AS d2
  FROM z r JOIN z d ON r.vb IS NULL AND d.vb IS NOT NULL),
imp_b AS (
  SELECT rid, avg(t) AS imp FROM (
    SELECT rid, t, row_number() OVER (PARTITION BY rid ORDER BY d2, did) AS rk FROM cand_b) WHERE rk <= 5 GROUP BY rid),
c3 AS (
  SELECT c2.*,
    CASE WHEN log_rev_in IS NOT NULL THEN revenue_raw ELSE exp(ia.imp) - 1 END AS revenue_clean,
    CASE WHEN log_emp_in IS NOT NULL THEN employees_raw ELSE exp(ib.imp) - 1 END AS employees_clean
  FROM c2 LEFT JOIN imp_a ia ON ia.rid = c2.company_id LEFT JOIN imp_b ib ON ib.rid = c2.company_id),
c4 AS (
  SELECT *,
    CASE WHEN year_found_clean IS NULL THEN NULL ELSE least(greatest(2026.0 - year_found_clean, 0.0), 200.0) END AS age_raw,
    COALESCE(it_spend_clean / NULLIF(employees_clean, 0), 0.0) AS it_spend_per_emp,
    revenue_clean / NULLIF(employees_clean, 0) AS rpe_raw,
    ln(1 + revenue_clean) AS log_revenue,
    ln(1 + employees_clean) AS log_employees,
    (CAST(NOT is_revenue_missing AS INTEGER) + CAST(NOT is_employees_missing AS INTEGER) + CAST(sic_code IS NOT NULL AS INTEGER)
     + CAST(entity_type IS NOT NULL AS INTEGER) + CAST(region IS NOT NULL AS INTEGER) + CAST(country IS NOT NULL AS INTEGER)
     + CAST(year_found IS NOT NULL AS INTEGER)) / 7.0 AS data_completeness
  FROM c3),
med AS (SELECT median(age_raw) AS m_age, median(rpe_raw) AS m_rpe FROM c4),
c5 AS (
  SELECT c4.*, COALESCE(age_raw, m_age) AS company_age, COALESCE(rpe_raw, m_rpe) AS revenue_per_employee FROM c4, med),
ind AS (SELECT sic2, median(revenue_clean) AS ind_rev_med, median(employees_clean) AS ind_emp_med FROM c5 GROUP BY sic2),
c6 AS (
  SELECT c5.*, ind.ind_rev_med, ind.ind_emp_med,
    CASE WHEN ind_rev_med > 0 THEN least(greatest((revenue_clean / ind_rev_med - 1) * 100, -100.0), 500.0) ELSE 0.0 END AS revenue_vs_industry,
    CASE WHEN ind_emp_med > 0 THEN least(greatest((employees_clean / ind_emp_med - 1) * 100, -100.0), 500.0) ELSE 0.0 END AS employees_vs_industry
  FROM c5 LEFT JOIN ind USING (sic2)),
c7 AS (
  SELECT *,
    CAST(least(100.0, greatest(0.0, (
      CASE WHEN revenue_clean >= 1e8 THEN 35.0 WHEN revenue_clean >= 1e7 THEN 25.0 WHEN revenue_clean >= 1e6 THEN 15.0
           WHEN revenue_clean >= 1e5 THEN 5.0 ELSE 0.0 END
      + CASE WHEN is_domestic_ultimate_clean = 1 THEN 15.0 ELSE entity_score * 3.0 END
      + CASE WHEN revenue_per_employee >= 5e5 THEN 10.0 ELSE 0.0 END
      + CASE WHEN it_spend_per_emp > 1000 THEN 10.0 WHEN it_spend_per_emp > 0 THEN 5.0 ELSE 0.0 END
      + CASE WHEN market_value_clean > 0 THEN 15.0 ELSE 0.0 END
      + CASE WHEN company_age >= 3 AND company_age <= 10 THEN 10.0 WHEN company_age > 10 THEN 5.0 ELSE 0.0 END
    ) * CASE WHEN data_completeness < 0.5 THEN 0.8 ELSE 1.0 END)) AS DOUBLE) AS lead_score
  FROM c6),
prepared AS (
  SELECT *,
    CASE WHEN lead_score > 0 AND lead_score <= 30 THEN 'Cold' WHEN lead_score > 30 AND lead_score <= 50 THEN 'Warm'
         WHEN lead_score > 50 AND lead_score <= 75 THEN 'Hot' WHEN lead_score > 75 AND lead_score <= 100 THEN 'Priority' END AS lead_tier,
    COALESCE(revenue_clean > 100000 AND is_employees_missing, false) AS risk_shell,
    COALESCE(data_completeness < 0.5, false) AS risk_data_quality,
    COALESCE(entity_type = 'Subsidiary' AND has_parent = 0, false) AS risk_orphan_sub
  FROM c7)
"""
)


def with_prepared(select: str) -> str:
    return CORE_SQL + select


_STRICT = "TRY_CAST(trim(replace({c}, ',', '')) AS DOUBLE)"

# The single-company evaluator's rules on every company, imputed against the
# pipeline's rows as stored donors (same scaler), brute force.
EVALUATOR_CTES = f"""
e0 AS (
  SELECT company_id, {_STRICT.format(c='revenue_usd')} AS rev_e, {_STRICT.format(c='employees_total')} AS emp_e,
    {_STRICT.format(c='year_found')} AS year_e, {_STRICT.format(c='market_value_usd')} AS mv_e,
    COALESCE({_STRICT.format(c='it_spend')}, 0.0) AS it_e,
    CAST(COALESCE(length(is_domestic_ultimate) > 0, false) AS INTEGER) AS du_e,
    CAST(COALESCE(length(parent_company) > 0, false) AS INTEGER) AS has_parent_e,
    CAST(CASE entity_type WHEN 'Parent' THEN 3 WHEN 'Headquarters' THEN 3 WHEN 'Subsidiary' THEN 2 WHEN 'Branch' THEN 1
         WHEN 'Single Location' THEN 3 ELSE 1 END AS DOUBLE) AS ord_e,
    (CAST(COALESCE(length(sic_code) > 0, false) AS INTEGER) + CAST(COALESCE(length(entity_type) > 0, false) AS INTEGER)
     + CAST(COALESCE(length(region) > 0, false) AS INTEGER) + CAST(COALESCE(length(country) > 0, false) AS INTEGER)
     + CAST(COALESCE(length(year_found) > 0, false) AS INTEGER)) AS present5
  FROM raw),
e1 AS (
  SELECT e0.*, CASE WHEN rev_e > 0 THEN ln(1 + rev_e) END AS va, CASE WHEN emp_e > 0 THEN ln(1 + emp_e) END AS vb FROM e0),
ez AS (SELECT e1.*, (va - ma) / sa AS za, (vb - mb) / sb AS zb, (ord_e - mo) / so AS zo FROM e1, sc),
ecand_a AS (
  SELECT r.company_id AS rid, d.id AS did, d.va AS t,
         CASE WHEN r.zb IS NOT NULL AND d.zb IS NOT NULL THEN 1.5 * ((r.zb - d.zb) * (r.zb - d.zb) + (r.zo - d.zo) * (r.zo - d.zo))
              ELSE 3.0 * ((r.zo - d.zo) * (r.zo - d.zo)) END AS d2
  FROM ez r JOIN z d ON r.va IS NULL AND d.va IS NOT NULL),
eimp_a AS (
  SELECT rid, avg(t) AS imp FROM (
    SELECT rid, t, row_number() OVER (PARTITION BY rid ORDER BY d2, did) AS rk FROM ecand_a) WHERE rk <= 5 GROUP BY rid),
ecand_b AS (
  SELECT r.company_id AS rid, d.id AS did, d.vb AS t,
         CASE WHEN r.za IS NOT NULL AND d.za IS NOT NULL THEN 1.5 * ((r.za - d.za) * (r.za - d.za) + (r.zo - d.zo) * (r.zo - d.zo))
              ELSE 3.0 * ((r.zo - d.zo) * (r.zo - d.zo)) END AS d2
  FROM ez r JOIN z d ON r.vb IS NULL AND d.vb IS NOT NULL),
eimp_b AS (
  SELECT rid, avg(t) AS imp FROM (
    SELECT rid, t, row_number() OVER (PARTITION BY rid ORDER BY d2, did) AS rk FROM ecand_b) WHERE rk <= 5 GROUP BY rid),
e2 AS (
  SELECT ez.*,
    CASE WHEN va IS NOT NULL THEN rev_e ELSE exp(ia.imp) - 1 END AS revenue_clean,
    CASE WHEN vb IS NOT NULL THEN emp_e ELSE exp(ib.imp) - 1 END AS employees_clean,
    CASE WHEN year_e IS NULL OR year_e = 0 THEN 15.0 ELSE least(greatest(2026.0 - year_e, 0.0), 200.0) END AS company_age,
    (CAST(COALESCE(rev_e > 0, false) AS INTEGER) + CAST(COALESCE(emp_e > 0, false) AS INTEGER) + present5) / 7.0 AS completeness
  FROM ez LEFT JOIN eimp_a ia ON ia.rid = ez.company_id LEFT JOIN eimp_b ib ON ib.rid = ez.company_id),
e3 AS (
  SELECT *, CASE WHEN employees_clean > 0 THEN revenue_clean / employees_clean ELSE 0.0 END AS rpe,
    CASE WHEN employees_clean > 0 THEN it_e / employees_clean ELSE 0.0 END AS it_emp FROM e2),
evaluated AS (
  SELECT *, CAST(least(100.0, greatest(0.0, (
      CASE WHEN revenue_clean >= 1e8 THEN 35.0 WHEN revenue_clean >= 1e7 THEN 25.0 WHEN revenue_clean >= 1e6 THEN 15.0
           WHEN revenue_clean >= 1e5 THEN 5.0 ELSE 0.0 END
      + CASE WHEN du_e = 1 THEN 15.0 ELSE ord_e * 3.0 END
      + CASE WHEN rpe >= 5e5 THEN 10.0 ELSE 0.0 END
      + CASE WHEN it_emp > 1000 THEN 10.0 WHEN it_emp > 0 THEN 5.0 ELSE 0.0 END
      + CASE WHEN mv_e > 0 THEN 15.0 ELSE 0.0 END
      + CASE WHEN company_age >= 3 AND company_age <= 10 THEN 10.0 WHEN company_age > 10 THEN 5.0 ELSE 0.0 END
    ) * CASE WHEN completeness < 0.5 THEN 0.8 ELSE 1.0 END)) AS DOUBLE) AS lead_score
  FROM e3)
"""
EVALUATOR_SQL = CORE_SQL.rstrip() + "," + EVALUATOR_CTES
