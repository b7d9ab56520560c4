"""SQL derivation of the credit portfolio from the driver tables, and small text helpers."""

FLAT = """
line_sums AS (
  SELECT l_orderkey,
         count(*) AS n,
         sum((l_extendedprice::DECIMAL(14,2) * 100)::BIGINT)::BIGINT AS price_cents,
         sum((l_tax::DECIMAL(14,2) * 100)::BIGINT)::BIGINT AS tax_h,
         sum((l_discount::DECIMAL(14,2) * 100)::BIGINT)::BIGINT AS disc_h,
         sum(l_quantity::BIGINT)::BIGINT AS q,
         sum((p_retailprice::DECIMAL(14,2) * 100)::BIGINT)::BIGINT AS retail_cents,
         min(p_size) AS ps,
         count(*) FILTER (WHERE l_returnflag = 'R') AS r,
         count(*) FILTER (WHERE l_returnflag = 'A') AS a,
         count(*) FILTER (WHERE l_linestatus = 'O') AS opn,
         count(DISTINCT l_suppkey) AS sup
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey),
ship_days AS (
  SELECT o_orderkey, d, row_number() OVER (PARTITION BY o_orderkey ORDER BY d) AS pos
  FROM (SELECT DISTINCT o_orderkey, l_shipdate::DATE AS d
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE l_shipdate::DATE >= o_orderdate::DATE
          AND l_shipdate::DATE < o_orderdate::DATE + 730)),
first_days AS (
  SELECT o_orderkey, max(CASE WHEN pos = 1 THEN d END) AS d1,
         max(CASE WHEN pos = 2 THEN d END) AS d2, max(CASE WHEN pos = 3 THEN d END) AS d3
  FROM ship_days GROUP BY o_orderkey),
facts AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS cust, o.o_orderdate::DATE AS od,
         o.o_orderstatus AS os, o.o_orderpriority AS prio,
         o.o_totalprice::DECIMAL(14,2) AS requested,
         (o.o_totalprice::DECIMAL(14,2) * 100)::BIGINT AS req_cents,
         c.c_mktsegment AS segment, (c.c_acctbal::DECIMAL(14,2) * 100)::BIGINT AS bal_cents,
         coalesce(l.n, 0) AS n, l.price_cents * 5 AS rev_cents,
         (l.price_cents * 5) // 12 AS mon_cents, (l.tax_h * 100) // l.n AS dti_t,
         l.disc_h, coalesce(l.q, 0) AS q, l.retail_cents, l.ps,
         coalesce(l.r, 0) AS r, coalesce(l.a, 0) AS a, coalesce(l.opn, 0) AS opn, l.sup,
         f.d1, f.d2, f.d3,
         CASE WHEN f.d2 IS NOT NULL THEN 'Disbursed'
              WHEN o.o_orderstatus = 'P' THEN 'Rejected'
              WHEN f.d1 IS NULL THEN 'Submitted'
              WHEN o.o_orderstatus = 'O' THEN 'Under Review'
              ELSE 'Approved' END AS status
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN line_sums l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN first_days f ON f.o_orderkey = o.o_orderkey),
outcomes AS (
  SELECT *,
         [6, 12, 18, 24, 36, 48, 60][(n % 7)::INT + 1] AS tenure,
         CASE WHEN status IN ('Approved', 'Disbursed')
              THEN (req_cents::HUGEINT * (100 * n - 3 * disc_h)) // (100 * n)
              ELSE 0 END AS app_cents,
         CASE WHEN status <> 'Disbursed' THEN 'Not Disbursed'
              WHEN r >= 3 THEN 'Default'
              WHEN opn = 0 THEN 'Closed'
              WHEN r = 0 THEN 'Current'
              WHEN r = 1 THEN CASE WHEN 1 + id % 59 < 30 THEN 'DPD 1-29' ELSE 'DPD 30-59' END
              ELSE CASE WHEN 60 + id % 61 < 90 THEN 'DPD 60-89' ELSE 'DPD 90+' END
         END AS ls
  FROM facts),
flat AS (
  SELECT id AS application_id, cust AS customer_id, od AS application_date,
         segment AS business_type, ps::DECIMAL(6,1) AS business_age_years,
         nullif(sup, 0)::INT AS number_of_employees,
         (mon_cents::DECIMAL(18,0) * 0.01)::DECIMAL(18,2) AS monthly_revenue,
         (rev_cents::DECIMAL(18,0) * 0.01)::DECIMAL(18,2) AS annual_revenue,
         requested::DECIMAL(18,2) AS requested_loan_amount,
         tenure::INT AS loan_tenure_months, prio AS loan_purpose,
         opn::INT AS existing_loans,
         (((mon_cents::HUGEINT * dti_t) // 1000)::DECIMAL(18,0) * 0.01)::DECIMAL(18,2)
           AS existing_monthly_debt,
         (dti_t::DECIMAL(9,0) * 0.001)::DECIMAL(6,3) AS debt_to_income_ratio,
         CASE WHEN id % 67 <> 0 THEN 300 + (bal_cents + 100000) // 2000 END::INT
           AS bureau_score,
         ((q % 300)::DECIMAL(9,0) * 0.1)::DECIMAL(6,1) AS credit_history_years,
         a::INT AS previous_defaults,
         retail_cents::DECIMAL(18,2) AS collateral_value,
         CASE WHEN id % 71 <> 0 THEN ((cust % 250)::DECIMAL(9,0) * 0.1)::DECIMAL(6,1) END
           AS bank_account_age_years,
         status AS application_status,
         CASE WHEN status = 'Rejected' THEN coalesce(d1, od + 7) ELSE d1 END
           AS credit_review_date,
         CASE WHEN status = 'Disbursed' THEN d2 WHEN status = 'Approved' THEN d1 END
           AS approval_date,
         CASE WHEN status = 'Disbursed' THEN coalesce(d3, d2) END AS disbursement_date,
         (app_cents::DECIMAL(18,0) * 0.01)::DECIMAL(18,2) AS approved_amount,
         ((CASE WHEN ls IN ('Not Disbursed', 'Closed') THEN 0
                ELSE (app_cents * opn) // n END)::DECIMAL(18,0) * 0.01)::DECIMAL(18,2)
           AS outstanding_balance,
         CASE WHEN ls = 'Default' THEN 90 + id % 91
              WHEN ls IN ('DPD 1-29', 'DPD 30-59') THEN 1 + id % 59
              WHEN ls IN ('DPD 60-89', 'DPD 90+') THEN 60 + id % 61
              ELSE 0 END::INT AS days_past_due,
         CASE WHEN ls IN ('Not Disbursed', 'Closed') THEN 0 ELSE r END::INT AS missed_payments,
         CASE WHEN ls = 'Not Disbursed' THEN 0 ELSE least(tenure, n) END::INT
           AS total_payments,
         ls AS loan_status, (ls = 'Default')::INT AS default_flag
  FROM outcomes)
"""

DISBURSED = "application_status = 'Disbursed'"
GRANTED = "application_status IN ('Approved', 'Disbursed')"


def query(body: str, *ctes: str) -> str:
    """A statement over ``flat`` with further named subqueries in front of ``body``."""
    return "WITH " + ",".join([FLAT, *ctes]) + "\n" + body


def half_up(num: str, den: str, places: int = 2, scale: int = 1) -> str:
    """scale * num / den rounded half-up for non-negative num, in whole numbers."""
    unit = 10 ** places
    return (f"((({2 * unit * scale} * ({num}) + ({den}))::HUGEINT "
            f"// nullif((2 * ({den}))::HUGEINT, 0))::DOUBLE / {unit})")


def pct(num: str, den: str) -> str:
    """Percentage of two counts, two decimals."""
    return half_up(num, den, 2, 100)


def cents(amount: str) -> str:
    """A money sum as whole cents."""
    return f"(({amount}) * 100)::HUGEINT"


def money_pct(num: str, den: str) -> str:
    """Percentage of two money sums, two decimals."""
    return half_up(cents(num), cents(den), 2, 100)


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def total(column: str, condition: str | None = None) -> str:
    """Money sum as a double."""
    where = f" FILTER (WHERE {condition})" if condition else ""
    return f"(sum({column}){where})::DOUBLE"
