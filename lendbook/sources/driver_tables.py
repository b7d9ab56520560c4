"""Credit applications derived from the order-and-lines tables.

One application per order. Money is carried in whole cents, because sums and roundings of
doubles depend on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.functions.exprs import div

# A shipment counts as a workflow date up to this many days after the order.
WORKFLOW_WINDOW_DAYS = 730


def _cents(amount: Column) -> Column:
    """Two-decimal amount as whole cents."""
    return (amount.cast("decimal(14,2)") * 100).cast("bigint")


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast(S.MONEY)


def _dealt(df: DataFrame, into: int | None, *keys: str) -> DataFrame:
    """Rows dealt by their keys into a number of partitions that follows the table's size.

    Rows that hardly repeat a key are dealt before they are grouped: grouping them first, in every
    task, fills its memory and frees none of the shuffle.
    """
    return df.repartition(into, *keys) if into else df.repartition(*keys)


def order_lines(lineitem: DataFrame, part: DataFrame, into: int | None = None) -> DataFrame:
    """Lines summed up per order, dealt by it.

    Lines are aggregated by (order, supplier) and then by order: the second step counts the
    suppliers, and an order holding a large share of all lines is split over many tasks. Parts are
    looked up by hash at every size, since lines are too many to sort for it.
    """
    lines = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        _cents(F.col("l_extendedprice")).alias("price_cents"),
        _cents(F.col("l_tax")).alias("tax_hundredths"),
        _cents(F.col("l_discount")).alias("discount_hundredths"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    parts = part.select("p_partkey", "p_size",
                        _cents(F.col("p_retailprice")).alias("retail_cents"))
    sums = ["price_cents", "tax_hundredths", "discount_hundredths", "quantity", "retail_cents"]
    priced = lines.join(parts.hint("shuffle_hash"), lines.l_partkey == parts.p_partkey, "left")
    per_supplier = (
        _dealt(priced.drop("l_partkey", "p_partkey"), into, "l_orderkey", "l_suppkey")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(name).alias(name) for name in sums],
            F.min("p_size").alias("smallest_part"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.count_if(F.col("l_returnflag") == "A").alias("accepted"),
            F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        )
    )
    added = ["n", *sums, "returned", "accepted", "open_lines"]
    return _dealt(per_supplier, into, "l_orderkey").groupBy("l_orderkey").agg(
        *[F.sum(name).alias(name) for name in added],
        F.min("smallest_part").alias("smallest_part"),
        F.count("l_suppkey").alias("suppliers"))


def workflow_days(lineitem: DataFrame, orders: DataFrame, into: int | None = None) -> DataFrame:
    """The first three distinct ship days of each order inside its workflow window, dealt by order.

    Days are made distinct before they meet the order date, which leaves at most one row per
    order and calendar day, so no order is large when its days are ranked.
    """
    days = _dealt(lineitem.select("l_orderkey", F.to_date("l_shipdate").alias("ship_day")), into,
                  "l_orderkey", "ship_day").distinct()
    placed = _dealt(orders.select(F.col("o_orderkey").alias("l_orderkey"), "order_day"), into,
                    "l_orderkey")
    # Computed here: two sides that come straight from a shuffle would be dealt anew, into
    # Spark's own number of partitions, and so would all that follows.
    ending = placed.withColumn("end_day", F.date_add("order_day", WORKFLOW_WINDOW_DAYS))
    dated = _dealt(days, into, "l_orderkey").join(ending.hint("shuffle_hash"), "l_orderkey")
    window = Window.partitionBy("l_orderkey").orderBy("ship_day")
    first = (
        dated.where((F.col("ship_day") >= F.col("order_day")) & (
            F.col("ship_day") < F.col("end_day")))
        .withColumn("place", F.row_number().over(window)).where("place <= 3")
    )
    return first.groupBy("l_orderkey").agg(*[
        F.max(F.when(F.col("place") == place, F.col("ship_day"))).alias(name)
        for place, name in enumerate(["first_day", "second_day", "third_day"], start=1)])


def credit_applications(spark: SparkSession, sf_dir: str, into: int | None = None) -> DataFrame:
    """The flat 30-column application table, dealt by application into ``into`` partitions."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = read("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.to_date("o_orderdate").alias("order_day"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("requested"),
    )
    customer = read("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    lineitem = read("lineitem")
    lines = order_lines(lineitem, read("part"), into)
    per_order = lines.join(workflow_days(lineitem, orders, into), "l_orderkey", "left")
    # An order whose customer is unknown stays; the foreign-key check tells of it.
    known = orders.join(customer.hint("shuffle_hash"), orders.o_custkey == customer.c_custkey,
                        "left").drop("c_custkey")
    joined = _dealt(known, into, "o_orderkey").join(
        per_order, F.col("o_orderkey") == per_order.l_orderkey, "left")
    return _as_applications(joined)


def _as_applications(joined: DataFrame) -> DataFrame:
    col = F.col
    order_key = col("o_orderkey")
    counts = joined.withColumns({
        "n": F.coalesce("n", F.lit(0).cast("bigint")),
        "returned": F.coalesce("returned", F.lit(0).cast("bigint")),
        "accepted": F.coalesce("accepted", F.lit(0).cast("bigint")),
        "open_lines": F.coalesce("open_lines", F.lit(0).cast("bigint")),
        "quantity": F.coalesce("quantity", F.lit(0).cast("bigint")),
        "requested_cents": _cents(col("requested")),
        "revenue_cents": col("price_cents") * 5,
        "dti_thousandths": div(col("tax_hundredths") * 100, col("n")),
    })
    status = (
        F.when(col("second_day").isNotNull(), "Disbursed")
        .when(col("o_orderstatus") == "P", "Rejected")
        .when(col("first_day").isNull(), "Submitted")
        .when(col("o_orderstatus") == "O", "Under Review")
        .otherwise("Approved")
    )
    monthly_cents = div(col("revenue_cents"), F.lit(12))
    decided = counts.withColumns({
        "status": status,
        "monthly_cents": monthly_cents,
        "tenure": F.element_at(F.array(*[F.lit(t) for t in S.TENURES]),
                               (col("n") % 7 + 1).cast("int")),
    })
    disbursed = col("status") == "Disbursed"
    granted = col("status").isin("Approved", "Disbursed")
    # Wide decimals: a single order may carry a very large number of lines.
    wide = "decimal(18,0)"
    kept_share = (col("n") * 100 - col("discount_hundredths") * 3).cast(wide)
    approved_cents = F.when(
        granted, div(col("requested_cents").cast(wide) * kept_share, (col("n") * 100).cast(wide))
    ).otherwise(F.lit(0).cast("bigint"))
    loan_status = (
        F.when(~disbursed, "Not Disbursed")
        .when(col("returned") >= 3, "Default")
        .when(col("open_lines") == 0, "Closed")
        .when(col("returned") == 0, "Current")
        .when(col("returned") == 1,
              F.when(order_key % 59 + 1 < 30, "DPD 1-29").otherwise("DPD 30-59"))
        .otherwise(F.when(order_key % 61 + 60 < 90, "DPD 60-89").otherwise("DPD 90+"))
    )
    outcome = decided.withColumns({"approved_cents": approved_cents, "loan": loan_status})
    running = ~col("loan").isin("Not Disbursed", "Closed")
    days_past_due = (
        F.when(col("loan") == "Default", order_key % 91 + 90)
        .when(col("loan").isin("DPD 1-29", "DPD 30-59"), order_key % 59 + 1)
        .when(col("loan").isin("DPD 60-89", "DPD 90+"), order_key % 61 + 60)
        .otherwise(0)
    )
    balance_cents = F.when(
        running, div(col("approved_cents").cast(wide) * col("open_lines").cast(wide),
                     col("n").cast(wide))
    ).otherwise(F.lit(0).cast("bigint"))
    review = (
        F.when(col("status") == "Rejected",
               F.coalesce("first_day", F.date_add("order_day", 7)))
        .otherwise(col("first_day"))
    )
    approval = (
        F.when(disbursed, col("second_day"))
        .when(col("status") == "Approved", col("first_day"))
    )
    disbursement = F.when(disbursed, F.coalesce("third_day", "second_day"))
    fields = {
        "application_id": order_key,
        "customer_id": col("o_custkey"),
        "application_date": col("order_day"),
        "business_type": col("c_mktsegment"),
        "business_age_years": col("smallest_part"),
        "number_of_employees": F.nullif("suppliers", F.lit(0)),
        "monthly_revenue": _money(col("monthly_cents")),
        "annual_revenue": _money(col("revenue_cents")),
        "requested_loan_amount": col("requested"),
        "loan_tenure_months": col("tenure"),
        "loan_purpose": col("o_orderpriority"),
        "existing_loans": col("open_lines"),
        "existing_monthly_debt": _money(div(
            col("monthly_cents").cast(wide) * col("dti_thousandths").cast(wide), F.lit(1000))),
        "debt_to_income_ratio":
            (col("dti_thousandths").cast("decimal(10,0)") / F.lit(1000)),
        "bureau_score": F.when(order_key % 67 != 0, F.lit(300) + div(
            _cents(col("c_acctbal")) + 100000, F.lit(2000))),
        "credit_history_years": (col("quantity") % 300).cast("decimal(6,0)") / F.lit(10),
        "previous_defaults": col("accepted"),
        "collateral_value": _money(col("retail_cents") * 100),
        "bank_account_age_years": F.when(
            order_key % 71 != 0, (col("o_custkey") % 250).cast("decimal(6,0)") / F.lit(10)),
        "application_status": col("status"),
        "credit_review_date": review,
        "approval_date": approval,
        "disbursement_date": disbursement,
        "approved_amount": _money(col("approved_cents")),
        "outstanding_balance": _money(balance_cents),
        "days_past_due": days_past_due,
        "missed_payments": F.when(running, col("returned")).otherwise(0),
        "total_payments": F.when(disbursed, F.least("tenure", "n")).otherwise(0),
        "loan_status": col("loan"),
        "default_flag": (col("loan") == "Default"),
    }
    types = {field.name: field.dataType for field in S.FLAT_LONG_KEYS}
    return outcome.select(*[
        value.cast(types[name]).alias(name) for name, value in fields.items()])
