"""Risk mart: exposures, loss, bands and windows over accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.operators import decisions as D
from weftline.operators.recordsort import numbered
from weftline.session import settled

MONEY = "decimal(18,2)"


def expected_loss(accounts: DataFrame) -> DataFrame:
    """Add ead, lgd_bps, segment, pd and el to accounts with drawn, undrawn, accrued, ccf_bps, lgd_bps, dpd, score."""
    segment, pd = D.default_probability(F.col("dpd"), F.col("score"))
    ead = F.col("drawn") + (F.col("undrawn") * F.col("ccf_bps") / F.lit(10000)).cast(MONEY) + F.col("accrued")
    out = accounts.withColumn("ead", ead.cast(MONEY)).withColumn("segment", segment).withColumn("pd", pd)
    el = (F.col("ead").cast("decimal(18,2)") * F.col("pd")).cast("decimal(24,6)") * F.col("lgd_bps") / F.lit(10000)
    return out.withColumn("el", el.cast("decimal(18,4)"))


def windows(accounts: DataFrame) -> DataFrame:
    """Add customer_ead, branch_rank and capital; one shuffle by customer and one by branch."""
    customer, branch = W.Window.partitionBy("customer_key"), W.Window.partitionBy("branch")
    ranked = branch.orderBy(F.desc("el"))
    return (
        accounts.withColumn("band", D.exposure_band(F.col("pd")))
        .withColumn("customer_ead", F.sum("ead").over(customer).cast("decimal(28,2)"))
        .withColumn("branch_rank", F.rank().over(ranked).cast("long"))
        .withColumn("branch_el", F.sum("el").over(branch).cast("decimal(28,4)"))
        .withColumn("capital", (F.col("el") * F.lit("12.5").cast("decimal(3,1)")).cast("decimal(22,5)"))
    )


def group_ranks(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """group, value, rank: the rank of each value in its group, the highest first, ties alike.

    Rows are put in one order by ranges of (group, value, key), so a group of any size is spread over tasks; a value's
    rank is how far its first row stands behind its group's first row. ``key`` tells rows apart. Nulls come last.
    """
    placed = numbered(df.select(group, value, key), [F.col(group), F.desc_nulls_last(value), F.col(key)], "pos_")
    firsts = settled(placed.groupBy(group, value).agg(F.min("pos_").alias("first_")))
    heads = firsts.groupBy(group).agg(F.min("first_").alias("head_")).withColumnRenamed(group, "g_")
    return firsts.join(heads, F.col(group).eqNullSafe(F.col("g_"))).select(group, value, (F.col("first_") - F.col("head_") + 1).alias("rank"))


def unified(customers: DataFrame, accounts: DataFrame, managers: DataFrame, transactions: DataFrame, run_date: str) -> DataFrame:
    """The unified model: one row for each account of a known customer, with all 29 columns.

    customers: customer_key, customer_full_name, customer_risk_tier, vulnerable_flag; accounts: what ``expected_loss``
    returns, with product_code, credit_limit, default_flag and risk_status; managers: branch, emp_id, value, one row for each
    person and branch; transactions: account_number, posted, amount, weight, reportable.

    Totals by customer and branch are sums first, joined afterwards, and the rank of a branch is found by ranges
    (``group_ranks``), so no task holds a branch. Transactions count from 30 days before ``run_date``. Accounts without
    transactions have 0 and N, branches without a manager null; the share of a branch without loss is null.
    """
    exact = lambda x, p, s: x.cast(f"decimal({p},{s})")
    bp = F.lit("0.0001").cast("decimal(4,4)")
    loss = exact(F.col("pd"), 5, 4) * F.col("ead") * exact(F.col("lgd_bps"), 5, 0) * bp
    # worked out after the joins, which need not move them
    expected, capital = F.round(loss, 2).cast(MONEY), F.round(loss * F.lit("12.5").cast("decimal(3,1)"), 2).cast("decimal(20,2)")
    since = F.date_sub(F.lit(run_date).cast("date"), 30).cast("timestamp_ntz")
    recent = transactions.where(F.col("posted") >= since).groupBy("account_number")
    recent = recent.agg(F.sum(F.col("amount") * F.col("weight")).cast("decimal(25,2)").alias("volume"), F.count("*").alias("n"), F.max("reportable").alias("reportable"))
    # tables of a row for each branch are settled, so that Spark knows that they are small and moves no account to meet them
    rm = settled(managers.groupBy("branch").agg(F.max("emp_id").alias("rm_emp_id"), F.sum("value").cast("decimal(25,2)").alias("rm_portfolio_value")))
    x = settled(accounts.join(customers, "customer_key").join(recent, "account_number", "left"))
    of_customer = x.groupBy("customer_key").agg(F.sum("ead").cast("decimal(28,2)").alias("customer_total_ead"))
    of_branch = settled(x.groupBy("branch").agg(F.sum("el").cast("decimal(28,4)").alias("branch_el")))
    ranks = group_ranks(x, "branch", "el", "account_number").select(F.col("branch").alias("b_"), F.col("el").alias("e_"), F.col("rank").alias("branch_el_rank"))
    out = x.join(of_customer, "customer_key").join(of_branch.withColumnRenamed("branch", "t_"), F.col("branch").eqNullSafe(F.col("t_"))).join(ranks, F.col("branch").eqNullSafe(F.col("b_")) & F.col("el").eqNullSafe(F.col("e_"))).join(rm, "branch", "left")
    # whole numbers, rounded half up, so that the share is exact: of losses in hundredths of a penny
    part, total = (F.col("el") * 10000).cast("decimal(24,0)"), (F.col("branch_el") * 10000).cast("decimal(32,0)")
    share = F.when(total != 0, F.floor((part * 20000 + total).cast("decimal(38,0)") / (total * 2).cast("decimal(33,0)")).cast("long"))
    utilisation = F.when(F.col("credit_limit") > 0, F.floor(F.col("drawn") * 10000 / F.col("credit_limit")).cast("long")).otherwise(F.lit(0))
    return out.select(
        "customer_key", "customer_full_name", "customer_risk_tier", "branch", "account_number", "product_code",
        F.col("drawn").alias("account_balance"), "credit_limit", (F.col("drawn") - F.col("accrued")).cast(MONEY).alias("net_exposure"), utilisation.alias("utilisation_bp"), F.col("dpd").alias("arrears_days"),
        F.coalesce("volume", F.lit(0).cast("decimal(25,2)")).alias("txn_volume_30d"), F.coalesce("n", F.lit(0)).alias("txn_count_30d"), "rm_emp_id", "rm_portfolio_value",
        "vulnerable_flag", F.coalesce("reportable", F.lit("N")).alias("reportable_flag"), "default_flag", "ead", F.col("lgd_bps").alias("final_lgd_bps"), F.col("pd").alias("pd_rate"), expected.alias("expected_loss"), "risk_status",
        D.exposure_band(F.col("pd")).alias("band"), "customer_total_ead", capital.alias("regulatory_capital"), "branch_el_rank", share.alias("share_of_branch_bp"), F.lit(run_date).cast("date").alias("model_run_date"),
    )
