"""Ready-made dashboard results over an orders table and its customers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import money, month_label
from siltstone.plans.shared_scan import grouped


@dataclass(frozen=True)
class OrderColumns:
    """Which columns of the two tables play which part."""

    order_id: str
    customer: str
    amount: str
    date: str
    status: str
    payment: str
    customer_id: str
    customer_name: str
    region: str
    cancelled: str = "cancelled"


def _kept(orders: DataFrame, c: OrderColumns) -> DataFrame:
    """Orders that count as revenue. A NULL status is not kept, as in SQL's ``!=``."""
    return orders.filter(F.col(c.status) != c.cancelled)


def _total(amount: str) -> Column:
    return F.sum(money(amount)).cast("double")


def kpis(orders: DataFrame, customers: DataFrame, c: OrderColumns) -> DataFrame:
    """Revenue, average order value, orders and customers in one row.

    The order figures share one pass with conditional aggregates; the customer count is a
    one-row subquery.
    """
    counts = F.col(c.status) != c.cancelled
    amount = F.when(counts, money(c.amount))
    return orders.agg(
        F.sum(amount).cast("double").alias("total_revenue"),
        F.round(F.sum(amount).cast("double") / F.count(amount), 2).alias("avg_order_value"),
        F.count(F.lit(1)).alias("total_orders"),
    ).withColumn("total_customers", customers.agg(F.count(F.lit(1))).scalar())


def trend(orders: DataFrame, c: OrderColumns) -> DataFrame:
    """Revenue per month with its label, in time order."""
    month = F.date_trunc("month", c.date)
    return (
        _kept(orders, c)
        .groupBy(month.alias("_month"))
        .agg(_total(c.amount).alias("revenue"))
        .orderBy("_month")
        .select(month_label("_month").alias("month"), "revenue")
    )


def count_by(df: DataFrame, key: str, name: str = "count", limit: int | None = None) -> DataFrame:
    """Rows per value, most first, ties by value."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key)
    return counted if limit is None else counted.limit(limit)


def revenue_by(orders: DataFrame, key: str, c: OrderColumns) -> DataFrame:
    """Revenue per value, highest first, ties by value."""
    return _kept(orders, c).groupBy(key).agg(_total(c.amount).alias("revenue")).orderBy(F.desc("revenue"), key)


def top_customers(orders: DataFrame, customers: DataFrame, c: OrderColumns, k: int = 10) -> DataFrame:
    """The k customers with the highest revenue.

    Orders are summed per customer before the join, so what meets the customer table is one row
    per buyer; names are only looked up for rows that survive the sum.
    """
    spent = _kept(orders, c).groupBy(c.customer).agg(
        F.sum(money(c.amount)).alias("revenue"), F.count(c.order_id).alias("orders")
    )
    named = spent.join(
        customers.select(c.customer_id, F.col(c.customer_name).alias("customer")),
        F.col(c.customer) == F.col(c.customer_id),
    )
    return (
        named.groupBy("customer")
        .agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("orders").alias("orders"))
        .orderBy(F.desc("revenue"), "customer")
        .limit(k)
    )


def recent(orders: DataFrame, customers: DataFrame, c: OrderColumns, k: int = 15) -> DataFrame:
    """The k newest orders with their customer.

    Orders whose customer exists are decided by a semi-join before the top-k, and the names are
    joined to the k rows only.
    """
    known = orders.join(customers, F.col(c.customer) == F.col(c.customer_id), "left_semi")
    newest = known.orderBy(F.desc(c.date), c.order_id).limit(k)
    return newest.join(
        customers.select(c.customer_id, c.customer_name), F.col(c.customer) == F.col(c.customer_id)
    ).orderBy(F.desc(c.date), c.order_id).limit(k).select(
        c.order_id,
        F.col(c.customer_name).alias("customer"),
        F.date_format(c.date, "yyyy-MM-dd").alias("date"),
        F.col(c.status).alias("status"),
        money(c.amount).cast("double").alias("amount"),
        F.col(c.payment).alias("payment_method"),
    )


def by_region(values: DataFrame, key: str, regions: DataFrame, region_key: str, name: str, limit: int | None = 10) -> DataFrame:
    """Rows per region name; the key is counted first, then named."""
    counted = values.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    named = counted.join(regions.select(region_key, name), F.col(key) == F.col(region_key))
    top = named.groupBy(name).agg(F.sum("_n").alias("customers")).orderBy(F.desc("customers"), name)
    return top if limit is None else top.limit(limit)


def command_center(orders: DataFrame, customers: DataFrame, c: OrderColumns, folder: str) -> dict[str, DataFrame]:
    """The whole sales dashboard. All aggregated widgets over the orders are one scan of them, made now.

    The newest orders are no aggregation: that widget alone reads the orders again, and only from the month on that holds as
    many as it shows, which the shared result tells; with customers unknown it goes further back.
    """
    kept = F.col(c.status) != c.cancelled
    month = orders.select(c.order_id, c.customer, c.amount, c.date, c.status, c.payment).withColumn("_month", F.date_trunc("month", c.date))
    sets = {"kpis": [], "trend": ["_month"], "status": [c.status], "payment": [c.payment], "customer": [c.customer]}
    measures = {
        "revenue": F.sum(F.when(kept, money(c.amount))),
        "paid": F.count(F.when(kept, money(c.amount))),
        "orders": F.count(F.when(kept, F.col(c.order_id))),
        "kept_rows": F.count(F.when(kept, F.lit(1))),
        "total": F.count(F.lit(1)),
    }
    found = grouped(month, sets, measures, folder)
    money_of = F.col("revenue").cast("double")
    total = found["kpis"].agg(*[F.max(n).alias(n) for n in measures])
    by_customer = found["customer"].filter("kept_rows > 0").join(
        customers.select(c.customer_id, F.col(c.customer_name).alias("_name")), F.col(c.customer) == F.col(c.customer_id)
    )
    buyers = by_customer.groupBy(F.col("_name").alias("customer")).agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("orders").alias("orders"))
    return {
        "kpis": total.select(
            money_of.alias("total_revenue"),
            F.round(money_of / F.nullif("paid", F.lit(0)), 2).alias("avg_order_value"),
            F.coalesce("total", F.lit(0)).alias("total_orders"),
        ).withColumn("total_customers", customers.agg(F.count(F.lit(1))).scalar()),
        "revenue_trend": found["trend"].filter("kept_rows > 0").orderBy("_month").select(month_label("_month").alias("month"), money_of.alias("revenue")),
        "orders_by_status": found["status"].select(c.status, F.col("total").alias("count")).orderBy(F.desc("count"), c.status),
        "top_customers": buyers.orderBy(F.desc("revenue"), "customer").limit(10),
        "revenue_by_payment": found["payment"].filter("kept_rows > 0").select(c.payment, money_of.alias("revenue")).orderBy(F.desc("revenue"), c.payment),
        "customers_by_region": count_by(customers, c.region, "customers", 10),
        "recent_orders": recent(_newest_months(orders, customers, c, found["trend"], 15), customers, c),
    }


def _newest_months(orders: DataFrame, customers: DataFrame, c: OrderColumns, months: DataFrame, k: int) -> DataFrame:
    """Orders from the newest month on that, with those after it, holds ``k`` orders of known customers; all if none does."""
    # One row a month.
    counts = months.filter("_month IS NOT NULL").orderBy(F.desc("_month")).select("_month", "total").collect()
    seen, wanted = 0, k
    for month, total in counts:
        seen += total
        if seen >= wanted:
            newest = orders.filter(F.col(c.date) >= F.lit(month).cast(orders.schema[c.date].dataType))
            known = newest.join(customers, F.col(c.customer) == F.col(c.customer_id), "left_semi").limit(k).count()
            if known >= k:
                return newest
            wanted = 4 * seen
    return orders
