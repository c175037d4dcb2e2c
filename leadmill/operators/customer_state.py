"""What orders add up to per customer, kept as a table that later orders are merged into.

Sums and latest dates can be merged: the state of old and new orders together is that of both
states added up. So an import reads the state and its own new orders, never the old ones.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.operators.analytics import count_if
from leadmill.schemas import COMPLETED, CUSTOMER_STATE, MONEY
from leadmill.sources.files import conform

FACTS = CUSTOMER_STATE.names[1:]


def order_facts() -> dict[str, Column]:
    """Aggregates of orders: completed ones and their revenue, last date of all and of these."""
    done = F.col("order_status") == COMPLETED
    return {
        "completed_orders": count_if(done),
        "completed_revenue": F.sum(F.when(done, F.col("net_revenue"))),
        "last_order_date": F.max("order_date"),
        "last_completed_date": F.max(F.when(done, F.col("order_date"))),
    }


def merged_facts() -> dict[str, Column]:
    """Aggregates that merge rows of facts."""
    return {
        c: F.sum(c) if c.startswith("completed") else F.max(c) for c in FACTS
    }


def customer_state(orders: DataFrame) -> DataFrame:
    """One row per customer that has orders; orders without a customer are left out."""
    found = orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
    return conform(found.agg(*_named(order_facts())), CUSTOMER_STATE)


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all the orders that the given states are of."""
    rows = reduce(DataFrame.unionByName, states).filter(F.col("customer_id").isNotNull())
    return conform(rows.groupBy("customer_id").agg(*_named(merged_facts())), CUSTOMER_STATE)


def with_delta(customers: DataFrame, state: DataFrame, delta: DataFrame) -> DataFrame:
    """Customers with the merged state of both beside them, as `prefixed` columns.

    The delta of an import is small; where Spark finds it small enough, it is broadcast.
    """
    added = delta.select("customer_id", *[F.col(c).alias(f"d_{c}") for c in FACTS])
    both = {}
    for c in FACTS:
        old, new = F.col(f"s_{c}"), F.col(f"d_{c}")
        if c.startswith("completed"):
            sum_ = F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
            both[f"s_{c}"] = F.when(old.isNotNull() | new.isNotNull(), sum_)
        else:
            both[f"s_{c}"] = F.greatest(old, new)
    return (
        customers.join(prefixed(state), "customer_id", "left")
        .join(added, "customer_id", "left")
        .withColumns(both)
        .drop(*[f"d_{c}" for c in FACTS])
        .withColumn("s_completed_revenue", F.col("s_completed_revenue").cast(MONEY))
    )


def prefixed(state: DataFrame) -> DataFrame:
    """A state to be joined beside customers: its facts are named s_... ."""
    return state.select("customer_id", *[F.col(c).alias(f"s_{c}") for c in FACTS])


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]
