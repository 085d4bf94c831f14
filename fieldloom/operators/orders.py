"""The sample domain's computations as columns: totals, transitions and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.naming import is_blank


def total(items: Column) -> Column:
    """Sum of unit_price times quantity."""
    return F.aggregate(items, F.lit(0).cast("decimal(38,4)"), lambda acc, x: (acc + (x["unit_price"] * x["quantity"]).cast("decimal(30,4)")).cast("decimal(38,4)"))


def totals(items: DataFrame, key: str) -> DataFrame:
    """(key, total) of item rows, by partial aggregation; total() is for items in an array."""
    return items.groupBy(key).agg(F.sum((F.col("unit_price") * F.col("quantity")).cast("decimal(30,4)")).cast("decimal(38,4)").alias("total"))


def add_item(items: Column, item: Column) -> Column:
    return F.array_append(items, item)


def remove_item(items: Column, product_id: Column) -> Column:
    """Without the items of this product; one without a product stays."""
    return F.filter(items, lambda x: ~(x["product_id"].eqNullSafe(product_id) & product_id.isNotNull()))


def transition(status: Column, before: list[str], after: str, also: Column | None = None) -> Column:
    allowed = status.isin(*before) if also is None else status.isin(*before) & also
    return F.when(allowed, F.lit(after)).otherwise(status)


def confirm(status: Column, items: Column) -> Column:
    return transition(status, ["PENDING"], "CONFIRMED", F.size(items) > 0)


def ship(status: Column) -> Column:
    return transition(status, ["CONFIRMED"], "SHIPPED")


def cancel(status: Column) -> Column:
    return transition(status, ["PENDING", "CONFIRMED"], "CANCELLED")


def reduce_stock(stock: Column, by: Column) -> Column:
    return F.when(stock >= by, stock - by).otherwise(stock)


def can_modify(status: Column) -> Column:
    return status == "PENDING"


def has_stock(stock: Column) -> Column:
    return stock > 0


def has_enough_stock(stock: Column, wanted: Column) -> Column:
    return stock >= wanted


def add_stock(stock: Column, by: Column) -> Column:
    return stock + by


def update_price(price: Column, new: Column) -> Column:
    """The new price; the old one plays no part."""
    return new


def summary(kind: str, **parts: Column) -> Column:
    """`Kind(a=1, b=2)`."""
    said = [x for i, (k, c) in enumerate(parts.items()) for x in (F.lit(f"{', ' if i else ''}{k}="), F.coalesce(c.cast("string"), F.lit("null")))]
    return F.concat(F.lit(f"{kind}("), *said, F.lit(")"))


def order_summary(order_id: Column, customer: Column, total: Column, status: Column, items: Column) -> Column:
    return summary("Order", id=order_id, customer=customer, total=total, status=status, itemCount=F.size(items))


def user_summary(user_id: Column, name: Column, email: Column, age: Column, active: Column) -> Column:
    return summary("User", id=user_id, name=name, email=email, age=age, active=active)


def update_profile(name: Column, email: Column, new_name: Column, new_email: Column) -> tuple[Column, Column]:
    return F.when(name.eqNullSafe(new_name), name).otherwise(new_name), F.when(email.eqNullSafe(new_email), email).otherwise(new_email)


def activate(active: Column) -> Column:
    return F.lit(True)


def deactivate(active: Column) -> Column:
    return F.when(active, F.lit(False)).otherwise(active)


def increment_age(age: Column) -> Column:
    return age + 1


def valid_user(user_id: Column, name: Column, email: Column, age: Column) -> Column:
    """False where any part is missing."""
    return ~is_blank(user_id) & ~is_blank(name) & F.coalesce(email.contains("@"), F.lit(False)) & F.coalesce(age >= 0, F.lit(False))
