"""Data-quality checks (Q1-Q7): the schema's declared constraints -- which
the app never enforces -- applied as Spark jobs over whole tables.

Each check returns violation rows ``(check, table_name, column_name, row_key,
value)``; an empty result means the table satisfies the rule.  All checks
are narrow filters or anti-joins: no check collects a table anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed sets declared by the schema.
ENUMS = {
    ("users", "role"): ("customer", "rider", "admin", "manager"),
    ("riders", "status"): ("pending", "approved", "rejected"),
    ("restaurants", "status"): ("pending", "approved", "rejected"),
    ("produce_items", "category"): ("fruit", "vegetable"),
    ("promo_codes", "discount_type"): ("percentage", "fixed"),
    ("loyalty_transactions", "type"): ("earn", "redeem"),
}

# (table, column, predicate that must hold; NULL passes like a SQL CHECK)
RANGES = [
    ("menu_items", "price", lambda c: c >= 0),
    ("food_orders", "total_amount", lambda c: c >= 0),
    ("order_items", "quantity", lambda c: c > 0),
    ("order_items", "unit_price", lambda c: c >= 0),
    ("reviews", "rating", lambda c: c.between(1, 5)),
    ("produce_items", "price_per_kg", lambda c: c >= 0),
    ("produce_orders", "total_amount", lambda c: c >= 0),
    ("produce_order_items", "quantity_kg", lambda c: c > 0),
    ("produce_order_items", "unit_price", lambda c: c >= 0),
    ("promo_codes", "discount_value", lambda c: c > 0),
]

REQUIRED = {
    "users": ("name", "email", "role"),
    "riders": ("user_id",),
    "restaurants": ("name",),
    "categories": ("restaurant_id", "name"),
    "menu_items": ("restaurant_id", "name", "price"),
    "food_orders": ("customer_id", "restaurant_id", "total_amount"),
    "order_items": ("order_id", "item_id", "quantity", "unit_price"),
    "messages": ("sender_id", "receiver_id", "message"),
    "reviews": ("customer_id", "restaurant_id", "rating"),
    "audit_log": ("action",),
    "produce_items": ("name", "category", "price_per_kg"),
    "produce_orders": ("customer_id", "total_amount"),
    "produce_order_items": ("order_id", "produce_id", "quantity_kg", "unit_price"),
    "promo_codes": ("code", "discount_type", "discount_value"),
    "loyalty_points": ("customer_id",),
    "loyalty_transactions": ("customer_id", "points", "type"),
}

UNIQUE = [("users", "email"), ("promo_codes", "code"), ("loyalty_points", "customer_id"), ("riders", "user_id")]

# child table, child column, parent table, parent column; "none" values
# (NULL, and 0 where the app uses 0 for "none") are not references.
FOREIGN_KEYS = [
    ("riders", "user_id", "users", "id"),
    ("restaurants", "manager_id", "users", "id"),
    ("categories", "restaurant_id", "restaurants", "id"),
    ("menu_items", "restaurant_id", "restaurants", "id"),
    ("menu_items", "category_id", "categories", "id"),
    ("food_orders", "customer_id", "users", "id"),
    ("food_orders", "restaurant_id", "restaurants", "id"),
    ("food_orders", "rider_id", "riders", "id"),
    ("order_items", "order_id", "food_orders", "id"),
    ("order_items", "item_id", "menu_items", "id"),
    ("messages", "sender_id", "users", "id"),
    ("messages", "receiver_id", "users", "id"),
    ("reviews", "customer_id", "users", "id"),
    ("reviews", "restaurant_id", "restaurants", "id"),
    ("audit_log", "user_id", "users", "id"),
    ("produce_orders", "customer_id", "users", "id"),
    ("produce_orders", "rider_id", "riders", "id"),
    ("produce_order_items", "order_id", "produce_orders", "id"),
    ("produce_order_items", "produce_id", "produce_items", "id"),
    ("loyalty_points", "customer_id", "users", "id"),
    ("loyalty_transactions", "customer_id", "users", "id"),
]
ZERO_MEANS_NONE = {("menu_items", "category_id"), ("produce_orders", "rider_id")}

VIOLATION_COLS = ("check", "table_name", "column_name", "row_key", "value")


def _key(df: DataFrame) -> Column:
    return F.col("id") if "id" in df.columns else F.lit(None)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rules_per_table(tables, check: str, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Evaluate many (table, column, violated, value) rules reading each table
    ONCE: the table's rules become an array of structs that is exploded and
    filtered, so no table is re-derived per rule."""
    by_table: dict[str, list[tuple[str, Column, Column]]] = {}
    for t, c, bad, value in rules:
        by_table.setdefault(t, []).append((c, bad, value))
    parts = []
    for t, rs in by_table.items():
        df = getattr(tables, t)
        arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(bad, F.lit(False)).alias("bad"),
                                 value.cast("string").alias("value")) for c, bad, value in rs])
        parts.append(df.select(_key(df).cast("string").alias("row_key"), F.explode(arr).alias("r"))
                     .where("r.bad")
                     .select(F.lit(check).alias("check"), F.lit(t).alias("table_name"),
                             F.col("r.column_name").alias("column_name"), "row_key", F.col("r.value").alias("value")))
    return _union(parts)


def check_enums(tables) -> DataFrame:
    """Rows whose value is outside the declared set (Q1)."""
    return _rules_per_table(tables, "enum", [
        (t, c, F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.col(c)) for (t, c), allowed in ENUMS.items()])


def check_ranges(tables) -> DataFrame:
    """Negative money, non-positive quantities, ratings outside 1-5 (Q2);
    NULL passes, as in a SQL CHECK."""
    return _rules_per_table(tables, "range", [
        (t, c, ~F.coalesce(ok(F.col(c)), F.lit(True)), F.col(c)) for t, c, ok in RANGES])


def check_required(tables) -> DataFrame:
    """NOT NULL columns holding NULL (Q3)."""
    return _rules_per_table(tables, "required", [
        (t, c, F.col(c).isNull(), F.lit(None)) for t, cols in REQUIRED.items() for c in cols])


def check_unique(tables) -> DataFrame:
    """Duplicated unique values with their count (Q4)."""
    parts = []
    for t, c in UNIQUE:
        dup = getattr(tables, t).where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")) \
            .where(F.col("n") > 1)
        parts.append(dup.select(F.lit("unique").alias("check"), F.lit(t).alias("table_name"),
                                F.lit(c).alias("column_name"), F.col(c).cast("string").alias("row_key"),
                                F.col("n").cast("string").alias("value")))
    return _union(parts)


def check_orphans(tables) -> DataFrame:
    """Child rows whose reference has no parent, per foreign key (Q5).

    Every table is derived ONCE: its own keys (when it is a parent) and its
    references (when it is a child) are exploded from one projection into
    ``(kind, parent, ref)`` rows, which are written once (below
    ``spark.checkpoint.dir``).  One anti-join of the references against the
    keys then covers all foreign keys; AQE splits a hot parent key (one
    restaurant referenced by a third of all orders) across tasks."""
    from ..sources.staging import staged
    children: dict[str, list[tuple[str, str, str]]] = {}
    for ct, cc, pt, pc in FOREIGN_KEYS:
        children.setdefault(ct, []).append((cc, pt, pc))
    parents = {pt: pc for _, _, pt, pc in FOREIGN_KEYS}
    parts = []
    for t in sorted(set(children) | set(parents)):
        df = getattr(tables, t)

        def ref(cc: str, t=t) -> Column:
            c = F.col(cc).cast("bigint")
            return F.when(c != 0, c) if (t, cc) in ZERO_MEANS_NONE else c

        items = [F.struct(F.lit("ref").alias("kind"), F.lit(pt).alias("parent"),
                          F.lit(f"{cc}->{pt}.{pc}").alias("column_name"), ref(cc).alias("ref"))
                 for cc, pt, pc in children.get(t, [])]
        if t in parents:
            items.append(F.struct(F.lit("key").alias("kind"), F.lit(t).alias("parent"),
                                  F.lit(None).cast("string").alias("column_name"),
                                  F.col(parents[t]).cast("bigint").alias("ref")))
        parts.append(df.select(F.lit(t).alias("table_name"), _key(df).cast("string").alias("row_key"),
                               F.explode(F.array(*items)).alias("r"))
                     .select("table_name", "row_key", "r.*").where(F.col("ref").isNotNull()))
    rows = staged(_union(parts), "references")
    refs = rows.where(F.col("kind") == "ref")
    keys = rows.where(F.col("kind") == "key").select(F.col("parent").alias("_parent"), F.col("ref").alias("_id"))
    j = refs.join(keys, (F.col("parent") == F.col("_parent")) & (F.col("ref") == F.col("_id")), "left_anti")
    return j.select(F.lit("orphan").alias("check"), "table_name", "column_name", "row_key",
                    F.col("ref").cast("string").alias("value"))


def cascade_delete(children: DataFrame, fk: str, deleted_parents: DataFrame, set_null: bool = False) -> DataFrame:
    """Apply ON DELETE to a child table (Q6): CASCADE removes the children of
    deleted parents (anti-join); SET NULL keeps them with the reference
    cleared (left join + when)."""
    gone = deleted_parents.select(F.col("id").alias("_gone")).distinct()
    if not set_null:
        return children.join(gone, F.col(fk) == F.col("_gone"), "left_anti")
    j = children.join(gone, F.col(fk) == F.col("_gone"), "left")
    return j.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone")


def promo_type_audit(promo_codes: DataFrame) -> DataFrame:
    """Codes priced as a flat amount although they read as a percentage:
    anything but the literal 'percent' is flat (Q7)."""
    t = F.lower(F.trim(F.col("discount_type")))
    return promo_codes.where((F.col("discount_type") != "percent")
                             & (t.startswith("percent") | t.contains("%")))
