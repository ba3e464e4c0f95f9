"""Registered data-quality checks (Q1-Q7)."""

from __future__ import annotations

import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.domain import TABLE_NAMES
from .catalog import query


def _sel(check: str, table: str, column: str, key: str, value: str, where: str, src: str | None = None) -> str:
    return (f"select '{check}' \"check\", '{table}' table_name, '{column}' column_name, "
            f"cast({key} as varchar) row_key, cast({value} as varchar) value from {src or table} where {where}")


def _key(table: str) -> str:
    return "null" if table in ("order_items", "produce_order_items") else "id"


_ENUM_SQL = "\nunion all\n".join(
    _sel("enum", t, c, _key(t), c, f"{c} is not null and {c} not in ({', '.join(repr(v) for v in vals)})")
    for (t, c), vals in Q.ENUMS.items())

_RANGE_PRED = {
    ("menu_items", "price"): "price >= 0", ("food_orders", "total_amount"): "total_amount >= 0",
    ("order_items", "quantity"): "quantity > 0", ("order_items", "unit_price"): "unit_price >= 0",
    ("reviews", "rating"): "rating between 1 and 5", ("produce_items", "price_per_kg"): "price_per_kg >= 0",
    ("produce_orders", "total_amount"): "total_amount >= 0",
    ("produce_order_items", "quantity_kg"): "quantity_kg > 0",
    ("produce_order_items", "unit_price"): "unit_price >= 0",
    ("promo_codes", "discount_value"): "discount_value > 0",
}
_RANGE_SQL = "\nunion all\n".join(
    _sel("range", t, c, _key(t), c, f"not coalesce({_RANGE_PRED[(t, c)]}, true)") for t, c, _ in Q.RANGES)

_REQ_SQL = "\nunion all\n".join(
    _sel("required", t, c, _key(t), "null", f"{c} is null") for t, cols in Q.REQUIRED.items() for c in cols)

_UNIQ_SQL = "\nunion all\n".join(
    _sel("unique", t, c, c, "n", "n > 1", f"(select {c}, count(*) n from {t} where {c} is not null group by {c}) x")
    for t, c in Q.UNIQUE)


def _orphan(ct, cc, pt, pc) -> str:
    extra = f" and {cc} <> 0" if (ct, cc) in Q.ZERO_MEANS_NONE else ""
    return _sel("orphan", ct, f"{cc}->{pt}.{pc}", _key(ct), cc,
                f"{cc} is not null{extra} and not exists (select 1 from {pt} p where p.{pc} = c.{cc})", f"{ct} c")


_ORPHAN_SQL = "\nunion all\n".join(_orphan(*fk) for fk in Q.FOREIGN_KEYS)


@query("check_enums", oracle=_ENUM_SQL)
def _q1(d):
    return Q.check_enums(d)


@query("check_ranges", oracle=_RANGE_SQL)
def _q2(d):
    return Q.check_ranges(d)


@query("check_required", oracle=_REQ_SQL)
def _q3(d):
    return Q.check_required(d)


@query("check_unique", oracle=_UNIQ_SQL)
def _q4(d):
    return Q.check_unique(d)


@query("check_orphans", oracle=_ORPHAN_SQL)
def _q5(d):
    return Q.check_orphans(d)


@query("cascade_delete", oracle="""
select * from menu_items where restaurant_id not in (select id from restaurants where status = 'rejected')""")
def _q6(d):
    """Deleting every rejected restaurant cascades to its menu items."""
    gone = d.restaurants.where(F.col("status") == "rejected")
    return Q.cascade_delete(d.menu_items, "restaurant_id", gone)


@query("cascade_set_null", oracle="""
select o.* replace (case when o.rider_id in (select id from riders where status = 'rejected') then null
                         else o.rider_id end as rider_id)
from food_orders o""")
def _q6b(d):
    """Deleting every rejected rider clears ``rider_id`` on their orders (SET NULL)."""
    gone = d.riders.where(F.col("status") == "rejected")
    return Q.cascade_delete(d.food_orders, "rider_id", gone, set_null=True)


@query("promo_type_audit", oracle="""
select * from promo_codes where discount_type <> 'percent'
  and (starts_with(lower(trim(discount_type)), 'percent') or contains(lower(trim(discount_type)), '%'))""")
def _q7(d):
    return Q.promo_type_audit(d.promo_codes)


# Damage done to the tables so that every kind of check has rows to find: (table, column, value), in terms that both
# engines read.
DAMAGE = [
    ("menu_items", "price", "case when id % 53 = 0 then -price else price end"),
    ("order_items", "quantity", "case when item_id % 59 = 0 then 0 else quantity end"),
    ("reviews", "rating", "case when id % 61 = 0 then rating + 5 else rating end"),
    ("produce_order_items", "quantity_kg", "case when produce_id % 67 = 0 then -quantity_kg else quantity_kg end"),
    ("promo_codes", "discount_value", "case when id % 5 = 0 then 0 else discount_value end"),
    ("promo_codes", "code", "case when id % 6 = 1 then 'SAME' when id % 6 = 2 then null else code end"),
    ("users", "email", "case when id % 71 = 0 then 'same@example.com' when id % 73 = 0 then null else email end"),
    ("users", "name", "case when id % 79 = 0 then null else name end"),
    ("food_orders", "customer_id", "case when id % 83 = 0 then -5 when id % 89 = 0 then null else customer_id end"),
    ("food_orders", "rider_id", "case when id % 97 = 0 then 999999999 else rider_id end"),
    ("restaurants", "manager_id", "case when id % 4 = 3 then 77 else manager_id end"),
]


def _damaged(d) -> SimpleNamespace:
    tables = {t: getattr(d, t) for t in TABLE_NAMES}
    for t, c, value in DAMAGE:
        tables[t] = tables[t].withColumn(f"_{c}", F.expr(value).cast(tables[t].schema[c].dataType))
    for t, c, _ in DAMAGE:
        tables[t] = tables[t].withColumn(c, F.col(f"_{c}"))
    return SimpleNamespace(**{t: df.drop(*[c for c in df.columns if c.startswith("_")]) for t, df in tables.items()})


def _on_damaged(body: str) -> str:
    """The check's SQL with every damaged table under another name."""
    ctes = []
    for t in dict.fromkeys(t for t, _, _ in DAMAGE):
        if re.search(rf"\b{t}\b", body):
            own = ", ".join(f"{v} as {c}" for tt, c, v in DAMAGE if tt == t)
            ctes.append(f"damaged_{t} as (select * replace ({own}) from {t})")
            body = re.sub(rf"\b(from|join) {t}\b", rf"\1 damaged_{t}", body)
    return f"with {', '.join(ctes)} select * from ({body}) x"


@query("check_ranges_damaged", oracle=_on_damaged(_RANGE_SQL))
def _q2_damaged(d):
    return Q.check_ranges(_damaged(d))


@query("check_required_damaged", oracle=_on_damaged(_REQ_SQL))
def _q3_damaged(d):
    return Q.check_required(_damaged(d))


@query("check_unique_damaged", oracle=_on_damaged(_UNIQ_SQL))
def _q4_damaged(d):
    return Q.check_unique(_damaged(d))


@query("check_orphans_damaged", oracle=_on_damaged(_ORPHAN_SQL))
def _q5_damaged(d):
    return Q.check_orphans(_damaged(d))
