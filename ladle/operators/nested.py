"""Nested assembly (N1-N7): the app's N+1 loops as one grouped pass each.

Lines are aggregated per parent *first* (partial collect per map task, then
one shuffle on the parent key) and joined to the parents afterwards, so no
parent row is replicated per line.  Each array holds one entity's lines or
items (an order, a restaurant menu), never a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import uncategorised
from .joins import order_lines_named, produce_lines_named

# Element type shared by food and produce lines so the two order families
# union into one schema: quantity is a double (kg for produce).
LINE_FIELDS = ("item_id", "name", "quantity", "unit_price")

EMPTY_LINES = "array<struct<item_id:bigint,name:string,quantity:double,unit_price:double>>"


def food_line(c_item="item_id", c_qty="quantity") -> Column:
    return F.struct(F.col(c_item).cast("bigint").alias("item_id"), F.col("name").alias("name"),
                    F.col(c_qty).cast("double").alias("quantity"),
                    F.col("unit_price").cast("double").alias("unit_price"))


def lines_per_order(lines: DataFrame, line: Column, key: str = "order_id") -> DataFrame:
    """``key`` -> sorted array of line structs (total order on all fields)."""
    return lines.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("items"))


def attach_items(orders: DataFrame, per_order: DataFrame, key: str = "order_id",
                 empty: str = EMPTY_LINES) -> DataFrame:
    j = orders.join(per_order.withColumnRenamed(key, "_k"), orders["id"] == F.col("_k"), "left").drop("_k")
    return j.withColumn("items", F.coalesce(F.col("items"), F.array().cast(empty)))


def orders_with_items(orders: DataFrame, order_items: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Each food order with ``items[]`` (name from the menu; empty if none)."""
    named = order_lines_named(order_items, menu_items)
    return attach_items(orders, lines_per_order(named, food_line()))


def produce_line() -> Column:
    return food_line("produce_id", "quantity_kg")


PRODUCE_LINE_EMPTY = ("array<struct<item_id:bigint,name:string,quantity:double,unit_price:double,"
                      "image_filename:string,category:string>>")


def produce_orders_with_items(produce_orders: DataFrame, produce_order_items: DataFrame,
                              produce_items: DataFrame, detail: bool = True) -> DataFrame:
    """Each produce order with ``items[]``; with ``detail`` the items carry
    image and category as on the produce history page (N2)."""
    named = produce_lines_named(produce_order_items, produce_items)
    if detail:
        line = F.struct(F.col("produce_id").cast("bigint").alias("item_id"), F.col("name"),
                        F.col("quantity_kg").cast("double").alias("quantity"),
                        F.col("unit_price").cast("double").alias("unit_price"),
                        F.col("image_filename"), F.col("category"))
        return attach_items(produce_orders, lines_per_order(named, line), empty=PRODUCE_LINE_EMPTY)
    return attach_items(produce_orders, lines_per_order(named, produce_line()))


MENU_ITEM = ("id", "name", "description", "price", "is_available")
MENU_ITEMS_EMPTY = ("array<struct<id:bigint,name:string,description:string,price:double,"
                    "is_available:int>>")


def _item() -> Column:
    return F.struct(*[F.col(c) for c in MENU_ITEM])


def _menu(restaurants: DataFrame, categories: DataFrame, items: DataFrame, fallback_label: str,
          include_empty_fallback: bool) -> DataFrame:
    """Shared body of N3/N4: categories with items, plus a group for items
    with no category (NULL or 0), and -- for N3 -- the all-items fallback for
    restaurants that would otherwise show nothing.

    Items are grouped once, by restaurant and category.  A full join with the
    categories tells the groups apart: those of a category (or empty), those
    without a category, and strays whose category is not the restaurant's.  A
    restaurant that shows nothing has strays only, so they are its fallback."""
    big = F.lit(9_223_372_036_854_775_807)
    groups = (items.groupBy(F.col("restaurant_id").alias("grid"),
                            F.when(~uncategorised(), F.col("category_id")).alias("gcid"))
              .agg(F.array_sort(F.collect_list(_item())).alias("gitems")))
    cats = categories.select(F.col("restaurant_id").alias("crid"), F.col("id").alias("cid"),
                             F.col("name").alias("cname"), F.lit(True).alias("listed"))
    both = cats.join(groups, (F.col("crid") == F.col("grid")) & (F.col("cid") == F.col("gcid")), "full")
    shown = F.col("listed").isNotNull() | F.col("gcid").isNull()
    group = F.struct(F.coalesce("cid", big).alias("k"), F.col("cid").alias("id"),
                     F.when(F.col("listed"), F.col("cname")).otherwise(F.lit(fallback_label)).alias("name"),
                     F.coalesce(F.col("gitems"), F.array().cast(MENU_ITEMS_EMPTY)).alias("items"))
    aggs = [F.array_sort(F.collect_list(F.when(shown, group))).alias("cs")]
    if include_empty_fallback:
        aggs.append(F.array_sort(F.flatten(F.collect_list(F.when(~shown, F.col("gitems"))))).alias("strays"))
    per_rest = both.groupBy(F.coalesce("crid", "grid").alias("rid")).agg(*aggs)
    menu = F.transform("cs", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"),
                                                c["items"].alias("items")))
    if include_empty_fallback:
        fallback = F.array(F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(fallback_label).alias("name"),
                                    F.col("strays").alias("items")))
        menu = F.when((F.size("cs") == 0) & (F.size("strays") > 0), fallback).otherwise(menu)
    cat_type = ("array<struct<id:bigint,name:string,items:" + MENU_ITEMS_EMPTY + ">>")
    out = restaurants.join(per_rest.select("rid", menu.alias("categories")),
                           restaurants["id"] == F.col("rid"), "left").drop("rid")
    return out.withColumn("categories", F.coalesce(F.col("categories"), F.array().cast(cat_type)))


def restaurant_menu(restaurants: DataFrame, categories: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Customer view (N3): categories -> available items; items without a
    category under 'Menu'; all available items under 'Menu' when there is
    nothing else."""
    avail = menu_items.where(F.col("is_available") == 1)
    return _menu(restaurants, categories, avail, "Menu", include_empty_fallback=True)


def manager_menu(restaurants: DataFrame, categories: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Manager view (N4): every category (empty ones too) and every item,
    ordered by id; items without a category under 'Uncategorised'."""
    return _menu(restaurants, categories, menu_items, "Uncategorised", include_empty_fallback=False)


def menu_filled_categories(menu: DataFrame) -> DataFrame:
    """Drop categories with no items."""
    return menu.withColumn("categories", F.filter("categories", lambda c: F.size(c["items"]) > 0))


def js_number(c: Column) -> Column:
    """A double as JavaScript prints it: whole numbers without '.0'."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def order_items_summary(orders_items: DataFrame, produce: bool = False) -> DataFrame:
    """``"name xqty, ..."`` for food, ``"name 1.5kg, ..."`` for produce."""
    if produce:
        fmt = lambda i: F.concat(i["name"], F.lit(" "), js_number(i["quantity"]), F.lit("kg"))
    else:
        fmt = lambda i: F.concat(i["name"], F.lit(" x"), i["quantity"].cast("bigint").cast("string"))
    return orders_items.select("id", F.array_join(F.transform("items", fmt), ", ").alias("items_text"))


def loyalty_statement(customers: DataFrame, loyalty_points: DataFrame, loyalty_transactions: DataFrame,
                      n: int = 20) -> DataFrame:
    """Balance (0/0 when absent) and the newest ``n`` transactions per
    customer (N7).  The per-customer top-n is a ``row_number() <= n`` filter,
    which Spark limits partially before the shuffle (WindowGroupLimit)."""
    from .windows import top_n_per_key
    last = top_n_per_key(loyalty_transactions, ["customer_id"], [F.desc("created_at"), F.desc("id")], n)
    tx = F.struct(F.col("rn"), F.col("id"), F.col("points"), F.col("type"), F.col("description"),
                  F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    per = (last.groupBy(F.col("customer_id").alias("_c"))
           .agg(F.array_sort(F.collect_list(tx)).alias("txs")))
    txs = F.transform("txs", lambda t: t.dropFields("rn"))
    lp = loyalty_points.select(F.col("customer_id").alias("_lp"), "total_points", "lifetime_points")
    return (customers.select(F.col("id").alias("customer_id"))
            .join(lp, F.col("customer_id") == F.col("_lp"), "left")
            .join(per, F.col("customer_id") == F.col("_c"), "left")
            .select("customer_id",
                    F.coalesce("total_points", F.lit(0)).cast("bigint").alias("total_points"),
                    F.coalesce("lifetime_points", F.lit(0)).cast("bigint").alias("lifetime_points"),
                    F.coalesce(txs, F.array().cast(
                        "array<struct<id:bigint,points:bigint,type:string,description:string,created_at:string>>"))
                    .alias("transactions")))
