"""Registered change-application queries.

Change sets are derived from the driver tables (line shipments become status
updates, pending riders and restaurants get decisions, ...), so every merge
runs over whole tables and grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ints import idiv
from ..operators import aggregates as A
from ..operators import changes as X
from ..sources import sinks
from ..sources.requests import derived_requests, ingest_checked, ingest_json
from ..sources.staging import scratch
from . import q_setops  # noqa: F401  (its SQL is an oracle here)
from .catalog import query, sql_of
from .q_nested import as_json

# Food status updates: each food line's shipment, latest by (ship date, line, part).
_FOOD_STATUS_CHANGES = """(select l_orderkey * 100000 + l_suppkey order_id, l_shipdate ts, l_linenumber seq, l_partkey part,
  case when l_linestatus = 'F' then 'Delivered' else 'Out for Delivery' end status
  from lineitem where l_orderkey % 4 <> 0)"""


def _food_status_changes(d):
    li = d.raw("lineitem").where(F.col("l_orderkey") % 4 != 0)
    return li.select((F.col("l_orderkey") * 100_000 + F.col("l_suppkey")).alias("order_id"),
                     F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("seq"),
                     F.col("l_partkey").alias("part"),
                     F.when(F.col("l_linestatus") == "F", "Delivered").otherwise("Out for Delivery").alias("status"))


@query("food_status_apply", oracle=f"""
select o.* replace (coalesce(c.status, o.status) as status, coalesce(c.ts, o.updated_at) as updated_at)
from food_orders o left join (
  select order_id, status, ts from (select *, row_number() over (partition by order_id
    order by ts desc, seq desc, part desc, status desc) rn from {_FOOD_STATUS_CHANGES} x) y where rn = 1) c
on o.id = c.order_id""")
def _s18(d):
    return X.last_write_wins(d.food_orders, _food_status_changes(d), "order_id", ["ts", "seq", "part", "status"],
                             ["status"], stamp="updated_at")


def _produce_status_changes(d):
    li = d.raw("lineitem").where(F.col("l_orderkey") % 4 == 0)
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"),
                     (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("seq"),
                     F.when(F.col("l_returnflag") == "A", "Preparing").when(F.col("l_returnflag") == "N", "Delivered")
                     .otherwise("Returned").alias("status"),
                     F.when(F.col("l_returnflag") == "N", F.col("l_suppkey") % 7).alias("rider_id"))


@query("produce_status_apply", oracle="""
with ch as (select l_orderkey order_id, l_shipdate ts, cast(l_linenumber as bigint) * 1000000000 + l_partkey seq,
    case when l_returnflag = 'A' then 'Confirmed' when l_returnflag = 'N' then 'Delivered' end status,
    case when l_returnflag = 'N' and l_suppkey % 7 <> 0 then l_suppkey % 7 end rider_id
  from lineitem where l_orderkey % 4 = 0 and l_returnflag in ('A', 'N')),
last as (select * from (select *, row_number() over (partition by order_id order by ts desc, seq desc) rn from ch) x
  where rn = 1)
select p.* replace (coalesce(l.status, p.status) as status, coalesce(l.ts, p.updated_at) as updated_at,
  case when l.order_id is not null and l.rider_id is not null then l.rider_id else p.rider_id end as rider_id)
from produce_orders p left join last l on p.id = l.order_id""")
def _s19(d):
    return X.produce_status_apply(d.produce_orders, _produce_status_changes(d))


@query("assign_riders", oracle="""
with ch as (select id order_id, created_at + interval 1 day ts, customer_id // 20 + 1 rider_id from food_orders
  where status = 'Confirmed' and rider_id is null)
select o.* replace (coalesce(ch.rider_id, o.rider_id) as rider_id, coalesce(ch.ts, o.updated_at) as updated_at,
  case when ch.order_id is not null then 'Out for Delivery' else o.status end as status)
from food_orders o left join ch on o.id = ch.order_id""")
def _s20(d):
    from ..operators.filters import available_food
    ch = available_food(d.food_orders).select(
        F.col("id").alias("order_id"), F.timestamp_add("DAY", F.lit(1), F.col("created_at")).alias("ts"),
        F.lit(0).alias("seq"), (idiv("customer_id", 20) + 1).alias("rider_id"),
        F.lit("Out for Delivery").alias("status"))
    return X.last_write_wins(d.food_orders, ch, "order_id", ["ts", "seq"], ["rider_id", "status"], stamp="updated_at")


@query("assign_produce_riders", oracle="""
with ch as (select id order_id, created_at + interval 1 day ts, customer_id // 20 + 1 rider_id from produce_orders
  where status = 'Confirmed' and (rider_id is null or rider_id = 0))
select o.* replace (coalesce(ch.rider_id, o.rider_id) as rider_id, coalesce(ch.ts, o.updated_at) as updated_at,
  case when ch.order_id is not null then 'Out for Delivery' else o.status end as status)
from produce_orders o left join ch on o.id = ch.order_id""")
def _s20_produce(d):
    from ..operators.filters import available_produce
    ch = available_produce(d.produce_orders).select(
        F.col("id").alias("order_id"), F.timestamp_add("DAY", F.lit(1), F.col("created_at")).alias("ts"),
        F.lit(0).alias("seq"), (idiv("customer_id", 20) + 1).alias("rider_id"),
        F.lit("Out for Delivery").alias("status"))
    return X.last_write_wins(d.produce_orders, ch, "order_id", ["ts", "seq"], ["rider_id", "status"], stamp="updated_at")


@query("rider_approval_apply", oracle="""
select r.* replace (case when r.status = 'pending' then case when r.id % 3 = 0 then 'rejected' else 'approved' end
  else r.status end as status) from riders r""")
def _s21(d):
    dec = d.riders.where(F.col("status") == "pending").select(
        F.col("id").alias("rider_id"), F.lit(0).alias("ts"), F.lit(0).alias("seq"),
        F.coalesce(F.when(F.col("id") % 3 == 0, F.lit("rejected")), F.lit("approved")).alias("status"))
    return X.last_write_wins(d.riders, dec, "rider_id", ["ts", "seq"], ["status"])


@query("restaurant_approval_apply", oracle="""
select r.* replace (case when r.status = 'pending' then case when r.id % 2 = 0 then 'approved' else 'rejected' end
    else r.status end as status,
  case when r.status = 'pending' and r.id % 2 = 0 then 1 else r.is_open end as is_open) from restaurants r""")
def _s22(d):
    dec = d.restaurants.where(F.col("status") == "pending").select(
        F.col("id").alias("restaurant_id"), F.lit(0).alias("ts"), F.lit(0).alias("seq"),
        F.when(F.col("id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("rejected")).alias("status"))
    return X.restaurant_approval_apply(d.restaurants, dec)


@query("restaurants_upsert", oracle="""
select r.* replace (case when r.manager_id = 1000000 + s.s_suppkey and s.s_acctbal > 5000 then upper(r.name)
  else r.name end as name) from restaurants r join supplier s on r.id = s.s_suppkey""")
def _s23(d):
    """Managers rename their own restaurants (suppliers with a high balance);
    an update whose manager does not own the restaurant is ignored."""
    s = d.raw("supplier")
    ch = (d.restaurants.join(s, d.restaurants["id"] == s["s_suppkey"])
          .where(F.col("s_acctbal") > 5000)
          .select(F.col("id").alias("restaurant_id"), (F.col("s_suppkey") + 1_000_000).alias("by_manager"),
                  F.lit(0).alias("ts"), F.lit(0).alias("seq"), F.upper("name").alias("name")))
    owned = ch.join(d.restaurants.select(F.col("id").alias("_r"), F.col("manager_id").alias("_m")),
                    (F.col("restaurant_id") == F.col("_r")) & (F.col("by_manager") == F.col("_m")), "left_semi")
    return X.last_write_wins(d.restaurants, owned, "restaurant_id", ["ts", "seq"], ["name"])


@query("menu_upsert", oracle="""
select m.* replace (case when m.price > 1500 then 1 - m.is_available else m.is_available end as is_available)
from menu_items m where m.category_id is not null""")
def _s24(d):
    """Toggle availability of the pricey items; delete items with no category."""
    tog = d.menu_items.where(F.col("price") > 1500).select(
        F.col("id").alias("item_id"), F.lit(0).alias("ts"), F.lit(0).alias("seq"),
        (1 - F.col("is_available")).alias("is_available"))
    upd = X.last_write_wins(d.menu_items, tog, "item_id", ["ts", "seq"], ["is_available"])
    return X.delete_keys(upd, d.menu_items.where(F.col("category_id").isNull()))


@query("restaurants_delete", oracle="select * from restaurants where status <> 'rejected'")
def _s25(d):
    return X.delete_keys(d.restaurants, d.restaurants.where(F.col("status") == "rejected"))


@query("produce_restock", oracle="""
select p.* replace (case when stock_kg < 10 then 50.0 else stock_kg end as stock_kg,
  case when stock_kg < 10 then 1 else is_available end as is_available) from produce_items p""")
def _s26(d):
    ch = d.produce_items.where(F.col("stock_kg") < 10).select(
        F.col("id").alias("produce_id"), F.lit(0).alias("ts"), F.lit(0).alias("seq"),
        F.lit(50.0).alias("stock_kg"), F.lit(1).alias("is_available"))
    return X.last_write_wins(d.produce_items, ch, "produce_id", ["ts", "seq"], ["stock_kg", "is_available"])


@query("produce_toggle", oracle="""
select p.* replace (case when category = 'fruit' then 1 - is_available else is_available end as is_available)
from produce_items p""")
def _s27(d):
    ch = d.produce_items.where(F.col("category") == "fruit").select(
        F.col("id").alias("produce_id"), F.lit(0).alias("ts"), F.lit(0).alias("seq"),
        (1 - F.col("is_available")).alias("is_available"))
    return X.last_write_wins(d.produce_items, ch, "produce_id", ["ts", "seq"], ["is_available"])


@query("produce_reprice", oracle="""
select p.* replace (case when (p_retailprice - 1000) > 0 then p_retailprice - 1000 else price_per_kg end
  as price_per_kg) from produce_items p join part on p.id = p_partkey""")
def _s28(d):
    """New price = retail - 1000; non-positive prices are rejected."""
    ch = d.raw("part").select(F.col("p_partkey").alias("produce_id"), F.lit(0).alias("ts"), F.lit(0).alias("seq"),
                              (F.col("p_retailprice") - 1000).alias("price_per_kg"))
    return X.last_write_wins(d.produce_items, ch.where(F.col("price_per_kg") > 0), "produce_id", ["ts", "seq"],
                             ["price_per_kg"])


@query("promos_upsert", oracle="""
with cand as (select upper(trim(n_name)) || '5' code, n_nationkey k from nation),
first as (select code, min(k) k from cand group by code),
fresh as (select code from first where code not in (select code from promo_codes))
select code, discount_type, is_active from promo_codes where id % 4 <> 0
union all select code, 'percent', 1 from fresh""")
def _s29(d):
    """Create one code per nation (upper-cased; duplicates and existing codes
    rejected, first wins), toggle nothing, delete every 4th existing code."""
    from ..operators.windows import top_n_per_key
    cand = d.raw("nation").select(F.concat(F.upper(F.trim("n_name")), F.lit("5")).alias("code"),
                                  F.col("n_nationkey").alias("k"))
    first = top_n_per_key(cand, ["code"], [F.col("k")], 1)
    fresh = first.join(d.promo_codes.select("code"), "code", "left_anti").select(
        "code", F.lit("percent").alias("discount_type"), F.lit(1).alias("is_active"))
    kept = X.delete_keys(d.promo_codes, d.promo_codes.where(F.col("id") % 4 == 0))
    return kept.select("code", "discount_type", "is_active").unionByName(fresh)


@query("messages_append_read", oracle="""
select m.* replace (case when m.receiver_id = (select min(id) from users where role = 'admin') then 1 else m.is_read end
  as is_read) from messages m""")
def _s30(d):
    """The admin opens every conversation: messages to the admin become read
    (a semi-join flag update)."""
    admin = A.first_admin_id(d.users)
    return d.messages.withColumn("is_read", F.when(F.col("receiver_id") == admin, F.lit(1))
                                 .otherwise(F.col("is_read")).cast("int"))


@query("rider_earnings_apply", oracle="""
select r.* replace (cast(cast(r.total_earnings as decimal(18,2)) + coalesce(t.s, 0) as double) as total_earnings)
from riders r left join (select rider_id, sum(cast(rider_tip as decimal(18,2))) s from food_orders
  where status = 'Delivered' and rider_id is not null group by rider_id) t on r.id = t.rider_id""")
def _s31(d):
    tips = d.food_orders.where((F.col("status") == "Delivered") & F.col("rider_id").isNotNull())
    return X.add_to_total(d.riders, tips, "rider_id", "total_earnings", "rider_tip")


@query("signup_apply", oracle="""
with s as (select c_custkey + 3000000 new_id, c_name || ' Jr' name,
    'j' || cast(c_custkey % (select count(*) // 2 + 1 from customer) as varchar) || '@example.com' email,
    '' phone, case when c_custkey % 3 = 0 then 'rider' else 'customer' end role, c_custkey seq from customer),
f as (select * from (select *, row_number() over (partition by email order by seq) rn from s) x where rn = 1)
select id, name, email, role from users
union all select new_id, name, email, role from f where email not in (select email from users)""")
def _s32(d):
    c = d.raw("customer")
    half = c.select((F.count(F.lit(1)) / 2).cast("bigint") + 1).scalar()
    s = c.select((F.col("c_custkey") + 3_000_000).alias("new_id"), F.concat(F.col("c_name"), F.lit(" Jr")).alias("name"),
                 F.concat(F.lit("j"), (F.col("c_custkey") % half).cast("string"), F.lit("@example.com")).alias("email"),
                 F.lit("").alias("phone"),
                 F.when(F.col("c_custkey") % 3 == 0, "rider").otherwise("customer").alias("role"),
                 F.lit(None).cast("string").alias("vehicle_type"),
                 F.lit("2024-06-01").cast("date").cast("timestamp_ntz").alias("ts"), F.col("c_custkey").alias("seq"))
    users, _riders, _rej = X.signup_apply(d.users, s, d.riders)
    return users.select("id", "name", "email", "role")


@query("reviews_apply", oracle="""
with rv as (select * from reviews union all
  select id + 1000000000, customer_id, restaurant_id, 5, 'again', created_at from reviews where rating = 1)
select r.id, coalesce(cast(floor((p.s * 20 + p.n) / (p.n * 2)) as double) / 10, r.rating) rating
from restaurants r left join (select restaurant_id, cast(sum(rating) as bigint) s, count(*) n from rv
  group by restaurant_id) p on r.id = p.restaurant_id""")
def _s33(d):
    """Append a 5-star follow-up for every 1-star review, then recompute ratings."""
    extra = d.reviews.where(F.col("rating") == 1).select(
        (F.col("id") + 1_000_000_000).alias("id"), "customer_id", "restaurant_id", F.lit(5).alias("rating"),
        F.lit("again").alias("comment"), "created_at")
    return A.restaurant_rating(d.restaurants, d.reviews.unionByName(extra)).select("id", "rating")


@query("orders_ingest")
def _a3(d):
    """Requests serialised as JSON lines, produce orders with the field names
    of their own body, and decoded back with the explicit schema and the
    app's defaults."""
    r = derived_requests(d).drop("payment_method", "estimated_time")
    produce = F.col("order_type") == "produce"
    body = [F.when(~produce, F.col(c)).alias(c) if c in ("order_type", "subtotal", "items") else F.col(c)
            for c in r.columns]
    lines = F.transform("items", lambda i: F.struct(i["item_id"].alias("produce_id"), i["quantity"].alias("quantity_kg"),
                                                    i["unit_price"].alias("unit_price")))
    own = F.to_json(F.struct(*[F.col(c) for c in r.columns if c not in ("order_type", "subtotal", "items")],
                             F.col("subtotal").alias("total_amount"), lines.alias("items")))
    return ingest_json(r.select(F.when(produce, own).otherwise(F.to_json(F.struct(*body))).alias("value")))


@query("json_export", oracle="""
select id, cast(to_json(struct_pack(id := id, name := name, cuisine := cuisine, rating := rating)) as varchar) json
from restaurants""")
def _a4(d):
    return d.restaurants.select("id", F.to_json(F.struct("id", "name", "cuisine", "rating")).alias("json"))


@query("json_export_nested", oracle=sql_of("customer_order_history"))
def _a4_nested(d):
    """The order history with its items, exported as JSON lines and read back."""
    from ..operators.setops import customer_order_history
    path = scratch(d.spark, "export")
    rows = customer_order_history(d)
    sinks.json_export(rows, path)
    return sinks.json_import(d.spark, path, rows.schema).withColumn("items", as_json("items"))


# Derived requests with a broken body: cut off, without an id, or with text for a number.
BROKEN = {7: "cut off", 19: "no id", 31: "not a number"}


@query("orders_ingest_rejects", oracle="""
select request_id, case when request_id % 7 = 3 then 'not JSON of the expected form'
  when request_id % 19 = 3 then 'no request_id' else 'not JSON of the expected form' end error
from (select id request_id from food_orders union all select id from produce_orders) x
where request_id % 7 = 3 or request_id % 19 = 3 or request_id % 31 = 3""")
def _a3_rejects(d):
    """Bodies that cannot be a request, kept with their error; the id is what the broken body was made from."""
    r = derived_requests(d).select("request_id", F.to_json(F.struct("request_id", "customer_id", "subtotal")).alias("body"))
    cut, no_id, text = (F.col("request_id") % n == 3 for n in BROKEN)
    value = (F.when(cut, F.substring("body", 1, 12)).when(no_id, F.regexp_replace("body", r'"request_id":\d+,', ""))
             .when(text, F.regexp_replace("body", r'"customer_id":\d+', '"customer_id":"none"')).otherwise(F.col("body")))
    _, rejects = ingest_checked(r.select(F.col("request_id").alias("made_from"), value.alias("value")))
    return rejects.select(F.col("made_from").alias("request_id"), "error")


@query("audit_append", oracle="""
select user_id, action, details, "timestamp", cast("timestamp" as date) event_date from audit_log""")
def _a5(d):
    """The audit rows appended in three batches, the second of them twice (a replay), and read back."""
    path = scratch(d.spark, "audit")
    rows = d.audit_log.select("id", "user_id", "action", "details", "timestamp")
    for batch in (0, 1, 2, 1):
        sinks.audit_append(rows.where(F.col("id") % 3 == batch).drop("id"), path, batch=str(batch))
    return sinks.audit_read(d.spark, path).select("user_id", "action", "details", "timestamp", "event_date")


@query("audit_day", oracle="""
select user_id, action, details, "timestamp", cast("timestamp" as date) event_date from audit_log
where cast("timestamp" as date) = (select cast(min("timestamp") as date) from audit_log)""")
def _a5_day(d):
    """The first day's audit rows: the read prunes to its partition."""
    path = scratch(d.spark, "audit")
    sinks.audit_append(d.audit_log.select("user_id", "action", "details", "timestamp"), path, batch="all")
    first = str(d.audit_log.agg(F.min("timestamp").cast("date")).first()[0])
    return sinks.audit_read(d.spark, path, first, first).select("user_id", "action", "details", "timestamp", "event_date")


@query("seed_insert_ignore", oracle="""
select id, name, category from produce_items union all
select p_partkey + 1000000, p_name, 'fruit' from part where p_size = 1 and p_partkey + 1000000 not in (select id from produce_items)""")
def _a6(d):
    new = d.raw("part").where(F.col("p_size") == 1).select(
        (F.col("p_partkey") + 1_000_000).alias("id"), F.col("p_name").alias("name"), F.lit("fruit").alias("category"))
    return X.seed_insert_ignore(d.produce_items.select("id", "name", "category"), new, "id")


@query("seed_if_empty", oracle="""
select code, discount_type from promo_codes""")
def _a7(d):
    defaults = d.raw("nation").select(F.concat(F.lit("SEED"), F.col("n_nationkey").cast("string")).alias("code"),
                                      F.lit("percent").alias("discount_type"))
    return X.seed_if_empty(d.promo_codes.select("code", "discount_type"), defaults)


@query("add_missing_columns", oracle="""
select r.*, '' address from restaurants r""")
def _a8(d):
    return X.add_missing_columns(d.restaurants, {"address": F.lit(""), "rating": F.lit(0.0)})


@query("read_schema_versions", oracle="""
select r.* replace (case when id % 3 = 0 then 0.0 else rating end as rating, cast(delivery_time as bigint) as delivery_time),
  case when id % 3 = 2 then 'Street ' || cast(id as varchar) when id % 3 = 1 then 'unknown' else '' end address
from restaurants r""")
def _a8_versions(d):
    """Restaurants written by three versions of the app: the first without rating and address, with a short number for
    the delivery time; the second without address; the third with all columns."""
    root = scratch(d.spark, "versions")
    wide = d.restaurants.withColumns({"delivery_time": F.col("delivery_time").cast("bigint"),
                                      "address": F.concat(F.lit("Street "), F.col("id").cast("string"))})
    parts = {1: d.restaurants.where("id % 3 = 0").drop("rating").withColumn("delivery_time", F.col("delivery_time").cast("smallint")),
             2: wide.where("id % 3 = 1").drop("address"), 3: wide.where("id % 3 = 2")}
    for n, df in parts.items():
        df.write.parquet(f"{root}/schema={n}")
    return sinks.read_versions(d.spark, root, wide.schema, {1: {"rating": F.lit(0.0), "address": F.lit("")},
                                                            2: {"address": F.lit("unknown")}})


@query("backfill_defaults", oracle="""
select p.* replace (case when stock_kg is null or stock_kg = 0 then 50.0 else stock_kg end as stock_kg,
  cast(coalesce(is_available, 1) as integer) as is_available,
  coalesce(nullif(image_filename, ''), 'produce_' || cast(id as varchar) || '.jpg') as image_filename)
from produce_items p""")
def _a9(d):
    return X.backfill_defaults(d.produce_items, image_default=F.concat(F.lit("produce_"), F.col("id").cast("string"),
                                                                       F.lit(".jpg")))
