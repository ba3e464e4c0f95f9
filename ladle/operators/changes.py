"""Change application (A3-A9, S12-S14, S18-S33): the app's UPDATE / INSERT
routes re-aimed as batch merges over whole tables.

One generic merge does the work: changes are reduced to the latest value per
key (``max_by`` over an ordering struct: partial aggregation per map task, so
a key with millions of changes is combined before the shuffle), then left
joined to the base table and coalesced.  Deletes are anti-joins.  Nothing is
updated in place; the result is a new DataFrame (write it as a new snapshot
directory, see ``sources.sinks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money, to_double
from ..sources.staging import staged
from .conflicts import resolve


def latest_per_key(changes: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The last change per key by ``order`` (struct comparison, ascending)."""
    return (changes.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_new"))
            .select(key, *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in cols]))


def last_write_wins(base: DataFrame, changes: DataFrame, key: str, order: Sequence[str], cols: Sequence[str],
                    base_key: str = "id", keep_old_if_null: Sequence[str] = (),
                    stamp: str | None = None) -> DataFrame:
    """Apply the latest change per key to ``base`` (S18 and the other status
    / attribute updates).  Columns in ``keep_old_if_null`` keep the old value
    when the change has none (e.g. a rider given only sometimes); the column
    ``stamp`` moves to the time (first of ``order``) of the latest change."""
    if stamp is not None:
        changes = changes.withColumn(stamp, F.col(order[0]))
        cols = [*cols, stamp]
    last = latest_per_key(changes, key, order, cols)
    j = base.join(last, base[base_key] == last[key], "left")
    out = []
    for c in base.columns:
        if c in cols:
            new = F.col(f"_new_{c}")
            hit = F.col(key).isNotNull()
            v = F.when(hit & (new.isNotNull() | F.lit(c not in keep_old_if_null)), new).otherwise(base[c])
            out.append(v.cast(base.schema[c].dataType).alias(c))
        else:
            out.append(base[c])
    return j.select(*out)


PRODUCE_STATUS_MAP = {"Preparing": "Confirmed"}                                          # fixed value
PRODUCE_STATUSES = ("Pending", "Confirmed", "Out for Delivery", "Delivered", "Cancelled")  # fixed value


def produce_status_changes(changes: DataFrame) -> DataFrame:
    """Map 'Preparing' to 'Confirmed', flag statuses outside the allowed five
    as rejected with the app's message (S19)."""
    st = F.coalesce(F.col("status"), F.lit(""))
    mapped = st
    for k, v in PRODUCE_STATUS_MAP.items():
        mapped = F.when(st == k, F.lit(v)).otherwise(mapped)
    ok = mapped.isin(*PRODUCE_STATUSES)
    return changes.select("*", F.when(ok, mapped).alias("new_status"),
                          F.when(~ok, F.concat(F.lit("Invalid status: "), st)).alias("error"))


def produce_status_apply(produce_orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest valid status per produce order; the rider is set only when the
    change carries one (a falsy rider id keeps the old one) (S19)."""
    c = produce_status_changes(changes).where(F.col("error").isNull()).select(
        "order_id", "ts", "seq", F.col("new_status").alias("status"),
        F.when(F.coalesce(F.col("rider_id"), F.lit(0)) != 0, F.col("rider_id")).alias("rider_id"))
    return last_write_wins(produce_orders, c, "order_id", ["ts", "seq"], ["status", "rider_id"],
                           keep_old_if_null=["rider_id"], stamp="updated_at")


def restaurant_approval_apply(restaurants: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest decision per restaurant; 'approved' also opens it.
    ``decisions``: restaurant_id, status (NULL -> approved), ts, seq."""
    d = decisions.select("restaurant_id", "ts", "seq",
                         F.coalesce(F.col("status"), F.lit("approved")).alias("status"))
    last = latest_per_key(d, "restaurant_id", ["ts", "seq"], ["status"])
    j = restaurants.join(last, restaurants["id"] == last["restaurant_id"], "left")
    new = F.col("_new_status")
    return j.select(*[
        (F.coalesce(new, F.col("status")).alias("status") if c == "status" else
         F.when(new == "approved", F.lit(1)).otherwise(F.col("is_open")).cast("int").alias("is_open")
         if c == "is_open" else restaurants[c]) for c in restaurants.columns])


def add_to_total(base: DataFrame, deltas: DataFrame, key: str, col: str, value: str) -> DataFrame:
    """``col += sum(value)`` per key (S15, S31): grouped sum + left join."""
    t = deltas.groupBy(key).agg(F.sum(money(value)).alias("_d"))
    j = base.join(t, base["id"] == t[key], "left")
    return j.select(*[(to_double(money(base[c]) + F.coalesce(F.col("_d"), F.lit(0).cast("decimal(18,2)"))).alias(c)
                       if c == col else base[c]) for c in base.columns])


def delete_keys(base: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """DELETE without cascade (S25, S24 deletes): anti-join on the key."""
    return base.join(deleted.select(F.col(key).alias("_del")), base[key] == F.col("_del"), "left_anti")


def seed_insert_ignore(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """INSERT OR IGNORE (A6): rows whose key is absent in the target."""
    fresh = new.join(target.select(F.col(key).alias("_k")), new[key] == F.col("_k"), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def seed_if_empty(target: DataFrame, defaults: DataFrame) -> DataFrame:
    """Load ``defaults`` only when the target has no rows (A7): an anti-join
    against at most one target row, so no count of the target is needed."""
    one = F.broadcast(target.limit(1).select(F.lit(1).alias("_any")))  # at most one row
    add = defaults.withColumn("_any", F.lit(1)).join(one, "_any", "left_anti").drop("_any")
    return target.unionByName(add, allowMissingColumns=True)


def add_missing_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive migration (A8): absent columns appear with their default;
    existing columns are untouched."""
    for name, default in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, default)
    return df


def backfill_defaults(df: DataFrame, stock_col: str = "stock_kg", avail_col: str = "is_available",
                      image_col: str = "image_filename", image_default: Column | None = None,
                      stock_default: float = 50.0) -> DataFrame:
    """Start-up backfill (A9): NULL/0 stock -> 50 (availability untouched),
    NULL availability -> 1, NULL/'' image -> the seeded image."""
    out = df
    if stock_col in df.columns:
        s = F.col(stock_col)
        out = out.withColumn(stock_col, F.when(s.isNull() | (s == 0), F.lit(stock_default)).otherwise(s))
    if avail_col in df.columns:
        out = out.withColumn(avail_col, F.coalesce(F.col(avail_col), F.lit(1)).cast("int"))
    if image_col in df.columns and image_default is not None:
        out = out.withColumn(image_col, F.coalesce(F.nullif(F.col(image_col), F.lit("")), image_default))
    return out


def signup_apply(users: DataFrame, signups: DataFrame, riders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sign-ups (S32): the first request per e-mail wins and an e-mail already
    present is rejected; a rider sign-up also yields a pending rider row
    (vehicle default 'Bike').  Returns (users, riders, rejected)."""
    from .windows import top_n_per_key
    first = top_n_per_key(signups, ["email"], [F.col("ts"), F.col("seq")], 1).drop("rn")
    taken = users.select(F.col("email").alias("_e"))
    ok = first.join(taken, first["email"] == F.col("_e"), "left_anti")
    rejected = signups.join(ok.select("seq"), "seq", "left_anti").withColumn("error", F.lit("Email already exists"))
    new_users = ok.select(F.col("new_id").alias("id"), "name", "email", "phone", "role",
                          F.col("ts").alias("created_at"))
    new_riders = ok.where(F.col("role") == "rider").select(
        F.col("new_id").alias("user_id"), F.coalesce("vehicle_type", F.lit("Bike")).alias("vehicle_type"),
        F.lit("pending").alias("status"))
    return (users.unionByName(new_users, allowMissingColumns=True),
            riders.unionByName(new_riders, allowMissingColumns=True), rejected)


def loyalty_manual_earn(requests: DataFrame) -> DataFrame:
    """Stand-alone earn rows (S12): int(amount / 100) points, written even
    when 0.  ``requests``: customer_id, order_amount, order_id."""
    amt = money("order_amount")
    return requests.select("customer_id", (amt / 100).cast("bigint").alias("points"), F.lit("earn").alias("type"),
                           F.concat(F.lit("Earned from order PKR "), amt.cast("bigint").cast("string"))
                           .alias("description"), "order_id")


def loyalty_manual_redeem(requests: DataFrame, balances: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Stand-alone redemptions (S13), one customer's requests in order:
    accepted when the balance covers the points, and an accepted redemption
    lowers the balance for the next.  One counter per request; a customer
    without a balance row is rejected.  ``requests``: request_id, customer_id, points, requested_at."""
    base = staged(requests.join(balances.select("customer_id", F.col("total_points").alias("bal0")), "customer_id", "left")
                  .withColumn("known", F.col("bal0").isNotNull()).withColumn("bal0", F.coalesce("bal0", F.lit(0))), "redemptions")
    rows = base.select(F.lit("redeem").alias("order_type"), "request_id", "requested_at", F.lit(0).alias("ctype"),
                       F.col("customer_id").cast("bigint").alias("ckey"), (-F.col("points")).alias("v"),
                       (F.col("points") - F.col("bal0")).alias("lo"), F.lit(None).cast("bigint").alias("hi"),
                       F.col("known").alias("fixed"))
    done = resolve(rows, max_rounds=max_rounds).rows.select("request_id", "before", "passes")
    accepted = F.col("known") & F.col("passes")
    return base.join(done, "request_id").select(
        "request_id", "customer_id", "points", "requested_at", accepted.alias("accepted"),
        (F.col("bal0") + F.col("before")).alias("balance_before"),
        F.when(~accepted, F.lit("Insufficient points")).alias("error"))


def loyalty_reconcile(loyalty_points: DataFrame, ledger: DataFrame) -> DataFrame:
    """Stored balance vs the ledger sum per customer (S14): full outer join."""
    s = ledger.groupBy("customer_id").agg(F.sum("points").cast("bigint").alias("ledger"))
    p = loyalty_points.select(F.col("customer_id").alias("_c"), F.col("total_points").alias("stored"))
    j = p.join(s, p["_c"] == s["customer_id"], "full")
    stored = F.coalesce("stored", F.lit(0))
    led = F.coalesce("ledger", F.lit(0))
    return j.select(F.coalesce("_c", "customer_id").alias("customer_id"), stored.cast("bigint").alias("stored"),
                    led.cast("bigint").alias("ledger"), (stored - led).cast("bigint").alias("diff"))
