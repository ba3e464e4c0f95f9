"""Quality checks on data that breaks the rules, against brute force."""

from collections import Counter
from functools import cached_property

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ladle.operators import quality as Q
from ladle.sources.domain import Domain


class WithoutRejectedRestaurants(Domain):
    """The domain after deleting rejected restaurants without cascading."""

    @cached_property
    def restaurants(self):
        return super().restaurants.where(F.col("status") != "rejected")


def test_orphans_after_delete(spark):
    d = WithoutRejectedRestaurants(spark, SF_SMALL)
    full = Domain(spark, SF_SMALL)
    gone = {r.id for r in full.restaurants.where(F.col("status") == "rejected").collect()}
    assert gone
    want = Counter()
    for t in ("categories", "menu_items", "food_orders", "reviews"):
        for r in getattr(full, t).select("restaurant_id").collect():
            if r.restaurant_id in gone:
                want[f"restaurant_id->restaurants.id"] += 1
    # restaurants of deleted managers are untouched; only restaurant references break
    got = Counter(r.column_name for r in Q.check_orphans(d).collect())
    assert got == want


def test_enum_and_required_rules(spark):
    class Broken(Domain):
        @cached_property
        def users(self):
            u = super().users
            return u.withColumn("role", F.when(F.col("id") == 0, F.lit("chef")).otherwise(F.col("role"))) \
                    .withColumn("email", F.when(F.col("id") == 1, F.lit(None)).otherwise(F.col("email")))

    d = Broken(spark, SF_SMALL)
    enums = {(r.table_name, r.column_name, r.row_key, r.value) for r in Q.check_enums(d).collect()
             if r.table_name == "users"}
    assert enums == {("users", "role", "0", "chef")}
    req = {(r.table_name, r.column_name, r.row_key) for r in Q.check_required(d).collect()}
    assert req == {("users", "email", "1")}
