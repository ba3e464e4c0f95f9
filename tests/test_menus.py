"""Menus (N3-N5) on literal fixtures: empty and filled categories, items without one, strays, nothing at all."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ladle.operators import nested

RESTAURANTS = [(1, "both"), (2, "loose only"), (3, "strays only"), (4, "nothing"), (5, "empty category"), (6, "unavailable")]
CATEGORIES = [(10, 1, "Soups"), (11, 1, "Breads"), (12, 5, "Empty"), (13, 6, "Hot")]
# id, restaurant_id, category_id, is_available
ITEMS = [(100, 1, 10, 1), (101, 1, 10, 0), (102, 1, None, 1), (103, 1, 0, 1), (104, 1, 12, 1), (105, 2, 0, 1), (106, 2, None, 1),
         (109, 3, 10, 1), (108, 3, 99, 1), (107, 3, 10, 1), (110, 6, 13, 0), (111, None, None, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    items = [(i, r, c, f"item {i}", None, float(i), a) for i, r, c, a in ITEMS]
    return (spark.createDataFrame(RESTAURANTS, "id long, name string"),
            spark.createDataFrame(CATEGORIES, "id long, restaurant_id long, name string"),
            spark.createDataFrame(items, "id long, restaurant_id long, category_id long, name string, description string, "
                                         "price double, is_available int"))


def shown(menu):
    rows = menu.collect()
    assert Counter(r.id for r in rows) == Counter(i for i, _ in RESTAURANTS)
    return {r.id: [(c.id, c.name, [i.id for i in c["items"]]) for c in r.categories] for r in rows}


def test_customer_menu(tables):
    menu = nested.restaurant_menu(*tables)
    assert shown(menu) == {
        1: [(10, "Soups", [100]), (11, "Breads", []), (None, "Menu", [102, 103])], 2: [(None, "Menu", [105, 106])],
        3: [(None, "Menu", [107, 108, 109])], 4: [], 5: [(12, "Empty", [])], 6: [(13, "Hot", [])]}
    assert shown(nested.menu_filled_categories(menu))[1] == [(10, "Soups", [100]), (None, "Menu", [102, 103])]


def test_manager_menu(tables):
    assert shown(nested.manager_menu(*tables)) == {
        1: [(10, "Soups", [100, 101]), (11, "Breads", []), (None, "Uncategorised", [102, 103])],
        2: [(None, "Uncategorised", [105, 106])], 3: [], 4: [], 5: [(12, "Empty", [])], 6: [(13, "Hot", [110])]}


def test_without_items_or_categories(tables):
    restaurants, categories, items = tables
    none = F.lit(False)
    assert shown(nested.restaurant_menu(restaurants, categories, items.where(none)))[1] == [(10, "Soups", []), (11, "Breads", [])]
    assert shown(nested.restaurant_menu(restaurants, categories.where(none), items))[1] == [(None, "Menu", [102, 103])]


def test_items_are_shuffled_once(tables):
    """Items are grouped by one aggregation; no other branch reads them."""
    plan = nested.restaurant_menu(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 3, plan
