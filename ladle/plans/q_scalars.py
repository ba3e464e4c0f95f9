"""Registered scalar-function queries (initials, age label, progress, stars, ETA)."""

from __future__ import annotations



from ..functions import exprs as X
from .catalog import query

AS_OF = "2024-01-05 00:00:00"  # run timestamp parameter for age labels

_STATUS = """(select * from (values
  ('Pending', 0, '0%', 'Waiting for restaurant', 0, 'Waiting for confirmation'),
  ('Confirmed', 1, '25%', 'Restaurant confirmed!', 15, '~30 min'),
  ('Preparing', 2, '50%', 'Chef is cooking your food', 40, '~20 min'),
  ('Out for Delivery', 3, '75%', 'Rider is on the way!', 75, '~10 min'),
  ('Delivered', 4, '100%', 'Delivered! Enjoy your meal \U0001F389', 100, 'Delivered! ✅'))
  t(status, step, fill, label, progress, eta))"""


@query("scalar_initials", oracle="""
select id, name, upper(substr(array_to_string(list_transform(string_split(name, ' '), lambda w: substr(w, 1, 1)), ''), 1, 2)) initials
from users""")
def _initials(d):
    return d.users.select("id", "name", X.initials("name").alias("initials"))


@query("scalar_age_label", oracle=f"""
select id, created_at,
  case when m < 1 then 'just now' when m < 60 then cast(m as varchar) || 'm ago'
       when m // 60 < 24 then cast(m // 60 as varchar) || 'h ago'
       else strftime(created_at, '%-m/%-d/%Y') end age_label
from (select id, created_at,
        cast(trunc((epoch_us(timestamp '{AS_OF}') - epoch_us(created_at)) / 60000000) as bigint) m
      from messages) x""")
def _age(d):
    return d.messages.select("id", "created_at", X.age_label("created_at", AS_OF).alias("age_label"))


@query("order_progress", oracle=f"""
select o.id, o.status, coalesce(s.step, 0) step, coalesce(s.fill, '0%') fill,
  coalesce(s.label, 'Waiting for restaurant') label, coalesce(s.progress, 0) progress, coalesce(s.eta, '—') eta,
  coalesce(list_position(['Pending', 'Confirmed', 'Preparing', 'Out for Delivery', 'Delivered'], o.status), 0) - 1 step_index
from food_orders o left join {_STATUS} s on o.status = s.status""")
def _progress(d):
    return X.order_progress(d.food_orders, X.status_dim(d.spark))


@query("review_stars", oracle="""
select id, rating, repeat('⭐', rating) || repeat('☆', 5 - rating) stars from reviews""")
def _stars(d):
    return d.reviews.select("id", "rating", X.stars("rating").alias("stars"))


@query("order_eta", oracle="""
select id, coalesce(nullif(delivery_time, 0), 35) + 10 eta_minutes from restaurants""")
def _eta(d):
    return d.restaurants.select("id", X.eta_minutes("delivery_time").alias("eta_minutes"))



