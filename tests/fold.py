"""Plain-Python one-by-one settlement, the reference semantics the Spark
fixpoint must reproduce.  Test helper only: it walks requests in order and
mutates small dicts, exactly like handling one request per transaction."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

D2 = Decimal("0.01")


def _r2(x: Decimal) -> Decimal:
    return x.quantize(D2, rounding=ROUND_HALF_UP)


def _s(x) -> str:
    return str(float(x))


def fold(requests, menu, produce, promos, balances, ui_adds_fee=True):
    """requests: dicts with request_id, requested_at, order_type, customer_id,
    restaurant_id, subtotal, delivery_fee, promo_code, promo_discount,
    loyalty_discount, items=[(item_id, quantity, unit_price)].
    menu: id -> (name, restaurant_id, is_available); produce: id -> [name,
    is_available, stock Decimal]; promos: code -> [max_uses, used] (active
    only); balances: customer -> points.  Returns {(type, id): error|None}."""
    produce = {k: list(v) for k, v in produce.items()}
    promos = {k: list(v) for k, v in promos.items()}
    balances = dict(balances)
    out = {}
    for r in sorted(requests, key=lambda r: (r["requested_at"], r["order_type"], r["request_id"])):
        key = (r["order_type"], r["request_id"])
        err = None
        food = r["order_type"] == "food"
        for item_id, qty, _ in r["items"]:
            if food:
                row = menu.get(item_id)
                if row is None:
                    err = f"Menu item {item_id} not found"
                elif row[1] != r["restaurant_id"]:
                    err = f"Menu item {row[0]} does not belong to selected restaurant"
                elif not row[2]:
                    err = f"Menu item {row[0]} is currently unavailable"
            else:
                row = produce.get(item_id)
                if row is None:
                    err = f"Produce item {item_id} not found"
                elif not row[1] or row[2] <= 0:
                    err = f"Produce item '{row[0]}' is currently out of stock"
                elif Decimal(str(qty)) > row[2]:
                    err = (f"Not enough stock for '{row[0]}' — requested {_s(qty)}kg, "
                           f"only {_s(row[2])}kg available")
            if err:
                break
        code = r.get("promo_code")
        if err is None and code:
            p = promos.get(code)
            if p is None:
                err = f"Promo code '{code}' is invalid or inactive"
            elif p[1] >= p[0]:
                err = f"Promo code '{code}' has reached its usage limit ({p[0]}/{p[0]})"
        disc = Decimal(str(r.get("loyalty_discount") or 0))
        if err is None and disc > 0:
            have = balances.get(r["customer_id"], 0)
            if have < int(disc):
                err = f"Insufficient loyalty points (have {have}, need {int(disc)})"
        out[key] = err
        if err is not None:
            continue
        sub = Decimal(str(r["subtotal"]))
        fee = Decimal(str(r.get("delivery_fee", 50)))
        promo = Decimal(str(r.get("promo_discount") or 0))
        if food:
            total = _r2(max(Decimal(0), sub + fee + _r2(sub * Decimal("0.05")) - promo - disc))
        else:
            amount = sub + (fee if ui_adds_fee else 0)
            total = _r2(max(Decimal(0), amount + fee - promo - disc))
        cid = r["customer_id"]
        balances[cid] = balances.get(cid, 0) + int(total / 100)
        if code:
            promos[code][1] += 1
        if disc > 0:
            balances[cid] = max(0, balances[cid] - int(disc))
        if not food:
            for item_id, qty, _ in r["items"]:
                row = produce[item_id]
                row[2] = max(Decimal(0), row[2] - Decimal(str(qty)))
                if row[2] <= 0:
                    row[1] = 0
    return out
