"""Monthly orders of an account: whole units, the largest shortfall first, within the cash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_BUFFER_BP = 300.0


def plan_orders(accounts: DataFrame, prices: DataFrame, targets: dict[str, float], buffer_bp: float = GAP_BUFFER_BP, whole: bool = True) -> DataFrame:
    """account, asset, qty, est_price, place of the orders: never a sale, never more than the cash less the buffer.

    accounts: account, cash and held (a map from asset to quantity); prices: asset and price, a row an asset. The cash left is
    the state of a fold over an account's few assets in order of shortfall; equal ones go in the order of targets. Raises if the
    targets don't sum to 1 or one of them has no price."""
    if abs(sum(targets.values()) - 1) > 1e-9:
        raise ValueError("targets must sum to 1")
    names = list(targets)
    known = prices.where(F.col("asset").isin(names)).agg(F.map_from_entries(F.collect_list(F.struct("asset", "price"))).alias("_px"))
    # one row, of as many prices as there are targets
    a = accounts.crossJoin(F.broadcast(known)).withColumn("_cash", F.col("cash") * (1 - buffer_bp / 1e4))
    price = lambda t: F.when(F.try_element_at("_px", F.lit(t)) > 0, F.try_element_at("_px", F.lit(t))).otherwise(F.raise_error(F.lit(f"no price for {t}")).cast("double"))
    value = lambda t: F.coalesce(F.try_element_at("held", F.lit(t)), F.lit(0.0)) * price(t)
    total = sum((value(t) for t in names), F.lit(0.0)) + F.col("_cash")
    gaps = F.array(*[F.struct((-(total * w - value(t))).alias("minus"), F.lit(i).alias("i"), F.lit(t).alias("asset"), price(t).alias("price")) for i, (t, w) in enumerate(targets.items())])
    a = a.select("account", "_cash", F.array_sort(gaps).alias("_gaps"))

    def buy(s, g):
        room = F.least(-g["minus"], s["left"])
        qty = F.floor(room / g["price"]).cast("double") if whole else room / g["price"]
        qty = F.greatest(qty, F.lit(0.0))
        bought = F.struct(g["asset"].alias("asset"), qty.alias("qty"), g["price"].alias("est_price"))
        return F.struct((s["left"] - qty * g["price"]).alias("left"), F.array_append(s["out"], bought).alias("out"))

    start = F.struct(F.col("_cash").alias("left"), F.array().cast("array<struct<asset:string,qty:double,est_price:double>>").alias("out"))
    orders = a.select("account", F.posexplode(F.filter(F.aggregate("_gaps", start, buy, lambda s: s["out"]), lambda o: o["qty"] > 0)).alias("place", "o"))
    return orders.select("account", "o.asset", "o.qty", "o.est_price", (F.col("place") + 1).alias("place"))
