"""Promotions across items and the exact optimum against enumeration; splits against their heuristic."""

import random
from itertools import combinations, product

import pytest

from trolley.operators import splits
from trolley.operators.splits import Basket, Line, Option, Promo
from trolley.plans import optimum

KINDS = ["n_for_t", "x_plus_y", "fixed_price", "percent_off"]


def promo(rng, k):
    kind = rng.choice(KINDS)
    n = {"n_for_t": rng.randint(2, 3), "x_plus_y": rng.randint(1, 2), "fixed_price": 0, "percent_off": rng.randint(5, 40)}[kind]
    t = {"n_for_t": rng.randint(5, 25), "x_plus_y": 1, "fixed_price": rng.randint(3, 12), "percent_off": 0}[kind]
    return Promo(k, kind, n, t, rng.randint(1, 3), rng.choice([None, 1, 2, 3]))


def paid(promo, bag):
    """What a bag of unit prices costs under a promotion, or None."""
    bag = sorted(bag)
    if promo.kind == "fixed_price":
        return len(bag) * promo.t
    if promo.kind == "percent_off":
        return sum(bag) * (100 - promo.n) // 100
    if promo.kind == "n_for_t":
        return None if len(bag) % promo.n else len(bag) // promo.n * promo.t
    group = promo.n + promo.t
    return None if len(bag) % group else sum(bag[len(bag) // group * promo.t :])


def cheapest(lines):
    """The least cost over all ways to give each unit to one promotion or to none."""
    units = [(k, x.price) for k, x in enumerate(lines) for _ in range(x.qty)]
    terms = {p.id: p for x in lines for p in x.promos}
    reach = {i: sum(x.qty for x in lines if p in x.promos) for i, p in terms.items()}
    choices = [[None, *[p.id for p in lines[k].promos if reach[p.id] >= p.least]] for k, _ in units]
    best = sum(x for _, x in units)
    for labels in product(*choices):
        cost = sum(x for (_, x), p in zip(units, labels, strict=True) if p is None)
        for i, p in terms.items():
            mine = [(k, x) for (k, x), y in zip(units, labels, strict=True) if y == i]
            if p.most is not None and any(sum(k == j for k, _ in mine) > p.most for j in range(len(lines))):
                cost = None
                break
            if mine:
                c = paid(p, [x for _, x in mine])
                if c is None:
                    cost = None
                    break
                cost += c
        if cost is not None:
            best = min(best, cost)
    return best


def test_allocation_equals_enumeration():
    rng, gained = random.Random(3), 0
    for _ in range(250):
        promos = [promo(rng, k) for k in range(rng.randint(1, 3))]
        lines = [Line(rng.randint(1, 3), rng.randint(4, 15), tuple(p for p in promos if rng.random() < 0.7)) for _ in range(rng.randint(1, 3))]
        cost, used = splits.allocate(lines)
        assert cost == cheapest(lines), lines
        assert cost <= splits.greedy(lines)[0] <= sum(x.qty * x.price for x in lines)
        gained += cost < splits.greedy(lines)[0]
        assert all(p.most is None or max(used[p.id]) <= p.most for p in promos if p.id in used)
    assert gained


def test_units_of_several_items_fill_a_bundle():
    p = Promo(1, "n_for_t", 3, 20, 1, None)
    assert splits.allocate([Line(2, 9, (p,)), Line(1, 8, (p,))]) == (20, {1: (2, 1)})
    assert splits.allocate([Line(2, 9, (p,)), Line(1, 8, ())])[0] == 26


def enumerated(needs, options, travels, stop, most, min_saving):
    best = {}
    for k in range(1, min(most, len(travels)) + 1):
        for places in combinations(range(len(travels)), k):
            each = [[o for o in own if o.place in places] or [None] for own in options]
            for choice in product(*each):
                cost = sum(travels[p] for p in places) + (k - 1) * stop
                for place in places:
                    cost += cheapest([Line(q, o.price, o.promos) for (_, q), o in zip(needs, choice, strict=True) if o and o.place == place])
                cost += sum(o.penalty for o in choice if o)
                key = sum(o is None for o in choice), cost
                best[k] = min(best.get(k, key), key)
    taken = best[1]
    for k in range(2, most + 1):
        now = best.get(k, taken)
        if now[0] < taken[0] or (now[0] == taken[0] and now[1] < taken[1] and taken[1] - now[1] >= min_saving):
            taken = now
    return taken


def test_optimum_equals_enumeration():
    rng, bundled = random.Random(5), 0
    for _ in range(60):
        places = rng.randint(1, 4)
        promos = {p: [promo(rng, 10 * p + k) for k in range(2)] for p in range(places)}
        needs = [(10 + i, rng.randint(1, 2)) for i in range(rng.randint(1, 3))]
        options = []
        for i in range(len(needs)):
            own = []
            for p in range(places):
                for v in range(rng.randint(0, 2)):
                    own.append(Option(10 * i + v, p, rng.randint(4, 15), 0 if v == 0 else 2, tuple(x for x in promos[p] if rng.random() < 0.6)))
            options.append(own)
        travels, stop, most, saving = [rng.randint(0, 6) for _ in range(places)], rng.randint(0, 4), rng.randint(1, 3), rng.choice([0, 0, 5])
        got = Basket(needs, options, travels, stop).optimum(most, saving)
        assert (got.missing, got.total + got.penalty + got.trip) == enumerated(needs, options, travels, stop, most, saving)
        assert len(got.items) == len(needs) - got.missing and {p for _, _, p in got.items} <= set(got.places)
        bundled += bool(got.bundles)
    assert bundled > 10


@pytest.mark.parametrize("most", [1, 2, 3])
def test_sets_of_places(most):
    found = [tuple(dict.fromkeys(x)) for x in splits.sets_of(5, most).tolist()]
    assert found == [c for k in range(1, most + 1) for c in combinations(range(5), k)]
    assert splits.sizes_of(5, most).tolist() == [len(x) for x in found]


def test_optimum_is_never_above_the_heuristic(spark):
    d = "/root/testdata/sf0.001"
    exact = {r.basket: (r.missing, r.objective) for r in optimum.optimal_baskets(spark, d).collect()}
    rough = {r.basket: (r.missing, r.objective) for r in optimum.split_limits(spark, d).collect()}
    more = {r.basket: r.max_stores for r in optimum.optimal_rows(spark, d).select("basket", "max_stores").collect()}
    assert exact.keys() == rough.keys() and all(exact[b] <= rough[b] for b in exact if more[b] == 1)
    best = {}
    for r in optimum.best_sets_by_size(spark, d).collect():
        if r.n_stores <= more[r.basket]:
            best[r.basket] = min(best.get(r.basket, (1 << 60, 0)), (r.missing, r.total + r.travel + r.stop_cost))
    slack = {r.basket: r.min_saving for r in optimum.optimal_rows(spark, d).select("basket", "min_saving").collect()}
    assert all(exact[b][0] <= best[b][0] and (exact[b][0] < best[b][0] or exact[b][1] <= best[b][1] + 2 * slack[b]) for b in exact)


def test_allocation_of_whole_tables(spark):
    rows = optimum.bundle_allocation(spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r.exact <= r.greedy <= r.shelf for r in rows) and any(r.bundles for r in rows)


def test_every_variant_that_may_be_best_is_an_option(spark):
    """Against all items of the asked product at each candidate store, joined plainly."""
    from pyspark.sql import functions as F

    from trolley.plans import catalogue
    from trolley.plans import tables as T

    d = "/root/testdata/sf0.001"
    items = T.items(spark, d)
    asked = catalogue.leveled(spark, d).where("level <> 'exact'").select("basket", "need", "user", "qty", "level").join(items.selectExpr("item AS need", "name AS n", "kind AS k", "size AS s"), "need")
    there = T.offers(spark, d).join(items.select("item", "name", "kind", "size"), "item").join(T.offered_deals(spark, d).select("item", "store", F.lit(True).alias("dealt")).distinct(), ["item", "store"], "left")
    every = asked.join(T.candidates(spark, d).select("user", "store"), "user").join(there, "store").where("item <> need AND IF(level = 'close', kind = k, name = n)")
    packs = F.expr("(qty * s + size - 1) div size")
    every = {(r.basket, r.need, r.store, r.item): (r.packs, r.packs * r.price, r.dealt) for r in every.select("basket", "need", "store", "item", packs.alias("packs"), "price", "dealt").collect()}
    best, had = {}, {}
    for r in optimum.optimal_rows(spark, d).collect():
        for o in r.options or []:
            had[r.basket, o.need, r.stores[o.place], o.item] = o
    for (basket, need, store, item), (packs, cost, dealt) in every.items():
        best[basket, need, store] = min(best.get((basket, need, store), 1 << 60), cost)
        if dealt:
            assert had[basket, need, store, item].packs == packs
    own = {key[:3]: o.packs * o.price for key, o in had.items() if key[1] == key[3]}
    least = {}
    for key, o in had.items():
        least[key[:3]] = min(least.get(key[:3], 1 << 60), o.packs * o.price)
    assert any(x[2] for x in every.values()) and best and all(least[key] == min(cost, own.get(key, cost)) for key, cost in best.items())


def test_weighed_baskets_equal_searched_ones(spark):
    table = optimum.optimal_rows(spark, "/root/testdata/sf0.001").toArrow().combine_chunks()
    batch = table.to_batches()[0]
    searched, search = [], splits._searched
    got = {}
    splits._searched = lambda r: searched.append(r["basket"]) or search(r)
    try:
        got = {x[0]: x for a in range(0, len(batch), 400) for x in splits._optima(batch.slice(a, 400))}
    finally:
        splits._searched = search
    known = {x[0]: x for x in map(search, batch.to_pylist()) if x}
    assert got == known and 0 < len(searched) < len(known) / 2 and any(x[-1] for k, x in got.items() if k not in searched)
    empty = batch.slice(0, 0)
    assert splits._optima(empty) == []
