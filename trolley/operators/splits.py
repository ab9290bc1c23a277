"""A basket over one to three stores: the best sets of stores by what their needs cost, and the exact optimum with promotions across items.

A basket is one household's list, so it is one row here: its needs with what they cost at each of a bounded number of
candidate stores. Rows are spread by basket, and a task weighs all sets of stores of many baskets as arrays.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.operators.shared import ship

#: Candidate stores of a user at most, and stores of a set at most.
PLACES, MOST = 12, 3
#: More than any basket costs, and what it is counted in where a need is missing.
NONE = 1 << 40
#: Lines weighed at a time.
LINES = 2048


@cache
def sets_of(places: int, most: int) -> np.ndarray:
    """Every set of one to most of the places, ascending by size and places; a smaller set repeats its last place."""
    found = [s for k in range(1, most + 1) for s in combinations(range(places), k)]
    return np.array([(*s, *[s[-1]] * (most - len(s))) for s in found], np.int64).reshape(-1, most)


@cache
def sizes_of(places: int, most: int) -> np.ndarray:
    return np.array([k for k in range(1, most + 1) for _ in combinations(range(places), k)], np.int64)


def cost_rows(hits: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """basket, lines: for each need with an offer the costs at places 0 to PLACES - 1 (null: not there), behind them what the usual store asks.

    hits: basket, need, place, usual, cost.
    """
    at = [F.min(F.when(F.col("place") == k, F.col("cost"))) for k in range(PLACES)]
    line = F.array(*at, F.max(F.when(F.col("usual"), F.col("cost"))))
    return hits.repartition("basket").groupBy("basket", "need").agg(line.alias("line")).groupBy("basket").agg(F.collect_list("line").alias("lines"))


def store_rows(candidates: DataFrame) -> DataFrame:
    """user, stores, travels: by place, from 0; usual_travel: to the usual store, null without one. candidates: user, store, place, travel, usual (may be left out); at most PLACES a user."""
    one = F.sort_array(F.collect_list(F.struct("place", "store", "travel")))
    own = F.when(F.col("usual"), F.col("travel")) if "usual" in candidates.columns else F.lit(None).cast("long")
    return candidates.groupBy("user").agg(one.alias("c"), F.max(own).alias("usual_travel")).select("user", F.col("c.store").alias("stores"), F.col("c.travel").alias("travels"), "usual_travel")


_CHOICE = "basket long, user long, alternative string, n_stores int, a long, b long, c long, missing long, total long, travel long, stop_cost long, saving long"
_FIELDS = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in _CHOICE.split(", ")]


def _flat(column: pa.Array, fill: int) -> np.ndarray:
    return column.flatten().fill_null(fill).to_numpy(zero_copy_only=False)


def _weighed(batch: pa.RecordBatch, most: int) -> tuple[np.ndarray, ...]:
    """By basket and set of places: needs found, their total, and what they cost less than at the usual store."""
    lines = batch.column("lines")
    first = np.concatenate([[0], np.cumsum(np.where(lines.is_valid().to_numpy(zero_copy_only=False), lines.value_lengths().fill_null(0).to_numpy(), 0))])
    values = lines.flatten().flatten().fill_null(NONE).to_numpy(zero_copy_only=False).reshape(-1, PLACES + 1)
    sets = sets_of(PLACES, most)
    out = [np.zeros((len(batch), len(sets)), np.int64) for _ in range(3)]
    of = np.repeat(np.arange(len(batch)), np.diff(first))
    for a in range(0, len(values), LINES):
        part, own = values[a : a + LINES], of[a : a + LINES]
        best = part[:, sets[:, 0]]
        for j in range(1, most):
            best = np.minimum(best, part[:, sets[:, j]])
        found = best < NONE
        best = np.where(found, best, 0)
        usual = part[:, -1:]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        for total, x in zip(out, (found.astype(np.int64), best, np.where(found & (usual < NONE), usual - best, 0)), strict=True):
            total[own[start]] += np.add.reduceat(x, start, axis=0)
    return tuple(out)


def best_sets(asked: DataFrame, hits: DataFrame, candidates: DataFrame, terms: DataFrame, most: int = 2, by_size: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The best sets of stores of each basket, with columns as _CHOICE; b and c are -1 where a set is smaller.

    alternative: single (fewest missing, then the least total), split (any size, by total with its trip), least_effort (one
    store, least travel first). With by_size, best_1 to best_<most> instead: the best set of each size by total with its trip.
    A set's stores stand in the order of their places; ties go to the smaller ids in that order. Needs cost what the cheapest
    member asks. asked: basket, user, n.
    hits: basket, need, place, usual, cost. candidates: user, store, place, travel. terms: user, stop_value.
    keep: columns (long) of asked or terms, or usual_travel, that go along behind the others, so that the choices meet no user again.
    """
    ship(asked.sparkSession)
    own = [c for c in keep if c in terms.columns and c not in asked.columns]
    rows = asked.join(cost_rows(hits), "basket", "left").join(store_rows(candidates), "user").join(terms.select("user", *[F.col(c).cast("long").alias(c) for c in ("stop_value", *own)]), "user")
    fields = [*_FIELDS, *[(c, pa.int64()) for c in keep]]

    def run(batches):
        sets, size = sets_of(PLACES, most), sizes_of(PLACES, most)
        for batch in batches:
            if not len(batch):
                continue
            found, total, saving = _weighed(batch, most)
            places = batch.column("stores").value_lengths().to_numpy()
            stores, travels = np.full((len(batch), PLACES), -1, np.int64), np.zeros((len(batch), PLACES), np.int64)
            there = np.arange(PLACES) < places[:, None]
            stores[there], travels[there] = _flat(batch.column("stores"), -1), _flat(batch.column("travels"), 0)
            member = np.zeros((len(sets), PLACES), np.int64)
            member[np.arange(len(sets))[:, None], sets] = 1
            travel = travels @ member.T
            stop = (size - 1) * batch.column("stop_value").to_numpy()[:, None]
            missing = batch.column("n").to_numpy()[:, None] - found
            valid = sets.max(axis=1) < places[:, None]
            kept = np.where(np.arange(most) < size[:, None], stores[:, sets], -1)
            if by_size:
                wanted = {f"best_{k}": (size == k, [missing, total + travel + stop]) for k in range(1, most + 1)}
            else:
                wanted = {"single": (size == 1, [missing, total]), "split": (size > 0, [missing, total + travel + stop]), "least_effort": (size == 1, [travel, missing, total])}
            for name, (allowed, keys) in wanted.items():
                ok = valid & allowed
                for key in [*keys, *np.moveaxis(kept, 2, 0)]:
                    ok &= key == np.where(ok, key, 1 << 62).min(axis=1, keepdims=True)
                some = np.flatnonzero(ok.any(axis=1))
                k = ok[some].argmax(axis=1)
                pick = lambda x, some=some, k=k: x[some, k]
                ids = np.full((len(some), 3), -1, np.int64)
                ids[:, :most] = kept[some, k]
                columns = dict(basket=batch.column("basket").take(pa.array(some)), user=batch.column("user").take(pa.array(some)), alternative=[name] * len(some), n_stores=size[k], a=ids[:, 0], b=ids[:, 1], c=ids[:, 2], missing=pick(missing), total=pick(total), travel=pick(travel), stop_cost=pick(stop), saving=pick(saving))
                columns |= {c: batch.column(c).take(pa.array(some)) for c in keep}
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for (_, t), x in zip(fields, (columns[c] for c, _ in fields), strict=True)], names=[c for c, _ in fields])

    return rows.select("basket", "user", "n", "lines", "stores", "travels", "stop_value", *keep).mapInArrow(run, ", ".join([_CHOICE, *[f"{c} long" for c in keep]]))


# ---- the exact optimum


@dataclass(frozen=True)
class Promo:
    """Terms at one store. n_for_t: n units for t. x_plus_y: of n + t units the t cheapest are free. fixed_price: t a unit. percent_off: n percent."""

    id: int
    kind: str
    n: int
    t: int
    least: int
    most: int | None


@dataclass(frozen=True)
class Option:
    """A product for a need at a place: its price, what its choice costs in preference, the promotions that cover it, its packs if not the need's quantity."""

    item: int
    place: int
    price: int
    penalty: int = 0
    promos: tuple[Promo, ...] = ()
    packs: int | None = None


@dataclass
class Line:
    """What is bought at one place for one need."""

    qty: int
    price: int
    promos: tuple[Promo, ...] = field(default=())


def _reward(promo: Promo, units: tuple[int, ...], prices: tuple[int, ...]) -> int | None:
    """What these units cost together under a promotion; None if they are no whole bundles."""
    m = sum(units)
    if promo.kind == "fixed_price":
        return m * promo.t
    if promo.kind == "percent_off":
        return sum(u * p for u, p in zip(units, prices, strict=True)) * (100 - promo.n) // 100
    group = promo.n if promo.kind == "n_for_t" else promo.n + promo.t
    if group <= 0 or m % group:
        return None
    bundles = m // group
    if promo.kind == "n_for_t":
        return bundles * promo.t
    free, out = bundles * promo.t, 0
    for p, u in sorted(zip(prices, units, strict=True)):
        paid = max(0, u - free)
        free -= u - paid
        out += paid * p
    return out


def _rate(promo: Promo, price: int) -> float:
    """The least that a unit may cost under a promotion, as a share of what its bundle costs."""
    if promo.kind == "n_for_t":
        return promo.t / promo.n if promo.n else price
    if promo.kind == "x_plus_y":
        return price * promo.n / (promo.n + promo.t) if promo.n + promo.t else price
    return promo.t if promo.kind == "fixed_price" else price * (100 - promo.n) / 100


def _usable(lines: list[Line]) -> list[tuple[Promo, list[int]]]:
    """The promotions whose least quantity the lines reach together, with the lines that they cover."""
    cover: dict[Promo, list[int]] = defaultdict(list)
    for k, line in enumerate(lines):
        for p in line.promos:
            cover[p].append(k)
    return [(p, ks) for p, ks in sorted(cover.items(), key=lambda x: x[0].id) if sum(lines[k].qty for k in ks) >= p.least]


def greedy(lines: list[Line]) -> tuple[int, dict[int, tuple[int, ...]]]:
    """Promotions one by one, that with the largest discount for what is left first, on as many units as it takes."""
    left, todo, cost, used = [x.qty for x in lines], _usable(lines), 0, {}
    while todo:
        best = None
        for p, ks in todo:
            units = [min(left[k], p.most if p.most is not None else left[k]) for k in ks]
            group = {"n_for_t": p.n, "x_plus_y": p.n + p.t}.get(p.kind, 1)
            drop = sum(units) % group if group > 0 else sum(units)
            for j in sorted(range(len(ks)), key=lambda j: lines[ks[j]].price):  # the cheapest units stay out of the last bundle
                take = min(drop, units[j])
                units[j], drop = units[j] - take, drop - take
            prices = tuple(lines[k].price for k in ks)
            paid = _reward(p, tuple(units), prices)
            gain = sum(u * x for u, x in zip(units, prices, strict=True)) - (paid if paid is not None else 1 << 60)
            if sum(units) and gain > 0 and (best is None or gain > best[0]):
                best = gain, p, ks, units, paid
        if best is None:
            break
        _, p, ks, units, paid = best
        cost += paid
        used[p.id] = tuple(units)
        for k, u in zip(ks, units, strict=True):
            left[k] -= u
        todo = [x for x in todo if x[0] != p]
    return cost + sum(n * x.price for n, x in zip(left, lines, strict=True)), used


def allocate(lines: list[Line]) -> tuple[int, dict[int, tuple[int, ...]]]:
    """The least that lines of one store cost together, and the units that each promotion takes of the lines that it covers.

    Each unit goes to one promotion or to none. Branches over the promotions: what is left of each line after the promotions
    so far, and the least cost that led there; a branch ends where its cost and the least that the rest may cost (every unit at
    its best rate) reach the best known, which is the greedy cost at first.
    """
    todo = _usable(lines)
    best, used = greedy(lines)
    if not todo:
        return best, used
    states = {tuple(x.qty for x in lines): (0, ())}
    for step, (p, ks) in enumerate(todo):
        rest = todo[step + 1 :]
        low = [min([x.price, *[_rate(q, x.price) for q, js in rest if k in js]]) for k, x in enumerate(lines)]
        prices, after = tuple(lines[k].price for k in ks), {}
        for left, (cost, path) in states.items():
            for units in product(*[range(min(left[k], p.most if p.most is not None else left[k]) + 1) for k in ks]):
                paid = _reward(p, units, prices) if any(units) else 0
                if paid is None:
                    continue
                now = list(left)
                for k, u in zip(ks, units, strict=True):
                    now[k] -= u
                now, spent = tuple(now), cost + paid
                if spent + sum(n * x for n, x in zip(now, low, strict=True)) - len(rest) >= best:  # rounding down saves under one a promotion
                    continue
                if now not in after or spent < after[now][0]:
                    after[now] = spent, (*path, (p.id, units)) if any(units) else path
        for left, (cost, path) in after.items():
            whole = cost + sum(n * x.price for n, x in zip(left, lines, strict=True))
            if whole < best:
                best, used = whole, dict(path)
        states = after
    return best, used


@dataclass
class Optimum:
    places: tuple[int, ...]
    missing: int
    total: int
    penalty: int
    trip: int
    items: list[tuple[int, int, int]]  # need, item, place
    bundles: list[tuple[int, int, int]]  # promotion, place, units


class Basket:
    """The needs of a basket with their options; costs of what is bought together at a place are worked out once."""

    def __init__(self, needs: list[tuple[int, int]], options: list[list[Option]], travels: list[int], stop_value: int):
        self.needs, self.travels, self.stop = needs, travels, stop_value
        self.known: dict[tuple, tuple[int, dict]] = {}
        share: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, own in enumerate(options):
            for o in own:
                for p in o.promos:
                    share[o.place, p.id].add(i)
        joint = {key for key, who in share.items() if len(who) > 1}
        self.options: list[list[Option]] = []
        for i, own in enumerate(options):
            best: dict[int, tuple] = {}
            for o in sorted(own, key=lambda o, i=i: (bool(o.promos), self._packs(i, o) * o.price + o.penalty)):
                if o.place in best and self._floor(i, o) > best[o.place][0][0]:
                    continue  # can't be the best there by itself
                key = (self.bought(o.place, ((i, o),))[0] + o.penalty, o.penalty, o.item)
                if o.place not in best or key < best[o.place][0]:
                    best[o.place] = key, o
            linked = [o for o in own if any((o.place, p.id) in joint for p in o.promos)]
            self.options.append(list(dict.fromkeys([o for _, o in best.values()] + linked)))
        self.groups = self._groups(share, joint)
        self.joint = {(place, i) for place, id in joint for i in share[place, id]}

    def _groups(self, share, joint) -> list[list[int]]:
        """Needs that promotions tie together, directly or by others."""
        root = list(range(len(self.needs)))

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for key in joint:
            first, *others = sorted(share[key])
            for x in others:
                a, b = sorted((top(first), top(x)))
                root[b] = a
        out: dict[int, list[int]] = defaultdict(list)
        for i in range(len(self.needs)):
            out[top(i)].append(i)
        return list(out.values())

    def _packs(self, i: int, o: Option) -> int:
        return self.needs[i][1] if o.packs is None else o.packs

    def bought(self, place: int, lines: tuple[tuple[int, Option], ...]) -> tuple[int, dict]:
        """What these needs cost together at a place, and the units in each promotion."""
        key = place, lines
        if key not in self.known:
            self.known[key] = allocate([Line(self._packs(i, o), o.price, o.promos) for i, o in lines])
        return self.known[key]

    def _cost(self, chosen: list[tuple[int, Option]]) -> int:
        at: dict[int, list] = defaultdict(list)
        for i, o in chosen:
            at[o.place].append((i, o))
        return sum(self.bought(place, tuple(lines))[0] for place, lines in at.items()) + sum(o.penalty for _, o in chosen)

    def _floor(self, i: int, o: Option) -> float:
        """The least that a need's option may cost, whatever else is bought with it."""
        return self._packs(i, o) * min([o.price, *[_rate(p, o.price) for p in o.promos]]) + o.penalty - len(o.promos)

    def group(self, members: list[int], inside: set[int]) -> tuple[int, int, list[tuple[int, Option]]]:
        """Missing needs, least cost and choice of a group at the given places: depth first, each need's likely options first, cut by floors."""
        choices = [[o for o in self.options[i] if o.place in inside] for i in members]
        have = [(i, sorted(own, key=lambda o, i=i: (self.bought(o.place, ((i, o),))[0] + o.penalty, o.place, o.item))) for i, own in zip(members, choices, strict=True) if own]
        missing = len(members) - len(have)
        chosen = [(i, own[0]) for i, own in have]
        best = self._cost(chosen), chosen
        if len(have) > 1:
            floors = [min(self._floor(i, o) for o in own) for i, own in have]
            behind = [sum(floors[k:]) for k in range(len(have) + 1)]

            def go(k: int, path: list[tuple[int, Option]], floor: float) -> None:
                nonlocal best
                if floor + behind[k] >= best[0]:
                    return
                if k == len(have):
                    cost = self._cost(path)
                    if cost < best[0]:
                        best = cost, list(path)
                    return
                i, own = have[k]
                for o in own:
                    go(k + 1, [*path, (i, o)], floor + self._floor(i, o))

            go(0, [], 0.0)
        return missing, *best

    def optimum(self, most: int, min_saving: int = 0) -> Optimum | None:
        """The best set of at most `most` places: fewest missing needs, then items, penalties, travel and stops together.

        A further store is taken only where it finds more, or saves at least min_saving against fewer stores.
        """
        n = len(self.travels)
        if not n:
            return None
        sets, size = sets_of(n, min(most, n)), sizes_of(n, min(most, n))
        missing, cost = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        for members in self.groups:
            if len(members) == 1:
                at = np.full(n, NONE, np.int64)
                for o in self.options[members[0]]:
                    at[o.place] = min(at[o.place], self.bought(o.place, ((members[0], o),))[0] + o.penalty)
                least = at[sets].min(axis=1)
                missing += least >= NONE
                cost += np.where(least < NONE, least, 0)
            else:
                # needs are bought by themselves where no place of the set has a promotion that two of them may share
                at = np.full((len(members), n), NONE, np.int64)
                for j, i in enumerate(members):
                    for o in self.options[i]:
                        at[j, o.place] = min(at[j, o.place], self.bought(o.place, ((i, o),))[0] + o.penalty)
                least = at[:, sets].min(axis=2)
                apart = ~np.isin(sets, [place for place, who in self.joint if who in members]).any(axis=1)
                missing += np.where(apart, (least >= NONE).sum(axis=0), 0)
                cost += np.where(apart, np.where(least < NONE, least, 0).sum(axis=0), 0)
                for k in np.flatnonzero(~apart).tolist():
                    m, c, _ = self.group(members, set(sets[k].tolist()))
                    missing[k] += m
                    cost[k] += c
        trip = np.array([sum(self.travels[p] for p in set(s)) for s in sets.tolist()], np.int64) + (size - 1) * self.stop
        taken = None
        for k in range(1, min(most, n) + 1):
            own = np.flatnonzero(size == k)
            x = own[np.lexsort((cost[own] + trip[own], missing[own]))[0]]
            now = int(missing[x]), int(cost[x] + trip[x]), x
            if taken is None or now[0] < taken[0] or (now[0] == taken[0] and now[1] < taken[1] and taken[1] - now[1] >= min_saving):
                taken = now
        x = taken[2]
        inside = set(sets[x].tolist())
        chosen = sorted((pair for members in self.groups for pair in self.group(members, inside)[2]), key=lambda p: p[0])
        bundles, paid = [], 0
        for place in sorted(inside):
            for members in self.groups:
                lines = tuple((i, o) for i, o in chosen if o.place == place and i in members)
                if lines:
                    spent, used = self.bought(place, lines)
                    paid += spent
                    bundles += [(p, place, sum(units)) for p, units in sorted(used.items())]
        penalty = sum(o.penalty for _, o in chosen)
        return Optimum(tuple(sorted(inside)), int(missing[x]), paid, penalty, int(trip[x]), [(self.needs[i][0], o.item, o.place) for i, o in chosen], bundles)


_OPTIMUM = "basket long, stores string, n_stores int, missing long, total long, penalty long, trip long, objective long, items string, bundles string"


def _promos(terms: list[dict] | None) -> tuple[Promo, ...]:
    return tuple(sorted({Promo(p["promo_id"], p["kind"], p["n"], p["t"], p["min_qty"], p["max_qty"]) for p in terms or []}, key=lambda p: p.id))


def _searched(r: dict) -> tuple | None:
    """The optimum of one basket (a row as in `optimal`) by search."""
    needs = sorted((x["need"], x["qty"]) for x in r["needs"])
    place = {need: i for i, (need, _) in enumerate(needs)}
    options: list[list[Option]] = [[] for _ in needs]
    for o in r["options"] or []:
        options[place[o["need"]]].append(Option(o["item"], o["place"], o["price"], o["penalty"], _promos(o["promos"]), o["packs"]))
    best = Basket(needs, options, r["travels"], r["stop_value"]).optimum(r["max_stores"], r["min_saving"])
    if best is None:
        return None
    at = r["stores"]
    return (r["basket"], ",".join(str(at[p]) for p in best.places), len(best.places), best.missing, best.total, best.penalty, best.trip, best.total + best.penalty + best.trip, " ".join(f"{i}:{x}@{at[p]}" for i, x, p in best.items), " ".join(f"{k}@{at[p]}:{u}" for k, p, u in best.bundles))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The lengths of the lists (null: none) and their elements."""
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0), column.flatten()


def _numbers(rows: pa.Array, name: str, fill: int = 0) -> np.ndarray:
    return rows.field(name).fill_null(fill).to_numpy(zero_copy_only=False).astype(np.int64)


def _optima(batch: pa.RecordBatch) -> list[tuple]:
    """The optima of many baskets (rows as in `optimal`).

    What a need costs at a place depends on nothing else, unless two needs of the basket may share a promotion there. Such baskets are searched
    one by one. Of all others the options are weighed as arrays; only those with a promotion that may make them the best at their place are allocated.
    """
    rows, sizes = len(batch), [_lists(batch.column(c)) for c in ("needs", "options", "stores", "travels")]
    (n_needs, need), (n_options, option), (n_stores, store), (_, travel) = sizes
    # needs by basket and id, numbered through the batch; options by the number of their need
    of = np.repeat(np.arange(rows), n_needs)
    ids, qty = _numbers(need, "need"), _numbers(need, "qty")
    order = np.lexsort((ids, of))
    of, ids, qty = of[order], ids[order], qty[order]
    basket, asked = np.repeat(np.arange(rows), n_options), _numbers(option, "need")
    both = np.lexsort((np.append(np.zeros(len(ids)), np.ones(len(asked))), np.append(ids, asked), np.append(of, basket)))
    number = np.cumsum(both < len(ids)) - 1
    line = np.empty(len(both), np.int64)
    line[both] = number
    line = line[len(ids) :]
    item, place, price, penalty = (_numbers(option, c) for c in ("item", "place", "price", "penalty"))
    packs = np.where(option.field("packs").is_valid().to_numpy(zero_copy_only=False), _numbers(option, "packs"), qty[line] if len(line) else 0)
    shelf = packs * price + penalty
    cost, used = shelf.copy(), {}
    # promotions by option
    n_promos, terms = _lists(option.field("promos"))
    owner = np.repeat(np.arange(len(line)), n_promos)
    searched = n_stores > PLACES
    if len(owner):
        keys = np.unique(np.stack([basket[owner], place[owner], _numbers(terms, "promo_id"), line[owner]], axis=1), axis=0)
        shared = (keys[1:, :3] == keys[:-1, :3]).all(axis=1)
        searched[keys[1:][shared][:, 0]] = True
        low = np.full((len(ids), PLACES), NONE, np.int64)
        alone = np.flatnonzero(~searched[basket])
        np.minimum.at(low, (line[alone], place[alone]), shelf[alone])
        ends, terms = np.cumsum(n_promos), terms.to_pylist()
        for k in np.flatnonzero((n_promos > 0) & ~searched[basket]):
            own = Option(int(item[k]), int(place[k]), int(price[k]), int(penalty[k]), _promos(terms[ends[k] - n_promos[k] : ends[k]]), int(packs[k]))
            if packs[k] * min([own.price, *[_rate(p, own.price) for p in own.promos]]) + own.penalty - len(own.promos) <= low[line[k], place[k]]:
                paid, units = allocate([Line(own.packs, own.price, own.promos)])
                cost[k], used[int(k)] = paid + own.penalty, units
    out = [_searched(r) for r in batch.filter(pa.array(searched)).to_pylist()] if searched.any() else []
    out = [x for x in out if x is not None]
    # the best option of each need at each place
    keep = np.flatnonzero(~searched[basket])
    keep = keep[np.lexsort((item[keep], penalty[keep], cost[keep], place[keep], line[keep]))]
    first = np.ones(len(keep), bool)
    first[1:] = (line[keep][1:] != line[keep][:-1]) | (place[keep][1:] != place[keep][:-1])
    keep = keep[first]
    at, chosen = np.full((len(ids), PLACES), NONE, np.int64), np.zeros((len(ids), PLACES), np.int64)
    at[line[keep], place[keep]], chosen[line[keep], place[keep]] = cost[keep], keep
    # the best set of each size, and whether a further store is taken
    sets, size = sets_of(PLACES, MOST), sizes_of(PLACES, MOST)
    missing, total = np.zeros((rows, len(sets)), np.int64), np.zeros((rows, len(sets)), np.int64)
    for a in range(0, len(at), LINES):
        part, own = at[a : a + LINES], of[a : a + LINES]
        best = part[:, sets[:, 0]]
        for j in range(1, MOST):
            best = np.minimum(best, part[:, sets[:, j]])
        found = best < NONE
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        missing[own[start]] += np.add.reduceat((~found).astype(np.int64), start, axis=0)
        total[own[start]] += np.add.reduceat(np.where(found, best, 0), start, axis=0)
    stores, travels = np.full((rows, PLACES), -1, np.int64), np.zeros((rows, PLACES), np.int64)
    there = np.arange(PLACES) < np.where(searched, 0, n_stores)[:, None]
    inside = ~np.repeat(searched, n_stores)
    stores[there], travels[there] = store.to_numpy(zero_copy_only=False)[inside], travel.to_numpy(zero_copy_only=False)[inside]
    member = np.zeros((len(sets), PLACES), np.int64)
    member[np.arange(len(sets))[:, None], sets] = 1
    trip = travels @ member.T + (size - 1) * _numbers_of(batch, "stop_value")[:, None]
    valid = (sets.max(axis=1) < there.sum(axis=1)[:, None]) & (size <= _numbers_of(batch, "max_stores")[:, None])
    least, taken, fewest, objective = _numbers_of(batch, "min_saving"), np.full(rows, -1), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for k in range(1, MOST + 1):
        ok = valid & (size == k)
        for key in (missing, total + trip):
            ok &= key == np.where(ok, key, 1 << 62).min(axis=1, keepdims=True)
        x = ok.argmax(axis=1)
        m, o = missing[np.arange(rows), x], (total + trip)[np.arange(rows), x]
        better = ok.any(axis=1) & ((taken < 0) | (m < fewest) | ((m == fewest) & (o < objective) & (objective - o >= least)))
        taken, fewest, objective = np.where(better, x, taken), np.where(better, m, fewest), np.where(better, o, objective)
    # what is bought there
    there = np.take_along_axis(at, sets[np.maximum(taken, 0)][of], axis=1)
    where = np.take_along_axis(sets[np.maximum(taken, 0)][of], there.argmin(axis=1)[:, None], axis=1)[:, 0]
    option_of, bought = chosen[np.arange(len(of)), where], there.min(axis=1) < NONE
    ends = np.cumsum(n_needs)
    names = batch.column("basket").to_pylist()
    for r in np.flatnonzero(taken >= 0).tolist():
        x, shop = taken[r], stores[r].tolist()
        mine = [(i, int(option_of[i]), int(where[i])) for i in range(ends[r] - n_needs[r], ends[r]) if bought[i]]
        places = sets[x][: size[x]].tolist()
        bundles = [f"{p}@{shop[w]}:{sum(units)}" for v in places for i, k, w in mine if w == v and k in used for p, units in sorted(used[k].items())]
        extra = int(sum(penalty[k] for _, k, _ in mine))
        out.append((names[r], ",".join(str(shop[p]) for p in places), int(size[x]), int(fewest[r]), int(total[r, x]) - extra, extra, int(trip[r, x]), int(objective[r]), " ".join(f"{ids[i]}:{item[k]}@{shop[w]}" for i, k, w in mine), " ".join(bundles)))
    return out


def _numbers_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


#: Baskets weighed at a time.
BASKETS = 1000


def optimal(rows: DataFrame) -> DataFrame:
    """The optimum of each basket, with its items (need:item@store) and bundles (promotion@store:units).

    rows: a row per basket: basket, needs (array of struct need, qty), options (array of struct need, item, place, price, penalty,
    packs, promos: array of struct promo_id, kind, n, t, min_qty, max_qty), stores, travels (by place), stop_value, max_stores, min_saving.
    """

    def run(batches):
        names = [x.split() for x in _OPTIMUM.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            for a in range(0, len(batch), BASKETS):
                out = _optima(batch.slice(a, BASKETS))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[t]) for k, (_, t) in enumerate(names)], names=[c for c, _ in names])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, _OPTIMUM)


_ALLOCATED = "basket long, store long, shelf long, greedy long, exact long, bundles string"


def allocated(rows: DataFrame) -> DataFrame:
    """basket, store, what its lines cost at shelf prices, by greedy and by exact allocation, and the exact bundles (promotion:units of each line).

    rows: basket, store, lines (array of struct item, qty, price, promos as in `optimal`).
    """

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lines = [Line(x["qty"], x["price"], tuple(Promo(p["promo_id"], p["kind"], p["n"], p["t"], p["min_qty"], p["max_qty"]) for p in x["promos"] or [])) for x in r["lines"]]
                exact, used = allocate(lines)
                out.append((r["basket"], r["store"], sum(x.qty * x.price for x in lines), greedy(lines)[0], exact, " ".join(f"{p}:{'+'.join(map(str, u))}" for p, u in sorted(used.items()))))
            names = [x.split() for x in _ALLOCATED.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[t]) for k, (_, t) in enumerate(names)], names=[c for c, _ in names])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, _ALLOCATED)
