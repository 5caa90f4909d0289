"""Petri nets of a model's size: built on the driver, sent to tasks, kept as tables."""

from __future__ import annotations

import heapq
import itertools
import math
import operator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How many markings a search for silent firings and one for an alignment may hold.
QUIET_MARKINGS, MARKINGS = 2000, 500_000


@dataclass
class Net:
    """places: id -> (tokens at first, tokens at the end); transitions: id -> label, None if silent; arcs: (source, target) -> weight."""

    places: dict[str, tuple[int, int]] = field(default_factory=dict)
    transitions: dict[str, str | None] = field(default_factory=dict)
    arcs: dict[tuple[str, str], int] = field(default_factory=dict)

    def place(self, name: str, first: int = 0, last: int = 0) -> str:
        self.places.setdefault(name, (first, last))
        return name

    def transition(self, name: str, label: str | None, inputs=(), outputs=()) -> str:
        self.transitions[name] = label
        for p in inputs:
            self.arcs[p, name] = self.arcs.get((p, name), 0) + 1
        for p in outputs:
            self.arcs[name, p] = self.arcs.get((name, p), 0) + 1
        return name

    def play(self) -> Play:
        return Play(self)

    def shortest_run(self) -> int:
        """Visible firings of a shortest run; 0 if none ends properly."""
        least = (self.play().run_cost() or (0, 0))[0]
        return 0 if math.isinf(least) else int(least)

    @property
    def silent(self) -> list[str]:
        return [t for t, label in self.transitions.items() if label is None]

    def fuse_silent(self) -> Net:
        """Joins a silent transition with its neighbour across a place that only the two of them use, until nothing changes."""
        while True:
            pre = {t: {p for (p, x) in self.arcs if x == t} for t in self.transitions}
            post = {t: {p for (x, p) in self.arcs if x == t} for t in self.transitions}
            makers = {p: [t for t in self.transitions if p in post[t]] for p in self.places}
            users = {p: [t for t in self.transitions if p in pre[t]] for p in self.places}
            for p, (first, last) in self.places.items():
                if first or last or len(makers[p]) != 1 or len(users[p]) != 1:
                    continue
                a, b = makers[p][0], users[p][0]
                if a == b:
                    continue
                ahead = self.transitions[a] is None and post[a] == {p} and not pre[a] & pre[b]
                behind = self.transitions[b] is None and pre[b] == {p} and not post[a] & post[b]
                if ahead or behind:
                    gone, kept = (a, b) if ahead else (b, a)
                    arcs = {k: w for k, w in self.arcs.items() if p not in k}
                    self.arcs = {tuple(kept if x == gone else x for x in k): w for k, w in arcs.items()}
                    del self.transitions[gone], self.places[p]
                    break
            else:
                return self

    def tables(self, spark: SparkSession, net_id: str = "net") -> tuple[DataFrame, DataFrame, DataFrame]:
        """net_places, net_transitions, net_arcs."""
        places = spark.createDataFrame([(net_id, p, p, a, b) for p, (a, b) in self.places.items()], "net_id string, place_id string, name string, m0 int, mf int")
        transitions = spark.createDataFrame([(net_id, t, t, label) for t, label in self.transitions.items()], "net_id string, transition_id string, name string, label string")
        arcs = spark.createDataFrame([(net_id, a, b, w) for (a, b), w in self.arcs.items()], "net_id string, source string, target string, weight int")
        return places, transitions, arcs


def net_from_tables(places: DataFrame, transitions: DataFrame, arcs: DataFrame, net_id: str) -> Net:
    """One net of the tables; a net is small, however many there are."""
    mine = lambda df: df.filter(F.col("net_id") == net_id).collect()
    return Net({r["place_id"]: (r["m0"], r["mf"]) for r in mine(places)}, {r["transition_id"]: r["label"] for r in mine(transitions)}, {(r["source"], r["target"]): r["weight"] for r in mine(arcs)})


class Play:
    """What a net can do, inside a task. A marking is a tuple of token counts in the order of the places.

    All searches are one: ``spread`` finds the least costs of markings from others when each firing has a price.
    Successors and silent reach are remembered per marking, so variants that pass the same markings share them.
    """

    def __init__(self, net: Net):
        self.names, self.labels, self.places = list(net.transitions), list(net.transitions.values()), list(net.places)
        self.begin, self.end = (tuple(net.places[p][k] for p in self.places) for k in (0, 1))
        self.need = np.zeros((len(self.names), len(self.places)), np.int64)
        self.gain = np.zeros_like(self.need)
        row, column = {t: k for k, t in enumerate(self.names)}, {p: k for k, p in enumerate(self.places)}
        for (x, y), w in net.arcs.items():
            if x in column:
                self.need[row[y], column[x]] = w
            else:
                self.gain[row[x], column[y]] = w
        self.known = {x for x in self.labels if x is not None}
        self._moves: dict[tuple, list[tuple[int, tuple]]] = {}
        self._quiet: dict[tuple, dict] = {}
        self._least: dict[int, tuple[float, float] | None] = {}

    def moves(self, marking: tuple) -> list[tuple[int, tuple]]:
        """The transitions that can fire, in the net's order, and where each leads."""
        if (found := self._moves.get(marking)) is None:
            here = np.array(marking, np.int64)
            can = np.flatnonzero((self.need <= here).all(axis=1)).tolist()
            found = [(t, tuple((here - self.need[t] + self.gain[t]).tolist())) for t in can]
            _remember(self._moves, marking, found)
        return found

    def spread(self, sources: dict[tuple, tuple[int, int]], price, limit=None, stop=None, most: int = MARKINGS) -> dict[tuple, tuple] | None:
        """Of each marking in reach its least cost, and the marking and the firing before it (None for a source), cheapest first.

        Costs are pairs that add up; ``price`` gives a transition's, or None where it may not fire. The search ends at
        costs over ``limit`` and at a marking that ``stop`` accepts. None if there are over ``most`` markings.
        """
        reached: dict[tuple, tuple] = {}
        order = itertools.count()
        queue = [(cost, next(order), marking, None, None) for marking, cost in sources.items()]
        heapq.heapify(queue)
        while queue:
            cost, _, marking, before, by = heapq.heappop(queue)
            if marking in reached:
                continue
            if len(reached) == most:
                return None
            reached[marking] = (cost, before, by)
            if stop is not None and stop(marking):
                break
            for t, then in self.moves(marking):
                if then not in reached and (p := price(t)) is not None:
                    total = cost[0] + p[0], cost[1] + p[1]
                    if limit is None or total <= limit:
                        heapq.heappush(queue, (total, next(order), then, marking, t))
        return reached

    def quiet(self, marking: tuple) -> dict[tuple, tuple]:
        """The markings that silent transitions alone lead to, nearest first (at most QUIET_MARKINGS of them)."""
        if (found := self._quiet.get(marking)) is None:
            count = itertools.count(1)
            found = self.spread({marking: (0, 0)}, lambda t: (0, 1) if self.labels[t] is None else None, stop=lambda _: next(count) >= QUIET_MARKINGS)
            _remember(self._quiet, marking, found)
        return found

    def path(self, reached: dict[tuple, tuple], marking: tuple) -> list[int]:
        """The firings that lead from a source to ``marking``."""
        out = []
        while reached[marking][2] is not None:
            _, marking, t = reached[marking]
            out.append(t)
        return out[::-1]

    def options(self, marking: tuple, label: str) -> list[int]:
        return [t for t, _ in self.moves(marking) if self.labels[t] == label]

    def replay(self, trace: list[str]) -> tuple[list[tuple[int, int, np.ndarray]], list[int], np.ndarray, np.ndarray]:
        """Token replay: firings as (position or -1, transition, tokens that lacked), positions of unknown activities, and per place what lacks and what is left at the end.

        A transition that can fire goes before one that silent firings enable (the fewest of them), and that before the
        one that lacks the fewest tokens.
        """
        marking, firings, unknown = self.begin, [], []

        def fire(at: int, t: int) -> tuple:
            here = np.array(marking, np.int64)
            lacks = np.maximum(self.need[t] - here, 0)
            firings.append((at, t, lacks))
            return tuple((here + lacks - self.need[t] + self.gain[t]).tolist())

        for at, label in enumerate(trace):
            if label not in self.known:
                unknown.append(at)
                continue
            reached = self.quiet(marking)
            near = min(((reached[m][0], self.options(m, label)[0], k, m) for k, m in enumerate(reached) if self.options(m, label)), default=None)
            if near is None:
                t = min((int(np.maximum(self.need[t] - marking, 0).sum()), t) for t, x in enumerate(self.labels) if x == label)[1]
            else:
                for silent in self.path(reached, near[3]):
                    marking = fire(-1, silent)
                t = near[1]
            marking = fire(at, t)
        reached = self.quiet(marking)
        goals = [self.end] if self.end in reached else [m for m in reached if all(map(operator.ge, m, self.end))]
        for silent in self.path(reached, goals[0]) if goals else ():
            marking = fire(-1, silent)
        surplus = np.array(marking, np.int64) - self.end
        return firings, unknown, np.maximum(-surplus, 0), np.maximum(surplus, 0)

    def run_cost(self, most: int = MARKINGS) -> tuple[float, float] | None:
        """Visible and silent firings of a shortest run of the net; None if it cannot end, infinite where over ``most`` markings would have to be held to tell."""
        if most not in self._least:
            reached = self.spread({self.begin: (0, 0)}, self._price, stop=lambda m: m == self.end, most=most)
            self._least[most] = (math.inf, math.inf) if reached is None else reached[self.end][0] if self.end in reached else None
        return self._least[most]

    def _price(self, t: int) -> tuple[int, int]:
        return (0, 1) if self.labels[t] is None else (1, 0)

    def align(self, trace: list[str], most: int = MARKINGS) -> tuple[int | None, list[tuple[str | None, str | None, str, str]]]:
        """Fewest deviations (then silent firings) and the moves (log, model, transition, kind); None where over ``most`` markings would have to be held.

        Alignments of at most 0, 1, 2, 4, ... deviations are looked for in turn, up to those of leaving the trace and
        taking a shortest run. The first search that finds one has seen all cheaper ones, so its cost is exact; and it holds
        only markings that so many deviations reach, however many the net has.
        """
        least = self.run_cost(most)
        if least is None:
            return None, []
        worst, bound = least[0] + len(trace), 0
        while True:
            found = self._within(trace, (bound, math.inf) if bound < worst else (worst, least[1]), most)
            if found is None or found[0] is not None:
                return found or (None, [])
            bound = min(worst, max(1, 2 * bound))

    def _within(self, trace: list[str], limit: tuple[float, float], most: int) -> tuple[int | None, list[tuple[str | None, str | None, str, str]]] | None:
        """A cheapest alignment of at most ``limit``, (None, []) if there is none; None where a layer has over ``most`` markings.

        One layer of markings for each position of the trace: firings of the net alone spread inside a layer, and a log
        move or a firing together with the trace leads to the next one.
        """
        entry: dict[tuple, tuple] = {self.begin: ((0, 0), None, None)}
        layers = []
        for label in [*trace, None]:
            last = len(layers) == len(trace)
            reached = self.spread({m: e[0] for m, e in entry.items()}, self._price, limit, (lambda m: m == self.end) if last else None, most)
            if reached is None:
                return None
            if not reached or last and self.end not in reached:
                return None, []
            layers.append((entry, reached))
            if last:
                break
            entry = {}
            for m, (cost, _, _) in reached.items():
                offers = [((cost[0] + 1, cost[1]), m, m, None)] + [(cost, then, m, t) for t, then in self.moves(m) if self.labels[t] == label]
                for price, then, before, t in offers:
                    if price <= limit and (then not in entry or price < entry[then][0]):
                        entry[then] = (price, before, t)
        marking, moves = self.end, []
        cost = layers[-1][1][marking][0][0]
        for k in range(len(trace), -1, -1):
            entry, reached = layers[k]
            while reached[marking][2] is not None:
                _, before, t = reached[marking]
                moves.append((None, self.labels[t], self.names[t], "silent" if self.labels[t] is None else "model"))
                marking = before
            _, before, t = entry[marking]
            if k:
                label = trace[k - 1]
                moves.append((label, None, "", "log") if t is None else (label, label, self.names[t], "sync"))
                marking = before
        return cost, moves[::-1]

    def walk(self, trace: list[str]) -> list[list[str]]:
        """For each position up to the first that the net cannot follow without lacking tokens, the labels that may come there.

        The first transition that can fire is taken, else the first that silent firings enable.
        """
        marking, out = self.begin, []
        for label in trace:
            reached = self.quiet(marking)
            out.append(sorted({self.labels[t] for m in reached for t, _ in self.moves(m)} - {None}))
            now = self.options(marking, label)
            if now:
                marking = dict(self.moves(marking))[now[0]]
                continue
            later = min(((t, k, m) for k, m in enumerate(reached) for t in self.options(m, label)), default=None)
            if later is None:
                break
            marking = dict(self.moves(later[2]))[later[0]]
        return out


def _remember(memory: dict, key: tuple, value, most: int = 50_000) -> None:
    if len(memory) >= most:
        memory.clear()
    memory[key] = value
