"""The typed composition language: a tree of ten operators, checked on the driver, lowered to DataFrames.

Nodes: constraint, intersect, union, difference, path, enumerate (sets); count, aggregate, contains, compare (answers).
Sets become one column `entity`; answers one row. Unknown operators, wrong types and missing fields raise PlanError
before anything runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import graph as G

SETS = {"constraint": ("relation", "value"), "intersect": ("args",), "union": ("args",), "difference": ("args",), "path": ("start", "chain"), "enumerate": ("arg",)}
ANSWERS = {"count": ("arg",), "aggregate": ("over", "attribute", "func"), "contains": ("set", "member"), "compare": ("a", "b", "relation")}


class PlanError(ValueError):
    pass


def check(node: dict, want_set: bool = False) -> None:
    """Raises PlanError unless the tree is well formed and well typed."""
    if not isinstance(node, dict) or "op" not in node:
        raise PlanError(f"not a node: {node!r}")
    op = node["op"]
    fields = SETS.get(op) or ANSWERS.get(op)
    if fields is None:
        raise PlanError(f"unknown operator: {op}")
    if want_set and op not in SETS:
        raise PlanError(f"{op} gives no set")
    for f in fields:
        if f not in node and not (op == "path" and f == "chain"):
            raise PlanError(f"{op} lacks {f}")
    if op == "aggregate" and node["func"] not in ("avg", "sum", "max", "min", "count"):
        raise PlanError(f"no such aggregate: {node['func']}")
    if op == "difference" and len(node["args"]) != 2:
        raise PlanError("a difference has two arguments")
    for child in [*node.get("args", []), *[node[k] for k in ("arg", "over", "set") if k in node]]:
        check(child, True)


@dataclass
class Composer:
    triples: DataFrame
    aliases: DataFrame
    equivalents: tuple = ()
    trace: list = field(default_factory=list)

    def _entity(self, value: str) -> DataFrame:
        """The first alias candidate that is a head or a tail; the value itself if none is."""
        ends = self.triples.select(F.explode(F.array("head", "tail")).alias("candidate"))
        c = G.alias_candidates(value, self.aliases)
        known = c.join(ends.filter(F.col("candidate").isNotNull()), "candidate", "left_semi")
        return known.agg(F.coalesce(F.min_by("candidate", "priority"), F.lit(value)).alias("entity"))

    def run(self, node: dict) -> DataFrame:
        check(node)
        return self._run(node)

    def _run(self, n: dict) -> DataFrame:
        self.trace.append(n["op"])
        return getattr(self, f"_{n['op']}")(n)

    def _constraint(self, n):
        return G.constraint(self.triples, n["relation"], n["value"], self.aliases, self.equivalents)

    def _empty(self):
        return self.triples.sparkSession.createDataFrame([], "entity string")

    def _intersect(self, n):
        return G.intersect(*map(self._run, n["args"])) if n["args"] else self._empty()

    def _union(self, n):
        return G.union(*map(self._run, n["args"])) if n["args"] else self._empty()

    def _difference(self, n):
        return G.difference(*map(self._run, n["args"]))

    def _path(self, n):
        return G.walk(self.triples, self._entity(n["start"]), n.get("chain", []))

    def _enumerate(self, n):
        return self._run(n["arg"]).orderBy("entity")

    def _count(self, n):
        return self._run(n["arg"]).agg(F.count_distinct("entity").alias("value"))

    def _aggregate(self, n):
        return G.aggregate(self.triples, self._run(n["over"]), n["attribute"], n["func"])

    def _contains(self, n):
        c = G.alias_candidates(n["member"], self.aliases).select(F.col("candidate").alias("entity"))
        return self._run(n["set"]).join(F.broadcast(c), "entity", "left_semi").agg((F.count("*") > 0).alias("value"))  # aliases of one value

    def _compare(self, n):
        a, b = (self._entity(n[k]).select(F.lit(k).alias("side"), F.col("entity").alias("head")) for k in ("a", "b"))
        t = self.triples.filter(F.col("relation") == n["relation"]).join(F.broadcast(a.unionByName(b)), "head").filter("tail is not null")  # two rows
        own = t.agg(F.collect_set(F.when(F.col("side") == "a", F.col("tail"))).alias("x"), F.collect_set(F.when(F.col("side") == "b", F.col("tail"))).alias("y"))
        s = lambda c: F.array_join(F.array_sort(c), "|")
        xy, yx = F.array_except("x", "y"), F.array_except("y", "x")
        return own.select(s(F.array_intersect("x", "y")).alias("same"), s(xy).alias("only_a"), s(yx).alias("only_b"), ((F.size("x") > 0) & (F.size(xy) + F.size(yx) == 0)).alias("identical"))


def diagnose(composer: Composer, node: dict) -> DataFrame:
    """R-22: leaf, n: how many entities each constraint of a plan has; an empty one is where it degenerates."""
    check(node)
    leaves: list[dict] = []

    def visit(n: dict) -> None:
        if n["op"] == "constraint":
            leaves.append(n)
        for c in [*n.get("args", []), *[n[k] for k in ("arg", "over", "set") if k in n]]:
            visit(c)

    visit(node)
    rows = None
    for n in leaves:
        row = composer._constraint(n).agg(F.count("*").alias("n")).select(F.lit(f"{n['relation']}={n['value']}").alias("leaf"), "n")
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        raise PlanError("a plan without constraints")
    return rows


def run_steps(composer: Composer, steps: list[dict]) -> DataFrame:
    """R-23: steps with names; "$name" in args stands for an earlier set, a foreach step walks from all of one at once."""
    done: dict[str, DataFrame] = {}
    for s in steps:
        if "foreach" in s:
            done[s["name"]] = G.walk(composer.triples, done[s["foreach"].lstrip("$")], s["chain"])
        elif s["op"] in ("intersect", "union", "difference"):
            f = {"intersect": G.intersect, "union": G.union, "difference": G.difference}[s["op"]]
            done[s["name"]] = f(*[done[a.lstrip("$")] for a in s["args"]])
        else:
            done[s["name"]] = composer.run({k: v for k, v in s.items() if k != "name"})
    return done[steps[-1]["name"]]
