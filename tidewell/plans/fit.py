"""The fit planner: which estimators a tree holds, what they depend on, and the stages in which they are fitted.

A stage takes one pass for all its scalers and one grouped count for all its dictionaries of a key type. Estimators of a
stage don't depend on each other; each sees its input through the operators, fitted by then, that stand before it.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.base import Chain, Context, Fan, Identity, Operator, Spread
from tidewell.operators.lookups import Lookup
from tidewell.operators.scalers import Estimator, Scaler, fit_together

#: An estimator's input is the whole result of the stage's graph; or the rows as they came.
ALL, BYPASS = -1, -2


@dataclasses.dataclass
class Stage:
    paths: list[str]
    mapping: list[int]
    graph: Operator


class FitPlan:
    def __init__(self, root: Operator):
        self.root = root
        self.modules: dict[str, Operator] = {}
        self.inputs: dict[str, list[Operator]] = {}
        self.upstream: dict[str, str] = {}
        self.dependencies: dict[str, set[str]] = {}
        self._walk(root, "", [], "", set())
        self.paths = [p for p in self.dependencies]
        self.stages = self._stages()

    def _walk(self, op: Operator, path: str, before: list[Operator], came: str, needs: set[str]) -> set[str]:
        """Notes the estimators below op; returns their paths. before: the operators between the input and op, came:
        the path of the last of them, needs: estimators among them."""
        join = lambda k: f"{path}.{k}" if path else str(k)
        if isinstance(op, Estimator):
            self.dependencies[path], self.modules[path] = set(needs), op
            self.inputs[path], self.upstream[path] = list(before), came
            return {path}
        found: set[str] = set()
        if isinstance(op, Chain):
            for k, part in enumerate(op.ops):
                found |= self._walk(part, join(k), before, came, needs | found)
                if not isinstance(part, Identity):
                    before, came = [*before, part], join(k)
        elif isinstance(op, Fan):
            for k, part in enumerate(op.ops):
                found |= self._walk(part, join(k), before, came, needs)
        elif isinstance(op, Spread):
            found = self._walk(op.op, join("op"), [*before, op], came, needs)
        return found

    def _stages(self) -> list[Stage]:
        stages, done = [], set()
        while len(done) < len(self.dependencies):
            level = [p for p, d in self.dependencies.items() if p not in done and d <= done]
            sources = list(dict.fromkeys(self.upstream[p] for p in level if self.inputs[p]))
            graphs = [self._graph(next(self.inputs[p] for p in level if self.upstream[p] == s)) for s in sources]
            graph = Identity() if not graphs else graphs[0] if len(graphs) == 1 else Fan(graphs, into=tuple)
            at = lambda p: BYPASS if not self.inputs[p] else ALL if len(graphs) == 1 else sources.index(self.upstream[p])  # noqa: B023, E731
            stages.append(Stage(level, [at(p) for p in level], graph))
            done |= set(level)
        return stages

    @staticmethod
    def _graph(ops: list[Operator]) -> Operator:
        return ops[0] if len(ops) == 1 else Chain(*ops)

    def fit(self, df: DataFrame, *args: Column) -> Operator:
        """Fits every estimator on the rows of df; args are the root's arguments, none if leaves are fields of df."""
        for stage in self.stages:
            ctx = Context(df)
            columns, lowered = {}, {}
            for p in stage.paths:
                x, steps = args, ()
                for op in self.inputs[p]:
                    # estimators that share operators before them share their results, and joins
                    steps = (*steps, id(op))
                    if steps not in lowered:
                        lowered[steps] = tuple(x[0].getField(f) for f in op.fields) if isinstance(op, Spread) else (op.lower(ctx, *x),)
                    x = lowered[steps]
                columns[p] = x[0] if len(x) == 1 else F.array(*x)
            rows = ctx.df
            scalers = [(self.modules[p], columns[p]) for p in stage.paths if isinstance(self.modules[p], Scaler) and not self.modules[p].alone]
            if scalers:
                fit_together(rows, scalers)
            for kind in ("string", "bigint"):
                own = [(i, p) for i, p in enumerate(stage.paths) if isinstance(self.modules[p], Lookup) and self.modules[p].key_kind.simpleString() == kind]
                if len(own) == 1:
                    self.modules[own[0][1]].fit(rows, columns[own[0][1]])
                elif own:
                    each = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), columns[p].cast(kind).alias("key")) for i, p in own]))
                    counts = rows.select(each.alias("e")).select("e.*").where("key is not null").groupBy("at", "key").agg(F.count("*").alias("count")).persist()
                    for i, p in own:
                        self.modules[p].finish(counts.where(F.col("at") == i).select("key", "count"))
                    counts.unpersist()
            for p in stage.paths:
                if not isinstance(self.modules[p], (Scaler, Lookup)) or isinstance(self.modules[p], Scaler) and self.modules[p].alone:
                    self.modules[p].fit(rows, columns[p])
        return self.root
