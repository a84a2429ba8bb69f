"""The operator tree: what every operator has, and composition in sequence and in parallel.

An operator declares the types it takes and gives (None: any) and lowers to a Column. Trees are checked when they are
built; Catalyst sees one projection.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE, LONG, STRING, BOOLEAN = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


@dataclasses.dataclass
class Context:
    """The DataFrame that a tree is lowered against. Operators that need a join replace it."""

    df: DataFrame | None = None
    joined: int = 0


class Operator:
    takes: tuple[T.DataType | None, ...] = (None,)
    gives: T.DataType | None = None

    def lower(self, ctx: Context, *args: Column) -> Column:
        raise NotImplementedError

    def __call__(self, *args: Column) -> Column:
        """The Column of operators that need no join."""
        return self.lower(Context(), *args)

    def __repr__(self) -> str:
        return f"{type(self).__name__}()"


class Identity(Operator):
    """Passes its argument on."""

    def lower(self, ctx, *args):
        return args[0]


class Field(Operator):
    """A field of a record: a column, or a field of a struct column."""

    def __init__(self, record: type | None, name: str, kind: T.DataType | None = None):
        self.record, self.name, self.kind = record, name, kind
        self.gives = kind

    def lower(self, ctx, *args):
        return args[0].getField(self.name) if args else F.col(f"`{self.name}`")

    def __repr__(self):
        return f"Field({self.name})"


def schema_fields(cls: type) -> type:
    """Class decorator: each annotated attribute becomes a Field. Annotations are Spark types, or float, int, str, bool."""
    plain = {float: DOUBLE, int: LONG, str: STRING, bool: BOOLEAN, "float": DOUBLE, "int": LONG, "str": STRING, "bool": BOOLEAN}
    for name, kind in getattr(cls, "__annotations__", {}).items():
        setattr(cls, name, Field(cls, name, plain.get(kind, kind if isinstance(kind, T.DataType) else None)))
    return cls


class Function(Operator):
    """A Column function as an operator."""

    def __init__(self, fn: Callable[..., Column], takes=(None,), gives=None, name: str | None = None):
        self.fn, self.takes, self.gives, self.name = fn, tuple(takes), gives, name or getattr(fn, "__name__", "fn")

    def lower(self, ctx, *args):
        return self.fn(*args)

    def __repr__(self):
        return f"Function({self.name})"


def check_operator(op) -> None:
    if not isinstance(op, Operator):
        raise ValueError(f"not an operator: {op!r}")


def fits(given: T.DataType | None, taken: T.DataType | None) -> bool:
    return given is None or taken is None or given == taken


class Chain(Operator):
    """Operators one after another. What each gives must be what the next takes; only the first takes several arguments."""

    def __init__(self, *ops: Operator):
        for op in ops:
            check_operator(op)
        active = [op for op in ops if not isinstance(op, Identity)]
        if not active:
            raise ValueError("a chain needs an operator besides Identity")
        for left, right in zip(active, active[1:]):
            if len(right.takes) != 1:
                raise TypeError(f"{right!r} takes {len(right.takes)} arguments; only the first operator may take several")
            if not fits(left.gives, right.takes[0]):
                raise TypeError(f"{left!r} gives {left.gives}, {right!r} takes {right.takes[0]}")
        self.ops, self.active = list(ops), active
        self.takes, self.gives = active[0].takes, active[-1].gives

    def lower(self, ctx, *args):
        for op in self.active:
            args = (op.lower(ctx, *args),)
        return args[0]

    def __getitem__(self, i: int) -> Operator:
        return self.ops[i]

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self) -> Iterator[Operator]:
        return iter(self.ops)

    def __repr__(self):
        return f"Chain({', '.join(map(repr, self.ops))})"


class Fan(Operator):
    """The same arguments for every operator; the results in an array (into=list), a struct by names (dict), a struct by
    position (tuple) or a struct with a dataclass's fields. Names go with operators one by one; a dataclass's fields
    are filled by name, whatever the order. Operators must take the same, and for a list give the same."""

    def __init__(self, ops: list[Operator], names: list[str] | None = None, into: type = list):
        for op in ops:
            check_operator(op)
        if names is not None and len(names) != len(ops):
            raise ValueError("a name for each operator is needed")
        record = dataclasses.is_dataclass(into)
        if into not in (list, dict, tuple) and not record:
            raise ValueError(f"into is list, dict, tuple or a dataclass, not {into!r}")
        if into is dict and names is None:
            raise ValueError("into=dict needs names")
        if record:
            fields = [f.name for f in dataclasses.fields(into)]
            names = fields if names is None else names
            if sorted(names) != sorted(fields):
                raise ValueError(f"names {names} are not the fields {fields}")
        if names is not None and into is not list and len(set(names)) != len(names):
            raise ValueError("names must differ")
        active = [op for op in ops if not isinstance(op, Identity)]
        self.takes = active[0].takes if active else (None,)
        for op in active[1:]:
            if len(op.takes) != len(self.takes) or not all(map(fits, op.takes, self.takes)):
                raise TypeError(f"{op!r} takes {op.takes}, others {self.takes}")
        if len(active) < len(ops) and len(self.takes) != 1:
            raise TypeError("Identity stands only among operators of one argument")
        gives = {str(op.gives): op.gives for op in active if op.gives is not None}
        if into is list and len(gives) > 1:
            raise TypeError(f"a list needs results of one type, not {sorted(gives)}")
        self.ops, self.names, self.into = list(ops), names, into
        self.order = fields if record else names
        self.gives = T.ArrayType(next(iter(gives.values()))) if into is list and len(gives) == 1 and len(active) == len(ops) else None

    def lower(self, ctx, *args):
        out = [op.lower(ctx, *args) for op in self.ops]
        if self.into is list:
            return F.array(*out)
        if self.into is tuple:
            return F.struct(*[c.alias(f"_{i + 1}") for i, c in enumerate(out)])
        by = dict(zip(self.names, out))
        return F.struct(*[by[n].alias(n) for n in self.order])

    def __getitem__(self, i: int) -> Operator:
        return self.ops[i]

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self) -> Iterator[Operator]:
        return iter(self.ops)

    def __repr__(self):
        return f"Fan({', '.join(map(repr, self.ops))})"


class Spread(Operator):
    """An operator of several arguments, fed from one struct's fields by position."""

    def __init__(self, op: Operator, fields: list[str] | None = None):
        check_operator(op)
        self.op, self.gives = op, op.gives
        self.fields = fields or [f"_{i + 1}" for i in range(len(op.takes))]
        if len(self.fields) != len(op.takes):
            raise ValueError(f"{op!r} takes {len(op.takes)} arguments")

    def lower(self, ctx, *args):
        return self.op.lower(ctx, *[args[0].getField(f) for f in self.fields])


def transform(df: DataFrame, root: Operator, name: str = "features", args: list[Column] | None = None) -> DataFrame:
    """df with the tree's result as a column. Without args, leaves are Fields of df itself."""
    ctx = Context(df)
    out = root.lower(ctx, *(args or []))
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return ctx.df.select(*kept, out.alias(name))
