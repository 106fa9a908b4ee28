"""What a search asks for: the target, the rule that marks cells, and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Widest combination of features, and conjuncts of a target.
MAX_WIDTH, MAX_CONJUNCTS = 4, 3
#: Positives below which cross-validated coverage is left undetermined.
LEAST_POSITIVES = 25


@dataclass(frozen=True)
class Rule:
    """When a cell of n rows with k positives is a centre.

    ``kind`` "purity": k reaches the share ``tau`` of n. "certified": the exact binomial test of
    purity <= tau is rejected at ``alpha``, shared among the schema's cells ("bonferroni"), among
    ``family`` tests of the whole search ("family"), or not at all ("none").
    """

    tau: float = 0.9
    alpha: float = 0.05
    kind: str = "purity"
    min_rows: int = 1
    bound: str = "exact"
    correction: str = "bonferroni"
    family: int | None = None

    def __post_init__(self) -> None:
        if not 0 < self.tau <= 1 or not 0 < self.alpha < 1:
            raise ValueError("tau must lie in (0, 1], alpha in (0, 1)")
        if self.kind not in ("purity", "certified") or self.bound not in ("exact", "wilson") or self.correction not in ("none", "bonferroni", "family"):
            raise ValueError(f"unknown rule: {self}")
        if self.kind == "certified" and self.tau == 1:
            raise ValueError("no number of rows certifies a purity of 1")
        if self.correction == "family" and (self.kind != "certified" or self.bound != "exact"):
            raise ValueError("a family correction needs the exact certificate")
        if self.min_rows < 1:
            raise ValueError("min_rows must be 1 at least")

    @property
    def resolved(self) -> bool:
        return self.correction != "family" or self.family is not None

    def with_family(self, tests: int) -> Rule:
        return replace(self, family=tests)

    def level(self, cells: int | Column) -> float | Column:
        """Level of each test, with ``cells`` occupied cells in the schema."""
        if self.correction == "none":
            return F.lit(self.alpha) if isinstance(cells, Column) else self.alpha
        if self.correction == "family":
            if self.family is None:
                raise ValueError("the family's size is not known yet")
            level = self.alpha / max(1, self.family)
            return F.lit(level) if isinstance(cells, Column) else level
        return F.lit(self.alpha) / F.greatest(F.lit(1), cells) if isinstance(cells, Column) else self.alpha / max(1, cells)

    def least_certifiable(self, level: float) -> int:
        """Rows that a pure cell needs for its certificate: tau ** n <= level."""
        return math.ceil(math.log(level) / math.log(self.tau))


def certificate(rule: str, tau: float = 0.9, alpha: float = 0.05, correction: str | None = None, **more) -> Rule:
    """A rule from a request: without a named correction, certificates hold over the family."""
    if correction is None:
        correction = "family" if rule == "certified" else "bonferroni"
    return Rule(tau=tau, alpha=alpha, kind=rule, correction=correction, **more)


@dataclass(frozen=True)
class Target:
    """One column's value, or a conjunction with up to two more (column, value) pairs."""

    column: str
    value: str | None = None
    also: tuple[tuple[str, str], ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.column, *(c for c, _ in self.also)]

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [(self.column, self.value), *self.also] if self.value is not None else []

    def indicator(self) -> Column:
        """1 where all conjuncts hold. Values are compared as text; null holds nothing."""
        if self.value is None:
            raise ValueError("the target has no value")
        hold = F.lit(True)
        for c, v in self.pairs:
            hold = hold & F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False))
        return hold.cast("int")


def default_column(df: DataFrame) -> str:
    return "class" if "class" in df.columns else df.columns[0]


def resolve_target(df: DataFrame, column: str | None = None, value: str | None = None, also: list[tuple[str, str]] | None = None) -> Target:
    """Check a request against the table: columns exist once each, values occur."""
    column = column or default_column(df)
    more = tuple(sorted(also or []))
    target = Target(column, value, more)
    names = target.columns
    if len(set(names)) != len(names):
        raise ValueError(f"a column stands twice in the target: {names}")
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such column: {missing}")
    if more and value is None:
        raise ValueError("a conjunction needs a value for its first column")
    if len(names) > MAX_CONJUNCTS:
        raise ValueError(f"a target has {MAX_CONJUNCTS} conjuncts at most")
    for c, v in target.pairs:
        if df.where(F.col(c).cast("string") == v).limit(1).isEmpty():
            raise ValueError(f"{v!r} does not occur in {c}")
    return target


def positive_value(df: DataFrame, column: str, value: str | None = None) -> str:
    """The value that counts as positive: a named one, or the higher of exactly two."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(3 if value is None else 1 << 20).collect()]
    if value is not None:
        same = [v for v in found if str(v) == value]
        if len(same) != 1:
            raise ValueError(f"{value!r} matches {len(same)} values of {column}")
        return value
    if len(found) != 2:
        raise ValueError(f"{column} has not exactly two values: name the positive one")
    return str(found[1])


def framed(df: DataFrame, target: Target, drop: list[str] | None = None, direction: str = "presence") -> DataFrame:
    """Feature columns and ``z``: the target's columns and ``drop`` go."""
    gone = {*target.columns, *(drop or [])}
    z = target.indicator()
    if "z" in df.columns and "z" not in gone:
        raise ValueError("z is the indicator's name: rename or drop that feature")
    return df.select(*[c for c in df.columns if c not in gone], oriented(z, direction).alias("z"))


def oriented(z: Column, direction: str) -> Column:
    if direction not in ("presence", "absence"):
        raise ValueError(f"unknown direction {direction!r}")
    return z if direction == "presence" else (1 - z).cast("int")


def base_rate(frame: DataFrame) -> tuple[int, int, float]:
    """Rows, positives and their share."""
    n, k = frame.agg(F.count("*"), F.coalesce(F.sum("z"), F.lit(0))).first()
    return n, k, k / n if n else 0.0


def void_reason(rule: Rule, prevalence: float) -> str | None:
    """Why a floor says nothing: it must lie above the base rate."""
    if rule.tau <= prevalence:
        return f"the floor {rule.tau:g} does not exceed the base rate {prevalence:g}"
    return None


def ordered_columns(df: DataFrame) -> dict[str, bool]:
    """Which columns have an order (numbers) beyond that of their codes."""
    return {f.name: isinstance(f.dataType, NumericType) for f in df.schema.fields}
