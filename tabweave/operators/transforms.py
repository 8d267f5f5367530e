"""Stateful transforms: fit is one or few aggregate jobs, apply is a lazy projection, state is plain JSON."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.operators.schema import INTEGERS, TabularSchema, clean_nan

EPS = 1e-12
#: A category list longer than this is joined instead of written into the plan as literals.
LITERALS_MOST = 200


class Transform(Protocol):
    requires_fit: bool
    invertible: bool

    def fit(self, df: DataFrame, schema: TabularSchema) -> Transform: ...
    def transform(self, df: DataFrame) -> DataFrame: ...
    def inverse(self, df: DataFrame) -> DataFrame: ...
    def state(self) -> dict[str, Any]: ...


REGISTRY: dict[str, type] = {}


def registered(cls: type) -> type:
    REGISTRY[cls.__name__] = cls
    return cls


def of_state(state: dict[str, Any]) -> Transform:
    """The transform that a state was taken of; an unknown name raises KeyError."""
    return REGISTRY[state["name"]](**state["params"])


class _Base:
    requires_fit: ClassVar[bool] = True
    invertible: ClassVar[bool] = True

    def state(self) -> dict[str, Any]:
        return {"name": type(self).__name__, "params": dict(self.__dict__)}

    def inverse(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")


def exact_quantiles(df: DataFrame, cols: list[str], q: float) -> dict[str, float | None]:
    """Exact interpolated quantiles in bounded memory: a sketch brackets each, counts place it, and only the rows
    inside the bracket are ranked."""
    x = lambda c: F.col(c).cast("double")
    spread = 0.002
    first = df.agg(*[F.percentile_approx(x(c), [max(0.0, q - spread), min(1.0, q + spread)], 20_000).alias(f"p{i}") for i, c in enumerate(cols)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0].asDict()
    live = [i for i in range(len(cols)) if first[f"n{i}"]]
    if not live:
        return dict.fromkeys(cols)
    inside = lambda i: x(cols[i]).between(F.lit(first[f"p{i}"][0]), F.lit(first[f"p{i}"][1]))
    second = df.agg(*[F.count_if(x(cols[i]) < F.lit(first[f"p{i}"][0])).alias(f"b{i}") for i in live], *[F.count_if(inside(i)).alias(f"m{i}") for i in live]).collect()[0].asDict()
    parts = []
    for i in live:
        place, m = (first[f"n{i}"] - 1) * q - second[f"b{i}"], second[f"m{i}"]
        if 0 <= place <= m - 1:
            parts.append(F.percentile(F.when(inside(i), x(cols[i])), F.lit(place / (m - 1) if m > 1 else 0.0)).alias(f"q{i}"))
        else:  # the sketch's bracket missed the place
            parts.append(F.percentile(x(cols[i]), F.lit(q)).alias(f"q{i}"))
    third = df.agg(*parts).collect()[0].asDict()
    return {c: third.get(f"q{i}") for i, c in enumerate(cols)}


def modes(df: DataFrame, cols: list[str]) -> dict[str, Any]:
    """The most frequent non-null value of each column, of ties the smallest; values are counted with map-side sums."""
    out: dict[str, Any] = {}
    for c in cols:
        row = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count().agg(F.min_by("v", F.struct((-F.col("count")).alias("n"), "v")).alias("v")).collect()[0]
        out[c] = row["v"]
    return out


def means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return dict(zip(cols, df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).collect()[0])) if cols else {}


@registered
@dataclass
class DropTypedColumns(_Base):
    """Drops columns of date and time types, or those named."""

    requires_fit: ClassVar[bool] = False
    invertible: ClassVar[bool] = False
    cols: list[str] | None = None

    def fit(self, df: DataFrame, schema: TabularSchema | None = None) -> DropTypedColumns:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        times = (T.TimestampType, T.TimestampNTZType, T.DateType)
        return df.drop(*(self.cols if self.cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, times)]))

    def inverse(self, df: DataFrame) -> DataFrame:
        return df


@registered
@dataclass
class DropMissingRows(_Base):
    """Drops rows with a null in the named columns; by default the features and, if asked, the target."""

    requires_fit: ClassVar[bool] = False
    invertible: ClassVar[bool] = False
    subset: list[str] | None = None
    include_target: bool = True

    def fit(self, df: DataFrame, schema: TabularSchema) -> DropMissingRows:
        if self.subset is None:
            self.subset = [*schema.features, *([schema.target] if self.include_target and schema.target else [])]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return clean_nan(df).na.drop(subset=self.subset or df.columns)

    def inverse(self, df: DataFrame) -> DataFrame:
        return df


@registered
@dataclass
class TypeAwareImputer(_Base):
    """Fills nulls of features: continuous by median, mean or constant; discrete by mode (or a rounded median or mean);
    categorical by mode or constant. Columns without any value get 0 or the missing mark. The target is left alone."""

    invertible: ClassVar[bool] = False
    continuous: str = "median"
    discrete: str = "mode"
    categorical: str = "mode"
    constant: float = 0.0
    missing: str = "__missing__"
    fill: dict[str, Any] = field(default_factory=dict)

    def fit(self, df: DataFrame, schema: TabularSchema) -> TypeAwareImputer:
        df = clean_nan(df)
        plan = {c: self.continuous for c in schema.continuous} | {c: self.discrete for c in schema.discrete} | {c: self.categorical for c in schema.categorical}
        by = lambda how: [c for c, h in plan.items() if h == how]
        found: dict[str, Any] = {}
        if by("median"):
            found |= exact_quantiles(df, by("median"), 0.5)
        if by("mean"):
            found |= means(df, by("mean"))
        found |= modes(df, by("mode"))
        for c, how in plan.items():
            text = c in schema.categorical
            v = found.get(c)
            if how == "constant":
                v = self.missing if text else self.constant
            if v is None:
                v = self.missing if text else 0.0
            if c in schema.discrete:
                v = int(round(float(v)))  # half to even
            self.fill[c] = v
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        df = clean_nan(df)

        def filled(c: str) -> Column:
            kind = df.schema[c].dataType
            v = F.lit(self.fill[c])
            if isinstance(kind, INTEGERS) and not float(self.fill[c]).is_integer():
                return F.coalesce(F.col(c).cast("double"), v)
            return F.coalesce(F.col(c), v.cast(kind))

        return df.withColumns({c: filled(c) for c in self.fill if c in df.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df


@registered
@dataclass
class StandardScaler(_Base):
    """(x - mean) / max(population deviation, 1e-12) of the continuous features; one aggregate fits all columns."""

    stats: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, schema: TabularSchema) -> StandardScaler:
        cols = list(schema.continuous)
        if cols:
            x = [F.col(c).cast("double") for c in cols]
            row = clean_nan(df).agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).collect()[0]
            self.stats = {c: [row[i] or 0.0, max(row[len(cols) + i] or 0.0, EPS)] for i, c in enumerate(cols)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items() if c in df.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in self.stats.items() if c in df.columns})


#: Encoders keep their categories on the driver; a column of more is refused, as each would be a column or branch.
MOST_CATEGORIES = 20_000


def sorted_categories(df: DataFrame, c: str) -> list[str]:
    """Distinct non-null values as text, sorted: the state of an encoder, as large as the column's alphabet."""
    found = [r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"{c} has more than {MOST_CATEGORIES} categories")
    return sorted(found)


@registered
@dataclass
class OneHot(_Base):
    """A 0/1 column col_value per category, after the other columns; an unknown value is all zeros and comes back as null."""

    categories: dict[str, list[str]] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, schema: TabularSchema) -> OneHot:
        self.categories = {c: sorted_categories(df, c) for c in schema.categorical}
        self.order = df.columns
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c not in self.categories]
        hot = [F.when(F.col(c).cast("string") == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, vs in self.categories.items() for v in vs]
        return df.select(*keep, *hot)

    def inverse(self, df: DataFrame) -> DataFrame:
        made = {f"{c}_{v}" for c, vs in self.categories.items() for v in vs}

        def back(c: str) -> Column:
            vs = self.categories[c]
            top = F.greatest(*[F.col(f"{c}_{v}") for v in vs]) if len(vs) > 1 else F.col(f"{c}_{vs[0]}")
            out = F.when(top <= 0, F.lit(None).cast("string"))
            for v in vs:
                out = out.when(F.col(f"{c}_{v}") == top, F.lit(v))
            return out.alias(c)

        have = [c for c in self.categories if self.categories[c]]
        whole = df.select(*[F.col(c) for c in df.columns if c not in made], *[back(c) for c in have])
        ordered = [c for c in self.order if c in whole.columns]
        return whole.select(*ordered, *[c for c in whole.columns if c not in ordered])


@registered
@dataclass
class IntegerCode(_Base):
    """Categories as 0 .. C-1 in sorted order; unknown values become -1, or raise; -1 and codes out of range come back as null."""

    unknown: str = "code"
    categories: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df: DataFrame, schema: TabularSchema) -> IntegerCode:
        self.categories = {c: sorted_categories(df, c) for c in schema.categorical}
        return self

    def _map(self, df: DataFrame, c: str, back: bool) -> DataFrame:
        vs = self.categories[c]
        if len(vs) <= LITERALS_MOST:
            if back:
                codes = F.array(*[F.lit(v) for v in vs]) if vs else F.array().cast("array<string>")
                at = F.col(c).cast("int")
                return df.withColumn(c, F.when((at >= 0) & (at < len(vs)), F.get(codes, at)))
            m = F.create_map(*[x for i, v in enumerate(vs) for x in (F.lit(v), F.lit(i))]) if vs else F.lit(None).cast("map<string,int>")
            code = F.try_element_at(m, F.col(c).cast("string"))
            return df.withColumn(c, F.coalesce(code, F.lit(-1)))
        pairs = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(vs)], "v__ string, i__ int")
        order = df.columns
        if back:
            return df.join(pairs, df[c].cast("int") == pairs["i__"], "left").withColumn(c, F.col("v__")).select(*order)
        return df.join(pairs, df[c].cast("string") == pairs["v__"], "left").withColumn(c, F.coalesce("i__", F.lit(-1))).select(*order)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.categories:
            if c in df.columns:
                out = self._map(out, c, False)
        if self.unknown == "raise":
            bad = out.filter(" or ".join(f"`{c}` = -1" for c in self.categories if c in df.columns) or "false").limit(1).count()
            if bad:
                raise ValueError("an unknown category")
        return out

    def inverse(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.categories:
            if c in df.columns:
                out = self._map(out, c, True)
        return out


REPRESENTATIONS: dict[str, type] = {"onehot": OneHot, "integer": IntegerCode}


def register_representation(name: str, cls: type) -> None:
    REPRESENTATIONS[name] = cls


def categorical_representation(name: str, **params) -> Transform:
    return REPRESENTATIONS[name](**params)


@dataclass
class TransformPipeline:
    steps: list[Any]

    def fit(self, df: DataFrame, schema: TabularSchema) -> TransformPipeline:
        for s in self.steps:
            s.fit(df, schema)
            df = s.transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def transform_global(self, df: DataFrame, schema: TabularSchema) -> DataFrame:
        """Only the steps that learn nothing; they may run before a split."""
        for s in self.steps:
            if not s.requires_fit:
                df = s.fit(df, schema).transform(df)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            if s.invertible:
                df = s.inverse(df)
        return df

    def state(self) -> list[dict[str, Any]]:
        return [s.state() for s in self.steps]

    @classmethod
    def of_state(cls, states: list[dict[str, Any]]) -> TransformPipeline:
        import copy

        return cls([of_state(copy.deepcopy(s)) for s in states])

    def clone(self) -> TransformPipeline:
        return self.of_state(self.state())

    @classmethod
    def drop_typed(cls):
        return cls([DropTypedColumns()])

    @classmethod
    def dropna_and_scale(cls):
        return cls([DropMissingRows(), StandardScaler()])

    @classmethod
    def impute_and_scale(cls):
        return cls([TypeAwareImputer(), StandardScaler()])

    @classmethod
    def impute_scale_encode(cls):
        return cls([TypeAwareImputer(), StandardScaler(), OneHot()])

    @classmethod
    def impute_scale_integer(cls):
        return cls([TypeAwareImputer(), StandardScaler(), IntegerCode()])

    @classmethod
    def drop_scale_integer(cls):
        return cls([DropMissingRows(), StandardScaler(), IntegerCode()])
