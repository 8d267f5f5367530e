"""Feature kinds of a table: one profiling job, then plain rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISCRETE_MOST = 20  # an integer-like column with fewer distinct values is discrete
TOLERANCE = 1e-12
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
CATEGORIES = (T.StringType, T.BooleanType)


def supported(kind: T.DataType) -> bool:
    return isinstance(kind, (*INTEGERS, *FRACTIONS, *CATEGORIES))


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every float column: missing values are one thing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def profile(df: DataFrame, cols: list[str] | None = None, cap: int = DISCRETE_MOST) -> dict[str, dict]:
    """Per column: rows, nulls, distinct (exact below cap, else cap) and whether all values are integer-like.

    A sketch of constant size sorts out columns with clearly more than `cap` distinct values; only the others are
    counted exactly, so no distinct-count of an unbounded column is planned.
    """
    df = clean_nan(df)
    cols = cols or df.columns
    for c in cols:
        if not supported(df.schema[c].dataType):
            raise TypeError(f"column {c} of type {df.schema[c].dataType.simpleString()} has no feature kind")
    first = []
    for i, c in enumerate(cols):
        first += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        if isinstance(df.schema[c].dataType, FRACTIONS):
            x = F.col(c).cast("double")
            first.append(F.bool_and(F.abs(x - F.rint(x)) <= F.lit(TOLERANCE)).alias(f"i{i}"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *first).collect()[0].asDict()
    near = [i for i in range(len(cols)) if row[f"d{i}"] < 2 * cap]
    exact = df.agg(*[F.count_distinct(cols[i]).alias(f"x{i}") for i in near]).collect()[0].asDict() if near else {}
    return {
        c: {
            "rows": row["rows"],
            "nulls": row["rows"] - row[f"n{i}"],
            "distinct": min(cap, exact.get(f"x{i}", cap)),
            "integer_like": isinstance(df.schema[c].dataType, INTEGERS) or bool(row.get(f"i{i}")),
        }
        for i, c in enumerate(cols)
    }


def classify(kind: T.DataType, stats: dict, cap: int = DISCRETE_MOST) -> str:
    """continuous, discrete or categorical."""
    if isinstance(kind, CATEGORIES):
        return "categorical"
    if not supported(kind):
        raise TypeError(f"type {kind.simpleString()} has no feature kind")
    if stats["rows"] == stats["nulls"]:
        return "discrete" if isinstance(kind, INTEGERS) else "continuous"
    return "discrete" if stats["integer_like"] and stats["distinct"] < cap else "continuous"


@dataclass(frozen=True)
class TabularSchema:
    continuous: tuple[str, ...] = ()
    discrete: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str | None = None
    id: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def features(self) -> tuple[str, ...]:
        return self.continuous + self.discrete + self.categorical

    @property
    def numeric(self) -> tuple[str, ...]:
        return self.continuous + self.discrete

    @property
    def columns(self) -> tuple[str, ...]:
        return self.features + tuple(c for c in (self.target, self.id) if c)

    def validate(self, df: DataFrame) -> None:
        groups = {"continuous": self.continuous, "discrete": self.discrete, "categorical": self.categorical}
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        for name, cols in groups.items():
            if len(set(cols)) != len(cols):
                raise ValueError(f"a column is listed twice as {name}")
        if len(set(self.features)) != len(self.features):
            raise ValueError("a column has two kinds")
        for c in (self.target, self.id):
            if c in self.features:
                raise ValueError(f"{c} is no feature")
        if self.id is not None and self.id == self.target:
            raise ValueError("id and target are the same column")
        for c in self.numeric:
            if not isinstance(df.schema[c].dataType, (*INTEGERS, *FRACTIONS)):
                raise ValueError(f"{c} is not numeric")
        for c in self.categorical:
            if not supported(df.schema[c].dataType):
                raise ValueError(f"{c} cannot be categorical")
        if self.id and df.filter(F.col(self.id).isNotNull()).limit(1).count() == 0 and df.limit(1).count():
            raise ValueError("the id column holds nulls only")

    @classmethod
    def infer(cls, df: DataFrame, target: str | None = None, id: str | None = None, features: list[str] | None = None, continuous=(), discrete=(), categorical=(), cap: int = DISCRETE_MOST) -> TabularSchema:
        """Kinds by the rules, except for columns that are named; named ones come first, then the others in order."""
        named = [*continuous, *discrete, *categorical]
        unknown = [c for c in [*named, *(features or [])] if c not in df.columns]
        if unknown:
            raise ValueError(f"unknown columns: {unknown}")
        pool = [c for c in (features or df.columns) if c not in (target, id)]
        rest = [c for c in pool if c not in named]
        stats = profile(df.select(*rest), rest, cap) if rest else {}
        kinds = {c: classify(df.schema[c].dataType, stats[c], cap) for c in rest}
        of = lambda first, kind: tuple(first) + tuple(c for c in rest if kinds[c] == kind)
        out = cls(of(continuous, "continuous"), of(discrete, "discrete"), of(categorical, "categorical"), target, id)
        out.validate(df)
        return out


def resolve_target(columns: list[str], wanted: str | None) -> str:
    """The column of that name, else the one equal after trimming blanks; the last column if none is wanted."""
    if wanted is None:
        return columns[-1]
    if wanted in columns:
        return wanted
    near = [c for c in columns if c.strip() == wanted.strip()]
    if not near:
        raise KeyError(wanted)
    return near[0]


def common_numeric(a: DataFrame, b: DataFrame, exclude=()) -> list[str]:
    numeric = lambda df: {f.name for f in df.schema.fields if isinstance(f.dataType, (*INTEGERS, *FRACTIONS))}
    both = numeric(a) & numeric(b)
    return [c for c in a.columns if c in both and c not in exclude]


def detect_task(df: DataFrame, target: str, most: int = DISCRETE_MOST) -> str:
    """classification for categories and for integer-like targets of at most `most` values, else regression."""
    kind = df.schema[target].dataType
    if isinstance(kind, CATEGORIES):
        return "classification"
    stats = profile(df.select(target), [target], most + 1)[target]
    return "classification" if stats["integer_like"] and stats["distinct"] <= most else "regression"
