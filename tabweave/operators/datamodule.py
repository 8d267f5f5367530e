"""Leakage-safe access to folds and holdouts: state is learned from the train rows alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabweave.operators import ranks
from tabweave.operators.schema import TabularSchema
from tabweave.operators.transforms import TransformPipeline


@dataclass(frozen=True)
class FoldData:
    fold: int
    train: DataFrame
    test: DataFrame
    transforms: TransformPipeline


@dataclass(frozen=True)
class HoldoutData:
    train: DataFrame
    val: DataFrame
    transforms: TransformPipeline


class TabularDataModule:
    """id_col addresses rows; it must be unique, as rows have no position."""

    def __init__(self, df: DataFrame, schema: TabularSchema, transforms: TransformPipeline, id_col: str):
        schema.validate(df)
        self.schema, self.id_col, self.transforms = schema, id_col, transforms.clone()
        self.clean = self.transforms.transform_global(df, schema)
        self._folds: DataFrame | None = None
        self._holdout: DataFrame | None = None

    def prepare_kfold(self, k: int, seed: int | str, label: str | None = None) -> TabularDataModule:
        ranks.require_rows(self.clean, k)
        self._folds = ranks.kfold(self.clean, self.id_col, k, seed, label)
        return self

    def prepare_holdout(self, share: float, seed: int | str) -> TabularDataModule:
        self._holdout = ranks.holdout(self.clean, self.id_col, share, seed)
        return self

    def _fitted(self, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame, TransformPipeline]:
        own = self.transforms.clone().fit(train, self.schema)
        a, b = own.transform(train), own.transform(test)
        for df in (a, b):
            if len(set(df.columns)) != len(df.columns):
                raise ValueError("a transform made a column twice")
            gone = [c for c in (self.schema.target, self.schema.id) if c and c not in df.columns]
            if gone:
                raise ValueError(f"a transform dropped {gone}")
        if a.columns != b.columns:
            raise ValueError("train and test columns differ")
        return a, b, own

    def fold(self, i: int) -> FoldData:
        if self._folds is None:
            raise RuntimeError("call prepare_kfold first")
        return FoldData(i, *self._fitted(self._folds.filter(self._folds.fold != i).drop("fold"), self._folds.filter(self._folds.fold == i).drop("fold")))

    def holdout(self) -> HoldoutData:
        if self._holdout is None:
            raise RuntimeError("call prepare_holdout first")
        h = self._holdout
        return HoldoutData(*self._fitted(h.filter(~h.is_val).drop("is_val"), h.filter(h.is_val).drop("is_val")))
