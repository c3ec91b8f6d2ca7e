"""Labels to consecutive codes and back, for columns and for pairs of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.functions.ordering import with_rank

SHOWN = 5


class LabelEncoder:
    """Codes in label order (``sort``), or in order of first appearance by an index column."""

    def __init__(self, sort: bool = True):
        self.sort = sort
        self._dictionary: DataFrame | None = None
        self._size = 0

    @property
    def is_fitted(self) -> bool:
        return self._dictionary is not None

    @property
    def dictionary(self) -> DataFrame:
        """(label, code)."""
        if self._dictionary is None:
            raise ValueError("this LabelEncoder is not fitted; call fit() first")
        return self._dictionary

    @property
    def n_groups(self) -> int:
        _ = self.dictionary
        return self._size

    @property
    def classes(self) -> list:
        """All labels by code; for dictionaries that fit the driver."""
        return [r["label"] for r in self.dictionary.orderBy("code").collect()]

    def fit(self, df: DataFrame, label: str = "label", index: str | None = None) -> LabelEncoder:
        self._no_nulls(df, label)
        if self.sort:
            ranked = with_rank(df.select(F.col(label).alias("label")).distinct(), ["label"], "code")
        else:
            if index is None:
                raise ValueError("first-appearance codes need an index column")
            firsts = df.groupBy(F.col(label).alias("label")).agg(F.min(index).alias("first_"))
            ranked = with_rank(firsts, ["first_", "label"], "code")
        self._dictionary = ranked.select("label", "code")
        self._size = self._dictionary.count()
        return self

    def _no_nulls(self, df: DataFrame, label: str) -> None:
        bad = F.col(label).isNull()
        if isinstance(df.schema[label].dataType, (T.DoubleType, T.FloatType)):
            bad = bad | F.isnan(label)
        if not df.filter(bad).isEmpty():
            raise ValueError(f"{label} holds null or NaN")

    def _known(self, df: DataFrame, column: str, key: str) -> None:
        known = self.dictionary.select(F.col(key).alias("key_"))
        unknown = df.join(known, F.col(column) == F.col("key_"), "left_anti").select(column).distinct().limit(10)
        rows = sorted(str(r[0]) for r in unknown.collect())
        if rows:
            raise ValueError(f"unknown {'labels' if key == 'label' else 'codes'} in {column}: {', '.join(rows)}")

    def unknown_labels(self, df: DataFrame, label: str = "label") -> DataFrame:
        """The distinct labels that the dictionary does not have."""
        return df.select(F.col(label).alias("label")).distinct().join(self.dictionary, "label", "left_anti")

    def _look_up(self, df: DataFrame, column: str, key: str, value: str, name: str) -> DataFrame:
        names = self.dictionary.select(F.col(key).alias("key_"), F.col(value).alias(name))
        return df.join(names, F.col(column) == F.col("key_")).drop("key_")

    def transform(self, df: DataFrame, label: str = "label", validate: bool = True) -> DataFrame:
        """Adds ``code``."""
        if validate:
            self._no_nulls(df, label)
            self._known(df, label, "label")
        return self._look_up(df, label, "label", "code", "code")

    def fit_transform(self, df: DataFrame, label: str = "label", index: str | None = None) -> DataFrame:
        return self.fit(df, label, index).transform(df, label, validate=False)

    def inverse_transform(self, df: DataFrame, code: str = "code", validate: bool = True) -> DataFrame:
        """Adds ``decoded``."""
        if validate:
            self._known(df, code, "code")
        return self._look_up(df, code, "code", "label", "decoded")

    def transform_pairs(self, df: DataFrame, u: str = "u_label", v: str = "v_label", validate: bool = True) -> DataFrame:
        """Adds ``u`` and ``v``; order and repetitions of pairs stay."""
        if validate:
            for c in (u, v):
                self._no_nulls(df, c)
                self._known(df, c, "label")
        return self._look_up(self._look_up(df, u, "label", "code", "u"), v, "label", "code", "v")

    def inverse_transform_pairs(self, df: DataFrame, u: str = "u", v: str = "v", validate: bool = True) -> DataFrame:
        """Adds ``u_decoded`` and ``v_decoded``."""
        if validate:
            for c in (u, v):
                self._known(df, c, "code")
        return self._look_up(self._look_up(df, u, "code", "label", "u_decoded"), v, "code", "label", "v_decoded")

    def __repr__(self) -> str:
        if not self.is_fitted:
            return f"LabelEncoder(sort={self.sort}, fitted=False)"
        if self._size <= SHOWN:
            shown = ", ".join(map(str, self.classes))
        else:
            ends = self.dictionary.filter(F.col("code").isin(0, 1, self._size - 1)).orderBy("code").collect()
            shown = "{}, {}, ..., {}".format(*[r["label"] for r in ends])
        return f"LabelEncoder(sort={self.sort}, n_groups={self._size}, classes=[{shown}])"
