"""Named helpers: register, unregister, load from a folder."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Helpers:
    """A registry of scalar helpers usable from Python and SQL.

    Functions take and return pandas Series and run as Arrow-batched UDFs; with
    ``vectorized=False`` a plain function of scalars is registered. The built-in
    column functions of ``tomeflow.functions`` need no UDF and are preferred.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.known = spark, {}

    def register(self, name: str, fn: Callable, return_type: str, vectorized: bool = True) -> None:
        """Also replaces a helper of that name."""
        udf = F.pandas_udf(fn, return_type) if vectorized else F.udf(fn, return_type)
        self.known[name] = self.spark.udf.register(name, udf)

    def unregister(self, name: str) -> None:
        if self.known.pop(name, None) is not None:
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")

    def load(self, folder: str) -> list[str]:
        """Each ``<name>.py`` defines ``helper`` and ``RETURN_TYPE``."""
        names = []
        for file in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(f"helper_{file.stem}", file)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            self.register(file.stem, module.helper, module.RETURN_TYPE, getattr(module, "VECTORIZED", True))
            names.append(file.stem)
        return names

    def call(self, name: str, *args: Column) -> Column:
        """A missing helper is an error, unless it has one argument at most: then
        it is nothing (null)."""
        if name in self.known:
            return self.known[name](*args)
        if len(args) <= 1:
            return F.lit(None)
        raise KeyError(f"missing helper: {name!r}")
