"""Caveats over rows: code, missing names and error of each edge's own caveat."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..plans.schema import Schema
from . import cel

RESULT = StructType([StructField("code", IntegerType()), StructField("missing", ArrayType(StringType())), StructField("err", StringType())])


def attach(df: DataFrame, schema: Schema, stored: str = "caveat_context", request: str = "context", name: str = "caveat_name") -> DataFrame:
    """Adds ``code``, ``missing`` and ``err``: TRUE without a caveat. Caveats over numbers, strings and booleans stay in the JVM; if others exist, the rows with those alone pass through Arrow."""
    none = F.array().cast("array<string>")
    if not schema.caveats:
        return df.withColumn("code", F.lit(cel.TRUE)).withColumn("missing", none).withColumn("err", F.when(F.col(name).isNotNull(), F.concat(F.lit("unknown caveat "), F.col(name)))).withColumn(
            "code", F.when(F.col("err").isNotNull(), F.lit(cel.OPEN)).otherwise(F.col("code"))
        )
    compiled = {n: cel.compile_caveat(c) for n, c in schema.caveats.items()}
    columns, fast, extra = df.columns, {}, {}
    for k, (n, c) in enumerate(compiled.items()):
        given = cel.inputs(c, F.col("_stored"), F.col("_request"), f"_p{k}_")
        if given is not None and (got := cel.to_columns(c, f"_p{k}_", F.col("_broken"))):
            fast[n] = got
            extra |= given
    if fast:  # contexts are parsed once a row, parameters read once, and expressions stay small
        (own, bad), (asked, worse) = cel.parsed(F.col(stored)), cel.parsed(F.col(request))
        df = df.withColumns({"_stored": own, "_request": asked, "_broken": bad | worse}).withColumns(extra)
    slow = sorted(set(compiled) - set(fast))
    code: Column = F.when(F.col(name).isNull(), F.lit(cel.TRUE))
    missing: Column = F.when(F.col(name).isNull(), none)
    err: Column = F.when(~F.coalesce(F.col(name).isin(list(compiled)), F.lit(True)), F.concat(F.lit("unknown caveat "), F.col(name)))
    for n, (c, m, e) in fast.items():
        code, missing, err = code.when(F.col(name) == n, c), missing.when(F.col(name) == n, m), err.when(F.col(name) == n, e)
    if slow:
        slow_only = {n: compiled[n] for n in slow}

        @F.pandas_udf(RESULT)
        def evaluated(names: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
            rows = [cel.evaluate(slow_only[n], s, r) if n in slow_only else (cel.OPEN, [], None) for n, s, r in zip(names, a, b)]
            return pd.DataFrame(rows, columns=["code", "missing", "err"])

        rest = df.where(~F.coalesce(F.col(name).isin(slow), F.lit(False)))
        own = df.where(F.col(name).isin(slow)).withColumn("_r", evaluated(F.col(name), F.col(stored), F.col(request)))
        own = own.withColumn("code", F.col("_r.code")).withColumn("missing", F.coalesce(F.col("_r.missing"), none)).withColumn("err", F.col("_r.err")).drop("_r")
        return rest.withColumn("code", code.otherwise(F.lit(cel.OPEN))).withColumn("missing", missing.otherwise(none)).withColumn("err", err).unionByName(own).select(*columns, "code", "missing", "err")
    return df.withColumns({"code": code.otherwise(F.lit(cel.OPEN)), "missing": missing.otherwise(none), "err": err}).select(*columns, "code", "missing", "err")
