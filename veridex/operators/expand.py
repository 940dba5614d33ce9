"""Permission trees: what a permission is made of, with the subjects at the leaves and caveats left as they are.

A level at a time, the nodes of the frontier meet the operands of their permission and the edges. The tree comes out
flat: a row for each node with the path to it. Cycles and depths over the limit end in an empty leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import ELLIPSIS, WILDCARD, Arrow, Nil, Ref, Schema, Self, SetOp
from ..sources.tuples import live
from ..util import written

MAX_DEPTH = 50


def operand_rows(schema: Schema) -> list[tuple]:
    """(type, relation, place, kind, edge, target): set operations and operands of each permission, by their place in it."""
    out = []

    def walk(t, r, e, place):
        if isinstance(e, SetOp):
            out.append((t, r, place, e.kind, "", ""))
            for i, p in enumerate(e.parts):
                walk(t, r, p, f"{place}/{i}")
        elif isinstance(e, Arrow):
            out.append((t, r, place, "all" if e.every else "any", e.relation, e.target))
        elif isinstance(e, Ref):
            out.append((t, r, place, "ref", e.name, ""))
        else:
            out.append((t, r, place, "nil" if isinstance(e, Nil) else "self" if isinstance(e, Self) else "this", "", ""))

    for d in schema.definitions.values():
        for m in d.members.values():
            if m.is_permission:
                walk(d.name, m.name, m.expr, "")
            else:
                out.append((d.name, m.name, "", "this", m.name, ""))
    return out


def _cut(df: DataFrame) -> DataFrame:
    return written(df, "trees")


def expand(edges: DataFrame, schema: Schema, resources: DataFrame, permission: str, now: str | None = None, recursive: bool = True) -> DataFrame:
    """root, path, kind (union, intersection, exclusion, any, all, leaf), object, subjects (sorted canonical texts with caveats)."""
    spark = edges.sparkSession
    operands = operand_rows(schema)
    rows = spark.createDataFrame(operands, "p_type string, p_rel string, place string, kind string, edge string, target string")
    e = edges.where(live(now)).select(*[F.col(c).alias(f"e_{c}") for c in ("resource_type", "resource_id", "resource_relation", "subject_type", "subject_id", "subject_relation", "caveat_name", "caveat_context")])
    caveat = F.when(F.col("e_caveat_name").isNull(), F.lit("")).otherwise(F.concat(F.lit("["), "e_caveat_name", F.when(F.col("e_caveat_context").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), "e_caveat_context")), F.lit("]")))
    subject = F.concat("e_subject_type", F.lit(":"), "e_subject_id", F.when(F.col("e_subject_relation") == ELLIPSIS, F.lit("")).otherwise(F.concat(F.lit("#"), "e_subject_relation")), caveat)
    me = F.concat("rt", F.lit(":"), "rid", F.lit("#"), "rel")
    frontier = _cut(resources.select(F.concat("resource_type", F.lit(":"), "resource_id").alias("root"), F.lit("").alias("path"), F.col("resource_type").alias("rt"), F.col("resource_id").alias("rid"), F.lit(permission).alias("rel"), F.array().cast("array<string>").alias("above")))
    out = None
    for _ in range(MAX_DEPTH):
        at = frontier.join(F.broadcast(rows), (F.col("rt") == F.col("p_type")) & (F.col("rel") == F.col("p_rel"))).select("root", F.concat("path", "place").alias("path"), "kind", "edge", "target", "rt", "rid", "rel", F.concat("above", F.array(me)).alias("above"))
        on = (F.col("rt") == F.col("e_resource_type")) & (F.col("rid") == F.col("e_resource_id")) & (F.col("edge") == F.col("e_resource_relation"))
        here = {tuple(r) for r in frontier.select("rt", "rel").distinct().collect()}  # at most the schema's
        read = sorted({(t, edge) for t, r, _, kind, edge, _ in operands if (t, r) in here and kind in ("this", "any", "all")})  # only their edges, by filters that reach the scan
        asked = e.where(F.col("e_resource_type").isin(sorted({t for t, _ in read})) & F.col("e_resource_relation").isin(sorted({r for _, r in read})))
        met = _cut(at.join(asked, on & F.col("kind").isin("this", "any", "all"), "left").withColumn("subject", subject))
        own = ["root", "path", "kind", "rt", "rid", "rel"]
        found = met.groupBy(*own).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "this", F.col("subject")))), ",").alias("subjects"))
        found = found.where("kind <> 'ref'").select("root", "path", F.when(F.col("kind").isin("this", "nil", "self"), F.lit("leaf")).otherwise(F.col("kind")).alias("kind"), me.alias("object"), F.when(F.col("kind") == "self", F.concat("rt", F.lit(":"), "rid")).otherwise(F.col("subjects")).alias("subjects"))
        out = found if out is None else out.unionByName(found)
        refs = met.where("kind = 'ref'").select("root", F.concat("path", F.lit("/="), "edge").alias("path"), "rt", "rid", F.col("edge").alias("rel"), "above")
        child = F.when(F.col("kind") == "this", F.col("e_subject_relation")).otherwise(F.col("target"))
        leads = F.when(F.col("kind") == "this", F.col("e_subject_relation") != ELLIPSIS).otherwise(F.col("e_subject_id") != WILDCARD)
        kids = met.where(F.col("e_subject_type").isNotNull() & leads & (F.lit(True) if recursive else F.col("kind") != "this"))
        kids = kids.select("root", F.concat("path", F.lit("/@"), "e_subject_type", F.lit(":"), "e_subject_id").alias("path"), F.col("e_subject_type").alias("rt"), F.col("e_subject_id").alias("rid"), child.alias("rel"), "above")
        new = refs.unionByName(kids)
        cut = new.where(F.array_contains("above", me)).select("root", "path", F.lit("leaf").alias("kind"), me.alias("object"), F.lit("").alias("subjects"))
        out = _cut(out.unionByName(cut))
        frontier = _cut(new.where(~F.array_contains("above", me)))
        if not frontier.limit(1).count():
            break
    return out
