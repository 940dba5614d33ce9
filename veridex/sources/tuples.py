"""The edge table: its columns, its text form, and filters on it."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("resource_type", "resource_id", "resource_relation", "subject_type", "subject_id", "subject_relation")
SCHEMA = (
    "resource_type string, resource_id string, resource_relation string, subject_type string, subject_id string, subject_relation string, "
    "caveat_name string, caveat_context string, expires_at timestamp"
)
VERSIONED = SCHEMA + ", created_rev bigint, deleted_rev bigint"
ELLIPSIS, WILDCARD = "...", "*"
MAX_ID = 1024

# What follows a name or an id is never a character of it, so no pattern has to give any back: all take what they can and keep it.
_TYPE = r"(?:[a-z][a-z0-9_]{2,62}+(?<!_)/)*+[a-z][a-z0-9_]{2,63}+(?<!_)"
_ID = r"[a-zA-Z0-9/_|\-=+]++"
_REL = r"[a-z][a-z0-9_]{2,63}+(?<!_)"
#: Groups: resource type, id, relation, subject type, id, relation, caveat name, caveat context, expiration.
TUPLE = rf"^({_TYPE}):({_ID})#({_REL})@({_TYPE}):({_ID}|\*)(?:#({_REL}|\.\.\.))?(?:\[({_TYPE})(?::(\{{.*?\}}))?\])?(?:\[expiration:([0-9TtZz:.+\-]+)\])?$"
ONR = rf"^({_TYPE}):({_ID}|\*)(?:#({_REL}|\.\.\.))?$"


def parse(text: Column) -> list[Column]:
    """The edge columns of canonical text; all null where the text is no tuple. The pattern runs once a row and leaves its groups apart."""
    groups = F.split(F.regexp_replace(text, TUPLE, "\x01".join(f"${k}" for k in range(1, 10))), "\x01", -1)

    def row(parts: Column) -> Column:
        part = lambda k: F.nullif(F.get(parts, k - 1), F.lit(""))
        context = F.when(F.try_parse_json(part(8)).isNotNull(), part(8))
        fine = (F.size(parts) == 9) & (F.length(part(2)) <= MAX_ID) & (F.length(part(5)) <= MAX_ID) & (part(8).isNull() | context.isNotNull()) & ~((part(5) == WILDCARD) & F.coalesce(part(6) != ELLIPSIS, F.lit(False)))
        cols = {k: part(i + 1) for i, k in enumerate(KEY)}
        cols["subject_relation"] = F.coalesce(part(6), F.lit(ELLIPSIS))
        cols |= {"caveat_name": part(7), "caveat_context": context, "expires_at": part(9).try_cast("timestamp")}
        return F.when(fine, F.struct(*(c.alias(k) for k, c in cols.items())))

    got = F.get(F.transform(F.array(groups), row), 0)
    return [got.getField(c.split()[0]).alias(c.split()[0]) for c in SCHEMA.split(", ")]


def parse_object(text: Column) -> list[Column]:
    """Type, id and relation of an object's text (no relation: the ellipsis); all null where it is none."""
    ok = text.rlike(ONR) & (F.length(F.regexp_extract(text, ONR, 2)) <= MAX_ID)
    part = lambda k: F.when(ok, F.regexp_extract(text, ONR, k))
    return [part(1).alias("type"), part(2).alias("id"), F.when(part(3) == "", F.lit(ELLIPSIS)).otherwise(part(3)).alias("relation")]


def read_text(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges of a text file, one a line (blank lines and // comments left out), and the lines that are none."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '//')")
    got = lines.select("line", *parse(F.col("line")))
    return got.where("resource_type is not null").drop("line"), got.where("resource_type is null").select("line")


def onr_text(type_: str = "resource_type", id_: str = "resource_id", relation: str = "resource_relation") -> Column:
    return F.concat(F.col(type_), F.lit(":"), F.col(id_), F.when(F.col(relation) == ELLIPSIS, F.lit("")).otherwise(F.concat(F.lit("#"), F.col(relation))))


def text(df: DataFrame) -> Column:
    """Canonical text; the expiration with seven digits of a second."""
    caveat = F.when(F.col("caveat_name").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("["), F.col("caveat_name"), F.when(F.coalesce("caveat_context", F.lit("{}")) == "{}", F.lit("")).otherwise(F.concat(F.lit(":"), F.col("caveat_context"))), F.lit("]"))
    )
    expires = F.when(F.col("expires_at").isNull(), F.lit("")).otherwise(F.concat(F.lit("[expiration:"), F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z]")))
    return F.concat(F.col("resource_type"), F.lit(":"), F.col("resource_id"), F.lit("#"), F.col("resource_relation"), F.lit("@"), onr_text("subject_type", "subject_id", "subject_relation"), caveat, expires)


# Filters --------------------------------------------------------------------------------------------------------------
def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def subject_relation(how: str | None, value: str | None = None) -> Column:
    """any, exact (a relation), only_userset, or include_ellipsis (a relation or none)."""
    c = F.col("subject_relation")
    if how in (None, "any"):
        return F.lit(True)
    if how == "exact":
        return c == (value or ELLIPSIS)
    if how == "only_userset":
        return c != ELLIPSIS
    if how == "include_ellipsis":
        return (c == ELLIPSIS) | (c == value) if value else F.lit(True)
    raise ValueError(f"unknown subject relation filter {how}")


def subjects(type_: str | None = None, ids=None, relation: tuple | None = None) -> Column:
    out = [F.col("subject_type") == type_] if type_ else []
    if ids:
        out.append(F.col("subject_id").isin(list(ids)))
    return _all([*out, subject_relation(*relation)] if relation else out)


def relationships(resource_type=None, resource_ids=None, id_prefix=None, relation=None, selectors=None, caveat=None, expiration=None) -> Column:
    """The conjunction of what is given. caveat: a name, or False for none; expiration: True or False; selectors: any of them."""
    out = [F.col("resource_type") == resource_type] if resource_type else []
    if resource_ids:
        out.append(F.col("resource_id").isin(list(resource_ids)))
    if id_prefix:
        out.append(F.col("resource_id").startswith(id_prefix))
    if relation:
        out.append(F.col("resource_relation") == relation)
    if selectors:
        out.append(reduce(or_, selectors))
    if caveat is not None:
        out.append(F.col("caveat_name").isNull() if caveat is False else F.col("caveat_name") == caveat)
    if expiration is not None:
        out.append(F.col("expires_at").isNotNull() if expiration else F.col("expires_at").isNull())
    return _all(out)


def live(now: Column | str | None) -> Column:
    """Not expired at ``now``; the instant itself is expired."""
    return F.lit(True) if now is None else F.col("expires_at").isNull() | (F.col("expires_at") > (F.lit(now).cast("timestamp") if isinstance(now, str) else now))


def after(cursor: tuple | None, columns: tuple) -> Column:
    """Strictly past a key in lexicographic byte order."""
    if cursor is None:
        return F.lit(True)
    return F.struct(*columns) > F.struct(*[F.lit(v).alias(c) for v, c in zip(cursor, columns)])
