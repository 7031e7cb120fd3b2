"""Attribute-value rows to wide tables with typed columns.

Stages: (1) names are matched to the wanted attributes by letters and digits,
values are cast by the attribute's type; (2) each cell is resolved by a
``max_by`` aggregate, which combines on the map side, so an entity or attribute
holding a third of all rows is reduced before the shuffle; (3) the resolved
pairs of an entity, at most one per wanted attribute, become one map; (4) the
map is projected into typed columns. No ``pivot`` job is needed to discover
columns and no window sorts an entity's history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblattice.functions.text import name_key

TYPES = ("count", "ratio", "real", "flag")
#: Counts are exact whole numbers; ratios and reals are doubles.
DECIMAL = "decimal(38,9)"
NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?"


@dataclass(frozen=True)
class Attribute:
    """A wanted column: its name and one of :data:`TYPES`."""

    name: str
    value_type: str


def typed_value(value: Column, value_type: Column) -> Column:
    """(``whole`` bigint, ``real`` double) of a value; both null when unusable for its type.

    count: whole, not negative and a bigint, commas part thousands. ratio: 0 to
    1, or a percentage of 0 to 100 with its sign. real: any finite number; in
    both a comma is a decimal comma. flag: words of truth, as whole 1 or 0.
    """
    text = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    thousands = text.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.0*)?$")
    count_text = F.when(thousands, F.regexp_replace(text, ",", "")).otherwise(text)
    percent = text.endswith("%")
    dotted = F.when(text.rlike(r"^[^.,]*,[^.,]*$"), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    bare = F.regexp_replace(dotted, r"[\s\p{Z}]*%$", "")

    def number(c: Column) -> Column:
        x = c.try_cast("double")
        return F.when(c.rlike(f"^{NUMBER}$") & (F.abs(x) < float("inf")), x)

    # A double tells tiny fractions apart from whole numbers, a decimal large whole numbers from each other.
    near, exact = number(count_text), count_text.try_cast(DECIMAL)
    count = F.when((near >= 0) & (near == F.floor(near)) & (exact == F.floor(exact)), exact.try_cast("bigint"))
    ratio = number(bare)
    ratio = F.when(percent, F.when(ratio.between(0, 100), ratio / 100)).when(ratio.between(0, 1), ratio)
    real = number(dotted)
    word = F.lower(text)
    flag = F.when(word.isin("1", "1.0", "t", "true", "yes"), F.lit(1)).when(
        word.isin("0", "0.0", "f", "false", "no"), F.lit(0)
    )
    return F.struct(
        F.when(value_type == "count", count).when(value_type == "flag", flag.cast("bigint")).alias("whole"),
        F.when(value_type == "ratio", ratio).when(value_type == "real", real).alias("real"),
    )


def resolved_cells(
    rows: DataFrame, attributes: Sequence[Attribute], entity: Sequence[str], name: str = "metric", value: str = "value",
    order: Sequence[str] = ("exported_at", "row_id"),
) -> DataFrame:
    """One row per entity and wanted attribute that occurs.

    Columns: the entity, ``_name``, ``_value`` (whole, real; null if no row of
    the cell is usable), ``_failed`` (number of unusable rows) and ``_last_failure`` (text
    and order of the latest unusable one). Among usable rows the greatest
    ``order`` wins. Nulls: a null name matches nothing, a null value is
    unusable, null order columns come first, null entity columns form a group.
    """
    pairs = [F.lit(x) for a in attributes for x in (_key(a.name), f"{a.value_type}\n{a.name}")]
    wanted = F.create_map(*pairs) if pairs else F.expr("map('', '')")
    hit = F.element_at(wanted, name_key(F.col(name)))
    when = F.struct(*[F.col(c) for c in order])
    slim = rows.select(*entity, F.col(value).alias("_raw"), when.alias("_when"), hit.alias("_hit")).where("_hit is not null")
    cast = slim.select(
        *entity, "_raw", "_when",
        F.substring_index("_hit", "\n", 1).alias("_type"), F.substring_index("_hit", "\n", -1).alias("_name"),
    ).withColumn("_cast", typed_value(F.col("_raw"), F.col("_type")))
    usable = F.col("_cast.whole").isNotNull() | F.col("_cast.real").isNotNull()
    return cast.groupBy(*entity, "_name").agg(
        F.max_by(F.col("_cast"), F.when(usable, F.col("_when"))).alias("_value"),
        F.count_if(~usable).alias("_failed"),
        F.max(F.when(~usable, F.struct(F.col("_when").alias("at"), F.col("_raw").alias("raw")))).alias("_last_failure"),
    )


def _key(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def column_name(name: str) -> str:
    """A column name without dots, which Spark would read as struct access."""
    return name.replace(".", "__")


def wide_table(
    rows: DataFrame, attributes: Sequence[Attribute], entity: Sequence[str] = ("run_id", "policy"), **names,
) -> DataFrame:
    """One row per entity with one typed column per attribute and ``cast_failures``.

    ``cast_failures`` is an array of (attribute, number of unusable rows, text
    of the latest one), bounded by the number of attributes; an unusable value
    never reaches a typed column. Entities all of whose rows are unusable come
    out with empty cells. An empty input gives an empty table with all columns.
    Further input columns are ignored, so clashing names do no harm; an
    attribute whose column name equals an entity column is refused.
    """
    taken = [column_name(a.name) for a in attributes]
    if len({*taken, *entity, "cast_failures"}) != len(taken) + len(entity) + 1:
        raise ValueError("column names of the wide table clash")
    cells = resolved_cells(rows, attributes, entity, **names)
    failure = F.struct(
        F.col("_name").alias("attribute"), F.col("_failed").alias("rows"), F.col("_last_failure.raw").alias("latest")
    )
    by_entity = cells.groupBy(*entity).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_name", "_value")))
        ).alias("_cells"),
        F.array_sort(F.collect_list(F.when(F.col("_failed") > 0, failure))).alias("cast_failures"),
    )
    typed = []
    for a in attributes:
        cell = F.element_at("_cells", F.lit(a.name))
        out = (cell["whole"] == 1) if a.value_type == "flag" else cell["whole"] if a.value_type == "count" else cell["real"]
        typed.append(out.alias(column_name(a.name)))
    return by_entity.select(*entity, *typed, "cast_failures")


def filled_cells(wide: DataFrame, attributes: Sequence[Attribute], entity: Sequence[str] = ("run_id", "policy")) -> DataFrame:
    """The filled cells of a wide table, back in rows: entity, metric, value_e6.

    A value whose millionfold is no bigint has no row here; the wide table has it.
    """
    cells = []
    for a in attributes:
        c = F.col(column_name(a.name))
        if a.value_type == "flag":
            e6 = c.cast("int").cast("bigint") * 1_000_000
        elif a.value_type == "count":
            e6 = F.try_multiply(c, F.lit(1_000_000).cast("bigint"))
        else:
            e6 = F.round(c * 1_000_000).try_cast("bigint")
        cells.append(F.struct(F.lit(a.name).alias("metric"), e6.alias("value_e6")))
    long = wide.select(*entity, F.explode(F.array(*cells)).alias("_c"))
    return long.select(*entity, "_c.metric", "_c.value_e6").where("value_e6 is not null")


def attributes_of(types: DataFrame, export: str, limit: int = 1000) -> list[Attribute]:
    """The wanted attributes of an export, read from a table of at most ``limit`` rows."""
    rows = types.where(F.col("export_name") == export).select("metric", "value_type").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} attributes")
    return [Attribute(r.metric, r.value_type) for r in sorted(rows) if r.metric is not None and r.value_type in TYPES]
