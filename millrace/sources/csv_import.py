"""CSV import into engine tables: a header row is required; columns are matched by name, or inferred for a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DecimalType, StringType, StructField, StructType

from millrace.engine.session import AffectedRows, Engine
from millrace.engine.store import Meta
from millrace.errors import NO_COLUMN, SqlError

_INTEGER, _FLOAT = r"^[+-]?[0-9]{1,19}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def read_text(engine: Engine, path: str) -> DataFrame:
    """All columns as strings; quotes as in RFC 4180, lines may break inside them; an empty field is ''."""
    return engine.spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False, emptyValue="", nullValue="\0")


def inferred(df: DataFrame) -> StructType:
    """Types of a new table, from one pass: integers, else floats, else strings; empty fields say nothing, and none at all a string."""
    checks = []
    for k, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        full = v.isNotNull() & (v != "")
        whole = v.rlike(_INTEGER) & F.expr(f"try_cast(`{c}` as bigint)").isNotNull()
        checks += [F.count_if(full).alias(f"n{k}"), F.count_if(full & whole).alias(f"i{k}"), F.count_if(full & (whole | v.rlike(_FLOAT))).alias(f"f{k}")]
    r = df.agg(*checks).first()
    kind = lambda k: "string" if not r[f"n{k}"] else "bigint" if r[f"i{k}"] == r[f"n{k}"] else "double" if r[f"f{k}"] == r[f"n{k}"] else "string"
    return StructType([StructField(c.lower(), StructType.fromDDL(f"x {kind(k)}")[0].dataType, True) for k, c in enumerate(df.columns)])


def _value(c: str, f: StructField) -> Column:
    v = F.col(f"`{c}`")
    if isinstance(f.dataType, StringType):
        return F.coalesce(v, F.lit(""))
    empty = v.isNull() | (v == "")
    if isinstance(f.dataType, BooleanType):
        low = F.lower(v)
        typed = F.when(low == "true", True).when(low == "false", False).otherwise(F.raise_error(F.lit(f"column {f.name}: not a BOOL")).cast("boolean"))
    elif isinstance(f.dataType, BinaryType):
        typed = F.unhex(v)
    elif isinstance(f.dataType, DecimalType):
        typed = v.cast(f.dataType)
    else:
        typed = v.cast(f.dataType)
    return F.when(empty, F.lit(None).cast(f.dataType)).otherwise(typed)


def import_csv(engine: Engine, path: str, table: str) -> AffectedRows:
    """Rows of a CSV file into a table, which is made if it isn't there. Missing and unknown columns are errors."""
    name, df = table.lower(), read_text(engine, path)
    meta = engine.tables.get(name)
    struct = meta.struct if meta else inferred(df)
    have = {c.lower(): c for c in df.columns}
    for c in have.keys() - {f.name for f in struct}:
        raise SqlError(f"column {c} does not exist", NO_COLUMN)
    for f in struct:
        if f.name not in have:
            raise SqlError(f"column {f.name} is missing in the file", NO_COLUMN)
    rows = df.select(*[_value(have[f.name], f).alias(f.name) for f in struct])
    if meta is None:
        meta = Meta(struct.json())
    else:
        meta = engine._own(name)
    part = engine._write(name, engine._checked(name, meta, rows))
    fresh = engine.spark.read.schema(struct).parquet(part)
    engine._unique(name, meta, fresh, engine.store.read(meta))
    meta.parts = [*meta.parts, part]
    engine._set(name, meta)
    return AffectedRows(fresh.count())
