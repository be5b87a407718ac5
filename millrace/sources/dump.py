"""Dump to and restore from SQL text: CREATE TABLE and INSERT statements."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, StringType, StructField, TimestampNTZType

from millrace.engine.session import Engine
from millrace.engine.store import Meta
from millrace.errors import SqlError
from millrace.plans.rewrite import statements

#: Declared names of the types.
NAMES = {"bigint": "INTEGER", "double": "FLOAT", "string": "STRING", "boolean": "BOOL", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


def create_table(name: str, meta: Meta) -> str:
    parts = []
    for f in meta.struct:
        kind = f.dataType.simpleString()
        words = [f'"{f.name}"', NAMES.get(kind, kind.upper())]
        if meta.key == f.name:
            words.append("PRIMARY KEY")
        elif f.name in meta.required:
            words.append("NOT NULL")
        if f.name in meta.unique:
            words.append("UNIQUE")
        if f.name in meta.defaults:
            words.append(f"DEFAULT {meta.defaults[f.name]}")
        parts.append(" ".join(words))
    return f'CREATE TABLE "{name}" ({", ".join(parts)})'


def _literal(f: StructField) -> Column:
    """A cell as SQL text, made on the executors."""
    c, q = F.col(f"`{f.name}`"), F.lit("'")
    if isinstance(f.dataType, (StringType, DateType, TimestampNTZType)):
        text = F.concat(q, F.replace(c.cast("string"), q, F.lit("''")), q)
    elif isinstance(f.dataType, BinaryType):
        text = F.concat(F.lit("unhex('"), F.hex(c), F.lit("')"))
    elif isinstance(f.dataType, BooleanType):
        text = F.upper(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def dump(engine: Engine) -> Iterator[str]:
    """Statements one after another; rows pass through the driver a partition at a time."""
    for name, meta in sorted(engine.store.refresh().items()):
        yield create_table(name, meta)
        row = F.concat_ws(", ", *[_literal(f) for f in meta.struct])
        for r in engine.store.read(meta).select(row.alias("r")).toLocalIterator():
            yield f'INSERT INTO "{name}" VALUES ({r["r"]})'


def restore(engine: Engine, script: str, batch: int = 2000) -> None:
    """Runs a dump in an empty engine, all of it or nothing; the text passes through the driver.

    INSERTs into one table that follow each other are joined, and unique values are checked once at the end.
    """
    with engine.transaction():
        engine.deferred = True
        try:
            _restore(engine, script, batch)
        finally:
            engine.deferred = False
        for r in engine.check().collect():  # a row a broken constraint
            raise SqlError(r["problem"], "23505")


def _restore(engine: Engine, script: str, batch: int) -> None:
    head, rows = "", []

    def flush() -> None:
        nonlocal rows
        if rows:
            engine.sql(f"{head} {', '.join(rows)}")
        rows = []

    for s in statements(script):
        if s.upper().startswith("INSERT") and " VALUES " in s:
            at = s.index(" VALUES ") + 8
            if s[: at - 1] != head or len(rows) >= batch:
                flush()
            head = s[: at - 1]
            rows.append(s[at:])
        else:
            flush()
            engine.sql(s)
    flush()
