"""The engine: SQL text in, DataFrames or counts of changed rows out."""

from __future__ import annotations

import contextlib
import copy
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.engine.store import Meta, Store
from millrace.errors import NO_COLUMN, NO_TABLE, READ_ONLY, SYNTAX, UNSUPPORTED, SqlError, translated
from millrace.plans.rewrite import Group, Rewriter, Token, nested, spark_type, split_commas, statements, string_value, tokens


@dataclass(frozen=True)
class AffectedRows:
    count: int


class _Frames(dict):
    """Registered DataFrames by name; those of paths are opened when first asked for."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark, self.paths = spark, {}

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or name in self.paths

    def __iter__(self) -> Iterator[str]:
        return iter({*super().__iter__(), *self.paths})

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(self.paths.pop(name))
        return self[name]

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[name] if name in self else default


class Engine:
    """Tables of a folder (root; a temporary one if None) and registered DataFrames, queried by SQL.

    Changes write new immutable files and then one commit record that names the current ones; a transaction writes one
    at COMMIT, with all its tables. Rows are never changed in place and a reader keeps the version that it began with. A
    statement outside of a transaction begins with the newest version, a transaction keeps that of its BEGIN (snapshot
    isolation); a change to a table that another session has changed since then fails with SQLSTATE 40001. Tables of
    attached folders are changed in the same way, each folder by a commit of its own. Deviations from the dialect, on
    purpose: decimals add up exactly, OFFSET and NULLS FIRST/LAST are honoured, overflow is an error, and UPDATE and
    DELETE take any condition.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, readonly: bool = False):
        self.spark, self.readonly = spark, readonly
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
        spark.conf.set("spark.sql.ansi.enabled", "true")
        self.store = Store(spark, root or _temporary(spark))
        #: Of the jobs of threads that have run statements here.
        self.tag = f"millrace-{uuid.uuid4().hex}"
        self.stores: dict[str, Store] = {"": self.store}
        self.tables: dict[str, Meta] = {}
        self.opened: dict[str, tuple[Meta, DataFrame]] = {}
        self.views: dict[str, str] = {}
        self.indexes: dict[str, tuple[str, list[str]]] = {}
        self.frames = _Frames(spark)
        self._saved: tuple | None = None
        #: Unique values are checked later, by ``check``.
        self.deferred = False
        self._refresh()

    # -- tables in reach -----------------------------------------------------------------------------------------------
    def register(self, folder: str, alias: str | None = None, names: tuple[str, ...] | None = None) -> Engine:
        """Makes the Parquet tables of a folder known, as name or alias.name."""
        if names is None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            names = tuple(s.getPath().getName()[: -len(".parquet")] for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))
        for name in names:
            self.frames.paths[(f"{alias}__{name}" if alias else name).lower()] = f"{folder}/{name}.parquet"
        return self

    def register_frame(self, name: str, df: DataFrame) -> None:
        self.frames[name.lower()] = df

    def attach(self, root: str, alias: str) -> None:
        """Tables of another folder as alias.table, for queries and changes."""
        if alias.lower() in self.stores:
            raise SqlError(f"{alias} is attached already", "42P07")
        self.stores[alias.lower()] = Store(self.spark, root)
        self._refresh()

    def detach(self, alias: str) -> None:
        if not alias or alias.lower() not in self.stores:
            raise SqlError(f"{alias} is not attached", NO_TABLE)
        del self.stores[alias.lower()]
        self._refresh()

    def _place(self, name: str) -> tuple[Store, str]:
        """The store of a table, and its name there."""
        alias, mark, bare = name.partition("__")
        return (self.stores[alias], bare) if mark and alias in self.stores else (self.store, name)

    def _write(self, name: str, df: DataFrame) -> str:
        store, bare = self._place(name)
        return store.write(bare, df)

    def _refresh(self) -> None:
        """The newest version of all stores' tables, unless a transaction holds its own."""
        if self._saved:
            return
        now = {f"{alias}__{n}" if alias else n: meta for alias, store in self.stores.items() for n, meta in store.refresh().items()}
        before, self.tables = self.tables, now
        for name in before.keys() - now.keys():
            self.spark.catalog.dropTempView(name)

    def _publish(self, base: dict[str, Meta], changes: dict[str, Meta | None]) -> None:
        """One commit in each store that has changes."""
        for store in self.stores.values():
            mine = {bare: (name, meta) for name, meta in changes.items() for own, bare in [self._place(name)] if own is store}
            if mine:
                store.commit({bare: base[name] for bare, (name, _) in mine.items() if name in base}, {bare: copy.deepcopy(meta) for bare, (_, meta) in mine.items()})
        self._refresh()

    def table(self, name: str) -> DataFrame:
        name = name.lower()
        if name in self.tables:
            return self.store.read(self.tables[name])
        if name in self.frames:
            return self.frames[name]
        if name in self.views:
            return self.query(self.views[name])
        raise SqlError(f"table {name} does not exist", NO_TABLE)

    def _types(self, name: str) -> dict[str, str] | None:
        """Column types of a table, registered frame or view."""
        if name in self.tables:
            struct = self.tables[name].struct
        elif name in self.frames:
            struct = self.frames[name].schema
        elif name in self.views:
            struct = self.query(self.views[name]).schema
        else:
            return None
        return _kinds(struct)

    def _rewriter(self, types: dict[str, str] | None = None, args: list | None = None) -> Rewriter:
        def describe(text: str) -> dict[str, str]:
            try:
                return _kinds(self._run(text, args).schema)  # analysis alone: nothing runs
            except Exception:  # noqa: BLE001
                return {}  # the whole statement's own error says it better

        return Rewriter(types, self._types, describe)

    def _run(self, text: str, args: list | None) -> DataFrame:
        for k in range(len(args or [])):
            text = text.replace(f"p_{k}_parameter", f":p{k}")
        return self.spark.sql(text, args={f"p{k}": a for k, a in enumerate(args)}) if args else self.spark.sql(text)

    def _named(self, flat: list[Token]) -> list[Token]:
        """alias.table as one name; registered tables are opened when they are named."""
        flat = list(flat)
        for alias in {n.split("__")[0] for n in self.frames if "__" in n} | {a for a in self.stores if a}:
            k = 0
            while k + 2 < len(flat):
                if flat[k].low == alias and flat[k].kind == "word" and flat[k + 1].low == "." and (k == 0 or flat[k - 1].low != "."):
                    flat[k : k + 3] = [Token("word", f"{alias}__{flat[k + 2].text.strip(chr(34)).lower()}")]
                k += 1
        for word in {t.text.strip('"`').lower() for t in flat if t.kind in ("word", "quoted")}:
            self._open(word)
        return flat

    def _open(self, name: str) -> None:
        """Makes a table, view or frame of this engine the one that Spark's session knows by that name just now."""
        if name in self.tables:
            if self.opened.get(name, (None,))[0] != self.tables[name]:
                self.opened[name] = copy.deepcopy(self.tables[name]), self.store.read(self.tables[name])
            self.opened[name][1].createOrReplaceTempView(name)
        elif name in self.views:
            self.query(self.views[name]).createOrReplaceTempView(name)
        elif name in self.frames:
            self.frames[name].createOrReplaceTempView(name)

    def _spark_text(self, sql: str, args: list | None = None) -> str:
        # Parameters that are numbers divide as numbers do; other types are left to Spark.
        given = {f"p_{k}_parameter": "bigint" if isinstance(a, int) else "double" for k, a in enumerate(args or []) if isinstance(a, (int, float)) and not isinstance(a, bool)}
        return self._rewriter(given, args).text(nested(self._named(tokens(sql))))

    def query(self, sql: str, args: list | None = None) -> DataFrame:
        """A SELECT."""
        given, wanted = len(args or []), sum(part.count("?") for part in _outside(sql))
        if given != wanted:
            raise SqlError(f"{wanted} parameters are needed, {given} are given", SYNTAX)
        marked = _numbered(sql) if args else sql
        try:
            return self._run(self._spark_text(marked, args), args)
        except SqlError:
            raise
        except Exception as e:
            raise translated(e) from e

    # -- statements ----------------------------------------------------------------------------------------------------
    def sql(self, text: str, args: list | None = None) -> DataFrame | AffectedRows:
        """One statement."""
        each = statements(text)
        if len(each) != 1:
            raise SqlError(f"one statement is expected, not {len(each)}", SYNTAX)
        self._refresh()
        self._tagged()
        flat = tokens(each[0])
        words = [t.low for t in flat[:3]]
        if words[0] in ("select", "with"):
            return self.query(each[0], args)
        flat = self._named(_bound(flat, args or []))
        run = self._statement(words, flat, _flat_sql(flat))
        if self.readonly and words[0] not in ("begin", "start", "commit", "rollback", "explain", "attach", "detach"):
            raise SqlError("the session is read-only", READ_ONLY)
        try:
            return run()
        except SqlError:
            raise
        except Exception as e:
            raise translated(e) from e

    def script(self, text: str) -> list[DataFrame | AffectedRows]:
        return [self.sql(s) for s in statements(text)]

    def prepare(self, text: str) -> Callable[..., DataFrame | AffectedRows]:
        return lambda *args: self.sql(text, list(args) or None)

    def rows(self, text: str, args: list | None = None) -> Iterator[Row]:
        """A cursor: rows one after another, a partition in memory at a time."""
        return self.query(text, args).toLocalIterator()

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Engine]:
        self.sql("BEGIN")
        try:
            yield self
        except BaseException:
            self.sql("ROLLBACK")
            raise
        self.sql("COMMIT")

    def _tagged(self) -> None:
        """Marks this thread's jobs as those of this engine alone."""
        sc = self.spark.sparkContext
        for tag in sc.getJobTags():
            if tag.startswith("millrace-") and tag != self.tag:
                sc.removeJobTag(tag)
        sc.addJobTag(self.tag)

    def cancel(self) -> None:
        """Ends the running jobs of this engine, whatever thread runs them; the statements fail, nothing is committed."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def close(self) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)
        for name in [*self.tables, *self.frames, *self.views]:
            self.spark.catalog.dropTempView(name)

    def _statement(self, words: list[str], flat: list[Token], text: str) -> Callable:
        one, two = words[0], tuple(words[:2])
        items = nested(flat)
        simple = {"begin": self._begin, "start": self._begin, "commit": self._commit, "rollback": self._rollback}
        if one in simple:
            return simple[one]
        if two == ("create", "table"):
            return lambda: self._create(items)
        if two == ("create", "view"):
            return lambda: self._create_view(flat)
        if two == ("create", "index"):
            return lambda: self._create_index(items)
        if one == "create":
            raise SqlError(f"CREATE {words[1].upper()} is not supported", UNSUPPORTED)
        if one == "drop":
            return lambda: self._drop(words[1], flat)
        if two == ("alter", "table"):
            return lambda: self._alter(items)
        if one == "truncate":
            return lambda: self._truncate(flat[-1].low)
        if one in ("insert", "replace"):
            return lambda: self._insert(items, one == "replace")
        if one == "update":
            return lambda: self._update(items)
        if one == "delete":
            return lambda: self._delete(items)
        if one == "analyze":
            return lambda: self.analyze(flat[-1].low)
        if one == "explain":
            if words[1] in ("analyze", "verbose", "format"):
                raise SqlError(f"EXPLAIN {words[1].upper()} is not supported", UNSUPPORTED)
            return lambda: self.explain(text[text.lower().index("explain") + 7 :])
        if one == "attach":
            return lambda: (self.attach(string_value(flat[1].text), flat[3].low), AffectedRows(0))[1]
        if one == "detach":
            return lambda: (self.detach(flat[-1].low), AffectedRows(0))[1]
        raise SqlError(f"statement {one.upper()} is not supported", UNSUPPORTED)

    # -- transactions --------------------------------------------------------------------------------------------------
    def _begin(self) -> AffectedRows:
        if self._saved:
            raise SqlError("a transaction is open already", "25001")
        self._saved = copy.deepcopy(self.tables), dict(self.views), dict(self.indexes)
        return AffectedRows(0)

    def _commit(self) -> AffectedRows:
        if not self._saved:
            raise SqlError("no transaction is open", "25P01")
        before, self._saved = self._saved, None
        changed: dict[str, Meta | None] = {n: m for n, m in self.tables.items() if before[0].get(n) != m} | dict.fromkeys(before[0].keys() - self.tables.keys())
        try:
            self._publish(before[0], changed)
        except BaseException:
            self._saved = before
            self._rollback()
            raise
        return AffectedRows(0)

    def _rollback(self) -> AffectedRows:
        if not self._saved:
            raise SqlError("no transaction is open", "25P01")
        now, (self.tables, self.views, self.indexes), self._saved = self.tables, self._saved, None
        for name in now.keys() - self.tables.keys():
            self.spark.catalog.dropTempView(name)
        self._refresh()
        return AffectedRows(0)

    def _set(self, name: str, meta: Meta | None) -> None:
        """A table's new version (None: it goes); committed at once outside of a transaction."""
        if not self._saved:
            self._publish(self.tables, {name: meta})
        elif meta is None:
            del self.tables[name]
            self.spark.catalog.dropTempView(name)
        else:
            self.tables[name] = meta

    def _own(self, name: str) -> Meta:
        if name in self.views:
            raise SqlError(f"view {name} is read-only", UNSUPPORTED)
        if name not in self.tables:
            raise SqlError(f"table {name} does not exist", NO_TABLE)
        return copy.deepcopy(self.tables[name])

    # -- definitions ---------------------------------------------------------------------------------------------------
    def _free(self, name: str) -> None:
        if name in self.tables or name in self.views or name in self.frames:
            raise SqlError(f"{name} exists already", "42P07")

    def _create(self, items: list) -> AffectedRows:
        k, missing_ok = 2, False
        if items[2].low == "if":
            k, missing_ok = 5, True
        name = items[k].text.strip('"`').lower()
        if missing_ok and name in self.tables:
            return AffectedRows(0)
        self._free(name)
        if items[k + 1].low == "as":
            df = self.query(_sql(items[k + 2 :]))
            kinds = [StructField(f.name.lower(), StringType() if f.dataType.simpleString() == "void" else f.dataType, True) for f in df.schema]
            typed = df.select(*[F.col(f"`{f.name}`").cast(k.dataType).alias(k.name) for f, k in zip(df.schema, kinds, strict=True)])
            meta = Meta(StructType(kinds).json(), [self._write(name, typed)])
            self._set(name, meta)
            return AffectedRows(self.store.read(meta).count())
        meta, fields = Meta(""), []
        for column in split_commas(items[k + 1].items):
            if column[0].low in ("check", "foreign", "constraint", "unique", "primary"):
                raise SqlError(f"{column[0].low.upper()} constraints of a table are not supported", UNSUPPORTED)
            fields.append(self._column(column, meta))
        if meta.key is None and fields and isinstance(fields[0].dataType, LongType):
            meta.key = fields[0].name
        meta.schema = StructType(fields).json()
        self._set(name, meta)
        return AffectedRows(0)

    def _column(self, items: list, meta: Meta) -> StructField:
        name = items[0].text.strip('"`').lower()
        stop = next((i for i, t in enumerate(items) if t.low in ("primary", "not", "unique", "default", "check", "references", "null")), len(items))
        kind = spark_type(items[1:stop])
        rest = [t.low for t in items[stop:]]
        if "check" in rest or "references" in rest:
            raise SqlError("CHECK and REFERENCES are not supported", UNSUPPORTED)
        if "primary" in rest:
            if kind != "bigint":
                raise SqlError("a primary key must be an INTEGER", UNSUPPORTED)
            meta.key = name
        if "unique" in rest:
            meta.unique.append(name)
        if "not" in rest or meta.key == name:
            meta.required.append(name)
        if "default" in rest:
            at = stop + rest.index("default") + 1
            end = next((i for i in range(at, len(items)) if items[i].low in ("primary", "not", "unique")), len(items))
            meta.defaults[name] = _sql(items[at:end])
        # Parquet columns stay nullable: the constraint is checked where rows are written.
        return StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType, True)

    def _create_view(self, flat: list[Token]) -> AffectedRows:
        name = flat[2].low
        self._free(name)
        _ = self.query(_flat_sql(flat[4:])).schema  # it must be a query
        self.views[name] = _flat_sql(flat[4:])
        return AffectedRows(0)

    def _create_index(self, items: list) -> AffectedRows:
        """Kept by name only: row-group statistics of the files serve lookups and ranges."""
        name, target = items[2].low, items[4].low
        columns = [c[0].low for c in split_commas(items[5].items)]
        known = {f.name for f in self._own(target).struct}
        for c in columns:
            if c not in known:
                raise SqlError(f"column {c} does not exist", NO_COLUMN)
        self.indexes[name] = (target, columns)
        return AffectedRows(0)

    def _drop(self, kind: str, flat: list[Token]) -> AffectedRows:
        name, missing_ok = flat[-1].low, any(t.low == "exists" for t in flat)
        known = {"table": self.tables, "view": self.views, "index": self.indexes}.get(kind)
        if known is None:
            raise SqlError(f"DROP {kind.upper()} is not supported", UNSUPPORTED)
        if name not in known:
            if missing_ok:
                return AffectedRows(0)
            raise SqlError(f"{kind} {name} does not exist", NO_TABLE)
        if kind == "table":
            self._set(name, None)
            return AffectedRows(0)
        del known[name]
        if kind == "view":
            self.spark.catalog.dropTempView(name)
        return AffectedRows(0)

    def _alter(self, items: list) -> AffectedRows:
        name, what = items[2].low, items[3].low
        meta = self._own(name)
        df = self.store.read(meta)
        rest = items[5:] if items[4].low == "column" else items[4:]
        if what == "add":
            field = self._column(rest, meta)
            if field.name in df.columns:
                raise SqlError(f"column {field.name} exists already", "42701")
            default = meta.defaults.get(field.name)
            if field.name in meta.required and default is None and meta.parts and not df.isEmpty():
                raise SqlError(f"column {field.name} is NOT NULL and needs a DEFAULT", "23502")
            df = df.withColumn(field.name, F.expr(Rewriter()(default)).cast(field.dataType) if default else F.lit(None).cast(field.dataType))
            meta.schema = StructType([*meta.struct, field]).json()
        elif what == "drop":
            column = rest[0].low
            if column not in df.columns:
                raise SqlError(f"column {column} does not exist", NO_COLUMN)
            if len(df.columns) == 1:
                raise SqlError("the last column can't be dropped", UNSUPPORTED)
            df = df.drop(column)
            meta.schema = StructType([f for f in meta.struct if f.name != column]).json()
            meta.key = None if meta.key == column else meta.key
            meta.unique, meta.required = [c for c in meta.unique if c != column], [c for c in meta.required if c != column]
            meta.defaults.pop(column, None)
        else:
            raise SqlError(f"ALTER TABLE {what.upper()} is not supported", UNSUPPORTED)
        if meta.parts:
            meta.parts = [self._write(name, df)]
        self._set(name, meta)
        return AffectedRows(0)

    # -- changes -------------------------------------------------------------------------------------------------------
    def _truncate(self, name: str) -> AffectedRows:
        meta = self._own(name)
        meta.parts = []
        self._set(name, meta)
        return AffectedRows(0)

    def _checked(self, name: str, meta: Meta, rows: DataFrame) -> DataFrame:
        """Rows as they are to be stored: NOT NULL holds; raises before anything is seen."""
        missing = [c for c in meta.required if c in rows.columns]
        if missing:
            bad = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in missing]).first()
            for c in missing:
                if bad[c]:
                    raise SqlError(f"column {c} of {name} is NOT NULL", "23502")
        return rows

    def _unique(self, name: str, meta: Meta, fresh: DataFrame, old: DataFrame | None = None) -> None:
        """Raises if values of unique columns are twice in fresh, or in fresh and old: only fresh values are counted."""
        for c in dict.fromkeys([*([meta.key] if meta.key else []), *meta.unique]):
            values = fresh.select(c).filter(F.col(c).isNotNull())
            again = old is not None and not old.select(c).join(values, c, "left_semi").isEmpty()
            if again or not values.groupBy(c).count().filter("count > 1").isEmpty():
                raise SqlError(f"duplicate value in {c} of {name}", "23505")

    def _typed(self, name: str, meta: Meta, rows: DataFrame) -> DataFrame:
        """Casts to the table's types; only integers to floats, and strings to dates and timestamps, change family."""
        out = []
        for f in meta.struct:
            have, want = rows.schema[f.name].dataType.simpleString(), f.dataType.simpleString()
            a, b = Rewriter._family_of_type(have), Rewriter._family_of_type(want)
            ok = have in ("void", want) or a == b or (a, b) in (("int", "float"), ("string", "date"), ("string", "timestamp"), ("int", "decimal"), ("float", "decimal"), ("decimal", "float"))
            if not ok:
                raise SqlError(f"column '{f.name}' expects {want}, got {have}", "42804")
            cast = F.col(f.name).cast(f.dataType)
            if b == "decimal" and a in ("decimal", "float", "int") and have != want:
                exact = F.col(f.name).cast("decimal(38,18)")
                cast = F.when(exact == cast.cast("decimal(38,18)"), cast).when(F.col(f.name).isNull(), None).otherwise(F.raise_error(F.lit(f"column '{f.name}': the value does not fit {want}")).cast(f.dataType))
            out.append(cast.alias(f.name))
        return rows.select(*out)

    def _insert(self, items: list, replace: bool) -> AffectedRows:
        if len(items) > 2 and items[1].low == "or":
            raise SqlError("INSERT OR is not supported", UNSUPPORTED)
        name, k = items[2].text.strip('"`').lower(), 3
        meta = self._own(name)
        names = [f.name for f in meta.struct]
        given = names
        if isinstance(items[k], Group):
            given, k = [c[0].text.strip('"`').lower() for c in split_commas(items[k].items)], k + 1
            for c in given:
                if c not in names:
                    raise SqlError(f"column {c} does not exist", NO_COLUMN)
        conflict = next((i for i in range(k, len(items) - 1) if items[i].low == "on" and items[i + 1].low == "conflict"), len(items))
        source = items[k:conflict]
        if source[0].low == "values":
            rows = self._values(source[1:], given, meta)
        else:
            df = self.query(_sql(source))
            if len(df.columns) != len(given):
                raise SqlError(f"{len(given)} columns are needed, {len(df.columns)} are given", SYNTAX)
            # The order of a SELECT's rows counts where several conflict: as the query gives them.
            rows = df.toDF(*given).withColumn("order_", F.monotonically_increasing_id())
        for f in meta.struct:
            if f.name not in given:
                default = meta.defaults.get(f.name)
                rows = rows.withColumn(f.name, F.expr(Rewriter()(default)) if default else F.lit(None).cast(f.dataType))
        typed = self._typed(name, meta, rows).withColumns({}) if not (replace or conflict < len(items)) else None
        old = self.store.read(meta)
        if typed is not None:
            part = self._write(name, self._checked(name, meta, typed))
            fresh = self.spark.read.schema(meta.struct).parquet(part)
            if not self.deferred:
                self._unique(name, meta, fresh, old)
            count = fresh.count()
            meta.parts = [*meta.parts, part]
            self._set(name, meta)
            return AffectedRows(count)
        ordered = self._typed(name, Meta(StructType([*meta.struct, StructField("order_", LongType())]).json()), rows)
        ordered = self._checked(name, meta, ordered)
        if replace:
            new, count = self._replaced(meta, old, ordered)
        else:
            new, count = self._upserted(meta, old, ordered, items[conflict + 2 :])
        part = self._write(name, new)
        meta.parts = [part]
        self._unique(name, meta, self.store.read(meta))
        self._set(name, meta)
        return AffectedRows(count)

    def _values(self, groups: list, given: list[str], meta: Meta) -> DataFrame:
        rows = []
        types = {f.name: f.dataType.simpleString() for f in meta.struct}
        write = Rewriter()
        for n, g in enumerate(t for t in groups if isinstance(t, Group)):
            values = split_commas(g.items)
            if len(values) != len(given):
                raise SqlError(f"{len(given)} values are needed, {len(values)} are given", SYNTAX)
            cells = []
            for c, v in zip(given, values, strict=True):
                if len(v) == 1 and v[0].low == "default":
                    text = meta.defaults.get(c)
                    cells.append(write(text) if text else "null")
                else:
                    text = write.text(v)
                    number = len(v) <= 2 and v[-1].kind == "number"
                    cells.append(text.rstrip("DL") + ("BD" if number else "") if types[c].startswith("decimal") and number else text)
            rows.append(f"({', '.join(cells)}, {n}L)")
        return self.spark.sql(f"select * from values {', '.join(rows)} as t({', '.join(f'`{c}`' for c in given)}, order_)")

    def _replaced(self, meta: Meta, old: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
        """The last row of each key stays; rows of the table that share a key or a unique value with it go."""
        keys = list(dict.fromkeys([*([meta.key] if meta.key else []), *meta.unique]))
        for c in keys:
            last = F.row_number().over(Window.partitionBy(c).orderBy(F.desc("order_")))
            rows = rows.withColumn("n_", last).filter(F.col(c).isNull() | (F.col("n_") == 1)).drop("n_")
            old = old.join(rows.select(F.col(c)), c, "left_anti")
        return old.unionByName(rows.drop("order_")), rows.count()

    def _upserted(self, meta: Meta, old: DataFrame, rows: DataFrame, items: list) -> tuple[DataFrame, int]:
        target = split_commas(items[0].items)[0][0].low if items and isinstance(items[0], Group) else None
        do = [t.low for t in items if t.kind == "word"]
        keys = [target] if target else list(dict.fromkeys([*([meta.key] if meta.key else []), *meta.unique]))
        if not keys or target and target not in (meta.key, *meta.unique):
            raise SqlError("ON CONFLICT needs a key or unique column", UNSUPPORTED)
        if "nothing" in do:
            for c in keys:
                first = F.row_number().over(Window.partitionBy(c).orderBy("order_"))
                rows = rows.withColumn("n_", first).filter(F.col(c).isNull() | (F.col("n_") == 1)).drop("n_")
                rows = rows.join(old.select(c), c, "left_anti")
            return old.unionByName(rows.select(*old.columns)), rows.count()
        at = next(i for i, t in enumerate(items) if t.low == "set")
        key = keys[0]
        # Of several new rows with one key the last is the one that counts.
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("order_")))
        fresh = rows.withColumn("n_", last).filter((F.col("n_") == 1) | F.col(key).isNull()).drop("n_", "order_")
        sets: dict[str, str] = {}
        for part in split_commas(items[at + 1 :]):
            column, value = part[0].low, part[2:]
            sets[column] = meta.defaults.get(column, "null") if len(value) == 1 and value[0].low == "default" else _sql(value)
        new = fresh.select(*[F.col(c).alias(f"excluded_{c}") for c in fresh.columns], F.lit(True).alias("there_new"))
        joined = old.withColumn("there_old", F.lit(True)).join(new, F.col(key) == F.col(f"excluded_{key}"), "full")
        both = F.col("there_old") & F.col("there_new")
        out = []
        for f in meta.struct:
            value = F.expr(Rewriter()(_excluded(sets[f.name]))).cast(f.dataType) if f.name in sets else F.col(f.name)
            out.append(F.when(both, value).when(F.col("there_old"), F.col(f.name)).otherwise(F.col(f"excluded_{f.name}")).alias(f.name))
        return joined.select(*out), fresh.count()

    def _update(self, items: list) -> AffectedRows:
        name = items[1].low
        meta = self._own(name)
        where = next((i for i, t in enumerate(items) if t.low == "where"), len(items))
        types = {f.name: f.dataType.simpleString() for f in meta.struct}
        write = self._rewriter(types)
        cond = F.coalesce(F.expr(write.text(items[where + 1 :])), F.lit(False)) if where < len(items) else F.lit(True)
        sets = {}
        for part in split_commas(items[3:where]):
            c = part[0].low
            if c not in types:
                raise SqlError(f"column {c} does not exist", NO_COLUMN)
            sets[c] = F.expr(write.text(part[2:]) if part[2].low != "default" else write(meta.defaults.get(c, "null")))
        # One pass finds the files that hold such rows; only these are written anew.
        count, hit, others = self.store.matching(meta, cond)
        if count:
            old = self.spark.read.schema(meta.struct).parquet(*hit)
            changed = old.filter(cond).select(*[sets.get(f.name, F.col(f.name)).alias(f.name) for f in meta.struct])
            typed = self._checked(name, meta, self._typed(name, meta, changed))
            if set(sets) & {meta.key, *meta.unique}:
                rest = old.filter(~cond)
                self._unique(name, meta, typed, rest.unionByName(self.spark.read.schema(meta.struct).parquet(*others)) if others else rest)
            part = self._write(name, old.filter(~cond).unionByName(typed))
            meta.parts = [*_untouched(meta.parts, hit, others), part]
            self._set(name, meta)
        return AffectedRows(count)

    def _delete(self, items: list) -> AffectedRows:
        name = items[2].low
        meta = self._own(name)
        where = next((i for i, t in enumerate(items) if t.low == "where"), None)
        if where is None:
            count, meta.parts = self.store.read(meta).count(), []
        else:
            condition = F.coalesce(F.expr(self._rewriter(_kinds(meta.struct)).text(items[where + 1 :])), F.lit(False))
            count, hit, others = self.store.matching(meta, condition)
            if count:
                part = self._write(name, self.spark.read.schema(meta.struct).parquet(*hit).filter(~condition))
                meta.parts = [*_untouched(meta.parts, hit, others), part]
        self._set(name, meta)
        return AffectedRows(count)

    # -- about tables --------------------------------------------------------------------------------------------------
    def analyze(self, name: str) -> DataFrame:
        from millrace.operators.analytics import analyze

        return analyze(self.table(name))

    def check(self) -> DataFrame:
        """(table, problem): what the data of the engine's tables breaks of their constraints; no row if all is well."""
        found = []
        for name in sorted(self.tables):
            meta = self.tables[name]
            rows = self.store.read(meta)
            for what in (lambda m=meta, r=rows, n=name: self._checked(n, m, r), lambda m=meta, r=rows, n=name: self._unique(n, m, r)):
                try:
                    what()
                except Exception as e:  # noqa: BLE001
                    found.append((name, translated(e).message))
        return self.spark.createDataFrame(found, "table string, problem string")

    def explain(self, sql: str) -> DataFrame:
        """The plan as text, one line a row; nothing runs."""
        plan = self.query(sql)._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")

    def schema(self, name: str) -> str:
        from millrace.sources.dump import create_table

        return create_table(name, self._own(name.lower()))


def _kinds(struct: StructType) -> dict[str, str]:
    return {f.name.lower(): f.dataType.simpleString() for f in struct}


def _temporary(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on one machine, where no shared one is named, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/millrace-db-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise SqlError("an engine without a folder needs spark.checkpoint.dir, a folder that all executors share", UNSUPPORTED)
    return "file://" + tempfile.mkdtemp(prefix="millrace-db-")


def _untouched(parts: list[str], hit: list[str], others: list[str]) -> list[str]:
    """Folders and files of parts without any file of hit; of a folder that has one, its other files."""
    out = []
    for p in parts:
        place = unquote(p).replace("file:///", "file:/").rstrip("/")
        inside = lambda f, place=place: f == place or f.startswith(place + "/")
        out += [f for f in others if inside(f)] if any(map(inside, hit)) else [p]
    return out


def _bound(flat: list[Token], args: list) -> list[Token]:
    """The statement with a literal for each parameter."""
    marks = sum(t.kind == "op" and t.text == "?" for t in flat)
    if marks != len(args):
        raise SqlError(f"{marks} parameters are needed, {len(args)} are given", SYNTAX)
    rest = iter(args)
    return [x for t in flat for x in (tokens(_literal(next(rest))) if t.kind == "op" and t.text == "?" else [t])]


def _literal(value: object) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float, Decimal)):
        if isinstance(value, float) and not math.isfinite(value):
            raise SqlError("a parameter must be finite", SYNTAX)
        return str(value)
    if isinstance(value, bytes):
        return f"unhex('{value.hex()}')"
    if isinstance(value, datetime):
        return f"timestamp '{value}'"
    if isinstance(value, date):
        return f"date '{value}'"
    return "'" + str(value).replace("'", "''") + "'"


def _flat_sql(flat: list[Token]) -> str:
    return " ".join(t.text for t in flat)


def _sql(items: list) -> str:
    return " ".join(f"({_sql(t.items)})" if isinstance(t, Group) else t.text for t in items)


def _outside(sql: str) -> list[str]:
    """What stands outside of string literals."""
    return sql.split("'")[::2]


def _numbered(sql: str) -> str:
    out, k = [], 0
    for i, part in enumerate(sql.split("'")):
        if i % 2 == 0:
            while "?" in part:
                part = part.replace("?", f" p_{k}_parameter ", 1)
                k += 1
        out.append(part)
    return "'".join(out)


def _excluded(sql: str) -> str:
    return sql.replace("excluded . ", "excluded_").replace("EXCLUDED . ", "excluded_").replace("excluded.", "excluded_")
