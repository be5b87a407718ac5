"""Results as text: table, JSON, CSV and TSV. For results of a size to read; large ones are written with df.write."""

from __future__ import annotations

import csv
import io
import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame

#: Cells of a table wider than this are cut to three less, and dots.
CELL = 64


def _cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex().upper()
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e16:
        return str(int(v))
    return str(v)


def _json(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex().upper()
    return str(v) if isinstance(v, (Decimal, date, datetime)) else v


def render(df: DataFrame, form: str = "table") -> str:
    columns, rows = df.columns, df.collect()
    if form == "json":
        return json.dumps({"columns": columns, "rows": [[_json(v) for v in r] for r in rows]}, ensure_ascii=False)
    if form in ("csv", "tsv"):
        out = io.StringIO()
        write = csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="\n")
        write.writerow(columns)
        write.writerows(["" if v is None else _cell(v) for v in r] for r in rows)
        return out.getvalue()
    if form != "table":
        raise ValueError(f"unknown form {form}")
    cut = lambda s: s if len(s) <= CELL else s[: CELL - 3] + "..."
    cells = [columns, *[[cut(_cell(v)) for v in r] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in widths), *map(line, cells[1:])])
