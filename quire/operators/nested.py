"""Nested JSON payloads as related flat tables.

One pass over the payloads shreds every array level into rows of a child table
that carry their own key, the parent's key and their place in the array; objects
inside a row become dotted columns. From the kept rows the merged schema lists
each (table, column, type) that occurs, and the tables are typed by it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

ROW_SCHEMA = "`table` string, row_key string, parent_key string, ordinal int, cols map<string,string>"
#: Columns over all tables that a schema may have.
MOST_COLUMNS = 10_000
LINKS = ("row_key", "parent_key", "ordinal")
_SPACE = "﻿ \t\r\n ​\x00"
_SQL = {"b": "boolean", "i": "bigint", "d": "double", "s": "string"}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_complete(text: object) -> object:
    """The value of a complete JSON text, blanks and byte-order marks around it apart; else None."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text.strip(_SPACE), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def _slots(value: object) -> list[dict | None]:
    """The outputs of a payload in order; an element of a list that holds none keeps its place as None."""
    if isinstance(value, str):
        inner = parse_complete(value)
        return _slots(inner) if isinstance(inner, (dict, list, str)) else [None]
    if isinstance(value, list):
        return [s for x in value for s in (_slots(x) if isinstance(x, (dict, list, str)) else [None])]
    if not isinstance(value, dict):
        return [None]
    if "result" in value:
        return [value]
    inside = []
    for x in value.values():
        if isinstance(x, (dict, list)) or (isinstance(x, str) and x.lstrip(_SPACE)[:1] in ("{", "[", '"')):
            found = _slots(x)
            if any(s is not None for s in found):
                inside += found
    if inside:
        return inside
    return [value if "error" in value or "command" in value else None]


def outputs(value: object) -> Iterator[tuple[int, dict]]:
    """The command outputs in a payload with their places in it.

    A payload may be one output, a list of outputs, either of them as a JSON
    string, or an object that wraps these at any depth, plainly or as JSON
    strings. An output is an object with a ``result``, or one with ``error`` or
    ``command`` that wraps no output; what lies inside it is never searched.
    Places count over the whole payload, list elements without an output included.
    """
    for i, out in enumerate(_slots(value)):
        if out is not None:
            yield i, out


def _scalar(value: object) -> tuple[str, str]:
    if isinstance(value, bool):
        return "b", "true" if value else "false"
    if isinstance(value, int):
        return "i", str(value)
    if isinstance(value, float):
        return "d", repr(value)
    return "s", value


def shred(value: object, table: str, key: str, parent: str | None, ordinal: int, decode: frozenset[str], split: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, str | None, int, dict[str, tuple[str, str]]]]:
    """Rows (table, key, parent key, ordinal, typed columns) of a value and all that is below it.

    ``decode``: column paths whose JSON strings are opened as if they were
    written plainly. ``split``: array columns that, when an object stands where
    the array should, give one child row with ordinal 0. A null element keeps
    its place but has no row.
    """
    cols: dict[str, tuple[str, str]] = {}
    below: list[tuple[str, object]] = []

    def walk(v: object, path: str) -> None:
        full = f"{table}.{path}" if path else table
        if path and isinstance(v, str) and full in decode:
            inner = parse_complete(v)
            v = inner if isinstance(inner, (dict, list)) else v
        if path and isinstance(v, dict) and full in split:
            v = [v]
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else str(k))
        elif isinstance(v, list):
            below.append((path, v))
        elif v is not None:
            cols[path or "value"] = _scalar(v)

    walk(value, "")
    yield table, key, parent, ordinal, cols
    for path, items in below:
        name = f"{table}.{path}" if path else f"{table}.items"
        for i, x in enumerate(items):
            if x is not None:
                yield from shred(x, name, f"{key}/{path}[{i}]", key, i, decode, split)


def _payload_rows(pdf: pd.DataFrame, decode: frozenset[str], split: frozenset[str]) -> Iterator[tuple]:
    for k, text in zip(pdf["_k"], pdf["_p"]):
        value = parse_complete(text)
        if isinstance(value, (dict, list, str)):
            try:
                rows = [r for pos, out in outputs(value) for r in shred(out, "run", f"{k}#{pos}", None if k is None else str(k), pos, decode, split)]
            except RecursionError:  # nested by hundreds of levels: unreadable, as for the parser
                continue
            yield from rows


def _frame(df: DataFrame, key: str, payload: str) -> DataFrame:
    return df.where(F.col(payload).isNotNull()).select(F.col(key).cast("string").alias("_k"), F.col(payload).alias("_p"))


def shredded(df: DataFrame, key: str, payload: str, tables: Iterable[str] | None = None, decode: Iterable[str] = (), split: Iterable[str] = ()) -> DataFrame:
    """All rows of all (or the named) tables in one frame; no shuffle.

    ``cols`` holds each value as text after one letter for its JSON type (b, i, d, s).
    """
    dec, spl, want = frozenset(decode), frozenset(split), None if tables is None else frozenset(tables)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, k, p, o, {c: kind + v for c, (kind, v) in cols.items()}) for t, k, p, o, cols in _payload_rows(pdf, dec, spl) if want is None or t in want]
            yield pd.DataFrame(out, columns=["table", "row_key", "parent_key", "ordinal", "cols"])

    return _frame(df, key, payload).mapInPandas(rows, ROW_SCHEMA)


def merged_schema(rows: DataFrame) -> dict[str, dict[str, str]]:
    """Table -> column -> SQL type over all shredded rows; long and double merge to double, other mixtures to string.

    A schema has to fit a plan, so more than MOST_COLUMNS columns (ids used as field names, say) are refused.
    """
    cols = rows.select("table", F.explode_outer("cols").alias("c", "v")).select("table", "c", F.left("v", F.lit(1)).alias("k"))
    found = cols.groupBy("table", "c").agg(F.collect_set("k").alias("ks")).limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    schema: dict[str, dict[str, str]] = {}
    for r in sorted(found, key=lambda r: (r["table"], r["c"] or "")):
        ks = set(r["ks"])
        table = schema.setdefault(r["table"], {})
        if r["c"] is not None:
            table[r["c"]] = _SQL[ks.pop() if len(ks) == 1 else ("d" if ks == {"i", "d"} else "s")]
    return schema


def flat_table(rows: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """One table with typed columns. A JSON field named like a link column gets the prefix ``json_``."""
    quoted = lambda c: c.replace("\\", "\\\\").replace("'", "\\'")
    picked = [F.expr(f"try_cast(substr(try_element_at(cols, '{quoted(c)}'), 2) as {t})").alias(f"json_{c}" if c in LINKS else c) for c, t in columns.items()]
    return rows.where(F.col("table") == table).select(*LINKS, *picked)


def flat_tables(df: DataFrame, key: str, payload: str, decode: Iterable[str] = (), split: Iterable[str] = (), tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Every (or each named) table of the payloads by name, typed by the merged schema.

    Payloads are parsed and shredded once; the rows are kept in the shared
    checkpoint folder, and both the schema and the tables are read from there.
    Null and unreadable payloads give no rows; a payload received twice gives
    each row once; other columns of ``df`` are not read.
    """
    rows = cut_lineage(shredded(df.select(key, payload).dropDuplicates(), key, payload, tables, decode, split))
    return {t: flat_table(rows, t, cols) for t, cols in merged_schema(rows).items()}


#: Where answer payloads hold hits, and what may be written as a JSON string there.
HITS = "run.result.top_k_hits"
DECODE = ("run.result", "run.result.top_k_hits")
SPLIT = ("run.result.top_k_hits",)


def answer_tables(runs: DataFrame, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Flat tables of ``answer_runs`` (run_id, payload): runs, hits and all deeper children."""
    return flat_tables(runs, "run_id", "payload", DECODE, SPLIT, tables)


def answer_table(runs: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """The link columns and the named columns, as strings, of one answer table; null where no payload has the column, empty without rows."""
    found = answer_tables(runs, [name]).get(name)
    if found is None:
        return runs.sparkSession.createDataFrame([], "row_key string, parent_key string, ordinal int, " + ", ".join(f"`{c}` string" for c in columns))
    return found.select(*LINKS, *[(F.col(f"`{c}`").cast("string") if c in found.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def answer_hits(runs: DataFrame) -> DataFrame:
    """run_id, result_pos, hit_pos, chunk_id, doc_id of each hit with a chunk_id, once per run."""
    return answer_table(runs, HITS, ("chunk_id", "doc_id")).where("chunk_id is not null").select(
        F.substring_index("row_key", "#", 1).cast("bigint").alias("run_id"),
        F.regexp_extract("row_key", r"#(\d+)/", 1).cast("int").alias("result_pos"),
        F.col("ordinal").alias("hit_pos"),
        "chunk_id",
        "doc_id",
    )
