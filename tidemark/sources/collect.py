"""Collecting from paged services and addresses through injected functions, with resumable state; item
files, dataset tables and their gates, run manifests and reports."""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import file_hash, write_json

#: Fixed values of the paged service: rows of a page, rows that one sort order reaches, and the orders.
PAGE, DEPTH, ORDERS = 100, 10_000, ("created_t", "last_modified_t")


def read_state(path: str | Path) -> dict:
    """What a collection has done: pages by sort order, and whether it is complete."""
    path = Path(path)
    return {"passes": {}, "done": False} | (json.loads(path.read_text()) if path.exists() else {})


def is_done(folder: str | Path, market: str) -> bool:
    """Whether a market's state says so; then its file must be there."""
    state, raw = read_state(Path(folder) / f"{market}.state"), Path(folder) / f"{market}.jsonl"
    if state["done"] and not raw.is_file():
        raise FileNotFoundError(f"{market} is marked complete without {raw.name}")
    return state["done"]


def collect_market(fetch: Callable[[dict], dict], market: str, folder: str | Path, page: int = PAGE, depth: int = DEPTH) -> bool:
    """Writes the market's pages as JSON lines, and the state after each, so that a next call goes on with
    the next page. A market near or beyond what one order reaches is read in a second order too, as far
    as the first misses it (rows that both have are left to the reader's dedup). An error of the source
    (`_error`) ends the call with what there is: False."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    raw, at = folder / f"{market}.jsonl", folder / f"{market}.state"
    state = read_state(at)
    head = fetch({"market": market, "page_size": 1, "page": 1, "sort_by": ORDERS[0]})
    if "_error" in head:
        return False
    total = int(head.get("count", 0))
    orders = ORDERS[:1] if total <= depth - page else ORDERS
    state |= {"count": total, "coverage": "complete" if len(orders) == 1 else "union_of_orders"}
    with raw.open("a", encoding="utf-8") as out:
        for order in orders:
            rows = min(total, depth) if order == orders[0] else total - min(total, depth) + 2 * page
            for n in range(state["passes"].get(order, 0) + 1, math.ceil(rows / page) + 1):
                got = fetch({"market": market, "page_size": page, "page": n, "sort_by": order})
                if "_error" in got:
                    write_json(state, at)
                    return False
                out.writelines(json.dumps(p, ensure_ascii=False) + "\n" for p in got.get("products", []))
                out.flush()
                state["passes"][order] = n
                write_json(state, at)
                if not got.get("products"):
                    break
    write_json(state | {"done": True}, at)
    return True


def collect(fetch: Callable[[dict], dict], markets: list[str], folder: str | Path, rounds: int = 3, pause: Callable[[], None] = lambda: None) -> list[str]:
    """Collects what is not done yet, in some rounds with a pause between; the markets still open."""
    for i in range(rounds):
        left = [m for m in markets if not is_done(folder, m)]
        if i and left:
            pause()
        for m in left:
            collect_market(fetch, m, folder)
    return [m for m in markets if not is_done(folder, m)]


def download(open_: Callable[[], Iterable[bytes]], path: str | Path) -> bool:
    """Chunks of bytes to a file that appears whole or not at all; a file that is there and not empty
    stays: False."""
    path = Path(path)
    if path.exists() and path.stat().st_size:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, aside = tempfile.mkstemp(prefix=".", suffix=".part", dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.writelines(open_())
        os.replace(aside, path)
    finally:
        if os.path.exists(aside):
            os.remove(aside)
    return True


def probe(rows: DataFrame, n: int = 100) -> tuple[int, DataFrame]:
    """How many rows there are, and the first n as the source gives them (a look, not a sample)."""
    return rows.count(), rows.limit(n)


def write_items(views: DataFrame, item: str, view: str, path: str) -> None:
    """JSON lines, one an item, with its views nested in their order; gathered by item, whose views are
    few."""
    rest = [c for c in views.columns if c not in (item, view)]
    nested = views.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(view, *rest))).alias("views"))
    nested.write.mode("overwrite").json(path)


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that `write_items` was given."""
    item = schema.split(" ", 1)[0]
    return spark.read.schema(schema).json(path).select(item, F.explode("views").alias("v")).select(item, "v.*")


def read_dataset(spark: SparkSession, folder: str, tables: list[str], expected: dict) -> tuple[dict[str, DataFrame], dict]:
    """The dataset's tables and its meta.json, if that holds all that is expected and no table is absent."""
    text = spark.read.text(f"{folder}/meta.json", wholetext=True).first()
    meta = json.loads(text[0]) if text else {}
    if bad := {k: meta.get(k) for k, v in expected.items() if meta.get(k) != v}:
        raise ValueError(f"dataset is another one: {bad}")
    if lacking := [t for t in tables if t not in meta.get("tables", {})]:
        raise ValueError(f"dataset lacks {lacking}")
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}, meta


def write_dataset(tables: dict[str, DataFrame], folder: str, meta: dict) -> dict:
    """Parquet of each table, then meta.json with their row counts, so that a reader finds a meta only
    beside whole tables. `folder` is local or a path that Spark knows; counts are read back."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    meta = meta | {"tables": {name: spark.read.parquet(f"{folder}/{name}.parquet").count() for name in tables}}
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta.json")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(target, True)
    out.write(json.dumps(meta, ensure_ascii=False, sort_keys=True).encode())
    out.close()
    return meta


def run_manifest(config: dict, reports: dict, artifacts: Iterable[str | Path], seconds: float, seeds: dict) -> dict:
    """What a completed run leaves: settings, seeds, hashes of its inputs, reports and time."""
    return {"status": "completed", "config": config, **seeds, "artifacts": {str(p): file_hash(p) for p in sorted(map(str, artifacts))}, "report": reports, "duration_seconds": round(seconds, 3)}


def markdown(rows: DataFrame, digits: int = 6) -> str:
    """A small result table (a row a comparison) as Markdown; numbers to so many digits, null as a dash."""
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [rows.columns, ["-"] * len(rows.columns), *[[show(v) for v in r] for r in rows.collect()]]
    return "\n".join("|" + "|".join(x) + "|" for x in lines)


def codes(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with `<column>_code`, the place of the value among the distinct ones in order; for columns
    of few values."""
    table = rows.select(column).where(F.col(column).isNotNull()).distinct()
    table = table.select(F.col(column).alias("__v"), (F.row_number().over(Window.orderBy(column)) - 1).alias(f"{column}_code"))
    return rows.join(F.broadcast(table), F.col(column) == F.col("__v"), "left").drop("__v")


def selected_metrics(target: str, found: dict[str, dict | None]) -> dict:
    """The metrics that the target names (overall, cross or cold); it never falls back to another."""
    if target not in ("overall", "cross", "cold"):
        raise ValueError(f"unknown selection target {target!r}")
    if found.get(target) is None:
        raise ValueError(f"no validation rows for the selection target {target}")
    return found[target]


def split_seed(config: dict) -> int:
    """The seed of the splits: its own, else the general one."""
    own = config.get("split_seed")
    return config["seed"] if own is None else own


def config_errors(config: dict, choices: dict[str, tuple], ranges: dict[str, tuple[float, float]]) -> list[str]:
    """Settings that are absent, none of their choices, or outside their range (ends count in)."""
    bad = [f"{k}: {config.get(k)!r} is none of {v}" for k, v in choices.items() if config.get(k) not in v]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    return bad + [f"{k}: {config.get(k)!r} is not from {a} to {b}" for k, (a, b) in ranges.items() if not (number(config.get(k)) and a <= config[k] <= b)]
