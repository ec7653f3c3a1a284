"""Units of work: a unit writes its tables under an epoch, a manifest entry commits them, and old units are folded into bucketed tables.

A manifest entry has the range of heights of every table of its unit, so a reader opens only the units in range. Folding moves the
rows of all units so far into tables by chain and bucket (``tables``), of which it rewrites the buckets that the units touch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import CODEC
from . import tables

#: What of a table's rows is the same row, of which the latest counts. Of other tables all rows count, or the last unit's alone.
KEYS = {"blocks": ["chain_id", "block_number"], "transactions": ["chain_id", "tx_hash", "block_number"]}
SNAPSHOTS = ("cursors", "islands", "releases")
ENTRY = "epoch long, name string, path string, rows long, lo long, hi long"


class Units:
    """The units that are committed at one moment. The driver holds an entry for each unit and table since the last fold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.base, self.carried, self.entries = spark, path, -1, [], []
        if tables.exists(spark, f"{path}/folded"):
            rows = spark.read.schema(f"{ENTRY}, base long").parquet(f"{path}/folded").collect()
            self.base = max((r["base"] for r in rows), default=-1)
            self.carried = [r for r in rows if r["base"] == self.base and r["name"]]
        if tables.exists(spark, f"{path}/manifest"):
            self.entries = spark.read.schema(ENTRY).parquet(f"{path}/manifest").filter(F.col("epoch") > self.base).collect()

    @property
    def latest(self) -> int:
        """The last committed epoch; -1 before the first."""
        return max((e["epoch"] for e in self.entries), default=self.base)

    def has(self, epoch: int) -> bool:
        return epoch <= self.base or any(e["epoch"] == epoch for e in self.entries)

    def _read(self, entries: list) -> DataFrame | None:
        return self.spark.read.parquet(*sorted(e["path"] for e in entries)) if entries else None

    def since_fold(self, name: str, lo: int | None = None, hi: int | None = None) -> DataFrame | None:
        """Rows of units that aren't folded; with lo and hi of the units whose range meets them."""
        own = [e for e in self.entries if e["name"] == name]
        met = own if lo is None else [e for e in own if e["rows"] and e["lo"] <= hi and e["hi"] >= lo]
        rows = self._read(met or own[-1:])
        return rows if rows is None or lo is None else rows.filter(F.col("block_number").between(lo, hi))

    def table(self, name: str, lo: int | None = None, hi: int | None = None) -> DataFrame | None:
        """All rows of a table, each with its epoch; None if no unit has it. lo and hi are for tables with a key."""
        folded = f"{self.path}/base/{name}"
        parts = [self.since_fold(name, lo, hi), self._read([e for e in self.carried if e["name"] == name and name not in KEYS])]
        if name in KEYS and self.base >= 0 and tables.exists(self.spark, folded):
            parts.append(tables.read_table(self.spark, folded, lo, hi))
        found = [p for p in parts if p is not None]
        out = found[0] if found else None
        for p in found[1:]:
            out = out.unionByName(p)
        return out

    def last(self, name: str) -> DataFrame | None:
        """A snapshot table as the last unit that has it left it."""
        found = max((e for e in [*self.carried, *self.entries] if e["name"] == name), key=lambda e: e["epoch"], default=None)
        return self._read([found]).drop("epoch") if found else None

    def rows(self, name: str) -> int:
        return sum(e["rows"] for e in [*self.carried, *self.entries] if e["name"] == name)


def _entries(spark: SparkSession, written: dict[str, tuple[int, str]]) -> list[tuple]:
    """A manifest entry for each table; one job counts them all."""
    sizes = None
    for name, (_, path) in written.items():
        df = spark.read.parquet(path)
        at = F.col("block_number").cast("long") if "block_number" in df.columns else F.lit(None).cast("long")
        part = df.agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("lo"), F.max(at).alias("hi")).withColumn("name", F.lit(name))
        sizes = part if sizes is None else sizes.unionByName(part)
    return [(written[r["name"]][0], r["name"], written[r["name"]][1], r["rows"], r["lo"], r["hi"]) for r in sizes.collect()] if written else []


def write_unit(blocks: DataFrame, txs: DataFrame, cursors: DataFrame, path: str, epoch: int, **others: DataFrame) -> None:
    """Write a unit's tables; the manifest entry comes last, so readers see all of the unit or nothing.

    Every attempt writes folders of its own. An epoch that is written again replaces what it wrote before.
    """
    spark, frames = cursors.sparkSession, {"blocks": blocks, "transactions": txs, "cursors": cursors, **others}
    written = {name: (epoch, f"{path}/data/{name}/{epoch}-{uuid.uuid4().hex}") for name in frames}

    def write(name: str) -> None:
        frames[name].withColumn("epoch", F.lit(epoch).cast("long")).write.option("compression", CODEC).parquet(written[name][1])

    with ThreadPoolExecutor(4) as pool:  # several small jobs at a time
        list(pool.map(write, frames))
    spark.createDataFrame(_entries(spark, written), ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/unit={epoch}")


def read_units(spark: SparkSession, path: str, name: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """A table over all committed units, however many."""
    found = Units(spark, path).table(name, lo, hi)
    if found is None:
        raise ValueError(f"no unit in {path} has {name}")
    return found


def current(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows that units wrote for the same key the latest, without the epoch."""
    return latest_rows(rows, key).drop("epoch")


def latest_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows that units wrote for the same key the latest."""
    columns = [c for c in rows.columns if c not in (*key, "epoch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "epoch").alias("_row"), F.max("epoch").alias("epoch"))
    return last.select(*key, *(F.col(f"_row.{c}").alias(c) for c in columns), "epoch").select(*rows.columns)


def fold(spark: SparkSession, path: str, keys: dict[str, list[str]] | None = None, kept: dict[str, Callable[[DataFrame], DataFrame]] | None = None, width: int = tables.WIDTH) -> int:
    """Fold all units so far; the epoch up to which they are. keys: of tables whose key isn't that in KEYS; kept: what of a table's
    rows is still wanted.

    Tables with a key go into their buckets, snapshots stay as the last unit has them, and rows of other tables are gathered in one
    folder for each fold. A fold that is broken off changes nothing for readers, and the next does the same again. Files of units
    are removed by the fold after the one that folded them, so readers that began before a fold are not disturbed.
    """
    units = Units(spark, path)
    upto, before = units.latest, units.base
    if upto == before:
        return upto
    written, carried = {}, []
    for name in sorted({e["name"] for e in [*units.entries, *units.carried]}):
        new = units.since_fold(name)
        if name in KEYS and new is not None:
            at, key = f"{path}/base/{name}", (keys or {}).get(name, KEYS[name])
            if not tables.exists(spark, at):
                tables.write_table(latest_rows(new, key), at, width)
            else:
                tables.merge_into(spark, at, tables.parts(new, width), lambda old, new=new, key=key: latest_rows(old.unionByName(new), key), width)
        elif name in SNAPSHOTS:
            e = max((e for e in [*units.carried, *units.entries] if e["name"] == name), key=lambda e: e["epoch"])
            carried.append(tuple(e)[:6])
        elif name in (kept or {}):
            at = f"{path}/data/{name}/fold-{upto}-{uuid.uuid4().hex}"
            kept[name](units.table(name)).write.option("compression", CODEC).parquet(at)
            written[name] = (upto, at)
        elif name not in KEYS:
            carried += [tuple(e)[:6] for e in units.carried if e["name"] == name]
            if new is not None and any(e["rows"] for e in units.entries if e["name"] == name):
                at = f"{path}/data/{name}/fold-{upto}-{uuid.uuid4().hex}"
                new.write.option("compression", CODEC).parquet(at)
                written[name] = (upto, at)
    rows = [*carried, *_entries(spark, written), (upto, "", "", 0, None, None)]
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{path}/folded/base={upto}")
    _sweep(spark, path, before, {r[2] for r in rows})
    return upto


def _sweep(spark: SparkSession, path: str, upto: int, kept: set[str]) -> None:
    """Remove the files of units up to an epoch that have been folded, but for those that are still read."""
    if upto < 0 or not tables.exists(spark, f"{path}/manifest"):
        return
    for e in spark.read.schema(ENTRY).parquet(f"{path}/manifest").filter(F.col("epoch") <= upto).collect():
        if e["path"] not in kept:
            tables.delete(spark, e["path"])
        tables.delete(spark, f"{path}/manifest/unit={e['epoch']}")


def write_events(events: DataFrame, path: str, epoch: int) -> None:
    """Events of one batch, single, many or reverted ones alike; a repeated epoch overwrites itself."""
    events.write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/epoch={epoch}")
