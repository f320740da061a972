"""Attribute-value rows into wide tables, by positional stitching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.terms import SIMPLE, clean_iri, where_any, with_value
from ..runtime import map_arrow

TYPES = {"integer": "decimal(38,0)", "decimal": "decimal(38,2)", "boolean": "boolean", "date": "date", "string": "string"}


def best_values(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """(s, p, kind, val): of every clean s and declared simple p the valid value asserted last, then of the greatest stmt_id.

    Null asserted_at counts as before all others. Rows with a null s, undeclared p or invalid value give nothing.
    """
    simple = predicates.where(F.col("value_type").isin(*SIMPLE)).select(F.col("pred_iri").alias("p"), F.col("value_type").alias("kind"))
    rows = triples.where("s is not null and o is not null").select(clean_iri("s").alias("s"), clean_iri("p").alias("p"), "o", "asserted_at", "stmt_id")
    rows = where_any(with_value(rows.join(simple, "p"), "kind", "o", "val"), "val")
    best = F.max(F.struct("asserted_at", "stmt_id", "val", "kind")).alias("b")
    return rows.groupBy("s", "p").agg(best).select("s", "p", F.col("b.kind").alias("kind"), F.col("b.val").alias("val"))


def _stitch(n: int):
    """Of partitions sorted by entity: (s, slot, val) rows to (ordinal, s, c0 .. cn-1), text still, a batch at a time.

    An entity's ordinal is its position in its partition; the caller adds the partition. Every column of a block is written at its
    positions alone, and the block's columns are put side by side; no row is looked up by key.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        ordinal = 0

        def assemble(t: pa.Table) -> pa.RecordBatch:
            nonlocal ordinal
            s = t.column("s").combine_chunks()
            ends = np.flatnonzero(np.append(pc.not_equal(s[1:], s[:-1]).to_numpy(zero_copy_only=False), True)) if len(s) > 1 else np.array([0])
            counts = np.diff(np.append(-1, ends))
            at = np.repeat(np.arange(len(ends)), counts)
            slot, val = t.column("slot").to_numpy(), t.column("val").combine_chunks()
            columns = [pa.array(np.arange(ordinal, ordinal + len(ends))), s.take(pa.array(ends))]
            for k in range(n):
                rows = np.flatnonzero(slot == k)
                where = np.full(len(ends), -1)
                where[at[rows]] = rows
                columns.append(val.take(pa.array(where, mask=where < 0)))
            ordinal += len(ends)
            return pa.RecordBatch.from_arrays(columns, names=["ordinal", "s", *(f"c{k}" for k in range(n))])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            last = held.column("s")[held.num_rows - 1]
            same = pc.equal(held.column("s"), last).to_numpy()
            cut_at = int(np.flatnonzero(same)[0])
            if cut_at:
                yield assemble(held.slice(0, cut_at))
                held = held.slice(cut_at)
        if held is not None and held.num_rows:
            yield assemble(held)

    return blocks


def widen(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """One row per entity: ordinal, s, and one typed column per declared predicate of a simple type, named by its IRI's last part.

    Global ordinals are ranges, one per partition (partition number times 2^33 plus position), so no pass over the data is needed to number
    the entities; they hold within one evaluation, so a table that is read twice should be written first. Clashing names are numbered (x, x_2). The columns come from the declared predicates, which must be few (they are columns);
    more than 10,000 raise ValueError. Entities without a valid value get no row; a column without values is null throughout. Numbers of more
    than 38 digits don't fit their columns: these stand in the map `overflow`, by the column's name, as text (null where there are none).
    """
    declared = predicates.where(F.col("value_type").isin(*SIMPLE)).select("pred_iri", "value_type").distinct().orderBy("pred_iri").limit(10_001).collect()
    if len(declared) > 10_000:
        raise ValueError("more than 10,000 attributes can't be columns")
    best = best_values(triples, predicates)
    slots = triples.sparkSession.createDataFrame([(r["pred_iri"], k) for k, r in enumerate(declared)], "p string, slot int")
    cells = best.join(F.broadcast(slots), "p").select("s", "slot", "val").repartition("s").sortWithinPartitions("s")
    text = map_arrow(cells, _stitch(len(declared)), "ordinal long, s string" + "".join(f", c{k} string" for k in range(len(declared))))
    names: dict[str, str] = {}
    for r in declared:
        name = base = r["pred_iri"].rstrip("/").rsplit("/", 1)[-1].rsplit("#", 1)[-1]
        n = 1
        while name.lower() in {"ordinal", "s", "overflow", *(x.lower() for x in names.values())}:
            n += 1
            name = f"{base}_{n}"
        names[r["pred_iri"]] = name
    typed = {k: F.col(f"c{k}").try_cast(TYPES[r["value_type"]]) for k, r in enumerate(declared)}
    numbers = [k for k, r in enumerate(declared) if r["value_type"] in ("integer", "decimal")]
    over = [F.struct(F.lit(names[declared[k]["pred_iri"]]).alias("key"), F.when(typed[k].isNull(), F.col(f"c{k}")).alias("value")) for k in numbers]
    too_long = F.lit(False)
    for k in numbers:
        too_long = too_long | (F.length(f"c{k}") > 36)
    overflow = F.when(F.coalesce(too_long, F.lit(False)), F.map_from_entries(F.filter(F.array(*over), lambda x: x["value"].isNotNull()))) if over else F.lit(None)
    wide = text.select(
        (F.spark_partition_id().cast("long") * F.lit(2**33) + F.col("ordinal")).alias("ordinal"),
        "s",
        *(typed[k].alias(names[r["pred_iri"]]) for k, r in enumerate(declared)),
        overflow.cast("map<string,string>").alias("overflow"),
    )
    wide._thistle_columns = [(r["pred_iri"], names[r["pred_iri"]], r["value_type"]) for r in declared]
    return wide


def narrow(wide: DataFrame) -> DataFrame:
    """The cells of a table made by widen() as (s, p, val_text)."""

    def text(name: str, kind: str) -> Column:
        if kind == "date":
            return F.date_format(name, "yyyy-MM-dd")
        short = F.col(f"`{name}`").cast("string")
        return F.coalesce(short, F.col("overflow")[name]) if kind in ("integer", "decimal") else short

    cells = [
        F.struct(F.lit(p).alias("p"), text(name, kind).alias("val_text"))
        for p, name, kind in wide._thistle_columns
    ]
    if not cells:
        return wide.select("s", F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("val_text")).limit(0)
    return wide.select("s", F.inline(F.array(*cells))).where("val_text is not null")
