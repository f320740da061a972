"""References to records that do not exist, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..runtime import cut, forget

#: Moments are microseconds; these stand for "since ever" and "for ever".
FIRST, LAST = -(2**62), 2**62
DAY = 86_400_000_000


def _period(at: Column, period_us: int) -> Column:
    return F.floor(at / F.lit(period_us)).cast("long")


def probe(refs: DataFrame, parents: DataFrame, period_us: int = DAY) -> DataFrame:
    """Marks every reference with whether a parent was valid at its moment.

    refs: key string, at long (microseconds; null: at no moment, so nothing is valid then), any further columns (row ids and the like;
    not named _kind, _delta, _open, _period, orphan). parents: key, from_us (null: since ever... never if both are null), to_us (null: for ever).
    Adds `orphan` boolean. References with a null key are orphans of nothing and come back with orphan = null. No row is lost or added.

    References and parent changes make one log per key. A running count of valid parents is taken inside each (key, period), and starts
    from a snapshot: the sum of the changes in all earlier periods. So a key with a third of all rows is worked on period by period, and
    only one number per key and period goes through the key's own ordering.
    """
    extra = [c for c in refs.columns if c not in ("key", "at")]
    real = parents.where(F.col("key").isNotNull() & F.col("from_us").isNotNull() & (F.col("to_us").isNull() | (F.col("to_us") > F.col("from_us"))))
    change = real.select("key", F.inline(F.array(F.struct(F.col("from_us").alias("at"), F.lit(1).alias("_delta")), F.struct(F.col("to_us").alias("at"), F.lit(-1).alias("_delta"))))).where("at is not null")
    change = change.groupBy("key", "at").agg(F.sum("_delta").alias("_delta")).withColumn("_period", _period(F.col("at"), period_us))
    usable = refs.where("key is not null and at is not null").withColumn("_period", _period(F.col("at"), period_us))
    rest = refs.where("key is null or at is null").withColumn("orphan", F.when(F.col("key").isNotNull(), F.lit(True)))

    net = change.groupBy("key", "_period").agg(F.sum("_delta").alias("_net"), F.lit(False).alias("_asked"))
    asked = usable.select("key", "_period").distinct().select("key", "_period", F.lit(0).cast("long").alias("_net"), F.lit(True).alias("_asked"))
    per = net.unionByName(asked).groupBy("key", "_period").agg(F.sum("_net").alias("_net"), F.max("_asked").alias("_asked"))
    before = W.partitionBy("key").orderBy("_period").rowsBetween(W.unboundedPreceding, -1)
    start = per.withColumn("_delta", F.coalesce(F.sum("_net").over(before), F.lit(0).cast("long"))).where("_asked and _delta <> 0")

    none = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in extra]
    log = (
        start.select("key", "_period", F.lit(FIRST).alias("at"), F.lit(0).alias("_kind"), "_delta", *none)
        .unionByName(change.select("key", "_period", "at", F.lit(0).alias("_kind"), "_delta", *none))
        .unionByName(usable.select("key", "_period", "at", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_delta"), *extra))
    )
    run = W.partitionBy("key", "_period").orderBy("at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    done = log.withColumn("_open", F.sum("_delta").over(run)).where("_kind = 1").withColumn("orphan", F.col("_open") <= 0)
    return done.select(*refs.columns, "orphan").unionByName(rest.select(*refs.columns, "orphan"))


class OrphanTracker:
    """Keyed pending-orphan state over batches of references and parent changes.

    The state grows by what a batch brings or changes, nothing is rewritten: the references seen, each with whether it was an orphan when it
    came; the changes of that since; the versions of the parents. advance() probes a batch's new references, and of the old ones only
    those whose key the batch's parents touch: an arriving parent resolves the orphans that waited for it, a deletion (a parent row with
    to_us) reopens references made after it. Every `compact` batches the lists of tables are merged. Feed each reference once, by an id
    unique in its tbl.
    """

    def __init__(self, spark: SparkSession, period_us: int = DAY, compact: int = 8):
        self.spark, self.period_us, self.compact, self.batch = spark, period_us, compact, 0
        self.seen: list[DataFrame] = []
        self.changes: list[DataFrame] = []
        self.parents: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def advance(self, refs: DataFrame, parents: DataFrame) -> DataFrame:
        """The orphans pending after a batch: id, tbl, key, at, on_us.

        refs: id, tbl, key, at, and optionally on_us (the moment they are reported under, at by default). parents: key, from_us, to_us, and
        optionally parent_id (a row replaces that of an earlier batch with the same id). Null keys are no references and no parents.
        """
        on = F.col("on_us" if "on_us" in refs.columns else "at").alias("on_us")
        new = cut(refs.where("key is not null").select("id", "tbl", "key", "at", on))
        come = self._parents(parents)
        if self.parents is not None:
            known = self.parents.where("parent_id is null").select("key", "from_us", F.coalesce("to_us", F.lit(LAST)).alias("_to"), F.lit(True).alias("_known")).distinct()
            come = come.withColumn("_to", F.when(F.col("parent_id").isNull(), F.coalesce("to_us", F.lit(LAST)))).join(known, ["key", "from_us", "_to"], "left").where("_known is null").drop("_to", "_known")
        come = cut(come)
        self.batch += 1
        none = F.lit(None).cast("boolean").alias("before")
        if self.parents is None:
            asked, self.parents = new.withColumn("before", none), come
            known = come
        else:
            touched = come.select("key").distinct()
            asked = new.withColumn("before", none).unionByName(self._status(touched))
            ids = come.where("parent_id is not null").select("parent_id").distinct()
            self.parents = self.parents.join(ids, "parent_id", "left_anti").unionByName(come)
            asked = cut(asked)
            known = self.parents.join(asked.select("key").distinct(), "key", "left_semi")
        found = cut(probe(asked, known, self.period_us).where("before is null or before <> orphan").withColumn("batch", F.lit(self.batch)))
        self.seen.append(found.where("before is null").drop("before", "batch"))
        if self.batch > 1:
            self.changes.append(found.where("before is not null").drop("before"))
        self.tables += [come, found]
        forget(new)
        if known is not come:
            forget(asked)
        if self.batch % self.compact == 0:
            self._merge()
        return self.pending

    @property
    def pending(self) -> DataFrame:
        columns = ["id", "tbl", "key", "at", "on_us"]
        came = self._all(self.seen).where("orphan")
        if not self.changes:
            return came.select(columns)
        last = self._last()
        return came.join(last.select("id", "tbl"), ["id", "tbl"], "left_anti").select(columns).unionByName(last.where("orphan").select(columns))

    def _all(self, tables: list[DataFrame]) -> DataFrame:
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        return every

    def _last(self) -> DataFrame:
        """The last change of each reference that ever changed."""
        return self._all(self.changes).groupBy("id", "tbl").agg(F.max_by(F.struct("key", "at", "on_us", "orphan"), "batch").alias("x")).select("id", "tbl", "x.*")

    def _status(self, touched: DataFrame) -> DataFrame:
        """The references to these keys, with whether they are orphans."""
        came = self._all(self.seen).join(touched, "key", "left_semi")
        if self.changes:
            came = came.join(self._last().select("id", "tbl", F.col("orphan").alias("now")), ["id", "tbl"], "left").withColumn("orphan", F.coalesce("now", "orphan"))
        return came.select("id", "tbl", "key", "at", "on_us", F.col("orphan").alias("before"))

    def _merge(self) -> None:
        seen, parents = cut(self._all(self.seen)), cut(self.parents)
        changes = cut(self._last().withColumn("batch", F.lit(self.batch))) if self.changes else None
        for t in self.tables:
            forget(t)
        self.seen, self.parents, self.changes = [seen], parents, [changes] if changes is not None else []
        self.tables = [seen, parents, *self.changes]

    @staticmethod
    def _parents(parents: DataFrame) -> DataFrame:
        has = "parent_id" in parents.columns
        return parents.where("key is not null").select("key", F.col("from_us").cast("long").alias("from_us"), F.col("to_us").cast("long").alias("to_us"), F.col("parent_id").cast("string") if has else F.lit(None).cast("string").alias("parent_id"))

    def snapshot(self) -> DataFrame:
        """Pending orphans per table and month they are reported under (null: no moment)."""
        month = F.date_format(F.timestamp_micros("on_us"), "yyyy-MM")
        return self.pending.groupBy("tbl", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("key").alias("missing_keys"))
