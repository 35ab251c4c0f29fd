"""New batches checked against all that was accepted before (problem 6).

The history lives in a stored index (:class:`HistoryIndex`): segments of its picture hashes
(:class:`segments.CodeIndex`) and its content hashes, both in buckets on shared storage.  A batch
reads the buckets of its own values, and what it brings is appended; the history itself isn't read
again.

Rows near a stored hash, or equal to a known content hash, are cases at once.  What remains can only
be a case through a row of the batches themselves that came earlier and was accepted.  Such rows are
linked through their hash values, never as pairs, and each component of links is settled in order by
one task.  A component too large for that is settled from its front: its first rows by a task, the
others against what these accepted, which breaks it up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.skew import join_hot, lookup
from pixelloom.llm.consensus import counting_hash
from pixelloom.llm.segments import MAX_BUCKETS, CodeIndex, known_codes, make_folder
from pixelloom.operators import hamming
from pixelloom.operators.graphs import min_labels
from pixelloom.session import Staging, fan_out, seen_in, staging

#: Rows of a component that one task settles in order.
WALK = 100_000
#: Content hashes in a bucket that the number of buckets aims at.
BUCKET_HASHES = 1_000_000


def _hashes(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows with blake3 and dhash NULL where they don't count."""
    return rows.select(*keep, F.when(counting_hash(F.col("blake3")), F.col("blake3")).alias("blake3"), F.when(F.col("dhash") != 0, F.col("dhash")).alias("dhash"))


def _marked(rows: DataFrame, keys: DataFrame, key: str, flag: str, total: int) -> DataFrame:
    """Rows with ``flag``: whether their key is among ``keys``, false for a NULL key.  NULLs are kept
    apart from the join, and so is a hot key."""
    with_key, without = rows.filter(F.col(key).isNotNull()), rows.filter(F.col(key).isNull())
    joined = lookup(with_key, keys.select(key, F.lit(True).alias(flag)), key, total, how="left")
    return joined.unionByName(without.withColumn(flag, F.lit(False))).withColumn(flag, F.coalesce(flag, F.lit(False)))


class HistoryIndex:
    """What was accepted so far: content hashes, and picture hashes with their near ones."""

    def __init__(self, spark: SparkSession, folder: str, codes: CodeIndex):
        self.spark, self.folder, self.codes = spark, folder, codes
        self.buckets = int(max(16, min(MAX_BUCKETS, -(-codes.size // BUCKET_HASHES))))

    @classmethod
    def create(cls, spark: SparkSession, folder: str, tau: int, size: int) -> HistoryIndex:
        """A new, empty index for about ``size`` rows in a folder that all executors share."""
        out = cls(spark, folder, CodeIndex.create(spark, folder, tau, size))
        make_folder(spark, f"{folder}/contents")
        return out

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> HistoryIndex:
        return cls(spark, folder, CodeIndex.open(spark, folder))

    def _bucketed(self, contents: DataFrame) -> DataFrame:
        c = contents.select("blake3").filter("blake3 is not null").distinct()
        return c.select(F.pmod(F.xxhash64("blake3"), F.lit(self.buckets)).cast("int").alias("bucket"), "blake3")

    def _store(self, contents: DataFrame) -> None:
        rows = self._bucketed(contents).repartition(min(self.buckets, fan_out(self.spark, self.codes.size, BUCKET_HASHES)), "bucket")
        rows.sortWithinPartitions("bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/contents")

    def append(self, accepted: DataFrame) -> None:
        """Adds accepted rows (blake3, dhash); hashes that don't count are left out."""
        h = _hashes(accepted)
        self._store(h)
        self.codes.append(h.select(F.col("dhash").alias("code")))

    def known_contents(self, contents: DataFrame) -> DataFrame:
        """(blake3) of those stored; only their buckets are read."""
        own = self._bucketed(contents)
        asked = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most MAX_BUCKETS
        stored = self.spark.read.schema("blake3 binary, bucket int").parquet(f"{self.folder}/contents").filter(F.col("bucket").isin(asked or [-1]))
        return own.select("blake3").join(stored.select("blake3"), "blake3", "left_semi")

    def check(self, incoming: DataFrame) -> DataFrame:
        """(batch_no, file_id) of the incoming rows that bring nothing new; what they bring is appended.

        ``incoming``: batch_no, file_id, blake3, dhash; distinct rows are taken by batch_no, then file_id
        (NULLs first; rows that agree on both by their hashes).  A row is a case if its counting blake3
        equals an accepted one, or its counting dhash is at most tau bits from an accepted one; every
        other row is accepted at once.  A row without a counting hash is never a case.  Empty tables
        give the obvious results."""
        with staging(self.spark, "batch") as area:
            rows = _hashes(incoming, "batch_no", "file_id").distinct()
            # Sorted once over all partitions: the identifier then rises with the order of the rows.
            rows = area.write(rows.sort("batch_no", "file_id", "blake3", "dhash").withColumn("pos", F.monotonically_increasing_id()))
            hashed = rows.filter("blake3 is not null or dhash is not null")
            # The first row of a pair of hashes stands for all: whatever becomes of it, the others are cases.
            heads = area.write(hashed.groupBy("blake3", "dhash").agg(F.min("pos").alias("pos")))
            total = seen_in(heads)
            b = area.write(self.known_contents(heads))
            d = area.write(self.codes.known(heads.select(F.col("dhash").alias("code"))).withColumnRenamed("code", "dhash"))
            flagged = area.write(_marked(_marked(heads, b, "blake3", "b", total), d, "dhash", "d", total))
            area.drop(b, d)
            settled = _settle(area, flagged.filter("not b and not d").select("pos", "blake3", "dhash"), self.codes.tau)
            first = area.write(flagged.filter("b or d").select("pos").unionByName(settled))
            self.append(heads.join(first, "pos", "left_anti"))
            cases = rows.join(first, "pos", "left_semi").unionByName(hashed.join(heads.select("pos"), "pos", "left_anti"))
            return cases.select("batch_no", "file_id").distinct()


def already_known(history: DataFrame, incoming: DataFrame, tau: int) -> DataFrame:
    """:meth:`HistoryIndex.check` of all batches at once against an index made of ``history`` (blake3,
    dhash), which lasts as long as the application."""
    with staging(incoming.sparkSession, "history") as area:
        index = HistoryIndex.create(incoming.sparkSession, f"{area.root}/index", tau, history.count() + incoming.count())
        index.append(history)
        return index.check(incoming)


def _components(area: Staging, rows: DataFrame, tau: int) -> DataFrame:
    """(pos, label) of the rows (pos, blake3, dhash) that share a hash with another or have a near one;
    label is the first pos among all that are linked directly or through others."""
    edges = None
    for key in ("blake3", "dhash"):
        own = rows.filter(F.col(key).isNotNull()).select("pos", key)
        least = area.write(own.groupBy(key).agg(F.min("pos").alias("a"), F.count("*").alias("n")), total=F.sum("n"))
        same = join_hot(own, least.filter("n > 1"), key, "n", seen_in(least, "total")).select("a", F.col("pos").alias("b"))
        edges = same if edges is None else edges.unionByName(same)
        if key == "dhash":
            edges = edges.unionByName(hamming.near_forest(least.select(F.col("a").alias("id"), F.col("dhash").alias("code")), tau, seen_in(least)))
    return min_labels(area, edges).select(F.col("node").alias("pos"), "label")


def settle_in_order(contents: list[bytes | None], codes: list[int | None], tau: int) -> list[bool]:
    """Which rows, in order, are cases: those whose content hash equals that of an accepted row before
    them, or whose code is at most tau bits from an accepted one's."""
    known: set[bytes] = set()
    accepted = np.empty(64, np.uint64)
    size = 0
    far: dict[int, int] = {}  # the accepted codes up to here are not near; -1 if one is
    out = []
    for content, code in zip(contents, codes):
        case = content is not None and content in known
        if not case and code is not None:
            done = far.get(code, 0)
            if done >= 0:
                near = done < size and bool((np.bitwise_count(accepted[done:size] ^ np.uint64(code)) <= tau).any())
                far[code] = done = -1 if near else size
            case = done < 0
        if not case:
            if content is not None:
                known.add(content)
            if code is not None:
                if size == len(accepted):
                    accepted = np.concatenate([accepted, np.empty(size, np.uint64)])
                accepted[size] = code
                size += 1
        out.append(case)
    return out


def _walk(rows: DataFrame, tau: int, tasks: int) -> DataFrame:
    """(pos, case) of rows (label, pos, blake3, dhash), each label settled in order by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        label, pos = t.column(0).to_numpy(), t.column(1).to_numpy()
        order = np.lexsort((pos, label))
        t = t.take(pa.array(order))
        label, pos = label[order], pos[order]
        contents, codes = t.column(2).to_pylist(), [c if c is None else c & (2**64 - 1) for c in t.column(3).to_pylist()]
        case: list[bool] = []
        ends = np.flatnonzero(np.r_[np.diff(label) != 0, True]) + 1
        for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            case += settle_in_order(contents[s:e], codes[s:e], tau)
        yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(case)], names=["pos", "case"])

    return rows.select("label", "pos", "blake3", "dhash").repartition(tasks, "label").mapInArrow(run, "pos bigint, case boolean")


def _settle(area: Staging, rows: DataFrame, tau: int) -> DataFrame:
    """(pos) of the cases among rows (pos, blake3, dhash) that the history doesn't know, of distinct
    pairs of hashes."""
    spark = rows.sparkSession
    cases = spark.createDataFrame([], "pos bigint")
    while True:
        linked = area.write(rows.join(_components(area, rows, tau), "pos"))
        sizes = area.write(linked.groupBy("label").agg(F.count("*").alias("n")), most=F.max("n"))
        tasks = fan_out(spark, seen_in(linked), 2 * WALK)
        if seen_in(sizes, "most") <= WALK:
            return cases.unionByName(_walk(linked, tau, tasks).filter("case").select("pos"))
        # Of a larger component the first rows, about WALK of them.  There are few such components.
        large = sizes.filter(F.col("n") > WALK)
        upto = linked.join(F.broadcast(large), "label").groupBy("label", "n").agg(F.percentile_approx("pos", F.lit([i / 1000 for i in range(1, 1001)]), 10_000).alias("_q"))
        upto = area.write(upto.select("label", F.get("_q", F.greatest(F.lit(0), F.floor(F.lit(1000 * WALK) / F.col("n")).cast("int") - 1)).alias("_last")))
        parted = area.write(linked.join(F.broadcast(upto), "label", "left").withColumn("now", F.coalesce(F.col("pos") <= F.col("_last"), F.lit(True))).drop("_last"))
        walked = area.write(_walk(parted.filter("now"), tau, tasks))
        cases = cases.unionByName(walked.filter("case").select("pos"))
        # The others against what these accepted: cases through it are settled, the rest goes on.
        new = parted.filter("now").join(walked.filter("not case"), "pos")
        rest = area.write(parted.filter("not now").select("pos", "blake3", "dhash"))
        total = seen_in(rest)
        codes = rest.select(F.col("dhash").alias("code"), F.lit(True).alias("probe")).unionByName(new.select(F.col("dhash").alias("code"), F.lit(False).alias("probe")))
        agree = hamming.scheme(seen_in(linked), tau)
        keyed = hamming.keyed(codes.filter("code is not null").distinct(), tau, agree)
        d = area.write(known_codes(keyed, tau, hamming.tasks_for(spark, seen_in(linked), tau)).withColumnRenamed("code", "dhash"))
        b = new.select("blake3").filter("blake3 is not null").distinct()
        marked = area.write(_marked(_marked(rest, b, "blake3", "b", total), d, "dhash", "d", total))
        cases = cases.unionByName(marked.filter("b or d").select("pos"))
        rows = marked.filter("not b and not d").select("pos", "blake3", "dhash")
        area.drop(linked, sizes)
