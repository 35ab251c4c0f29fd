"""A segment index for near-duplicate search by bounded edit distance (problem 6).

An indexed string is cut into a fixed number of segments, stored by length and position.  A string
at most tau edits away must hold one of tau + 1 segments unchanged, at a place that the edits left
and right of it bound; so a probe looks up only the selected substrings of its own, and what it
meets is verified by a distance computation that stops at tau.  New strings are appended as further
segments; what is stored is never read as a whole or written again.

:class:`CodeIndex` is the index of strings over {0, 1} of length 64, which is what picture hashes
are, where an edit is a flipped bit: all lengths are equal and no place can move, so the selected
substrings are the segments at the same positions, and segments and strings are machine words.
With many codes a segment of a few bits selects little; the index then takes more segments and asks
for several of them at once.  :class:`StringIndex` is the index of strings of any length.
"""

from __future__ import annotations

import json
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import hamming
from pixelloom.session import Staging, fan_out

#: Stored segments in a bucket that the number of buckets aims at, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 400_000, 4_096
#: Cells asked for up to which the stored ones are filtered by a broadcast of them: some 3 MB.
BROADCAST_CELLS = 200_000


def _place(spark: SparkSession, path: str) -> tuple:
    """A path of the shared file system, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, folder: str) -> None:
    at, fs = _place(spark, folder)
    fs.mkdirs(at)


class CodeIndex:
    """Segments of 64-bit codes stored in a shared folder, in buckets of cells.

    ``size`` is the number of codes the index is made for; the number of segments and of buckets
    follow from it and hold for its life.  A probe reads only the buckets of its own cells, so a batch
    of a given size reads the smaller a share of the index the larger that is."""

    def __init__(self, spark: SparkSession, folder: str, tau: int, size: int):
        agree = hamming.scheme(max(size, 1), tau)
        self.spark, self.folder, self.tau, self.agree, self.size = spark, folder, tau, agree, size
        self.keys = comb(tau + agree, agree)
        self.buckets = int(max(16, min(MAX_BUCKETS, -(-size * self.keys // BUCKET_ROWS))))

    @classmethod
    def create(cls, spark: SparkSession, folder: str, tau: int, size: int) -> CodeIndex:
        """A new, empty index in a folder."""
        out = cls(spark, folder, tau, size)
        make_folder(spark, f"{folder}/codes")
        at, fs = _place(spark, f"{folder}/made.json")
        stream = fs.create(at, False)
        stream.write(bytearray(json.dumps({"tau": tau, "size": size}), "utf-8"))
        stream.close()
        return out

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CodeIndex:
        """The index stored in a folder."""
        made = json.loads(spark.read.text(f"{folder}/made.json").first()[0])
        return cls(spark, folder, made["tau"], made["size"])

    def _keyed(self, codes: DataFrame) -> DataFrame:
        c = hamming.keyed(codes.select("code").filter("code is not null").distinct(), self.tau, self.agree)
        return c.select(F.pmod("cell", F.lit(self.buckets)).cast("int").alias("bucket"), "cell", "code")

    def _store(self, codes: DataFrame) -> None:
        tasks = max(1, min(self.buckets, fan_out(self.spark, self.size * self.keys, BUCKET_ROWS)))
        rows = self._keyed(codes).repartition(tasks, "bucket").sortWithinPartitions("bucket", "cell")
        rows.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/codes")

    def append(self, codes: DataFrame) -> None:
        """Stores the segments of codes (code bigint) as further files; nothing stored is read or written
        again.  Codes stored before may come again."""
        self._store(codes)

    def stored(self, buckets: list[int]) -> DataFrame:
        """(cell, code) of some buckets; the files of the others aren't opened."""
        return self.spark.read.schema("cell bigint, code bigint, bucket int").parquet(f"{self.folder}/codes").filter(F.col("bucket").isin(buckets)).select("cell", "code")

    def known(self, codes: DataFrame) -> DataFrame:
        """(code) of the probes (code bigint) that have a stored code at most tau bits away."""
        own = self._keyed(codes)
        asked = own.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # at most MAX_BUCKETS rows
        if not asked:
            return self.spark.createDataFrame([], "code bigint")
        stored = self.stored([r["bucket"] for r in asked])
        if sum(r["n"] for r in asked) <= BROADCAST_CELLS:
            stored = stored.join(F.broadcast(own.select("cell").distinct()), "cell", "left_semi")
        every = own.select("cell", "code", F.lit(True).alias("probe")).unionByName(stored.withColumn("probe", F.lit(False)))
        return known_codes(every, self.tau, hamming.tasks_for(self.spark, self.size, self.tau))


def known_codes(keyed: DataFrame, tau: int, tasks: int) -> DataFrame:
    """(code) of the probes among keyed codes (cell, code, probe) that have another code, which is no
    probe, at most tau bits away."""
    rows = keyed.select(F.col("code").alias("id"), "code", "cell", "probe")
    return hamming.over_cells(rows, tau, "code bigint", hamming.known_in_cell, tasks).distinct()


class StringIndex:
    """Stored segments of strings, for edit distance (insertions, deletions, substitutions)."""

    def __init__(self, area: Staging, tau: int):
        self.area, self.tau = area, tau
        self.parts: list[DataFrame] = []

    def _bounds(self, length: Column, part: Column) -> tuple[Column, Column]:
        """Start (from 1) and length of a segment: the first ones are the shorter by a character."""
        n = self.tau + 1
        base, longer = F.floor(length / n), F.pmod(length, F.lit(n))
        short = F.lit(n) - longer
        start = part * base + F.greatest(F.lit(0), part - short) + 1
        return start.cast("int"), (base + F.when(part >= short, 1).otherwise(0)).cast("int")

    def append(self, strings: DataFrame) -> None:
        """Stores (id, text).  NULL texts are left out.  A text of at most tau characters, which has
        no whole segments, is stored by its length alone."""
        s = strings.select("id", "text").filter("text is not null").withColumn("length", F.length("text"))
        cut = F.transform(F.sequence(F.lit(0), F.lit(self.tau)), lambda p: F.struct(p.alias("part"), F.substring(F.col("text"), *self._bounds(F.col("length"), p)).alias("segment")))
        whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit("").alias("segment")))
        rows = s.withColumn("_s", F.explode(F.when(F.col("length") > self.tau, cut).otherwise(whole)))
        self.parts.append(self.area.write(rows.select("length", "_s.part", "_s.segment", F.col("id").alias("stored_id"), F.col("text").alias("stored"))))

    def probe(self, strings: DataFrame) -> DataFrame:
        """(id, stored_id, distance) of every stored text at most tau edits from a text (id, text)."""
        tau = self.tau
        s = strings.select("id", "text").filter("text is not null").withColumn("own", F.length("text"))

        def places(length: Column, part: Column) -> Column:
            # Selected by both ends: with i edits left of a segment it moves by at most i, and the
            # edits to its right bound its move relative to the end.
            start, size = self._bounds(length, part)
            shift = F.col("own") - length
            low = F.greatest(start - part, start + shift - (tau - part), F.lit(1))
            high = F.least(start + part, start + shift + (tau - part), F.col("own") - size + 1)
            at = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda x: F.struct(length.alias("length"), part.alias("part"), F.substring(F.col("text"), x, size).alias("segment")))

        lengths = F.sequence(F.greatest(F.col("own") - tau, F.lit(tau + 1)), F.greatest(F.col("own") + tau, F.lit(tau + 1)))
        probes = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tau)), lambda p: places(n, p)))))
        tiny = F.transform(F.sequence(F.greatest(F.col("own") - tau, F.lit(0)), F.least(F.col("own") + tau, F.lit(tau))), lambda n: F.struct(n.alias("length"), F.lit(-1).alias("part"), F.lit("").alias("segment")))
        every = F.array_distinct(F.concat(probes, F.when(F.col("own") <= 2 * tau, tiny).otherwise(F.array().cast("array<struct<length:int,part:int,segment:string>>"))))
        rows = s.withColumn("_s", F.explode(every)).select("id", "text", "_s.*")
        stored = self.parts[0]
        for p in self.parts[1:]:
            stored = stored.unionByName(p)
        met = rows.join(stored, ["length", "part", "segment"]).select("id", "stored_id", F.levenshtein("text", "stored", tau).alias("distance"))
        return met.filter("distance >= 0").distinct()
