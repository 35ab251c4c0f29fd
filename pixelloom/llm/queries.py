"""Named queries of the subpackage's operators, each over its whole tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bpe, components, consensus, history, hnsw, mixing, subjects
from pixelloom.plans.tables import table

#: Two picture hashes are near if at most so many of their bits differ.
NEAR_BITS = 5


def counting_dhash(rows: DataFrame) -> DataFrame:
    """Rows whose dhash counts: neither NULL nor 0, the hash of a flat picture."""
    return rows.filter(F.col("dhash").isNotNull() & (F.col("dhash") != 0))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The members that hold the surviving size, dimensions and path of each duplicate group."""
    return consensus.surviving_fields(table(spark, folder, "files"), table(spark, folder, "hashes"))


def p2_consensus_path(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, path, distance, votes): of each duplicate group the path closest to the consensus of
    the members' aligned path tokens."""
    m = consensus.duplicate_members(table(spark, folder, "files"), table(spark, folder, "hashes"))
    best = consensus.consensus_of_tokens(m.select("group", F.col("path").alias("value")), consensus.path_tokens(F.col("value")))
    return best.select(F.col("group").alias("group_id"), F.col("value").alias("path"), "distance", "votes")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, group_id): files linked by near dhashes, directly or through others."""
    rows = counting_dhash(table(spark, folder, "hashes").select("file_id", "dhash"))
    return components.near_groups(rows, "dhash", "file_id", NEAR_BITS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(file_a, file_b): pairs of files of which one is among the three most similar of the other."""
    rows = counting_dhash(table(spark, folder, "hashes").select("file_id", "dhash"))
    pairs = hnsw.similar_files(rows, "dhash", "file_id", NEAR_BITS)
    return pairs.select(F.col("a").alias("file_a"), F.col("b").alias("file_b"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_no, file_id): incoming rows that bring nothing new."""
    return history.already_known(table(spark, folder, "hashes").select("blake3", "dhash"), table(spark, folder, "incoming_hashes"), NEAR_BITS)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    return bpe.encode_texts(table(spark, folder, "documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the largest mix at the target weights."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The actual share of each target's source in the mix."""
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the sources at the temperature that has the entropy of the target weights."""
    return mixing.tempered_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, subject): the subjects that at least three of a document's sentences are about."""
    return subjects.subject_areas(*(table(spark, folder, t) for t in ("documents", "doc_labels", "subjects"))).select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, docs, sentences): the corpus by subject."""
    found = subjects.subject_areas(*(table(spark, folder, t) for t in ("documents", "doc_labels", "subjects")))
    return found.groupBy("subject").agg(F.count("*").alias("docs"), F.sum("n_sentences").alias("sentences"))


QUERIES = {q.__name__: q for q in (p2_found, p2_consensus_path, p4_found, p5_found, p6_found, p7_ids, p8_mix, p8_shares, p8_temperature, p9_found, p9_composition)}

_NEAR = """d AS (SELECT file_id, dhash FROM hashes WHERE dhash IS NOT NULL AND dhash <> 0 AND file_id IS NOT NULL),
u AS (SELECT dhash, min(file_id) AS rep, count(*) AS n FROM d GROUP BY dhash),
e AS (SELECT a.rep AS x, b.rep AS y, a.dhash AS dx, b.dhash AS dy, bit_count(xor(a.dhash, b.dhash)) AS dist FROM u a JOIN u b ON a.dhash <> b.dhash AND bit_count(xor(a.dhash, b.dhash)) <= 5)"""

ORACLES = {
    "p2_found": """
WITH h AS (SELECT file_id, blake3 FROM hashes WHERE octet_length(blake3) = 32 AND blake3 <> from_hex(repeat('00', 32))),
g AS (SELECT blake3, min(file_id) AS group_id FROM h GROUP BY blake3 HAVING count(*) > 1),
m AS (SELECT group_id, f.id, f.size, f.width, f.height, f.path FROM h JOIN g USING (blake3) JOIN files f ON f.id = h.file_id),
s AS (SELECT group_id, size, count(*) AS n, min(id) AS id FROM m WHERE size > 0 GROUP BY group_id, size),
s1 AS (SELECT group_id, id FROM s QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, size DESC) = 1),
t AS (SELECT group_id, width, height, count(*) AS n, min(id) AS id FROM m WHERE width BETWEEN 1 AND 60000 AND height BETWEEN 1 AND 60000 GROUP BY group_id, width, height),
t1 AS (SELECT group_id, id FROM t QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, width * height DESC, width DESC) = 1),
p1 AS (SELECT group_id, id FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY length(path), encode(path)) = 1)
SELECT g.group_id, coalesce(s1.id, 0) AS size_id, coalesce(t1.id, 0) AS dims_id, p1.id AS path_id
FROM g LEFT JOIN s1 USING (group_id) LEFT JOIN t1 USING (group_id) LEFT JOIN p1 USING (group_id)
""",
    "p4_found": f"""
WITH RECURSIVE {_NEAR},
r AS (SELECT rep AS node, rep AS root FROM u UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node AND e.y > r.root),
l AS (SELECT node, min(root) AS group_id FROM r GROUP BY node),
s AS (SELECT group_id, sum(n) AS members FROM l JOIN u ON u.rep = l.node GROUP BY group_id)
SELECT d.file_id, l.group_id FROM d JOIN u USING (dhash) JOIN l ON l.node = u.rep JOIN s USING (group_id) WHERE members > 1
""",
    "p5_found": f"""
WITH {_NEAR},
c AS (SELECT a.file_id AS x, b.file_id AS y, 0 AS dist FROM d a JOIN d b ON a.dhash = b.dhash AND a.file_id <> b.file_id
      UNION ALL SELECT a.file_id, b.file_id, e.dist FROM e JOIN d a ON a.dhash = e.dx JOIN d b ON b.dhash = e.dy),
k AS (SELECT x, y FROM c QUALIFY row_number() OVER (PARTITION BY x ORDER BY dist, y) <= 3)
SELECT DISTINCT least(x, y) AS file_a, greatest(x, y) AS file_b FROM k
""",
}
