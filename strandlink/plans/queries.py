"""Registered queries over the driver's tables, and their SQL forms.

The tables hold no nucleotide sequences.  Each document's whole text is made one by keeping its letters a, c, g, t
and u, in order; its header is its source and length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlink.config import ClusterConfig
from strandlink.functions import qgram
from strandlink.functions import sql as functions
from strandlink.operators import candidates, cluster
from strandlink.plans.shipping import ship
from strandlink.plans.stages import materialize, new_path
from strandlink.sources import datasource, fasta, report


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.concat("source", F.lit("_"), F.col("n_chars").cast("string")).alias("header"), F.regexp_replace(F.lower("text"), "[^acgtu]+", "").alias("raw")
    )
    return fasta.from_table(docs, "doc_id", "raw", "header")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(sequences(spark, sf_dir), "sequences")


def seq_encode(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_no", fasta.encode(F.col("seq")).alias("codes"), "seq_len")


def seq_decode(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_no", fasta.decode(fasta.encode(F.col("seq"))).alias("seq"))


def fasta_round_trip(spark, sf_dir):
    path = new_path(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf_dir), path)
    return fasta.read_fasta(spark, path).select("seq_no", "header", "abundance", "seq", "seq_len")


def abundance_extract(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_no", "header", "abundance")


def abundance_missing(spark, sf_dir):
    return fasta.missing_abundance(sequences(spark, sf_dir))


def abundance_presorted(spark, sf_dir):
    return fasta.out_of_order(sequences(spark, sf_dir))


def abundance_order(spark, sf_dir):
    return fasta.sort_by_abundance(sequences(spark, sf_dir)).select("seq_no", "abundance")


def duplicate_headers(spark, sf_dir):
    return fasta.duplicate_headers(sequences(spark, sf_dir))


def db_info(spark, sf_dir):
    return fasta.db_info(sequences(spark, sf_dir))


def qgram_profile(spark, sf_dir):
    return qgram.profile_rows(sequences(spark, sf_dir))


def qgram_diff_pairs(spark, sf_dir):
    ship(spark)
    return candidates.profile_join(_written(spark, sf_dir), 1)


def bucket_map(spark, sf_dir):
    ship(spark)
    pairs = candidates.profile_join(_written(spark, sf_dir), 2)
    return pairs.select("src", "dst", "qgram_diff", qgram.bucket(F.col("qgram_diff"), 2).alias("level"))


def _edges(d: int):
    def run(spark, sf_dir):
        ship(spark)
        return cluster.edges(_written(spark, sf_dir), ClusterConfig(resolution=d))

    return run


def _clusters(d: int, then: Callable[[DataFrame], DataFrame] = lambda x: x):
    def run(spark, sf_dir):
        ship(spark)
        return then(cluster.clusters(_written(spark, sf_dir), ClusterConfig(resolution=d)))

    return run


def cluster_members_d1(spark, sf_dir):
    c = cluster.clusters(_written(spark, sf_dir), ClusterConfig())
    # members of one cluster as text, for reading; a cluster's rows stay rows everywhere else
    return cluster.cluster_sizes(c).join(c, "cluster_id").filter("size > 1").select("cluster_id", "size", "seq_no")


def search_stats_d1(spark, sf_dir):
    ship(spark)
    return cluster.search_stats(_written(spark, sf_dir), ClusterConfig())


def level_stats_d1(spark, sf_dir):
    ship(spark)
    return cluster.level_stats(_written(spark, sf_dir), ClusterConfig(), 2)


def profile_words(spark, sf_dir):
    """The profile as 16 words, by number: the same bits as ``qgram_profile``."""
    ship(spark)
    words = qgram.word_profiles(sequences(spark, sf_dir)).select("seq_no", F.posexplode(F.array(*qgram.WORDS)).alias("word", "bits"))
    return words.filter("bits <> 0")


def cluster_report_d1(spark, sf_dir):
    s = _written(spark, sf_dir)
    return report.report_lines(cluster.clusters(s, ClusterConfig()), s).select("value")


def fasta_source(spark, sf_dir):
    """Written and read by the data source; tasks read a few records each, cut anywhere."""
    ship(spark)
    datasource.register(spark)
    path = new_path(spark, "fasta-source")
    sequences(spark, sf_dir).repartitionByRange(8, "seq_no").sortWithinPartitions("seq_no").write.format("fasta").mode("append").save(path)
    return datasource.numbered(spark.read.format("fasta").option("splitBytes", 1 << 20).load(path))


def validation_counts(spark, sf_dir):
    return fasta.validation_counts(sequences(spark, sf_dir))


def pivot_pairs_d2(spark, sf_dir):
    ship(spark)
    return candidates.pivot_join(_written(spark, sf_dir), 2)


def clusters_d1_extended(spark, sf_dir):
    """Clusters of two thirds of the rows, then those of all by looking at the other third."""
    ship(spark)
    s = _written(spark, sf_dir)
    old, new = s.filter("seq_no % 3 <> 1"), s.filter("seq_no % 3 = 1")
    return cluster.extend_clusters(materialize(cluster.clusters(old), "stored"), old, new)


def rows_by_level_d1(spark, sf_dir):
    s = _written(spark, sf_dir)
    return cluster.rows_by_level(s, cluster.edges(s))


def edges_d1_by_sql(spark, sf_dir):
    """The blocked join in SQL alone, with the registered functions."""
    ship(spark)
    functions.register(spark)
    rows = _written(spark, sf_dir)
    rows.createOrReplaceTempView("sequences_to_join")
    # classes and their keys are written, else the table function runs once for each side of the join
    classes = materialize(spark.sql("SELECT seq, min(seq_no) AS rep, count(*) AS copies FROM sequences_to_join GROUP BY seq"), "classes")
    classes.createOrReplaceTempView("classes_to_join")
    # a key holds half of a sequence: its hash meets, and the edit distance tells chance from likeness
    keys = spark.sql("SELECT rep, xxhash64(n.key) AS key, n.filed FROM classes_to_join c, LATERAL neighbours(c.seq, 1) n")
    materialize(keys, "keys").createOrReplaceTempView("keys_to_join")
    near = spark.sql("""
      WITH met AS (
        SELECT DISTINCT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b FROM keys_to_join a JOIN keys_to_join b ON a.key = b.key
        WHERE a.filed AND NOT b.filed AND a.rep <> b.rep)
      SELECT a, b, x.seq AS x, y.seq AS y FROM met JOIN classes_to_join x ON x.rep = a JOIN classes_to_join y ON y.rep = b
      WHERE abs(length(x.seq) - length(y.seq)) <= 1 AND levenshtein(x.seq, y.seq, 1) >= 0""")
    materialize(near, "near").createOrReplaceTempView("near_to_align")
    return spark.sql("""
      WITH member AS (SELECT s.seq_no, c.rep FROM sequences_to_join s JOIN classes_to_join c ON s.seq = c.seq),
      several AS (SELECT s.seq_no, c.rep FROM sequences_to_join s JOIN classes_to_join c ON s.seq = c.seq WHERE c.copies > 1),
      turned AS (
        SELECT a, b, align_within(x, y) AS forward, align_within(y, x) AS backward FROM near_to_align),
      between AS (
        SELECT least(p.seq_no, q.seq_no) AS src, greatest(p.seq_no, q.seq_no) AS dst, if(p.seq_no < q.seq_no, forward, backward) AS diff
        FROM turned JOIN member p ON p.rep = a JOIN member q ON q.rep = b)
      SELECT src, dst, diff FROM between WHERE diff <= 1
      UNION ALL
      SELECT p.seq_no, q.seq_no, 0 FROM several p JOIN several q ON p.rep = q.rep AND p.seq_no < q.seq_no""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "seq_encode": seq_encode,
        "seq_decode": seq_decode,
        "fasta_round_trip": fasta_round_trip,
        "abundance_extract": abundance_extract,
        "abundance_missing": abundance_missing,
        "abundance_presorted": abundance_presorted,
        "abundance_order": abundance_order,
        "duplicate_headers": duplicate_headers,
        "db_info": db_info,
        "qgram_profile": qgram_profile,
        "qgram_diff_pairs": qgram_diff_pairs,
        "bucket_map": bucket_map,
        "edges_d1": _edges(1),
        "clusters_d1": _clusters(1),
        "cluster_sizes_d1": _clusters(1, cluster.cluster_sizes),
        "cluster_members_d1": cluster_members_d1,
        "singletons_d1": _clusters(1, cluster.singletons),
        "cluster_totals_d1": _clusters(1, cluster.totals),
        "search_stats_d1": search_stats_d1,
        "level_stats_d1": level_stats_d1,
        "profile_words": profile_words,
        "cluster_report_d1": cluster_report_d1,
        "edges_d2_affine": _edges(2),
        "clusters_d2_affine": _clusters(2),
        "clusters_d8_affine": _clusters(8),
        "fasta_source": fasta_source,
        "validation_counts": validation_counts,
        "pivot_pairs_d2": pivot_pairs_d2,
        "clusters_d1_extended": clusters_d1_extended,
        "rows_by_level_d1": rows_by_level_d1,
        "edges_d1_by_sql": edges_d1_by_sql,
    }


_SEQ = """seqs AS (
  SELECT doc_id AS seq_no, source || '_' || n_chars AS header,
         translate(regexp_replace(lower(coalesce(text, '')), '[^acgtu]', '', 'g'), 'u', 't') AS seq
  FROM documents),
s AS (
  SELECT seq_no, header, coalesce(try_cast(nullif(regexp_extract(header, '_([0-9]+)$', 1), '') AS BIGINT), 0) AS abundance,
         seq, CAST(length(seq) AS INT) AS seq_len
  FROM seqs)"""

_CODES = """grams AS (
  SELECT seq_no, unnest(range(1, seq_len - 3)) AS i, translate(seq, 'acgt', '0123') AS digits FROM s WHERE seq_len >= 5),
codes AS (
  SELECT seq_no, CAST(256 * substr(digits, i, 1)::INT + 64 * substr(digits, i + 1, 1)::INT + 16 * substr(digits, i + 2, 1)::INT
         + 4 * substr(digits, i + 3, 1)::INT + substr(digits, i + 4, 1)::INT AS INT) AS code FROM grams),
odd AS (SELECT seq_no, code FROM codes GROUP BY ALL HAVING count(*) % 2 = 1)"""

_PAIRS = f"""{_CODES},
n AS (SELECT s.seq_no, count(code) AS n FROM s LEFT JOIN odd USING (seq_no) GROUP BY ALL),
shared AS (SELECT a.seq_no AS src, b.seq_no AS dst, count(*) AS c FROM odd a JOIN odd b ON a.code = b.code AND a.seq_no < b.seq_no GROUP BY ALL),
diffs AS (
  SELECT a.seq_no AS src, b.seq_no AS dst, CAST((a.n + b.n - 2 * coalesce(c, 0) + 9) // 10 AS INT) AS qgram_diff
  FROM n a JOIN n b ON a.seq_no < b.seq_no LEFT JOIN shared ON src = a.seq_no AND dst = b.seq_no)"""

_EDGES = """near AS MATERIALIZED (
  SELECT a.seq_no AS src, b.seq_no AS dst, a.seq AS x, b.seq AS y
  FROM (SELECT *, unnest([seq_len - 1, seq_len, seq_len + 1]) AS other FROM s) a JOIN s b ON a.other = b.seq_len
  WHERE a.seq_no < b.seq_no),
measured AS MATERIALIZED (SELECT src, dst, CAST(levenshtein(x, y) AS INT) AS diff FROM near),
edges AS MATERIALIZED (SELECT src, dst, diff FROM measured WHERE diff <= 1)"""


def _affine(d: int) -> str:
    """Edges at resolution ``d``: the whole alignment table of each pair within ``d`` edits, one anti-diagonal a step.

    ``cur`` and ``prev`` hold the last two anti-diagonals, a cell for each symbol of the query: least cost, that of
    paths that end in a gap of either kind, and the differences on each.  Nothing is banded.
    """
    mis, o, r = ClusterConfig(resolution=d).costs
    q = o + r
    own, up, old = "cur[i + 1]", "cur[i]", "prev[i]"
    return f"""near AS MATERIALIZED (
  SELECT a.seq_no AS src, b.seq_no AS dst, a.seq AS x, b.seq AS y
  FROM (SELECT *, unnest(range(seq_len - {d}, seq_len + {d + 1})) AS other FROM s) a JOIN s b ON a.other = b.seq_len
  WHERE a.seq_no < b.seq_no AND (a.seq = b.seq OR levenshtein(a.seq, b.seq) <= {d})),
dp AS (
  SELECT x, y, length(x) AS m, length(y) AS n, CAST(-1 AS BIGINT) AS k,
         CAST([] AS STRUCT(h BIGINT, e BIGINT, f BIGINT, d BIGINT, di BIGINT, dd BIGINT)[]) AS cur,
         CAST([] AS STRUCT(h BIGINT, e BIGINT, f BIGINT, d BIGINT, di BIGINT, dd BIGINT)[]) AS prev
  FROM (SELECT DISTINCT x, y FROM near WHERE x <> y AND x <> '' AND y <> '')
  UNION ALL
  SELECT x, y, m, n, k, CAST([{{
           'h': least(g['diag'], g['e'], g['f']), 'e': g['e'], 'f': g['f'],
           'd': CASE WHEN g['e'] <= least(g['diag'], g['f']) THEN g['di'] WHEN g['f'] < g['diag'] THEN g['dd'] ELSE g['dg'] END,
           'di': g['di'], 'dd': g['dd']}} FOR g IN gaps] AS STRUCT(h BIGINT, e BIGINT, f BIGINT, d BIGINT, di BIGINT, dd BIGINT)[]), cur
  FROM (
    SELECT x, y, m, n, k + 1 AS k, cur, [{{
             'e': CASE WHEN i = k + 1 THEN {q} + {r} * i ELSE least({own}['h'] + {q}, {own}['e'] + {r}) END,
             'di': CASE WHEN i = k + 1 THEN i + 2 WHEN {own}['h'] + {q} > {own}['e'] + {r} THEN {own}['di'] + 1 ELSE {own}['d'] + 1 END,
             'f': CASE WHEN i = 0 THEN {q} + {r} * (k + 1) ELSE least({up}['h'] + {q}, {up}['f'] + {r}) END,
             'dd': CASE WHEN i = 0 THEN k + 3 WHEN {up}['h'] + {q} > {up}['f'] + {r} THEN {up}['dd'] + 1 ELSE {up}['d'] + 1 END,
             'diag': CASE WHEN k = -1 THEN 0 WHEN i = 0 OR i = k + 1 THEN {q} + {r} * k ELSE {old}['h'] END
                     + CASE WHEN x[i + 1] = y[k + 2 - i] THEN 0 ELSE {mis} END,
             'dg': CASE WHEN i = 0 OR i = k + 1 THEN k + 1 ELSE {old}['d'] END + CASE WHEN x[i + 1] = y[k + 2 - i] THEN 0 ELSE 1 END
           }} FOR i IN range(m)] AS gaps
    FROM dp WHERE k < m + n - 2)),
aligned AS MATERIALIZED (SELECT x, y, cur[m]['d'] AS diff FROM dp WHERE k = m + n - 2),
edges AS MATERIALIZED (
  SELECT src, dst, CAST(diff AS INT) AS diff
  FROM (SELECT src, dst, CASE WHEN near.x = near.y THEN 0 WHEN near.x = '' OR near.y = '' THEN greatest(length(near.x), length(near.y)) ELSE aligned.diff END AS diff
        FROM near LEFT JOIN aligned ON near.x = aligned.x AND near.y = aligned.y)
  WHERE diff <= {d})"""


_REACH = """sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
reach(v, r) AS (SELECT seq_no, seq_no FROM s UNION SELECT sym.dst, reach.r FROM reach JOIN sym ON sym.src = reach.v),
clusters AS (SELECT min(r) AS cluster_id, v AS seq_no FROM reach GROUP BY v)"""

_CLUSTERS = f"{_EDGES}, {_REACH}"


def oracle_sql() -> dict[str, str]:
    c = f"WITH RECURSIVE {_SEQ}, {_CLUSTERS}"
    return {
        "seq_encode": f"WITH {_SEQ} SELECT seq_no, translate(seq, 'acgt', '1234') AS codes, seq_len FROM s",
        "seq_decode": f"WITH {_SEQ} SELECT seq_no, seq FROM s",
        "fasta_round_trip": f"WITH {_SEQ} SELECT row_number() OVER (ORDER BY seq_no) - 1 AS seq_no, header, abundance, seq, seq_len FROM s",
        "abundance_extract": f"WITH {_SEQ} SELECT seq_no, header, abundance FROM s",
        "abundance_missing": f"WITH {_SEQ} SELECT count(*) FILTER (abundance < 1) AS missing FROM s",
        "abundance_presorted": f"WITH {_SEQ}, w AS (SELECT *, lag(abundance) OVER (ORDER BY seq_no) AS previous FROM s) SELECT seq_no, header, previous, abundance FROM w WHERE previous >= 1 AND abundance > previous",
        "abundance_order": f"WITH {_SEQ} SELECT seq_no, abundance FROM s ORDER BY abundance DESC, seq_no",
        "duplicate_headers": f"WITH {_SEQ} SELECT header, count(*) AS n FROM s GROUP BY header HAVING count(*) > 1",
        "db_info": f"WITH {_SEQ} SELECT count(*) AS sequences, CAST(coalesce(sum(seq_len), 0) AS BIGINT) AS nucleotides, coalesce(max(seq_len), 0) AS longest FROM s",
        "qgram_profile": f"WITH {_SEQ}, {_CODES} SELECT seq_no, code FROM odd",
        "qgram_diff_pairs": f"WITH {_SEQ}, {_PAIRS} SELECT src, dst, qgram_diff FROM diffs WHERE qgram_diff <= 1",
        "bucket_map": f"WITH {_SEQ}, {_PAIRS} SELECT src, dst, qgram_diff, CAST(ceil(qgram_diff / 2) AS INT) AS level FROM diffs WHERE qgram_diff <= 2",
        "edges_d1": f"WITH {_SEQ}, {_EDGES} SELECT src, dst, diff FROM edges",
        "clusters_d1": f"{c} SELECT cluster_id, seq_no FROM clusters",
        "cluster_sizes_d1": f"{c} SELECT cluster_id, count(*) AS size FROM clusters GROUP BY cluster_id",
        "cluster_members_d1": f"{c} SELECT cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size, seq_no FROM clusters QUALIFY size > 1",
        "singletons_d1": f"{c} SELECT cluster_id AS seq_no FROM clusters GROUP BY cluster_id HAVING count(*) = 1",
        "cluster_totals_d1": f"{c} SELECT count(DISTINCT cluster_id) AS clusters, count(*) AS sequences FROM clusters",
        "search_stats_d1": f"WITH {_SEQ}, {_PAIRS}, {_EDGES} SELECT (SELECT CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) FROM s) AS total_estimate, (SELECT count(*) FROM diffs WHERE qgram_diff <= 1) AS total_search, (SELECT count(*) FROM edges) AS total_match",
        "level_stats_d1": f"WITH {_SEQ}, {_PAIRS} SELECT CAST(ceil(qgram_diff / 1) AS INT) AS level, count(*) AS pairs FROM diffs WHERE qgram_diff <= 2 GROUP BY ALL",
        "profile_words": f"WITH {_SEQ}, {_CODES} SELECT seq_no, CAST(code // 64 AS INT) AS word, bit_xor(CASE WHEN code % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE (1::BIGINT << (code % 64)) END) AS bits FROM odd GROUP BY ALL",
        "edges_d2_affine": f"WITH RECURSIVE {_SEQ}, {_affine(2)} SELECT src, dst, diff FROM edges",
        "clusters_d2_affine": f"WITH RECURSIVE {_SEQ}, {_affine(2)}, {_REACH} SELECT cluster_id, seq_no FROM clusters",
        "clusters_d8_affine": f"WITH RECURSIVE {_SEQ}, {_affine(8)}, {_REACH} SELECT cluster_id, seq_no FROM clusters",
        "fasta_source": f"WITH {_SEQ} SELECT row_number() OVER (ORDER BY seq_no) - 1 AS seq_no, header, abundance, seq, seq_len FROM s",
        "validation_counts": f"WITH {_SEQ}, w AS (SELECT abundance, lag(abundance) OVER (ORDER BY seq_no) AS previous FROM s), h AS (SELECT header, count(*) AS n FROM s WHERE header IS NOT NULL GROUP BY header HAVING count(*) > 1) SELECT (SELECT count(*) FROM s) AS sequences, (SELECT count(*) FROM s WHERE abundance < 1) AS missing, (SELECT count(*) FROM w WHERE previous >= 1 AND abundance > previous) AS disordered, (SELECT count(*) FROM h) AS repeated, (SELECT min(header) FROM h) AS header, (SELECT n FROM h ORDER BY header LIMIT 1) AS times",
        "pivot_pairs_d2": f"WITH {_SEQ}, {_PAIRS} SELECT src, dst, qgram_diff FROM diffs WHERE qgram_diff <= 2",
        "clusters_d1_extended": f"{c} SELECT cluster_id, seq_no FROM clusters",
        "rows_by_level_d1": f"WITH RECURSIVE {_SEQ}, {_EDGES}, levels(v, l) AS (SELECT seq_no, 1 FROM s WHERE seq_no NOT IN (SELECT dst FROM edges) UNION SELECT dst, l + 1 FROM levels JOIN edges ON src = v), least_levels AS (SELECT v, min(l) AS level FROM levels GROUP BY v) SELECT level, count(*) AS rows FROM least_levels GROUP BY level",
        "edges_d1_by_sql": f"WITH {_SEQ}, {_EDGES} SELECT src, dst, diff FROM edges",
        "cluster_report_d1": f"{c}, t AS (SELECT count(DISTINCT cluster_id) AS n, count(*) AS m FROM clusters) SELECT header AS value FROM clusters JOIN s USING (seq_no) UNION ALL SELECT '' FROM (SELECT DISTINCT cluster_id FROM clusters) UNION ALL SELECT '' UNION ALL SELECT '' UNION ALL SELECT 'Total: ' || n || ' clusters of ' || m || ' sequences' FROM t",
    }
