"""Versions, conflicts and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, FILES_SQL, TOKENS_SQL, Catalog, docs, files, table, values
from harrier.operators import graph as G
from harrier.operators import versions as V
from harrier.scratch import checkpointed

CATALOG = Catalog()

_F = FILES_SQL
_KEY = "CASE WHEN suf = '' THEN 'none' ELSE suf END || ':' || lower(regexp_replace(regexp_replace(stem, '(?i)(_v[0-9]+|_old|_archive|[-._]bak)$', ''), '_v[0-9]+', '', 'g'))"
_CLUSTERS = f"""p AS (SELECT path, mtime, lower(regexp_extract(split_part(path, '/', -1), '^.+([.][^.]+)$', 1)) AS suf, regexp_replace(split_part(path, '/', -1), '^(.+)[.][^.]+$', '\\1') AS stem FROM f),
  k AS (SELECT path, mtime, {_KEY} AS key FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, max(mtime) OVER (PARTITION BY key) AS newest FROM k),
  r AS (SELECT *, NOT list_has_any(string_split(lower(path), '/'), ['archive', 'old', 'superseded']) AND mtime >= newest - 1e-6 AS fresh FROM n WHERE n > 1),
  c AS (SELECT key, path, mtime, CASE WHEN max(fresh) OVER (PARTITION BY key) THEN fresh ELSE row_number() OVER (PARTITION BY key ORDER BY mtime DESC, path) = 1 END AS current,
        first_value(path) OVER (PARTITION BY key ORDER BY fresh DESC, mtime DESC, path) AS current_path FROM r)""".replace("\\\\1", "\\1")


@CATALOG.add(f"WITH {_F}, {_CLUSTERS} SELECT key, path, mtime, current, current_path FROM c")
def version_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clusters(files(spark, sf_dir))


_ASKS = "CASE CAST(r % 3 AS INT) WHEN 0 THEN 'what changed between the versions' WHEN 1 THEN 'what learning rate did run ' || r || ' use' ELSE 'learning rate' END"


@CATALOG.add(f"""WITH {_F}, {_CLUSTERS}, h AS (SELECT r AS query_id, {_ASKS} AS query, path, CASE k WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS rank FROM f WHERE k IN (0, 1, 7)),
  g AS (SELECT h.query_id, h.path FROM h JOIN c ON h.path = c.path AND c.path <> c.current_path JOIN h o ON o.query_id = h.query_id AND o.path = c.current_path WHERE NOT regexp_matches(h.query, '(?i)\\b(compare|versus|vs\\.?|between|changed|difference|diff|older|newer)\\b'))
  SELECT query_id, path, query, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS rank FROM h WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = h.query_id AND g.path = h.path)""")
def prefer_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run's question its old config, its config and its notes, in this order."""
    rank = F.expr("CASE k WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END")
    hits = files(spark, sf_dir).filter("k IN (0, 1, 7)").select(F.col("r").alias("query_id"), F.expr(_ASKS).alias("query"), "path", rank.alias("rank"))
    return V.prefer_current(hits, V.clusters(files(spark, sf_dir)))


_FACTS = """e AS (SELECT *, coalesce('run:' || nullif(regexp_replace(regexp_extract(path, '(?i)run[_-]?0*([0-9]+)', 1), '^0+(.)', '\\1'), ''), 'run:' || nullif(regexp_replace(regexp_extract(text, '(?i)run[_-]?0*([0-9]+)', 1), '^0+(.)', '\\1'), ''), 'file:' || path) AS entity FROM f),
  x AS (SELECT entity, path, lower(unnest(regexp_extract_all(text, '(?i)\\b(learning_rate|val_rmse|num_pairs|fusion|encoder|bark_type)\\s*[:=]\\s*([A-Za-z0-9.eE+\\-]+)', 1))) AS field,
        lower(unnest(regexp_extract_all(text, '(?i)\\b(learning_rate|val_rmse|num_pairs|fusion|encoder|bark_type)\\s*[:=]\\s*([A-Za-z0-9.eE+\\-]+)', 2))) AS value FROM e)"""


@CATALOG.add(f"WITH {_F}, {_FACTS} SELECT entity, field, list_sort(list(DISTINCT value)) AS values, list_sort(list(DISTINCT path)) AS paths FROM x GROUP BY entity, field HAVING count(DISTINCT value) >= 2")
def structural_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.structural_conflicts(files(spark, sf_dir))


@CATALOG.add(f"""WITH {_F}, t AS (SELECT r, path, trim(regexp_replace(regexp_replace(lower(text), '[*_`~]+', '', 'g'), '[^a-z0-9.]+', ' ', 'g')) AS x FROM f), o AS (SELECT * FROM (VALUES (0, 'does help', 'does not help'), (1, 'fusion helps', 'fusion does not'), (2, 'not help', 'does help')) AS v(i, said, denied)),
  m AS (SELECT a.r AS query_id, a.path AS path_a, b.path AS path_b, min(i) AS i FROM t a JOIN t b ON a.r = b.r AND a.path < b.path JOIN o ON (contains(a.x, said) AND contains(b.x, denied)) OR (contains(b.x, said) AND contains(a.x, denied)) GROUP BY ALL)
  SELECT query_id, path_a, path_b, said, denied FROM m JOIN o USING (i)""")
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.claim_conflicts(files(spark, sf_dir).select(F.col("r").alias("query_id"), "path", "text", "mtime"))


_RUN = "nullif(regexp_replace(coalesce(nullif(regexp_extract(path, '(?i)run[_-]?0*([0-9]+)', 1), ''), regexp_extract(text, '(?i)run[_-]?0*([0-9]+)', 1)), '^0+(.)', '\\1'), '')"


@CATALOG.add(f"""WITH {_F}, p AS (SELECT path, text, mtime, split_part(path, '/', -1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f),
  refs AS (SELECT path, unnest(regexp_extract_all(text, '(?:[\\w.\\-]+/)+[\\w.\\-]+\\.(?:ya?ml|py|csv|md|out|sbatch|json|png|pdf)')) AS ref FROM p),
  imps AS (SELECT path, unnest(regexp_extract_all(text, '(?m)^\\s*(?:from|import)\\s+([\\w.]+)', 1)) AS m FROM p WHERE path LIKE '%.py'),
  incs AS (SELECT path, unnest(regexp_extract_all(text, '(?:include|source|config|checkpoint)\\s*[:=]\\s*[''"]?([^\\s''"]+)', 1)) AS r FROM p),
  runs AS (SELECT path, {_RUN} AS run FROM p), e AS (
  SELECT folder AS src, path AS dst, 'contains' AS kind FROM p WHERE folder <> ''
  UNION ALL SELECT refs.path, p.path, 'references' FROM refs JOIN p ON ref = p.path AND refs.path <> p.path
  UNION ALL SELECT imps.path, p.path, 'imports' FROM imps JOIN p ON (ends_with(p.path, replace(m, '.', '/') || '.py') OR regexp_replace(name, '[.][^.]+$', '') = split_part(m, '.', -1)) AND imps.path <> p.path
  UNION ALL SELECT incs.path, p.path, 'references' FROM incs JOIN p ON (ends_with(p.path, r) OR name = split_part(r, '/', -1)) AND incs.path <> p.path
  UNION ALL SELECT a.path, b.path, 'same_run' FROM runs a JOIN runs b ON a.run = b.run AND a.path < b.path
  UNION ALL SELECT a.path, b.path, 'co_modified' FROM p a JOIN p b ON a.folder = b.folder AND b.mtime - a.mtime BETWEEN 0 AND 3600 AND (a.mtime < b.mtime OR a.path < b.path))
  SELECT src, dst, kind, count(*) AS n FROM e GROUP BY ALL""")
def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.file_edges(files(spark, sf_dir)).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@CATALOG.add("""WITH f AS (SELECT event_type || '/' || event_id || '.log' AS path, event_type AS folder, epoch(ts) AS mtime FROM events)
  SELECT a.path AS src, b.path AS dst, 'co_modified' AS kind FROM f a JOIN f b ON a.folder = b.folder AND b.mtime - a.mtime BETWEEN 0 AND 600 AND (a.mtime < b.mtime OR a.path < b.path)""")
def co_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _co_modified(table(spark, sf_dir, "events"))


def _co_modified(e: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return G.co_modified(e.select(F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".log")).alias("path"), seconds.alias("mtime")), 600.0)


@CATALOG.add("""WITH e AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), z AS (SELECT 'c' || c_custkey AS seed FROM customer),
  h1 AS (SELECT DISTINCT seed, b AS node FROM z JOIN u ON seed = a), h2 AS (SELECT seed, b AS node FROM h1 JOIN u ON node = a EXCEPT (SELECT seed, seed FROM z UNION ALL SELECT seed, node FROM h1))
  SELECT seed, seed AS node, 0::BIGINT AS hop FROM z UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2""")
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all customers over all orders."""
    return _k_hop(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def _k_hop(o: DataFrame, c: DataFrame) -> DataFrame:
    edges = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("placed").alias("kind"))
    seeds = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("seed"))
    return G.hops(edges, seeds, 2)


@CATALOG.add("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), ss AS (SELECT DISTINCT x.a AS x, y.a AS y FROM e x JOIN e y USING (b)),
  r(x, y) AS (SELECT x, y FROM ss UNION SELECT r.x, ss.y FROM r JOIN ss ON r.y = ss.x), low AS (SELECT a, least(a, min(b)) AS m FROM e GROUP BY a),
  c AS (SELECT x AS a, min(m) AS component FROM r JOIN low ON low.a = r.y GROUP BY x) SELECT a AS node, component FROM c UNION ALL SELECT b, min(component) FROM e JOIN c USING (a) GROUP BY b""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(table(spark, sf_dir, "lineitem"))


def _components(li: DataFrame) -> DataFrame:
    return G.connected(li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")))


_TRIPLES = f"""rr AS (SELECT path, text, 'run:' || {_RUN} AS src FROM f WHERE {_RUN} IS NOT NULL), t AS (
  SELECT src, 'uses_encoder' AS relation, 'encoder:' || lower(unnest(regexp_extract_all(text, '(?i)\\b(dinov2|resnet50|clip|vit-b/?[0-9]*)\\b', 1))) AS dst, path AS evidence FROM rr
  UNION ALL SELECT src, 'uses_bark', 'bark:' || lower(unnest(regexp_extract_all(text, '(?i)\\bbark(?:_type)?\\s*[:=]\\s*([A-Za-z]+)', 1))), path FROM rr
  UNION ALL SELECT src, 'has_' || lower(unnest(regexp_extract_all(text, '(?i)\\b(learning_rate|val_rmse|num_pairs|fusion)\\s*[:=]\\s*([A-Za-z0-9.eE+\\-]+)', 1))), lower(unnest(regexp_extract_all(text, '(?i)\\b(learning_rate|val_rmse|num_pairs|fusion)\\s*[:=]\\s*([A-Za-z0-9.eE+\\-]+)', 2))), path FROM rr
  UNION ALL SELECT src, 'documented_in', 'file:' || path, path FROM rr)"""
_COMMUNITIES = f"""{_F}, {_TRIPLES}, te AS (SELECT src AS a, dst AS b FROM t UNION SELECT dst, src FROM t), cw(node, other) AS (SELECT a, a FROM te UNION SELECT node, b FROM cw JOIN te ON other = a),
  cl AS (SELECT node, min(other) AS component FROM cw GROUP BY node), cs AS (SELECT component, count(*) AS size FROM cl GROUP BY component HAVING count(*) > 1),
  cn AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) - 1 AS community FROM cs), cm AS (SELECT community, node, size FROM cl JOIN cn USING (component))"""


@CATALOG.add(f"WITH {_F}, {_TRIPLES} SELECT src, relation, dst, evidence FROM t")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triples(files(spark, sf_dir))


@CATALOG.add(f"WITH RECURSIVE {_COMMUNITIES} SELECT community, node, size FROM cm")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(G.triples(files(spark, sf_dir)))


#: A question for each passage, most of them about a run.
_ASKS_RUN = "CASE CAST(item_id % 4 AS INT) WHEN 0 THEN 'what learning rate does run ' || item_id || ' use' WHEN 1 THEN 'bark of run ' || item_id WHEN 2 THEN 'encoder clip' ELSE 'unrelated' END"
_Q = f"q AS (SELECT item_id AS query_id, {_ASKS_RUN} AS text FROM benchmark)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_ASKS_RUN).alias("text"))


_ROUNDS = ", ".join(f"p{i + 1} AS (SELECT s0.query_id, s0.node, 0.85::DOUBLE * coalesce(sum(share * p{i}.mass), 0) + 0.15::DOUBLE * any_value(s0.mass) AS mass FROM p0 s0 LEFT JOIN sh ON sh.b = s0.node LEFT JOIN p{i} ON p{i}.query_id = s0.query_id AND p{i}.node = sh.a GROUP BY ALL)" for i in range(25))


@CATALOG.add(f"""WITH {_F}, {_TRIPLES}, {_Q}, w AS (SELECT a, b, count(*)::DOUBLE AS weight FROM (SELECT src AS a, dst AS b FROM t UNION ALL SELECT dst, src FROM t) GROUP BY ALL),
  sh AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM w), n AS (SELECT DISTINCT a AS node FROM w),
  seed AS (SELECT query_id, 'run:' || nullif(regexp_extract(text, '(?i)\\brun\\s+0*([0-9]+)\\b', 1), '') AS s FROM q UNION ALL SELECT query_id, 'encoder:' || lower(unnest(regexp_extract_all(text, '(?i)\\b(dinov2|resnet50|clip|vit-b/?[0-9]*)\\b', 1))) FROM q),
  m AS (SELECT query_id, node, CASE WHEN node = s THEN 1.5 ELSE 0.5 END::DOUBLE AS mass FROM seed JOIN n ON contains(lower(node), lower(s))), z AS (SELECT query_id, sum(mass) AS total FROM m GROUP BY query_id),
  p0 AS MATERIALIZED (SELECT q.query_id, n.node, CASE WHEN z.total IS NULL THEN 1.0::DOUBLE / (SELECT count(*) FROM n) ELSE coalesce(m.mass, 0) / z.total END AS mass FROM q CROSS JOIN n LEFT JOIN z USING (query_id) LEFT JOIN m ON m.query_id = q.query_id AND m.node = n.node), {_ROUNDS}
  SELECT query_id, node, round(mass, 6) AS mass FROM p25""")
def ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted, collected and asked for its nodes: the texts are read once
    weights = checkpointed(G.adjacency(G.triples(files(spark, sf_dir))))
    q = _asked(spark, sf_dir)
    return G.page_rank(weights, G.seeds_of(q, weights.select(F.col("a").alias("node")).distinct())).withColumn("mass", F.round("mass", 6))


@CATALOG.add(f"""WITH RECURSIVE {_COMMUNITIES}, {_Q}, cx AS (SELECT DISTINCT community, unnest({TOKENS_SQL.format(x="replace(node, ':', ' ')")}) AS word FROM cm), qx AS (SELECT DISTINCT query_id, unnest({TOKENS_SQL.format(x="text")}) AS word FROM q),
  sc AS (SELECT query_id, community AS item, count(*) AS score FROM qx JOIN cx USING (word) GROUP BY ALL) SELECT query_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM sc) WHERE rank <= 3""")
def community_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.match_communities(_asked(spark, sf_dir), G.communities(G.triples(files(spark, sf_dir))))


#: Files of three runs, with a question and a mass for each; and the pairs of a question's word and a path that are worth something.
_BOOST_ASKS = "CASE CAST(r % 3 AS INT) WHEN 0 THEN 'which config and log of the job' WHEN 1 THEN 'the source code of the paper draft' ELSE 'rmse and documents' END"


@CATALOG.add(f"""WITH {_F}, h AS (SELECT r AS query_id, {_BOOST_ASKS} AS query, path, row_number() OVER (PARTITION BY r ORDER BY path) AS rank, ((doc_id * 37) % 11) / 10.0::DOUBLE AS mass FROM f),
  i AS (SELECT *, (CASE WHEN regexp_matches(query, '\\b(slurm|job|launch(?:ed)?)\\b') AND ends_with(path, '.sbatch') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(query, '\\b(source|module|code|documents?)\\b') AND ends_with(path, '.py') THEN 2 ELSE 0 END
       + CASE WHEN regexp_matches(query, '\\b(paper|draft)\\b') AND (starts_with(path, 'paper/') OR ends_with(path, '.md')) THEN 1.5 ELSE 0 END + CASE WHEN contains(query, 'config') AND starts_with(path, 'configs/') THEN 1.5 ELSE 0 END
       + CASE WHEN regexp_matches(query, '\\b(log|rmse)\\b') AND (starts_with(path, 'logs/') OR ends_with(path, '.out')) THEN 0.75 ELSE 0 END)::DOUBLE AS intent FROM h),
  g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY intent DESC, round(mass, 12) DESC, path DESC) AS graph_rank, row_number() OVER (PARTITION BY query_id ORDER BY intent DESC, path DESC) AS intent_rank FROM i),
  s AS (SELECT *, round(1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + graph_rank) + 1.1::DOUBLE / (60 + intent_rank), 10) AS score FROM g) SELECT query_id, query, path, rank, mass, intent, CAST(graph_rank AS BIGINT) AS graph_rank, CAST(intent_rank AS BIGINT) AS intent_rank, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS BIGINT) AS new_rank FROM s""")
def intent_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each run, in the order of their paths, for a question about the run."""
    rank = F.row_number().over(Window.partitionBy("r").orderBy("path"))
    mass = (F.col("doc_id") * 37 % 11).cast("double") / 10
    return G.boosted(files(spark, sf_dir).select(F.col("r").alias("query_id"), F.expr(_BOOST_ASKS).alias("query"), "path", rank.alias("rank"), mass.alias("mass")))


@CATALOG.add(f"""WITH {DOCS_SQL}, h AS (SELECT path, source AS folder, doc_id, substr(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' '), 1, 400) AS head FROM docs),
  l AS (SELECT 'file' AS level, path AS name, path, doc_id, head FROM h UNION ALL SELECT 'folder', folder, path, doc_id, head FROM h UNION ALL SELECT 'corpus', 'corpus', path, doc_id, head FROM h),
  n AS (SELECT *, row_number() OVER (PARTITION BY level, name ORDER BY path, doc_id) AS i, count(*) OVER (PARTITION BY level, name) AS n_chunks FROM l)
  SELECT level, name, n_chunks, substr(name || ': ' || string_agg(head, ' | ' ORDER BY i), 1, 800) AS summary FROM n WHERE i <= 6 GROUP BY level, name, n_chunks""")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hierarchy(docs(spark, sf_dir).select("path", F.col("doc_id").alias("chunk_id"), "text"))
