"""Evidence for research questions, cards, rollouts, snapshots, and budgets that are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QT_SQL, QUERIES_SQL, TF_SQL, TOKEN_SQL, Catalog, bm25_sql, docs, table, text_queries, top_sql
from harrier.catalog.graphs import _CLUSTERS
from harrier.operators import evidence as X
from harrier.operators import graph as G
from harrier.operators import lexical as L
from harrier.operators import research as R
from harrier.operators import tabular as P
from harrier.operators import versions as V
from harrier.operators.understand import COMPARATIVE
from harrier.sources import corpus, snapshot
from harrier.streaming import ledger

CATALOG = Catalog()

_BASE = f"{TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 10, 'base')}"
_TERMS = "['" + "', '".join(R.SOURCE_TERMS) + "']"


def _hits(spark: SparkSession, sf_dir: str, n: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    return L.bm25_top_k(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), n, k1, b)


@CATALOG.add(f"""WITH {_BASE}, f AS (SELECT doc_id AS item, CASE doc_id % 5 WHEN 0 THEN 'paper/draft_' || doc_id // 10 || '_v' || doc_id // 5 % 2 || '.md' WHEN 1 THEN 'src/part_' || doc_id || '.py' WHEN 2 THEN 'configs/run_' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END || '.yaml'
    WHEN 3 THEN 'logs/run_' || doc_id || '.out' ELSE 'misc/checkpoint_' || doc_id || '.txt' END AS path, text || CASE WHEN doc_id % 7 = 0 THEN ' Encoder' ELSE '' END AS text, doc_id::DOUBLE AS mtime FROM docs), {_CLUSTERS},
  asked AS (SELECT query_id, text || CASE WHEN query_id % 2 = 0 THEN ' Run ' || (query_id + 2) ELSE '' END AS query, CASE WHEN query_id % 2 = 0 THEN CAST(query_id + 2 AS VARCHAR) END AS run FROM q),
  named AS (SELECT item, path, text, coalesce(nullif(regexp_extract(path, '(?i)run[_-]?0*([0-9]+)', 1), ''), nullif(regexp_extract(text, '(?i)run[_-]?0*([0-9]+)', 1), '')) AS run, lower(path || ' ' || text) AS low, list_distinct(list_transform({TOKEN_SQL.format(x="path || ' ' || text")}, lambda t: lower(t))) AS words FROM f),
  cand AS (SELECT query_id, doc_id AS item FROM base UNION SELECT query_id, item FROM asked JOIN named USING (run)),
  said AS (SELECT DISTINCT query_id, term FROM cand JOIN named USING (item), (SELECT unnest({_TERMS}) AS term) WHERE contains(lower(text), term)), st AS MATERIALIZED (SELECT query_id, list(term) AS terms FROM said GROUP BY query_id),
  wide AS (SELECT * FROM cand UNION SELECT query_id, item FROM said JOIN named ON path LIKE '%.py' AND contains(low, term)),
  x AS (SELECT wide.query_id, item, path, query, CASE WHEN path = 'configs/run_' || CASE WHEN length(asked.run) < 3 THEN lpad(asked.run, 3, '0') ELSE asked.run END || '.yaml' THEN 0 WHEN path LIKE 'paper/%' THEN 1 WHEN path LIKE '%.py' THEN 2 WHEN path LIKE 'logs/%' THEN 3 WHEN path LIKE '%.sbatch' THEN 4 WHEN contains(path, 'checkpoint') THEN 5 ELSE 6 END AS role,
    coalesce(len(list_intersect(terms, words)), 0) AS a, len(list_intersect(list_distinct(list_transform({TOKEN_SQL.format(x="query")}, lambda t: lower(t))), words)) AS b, coalesce(base.rank, 10000) AS found
    FROM wide JOIN named USING (item) JOIN asked USING (query_id) LEFT JOIN st USING (query_id) LEFT JOIN base ON base.query_id = wide.query_id AND base.doc_id = item),
  gone AS (SELECT DISTINCT x.query_id, x.path FROM x JOIN c ON x.path = c.path AND c.path <> c.current_path JOIN x o ON o.query_id = x.query_id AND o.path = c.current_path WHERE NOT regexp_matches(x.query, '{COMPARATIVE}'))
  SELECT query_id, item, path, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY role, a DESC, b DESC, found, path, item) AS rank FROM x ANTI JOIN gone USING (query_id, path)) WHERE rank <= 12""".replace(" st AS MATERIALIZED", " sterms AS").replace("LEFT JOIN st USING", "LEFT JOIN sterms USING"))
def research_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers of two versions, code, settings, logs and checkpoints; every other
    query names a run."""
    d, i = docs(spark, sf_dir), F.col("doc_id").cast("string")
    number = F.when(F.col("doc_id") < 1000, F.lpad(i, 3, "0")).otherwise(i)
    paths = [F.concat(F.lit("paper/draft_"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit("_v"), (F.floor(F.col("doc_id") / 5) % 2).cast("string"), F.lit(".md")), F.concat(F.lit("src/part_"), i, F.lit(".py")), F.concat(F.lit("configs/run_"), number, F.lit(".yaml")), F.concat(F.lit("logs/run_"), i, F.lit(".out"))]
    path = F.concat(F.lit("misc/checkpoint_"), i, F.lit(".txt"))
    for n, p in enumerate(paths):
        path = F.when(F.col("doc_id") % 5 == n, p).otherwise(path)
    chunks = d.select(F.col("doc_id").alias("item"), path.alias("path"), F.concat("text", F.when(F.col("doc_id") % 7 == 0, " Encoder").otherwise("")).alias("text"), F.col("doc_id").cast("double").alias("mtime"))
    run = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit(" Run "), (F.col("query_id") + 2).cast("string"))).otherwise("")
    queries = text_queries(spark, sf_dir).select("query_id", F.concat("text", run).alias("query"))
    return R.research_evidence(queries, _hits(spark, sf_dir), chunks, V.clusters(chunks))


_ENDS = ("", " Streamlit", " plot of fusion", " test the Learning-Rate", " reproduced 3e-4")


@CATALOG.add(f"""WITH {_BASE}, a AS (SELECT query_id, text || ['{"', '".join(_ENDS)}'][query_id % 5 + 1] AS query FROM q), c AS (SELECT query_id, list(path || ':0-' || strlen(text) ORDER BY rank) AS citations FROM base JOIN docs USING (doc_id) WHERE rank <= 4 GROUP BY query_id),
  t AS (SELECT *, CASE WHEN regexp_matches(lower(query), 'streamlit|dashboard') THEN 1 WHEN regexp_matches(lower(query), 'notebook|jupyter|plot') THEN 2 WHEN contains(lower(query), 'test') THEN 3 WHEN regexp_matches(lower(query), 'reproduc|from the paper|paper2code') THEN 4 ELSE 5 END AS i FROM a)
  SELECT query_id, trim(query, ' ') AS goal, ['streamlit', 'jupyter-analysis', 'pytest', 'research-repro', 'python-lib'][i] AS template, coalesce(citations, []) AS citations, CASE WHEN contains(lower(query), 'fusion') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(query, '(?i)learning.?rate|3e-4') THEN 1 ELSE 0 END AS n_tests,
  'artifacts/' || ['app.py', 'analysis.py', 'test_artifact.py', 'reproduce.py', 'lib.py'][i] AS file_path, trim(query, ' ') <> '' AND citations IS NOT NULL AS ready FROM t LEFT JOIN c USING (query_id)""")
def spec_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("query_id") % 5 + 1).cast("int"))
    queries = text_queries(spark, sf_dir).select("query_id", F.concat("text", end).alias("query"))
    cards = R.spec_cards(queries, _placed(spark, sf_dir).withColumn("chunk_id", F.col("item").cast("string")))
    cited = F.transform("citations", lambda c: F.concat(c["path"], F.lit(":"), c["start_byte"].cast("string"), F.lit("-"), c["end_byte"].cast("string")))
    return cards.withColumns({"citations": cited, "n_tests": F.size("tests")}).drop("tests")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with path, text and byte range: each document is one chunk."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("item"), "path", "text", F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"))
    return _hits(spark, sf_dir).join(d, "item")


@CATALOG.add(f"""WITH {DOCS_SQL}, c AS (SELECT doc_id AS id, lower(text) AS low, unnest([{{'field': 'learning_rate', 'value': '0.' || doc_id}}, {{'field': 'fusion', 'value': 'The'}}, {{'field': 'fusion', 'value': '' || doc_id}}, {{'field': 'encoder literal', 'value': 'clip'}}]) AS s, unnest([0, 0, 1, 0]) AS nth FROM docs)
  SELECT id, s.field AS field, s.value AS value, nth FROM c WHERE NOT contains(low, lower(s.value)) AND NOT contains(low, s.field)""")
def unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code that states three values and an encoder, with each document as its only hit."""
    d, i = docs(spark, sf_dir), F.col("doc_id").cast("string")
    code = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("Learning_Rate = 0."), i, F.lit("\nfusion: The\nfusion="), i, F.lit("\nENCODER = 'clip'")).alias("text"))
    return R.unsupported_claims(code, d.select(F.col("doc_id").alias("id"), "text"))


@CATALOG.add(f"""WITH {_BASE}, h AS (SELECT query_id, rank, path, path || ' [0:' || strlen(text) || '] ' || substr(text, 1, 400) AS line FROM base JOIN docs USING (doc_id)), i AS (SELECT query_id, string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 4) AS info, list(path ORDER BY rank) AS paths, min(path) FILTER (rank = 1) AS answer FROM h GROUP BY query_id)
  SELECT query_id AS id, sha256('<search>' || text || '</search>' || chr(10) || '<information>' || coalesce(info, '') || '</information>' || chr(10) || '<answer>' || coalesce(answer, '') || '</answer>') AS sha, coalesce(paths, []) AS paths, answer IS NOT NULL AS cited FROM q LEFT JOIN i USING (query_id)""")
def search_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search for each query; the best hit's path is the answer."""
    hits = _placed(spark, sf_dir).withColumnRenamed("query_id", "id")
    questions = text_queries(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("text").alias("question"))
    found = R.rollouts(questions, hits, hits.filter("rank = 1").select("id", F.col("path").alias("answer")))
    return found.select("id", F.sha2("text", 256).alias("sha"), "paths", "cited")


@CATALOG.add(f"""WITH {TF_SQL}, {QT_SQL}, {bm25_sql('1.5', '0.75', 'b0')}, {bm25_sql('0.4', '0.0', 'b1')}, {top_sql('b0', 10, 'r0')}, {top_sql('b1', 10, 'r1')},
  l AS (SELECT query_id, doc_id, source AS path, rank, leg FROM (SELECT *, 0 AS leg FROM r0 UNION ALL SELECT *, 1 FROM r1) JOIN docs USING (doc_id)), s AS (SELECT query_id, doc_id, path, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS rrf, min(leg * 1000 + rank) AS first FROM l GROUP BY ALL),
  u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS rank FROM s), g AS (SELECT query_id, path, min(rank) AS first, 2 AS leg FROM u WHERE rank <= 5 GROUP BY ALL UNION ALL SELECT query_id, path, min(rank), leg FROM l GROUP BY query_id, path, leg),
  o AS (SELECT query_id, path, leg, row_number() OVER (PARTITION BY query_id, leg ORDER BY first, path) AS r FROM g), w AS (SELECT query_id, path, max(r) FILTER (leg = 1) AS dense_rank, max(r) FILTER (leg = 0) AS bm25_rank, max(r) FILTER (leg = 2) AS now FROM o GROUP BY ALL),
  k AS (SELECT query_id, path, min(rank) AS chunk_rank, arg_min(rrf, rank) AS rrf FROM u GROUP BY ALL), z AS (SELECT query_id, rrf AS cut FROM u WHERE rank = 5)
  SELECT query_id, path, CASE WHEN coalesce(dense_rank <= 4, false) THEN 'dropped' ELSE 'gained' END AS change, dense_rank, bm25_rank, chunk_rank, rrf, chunk_rank <= 5 AS kept, coalesce(rrf = cut, false) AS tied FROM w JOIN k USING (query_id, path) LEFT JOIN z USING (query_id) WHERE coalesce(dense_rank <= 4, false) <> coalesce(now <= 4, false)""")
def fusion_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as files: what fusing two settings of BM25 drops and gains among the first four."""
    places = docs(spark, sf_dir).select(F.col("doc_id").alias("item"), F.col("source").alias("path"))
    a, b = (_hits(spark, sf_dir, 10, *s).join(places, "item").select("query_id", "item", "path", "rank") for s in ((1.5, 0.75), (0.4, 0.0)))
    return R.fusion_changes(a, b, a.unionByName(b), 5, 60, 4)


_FROZEN = """s AS (SELECT doc_id, 'results/' || source || '/doc_' || doc_id || CASE WHEN doc_id % 9 = 8 THEN '.exe' ELSE '.json' END AS path, 'results/' || source AS family, CASE WHEN doc_id % 11 = 10 THEN '{"note": "api_key=abcdefghijklmnop"}'
    ELSE '{"outer": {"steps": 7}, "steps" : ' || CASE WHEN doc_id % 13 = 12 THEN -1 ELSE doc_id END || ', "status": "é ' || coalesce(lang, '') || '"}' END AS content FROM documents),
  g AS (SELECT *, sha256(content) AS sha256, CASE WHEN path LIKE '%.exe' THEN 'type_or_size' WHEN contains(content, 'api_key') THEN 'possible_secret' END AS own FROM s), m AS (SELECT sha256, min(path) AS first FROM g WHERE own IS NULL GROUP BY sha256),
  j AS (SELECT g.*, coalesce(own, CASE WHEN path <> first THEN 'duplicate_content' END) AS reason FROM g LEFT JOIN m USING (sha256))"""


def _snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    steps = F.when(F.col("doc_id") % 13 == 12, "-1").otherwise(i)
    text = F.concat(F.lit('{"outer": {"steps": 7}, "steps" : '), steps, F.lit(', "status": "é '), F.coalesce("lang", F.lit("")), F.lit('"}'))
    content = F.when(F.col("doc_id") % 11 == 10, '{"note": "api_key=abcdefghijklmnop"}').otherwise(text)
    return d.select(F.concat(F.lit("results/"), "source", F.lit("/doc_"), i, F.when(F.col("doc_id") % 9 == 8, ".exe").otherwise(".json")).alias("path"), F.encode(content, "UTF-8").alias("content"))


@CATALOG.add(f"WITH {_FROZEN} SELECT path, sha256, family, reason FROM j")
def snapshot_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.gated(_snapshot_files(spark, sf_dir)).drop("content")


@CATALOG.add(f"""WITH {_FROZEN}, a AS (SELECT path, family, sha256, content, unnest(['steps', 'status']) AS field FROM j WHERE reason IS NULL), b AS (SELECT *, strlen(regexp_extract(content, '^.*"' || field || '" ?: ')) AS start_byte, regexp_extract(content, '^.*"' || field || '" ?: ("[^"]*"|-?[0-9]+)', 1) AS answer FROM a),
  c AS (SELECT *, start_byte + strlen(answer) AS end_byte, substr(sha256(path || ':' || field), 1, 20) AS id, CASE WHEN ('0x' || substr(sha256(family), 1, 8))::BIGINT % 3 = 0 THEN 'dev' ELSE 'test' END AS split FROM b),
  d AS (SELECT *, row_number() OVER (PARTITION BY split, family ORDER BY id) AS depth FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY depth, family) AS turn FROM d)
  SELECT id, family, split, 'For experiment ' || regexp_replace(replace(replace(path, 'results/', ''), '.json', ''), '[_/.-]+', ' ', 'g') || ', what is the ' || field || '?' AS question, field, answer, path, start_byte, end_byte, sha256 FROM e WHERE turn <= 120 OR (split = 'test' AND turn <= 240)""")
def snapshot_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file of each document, all of them frozen; questions in turns over families."""
    files = _snapshot_files(spark, sf_dir)
    return snapshot.freeze(files, n_files=2**31 - 1)[1]


@CATALOG.add()
def settled_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event reserves its value in tenths of a cent and settles two events later at
    half of it; errors never say what they cost."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    reserve = e.select("day", (F.col("event_id") * 2).alias("seq"), F.col("event_id").alias("request"), F.lit("reserve").alias("kind"), (F.col("value") / 1000).alias("usd"))
    settle = e.select("day", (F.col("event_id") * 2 + 5).alias("seq"), F.col("event_id").alias("request"), F.lit("settle").alias("kind"), F.when(F.col("event_type") != "error", F.col("value") / 2000).alias("usd"))
    return ledger.settled(reserve.unionByName(settle), 1.0)


@CATALOG.add("""SELECT * FROM (SELECT n_nationkey AS version, n_name AS name, CASE WHEN n_nationkey IN (7) THEN 'gap' WHEN n_nationkey = 3 THEN 'edited' WHEN n_nationkey < 20 THEN 'applied' ELSE 'pending' END AS status FROM nation
  UNION ALL SELECT -1, NULL, 'unknown')""")
def pending_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("version"), F.col("n_name").alias("name"), F.md5(F.col("n_name").cast("binary")).alias("checksum"))
    applied = files.filter("version < 20 AND version <> 7").select("version", F.when(F.col("version") == 3, "other").otherwise(F.col("checksum")).alias("checksum"))
    return corpus.pending_steps(files, applied.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("version"), F.lit("x").alias("checksum"))))


@CATALOG.add("""WITH u AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o FROM orders), z AS (SELECT o_orderkey % 100 AS query_id, o_orderkey AS seed, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderkey % 7 = 0),
  r AS (SELECT query_id, 'o' || seed AS node, rank * 2 AS pos FROM z UNION ALL SELECT query_id, 'c' || c, rank * 2 + 1 FROM z JOIN u ON seed = o UNION ALL SELECT query_id, 'o' || b.o, rank * 2 + 1 FROM z JOIN u a ON seed = a.o JOIN u b ON a.c = b.c AND b.o <> seed),
  f AS (SELECT query_id, node, min(pos) AS pos FROM r GROUP BY ALL) SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY pos, node) AS position FROM f""")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order as a seed, with its customer and that one's other orders."""
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("placed").alias("kind"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("o_orderkey"))
    seeds = o.filter("o_orderkey % 7 = 0").select((F.col("o_orderkey") % 100).alias("query_id"), "o_orderkey").withColumn("rank", turn)
    return G.expanded(seeds.select("query_id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("seed"), "rank"), edges, 2)


@CATALOG.add("""WITH c AS (SELECT event_id, 'event_type' AS "column", event_type AS cell FROM events UNION ALL SELECT event_id, 'user_id', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'props', CAST(props AS VARCHAR) FROM events),
  f AS (SELECT "column", cell, min(event_id) AS pos FROM c WHERE cell <> '' GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY pos, cell) AS turn FROM f) SELECT "column", list(cell ORDER BY turn) AS sample FROM t WHERE turn <= 4 GROUP BY "column" """)
def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.samples(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"), "event_id")


#: Kinds of evidence, by the label that they must get: what a claim and its evidence change of
#: a fact (subject, field, value, unit, negated, current). ``{n}`` is the variant's number.
_FACT = {"subject": "robot_{n}", "field": "latency", "value": "{n}", "unit": "s", "negated": False, "current": True}
_KINDS = [
    ("supported", {}, [{}]), ("supported", {"value": "{n}000", "unit": "ms"}, [{}]), ("supported", {"value": "{n}e0"}, [{}]), ("supported", {"negated": True}, [{"negated": True}]),
    ("supported", {"field": "on", "value": "true", "unit": ""}, [{"field": "on", "value": "true", "unit": ""}]), ("supported", {"field": "encoder", "value": "e{n}", "unit": ""}, [{"field": "encoder", "value": "e{n}", "unit": ""}]), ("supported", {"subject": "röbot_{n}"}, [{"subject": "röbot_{n}"}]),
    ("conflict", {"value": "{n}1"}, [{}]), ("conflict", {"unit": "m"}, [{}]), ("conflict", {"negated": True}, [{}]), ("conflict", {}, [{"current": False}]), ("conflict", {}, [{}, {"value": "{n}1"}]), ("conflict", {"value": "{n}001", "unit": "ms"}, [{}]),
    ("conflict", {"field": "on", "value": "false", "unit": ""}, [{"field": "on", "value": "true", "unit": ""}]), ("conflict", {"field": "encoder", "value": "f{n}", "unit": ""}, [{"field": "encoder", "value": "e{n}", "unit": ""}]),
    ("unknown", {"subject": "other_{n}"}, [{}]), ("unknown", {"field": "other"}, [{}]), ("unknown", {"unit": "furlongs"}, [{}]), ("unknown", {}, [{"current": None}]), ("unknown", {"value": "NaN"}, [{}]), ("unknown", {}, []),
]


@CATALOG.add("SELECT label AS expected, label AS actual, kinds * (SELECT count(*) FROM documents) AS n FROM (VALUES " + ", ".join(f"('{label}', {sum(k[0] == label for k in _KINDS)})" for label in ("supported", "conflict", "unknown")) + ") AS t(label, kinds)")
def evidence_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels claims of known label get, over kinds of evidence, with each document's number in them."""
    variants = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).cast("string").alias("n"))
    cases, pairs = None, None

    def fact(prefix: str, changes: dict) -> list:
        shown = {k: F.replace(F.lit(v), F.lit("{n}"), F.col("n")) if isinstance(v, str) else F.lit(v).cast("boolean") for k, v in (_FACT | changes).items()}
        return [c.alias(f"{prefix}_{k}") for k, c in shown.items()]

    for i, (label, claim, evidence) in enumerate(_KINDS):
        case = variants.select(F.concat(F.lit(f"{i}/"), "n").alias("claim_id"), F.lit(label).alias("expected"))
        cases = case if cases is None else cases.unionByName(case)
        for found in evidence:
            pair = variants.select(F.concat(F.lit(f"{i}/"), "n").alias("claim_id"), *fact("c", claim), *fact("e", found))
            pairs = pair if pairs is None else pairs.unionByName(pair)
    said = X.fact_verdicts(X.compared_facts(pairs))
    return cases.join(said, "claim_id", "left").groupBy("expected", F.coalesce("label", F.lit("unknown")).alias("actual")).agg(F.count("*").alias("n"))
