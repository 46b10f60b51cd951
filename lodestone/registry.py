"""Queries of the retrieval engine on the fixture tables, each with SQL that gives the same rows.

documents are files, their source the corpus; embeddings are vectors, their label the corpus; a document
and a vector with one id belong together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cli, embed, errors, tokenizers
from .engine import Engine
from .functions import fts, markup, text
from .operators import bm25, chunk, fusion, search, vectors
from .plans import catalog
from .sources import convert
from .tools import Server

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS, SCOPE, QUERY_VEC = "licensed apache the eau", "src3", 7
BUDGET, OVERLAP = chunk.budget(512)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("corpus"), "text")


def _vectors(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("corpus"), "embedding")


def _query_vector(spark, sf, vec_id: int = QUERY_VEC) -> list[float]:
    return list(_t(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- lexical -------------------------------------------------------------------------------------
def bm25_sql(words: str, name: str = "bm", table: str = "documents") -> str:
    """Common table expressions that end in ``name(id, corpus, score)`` of all rows of a table (doc_id, source,
    text) with a term."""
    return rf"""
{name}_tok AS (SELECT doc_id AS id, source AS corpus, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+')) AS t FROM {table}),
{name}_len AS (SELECT d.doc_id AS id, count(t.t) AS len FROM {table} d LEFT JOIN {name}_tok t ON t.id = d.doc_id GROUP BY d.doc_id),
{name}_st AS (SELECT count(*) AS ndoc, sum(len) / count(*) AS av FROM {name}_len),
{name}_q AS (SELECT t, count(*) AS qn FROM (SELECT unnest(regexp_extract_all(strip_accents(lower('{words}')), '[\p{{L}}\p{{N}}]+')) AS t) GROUP BY t),
{name}_tf AS (SELECT id, corpus, t, count(*) AS f FROM {name}_tok SEMI JOIN {name}_q USING (t) GROUP BY ALL),
{name}_df AS (SELECT t, count(*) AS df FROM {name}_tf GROUP BY t),
{name}_w AS (SELECT t, qn, CASE WHEN ln((ndoc - df + 0.5) / (df + 0.5)) > 0 THEN ln((ndoc - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM {name}_q JOIN {name}_df USING (t), {name}_st),
{name} AS (SELECT id, corpus, sum(qn * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) AS score FROM {name}_tf JOIN {name}_w USING (t) JOIN {name}_len USING (id), {name}_st GROUP BY id, corpus)"""


@query(f"WITH {bm25_sql(WORDS)} SELECT id AS chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def lexical_search(spark, sf):
    return _rounded(bm25.search(_docs(spark, sf), WORDS, 10), "score")


@query(f"WITH {bm25_sql(WORDS)} SELECT id AS chunk_id, round(score, 6) AS score FROM bm WHERE corpus = '{SCOPE}' ORDER BY bm.score DESC, id LIMIT 10")
def lexical_scoped(spark, sf):
    return _rounded(bm25.search(_docs(spark, sf), WORDS, 10, F.col("corpus") == SCOPE, extra=("corpus",)).drop("corpus"), "score")


@query(f"WITH {bm25_sql('license license apache')} SELECT id AS chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def lexical_repeated_terms(spark, sf):
    return _rounded(bm25.search(_docs(spark, sf), "license, LICENSE apache", 10), "score")


@query("SELECT doc_id AS chunk_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def lexical_no_terms(spark, sf):
    return bm25.search(_docs(spark, sf), " ... !? ", 10)


@query(f"WITH {bm25_sql(WORDS)} SELECT id AS chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def lexical_postings(spark, sf):
    return _rounded(bm25.search_postings(*bm25.build_postings(_docs(spark, sf)), WORDS, 10), "score")


@query(r"""SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM
(SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS t FROM documents) GROUP BY t""")
def index_terms(spark, sf):
    own = _t(spark, sf, "documents").select("doc_id", F.explode(fts.tokens(F.col("text"))).alias("term"))
    return own.groupBy("term", "doc_id").agg(F.count("*").alias("f")).groupBy("term").agg(F.sum("f").alias("n"), F.count("*").alias("docs"))


@query(r"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'), lambda x: '"' || x || '"'), ' OR ') AS match FROM benchmark""")
def fts_match_query(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", fts.match_expression(F.col("text")).alias("match"))


# -- chunks --------------------------------------------------------------------------------------
def chunk_sql(size: int, overlap: int, before: str = "", table: str = "documents") -> str:
    w = size // 5
    return rf"""WITH RECURSIVE {before} c AS (SELECT doc_id, text, length(text) AS n, 0 AS s, -1 AS e FROM {table}
UNION ALL SELECT doc_id, text, n, ns, CASE WHEN ns + {size} >= n THEN n
  WHEN instr(rw, chr(10) || chr(10)) > 0 THEN ss + {w} - instr(rw, chr(10) || chr(10)) + 1
  WHEN instr(rw, chr(10)) > 0 THEN ss + {w} - instr(rw, chr(10)) + 1
  WHEN regexp_matches(w, '[.!?] ') THEN ss + {w} - 1 - length(regexp_extract(rw, '(?s)^(.*?) [.!?]', 1)) ELSE ns + {size} END
  FROM (SELECT *, reverse(w) AS rw FROM (SELECT *, substr(text, ss + 1, {w}) AS w FROM (SELECT *, ns + {size} - {w} AS ss FROM
    (SELECT doc_id, text, n, CASE WHEN e < 0 THEN 0 ELSE e - {overlap} END AS ns FROM c WHERE e < n))))),
t AS (SELECT doc_id, s, e, regexp_replace(substr(text, s + 1, e - s), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text FROM c WHERE e >= 0),
chunks AS (SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS position, s::INTEGER AS start_offset, e::INTEGER AS end_offset FROM t WHERE text <> '')"""


@query(chunk_sql(BUDGET, OVERLAP) + " SELECT * FROM chunks")
def chunk_text(spark, sf):
    return chunk.chunk_table(_t(spark, sf, "documents"), BUDGET, OVERLAP)


@query(chunk_sql(2048, 205) + " SELECT * FROM chunks")
def chunk_legacy_2048(spark, sf):
    return chunk.chunk_table(_t(spark, sf, "documents"), chunk.LEGACY_BUDGET, chunk.LEGACY_OVERLAP)


@query(chunk_sql(BUDGET, OVERLAP) + " SELECT source AS corpus, count(*) AS chunks, count(DISTINCT c.doc_id) AS files FROM chunks c JOIN documents d USING (doc_id) GROUP BY source")
def chunk_counts(spark, sf):
    n = _t(spark, sf, "documents").select("source", F.size(chunk.chunks(F.col("text"), BUDGET, OVERLAP)).alias("n")).filter("n > 0")
    return n.groupBy(F.col("source").alias("corpus")).agg(F.sum("n").alias("chunks"), F.count("*").alias("files"))


# -- vectors -------------------------------------------------------------------------------------
_DIST = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _knn_sql(where: str = "", k: int = 10) -> str:
    return f"""SELECT vec_id, round(d, 6) AS distance, round(greatest(0, 1 - d * d / 2), 6) AS score FROM (SELECT e.vec_id, {_DIST} AS d
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VEC}) q {where} ORDER BY d, e.vec_id LIMIT {k})"""


@query(_knn_sql())
def knn_dense(spark, sf):
    return _rounded(vectors.knn(_t(spark, sf, "embeddings"), _query_vector(spark, sf), 10), "distance", "score")


@query(_knn_sql("WHERE e.label = 3"))
def knn_scoped(spark, sf):
    return _rounded(vectors.knn(_t(spark, sf, "embeddings"), _query_vector(spark, sf), 10, F.col("label") == 3), "distance", "score")


@query(f"""SELECT query_id, vec_id, rank::INTEGER AS rank, round(d, 6) AS distance, round(greatest(0, 1 - d * d / 2), 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS d
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""")
def knn_batch_topk(spark, sf):
    e = _t(spark, sf, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _rounded(vectors.batch_knn(e, queries, 5), "distance", "score")


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, 1 - {_DIST} * {_DIST} / 2), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id < 5")
def score_clamp(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = e.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return e.join(F.broadcast(q)).select("query_id", "vec_id", F.round(vectors.score(vectors.distance(F.col("embedding"), F.col("query"))), 6).alias("score"))  # five stated queries


@query("""SELECT vec_id, i::INTEGER AS dim, round(CASE WHEN vec_id = 0 THEN 0 ELSE v[i + 1] * 3 / n END, 6) AS value FROM
(SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x))) AS n, unnest(range(0, len(embedding))) AS i FROM embeddings)""")
def normalize_vectors(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") == 0, 0.0).otherwise(3.0))
    return _t(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.normalize(scaled)).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("""SELECT label, i::INTEGER AS dim, round(avg(v[i + 1]), 6) AS value FROM (SELECT label, embedding::DOUBLE[] AS v, unnest(range(0, len(embedding))) AS i
FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY label, i""")
def mean_pool_by_label(spark, sf):
    return _rounded(vectors.mean_pool(_t(spark, sf, "embeddings"), "label", mask=F.col("vec_id") % 3 != 0), "value")


@query("""SELECT label, i::INTEGER AS dim, round(avg(v[i + 1]), 6) AS value FROM (SELECT label, embedding::DOUBLE[] AS v, unnest(range(0, len(embedding))) AS i
FROM embeddings) GROUP BY label, i""")
def mean_pool_all_by_label(spark, sf):
    return _rounded(vectors.mean_pool(_t(spark, sf, "embeddings"), "label"), "value")


# -- fusion and composite search -----------------------------------------------------------------
def _dense_sql(name: str, k: int = 50, vec: int = QUERY_VEC, order: str = "d") -> str:
    return f"""{name} AS (SELECT id, s AS score, row_number() OVER (ORDER BY {order}, id) AS rank FROM (SELECT e.vec_id AS id, {_DIST} AS d, greatest(0, 1 - {_DIST} * {_DIST} / 2) AS s
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) q ORDER BY d, e.vec_id LIMIT {k}))"""


_LEX = f"{bm25_sql(WORDS)}, lx AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 50))"
_FUSED = "SELECT id AS chunk_id, round(sum(1 / (60 + rank)), 6) AS score FROM ({}) GROUP BY id ORDER BY sum(1 / (60 + rank)) DESC, id LIMIT 10"


def _dense_list(spark, sf, no: int, vec: int = QUERY_VEC) -> DataFrame:
    return fusion.ranked(vectors.knn(_vectors(spark, sf), _query_vector(spark, sf, vec), 50, vec_id="chunk_id"), no, "chunk_id", "distance", ascending=True)


@query(f"WITH {_LEX}, {_dense_sql('dn')} " + _FUSED.format("SELECT id, rank FROM dn UNION ALL SELECT id, rank FROM lx"))
def hybrid_rrf(spark, sf):
    lexical = fusion.ranked(bm25.search(_docs(spark, sf), WORDS, 50), 1, "chunk_id")
    return _rounded(fusion.fuse([_dense_list(spark, sf, 0), lexical], 10, "chunk_id"), "score")


@query(f"WITH {_LEX} SELECT id AS chunk_id, round(score, 6) AS score FROM lx ORDER BY lx.score DESC, id LIMIT 10")
def rrf_passthrough(spark, sf):
    lexical = fusion.ranked(bm25.search(_docs(spark, sf), WORDS, 50), 1, "chunk_id")
    return _rounded(fusion.fuse([_dense_list(spark, sf, 0).filter("rank < 0"), lexical], 10, "chunk_id"), "score")


@query(f"WITH {_LEX}, {_dense_sql('dn')}, {_dense_sql('d2', vec=11)} " + _FUSED.format("SELECT id, rank FROM dn UNION ALL SELECT id, rank FROM lx UNION ALL SELECT id, rank FROM d2"))
def rrf_three_lists(spark, sf):
    lexical = fusion.ranked(bm25.search(_docs(spark, sf), WORDS, 50), 1, "chunk_id")
    return _rounded(fusion.fuse([_dense_list(spark, sf, 0), lexical, _dense_list(spark, sf, 2, 11)], 10, "chunk_id"), "score")


@query(f"WITH {_LEX}, {_dense_sql('dn', order='s DESC')} " + _FUSED.format("SELECT id, rank FROM dn UNION ALL SELECT id, rank FROM lx"))
def search_all_shared(spark, sf):
    return _rounded(search.search(search.lexical_scores(_docs(spark, sf), WORDS), _vectors(spark, sf), _query_vector(spark, sf), 10, "hybrid"), "score")


@query(f"WITH {bm25_sql(WORDS)} SELECT id AS chunk_id, round(score, 6) AS score FROM bm WHERE corpus = '{SCOPE}' ORDER BY bm.score DESC, id LIMIT 5")
def search_one_lexical(spark, sf):
    return _rounded(search.search(search.lexical_scores(_docs(spark, sf), WORDS, SCOPE), None, None, 5, "lexical", SCOPE), "score")


@query(f"""WITH {bm25_sql(WORDS)}, vc AS (SELECT e.vec_id AS id, 'src' || e.label AS corpus, {_DIST} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VEC}) q),
l AS (SELECT corpus, id, row_number() OVER (PARTITION BY corpus ORDER BY d, id) AS rank, greatest(0, 1 - d * d / 2) AS own, 0 AS no FROM vc
UNION ALL SELECT corpus, id, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, id), score, 1 FROM bm),
p AS (SELECT *, count(DISTINCT no) OVER (PARTITION BY corpus) AS lists FROM l WHERE rank <= 50),
s AS (SELECT corpus, id, CASE WHEN max(lists) = 1 THEN min(own) ELSE sum(1 / (60 + rank)) END AS score FROM p GROUP BY corpus, id)
SELECT corpus, id AS chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""")
def search_all_grouped(spark, sf):
    v = _vectors(spark, sf).withColumn("corpus", F.concat(F.lit("src"), "corpus"))
    return _rounded(search.search_grouped(search.lexical_scores(_docs(spark, sf), WORDS), [(v, _query_vector(spark, sf))], 5, "hybrid"), "score")


@query(f"""WITH {bm25_sql(WORDS)} SELECT id AS chunk_id, 'f' || id AS path, d.source AS corpus, round(s.score, 4) AS score FROM
(SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 5) s JOIN documents d ON d.doc_id = s.id""")
def search_with_paths(spark, sf):
    d = _t(spark, sf, "documents")
    chunks = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), "text", F.lit(0).alias("position"))
    files = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), "doc_id").alias("path"), F.col("source").alias("corpus_id"))
    corpora = d.select(F.col("source").alias("id"), F.col("source").alias("name")).distinct()
    found = bm25.search(_docs(spark, sf), WORDS, 5)
    return search.with_texts(found, chunks, files, corpora).select("chunk_id", "path", "corpus", F.round(F.col("score").cast("double"), 4).alias("score"))


# -- catalog -------------------------------------------------------------------------------------
def _corpora(spark, sf) -> DataFrame:
    """Sources as corpora, and one corpus without a file; models by the number in the name."""
    own = _t(spark, sf, "documents").select("source").distinct().withColumn("no", F.regexp_extract("source", r"(\d+)", 1).cast("long"))
    empty = spark.createDataFrame([("empty", 99)], "source string, no long")
    return own.unionByName(empty).select(F.col("no").alias("id"), F.col("source").alias("name"), F.when(F.col("no") % 2 == 0, F.concat(F.lit("about "), "source")).alias("description"), (F.col("no") % 3).alias("model_id"))


def _files(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("corpus_id"), F.concat(F.lit("/d/"), "doc_id").alias("path"), F.ceil(F.col("n_chars") / 1000).cast("int").alias("chunk_count"), F.col("n_chars").cast("double").alias("mtime"))


def _models(spark) -> DataFrame:
    return spark.createDataFrame([(0, "native", "native", 512), (1, "hf", "owner/small", 384), (2, "local", "/m/x", 64), (3, "hf", "owner/unused", 768)], "id long, source string, identifier string, dimensions int")


_CAT = r"""src AS (SELECT DISTINCT source, regexp_extract(source, '(\d+)', 1)::BIGINT AS no FROM documents UNION ALL SELECT 'empty', 99),
corpora AS (SELECT no AS id, source AS name, CASE WHEN no % 2 = 0 THEN 'about ' || source END AS description, no % 3 AS model_id FROM src),
files AS (SELECT doc_id AS id, regexp_extract(source, '(\d+)', 1)::BIGINT AS corpus_id, '/d/' || doc_id AS path, ceil(n_chars / 1000)::INTEGER AS chunk_count, n_chars::DOUBLE AS mtime FROM documents),
models AS (SELECT * FROM (VALUES (0::BIGINT, 'native', 'native', 512), (1, 'hf', 'owner/small', 384), (2, 'local', '/m/x', 64), (3, 'hf', 'owner/unused', 768)) m(id, source, identifier, dimensions))"""


@query(f"""WITH {_CAT} SELECT c.name, c.description, count(f.id) AS file_count, coalesce(sum(f.chunk_count), 0)::BIGINT AS chunk_count
FROM corpora c LEFT JOIN files f ON f.corpus_id = c.id GROUP BY c.id, c.name, c.description""")
def corpus_list(spark, sf):
    return catalog.corpus_stats(_corpora(spark, sf), _files(spark, sf)).select("name", "description", "file_count", "chunk_count")


@query(f"""WITH {_CAT} SELECT c.name, CASE WHEN m.source = 'native' THEN 'native' ELSE m.source || ':' || m.identifier END AS model, m.dimensions, count(f.id) AS file_count,
coalesce(sum(f.chunk_count), 0)::BIGINT AS chunk_count FROM corpora c LEFT JOIN files f ON f.corpus_id = c.id LEFT JOIN models m ON m.id = c.model_id GROUP BY c.id, c.name, m.source, m.identifier, m.dimensions""")
def corpus_info(spark, sf):
    return catalog.corpus_stats(_corpora(spark, sf), _files(spark, sf), _models(spark)).select("name", "model", "dimensions", "file_count", "chunk_count")


@query(f"WITH {_CAT} SELECT count(*) AS file_count, coalesce(sum(chunk_count), 0)::BIGINT AS chunk_count FROM files WHERE corpus_id = 3")
def corpus_stats(spark, sf):
    return _files(spark, sf).filter("corpus_id = 3").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunk_count"))


@query(f"WITH {_CAT} SELECT path, chunk_count FROM files WHERE corpus_id = 3")
def file_list(spark, sf):
    return _files(spark, sf).filter("corpus_id = 3").orderBy("path").select("path", "chunk_count")


@query(f"WITH {_CAT} SELECT id, path FROM files WHERE corpus_id = 3 AND path = '/d/23'")
def file_lookup(spark, sf):
    return _files(spark, sf).filter("corpus_id = 3 AND path = '/d/23'").select("id", "path").limit(1)


@query(f"WITH {_CAT} SELECT m.id, m.source, m.identifier, m.dimensions, count(c.id) AS corpora FROM models m LEFT JOIN corpora c ON c.model_id = m.id GROUP BY ALL")
def model_usage(spark, sf):
    return catalog.model_usage(_models(spark), _corpora(spark, sf))


@query(f"""WITH {_CAT} SELECT * FROM models UNION ALL SELECT 4 + k, 'local', 'm' || k, 8 FROM (SELECT DISTINCT n_nationkey % 5 AS k FROM nation)""")
def model_upsert(spark, sf):
    new = _t(spark, sf, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("k")).distinct().select((F.col("k") + 4).alias("id"), F.lit("local").alias("source"), F.concat(F.lit("m"), "k").alias("identifier"), F.lit(8).alias("dimensions"))
    again = _models(spark).select((F.col("id") + 100).alias("id"), "source", "identifier", F.lit(1).alias("dimensions"))
    return catalog.insert_or_ignore(_models(spark), new.unionByName(again), ["source", "identifier"])


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def file_upsert(spark, sf):
    return catalog.latest(_t(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query(f"WITH {_CAT} SELECT f.corpus_id, count(*) AS files, count(v.vec_id) AS vectors FROM files f LEFT JOIN embeddings v ON v.vec_id = f.id WHERE f.corpus_id <> 3 GROUP BY f.corpus_id")
def corpus_delete_cascade(spark, sf):
    gone = _corpora(spark, sf).filter("name = 'src3'").select(F.col("id").alias("corpus_id"))
    files = _files(spark, sf).join(F.broadcast(gone), "corpus_id", "left_anti")
    left = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("v")).join(files.select("id"), "id", "left_semi")
    return files.join(left, "id", "left").groupBy("corpus_id").agg(F.count("*").alias("files"), F.count("v").alias("vectors"))


@query(f"WITH {_CAT} SELECT id, CASE WHEN path = '/d/23' THEN 'renamed' ELSE path END AS path FROM files WHERE corpus_id = 3")
def file_rename(spark, sf):
    return _files(spark, sf).filter("corpus_id = 3").select("id", F.when(F.col("path") == "/d/23", "renamed").otherwise(F.col("path")).alias("path"))


_SNAP = """a AS (SELECT user_id AS path, max(epoch_us(ts)) / 1e6 AS mtime FROM events WHERE event_id % 3 <> 0 GROUP BY user_id),
b AS (SELECT user_id AS path, max(epoch_us(ts)) / 1e6 AS mtime FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
p AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'new' WHEN b.mtime > a.mtime THEN 'updated' ELSE 'kept' END AS action FROM a FULL JOIN b ON a.path = b.path)"""


def _plan(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("user_id").alias("path"), "event_id", text.epoch_seconds(F.col("ts")).alias("mtime"))
    snap = lambda keep: e.filter(keep).groupBy("path").agg(F.max("mtime").alias("mtime"))
    return catalog.refresh_plan(snap("event_id % 3 <> 0"), snap("event_id % 2 = 0"))


@query(f"WITH {_SNAP} SELECT path, action FROM p")
def refresh_plan(spark, sf):
    return _plan(spark, sf)


@query(f"WITH {_SNAP} SELECT action, count(*) AS n FROM p GROUP BY action")
def refresh_counters(spark, sf):
    return _plan(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


# -- conversion and text -------------------------------------------------------------------------
@query(r"""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def concat_directory(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("path"), "text")
    return convert.concat_directory(c, ["conv_id"])


_MD = "'# ' || source || chr(10) || '## *' || lang || '* and _' || doc_id || '_' || chr(10) || '> ' || text || chr(10) || '- a [link](http://x/' || doc_id || ') ![i](p.png)' || chr(10) || '1. `code` ' || chr(10) || '---' || chr(10) || '```sql' || chr(10) || 'SELECT 1' || chr(10) || '```'"


@query(f"SELECT doc_id, regexp_replace({markup.duckdb_chain(_MD, markup.MARKDOWN)}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS text FROM documents")
def markdown_strip(spark, sf):
    n = F.lit("\n")
    md = F.concat(F.lit("# "), "source", n, F.lit("## *"), "lang", F.lit("* and _"), "doc_id", F.lit("_"), n, F.lit("> "), "text", n, F.lit("- a [link](http://x/"), "doc_id", F.lit(") ![i](p.png)"), n, F.lit("1. `code` "), n, F.lit("---"), n, F.lit("```sql"), n, F.lit("SELECT 1"), n, F.lit("```"))
    return _t(spark, sf, "documents").select("doc_id", markup.strip_markdown(md).alias("text"))


@query(f"SELECT page_id, regexp_replace({markup.duckdb_chain('html', markup.HTML)}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS text FROM pages")
def html_to_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@query("""SELECT ext, count(*) AS n, CASE WHEN ext IN ('txt', 'md', 'html') THEN 'ok' ELSE 'skipped' END AS status FROM
(SELECT CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'html' ELSE 'xyz' END AS ext FROM documents) GROUP BY ext""")
def convert_dispatch(spark, sf):
    kind = F.when(F.col("doc_id") % 4 == 0, "TXT").when(F.col("doc_id") % 4 == 1, "md").when(F.col("doc_id") % 4 == 2, "Html").otherwise("xyz")
    files = _t(spark, sf, "documents").select(F.concat_ws(".", F.concat(F.lit("/x/f"), "doc_id"), kind).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return convert.convert(files).groupBy(text.extension(F.col("path")).alias("ext"), "status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents")
def decode_bytes(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.decode_text(F.encode("text", "UTF-8")).alias("text"))


@query(r"""SELECT item_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT item_id, regexp_extract_all(lower(text), '[!-/:-@\[-`{-~\p{Po}]|[^\s\p{Z}!-/:-@\[-`{-~\p{Po}]+') AS t FROM benchmark)""")
def bert_basic_tokens(spark, sf):
    t = tokenizers.basic_tokens(F.col("text"))
    return _t(spark, sf, "benchmark").select("item_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query(r"""SELECT item_id, array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN i <= len(t) THEN length(t[i]) ELSE 0 END), ',') AS ids,
array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN i <= len(t) THEN 1 ELSE 0 END), ',') AS mask FROM (SELECT item_id, string_split(text, ' ') AS t FROM benchmark)""")
def pad_truncate(spark, sf):
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    n = F.least(F.size(ids), F.lit(16))
    more = F.array_repeat(F.lit(0), 16 - n)
    return _t(spark, sf, "benchmark").select("item_id", F.array_join(F.concat(F.slice(ids, F.lit(1), n), more).cast("array<string>"), ",").alias("ids"), F.array_join(F.concat(F.array_repeat(F.lit(1), n), more).cast("array<string>"), ",").alias("mask"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Instruct: find it' || chr(10) || 'Query: ' || text ELSE text END AS query FROM benchmark")
def query_instruction(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", text.apply_instruction(F.col("text"), F.when(F.col("item_id") % 2 == 0, "find it").otherwise("")).alias("query"))


_SPECS = ("native", "hf:owner/small", "hf:", "local:/m/x", "other:thing", "")


@query("SELECT * FROM (VALUES ('native', 'native', 'native'), ('hf:owner/small', 'hf', 'owner/small'), ('hf:', NULL, NULL), ('local:/m/x', 'local', '/m/x'), ('other:thing', NULL, NULL), ('', NULL, NULL)) s(spec, source, identifier)")
def model_spec_parse(spark, sf):
    d = spark.createDataFrame([(s,) for s in _SPECS], "spec string").withColumn("p", text.model_spec(F.col("spec")))
    return d.select("spec", "p.source", "p.identifier")


def _parsed_dates(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.when(F.date_trunc("second", "ts") == F.col("ts"), text.sqlite_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).otherwise(F.col("ts")).alias("ts"))


@query("SELECT event_id, ts FROM events WHERE event_id < 500")
def sqlite_date_parse(spark, sf):
    return _parsed_dates(_t(spark, sf, "events").filter("event_id < 500"))


@query("SELECT event_id, ts FROM events")
def sqlite_date_parse_all(spark, sf):
    return _parsed_dates(_t(spark, sf, "events"))


@query("SELECT l_orderkey, l_linenumber, format('{:.3f}', l_discount) AS shown FROM lineitem")
def score_format(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.score_text(F.col("l_discount")).alias("shown"))


# -- tokenizers and embedders: no SQL ------------------------------------------------------------
@query()
def wordpiece_encode(spark, sf):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "th", "##er", "##e", "e", "an", "##nd", "."])}
    return _t(spark, sf, "benchmark").select("item_id", tokenizers.encode(F.col("text"), tokenizers.WordPiece(vocab)).alias("e")).select("item_id", "e.*")


@query()
def bpe_encode(spark, sf):
    letters = sorted(tokenizers.byte_letters().values())
    merges = [("t", "h"), ("th", "e"), ("Ġ", "the"), ("e", "r")]
    vocab = {t: i for i, t in enumerate([*letters, *("".join(m) for m in merges)])}
    return _t(spark, sf, "benchmark").select("item_id", tokenizers.encode(F.col("text"), tokenizers.BytePair(vocab, merges, after=[len(vocab)])).alias("e")).select("item_id", "e.*")


@query()
def embed_hash(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", embed.embed(F.col("text"), embed.HashingEmbedder()).alias("embedding"))


@query()
def windowed_events(spark, sf):
    """Rank of each user's events, as the ordinal of a listing."""
    return _t(spark, sf, "events").withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_id", "user_id", "ordinal")


ORACLE_SQL["windowed_events"] = "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS ordinal FROM events"


# -- a whole catalog of the tables ----------------------------------------------------------------
#: Catalogs that were built, by application and tables.
_ENGINES: dict[tuple[str, str], Engine] = {}


class _SmallEmbedder(embed.HashingEmbedder):
    source, identifier, dimensions = "hf", "registry/small", 64


def _engine(spark, sf) -> Engine:
    """A catalog through all kinds of changes: documents as one corpus, of which every tenth entry is replaced,
    one removed and one renamed; benchmark texts as a corpus that is renamed; nations as one of another model;
    an empty corpus, and one that is deleted with its file."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _ENGINES:
        return _ENGINES[key]
    embed.register("hf", lambda identifier: _SmallEmbedder())
    engine = Engine(spark, catalog.scratch(spark, "registry"))
    cat, big, small = engine.catalog, embed.HashingEmbedder(), _SmallEmbedder()

    def entries(df: DataFrame, path, body) -> DataFrame:
        return df.select(path.alias("path"), path.alias("source_path"), F.lit(None).cast("string").alias("description"), F.lit(1.0).alias("mtime"), F.length(body).cast("long").alias("size"), body.alias("text"))

    d, path = _t(spark, sf, "documents"), F.concat(F.lit("/d/"), "doc_id")
    cat.create_corpus("docs", big, "all documents")
    cat.put_files("docs", entries(d, path, F.col("text")), big)
    cat.create_corpus("notes", big)
    cat.put_files("notes", entries(_t(spark, sf, "benchmark"), F.concat(F.lit("b"), "item_id"), F.col("text")), big)
    cat.put_files("docs", entries(d.filter("doc_id % 10 = 0"), path, F.concat(F.lit("replaced licensed "), "doc_id")), big)
    cat.remove_file("docs", "/d/1")
    cat.rename_file("docs", "/d/2", "renamed", "a name")
    cat.update_corpus("notes", "items", "benchmark texts")
    cat.create_corpus("nations", small)
    cat.put_files("nations", entries(_t(spark, sf, "nation"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("the nation "), "n_name")), small)
    cat.create_corpus("empty", big)
    cat.create_corpus("gone", big)
    cat.put_files("gone", entries(_t(spark, sf, "region"), F.col("r_name"), F.lit("the licensed text that goes")), big)
    cat.delete_corpus("gone")
    _ENGINES[key] = engine
    return engine


#: Entries (batch, corpus, path, text) as that catalog holds them, and their chunks in order of their ids.
_ENTRIES = """ents AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 0 END AS batch, 'docs' AS corpus, '/d/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'replaced licensed ' || doc_id ELSE text END AS text FROM documents WHERE doc_id <> 1
UNION ALL SELECT 1, 'items', 'b' || item_id, text FROM benchmark UNION ALL SELECT 3, 'nations', 'n' || n_nationkey, 'the nation ' || n_name FROM nation),
cur AS (SELECT row_number() OVER (ORDER BY batch, path) AS doc_id, * FROM ents), """
_CHUNKS = chunk_sql(BUDGET, OVERLAP, _ENTRIES, "cur") + """, named AS (SELECT c.*, batch, corpus, path AS old, CASE WHEN path = '/d/2' THEN 'renamed' ELSE path END AS path FROM chunks c JOIN cur USING (doc_id)),
ck AS (SELECT row_number() OVER (ORDER BY doc_id, position) AS doc_id, corpus AS source, path, position, start_offset, end_offset, text FROM named)"""


@query(_CHUNKS + """, n AS (SELECT source, count(DISTINCT path) AS files, count(*) AS chunks FROM ck GROUP BY source),
known(name, description, model, dimensions) AS (VALUES ('docs', 'all documents', 'native', 512), ('items', 'benchmark texts', 'native', 512), ('nations', NULL, 'hf:registry/small', 64), ('empty', NULL, 'native', 512))
SELECT known.*, coalesce(files, 0)::BIGINT AS file_count, coalesce(chunks, 0)::BIGINT AS chunk_count FROM known LEFT JOIN n ON n.source = name""")
def catalog_corpora(spark, sf):
    return _engine(spark, sf).catalog.corpora().select("name", "description", "model", "dimensions", "file_count", "chunk_count")


@query("SELECT * FROM (VALUES (1::BIGINT, 'native', 'native', 512, 3::BIGINT), (2, 'hf', 'registry/small', 64, 1)) m(id, source, identifier, dimensions, corpora)")
def catalog_models(spark, sf):
    return _engine(spark, sf).catalog.models()


@query(_CHUNKS + " SELECT path, CASE WHEN path = 'renamed' THEN 'a name' END AS description, count(*)::INTEGER AS chunk_count FROM ck WHERE source = 'docs' GROUP BY path")
def catalog_files(spark, sf):
    return _engine(spark, sf).catalog.files("docs").select("path", "description", "chunk_count")


@query(_CHUNKS + " SELECT id, path, CASE WHEN path = 'renamed' THEN 'a name' END AS description FROM (SELECT DISTINCT path FROM ck WHERE path IN ('renamed', '/d/20')), (SELECT 'file' AS id)")
def catalog_file(spark, sf):
    """Two entries looked up by corpus and path; one that was renamed can't be found by its old path."""
    cat = _engine(spark, sf).catalog
    rows = [cat.file("docs", path) for path in ("renamed", "/d/20")]
    try:
        rows.append(cat.file("docs", "/d/2"))
    except errors.FileNotIndexed:
        pass
    return spark.createDataFrame([("file", r["path"], r["description"]) for r in rows], "id string, path string, description string")


@query(_CHUNKS + " SELECT position, text FROM ck WHERE path = '/d/3'")
def catalog_chunks_of_file(spark, sf):
    """Chunks of an entry by their ids."""
    cat = _engine(spark, sf).catalog
    ids = cat.chunk_ids("docs", "/d/3")
    return cat.table("chunks").join(ids, "id").select("position", "text")


@query(_CHUNKS + " SELECT source AS corpus, path, position, start_offset, end_offset, text FROM ck")
def catalog_chunks(spark, sf):
    cat = _engine(spark, sf).catalog
    files = cat.table("files").select(F.col("id").alias("file_id"), "path")
    names = cat.table("corpora").select(F.col("id").alias("corpus_id"), F.col("name").alias("corpus"))
    return cat.table("chunks").join(files, "file_id").join(names, "corpus_id").select("corpus", "path", "position", "start_offset", "end_offset", "text")


@query(_CHUNKS + " SELECT source AS corpus, CASE WHEN source = 'nations' THEN 64 ELSE 512 END AS dimensions, count(*) AS vectors FROM ck GROUP BY source")
def catalog_vectors(spark, sf):
    cat = _engine(spark, sf).catalog
    names = cat.table("corpora").select(F.col("id").alias("corpus_id"), F.col("name").alias("corpus"))
    return cat.table("embeddings").join(names, "corpus_id").groupBy("corpus", F.size("embedding").alias("dimensions")).agg(F.count("*").alias("vectors"))


@query(_CHUNKS + r""", tk AS (SELECT source, doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM ck)
SELECT source AS corpus, term, count(*) AS n, count(DISTINCT doc_id) AS chunks FROM tk GROUP BY source, term""")
def catalog_postings(spark, sf):
    cat = _engine(spark, sf).catalog
    names = cat.table("corpora").select(F.col("id").alias("corpus_id"), F.col("name").alias("corpus"))
    return cat.table("postings").join(names, "corpus_id").groupBy("corpus", "term").agg(F.sum("tf").alias("n"), F.count("*").alias("chunks"))


def _found(engine: Engine, *args) -> DataFrame:
    _, df = engine.found(*args)
    return df.select("corpus", "path", "position", F.round(F.col("score").cast("double"), 4).alias("score"))


def _top_sql(k: int, window: str = "", where: str = "") -> str:
    return _CHUNKS + f""", {bm25_sql(WORDS, table="ck")},
got AS (SELECT ck.source AS corpus, ck.path, ck.position, round(bm.score::FLOAT::DOUBLE, 4) AS score, row_number() OVER ({window} ORDER BY bm.score DESC, id) AS r FROM bm JOIN ck ON ck.doc_id = bm.id {where})
SELECT corpus, path, position, score FROM got WHERE r <= {k}"""


@query(_top_sql(10, where="WHERE ck.source = 'docs'"))
def engine_lexical(spark, sf):
    return _found(_engine(spark, sf), WORDS, "docs", 10, "lexical")


@query(_top_sql(4, "PARTITION BY ck.source"))
def engine_lexical_grouped(spark, sf):
    """All corpora, of several models: results of each by itself, in one plan."""
    return _found(_engine(spark, sf), WORDS, "all", 4, "lexical")


@query()
def engine_hybrid(spark, sf):
    return _found(_engine(spark, sf), WORDS, "docs", 10, "hybrid")


@query()
def engine_dense_grouped(spark, sf):
    return _found(_engine(spark, sf), WORDS, "all", 4, "dense")


@query(_CHUNKS + """, n AS (SELECT source, count(DISTINCT path) AS files, count(*) AS chunks FROM ck GROUP BY source),
known(name, description) AS (VALUES ('docs', 'all documents'), ('items', 'benchmark texts'), ('nations', NULL), ('empty', NULL))
SELECT '• ' || name || ': ' || coalesce(description, '(no description)') || ' [' || coalesce(files, 0) || ' files, ' || coalesce(chunks, 0) || ' chunks]' AS line FROM known LEFT JOIN n ON n.source = name""")
def server_list_corpora(spark, sf):
    text = Server(_engine(spark, sf)).handle('{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "list_corpora"}}')["result"]["content"][0]["text"]
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query(_CHUNKS + " SELECT path, count(*) AS chunks FROM ck WHERE source = 'items' GROUP BY path")
def cli_index_list(spark, sf):
    engine = _engine(spark, sf)
    text = cli.run(cli.parser().parse_args(["index", "list", "--corpus", "items", "--format", "json"]), engine)
    return spark.createDataFrame([(text,)], "t string").select(F.inline(F.from_json("t", "array<struct<path: string, chunks: bigint>>")))


@query("SELECT item_id, replace('owner/' || item_id, '/', '--') AS name FROM benchmark")
def model_dir_name(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", text.model_dir_name(F.concat(F.lit("owner/"), "item_id")).alias("name"))
