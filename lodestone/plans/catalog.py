"""Catalog of models, corpora, files, chunks, vectors and a full-text index as Parquet tables.

A snapshot file names the directories of each table; a change writes new directories and then the next
snapshot, by a rename that fails where another change has written it meanwhile.  So a reader sees the state
before or after, a failed change leaves the old one, and of two changes at once one is refused.
models, corpora and files are rewritten as a whole.  chunks, embeddings and postings only grow by a
directory a change, which belongs to one corpus, so a search of one corpus reads its vectors only; what
belongs to a file that is gone is left out by a semi join with files, whose ids are never used again,
until compact() rewrites them.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..embed import Embedder, embed
from ..errors import ConcurrentChange, CorpusAlreadyExists, CorpusNotFound, DimensionMismatch, EngineError, FileNotIndexed
from ..functions import fts
from ..operators import bm25
from ..operators.chunk import budget, chunks as chunk_column
from ..schemas import MODEL_SOURCES, REQUIRED, TABLES

GROWING = ("chunks", "embeddings", "postings")
#: Snapshots that stay, for readers that have just found one.
KEPT_SNAPSHOTS = 20
ENV = "LODESTONE_DB"


def resolve_root(root: str | None = None) -> str:
    """The argument, else the environment, else a folder in the home directory, or here if that can't be made."""
    if given := root or os.environ.get(ENV):
        return given
    home = os.path.join(os.path.expanduser("~"), ".lodestone", "index")
    try:
        os.makedirs(home, exist_ok=True)
        return home
    except OSError:
        return os.path.join(".", ".lodestone", "index")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh place in the folder that the cluster shares (``spark.checkpoint.dir``), or, in local mode without
    one, in a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
        base = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = resolve_root(root).rstrip("/")
        if "://" not in self.root:
            self.root = os.path.abspath(self.root)
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(jvm.Path(f"{self.root}/snapshots"))
        self._context = jvm.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        if not self._versions():
            try:
                self._publish({"version": 0, "tables": {t: [] for t in TABLES}, "next": {"models": 1, "corpora": 1, "files": 1, "chunks": 1}})
            except ConcurrentChange:
                pass  # someone else has just made it

    # -- snapshots -------------------------------------------------------------------------------
    def _snapshot(self, version: int):
        return self._path(f"{self.root}/snapshots/{version:012}.json")

    def _versions(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/snapshots")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _state(self) -> dict:
        stream = self._fs.open(self._snapshot(self._versions()[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """Write the snapshot after the one that state came from; refused where there is one already."""
        state["version"] += 1
        new = self._path(f"{self.root}/snapshots/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            self._context.rename(new, self._snapshot(state["version"]), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise ConcurrentChange() from None
            raise
        for old in self._versions()[:-KEPT_SNAPSHOTS]:
            self._fs.delete(self._snapshot(old), False)

    def _write(self, name: str, df: DataFrame) -> str:
        place = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(place)
        return place

    def _grow(self, name: str, df: DataFrame) -> list[str]:
        """Write rows of a growing table: a directory for each corpus.  Postings lie in order of term, so a
        search reads few row groups."""
        df = df.select(*self._columns(name))
        if name == "postings":
            df = df.repartitionByRange("term").sortWithinPartitions("corpus_id", "term")
        place = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.withColumn("corpus", F.col("corpus_id")).write.partitionBy("corpus").parquet(place)
        return [f"{place}/{f.getPath().getName()}" for f in self._fs.listStatus(self._path(place)) if f.isDirectory() and f.getPath().getName().startswith("corpus=")]

    def staged(self, df: DataFrame) -> DataFrame:
        """df as a written table that cleanup() takes away."""
        return self.spark.read.schema(df.schema).parquet(self._write("staging", df))

    def cleanup(self) -> None:
        """Take away staged tables; not while a change is running."""
        self._fs.delete(self._path(f"{self.root}/staging"), True)

    def _read(self, state: dict, name: str, corpus_id: int | None = None) -> DataFrame:
        places = state["tables"][name]
        if corpus_id is not None and name in GROWING:
            places = [p for p in places if p.endswith(f"/corpus={corpus_id}")]
        return self.spark.read.schema(TABLES[name]).parquet(*places) if places else self.spark.createDataFrame([], TABLES[name])

    def _commit(self, state: dict, rewritten: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> None:
        for name, df in rewritten.items():
            state["tables"][name] = self._grow(name, df) if name in GROWING else [self._write(name, df.select(*self._columns(name)))]
        for name, df in (added or {}).items():
            state["tables"][name] = [*state["tables"][name], *self._grow(name, df)]
        self._publish(state)

    def _columns(self, name: str) -> list[str]:
        return [part.split()[0] for part in TABLES[name].split(", ")]

    def table(self, name: str, corpus_id: int | None = None) -> DataFrame:
        """A table as it stands, without rows that lack a required column: of growing ones the rows of files that
        are there, of one corpus or all."""
        state = self._state()
        df = self._read(state, name, corpus_id).dropna(subset=list(REQUIRED[name]))
        if name not in GROWING:
            return df
        files = self._read(state, "files").select(F.col("id").alias("file_id"))
        return df.join(files, "file_id", "left_semi").select(*self._columns(name))

    def index_size(self) -> DataFrame:
        """Statistics of the full-text index, one row: chunks, and their mean length in tokens."""
        chunks = F.sum("chunk_count")
        return self.table("files").agg(F.coalesce(chunks, F.lit(0)).alias("n"), (F.sum("token_count") / chunks).alias("avgdl"))

    def compact(self) -> None:
        """Rewrite chunks, embeddings and postings without what is gone."""
        state = self._state()
        self._commit(state, {name: self.table(name) for name in GROWING})

    # -- models and corpora ----------------------------------------------------------------------
    def upsert_model(self, source: str, identifier: str, dimensions: int) -> Row:
        """Insert, or the stored row, whose dimensions win."""
        if source not in MODEL_SOURCES:
            source = "native"
        state = self._state()
        models = self._read(state, "models")
        same = (F.col("source") == source) & (F.col("identifier") == identifier)
        if found := models.filter(same).head():
            return found
        row = Row(id=state["next"]["models"], source=source, identifier=identifier, dimensions=dimensions)
        state["next"]["models"] += 1
        self._commit(state, {"models": models.unionByName(self.spark.createDataFrame([row], TABLES["models"]))})
        return row

    def model(self, model_id: int) -> Row | None:
        return self.table("models").filter(F.col("id") == model_id).head()

    def create_corpus(self, name: str, embedder: Embedder, description: str | None = None) -> Row:
        if self.find_corpus(name):
            raise CorpusAlreadyExists(name)
        width = len(embedder.embed_batch(["test"])[0])
        model = self.upsert_model(embedder.source, embedder.identifier, width)
        state = self._state()
        new = self.spark.createDataFrame([(state["next"]["corpora"], name, description, model["id"])], "id long, name string, description string, model_id long").withColumn("created_at", F.current_timestamp())
        state["next"]["corpora"] += 1
        self._commit(state, {"corpora": self._read(state, "corpora").unionByName(new)})
        return self.corpus(name)

    def find_corpus(self, name: str) -> Row | None:
        return self.table("corpora").filter(F.col("name") == name).head()

    def corpus(self, name: str) -> Row:
        if row := self.find_corpus(name):
            return row
        raise CorpusNotFound(name)

    def update_corpus(self, name: str, new_name: str | None = None, description: str | None = None) -> None:
        if new_name is None and description is None:
            raise EngineError("A new name or a description must be given.")
        row = self.corpus(name)
        if new_name is not None and new_name != name and self.find_corpus(new_name):
            raise CorpusAlreadyExists(new_name)
        mine = F.col("id") == row["id"]
        state = self._state()
        changed = self._read(state, "corpora")
        if new_name is not None:
            changed = changed.withColumn("name", F.when(mine, F.lit(new_name)).otherwise(F.col("name")))
        if description is not None:
            changed = changed.withColumn("description", F.when(mine, F.lit(description)).otherwise(F.col("description")))
        self._commit(state, {"corpora": changed})

    def delete_corpus(self, name: str) -> None:
        """The corpus and its files; chunks and vectors go with the files."""
        row = self.corpus(name)
        state = self._state()
        self._commit(state, {"corpora": self._read(state, "corpora").filter(F.col("id") != row["id"]), "files": self._read(state, "files").filter(F.col("corpus_id") != row["id"])})

    # -- listings --------------------------------------------------------------------------------
    def corpora(self) -> DataFrame:
        """name, description, model, dimensions, file_count, chunk_count in order of name."""
        return corpus_stats(self.table("corpora"), self.table("files"), self.table("models"))

    def models(self) -> DataFrame:
        return model_usage(self.table("models"), self.table("corpora"))

    def files(self, corpus: str) -> DataFrame:
        row = self.corpus(corpus)
        return self.table("files").filter(F.col("corpus_id") == row["id"]).orderBy("path")

    def file(self, corpus: str, path: str) -> Row:
        if row := self.files(corpus).filter(F.col("path") == path).head():
            return row
        raise FileNotIndexed(path)

    def chunk(self, chunk_id: int) -> Row | None:
        return self.table("chunks").filter(F.col("id") == chunk_id).head()

    def chunk_ids(self, corpus: str, path: str) -> DataFrame:
        """Ids of an entry's chunks in order of position."""
        row = self.file(corpus, path)
        return self.table("chunks", row["corpus_id"]).filter(F.col("file_id") == row["id"]).orderBy("position").select("id")

    # -- files -----------------------------------------------------------------------------------
    def put_files(self, corpus: str, entries: DataFrame, embedder: Embedder, gone: DataFrame | None = None) -> DataFrame:
        """Insert or replace entries (path, source_path, description, mtime, size, text); returns (path, chunk_count).

        An entry of a known path gets a new id, and its old chunks and vectors go; one whose text is blank, or
        whose path is in gone (path), is taken out.  Chunking and embedding run in Arrow batches; ids follow from sorted entries.
        """
        row = self.corpus(corpus)
        model = self.model(row["model_id"])
        if embedder.dimensions != model["dimensions"]:
            raise DimensionMismatch(model["dimensions"], embedder.dimensions)
        state = self._state()
        size, overlap = budget(embedder.max_input_tokens)
        cut = entries.withColumn("_c", chunk_column(F.col("text"), size, overlap)).drop("text").withColumn("chunk_count", F.size("_c"))
        n_tokens = F.transform("_c", lambda c: F.size(fts.tokens(c["text"])).cast("long"))
        cut = cut.withColumn("token_count", F.aggregate(n_tokens, F.lit(0).cast("long"), lambda a, b: a + b))
        staged = self.staged(cut)
        first = state["next"]["files"]
        known = staged.filter("chunk_count > 0")
        # per entry one small row: numbers are dealt out by sums of partitions, not in one task
        listing = self.staged(self._with_ids(known.select("path", "chunk_count"), first, state["next"]["chunks"]))
        totals = listing.agg(F.count("*").alias("n"), F.sum("chunk_count").alias("c")).first()
        state["next"]["files"] += totals["n"]
        state["next"]["chunks"] += totals["c"] or 0
        files = self._read(state, "files")
        out = staged.select("path") if gone is None else staged.select("path").unionByName(gone.select("path"))
        kept = files.join(out.select("path", F.lit(row["id"]).alias("corpus_id")), ["corpus_id", "path"], "left_anti")
        fresh = known.join(listing.select("path", "id", "chunk_base"), "path")
        new_files = fresh.select("id", F.lit(row["id"]).alias("corpus_id"), "path", "source_path", "description", "mtime", "size", F.col("chunk_count").cast("int").alias("chunk_count"), "token_count", F.current_timestamp().alias("indexed_at"))
        chunks = fresh.select(F.lit(row["id"]).alias("corpus_id"), F.col("id").alias("file_id"), "chunk_base", F.inline("_c")).withColumn("id", F.col("chunk_base") + F.col("position"))
        named = chunks.withColumnRenamed("id", "chunk_id")
        embeddings = named.select("corpus_id", "file_id", "chunk_id", embed(F.col("text"), embedder).alias("embedding"))
        postings, _ = bm25.build_postings(named, extra=("corpus_id", "file_id"))
        self._commit(state, {"files": kept.unionByName(new_files)}, {"chunks": chunks, "embeddings": embeddings, "postings": postings})
        return staged.select("path", "chunk_count")

    def _with_ids(self, rows: DataFrame, first_id: int, first_chunk: int) -> DataFrame:
        """id and chunk_base (the first chunk's id) in order of path, from per-partition sums."""
        ordered = self.staged(rows.repartitionByRange("path").sortWithinPartitions("path").withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)))
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
        base = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.sum("chunk_count").alias("c")).select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_s"))
        own = Window.partitionBy("_p").orderBy("_m")
        inner = F.coalesce(F.sum("chunk_count").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return ordered.withColumn("_i", F.row_number().over(own) - 1).withColumn("_w", inner).join(F.broadcast(base), "_p").select(
            "path", "chunk_count", (F.lit(first_id) + F.col("_n") + F.col("_i")).cast("long").alias("id"), (F.lit(first_chunk) + F.col("_s") + F.col("_w")).cast("long").alias("chunk_base"))

    def remove_file(self, corpus: str, path: str) -> None:
        row = self.file(corpus, path)
        state = self._state()
        self._commit(state, {"files": self._read(state, "files").filter(F.col("id") != row["id"])})

    def rename_file(self, corpus: str, path: str, new_path: str | None = None, description: str | None = None) -> None:
        if new_path is None and description is None:
            raise EngineError("A new path or a description must be given.")
        row = self.file(corpus, path)
        if new_path is not None and new_path != path and self.files(corpus).filter(F.col("path") == new_path).head():
            raise EngineError(f"The corpus has an entry '{new_path}' already.")
        mine = F.col("id") == row["id"]
        state = self._state()
        changed = self._read(state, "files")
        if new_path is not None:
            changed = changed.withColumn("path", F.when(mine, F.lit(new_path)).otherwise(F.col("path")))
        if description is not None:
            changed = changed.withColumn("description", F.when(mine, F.lit(description)).otherwise(F.col("description")))
        self._commit(state, {"files": changed})


# -- plans over tables, used by the catalog and the registry --------------------------------------
def corpus_stats(corpora: DataFrame, files: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Each corpus with its files and chunks counted; corpora without files have zeros."""
    counts = files.groupBy("corpus_id").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunk_count"))
    out = corpora.join(counts, corpora["id"] == counts["corpus_id"], "left").drop("corpus_id")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("file_count", "chunk_count")})
    if models is not None:
        m = models.select(F.col("id").alias("_m"), F.when(F.col("source") == "native", "native").otherwise(F.concat_ws(":", "source", "identifier")).alias("model"), "dimensions")
        out = out.join(m, F.col("model_id") == F.col("_m"), "left").drop("_m")
    return out.orderBy("name")


def model_usage(models: DataFrame, corpora: DataFrame) -> DataFrame:
    """Each model with the number of corpora that use it, zero included."""
    used = corpora.groupBy("model_id").agg(F.count("*").alias("n"))
    out = models.join(used, models["id"] == used["model_id"], "left")
    return out.select("id", "source", "identifier", "dimensions", F.coalesce("n", F.lit(0)).cast("long").alias("corpora")).orderBy("source", "identifier")


def latest(rows: DataFrame, key: list[str], version: str, *ties: str) -> DataFrame:
    """The latest row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version), *[F.desc(t) for t in ties]))
    return rows.withColumn("_r", rank).filter(F.col("_r") == 1).drop("_r")


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(key).join(stored, key, "left_anti"))


def refresh_plan(stored: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    """key and action of each entry: removed (not on disk), updated (newer there), kept, or new."""
    s, d = stored.select(F.col(key), F.col("mtime").alias("_s")), disk.select(F.col(key), F.col("mtime").alias("_d"))
    action = F.when(F.col("_d").isNull(), "removed").when(F.col("_s").isNull(), "new").when(F.col("_d") > F.col("_s"), "updated").otherwise("kept")
    return s.join(d, key, "full_outer").select(key, action.alias("action"))

