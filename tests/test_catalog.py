"""Catalog, ingest, server and command line."""

import io
import json
import os

import pytest

from lodestone import cli
from lodestone.embed import HashingEmbedder
from lodestone.errors import ConcurrentChange, CorpusAlreadyExists, CorpusNotFound, DimensionMismatch, EngineError, FileNotIndexed
from lodestone.plans import ingest
from lodestone.plans.catalog import resolve_root
from lodestone.streaming.watch import watch
from lodestone.tools import Server


def test_models_and_corpora(engine, corpus):
    cat = engine.catalog
    assert cat.upsert_model("native", "native", 3)["id"] == cat.upsert_model("native", "native", 9)["id"] == 1
    assert cat.model(1)["dimensions"] == 512 and [r["corpora"] for r in cat.models().collect()] == [1]
    with pytest.raises(CorpusAlreadyExists):
        cat.create_corpus("notes", HashingEmbedder())
    with pytest.raises(CorpusNotFound):
        cat.corpus("none")
    cat.create_corpus("other", HashingEmbedder())
    with pytest.raises(CorpusAlreadyExists):
        cat.update_corpus("other", "notes")
    with pytest.raises(EngineError):
        cat.update_corpus("other")
    cat.update_corpus("other", "more", "text")
    assert [(r["name"], r["description"], r["file_count"]) for r in cat.corpora().collect()] == [("more", "text", 0), ("notes", "short texts", 0)]
    cat.delete_corpus("more")
    assert [r["name"] for r in cat.corpora().collect()] == ["notes"]


def test_index_search_and_refresh(engine, corpus, tmp_path, spark):
    cat, d = engine.catalog, tmp_path / "files"
    d.mkdir()
    (d / "a.txt").write_text("The cat sat on the mat. " * 200)
    (d / "b.md").write_text("# Dogs\nA dog barks.")
    n, warnings = ingest.add(cat, corpus, str(d / "a.txt"))
    assert n == cat.table("chunks").count() == cat.table("embeddings").count() == 3 and warnings == []
    assert ingest.add(cat, corpus, str(d / "b.md"), "dogs", "about dogs")[0] == 1
    assert [(r["path"], r["chunk_count"]) for r in cat.files(corpus).collect()] == [(str(d / "a.txt"), 3), ("dogs", 1)]
    for mode in ("dense", "lexical", "hybrid"):
        got = engine.search("dog barks", corpus, 2, mode)
        assert got[0]["file"] == "dogs" and got[0]["corpus"] == corpus and got[0]["position"] == 0
    assert engine.search("dog", "all", 1, "hybrid")[0]["file"] == "dogs" and engine.search("!!", corpus, 3, "lexical") == []
    with pytest.raises(CorpusNotFound):
        engine.search("x", "none")
    old = cat.file(corpus, "dogs")["id"]
    os.utime(d / "b.md", (4e9, 4e9))
    assert ingest.refresh(cat, corpus) == {"updated": 1, "removed": 0, "failed": 0}
    assert cat.file(corpus, "dogs")["id"] > old and cat.file(corpus, "dogs")["description"] == "about dogs" and cat.table("embeddings").count() == 4
    (d / "b.md").write_text("  ")
    os.utime(d / "b.md", (5e9, 5e9))
    os.remove(d / "a.txt")
    assert ingest.refresh(cat, corpus) == {"updated": 1, "removed": 1, "failed": 0}
    assert cat.files(corpus).count() == cat.table("chunks").count() == cat.table("embeddings").count() == 0
    cat.compact()
    with pytest.raises(FileNotIndexed):
        ingest.refresh(cat, corpus, "dogs")
    (d / "c.xyz").write_text("?")
    assert ingest.add(cat, corpus, str(d / "c.xyz"))[0] == 0


def test_folder_is_one_entry_or_one_a_file(engine, corpus, tmp_path):
    d = tmp_path / "two"
    d.mkdir()
    (d / "b.txt").write_text("second")
    (d / "a.txt").write_text("first")
    ingest.add(engine.catalog, corpus, str(d))
    assert [r["text"] for r in engine.catalog.table("chunks").collect()] == ["first\n\nsecond"]
    ingest.add(engine.catalog, corpus, str(d), per_file=True)
    assert engine.catalog.files(corpus).count() == 3
    engine.catalog.rename_file(corpus, str(d), "both", "x")
    with pytest.raises(EngineError):
        engine.catalog.rename_file(corpus, "both", str(d / "a.txt"))
    engine.catalog.remove_file(corpus, "both")
    assert engine.catalog.files(corpus).count() == 2


def test_watch(engine, corpus, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("first text")
    for name in ("b", "c"):
        watch(engine.catalog, corpus, str(d), str(tmp_path / "ck")).awaitTermination(120)
        (d / f"{name}.txt").write_text(f"text {name}")
    assert engine.catalog.files(corpus).count() == 2


def test_dimensions_and_root(engine, corpus, spark, monkeypatch, tmp_path):
    class Small(HashingEmbedder):
        dimensions = 8

    entries = spark.createDataFrame([("p", "p", None, 1.0, 1, "text")], "path string, source_path string, description string, mtime double, size long, text string")
    with pytest.raises(DimensionMismatch):
        engine.catalog.put_files(corpus, entries, Small())
    monkeypatch.setenv("LODESTONE_DB", "/x/y")
    assert resolve_root() == "/x/y" and resolve_root("z") == "z"


def test_server(engine, corpus, tmp_path):
    (tmp_path / "a.txt").write_text("the cat")
    ingest.add(engine.catalog, corpus, str(tmp_path / "a.txt"), "a")
    s = Server(engine)

    def call(method, rid=1, **params):
        return s.handle(json.dumps({"jsonrpc": "2.0", "id": rid, "method": method, "params": params}))

    assert call("initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert [t["name"] for t in call("tools/list")["result"]["tools"]] == ["list_corpora", "search", "list_files"]
    text = lambda r: r["result"]["content"][0]["text"]
    assert text(call("tools/call", name="list_corpora")) == "• notes: short texts [1 files, 1 chunks]"
    assert text(call("tools/call", name="list_files", arguments={"corpus": "notes"})) == "• a (1 chunks)"
    assert text(call("tools/call", "x", name="search", arguments={"corpus": "notes", "query": "cat"})).startswith("[1] a (score: 0.")
    assert [call(*a, **b)["error"]["code"] for a, b in ((("none",), {}), (("tools/call",), {}), (("tools/call",), {"name": "no"}), (("tools/call",), {"name": "search"}), (("tools/call",), {"name": "search", "arguments": {"corpus": "all", "query": "x"}}))] == [-32601, -32602, -32601, -32603, -32603]
    assert s.handle("{")["error"]["code"] == -32700 and s.handle('{"method": "x"}') is None
    out = io.StringIO()
    s.run(io.StringIO('\n{"id": 1, "method": "initialize"}\n'), out)
    assert json.loads(out.getvalue())["id"] == 1


def test_command_line(engine, tmp_path):
    def run(*argv):
        return cli.run(cli.parser().parse_args(argv), engine)

    (tmp_path / "a.txt").write_text("the cat sat")
    assert run("corpus", "list") == "No corpora." and run("corpus", "list", "--format", "json") == "[]"
    run("corpus", "create", "c", "--description", "d")
    assert run("index", "add", str(tmp_path / "a.txt"), "--corpus", "c") == "Indexed 1 chunks."
    assert run("corpus", "list") == "• c — d [1 files, 1 chunks]"
    assert json.loads(run("corpus", "info", "c", "--format", "json")) == {"name": "c", "description": "d", "model": "native", "dimensions": 512, "fileCount": 1, "chunkCount": 1}
    assert "(corpus: c, score: 1.000)" in run("search", "the cat sat", "--corpus", "c")
    assert json.loads(run("search", "cat", "--corpus", "all", "--mode", "hybrid", "--format", "json"))[0]["text"] == "the cat sat"
    assert run("index", "rename", str(tmp_path / "a.txt"), "--corpus", "c", "--name", "n") and "• n (1 chunks)" == run("index", "list", "--corpus", "c")
    assert run("index", "refresh", "--corpus", "c") == "0 updated, 0 removed, 0 failed."
    assert "native" in run("model", "list") and run("index", "remove", "n", "--corpus", "c") and run("corpus", "delete", "c")


def test_every_failed_file_is_reported(engine, corpus, tmp_path):
    for i in range(1003):
        (tmp_path / f"f{i:04}.pdf").write_bytes(b"no pdf")
    n, warnings = ingest.add(engine.catalog, corpus, str(tmp_path), per_file=True)
    assert n == 0 and sum(".pdf: " in w for w in warnings) == 1003


def test_one_of_two_changes_at_once_is_refused(engine, corpus):
    cat = engine.catalog
    stale = cat._state()
    cat.update_corpus(corpus, description="first")
    with pytest.raises(ConcurrentChange):
        cat._commit(stale, {"corpora": cat.table("corpora").limit(0)})
    assert [r["description"] for r in cat.corpora().collect()] == ["first"]
    for k in range(25):
        cat._publish(cat._state())
    assert len(cat._versions()) == 20 and cat.corpus(corpus)["description"] == "first"


def test_index_in_the_catalog(engine, corpus, spark):
    """Postings give the scores of the texts, also after changes and compaction; vectors lie by corpus."""
    from pyspark.sql import functions as F

    from lodestone.operators import bm25

    cat = engine.catalog
    cat.create_corpus("other", HashingEmbedder())
    kind = "path string, source_path string, description string, mtime double, size long, text string"
    entry = lambda *rows: spark.createDataFrame([(p, p, None, 1.0, len(t), t) for p, t in rows], kind)
    cat.put_files(corpus, entry(("a", "the cat sat " * 400), ("b", "a dog and the cat"), ("c", "gone dog cat")), HashingEmbedder())
    cat.put_files("other", entry(("a", "cat, cat and dog"), ("d", "Čarobnjak !")), HashingEmbedder())
    cat.put_files(corpus, entry(("b", "the dog barks")), HashingEmbedder())
    cat.remove_file(corpus, "c")
    for compacted in (False, True):
        if compacted:
            cat.compact()
        texts = cat.table("chunks").select(F.col("id").alias("chunk_id"), "text")
        want = {r["chunk_id"]: r["score"] for r in bm25.scores(texts, "cat dog the carobnjak").collect()}
        got = {r["chunk_id"]: r["score"] for r in bm25.index_scores(cat.table("postings"), cat.index_size(), "cat dog the carobnjak").collect()}
        assert got == pytest.approx(want) and len(got) > 4
        own = cat.corpus("other")["id"]
        assert all(f"/corpus={own}/" in f for f in cat.table("embeddings", own).inputFiles() if "/embeddings/" in f)
        assert {r["corpus_id"] for r in cat.table("embeddings", own).collect()} == {own} and cat.table("embeddings", own).count() == 2
        assert [r["file"] for r in engine.search("cat", "other", 3, "lexical")] == ["a"]


def test_refresh_of_many_entries_is_one_commit(engine, corpus, tmp_path):
    d = tmp_path / "many"
    (d / "sub").mkdir(parents=True)
    for i in range(12):
        (d / ("sub" if i % 2 else ".") / f"f{i}.txt").write_text(f"text {i}")
    ingest.add(engine.catalog, corpus, str(d), per_file=True)
    ingest.add(engine.catalog, corpus, str(d / "sub"), "folder")
    for i in (0, 1, 2):
        f = d / ("sub" if i % 2 else ".") / f"f{i}.txt"
        f.write_text(f"new {i}")
        os.utime(f, (4e9, 4e9))
    (d / "f4.txt").unlink()
    os.utime(d / "sub", (4e9, 4e9))
    version = engine.catalog._state()["version"]
    assert ingest.refresh(engine.catalog, corpus) == {"updated": 4, "removed": 1, "failed": 0}
    assert engine.catalog._state()["version"] == version + 1
    texts = {r["text"] for r in engine.catalog.table("chunks").collect()}
    assert {"new 0", "new 1", "new 2"} <= texts and "text 4" not in texts and any(t.startswith("new 1\n\n") or "\n\nnew 1" in t for t in texts)
    assert ingest.refresh(engine.catalog, corpus) == {"updated": 0, "removed": 0, "failed": 0}


def test_grouped_search_over_models(engine, corpus, spark, monkeypatch):
    from lodestone import embed

    class Small(HashingEmbedder):
        source, identifier, dimensions = "hf", "x/small", 32

    monkeypatch.setitem(embed._REGISTRY, "hf", lambda identifier: Small())
    kind = "path string, source_path string, description string, mtime double, size long, text string"
    engine.catalog.create_corpus("small", Small())
    engine.catalog.put_files(corpus, spark.createDataFrame([("a", "a", None, 1.0, 1, "the cat sat"), ("b", "b", None, 1.0, 1, "a dog")], kind), HashingEmbedder())
    engine.catalog.put_files("small", spark.createDataFrame([("c", "c", None, 1.0, 1, "the cat ran"), ("d", "d", None, 1.0, 1, "no match")], kind), Small())
    for mode in ("dense", "lexical", "hybrid"):
        got = engine.search("the cat", "all", 1, mode)
        assert [(name, [r["file"] for r in rows]) for name, rows in got] == [("notes", ["a"]), ("small", ["c"])], mode


def test_rows_without_a_required_column_are_left_out(engine, corpus, spark):
    cat = engine.catalog
    kind = "path string, source_path string, description string, mtime double, size long, text string"
    cat.put_files(corpus, spark.createDataFrame([("a", "a", None, 1.0, 1, "one text")], kind), HashingEmbedder())
    ids = [r["id"] for r in cat.chunk_ids(corpus, "a").collect()]
    assert [cat.chunk(i)["text"] for i in ids] == ["one text"] and cat.chunk(99) is None
    from pyspark.sql import functions as F

    state = cat._state()
    files = cat._read(state, "files")
    cat._commit(state, {"files": files.unionByName(files.withColumns({"id": F.lit(77).cast("long"), "path": F.lit(None).cast("string")}))})
    assert cat._read(cat._state(), "files").count() == 2 and cat.files(corpus).count() == 1
