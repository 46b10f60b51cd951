"""Winnowing against a direct version of its definition."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import winnow


def gram_hash(text, i, k):
    return xxhash.xxh64(text[i:i + k].encode("utf-32-be"), seed=42).intdigest() & 0xFFFFFFFF


def brute(text, k=winnow.K, w=winnow.W):
    """(position, hash) of the selected grams by the definition."""
    n = max(len(text) - k + 1, 1) if text else 0
    h = [gram_hash(text, i, k) for i in range(n)]
    picked = set()
    for a in range(max(n - w + 1, min(n, 1))):
        window = h[a:a + w]
        low = min(window)
        picked.add(a + max(i for i, x in enumerate(window) if x == low))
    return [(i, h[i]) for i in sorted(picked)]


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_selection_equals_definition(spark):
    texts = ["", "abc", "x" * 200, "The quick brown fox jumps over the lazy dog. " * 3, "é\U0001f600ab" * 40, "".join(chr(97 + (i * i) % 23) for i in range(2500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(winnow.fingerprints(df))
    for i, t in enumerate(texts):
        assert list(zip(got[i]["positions"], got[i]["hashes"])) == brute(t), t[:20]
    for k, w in ((5, 4), (1, 3), (13, 1)):
        got = rows_of(winnow.fingerprints(df, k, w))
        assert all(list(zip(got[i]["positions"], got[i]["hashes"])) == brute(t, k, w) for i, t in enumerate(texts))


def test_edited_fingerprint_equals_that_of_the_edited_text(spark, odd_documents, documents):
    for docs in (odd_documents, documents.limit(60)):
        got = winnow.compared_with_next(docs, rows=7).withColumn("again", winnow.selected(F.col("edited"))).collect()
        assert len(got) == docs.count()
        assert all(r["edited_sel"] == r["again"] for r in got)
    got = rows_of(winnow.compared_with_next(documents, rows=50))
    pdf = documents.toPandas().sort_values("doc_id").reset_index(drop=True)
    for i, (d, t) in enumerate(zip(pdf.doc_id, pdf.text)):
        nxt, q = pdf.text[(i + 1) % len(pdf)], len(t) // 4
        want = t[:len(t) - q] + nxt[:q]
        assert hashlib.sha256(got[d]["edited"].encode()).digest() == hashlib.sha256(want.encode()).digest()
        assert got[d]["n_chars"] == len(t) and 0 <= got[d]["near_next"] <= 1
    whole = rows_of(documents.select("doc_id", winnow.selected(F.col("text")).alias("s")))
    assert all(whole[d]["s"] == got[d]["sel"] for d in got)


def test_ids_of_many_rows(spark):
    """Ids that a third of all rows share, and null ids, are dealt over several buckets in their order."""
    rows = [(i if i < 40 else 17 if i < 80 else None, f"text {i} " * 6) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    h = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    got = winnow.compared_with_next(docs, rows=5).collect()
    edited = lambda t, n: t[:len(t) - len(t) // 4] + n[:len(t) // 4]
    want = sorted((str(d), edited(t, order[(i + 1) % len(order)][1])) for i, (d, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited"]) for r in got) == want
    ids = docs.select("doc_id", F.xxhash64("text").alias("h"))
    b = ids.withColumn("b", winnow._bucket(F.col("doc_id"), F.col("h"), *winnow._bounds(ids, 5))).groupBy("b").count()
    assert b.agg(F.max("count")).first()[0] <= 20


def test_empty_table_and_single_row(spark, odd_documents):
    assert winnow.compared_with_next(odd_documents.limit(0)).count() == 0
    one = winnow.compared_with_next(odd_documents.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_a_shared_passage_shares_a_hash(spark):
    passage = "this passage is as long as the guarantee asks for"
    df = spark.createDataFrame([(1, "some text before " * 4 + passage + " and 1 after" * 5), (2, "unrelated " * 9 + passage + "?" * 30)], "doc_id long, text string")
    a, b = (set(r["hashes"]) for r in winnow.fingerprints(df).collect())
    assert a & b


def test_query_equals_definition(spark, documents):
    from lodestone.llm import queries

    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()))
    got = rows_of(queries.op1_winnowing(spark, "/root/testdata/sf0.001"))
    assert len(got) == len(rows)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i in [*range(0, len(rows), 9), len(rows) - 1]:
        (d, t), (_, following) = rows[i], rows[(i + 1) % len(rows)]
        if len(t) > 4000:
            continue
        q = len(t) // 4
        edited = t[:len(t) - q] + following[:q]
        own, other, after = brute(t), brute(edited), brute(following)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{h:08x}" for _, h in own) and r["positions"] == [p for p, _ in own]
        assert r["edited_fingerprint"] == "".join(f"{h:08x}" for _, h in other) and r["edited_positions"] == [p for p, _ in other]
        sets = [{h for _, h in x} for x in (own, other, after)]
        assert r["near_edited"] == pytest.approx(alike(sets[0], sets[1])) and r["near_next"] == pytest.approx(alike(sets[0], sets[2]))
