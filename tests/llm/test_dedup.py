"""Similarity join, components, repeated strings and lines against brute force."""

import hashlib
import random
import tracemalloc
import uuid
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import bytehash, components as components_module, lines, repeats, similarity
from lodestone.llm.bytehash import shingle_sets
from lodestone.llm.common import small_batches
from lodestone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def find(parent, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(parent, i)] = find(parent, j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(parent, i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return Counter((d, len(s), low.get(find(parent, i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies():
    """A large group of near copies of all degrees, chains, exact copies and a passage that many share."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for _ in range(120):
        t = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            t[rng.randrange(len(t))] = f"n{rng.random()}"
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words) for _ in range(60)) + " " + passage for _ in range(40)]
    texts += [passage, passage + " x", passage.upper(), "", " ", "one", "one", "One two"]
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(25):
        texts.append(" ".join(chain))
        for _ in range(3):
            chain[rng.randrange(100)] = f"c{rng.random()}"
    rng.shuffle(texts)
    return list(enumerate(texts))


def got_components(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_similarity_join(spark, documents, odd_documents):
    for rows in (near_copies(), [(r["doc_id"], r["text"]) for r in documents.collect()], [(r["doc_id"], r["text"]) for r in odd_documents.collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got_components(similarity.near_duplicates(df)) == brute_components(rows)


def test_similarity_join_over_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FRAGMENT", 2000)
    monkeypatch.setattr(similarity, "JOIN_FRAGMENT", 2000)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = similarity.near_duplicates(df)
    assert got_components(out) == brute_components(rows)
    groups = len({c for _, _, c in brute_components(rows)})
    assert out.filter("first").select("component_id").distinct().count() == groups


def test_similarity_join_in_parts(spark, monkeypatch):
    """Fragments cut by sets as well, queries of a cluster in several groups, and many turns."""
    for name, n in (("PART", 20), ("JOIN_FRAGMENT", 300), ("FRAGMENT", 3000), ("TOGETHER", 2), ("SUMMED", 200), ("PACKED", 500), ("SEEDS", 2), ("GROWTH", 2), ("SCAN_BYTES", 20000), ("INCREMENTS", 500)):
        monkeypatch.setattr(similarity, name, n)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_components(similarity.near_duplicates(df)) == brute_components(rows)


def test_few_open_sets_end_the_turns(spark, monkeypatch):
    """What is left after the first turn takes one more where it is little to compare, and else as many as before."""
    turns, inner = [], similarity.links
    monkeypatch.setattr(similarity, "links", lambda *a: turns.append(1) or inner(*a))
    monkeypatch.setattr(similarity, "SEEDS", 2)
    monkeypatch.setattr(similarity, "GROWTH", 2)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_components(similarity.near_duplicates(df)) == brute_components(rows)
    assert len(turns) == 2
    monkeypatch.setattr(similarity, "AT_ONCE", 0)
    assert got_components(similarity.near_duplicates(df)) == brute_components(rows)
    assert len(turns) > 2 + 3


def test_groups_of_the_join_are_bounded(spark, monkeypatch, tmp_path):
    """However many fragments a pair's overlap is cut into, and however many sets a cluster has: partial
    overlaps summed together, and shingles that come to one task, keep their bounds."""
    bounds = {"JOIN_FRAGMENT": 1000, "SUMMED": 1000, "PART": 100, "PACKED": 2000, "INCREMENTS": 2000}
    for name, n in bounds.items():
        monkeypatch.setattr(similarity, name, n)
    seen = str(tmp_path)

    def noted(kind, factory, size):
        def made(*args):
            inner = factory(*args)

            def run(key, pdf):
                with open(f"{seen}/{kind}-{'-'.join(map(str, key))}-{uuid.uuid4().hex}", "w") as out:
                    out.write(str(size(pdf)))
                return inner(key, pdf)

            return run

        return made

    # 48 bytes a partial overlap; 8 a shingle, with some for the set
    monkeypatch.setattr(similarity, "_linked", noted("linked", similarity._linked, lambda pdf: sum(map(len, pdf["payload"])) // 48))
    monkeypatch.setattr(similarity, "_overlaps", noted("overlaps", similarity._overlaps, lambda pdf: sum(map(len, pdf["payload"])) // 8))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for copies in [260] + [4] * 60:
        base = [rng.choice(words) for _ in range(90)]
        for _ in range(copies):
            t = base[:]
            t[rng.randrange(90)] = f"n{rng.random()}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = got_components(similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    sizes = {kind: [int(p.read_text()) for p in tmp_path.glob(f"{kind}-*")] for kind in ("linked", "overlaps")}
    assert got == brute_components(rows)
    # dealt by hashes, so groups vary around the bounds; an entry of _overlaps also has up to seven words on its set
    assert max(sizes["linked"]) < 3 * bounds["SUMMED"] and max(sizes["overlaps"]) < 4 * 7 * bounds["JOIN_FRAGMENT"]


def test_memory_of_the_scan(spark, monkeypatch):
    """A worker that scans holds few bytes for a byte of text, and gets and hands on small batches, in however
    many fragments the shingles are."""

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(similarity, "TaskContext", Task)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(600)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"d": range(2000), "h": range(2000), "t": texts})
    own = shingle_sets(batch.column("t"), 5)
    for i in (0, 700, 1999):  # as alone
        assert own[i].tolist() == shingle_sets(batch.column("t")[i:i + 1], 5)[0].tolist()
    del own
    bytehash._POWERS.clear()
    tracemalloc.start()
    sent = [b.nbytes for b in similarity._scan(Docs(), 1000, 5)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and max(sent) < 1.1 * 2_000_000 < sum(sent), (peak, sent)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    long = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    with small_batches(spark):
        got = [r["size"] for r in long.mapInArrow(sizes, "size long").collect()]
    assert sum(got) > 30e6 and max(got) < 4.5e6


def test_links_grow_with_the_group(spark, monkeypatch):
    """Edges into the components stay below the sets of a group of near copies."""
    seen, inner = [], similarity.links
    monkeypatch.setattr(similarity, "links", lambda sets, marks, *a: seen.append((marks, inner(sets, marks, *a))) or seen[-1][1])
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        t = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            t[rng.randrange(150)] = f"n{rng.random()}"
        texts.append(" ".join(t))
    similarity.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    n = seen[0][0].count()
    assert sum(edges.count() for _, edges in seen) < 1.2 * n


def test_similarity_join_of_nothing(odd_documents):
    assert similarity.near_duplicates(odd_documents.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(500, 500)]
    parent = {v: v for e in edges for v in e}
    for a, b in edges:
        parent[find(parent, a)] = find(parent, b)
    low = defaultdict(lambda: 10**9)
    for v in parent:
        low[find(parent, v)] = min(low[find(parent, v)], v)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: low[find(parent, v)] for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_one_task_and_more_star_steps(spark, monkeypatch):
    writes, inner = [], components_module.written
    monkeypatch.setattr(components_module, "written", lambda *a: writes.append(1) or inner(*a))
    edges = [(i, i + 1) for i in range(300)] + [(400, 400 + i) for i in range(9)] + [(7, 3), (500, 500)]
    random.Random(2).shuffle(edges)
    monkeypatch.setattr(components_module, "ALONE", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a few rows are one task everywhere
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    want = {i: 0 for i in range(301)} | {400 + i: 400 for i in range(9)} | {500: 500}
    try:
        assert {r["node"]: r["component"] for r in components(df).collect()} == want
        assert len(writes) == 2
        monkeypatch.setattr(components_module, "ALONE", 0)
        assert {r["node"]: r["component"] for r in components(df).collect()} == want
        assert len(writes) > 2 + 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[s:s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if count[d[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def repeated_texts():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passage, other = text(500), text(260)
    out = [text(rng.randrange(100, 700)) + passage + text(rng.randrange(300)) for _ in range(25)]
    out += [text(50) + passage[i:i + 230] + text(40) for i in range(0, 270, 30)]
    out += [passage[:199], passage[:200], "x" * 150, "x" * 450, "ab" * 260, "abc" * 90 + other, other + "\0" * 210, other[1:] + other, "", None, passage, passage]
    return out


def test_repeated_strings(spark, documents, odd_documents, monkeypatch):
    for texts in (repeated_texts(), [r["text"] for r in documents.collect()], [r["text"] for r in odd_documents.collect()]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.remove_repeats(df).collect()}
        want = brute_repeats(texts, 200)
        assert [got[i] for i in range(len(texts))] == want


def test_repeated_strings_of_hot_grams_and_many_fragments(spark, monkeypatch):
    texts = repeated_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for names in ({"HOT": 3}, {"FRAGMENT": 20, "GROUP": 10}, {"_PIECE": 300, "SCAN_BYTES": 2000}):
        with monkeypatch.context() as m:
            for k, v in names.items():
                m.setattr(repeats, k, v)
            got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.remove_repeats(df).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200), names


def test_one_gram_in_every_document(spark, monkeypatch):
    """A hot gram whose surroundings agree in all degrees, split down to single strings."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot, near, far = "~" * 20 + text(44), text(180), text(180)
    texts = []
    for _ in range(60):
        a, b = rng.randrange(0, 180), rng.randrange(0, 180)
        texts.append(text(rng.randrange(150, 300)) + near[len(near) - a:] + hot + far[:b] + text(rng.randrange(150, 300)))
    texts += [texts[0][40:], texts[1] + texts[2], hot, near + hot, hot + far]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_repeats(texts, 200)
    for most, ranges in ((1, 8), (3, 2), (20_000, 8)):
        monkeypatch.setattr(repeats, "HOT", most)
        monkeypatch.setattr(repeats, "RANGES", ranges)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.remove_repeats(df).collect()}
        assert [got[i] for i in range(len(texts))] == want, (most, ranges)


def test_repeated_strings_of_nothing(odd_documents):
    assert repeats.remove_repeats(odd_documents.limit(0)).count() == 0


def brute_lines(rows, percent, least):
    sites, found = Counter(s for s, _ in rows), Counter()
    space = " \t\n\x0b\f\r"
    for s, t in rows:
        found.update({(s, x.strip(space)) for x in (t or "").split("\n") if x.strip(space)})
    bad = {k for k, n in found.items() if n >= least and 100 * n > percent * sites[k[0]]}
    out = []
    for s, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if (s, x.strip(space)) not in bad]
        n = sum(1 for x in own if x.strip(space))
        out.append((None if t is None else "\n".join(keep), n, len(own) - len(keep)))
    return Counter(out)


def line_rows():
    rng = random.Random(2)
    rows = []
    for i in range(90):
        own = [f"line {rng.randrange(10**6)}" for _ in range(3)]
        own += ["menu | home"] * (rng.random() < 0.5) + [" menu | home\t"] * (rng.random() < 0.2) + ["", " "] + ["rare"] * (rng.random() < 0.04)
        rng.shuffle(own)
        rows.append((rng.choice(["a", "a", "b", None]), "\n".join(own)))
    return rows + [("a", None), ("a", ""), ("c", "menu | home"), (None, "menu | home")]


def test_line_dedup(spark, odd_documents, monkeypatch):
    odd = [(r["source"], r["text"]) for r in odd_documents.collect()]
    for rows in (line_rows(), odd):
        df = spark.createDataFrame([(*r, 9, "x") for r in rows], "source string, text string, n_dropped int, site string")
        for limit in (lines.BROADCAST_ROWS, -1):
            monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
            got = lines.drop_boilerplate(df, 20, 3)
            assert Counter((r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == brute_lines(rows, 20, 3)
        monkeypatch.undo()
    assert lines.drop_boilerplate(odd_documents.limit(0)).count() == 0
