"""Quality rules, mixing, language, pages, queries with SQL and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import html_text, language, lines, mixing, quality, queries
from test_dedup import brute_components, brute_lines

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(t):
    t = t or ""
    w, own = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(own) - len(set(own)), "n_repeat_words": len(hit), "n_lines": len(own)}


def bits(m):
    return [m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 100 * m["n_symbols"] > 10 * m["n_words"], 100 * m["n_dup_lines"] > 30 * m["n_lines"], m["word_chars"] < 3 * m["n_words"], m["word_chars"] > 12 * m["n_words"]]


def test_quality_ledger(spark, documents, odd_documents):
    more = spark.createDataFrame([("a b c a b c a b c",), ("x\nx\n\n \nx",), ("a b a b",), ("a b c d",), ("é\U0001f600 ## é",), ("a a a a",)], "text string").withColumn("doc_id", F.lit(1).cast("long"))
    for docs in (documents.select("doc_id", "text"), odd_documents, more):
        got = quality.ledger(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            m = measures(r["text"])
            assert {k: r[k] for k in quality.MEASURES} == m and r["failed_bits"] == sum(1 << k for k, b in enumerate(bits(m)) if b)
    led = quality.ledger(documents)
    kept = quality.kept_documents(led, "web-1")
    assert kept.count() == quality.apply_policy(led, "web-1").filter("kept").count()
    rows = [bits(measures(r["text"])) for r in documents.collect()]
    for r in quality.ablation(led, "web-1").collect():
        k = list(quality.RULES).index(r["rule"])
        assert (r["n_failed"], r["n_only"], r["n_docs"]) == (sum(b[k] for b in rows), sum(b[k] and sum(b) == 1 for b in rows), len(rows))
    assert quality.ledger(odd_documents.limit(0)).count() == 0


def test_water_filling():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 45) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.water_fill([0, 10], [5, 2], 15) == [0, 15]
    assert mixing.water_fill([], [], 0) == [] and sum(mixing.water_fill([1, 1], [5, 2], 99)) == 4


def test_mix(spark, documents, odd_documents):
    for docs in (documents, odd_documents):
        out, pieces = mixing.mix(docs)
        rows = out.collect()
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs.collect())
        names = sorted({r["source"] for r in docs.collect()}, key=lambda s: (s is None, (s or "").encode()))
        size = Counter()
        for r in docs.collect():
            size[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = mixing.water_fill([size[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))
        assert sorted({(r["source_size"], round(r["target"], 6)) for r in rows}) == sorted({(size[n], round(t, 6)) for n, t in zip(names, want)})
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        taken = defaultdict(int)
        for r in rows:
            taken[r["source_size"], r["target"]] += r["taken"]
        n = Counter((size[x], t) for x, t in zip(names, want))
        assert all(abs(v - k[1] * n[k]) <= n[k] for k, v in taken.items())
        assert sorted((r["_row"], r["taken"]) for r in mixing.mix(docs)[0].collect()) == sorted((r["_row"], r["taken"]) for r in rows)
        texts = Counter()
        for r in mixing.mixed_documents(docs).collect():
            texts[r["doc_id"]] += len(WORD.findall(r["text"]))
        by_id = Counter()
        for r in rows:
            by_id[r["doc_id"]] += r["taken"]
        assert {k: v for k, v in by_id.items() if v} == dict(texts)
        assert pieces.groupBy("t", "_row", "p").count().filter("count > 1").count() == 0
    assert mixing.mix(odd_documents.limit(0))[0].count() == 0


def test_schedule_is_balanced_at_every_length(spark):
    sources = spark.createDataFrame([(0, 0, 600), (1, 600, 900), (2, 900, 1000)], "src int, lo long, hi long")
    rows = mixing.schedule(sources, 1000).orderBy("t").collect()
    assert Counter(r["src"] for r in rows) == {0: 600, 1: 300, 2: 100}
    seen = Counter()
    for i, r in enumerate(rows[:900], 1):
        assert r["rank"] == seen[r["src"]]
        seen[r["src"]] += 1
        assert abs(seen[0] - 0.6 * i) < 6


def test_language(spark, documents, odd_documents):
    model = language.fit(documents)
    assert model.languages == sorted({r["lang"] for r in documents.collect()})
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = language.predict(documents, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    odd = language.predict(odd_documents, model).collect()
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in odd_documents.collect()}
    assert len(odd) == odd_documents.count() and all((r["lang_pred"] == "und") == (not letters[r["doc_id"]]) for r in odd)
    none = language.fit(odd_documents.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd_documents, none).collect()} == {"und"} and language.predict(odd_documents.limit(0), model).count() == 0
    one = language.fit(documents.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language.predict(documents, one).collect()} == {"en"}


@pytest.mark.parametrize("k", [2, 4, 7, 12, 30])
def test_codewords_differ(k):
    c = language.codewords(k)
    gap = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
    assert c.shape[0] == k and gap >= (2 ** (k - 2) if k <= 7 else 3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav></header>
<div class="cookie-notice">We use cookies, and we say so at length here.</div><div id=main><article class=post><header><h1>Title &amp; more</h1></header><p>First   paragraph,
with <a href=x>a link</a> in it. It is long enough, as texts go.<p><b>Second<br>one</b>, with R&eacute;sum&#233;. And more, and more.</p><ul><li>An item, the first.</li><li>Another item, the second.</li></ul>
<aside>Read also: other things.</aside><div class="ad">Buy now!</div><form><label>Mail</label><input></form><script>var x = "</p>";</script><!-- note --></article>
<section class="comments"><p>Great article, I liked it very much, thanks.</p></section></div><div class="sidebar">Popular</div><footer>&copy; 2020</footer></body></html>"""


def test_pages():
    want = "Title & more\n\nFirst paragraph, with a link in it. It is long enough, as texts go.\n\nSecond one, with Résumé. And more, and more.\n\nAn item, the first.\n\nAnother item, the second."
    assert html_text.extract(PAGE) == want
    assert [html_text.extract(x) for x in (None, "", "<p></p>", "<!-- x", "<script>x")] == [""] * 5
    assert html_text.extract("plain text, no tags &lt;here&gt;") == "plain text, no tags <here>"
    plain = "<body><div class=top><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>" + "Some words, and more. " * 9 + "</p><p>" + "Other words, and so on. " * 9 + "</p></div><div><a href=c>Terms</a></div>"
    assert html_text.extract(plain).split("\n\n")[0] == "Head" and "Terms" not in html_text.extract(plain) and "One" not in html_text.extract(plain)


def test_page_keeps_lists_and_tables_of_an_article():
    long = "Some longer words, as an article has them, and more. " * 6
    for n in (3, 8, 30):
        items, cells = [f"short item number {i}" for i in range(n)], [f"cell {i}" for i in range(n)]
        body = f"<h1>Heading</h1>{f'<p>{long}</p>' * 5}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><table><caption>Cap</caption>{''.join(f'<tr><td>{x}</td></tr>' for x in cells)}</table><dl><dt>Term<dd>{long}</dl><figure><figcaption>Fig</figcaption></figure><p>{long}</p>"
        want = "\n\n".join(["Heading", *[long.strip()] * 5, *items, "Cap", *cells, "Term", long.strip(), "Fig", long.strip()])
        for tag in ("article", "main"):
            assert html_text.extract(f"<body><nav>Menu</nav><{tag}>{body}<ul class=share><li>Share</li></ul><div><a href=x>Next page of this</a></div></{tag}><p>Outside</p></body>") == want


def test_page_that_names_comments():
    text, more = "Some longer words, as an article has them. " * 6, "<section id=comments class=comments-area><article class='comment-body'><p>Great, thanks, I liked it.</p></article></section>"
    for page in ("<html class=comments><body class='single comments-open'><article><p>{}</p></article>{}</body></html>", "<body><article class='post comments-enabled'><p>{}</p></article>{}", "<body><article class=comments-open><p>{}</p></article>{}",
                 "<main class=comments><p>{}</p>{}</main>", "<body><div class='page comments-open'><article><p>{}</p></article>{}</div>", "<body class=comments-open><div class=comments><h1>{}</h1></div>{}", "<article class=post><p>{}</p><article class='comment post'>No, thanks.</article></article>{}"):
        for comments in ("", more):
            assert html_text.extract(page.format(text, comments)) == text.strip(), page
    for comments in (more, more * 2):
        assert html_text.extract(f"<body><div class=post><p>{text}</p></div>{comments}") == text.strip()


def unmarked_page(rng, n):
    """An article without a mark or class word beside a long menu without links, and its text."""
    say = lambda k: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**6)}{rng.choice(['', '', ',', '.'])}" for _ in range(k))
    parts = [f"Title {n}", *(say(rng.randrange(20, 80)) + "." for _ in range(rng.randrange(3, 9)))]
    menu = "".join(f"<p>Topic {rng.randrange(999)}</p>" for _ in range(250))
    return f"<html><body><div><div>{menu}</div></div><div><h1>{parts[0]}</h1>{''.join(f'<section><p>{x}</p></section>' for x in parts[1:])}</div><div>Some last words</div></body></html>", "\n\n".join(parts)


def test_scores_choose_the_content_of_unmarked_pages(monkeypatch):
    rng = random.Random(4)
    pages = [unmarked_page(rng, n) for n in range(60)]
    got = [html_text.extract(page) for page, _ in pages]
    assert sum(g == want for g, (_, want) in zip(got, pages)) >= 54
    for g, (_, want) in zip(got, pages):
        words = Counter(want.split())
        assert sum((words & Counter(g.split())).values()) >= 0.95 * sum(words.values())
    monkeypatch.setattr(html_text, "path_scores", lambda paths, length, marks: np.ones(paths.max() + 1))
    assert sum(html_text.extract(page) != g for (page, _), g in zip(pages, got)) >= 54


def test_path_scores_equal_definition():
    page = html_text.Page(PAGE)
    names, of = [], lambda k: "" if k < 0 else of(page.parent[k]) + "/" + page.tag[k]
    names = [of(k) for k in page.element]
    length, marks = [len(t) for t in page.texts], [len(re.findall(r"[.,;:!?…。，！？]", t)) for t in page.texts]
    rows = defaultdict(list)
    for i, name in enumerate(names):
        rows[name].append(i)
    mean = lambda x: [sum(x[j] for j in rows[name]) / len(rows[name]) for name in names]
    near = lambda x, i: sum(w * x[min(max(i + d, 0), len(x) - 1)] for d, w in ((-2, .05), (-1, .2), (0, .5), (1, .2), (2, .05)))
    text, punctuation = mean(length), mean(marks)
    fused = [near(text, i) * (1 + near(punctuation, i)) for i in range(len(names))]
    want = [(sum(fused[j] for j in rows[name]) / len(rows[name])) ** 0.5 for name in names]
    paths = np.array(page.block_path)
    assert len({(p, n) for p, n in zip(page.block_path, names)}) == len(rows) == len(set(page.block_path))
    assert html_text.path_scores(paths, np.array(length, float), np.array(marks, float))[paths] == pytest.approx(want)


@pytest.mark.parametrize("page", ["<a '" * 250_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<a " * 300_000, "<p><b>" * 100_000 + "x", "<li><ul>" * 60_000 + "x", "<!--" * 200_000, "<p a='" * 150_000 + "x", "<p>" + "word " * 400_000])
def test_pages_of_broken_markup_take_linear_time(page):
    began = time.process_time()
    text = html_text.extract(page)
    assert time.process_time() - began < 8 and len(text) <= len(page)
    assert "x" in text or "word" in text or page.startswith(("<a", "<!", "<p a"))


def test_page_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, None, "y")], "page_id long, url string, html string, text string, html_ string")
    got = html_text.main_text(df).collect()
    assert sorted(r["n_chars"] for r in got)[0] == 0 and len(got) == 3 and got[0]["text"] == html_text.extract(PAGE) and {r["html_"] for r in got} == {"y"}
    assert html_text.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    got = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(x) for x in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in got.fetchall())


def test_pipeline(spark, documents):
    stages, docs, seen = dict(corpus_pipeline.STAGES), documents, [documents.collect()]
    for name in list(stages)[:-1]:
        docs = spark.createDataFrame(stages[name](spark, docs, SF).collect(), documents.schema)
        seen.append(docs.collect())
    first, good, lined, unique, mixed = seen
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in first if not any(bits(measures(r["text"])))}
    want = brute_lines([(r["source"], r["text"]) for r in good], 5, 5)
    assert Counter(r["text"] for r in lined) == Counter({t: sum(n for (x, _, _), n in want.items() if x == t) for t, _, _ in want})
    groups = {}
    for (d, _, c) in brute_components([(r["doc_id"], r["text"]) for r in lined]):
        groups[d] = c
    assert {r["doc_id"] for r in unique} == set(groups.values())
    whole = {r["doc_id"]: r["text"] for r in unique}
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed)
    size = sum(len(WORD.findall(t)) for t in whole.values())
    assert 0 < sum(len(WORD.findall(r["text"])) for r in mixed) <= 1.5 * size + 20
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)


def test_pipeline_keeps_one_of_many_copies(spark, documents):
    rng = random.Random(11)
    text = lambda: "\n".join(" ".join(f"word{rng.randrange(9000)}" for _ in range(20)) for _ in range(5))
    copied, small = text(), text()
    rows = [(i, copied) for i in range(40)] + [(i, small + "\n" * (i % 2)) for i in range(40, 46)] + [(i, text() + "\nmenu | home | about us") for i in range(46, 106)]
    docs = spark.createDataFrame([(i, t, "en", "big" if i < 40 else "other", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*(F.col(f.name).cast(f.dataType) for f in documents.schema))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "line_dedup", "near_duplicates"):
        docs = spark.createDataFrame(stages[name](spark, docs, SF).collect(), documents.schema)
    texts = Counter(r["text"].rstrip("\n") for r in docs.collect())
    assert texts[copied] == 1 and texts[small] == 1 and len(texts) == 62 and not any("menu" in t for t in texts)
    assert {copied, small} <= {r["text"].rstrip("\n") for r in stages["source_mix"](spark, docs, SF).collect()}


#: Every name that a module uses for itself, and the older forms of them.
INNER = sorted(set("l_ rest_ keys_ site_ row_ i_ x_ key_ drop_ t_ lines_ win_ at_ hash_ doc_ h_ size_ words_ n_ html_ _l _rest _keys _site _row _t _words _lines _win _at _key _d _h _b _k p d h s t l x m n b r u v site key known n_docs n_site taken size target cid doc rank pos src first words sel shared".split()))


def clashing(docs):
    return docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in INNER if c not in docs.columns))


def untouched(rows):
    return all(r[c] == f"{c}:{'' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in INNER if c in r)


def test_columns_that_clash_with_inner_names(spark, odd_documents):
    docs = odd_documents.drop("size", "n_words", "kept")
    wide = clashing(docs)
    key = lambda df, *cols: Counter(map(tuple, df.select(*cols).collect()))
    led, own = quality.ledger(wide), ("doc_id", "text", *quality.MEASURES, "failed_bits")
    assert key(led, *own) == key(quality.ledger(docs), *own) and untouched([r.asDict() for r in led.collect()])
    out, own = lines.drop_boilerplate(wide, 20, 2), ("doc_id", "text", "n_lines", "n_dropped")
    assert key(out, *own) == key(lines.drop_boilerplate(docs, 20, 2), *own) and untouched([r.asDict() for r in out.collect()])
    mixed = [r.asDict() for r in mixing.mixed_documents(wide).collect()]
    assert untouched(mixed) and set(mixed[0]) == set(wide.columns)
    pages = docs.select(F.col("doc_id"), F.concat(F.lit("<p>"), "text").alias("html"), *(F.lit(f"{c}:").alias(c) for c in INNER))
    assert all(r[c] == f"{c}:" for r in html_text.main_text(pages).collect() for c in INNER)
    assert set(corpus_pipeline.near_duplicates(spark, wide, SF).columns) == set(wide.columns)


def test_mix_keeps_rows_with_one_id_and_text_apart(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("x", 50), "a", "en"), (1, words("x", 50), "b", "de"), (2, words("y", 80), "b", "de"), (2, words("y", 80), "b", "de"), (3, words("z", 40), "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs)[0].collect()
    got = mixing.mixed_documents(docs).collect()
    assert {(r["source"], r["lang"]) for r in got if r["doc_id"] == 1} == {("a", "en"), ("b", "de")}
    taken, total = Counter(), Counter()
    for r in out:
        taken[r["doc_id"]] += r["taken"]
    for r in got:
        total[r["doc_id"]] += len(r["text"].split())
    assert taken == total
    by_source = Counter()
    for r in got:
        by_source[r["source"]] += len(r["text"].split())
    assert by_source["a"] == 100 and abs(by_source["b"] - 350) <= 2  # 150 % of 300 words; a stops at twice its 50


def test_pipeline_keeps_one_row_of_an_id_by_its_columns(spark, documents):
    text = "\n".join(" ".join(f"w{i * 7 + j}" for j in range(30)) for i in range(4))
    rows = [(1, text, "en", "a", 5), (1, text, "de", "b", 5), (1, text, "de", "b", 5), (2, text + " end", "fr", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    again = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3, "lang"), SF).collect()]
    assert len(one) == 1 and one == again


def targets(sizes):
    """Targets by a plain search for the level that the open sources' weights are multiplied with."""
    weights, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes)
    low, high = 0.0, 2.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * s, level * w) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(2 * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_of_the_mix(spark, documents):
    size = Counter()
    for r in documents.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(((size[n], n) for n in names), targets([size[n] for n in names])))
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    for r in mixing.mix(documents)[0].collect():
        assert r["target"] == pytest.approx(want[r["source_size"], source[r["doc_id"]]], rel=1e-6)


def test_language_features_and_decoding_equal_definition(spark, documents):
    texts = [r["text"][:300] for r in documents.limit(12).collect()] + ["Ärger, é!", "a", "", None]
    got = language.features(pa.array(texts))
    for row, t in zip(got, texts):
        b = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (t or "").encode()]
        count = Counter()
        for k in (1, 2, 3):
            for i in range(len(b) - k + 1):
                code = 0
                for c in b[i:i + k]:
                    code = code * 256 + c
                count[((code * 0x9E3779B1 + k * 0x85EBCA6B) >> 7) % language.FEATURES] += 1
        norm = sum(count.values()) ** 0.5
        want = np.zeros(language.FEATURES)
        for f, n in count.items():
            want[f] = n ** 0.5 / norm
        assert np.abs(row - want).max() < 1e-6
    model = language.fit(documents)
    rows = {r["doc_id"]: r for r in language.predict(documents, model).collect()}
    for r in documents.limit(40).collect():
        x = language.features(pa.array([r["text"]]))[0]
        loss = []
        for word in model.code.tolist():
            part = [np.log1p(np.exp(-c * (float(x @ model.weights[:, j]) + float(model.bias[j])))) * float(model.trust[j]) for j, c in enumerate(word)]
            loss.append(sum(part) / float(model.trust.sum()))
        got, p = rows[r["doc_id"]], [np.exp(-4 * (v - min(loss))) for v in loss]
        order = sorted(loss)
        assert got["lang_pred"] == model.languages[int(np.argmin(loss))] and got["score"] == pytest.approx(max(p) / sum(p), rel=1e-4)
        assert got["ambiguous"] == (order[1] - order[0] < 0.2)
