"""Encoding, token files and packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing, token_file
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.tokens import Encoder, slices


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path())


def whole(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["a  b", " x\n\n b", "", "  foo <|endoftext|> b ", None, "don't  'll stop\n x", "ça   ok", " \n", "a ", " ", "x  y　 z", "\x1c \x85 q", "\U0001f600 é", "tab\t x"]


def test_encoding_equals_that_of_whole_texts(enc, documents):
    texts = [*ODD, *(r["text"] for r in documents.limit(60).collect())]
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == whole(enc, t), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab '\n\t é.1 \x0b", max_size=12), max_size=6))
def test_encoding_of_any_white_space(texts):
    enc = _shared_encoder()
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [whole(enc, t) for t in texts]


def _shared_encoder(kept=[]):
    if not kept:
        kept.append(Encoder(tokenizer_path()))
    return kept[0]


def test_many_words_are_encoded_as_one_text(documents):
    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **how)

    enc = Encoder(tokenizer_path())
    rng = np.random.default_rng(4)
    texts = [t for t in ODD if t] + [" ".join(f"w{x}'s" for x in rng.integers(0, 1 << 40, 500)) for _ in range(8)] + ["a\n", "Ġ Ġa b<|endoftext|> <|endoftext|>c", " lead", "a "]
    texts += [r["text"] for r in documents.limit(40).collect()]
    want = [whole(enc, t) for t in texts]
    enc.tokenizer = Counted(enc.tokenizer)

    def got():
        ids, ends = enc.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]

    assert got() == want
    assert enc.tokenizer.texts < 150 < 4000 < len(enc.place)
    enc.spaced[:] = False  # a vocabulary that writes spaces in another way
    enc.place.clear()
    assert got() == want


def test_slices_hold_whole_texts():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 5, None, "y" * 50, "z"]})
    assert [r for s in slices(batch, "t", 10) for r in s.column("t").to_pylist()] == batch.column("t").to_pylist()


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_file.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_file.unpack(data, 1001, bits) == ids).all()
    with pytest.raises(ValueError):
        token_file.pack(np.array([1 << 4], np.uint32), 4)
    assert token_file.width(50257) == 16 and token_file.width(2) == 1 and token_file.width(65537) == 17


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 5, 300, 1, 77)]
    w = token_file.Writer(f"file://{tmp_path}/s.ldtk", 13, block=64)
    for part in ((0, 2), (2, 5)):
        own = docs[part[0]:part[1]]
        w.add(pa.array([None if k == 1 else k for k in range(*part)], pa.int64()), np.concatenate(own), np.cumsum([len(d) for d in own]))
    w.close()
    r = token_file.Reader(f"file://{tmp_path}/s.ldtk")
    assert r.known.tolist() == [True, False, True, True, True] and r.n_ids == 383
    assert all((r.document(k) == d).all() for k, d in enumerate(docs))
    assert (r.ids(60, 200) == np.concatenate(docs)[60:200]).all()
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_bytes(b"x" * 100)
        token_file.Reader(f"file://{tmp_path}/bad")


def test_token_files(spark, documents, odd_documents, enc):
    for docs in (documents, odd_documents):
        manifest = token_file.write_token_files(docs, tokenizer_path(), 0)
        got = token_file.read_token_files(manifest, with_ids=True).collect()
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] is not None, r["text"]))
        at, want = 0, []
        for r in rows:
            ids = [*whole(enc, r["text"]), 0]
            want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
            at += len(ids)
        assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got) == [(b, a, c, d, e) for a, b, c, d, e in want]
    empty = token_file.write_token_files(documents.limit(0), tokenizer_path(), 0)
    assert token_file.read_token_files(empty).count() == 0


def test_packing(documents, odd_documents, enc):
    for docs in (documents, odd_documents):
        rows = packing.pack(docs, tokenizer_path(), 1024, 2, with_ids=True).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_seq[r["sequence_id"]].append(r)
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 1024
        for rs in by_seq.values():
            rs.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in rs] == np.cumsum([0, *(r["length"] for r in rs)])[:-1].tolist() and sum(r["length"] for r in rs) <= 1024
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*whole(enc, r["text"]), 2]
            head = (len(ids) - 1) % 1024 + 1
            cuts = [0, *range(head, len(ids) + 1, 1024)]
            want.update((r["doc_id"], p, a, b - a, tuple(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(r["ids"])) for r in rows) == want
        assert len(by_seq) <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 2
    assert packing.pack(documents.limit(0), tokenizer_path()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_solution_covers_the_histogram_exactly(histogram):
    plan = packing.solve(histogram, 64)
    used = Counter()
    for conf, times in plan:
        assert sum(k * a for k, a in conf.items()) <= 64
        used.update({k: a * times for k, a in conf.items()})
    assert used == Counter(histogram)
    table = packing.slots(plan)
    assert len(table["length"]) == sum(len(c) for c, _ in plan)


def brute_knapsack(price, capacity):
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(v + best[c - k] for k, v in price.items() if k <= c)])
    return best[capacity]


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.floats(0.01, 1), min_size=1, max_size=12))
def test_knapsack_of_any_prices(price):
    lengths = np.array(sorted(price))
    conf = packing.knapsack(np.array([price[k] for k in lengths.tolist()]), lengths, 64)
    assert sum(lengths[i] * n for i, n in conf.items()) <= 64
    assert sum(price[int(lengths[i])] * n for i, n in conf.items()) == pytest.approx(brute_knapsack(price, 64))


def test_weights_beat_greedy_configurations_and_stay_near_the_bound():
    rng = np.random.default_rng(0)
    cases = [np.repeat([600, 424, 400, 624, 300, 212, 512, 324], [900, 500, 700, 300, 2000, 1500, 800, 1000]), rng.integers(200, 400, 20000), rng.integers(300, 700, 20000), np.clip(np.exp(rng.normal(5.2, 1.0, 8000)).astype(int) + 2, 2, 1024), np.repeat([513, 342, 147, 23], 500)]
    for k, lengths in enumerate(cases):
        histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
        plan, bound = packing.solve_with_bound(histogram)
        n = sum(times for _, times in plan)
        assert -(-sum(lengths) // 1024) <= bound <= n <= bound + len(histogram) + 12
        if k == 1:
            greedy = sum(times for _, times in packing._rounded(histogram, 1024, 0.0)[0])
            alone = sum(times for _, times in packing.best_fit(histogram, [], 1024))
            assert n < 0.97 * greedy and n < 0.97 * alone


def test_fractional_uses_cover_all_lengths_alike_and_price_a_bound():
    lengths, counts = np.array([300, 340, 380]), np.array([605, 605, 604])
    uses, bound = packing.fractional(lengths, counts, 1024, 4.0)
    covered = np.zeros(3)
    for conf, x in uses.items():
        assert sum(lengths[i] * a for i, a in conf) <= 1024 and x > 0
        for i, a in conf:
            covered[i] += a * x
    assert all(0.8 < c / n < 1.05 for c, n in zip(covered, counts)) and any(x != int(x) for x in uses.values())
    assert 600 <= bound <= 604.7  # three pieces fit a sequence, in any mixture up to the capacity


def test_knapsack_is_optimal():
    lengths, values = np.array([3, 5, 7]), np.array([0.31, 0.5, 0.72])
    conf = packing.knapsack(values, lengths, 11)
    best = max(a * .31 + b * .5 + c * .72 for a in range(4) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= 11)
    assert sum(values[i] * n for i, n in conf.items()) == pytest.approx(best)
