"""Tokenizers and embedders."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import embed, registry, tokenizers
from lodestone.errors import InvalidModelSpec, ModelNotCompatible, ModelNotFound

SF = "/root/testdata/sf0.001"


def test_wordpiece():
    t = tokenizers.WordPiece.from_text("[PAD]\n[UNK]\n\n[CLS]\n[SEP]\nun\n##able\n!\nplay", 8)
    assert t.vocab["[CLS]"] == 3 and t.words("Unable, PLAY!") == ["unable", ",", "play", "!"]
    assert t.pieces("unable") == ["un", "##able"] and t.pieces("unzable") == ["[UNK]"]
    assert t.encode("unable play!") == ([3, 5, 6, 8, 7, 4, 0, 0], [1] * 6 + [0] * 2)
    assert t.encode("play " * 20)[0] == [3, *[8] * 6, 4]


def test_basic_tokens_column(spark):
    texts = ["Hello, World!", "a-b  c…d", "", "Été 3.5"]
    t = tokenizers.WordPiece({})
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokenizers.basic_tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r["w"] for r in got] == [t.words(x) for x in texts]


def bpe(**more):
    letters = tokenizers.byte_letters()
    vocab = {c: i for i, c in enumerate(sorted(letters.values()))}
    for m in ("th", "the", "Ġthe"):
        vocab[m] = len(vocab)
    return json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": ["t h", ["th", "e"], "Ġ the"]}, **more}), vocab


def test_byte_pair():
    text, vocab = bpe()
    t = tokenizers.BytePair.from_json(text)
    assert t.merge("Ġthe") == ["Ġthe"] and t.encode("the the")[0] == [vocab["the"], vocab["Ġthe"]]
    assert len(set(tokenizers.byte_letters().values())) == 256
    template = {"type": "Sequence", "processors": [{"type": "ByteLevel"}, {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<s>"}}, {"Sequence": {"id": "A"}}, {"SpecialToken": {"id": "</s>"}}], "special_tokens": {"<s>": {"ids": [7]}, "</s>": {"ids": [8, 9]}}}]}
    t = tokenizers.BytePair.from_json(bpe(post_processor=template)[0], 5)
    assert t.encode("the the the the") == ([7, vocab["the"], vocab["Ġthe"], 8, 9], [1] * 5)
    with pytest.raises(ValueError):
        tokenizers.BytePair.from_json('{"model": {"type": "WordPiece"}}')


def test_padding(spark):
    assert tokenizers.pad([1, 2], [1, 1], 4, "left") == ([0, 0, 1, 2], [0, 0, 1, 1])
    assert tokenizers.pad([1, 2, 3], [1, 1, 1], 2) == ([1, 2], [1, 1])
    t = tokenizers.BytePair.from_json(bpe()[0])
    got = spark.createDataFrame([("the",), (None,)], "t string").select(tokenizers.encode(F.col("t"), t, 3).alias("e")).collect()
    assert [r["e"]["attention_mask"] for r in got] == [[0, 0, 1], [0, 0, 0]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
def test_queries_encode_whole_texts(spark):
    texts = {r["item_id"]: r["text"] for r in registry._t(spark, SF, "benchmark").collect()}
    letters = tokenizers.byte_letters()
    names = {i: t for i, t in enumerate([*sorted(letters.values()), "th", "the", "Ġthe", "er"])}
    for r in registry.bpe_encode(spark, SF).collect():
        assert "".join(names[i] for i in r["input_ids"][:-1]) == "".join(letters[b] for b in texts[r["item_id"]].encode())
    for r in registry.wordpiece_encode(spark, SF).collect():
        assert sum(r["attention_mask"]) >= 2 + len(tokenizers.WordPiece({}).words(texts[r["item_id"]])) and len(r["input_ids"]) == 512


def test_embedders(tmp_path):
    e = embed.resolve("native")
    v = e.embed_batch(["a cat", "A  cát", "", "dog"])
    assert v.shape == (4, 512) and np.allclose(v[0], v[1]) and not v[2].any() and np.linalg.norm(v[3]) == pytest.approx(1)
    for spec, error in (("hf:", InvalidModelSpec), ("other", InvalidModelSpec), ("local:/none/here", ModelNotFound), ("hf:a/b", ModelNotCompatible)):
        with pytest.raises(error):
            embed.resolve(spec)
    assert embed.parse_spec("hf:a/b") == ("hf", "a/b") and embed.spec_of("hf", "a/b") == "hf:a/b"
    assert embed.select_model_files(["z.mlmodel", "b.mlpackage/x", "a.mlpackage/y", "vocab.txt", "README"]) == ["a.mlpackage/y", "vocab.txt"]
    assert embed.select_model_files(["z.mlmodel", "a.mlmodel"]) == ["a.mlmodel"]
