"""The chunker's contract."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators.chunk import budget, chunk_text


def test_empty_and_blank_texts_have_no_chunks():
    assert chunk_text("") == [] and chunk_text(None) == [] and chunk_text(" \n\t ") == []


def test_short_text_is_one_chunk():
    assert chunk_text("Hello, world!") == [{"text": "Hello, world!", "position": 0, "start_offset": 0, "end_offset": 13}]


def test_offsets_positions_and_overlap():
    for text in ("word " * 600, "This is a sentence for you. " * 200, "A" * 4096):
        got = chunk_text(text)
        assert got[0]["start_offset"] == 0 and got[-1]["end_offset"] <= len(text)
        assert [c["position"] for c in got] == list(range(len(got)))
        assert all(a["end_offset"] > b["start_offset"] for a, b in zip(got, got[1:]))


def test_cuts_at_blank_lines_then_lines_then_sentences():
    assert chunk_text("a" * 90 + "\n\n" + "b" * 50, 100, 10)[0]["end_offset"] == 92
    assert chunk_text("a" * 90 + "\n" + "b" * 50, 100, 10)[0]["end_offset"] == 91
    assert chunk_text("a" * 90 + ". " + "b" * 50, 100, 10)[0]["end_offset"] == 91
    assert chunk_text("a" * 150, 100, 10)[0]["end_offset"] == 100


def test_budget_of_a_model():
    assert budget(512) == (1843, 184)


def test_offsets_are_utf16_units():
    got = chunk_text("\U0001f600" * 100, 50, 5)
    assert got[0]["end_offset"] == 50 and got[0]["text"] == "\U0001f600" * 25
    assert got[-1]["end_offset"] == 200


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n\U0001f600", max_size=400), st.integers(20, 80))
def test_chunks_cover_the_text(text, size):
    got, total = chunk_text(text, size, size // 10), sum(2 if c > "￿" else 1 for c in text)
    for a, b in zip(got, got[1:]):
        assert a["start_offset"] < b["start_offset"] and b["end_offset"] <= total
    assert all(c["text"].strip() == c["text"] for c in got)


@pytest.mark.parametrize("size", [1843, 2048])
def test_progress(size):
    assert len(chunk_text("x" * 20000, size, size // 10)) == -(-(20000 - size // 10) // (size - size // 10))
