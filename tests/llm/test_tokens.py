import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelake.llm.tokens import DEFAULT_DIR, encoded, encoder

PATH = f"{DEFAULT_DIR}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_special_cases(library):
    for text in ("", " ", "a" * 3000, " " * 2000 + "x", "ab" * 1500, "漢字" * 400, "!" * 700, "a\r\n\t  b", "<|endoftext|>", "x's'T we'll", "naïve ﬁnal​﻿�", "0" * 900, "\x00\x01", "👩‍👩‍👧" * 40):
        assert list(encoder(PATH).encode([text])[0]) == library(text), text[:20]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 'st\n1é漢"), st.characters(codec="utf-8")), max_size=120))
def test_any_text(text):
    from tokenizers import Tokenizer

    global _LIB
    if "_LIB" not in globals():
        _LIB = Tokenizer.from_file(PATH)
        _LIB.encode_special_tokens = True
    assert list(encoder(PATH).encode([text])[0]) == _LIB.encode(text, add_special_tokens=False).ids


def test_frame(spark, library):
    df = spark.createDataFrame([(1, "two words", "x"), (1, "two words", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encoded(df, "doc_id", "text", PATH).collect())
    assert got == [(1, library("two words"))] * 2 + [(2, []), (3, [])]
    assert sorted((r.doc_id, r.n_tokens) for r in encoded(df, "doc_id", "text", PATH, counts_only=True).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert encoded(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import pytest

    from hirelake.llm.tokens import DEFAULT_DIR, Encoder

    said = json.load(open(f"{DEFAULT_DIR}/byte_bpe_50k.json", encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": said["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": said["model"] | {"ignore_merges": True}}):
        (tmp_path / "v.json").write_text(json.dumps(said | change), encoding="utf-8")
        with pytest.raises(ValueError):
            Encoder(str(tmp_path / "v.json"))
    assert Encoder(f"{DEFAULT_DIR}/byte_bpe_50k.json").rising
