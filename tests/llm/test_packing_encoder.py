"""Ids of the packing encoder against the tokenizer's own library."""

import os
from array import array

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from dyadica.llm import packing

PATH = packing.tokenizer_path()


def same(path, texts):
    encoder, own = packing.encoder(path), Tokenizer.from_file(path)
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [array("I", b).tolist() for b in encoder.encode(texts)] == want


def test_every_document_of_a_table():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert packing.encoder(PATH).fast is not None
    same(PATH, texts)


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 150_000 + "x", "x" + " \n\t" * 60_000, " " * 120_000, "7" * 5000 + "é" * 5000,
                                  "a <|endoftext|> b", "\x00퟿\U0001f600 x", "'s's 'll\n\n \n", "word " * 40_000])
def test_extreme_texts(text):
    same(PATH, [text, "", text + "!"])


def test_another_kind_of_tokenizer():
    path = os.path.join(os.path.dirname(PATH), "word_bpe_49k.json")
    assert packing.encoder(path).fast is None
    same(path, ["Some words, it's 12,5% naïve\n", ""])
