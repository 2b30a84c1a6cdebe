"""Names of special tokens in texts, against the tokenizer as it is loaded."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from climrisk.llm import lengths, packing, tokens

TEXTS = [
    "one <|endoftext|> two",
    "<|startoftext|>one two<|endoftext|>",
    "glued<|endoftext|>words <|ENDOFTEXT|> <|endoftext|",
    "  <|endoftext|>  \n<|startoftext|>",
    "a <| b |> c",
    "plain words only",
    "",
]


@pytest.fixture(scope="module")
def loaded():
    made = Tokenizer.from_file(tokens.default_path())
    return lambda text: made.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_the_loaded_tokenizer(text, loaded):
    assert np.frombuffer(tokens.encoder(tokens.default_path())(text), "<u4").tolist() == loaded(text)


def test_packing_and_lengths_see_special_tokens(docs, loaded):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs(rows)).collect()}
    assert got == {i: (len(loaded(t)) + 1, zlib.crc32(np.array([*loaded(t), 1], "<u4").tobytes())) for i, t in rows}
    assert sorted(r["length"] for r in lengths.histogram(docs(rows)).collect()) == sorted({len(loaded(t)) for _, t in rows})
    assert 49407 in loaded(TEXTS[0])
