import random

import pytest
from spanloom.llm import bpe as B
from spanloom.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def agree(library, texts):
    mine = B.tokenizer(PATH)
    for text, (ids, decoded) in zip(texts, mine.encode_many(texts), strict=True):
        e = library.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == e, text
        assert decoded.decode() == library.decode(e, skip_special_tokens=False) == mine.decode(e)


def test_random_texts_as_the_library(library, monkeypatch):
    monkeypatch.setattr(B, "TABLE_ROWS", 500)
    rng = random.Random(0)
    alphabet = "aAbB'sStTrRvV 12.,!\n\t\x1c\x1d\x85\xa0é́ÉΣσςİßΩ中文字😀‍̀½²­​᠎Ᲊ՘"
    for _ in range(10):
        agree(library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)])
    agree(library, ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(2000)])


def test_special_and_long_texts(library):
    agree(library, ["", " ", "<|startoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|", "a" * 5000, "ab" * 3000, "don't we'll I'M", "the " * 20000])


def test_surface():
    mine = B.tokenizer(PATH)
    assert mine.surface(mine.encode("Hello, wörld 12")) == "hello , wörld 1 2 "


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        B.WordBpe(tokenizer_path("byte_bpe_50k.json"))


def test_edges(edge_docs, no_docs):
    got = {r.doc_id: r for r in B.encode_texts(edge_docs, PATH, keep=("ids", "decoded"), carry=("lang",)).collect()}
    assert got[1].n_tokens == 0 and got[1].decoded == "" and got[2].ids_sha256 == got[1].ids_sha256
    assert len(got[3].ids) == got[3].n_tokens == 24000 and got[4].lang == "fr"
    assert B.encode_texts(no_docs, PATH).count() == 0
