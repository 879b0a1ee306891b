import random

import numpy as np
import pyarrow as pa
import pytest

from icuflow.llm import bpe, token_counts
from icuflow.llm.queries import tokenizer_path
from llm.conftest import ODD

PARTS = ["'s", "'re", "'", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "a", "Z", "é", "ß", "漢", "1", "½", "Ⅷ", "!", "?", "<|endoftext|>", "<|", "'ll", "ll", "😀", "​", "́", "tion", "ing", "the", " the"]


def texts(n, most, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, most))) for _ in range(n)] + ["a" * 3000, "ab" * 5000, " " * 2000, "", "x " * 2000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_and_decoder_are_the_library(library):
    some = texts(3000, 30)
    packed = bpe.Encoder(tokenizer_path()).encode(some)
    want = [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    assert [bpe.unpack(p).tolist() for p in packed] == want
    assert bpe.Decoder(tokenizer_path()).decode(packed) == library.decode_batch(want, skip_special_tokens=False)


def test_decoder_replaces_broken_utf8(library):
    ids = [library.token_to_id(x) for x in "Ãġ"]
    packed = [np.array(ids[:1] + ids, "<u4").tobytes(), None]
    assert bpe.Decoder(tokenizer_path()).decode(packed) == [library.decode(ids[:1] + ids, skip_special_tokens=False), ""]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 256), (64, 8), (200, 3)])
def test_counts_are_the_library(library, chunk, overlap):
    some = texts(60, 200)
    found = token_counts.Counter(tokenizer_path()).count(pa.array([*some, None]), chunk, overlap)
    assert found == [*(len(x) for x in library.encode_batch(some, add_special_tokens=False)), 0]


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr("icuflow.llm.pretokens.CHARS", 300)
    some = texts(20, 900)
    packed = bpe.Encoder(tokenizer_path()).encode(some)
    assert [bpe.unpack(p).tolist() for p in packed] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_frames(docs, library):
    df = docs(ODD)
    coded = bpe.encode(df, tokenizer_path())
    assert coded.columns == [*df.columns, "n_tokens", "token_ids_"]
    back = bpe.decode(coded, tokenizer_path(), "token_ids_").collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in back if r["doc_id"]) == sorted((i, t or "") for i, t in ODD if i)
    counts = token_counts.token_counts(df, tokenizer_path(), limit=2).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD]
    assert sorted((tuple(r) for r in counts), key=str) == sorted(((*w, w[2] > 2) for w in want), key=str)
    assert token_counts.token_counts(docs([]), tokenizer_path()).collect() == []
    assert bpe.encode(docs([]), tokenizer_path()).collect() == []
