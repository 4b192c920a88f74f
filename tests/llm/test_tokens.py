"""Token ids of many chunks at once are the library's on whole texts, and hashes by eights tell words apart."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tideline.llm import packing, textops, tokens


class Counting:
    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_new_chunks_share_texts():
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole, encoder.library = encoder.library, Counting(encoder.library)
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdefg"), 7)) + rng.choice(["", ".", ","]) for _ in range(400)) for _ in range(10)]
    got = list(encoder.column(pa.array(texts)))
    assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.library.texts < 400  # of nearly 4,000 words


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_texts(name):
    encoder = tokens.Encoder(public_tokenizers.path(name))
    rng = np.random.default_rng(3)
    odd = ["".join(rng.choice(list(" \n\t.,'!aesß1　́한X\U0001f600"), rng.integers(0, 60))) for _ in range(2000)]
    odd += ["it's, 's. a'll", "a" * 300 + ". " + "b" * 300, "<|endoftext|> x. <|endoftext|>", "x\x00 \x01.", " \n", ""]
    got = [x.tolist() for x in encoder.column(pa.array(odd))]
    assert got == [encoder.library.encode(t, add_special_tokens=False).ids for t in odd]


def test_hashes_and_orders():
    words = [b"a" * n for n in range(1, 90)] + [b"a" * n + b"\0" for n in range(1, 90)] + [b"ab", b"ba"]
    data = np.frombuffer(b"".join(words * 2), np.uint8)
    ends = np.cumsum([len(w) for w in words * 2])
    found = textops.short_hashes(data, np.append(0, ends[:-1]), ends)
    assert len(np.unique(found)) == len(words) and (found[: len(words)] == found[len(words) :]).all()
    for keys in (found, np.array([8, 9, 8, 9, 9, 8], np.uint64), np.empty(0, np.uint64)):  # 8 and 9 differ in the bits that places take
        distinct, at, inverse = textops.distinct(keys)
        assert (distinct == np.unique(keys)).all() and (keys[at] == distinct).all() and (distinct[inverse] == keys).all()
    terms = np.random.default_rng(4).integers(0, 1 << packing.TERM_BITS, 50).astype(np.uint64)[np.random.default_rng(5).integers(0, 50, 3000)]
    assert (packing.by_term(terms) == np.argsort(terms, kind="stable")).all()
