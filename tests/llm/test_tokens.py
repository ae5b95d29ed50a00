"""Token ids are those of the library, whatever the words' hashes."""

import numpy as np
import pyarrow as pa
import pytest

from commercelake.llm import tokens
from commercelake.llm.queries import vocabulary
from commercelake.llm.words import Lanes, word_spans


def library(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(vocabulary())
    return [known.encode(t or "", add_special_tokens=False).ids for t in texts]


def encoded(texts, encoder=None):
    ids, offsets = (encoder or tokens.Encoder(vocabulary())).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_any_polynomial():
    one, two = thue_morse(1024)
    texts = [f"{one} {two} {one}", two, None, "", f"x {two}{one}", one]
    assert encoded(texts) == library(texts)


@pytest.mark.parametrize("distinct", [1, 7])
def test_words_of_one_hash_keep_their_own_ids(monkeypatch, distinct):
    """Hashes of few values: nearly all words share theirs with others, of other and of the same length."""
    real = Lanes.hashes

    def few(self, starts, ends, salt=0):
        # As the real ones, they keep short words of one length apart.
        lengths = ends - starts
        return np.where(lengths <= 8, real(self, starts, ends, salt), np.uint64(3) + lengths.astype(np.uint64) % np.uint64(distinct))

    monkeypatch.setattr(Lanes, "hashes", few)
    texts = ["internationalization institutionalism a b", "internationalisation überraschend überraschung", "x" * 200 + " " + "x" * 199 + "y", "characters charactered"]
    encoder = tokens.Encoder(vocabulary())
    for _ in range(2):
        assert encoded(texts, encoder) == library(texts)


def test_hashes_of_short_words_never_collide():
    rng = np.random.default_rng(2)
    words = sorted({bytes(rng.integers(97, 99, 8).astype(np.uint8)) for _ in range(400)})
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    assert len(np.unique(Lanes(data).hashes(starts, ends))) == len(words)
