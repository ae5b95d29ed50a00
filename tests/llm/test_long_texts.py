"""Patterns and tags in time in proportion to the text, with the matches of the plain patterns."""

import random
import re
import time

import numpy as np
import pytest

from commercelake.llm import main_text, personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<", re.S)


def texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_emails_and_addresses_are_those_of_the_plain_patterns():
    for text in texts("aB9@..-+_% é", 4000, 1) + ["a@b.co+x@e.f", "a@b@c.d", "x@y.z@w.v", "@a.b", "a@.b", "a@b."]:
        assert list(personal_data._emails(text)) == [m.span() for m in EMAIL.finditer(text)]
    for text in texts("12 ..x", 4000, 2) + ["1.2.3.4.5.6.7.8", "1111.2.3.4"]:
        assert [m.span() for m in personal_data.IP.finditer(text)] == [m.span() for m in IP.finditer(text)]


def test_tags_are_those_of_the_plain_pattern():
    for page in texts(["<", "</", ">", '"', "'", "a", "p ", "!", "<!--", "-->", "?", "/", "=", "\n"], 6000, 3):
        tags = main_text.Tags(page)
        for m in re.finditer("<", page):
            want = TOKEN.match(page, m.start())
            skip = tags.declaration(m.start())
            if want.group(2) is None:
                assert skip == (-1 if want.group() == "<" else want.end()) and (skip >= 0 or tags.at(m.start()) is None)
            else:
                assert skip == -1 and tags.at(m.start()) == (bool(want.group(1)), want.group(2), want.group(3), want.end())


N = 2_000_000
LONG = {
    "open tags": "<a " * (N // 3),
    "open quotes": '<a "' * (N // 4),
    "quotes and an end": '<a "' * (N // 4) + "'>",
    "declarations": "<!x" * (N // 3),
    "end tags that close nothing": "<div></p>" * (N // 9),
    "vector images that never end": "<svg>" * (N // 5),
    "less-than signs": "<" * N,
}


@pytest.mark.parametrize("name", LONG)
def test_long_pages(name):
    begun = time.process_time()
    main_text.blocks_of(LONG[name])
    assert time.process_time() - begun < 15


@pytest.mark.parametrize("text", ["a" * N + " x@y.z", "9" * N, "1." * (N // 2), "a@" * (N // 2), "+1" * (N // 2), "1 " * (N // 2)])
def test_long_runs(text):
    begun = time.process_time()
    personal_data.base_spans(text)
    assert time.process_time() - begun < 15


@pytest.mark.parametrize("rows", [0, 1, 3999, 4001, 10**6, 10**10, 10**13])
def test_some_documents_are_drawn_at_any_size(rows):
    found = personal_data.threshold(4000, rows)
    assert 0 < found <= personal_data.SPACE
    assert found == personal_data.SPACE if rows <= 4000 else abs(found / personal_data.SPACE * rows - 4000) < 1


def test_evidence_reaches_all_repeats_of_a_token():
    """Fifty times one token, of which the first alone is plainly of a kind."""
    k, n = len(personal_data.KINDS) + 1, 50
    features = np.zeros((n, 2))
    features[0, 0] = features[1:, 1] = 1
    weights = np.zeros((k, 2))
    weights[2, 0], weights[0, 1] = 200.0, 0.01
    field = personal_data.Field(weights, np.zeros((k, k)))
    graph = personal_data.Graph([(i, i + 1) for i in range(n)], features, [], [(i, i + 1) for i in range(n - 1)])
    found = field.marginals(graph)
    # A chain of equal potentials has these marginals exactly.
    step = np.exp(personal_data.SKIP * (np.eye(k) - np.eye(k)[0][:, None] * np.eye(k)[0]))
    unary = np.exp(features @ weights.T - (features @ weights.T).max(axis=1, keepdims=True))
    ahead, back = [unary[0]], [np.ones(k)]
    for i in range(1, n):
        ahead.append(unary[i] * (ahead[-1] @ step))
        ahead[-1] /= ahead[-1].sum()
    for i in range(n - 1, 0, -1):
        back.append(step @ (unary[i] * back[-1]))
        back[-1] /= back[-1].sum()
    want = np.array(ahead) * np.array(back[::-1])
    assert np.allclose(found, want / want.sum(axis=1, keepdims=True), atol=1e-4)
