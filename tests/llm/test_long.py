"""Long texts of one kind: nothing takes more than time in proportion, and nothing fails."""

import time

import pytest

from lodestone.llm import bpe, leaks, mail, personal, scans, spans, split

N = 60_000
TEXTS = {
    "letters": "a" * N, "words": "word " * (N // 5), "digits": "1 " * (N // 2), "blanks": " " * N, "lines": "\n" * N, "quotes": "> \n" * (N // 3), "capitals": "Abc " * (N // 4),
    "at-signs": "a@" * (N // 2), "dots": "a." * (N // 2), "dashes": "-" * N, "hyphens": "ab-\n" * (N // 4), "symbols": "a!b|c1" * (N // 6), "houses": "12 Abc Def " * (N // 11), "initials": "X. " * (N // 3), "crlf": "a b\r\n" * (N // 5),
}


@pytest.fixture(scope="module")
def operators():
    index = leaks.Index([(1, "a b c d e f g h i j k l m n", None), (2, "word " * 30, None)], 12)
    finder = personal.Finder(frozenset({"abc"}), frozenset({"def"}))
    reader = scans.Reader(scans.Lexicon({"hello": 100, "word": 500}, [], *[scans.np.zeros((0, 4))] * 2))
    return {
        "bpe": lambda t: bpe.encoder(bpe.vocabulary()).encode([t]), "split": split.pieces, "spans": lambda t: spans.anchors([t], 300), "leaks": lambda t: list(index.leaks([t])),
        "personal": finder.find, "mail": lambda t: list(mail.judge([mail.Message("1", t)])), "scans": reader.read,
    }


@pytest.mark.parametrize("name", ["bpe", "split", "spans", "leaks", "personal", "mail", "scans"])
@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_long_texts(operators, name, kind):
    began = time.process_time()
    operators[name](TEXTS[kind])
    assert time.process_time() - began < 20
