"""How new pieces of words reach the vocabulary, and which pairs a grammar looks at."""

from __future__ import annotations

import random
import string

import numpy as np
import pytest

from chatwarden.llm import token_files
from chatwarden.llm.queries import tokenizer_path


class Recorded:
    """A tokenizer that keeps what it was given."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def __getattr__(self, name):
        def call(texts, **how):
            self.given += [texts] if isinstance(texts, str) else texts
            return getattr(self.inner, name)(texts, **how)

        return call if name.startswith("encode") else getattr(self.inner, name)


def plain_texts():
    draw = random.Random(5)
    kinds = [string.ascii_letters, string.digits, "".join(set(string.punctuation) - {"'"})]
    piece = lambda: "".join(draw.choices(draw.choice(kinds), k=draw.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 25, 40])))
    return ["".join(piece() + draw.choice(["", " "]) for _ in range(draw.randint(1, 60))).strip() for _ in range(300)]


def same_ids(words, texts):
    ids, bounds = words.encode([t.encode() for t in texts])
    return all(
        ids[s:e].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids for t, s, e in zip(texts, bounds[:-1], bounds[1:])
    )


def test_plain_pieces_do_not_go_through_the_pattern():
    words = token_files.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    words.tokenizer = Recorded(words.tokenizer)
    texts = plain_texts()
    words.encode([t.encode() for t in texts])
    assert words.tokenizer.given == []
    assert same_ids(words, texts)  # all known by now
    words.tokenizer.given.clear()
    words.encode("plain café it's a\tb".encode().split(b"\x00"))
    assert sorted(" ".join(words.tokenizer.given).split()) == ["'s", "b", "café"]


@pytest.mark.parametrize("spelled", [True, False])
def test_plain_pieces_have_the_ids_of_the_whole_text(spelled):
    words = token_files.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    if not spelled:  # lengths that do not fit the pieces: the pattern is used
        words.length[:] = 3
    texts = [*plain_texts(), "", "a", "don't", "'", "x'y z' 'w", "1'2 3", "léa b", "é", "a\x01b c\x7f d", "a\nb", "tab\there"]
    assert same_ids(words, texts) and same_ids(words, texts[::-1])
    assert (words.model is not None) == spelled


@pytest.mark.parametrize("end", [50256, 90000])
def test_a_grammar_looks_at_rare_pairs_once(monkeypatch, end):
    draw = np.random.default_rng(4)
    common = [draw.integers(0, 3000, 6) for _ in range(100)]
    ids = [np.concatenate([common[draw.integers(100)], draw.integers(0, end, 12)]) for _ in range(6000)]
    ids = np.append(np.concatenate(ids), [end]).astype(np.uint32)
    looked, groups = [], token_files._groups
    monkeypatch.setattr(token_files, "_groups", lambda symbols, live, least: (looked.append(len(live)), groups(symbols, live, least))[1])
    symbols, rules, lengths = token_files.repair(ids, end)
    grammar = token_files.Grammar(end + 1, rules, lengths)
    assert (grammar.decode(symbols) == ids).all()
    assert len(symbols) < len(ids) * 0.75
    assert len(looked) > 3 and sum(looked) < 2 * len(ids)
