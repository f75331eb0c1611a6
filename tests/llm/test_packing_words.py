"""Ids of words looked up together against the tokenizer, text by text."""

import random

import public_tokenizers
import pytest

from glyphmill.llm import packing


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


def test_new_words_of_many_texts_are_tokenized_in_few_calls(path):
    own = packing.WordIds(path)
    calls, real = [], own.by_piece

    class Counted:
        def encode(self, text, **more):
            calls.append(text)
            return real.encode(text, **more)

    own.by_piece = Counted()
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) + rng.choice(["", ",", "'s", "!?7"]) for _ in range(40)) for _ in range(50)]
    assert own.of_all(texts) == [own.whole(t) for t in texts]
    n = len({p for t in texts for p in packing._PIECES.findall(t)})
    assert n > 1500 and len(calls) <= n // packing.JOINED + 1
    assert own.of_all(texts) == [own.whole(t) for t in texts] and len(calls) <= n // packing.JOINED + 1


def test_letters_whose_lower_case_lies_elsewhere(path):
    own = packing.WordIds(path)
    plain = [c for c in map(chr, range(0x2C80)) if packing._PLAIN.fullmatch(c) or packing._PLAIN.fullmatch(c.lower())]
    texts = ["Əli ƏLİ", "Ɓoye aƁ", "Ⱥx", *(t for c in plain for t in (c, f"{c}b", f"b{c}", f" {c}{c}'s", f"1{c}.", f"it's{c}'ll"))]
    want = [own.whole(t) for t in texts]
    assert [own.ids(t) for t in texts] == want
    assert packing.WordIds(path).of_all(texts) == want
    few = packing.WordIds(path, most=20)  # emptied again and again, also within a group
    assert [x for i in range(0, len(texts), 5) for x in few.of_all(texts[i : i + 5])] == want
    assert own.of_all([]) == [] and own.of_all(["", " \n", "日本", "<|endoftext|> a", "a"]) == [b"", b"", own.whole("日本"), own.whole("<|endoftext|> a"), own.whole("a")]


def test_groups_hold_every_row(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_CHARS", 10)
    rows = [(i, "x" * n, 0) for i, n in enumerate([0, 3, 40, 0, 9, 1, 5])]
    assert [[r[0] for r in g] for g in packing.grouped(iter(rows))] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [*packing.grouped(iter(()))] == []
    assert [len(g) for g in packing.grouped((i, "", 0) for i in range(2500))] == [1000, 1000, 500]
