"""Long pieces: chunks inside of a piece, their state maps, and the bound of the table, against the library."""

import random

import pytest

from folioforge.llm import queries, transducer

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary("byte_bpe_50k.json")


def expected(path, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def long_pieces(rng):
    return [
        "".join(rng.choice(LETTERS) for _ in range(12000)), "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(5000)), "a" * 30001, "ab" * 9000, ("a" * 17 + "b") * 900, "-" * 9000,
        "".join(rng.choice(["the", "house", "tion", "ing"]) for _ in range(4000)), " " * 9000 + "x", "x " + "9" * 5000 + " y", "don't " * 3000, "é" * 7000,
    ]


def test_long_pieces(path):
    texts = long_pieces(random.Random(5))
    assert transducer.Transducer(path).counts(texts).tolist() == expected(path, texts)


def test_a_full_table_starts_anew(path, monkeypatch):
    monkeypatch.setattr(transducer, "MAX_STATES", 300)
    rng = random.Random(6)
    texts = [x[:3000] for x in long_pieces(rng)] + ["hello world"]
    machine = transducer.Transducer(path)
    assert machine.counts(texts).tolist() == expected(path, texts)
    assert len(machine.states) < 300 + 2 * len(texts) + 100 and len(machine.table) <= 4096


@pytest.mark.parametrize("warm", [0, 3])
def test_small_chunks(path, monkeypatch, warm):
    monkeypatch.setattr(transducer, "CHUNK", 16)
    monkeypatch.setattr(transducer, "WARM", warm)
    rng = random.Random(7)
    parts = [["a", "b", "the", "ing", "é", "日", " ", "  ", "'s", "\n", "12"], list("abcdet")]
    texts = ["".join(rng.choice(parts[i % 2]) for _ in range(rng.randrange(300))) for i in range(200)]
    machine = transducer.Transducer(path)
    assert [int(machine.counts([x])[0]) for x in texts] == expected(path, texts) == machine.counts(texts).tolist()


def test_the_table_is_bounded_by_cells(path, monkeypatch):
    monkeypatch.setattr(transducer, "MAX_TABLE", 64 * 250)
    texts = [x[:2500] for x in long_pieces(random.Random(8))]
    machine = transducer.Transducer(path)
    assert machine.counts(texts).tolist() == expected(path, texts) and machine.table.dtype.itemsize == 4


def test_other_patterns_are_refused(path, tmp_path):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    for change in ({"pre_tokenizer": pre_tokenizers.Whitespace()}, {"pre_tokenizer": pre_tokenizers.ByteLevel(add_prefix_space=True)}, {"normalizer": normalizers.Lowercase()}):
        other = Tokenizer.from_file(path)
        for name, value in change.items():
            setattr(other, name, value)
        other.save(str(tmp_path / "other.json"))
        with pytest.raises(ValueError):
            transducer.Transducer(str(tmp_path / "other.json"))
