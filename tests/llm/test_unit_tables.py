"""Unit tables: each unit is looked up once, whatever table or encoder knows it."""

import random

import numpy as np
import public_tokenizers
import pytest

from tallyspark.llm import grammar, units
from tallyspark.llm.token_alignment import PieceEncoder


class Counted(str):
    asked = 0

    def __hash__(self):
        Counted.asked += 1
        return str.__hash__(self)


def words(draw, n):
    """Distinct plain words, mixed units, line feeds, odd ones and a special string."""
    fixed = [" the", "\n", " <|endoftext|>", " ", "x\ty", " éé", " 漢字", " a1", " can't", "  two"]
    return list(dict.fromkeys([*fixed, *(" " + "".join(draw.choice("abcde7-") for _ in range(draw.randrange(1, 9))) for _ in range(n))]))


def test_tables_give_each_units_own_ids():
    draw = random.Random(3)
    for coder in (units.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json")), PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))):
        alone = {}
        for u in words(random.Random(4), 300):
            begin, size, ids = coder.lookup([u])
            alone[u] = ids[begin[0]:begin[0] + size[0]].tolist()
        coder.table, coder.old, coder.most = units.Table(), units.Table(), 60
        for _ in range(30):
            some = draw.sample(list(alone), draw.randrange(1, 50))
            begin, size, ids = coder.lookup(some)
            assert [ids[b:b + n].tolist() for b, n in zip(begin, size)] == [alone[u] for u in some]


def test_a_unit_is_hashed_once():
    coder = units.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    some = [Counted(f" w{i}") for i in range(100)]
    for _ in range(2):
        Counted.asked = 0
        coder.lookup(some)
        assert Counted.asked == len(some)


def test_colliding_kinds_of_pair(monkeypatch):
    """All kinds of pair share a place of the hash table; the grammar is the same."""
    draw = np.random.default_rng(7)
    ids = draw.integers(0, 40, 6000).astype("<u4")
    last = np.zeros(len(ids), bool)
    last[draw.integers(0, len(ids), 50)] = True
    want = grammar.repair(ids, last)
    monkeypatch.setattr(grammar, "MIX", np.uint64(0))
    for a, b in zip(want, grammar.repair(ids, last)):
        assert np.array_equal(a, b)


def test_new_units_are_searched_and_stored_at_once():
    coder = units.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    some = [f" w{i}" for i in range(50)]
    coder.lookup(some[:20])
    begin, size, ids = coder.lookup(some)
    assert all(a is b for a, b in zip(coder.table.slots, some))
    assert [ids[b:b + n].tolist() for b, n in zip(begin, size)] == [coder.whole.encode(u, add_special_tokens=False).ids for u in some]


def test_units_without_ids_are_forgotten(monkeypatch):
    coder = units.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))

    def fail(groups):
        raise MemoryError

    with monkeypatch.context() as m:
        m.setattr(coder, "_ask", fail)
        with pytest.raises(MemoryError):
            coder.lookup([" the", "x\ty"])
    begin, size, ids = coder.lookup(["x\ty"])
    assert ids[begin[0]:begin[0] + size[0]].tolist() == coder.whole.encode("x\ty", add_special_tokens=False).ids


def test_special_strings_of_letters_are_not_plain():
    from tokenizers import AddedToken, Tokenizer
    import tempfile
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.add_special_tokens([AddedToken("stopword", special=True)])
    with tempfile.TemporaryDirectory() as folder:
        whole.save(f"{folder}/t.json")
        coder = units.UnitEncoder(f"{folder}/t.json")
    for u in (" stopword", "stopwords", " stop", " word"):
        begin, size, ids = coder.lookup([u])
        assert ids[begin[0]:begin[0] + size[0]].tolist() == whole.encode(u, add_special_tokens=False).ids


def test_lengths_of_rules_level_by_level():
    draw = np.random.default_rng(5)
    sides = np.array([[draw.integers(0, 4 + i), draw.integers(0, 4 + i)] for i in range(20)], "<u4")
    chain = np.array([[0, 1], *([2 + i, 0] for i in range(200))], "<u4")
    for rows, base in ((sides, 4), (chain, 2), (sides[:0], 4)):
        want = []
        for a, b in rows.tolist():
            want.append(sum(want[x - base] if x >= base else 1 for x in (a, b)))
        assert grammar.expansion_lengths(rows, base).tolist() == want


def test_runs_of_one_symbol_pair_from_the_left():
    for n in range(16, 60):
        ids = np.array([5] * n + [7, 8], "<u4")
        last = np.zeros(len(ids), bool)
        last[[n - 1, n + 1]] = True
        payload = grammar.encode_shard(ids, [n, 2])
        assert [x.tolist() for x in grammar.Shard(payload).documents()] == [[5] * n, [7, 8]]
        symbols, _, sides, base = grammar.repair(ids, last)
        assert sides[0].tolist() == [5, 5] and len(symbols) == 2 + len(grammar.repair(ids[:n], last[:n])[0])
