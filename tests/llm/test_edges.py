"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import AWKWARD, awkward, crc, empty, no_labels
from hypothesis import example, given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tallyspark.llm import (common, grammar, line_dedup, lz_fingerprint, packing, quality, sentencepiece_backend, sharding, simhash,
                            token_counts, toxicity, units)

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


def test_units_equal_whole_texts(tokenizer):
    texts = [t for _, t, _ in AWKWARD] + ["", " ", "\n", "\n\n", " a", "a ", "a\n", "\na", "a  b", "a \n b", "don't  'll", "²ª¼ x² ½", "x\x01y z"]
    n, ids = units.UnitEncoder(BPE).encode(pa.array(texts))
    assert n.tolist() == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t or "", add_special_tokens=False).ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("ab1.,'|<>é漢 \n\t\u00a0\x01") + ["<|endoftext|>", "'s", "  "]), max_size=30).map("".join), max_size=4))
def test_units_equal_whole_texts_property(texts):
    from tokenizers import Tokenizer
    whole, coder = _shared.setdefault("t", (Tokenizer.from_file(BPE), units.UnitEncoder(BPE)))
    n, ids = coder.encode(pa.array(texts, pa.string()))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


_shared = {}


def shared_backend(name):
    if name not in _shared:
        _shared[name] = sentencepiece_backend.Backend(PIECES)
    return _shared[name]


def test_full_tables_start_afresh(tokenizer, monkeypatch):
    monkeypatch.setattr(units, "TABLE_UNITS", 3)
    coder = units.UnitEncoder(BPE)
    for text in ("a b c d e f", "g h i j", "a b " + "w" * 200):
        assert coder.encode(pa.array([text]))[1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(list("ab .é漢\n▁\x1e") + ["  ", "     ", "the ", " \x1e", "🙂"]), max_size=30).map("".join))
def test_sentencepiece_parity_property(text):
    back = shared_backend("whole")
    sp = back.reference
    (ids, same, decoded), = back.run([text])
    want = sp.encode(text)
    assert same and ids.tolist() == want
    assert decoded == sp.decode(want) and back.encode([text]) == [want]


@settings(max_examples=400, deadline=None)
@example(["\x1e "])
@given(st.lists(st.lists(st.sampled_from(list("ab .é漢\n▁\x1e🙂") + ["the ", " of"]), max_size=12).map("".join), max_size=8))
def test_sentencepiece_joined_units_equal_single_ones(texts):
    back, one = shared_backend("joined"), shared_backend("single")
    assert back.split_id is not None
    one.split_id = None
    back.known, one.known = {}, {}
    for a, b in zip(back.run(texts), one.run(texts), strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1:] == b[1:]


def test_sentencepiece_unigram_model(tmp_path):
    """A small unigram model with byte fallback, written by hand as protobuf."""
    import struct
    import sentencepiece

    def field(n, data):
        return bytes([n << 3 | 2, *varint(len(data))]) + data

    def varint(x):
        out = []
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return [*out, x]

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))

    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    data += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    data += b"".join(piece(t, s, 1) for t, s in [("▁", -3.0), ("▁ab", -1.5), ("a", -4.0), ("b", -4.1), ("ab", -2.5), ("c", -4.2), ("bc", -2.0)])
    data += field(2, bytes([3 << 3, 1]) + bytes([35 << 3 & 127 | 128, 2, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))
    path = str(tmp_path / "small.model")
    with open(path, "wb") as f:
        f.write(data)
    sp, back = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_backend.Backend(path)
    texts = ["ab", "abc ab", "aab", "cab bca", "", "é ab"]
    assert [r[0].tolist() for r in back.run(texts)] == [sp.encode(t) for t in texts] and all(r[1] for r in back.run(texts))


def test_op1_rows(spark):
    got = sentencepiece_backend.encode_decode(awkward(spark), PIECES, keep=("doc_id", "tile")).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _, _ in AWKWARD)
    assert all(r["decoded"] == "" and r["ids"] == [] for r in got if r["doc_id"] in (7, 8))
    assert sentencepiece_backend.digests(empty(spark), PIECES).count() == 0


def test_op2_rows(spark):
    got = sharding.place(awkward(spark), "doc_id", ["a", "b"], 101, "tile").collect()
    assert len(got) == len(AWKWARD) and {r["tile"] for r in got} <= {"a", "b"}
    assert len({r["tile"] for r in got if r["doc_id"] is None}) == 1
    assert sharding.place(empty(spark), "doc_id", ["a"], 101).count() == 0
    weighted = sharding.fill_table(["a", "b"], 1009, {"b": 3})
    assert abs(sum(weighted) / 1009 - 0.75) < 0.01
    for names, size in (([], 101), (["a", "a"], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sharding.fill_table(names, size)


def test_op3_rows(spark):
    df = awkward(spark)
    got = [(r["doc_id"], r["n_lines"], r["dropped"]) for r in line_dedup.dedup_report(df).collect()]
    assert len(got) == len(AWKWARD)
    by = dict((i, (n, d)) for i, n, d in got)
    assert by[11] == (4, [1, 3]) and by[9] == (0, []) and by[7] == (0, [])
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    texts = collections.defaultdict(list)
    for r in out.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[11] == ["One line.\nAnother line that is long enough."] and texts[7] == [None] and texts[5] == ["plain words go here"] * 2
    assert line_dedup.dedup_report(empty(spark)).count() == 0 and line_dedup.dedup_lines(empty(spark)).columns == df.columns


def test_op3_fuzzy_and_tiles(spark, monkeypatch):
    """Near copies of one line, more than a tile holds, are one component; another line stays."""
    monkeypatch.setattr(line_dedup, "TILE", 16)
    base = "the quick brown fox jumps over the lazy dog near the old river bank while the sun goes down slowly " * 2
    rows = [(i, base + f"{i:03d}", "en") for i in range(60)] + [(100, "a line of its own that nothing else is like at all", "en")]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.dedup_report(awkward(spark, rows)).collect()}
    assert got[0] == [] and got[100] == [] and all(got[i] == [0] for i in range(1, 60))


def test_op4_rows(spark):
    got = lz_fingerprint.edited_fingerprints(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    same = [r for r in got if r["doc_id"] == 5]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and sorted(r["near_next"] for r in same)[-1] == 1.0
    assert all(r["fingerprint"] == lz_fingerprint.EMPTY and r["n_chars"] == 0 for r in got if r["doc_id"] in (7, 8))
    alone = lz_fingerprint.edited_fingerprints(awkward(spark, [(1, "abcdef", "en")])).collect()
    assert alone[0]["near_next"] == 1.0 and lz_fingerprint.edited_fingerprints(empty(spark)).count() == 0
    assert lz_fingerprint.text_fingerprints(awkward(spark)).count() == len(AWKWARD)


def test_op4_order_does_not_depend_on_blocks(spark):
    rows = [(i * 37 % 101, f"text number {i} " * (i % 7), "en") for i in range(101)]
    df = awkward(spark, rows)
    a = {tuple(r) for r in lz_fingerprint.edited_fingerprints(df).collect()}
    b = {tuple(r) for r in lz_fingerprint.edited_fingerprints(df.repartition(5)).collect()}
    assert a == b and len(a) == 101
    texts = {i: t for i, t, _ in rows}
    for r in a:
        nxt = texts[(r[0] - 1) % 101]
        assert r[6] == lz_fingerprint.likeness(*(lz_fingerprint.Parse().feed(x.encode()).signature() for x in (texts[r[0]], nxt)))


def test_op5_rows(spark):
    labels = spark.createDataFrame([(5, None, 1), (12, None, 0), (13, None, 0), (None, None, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, no_labels(spark)):
        model = toxicity.fit(awkward(spark), marks)
        got = toxicity.scored(awkward(spark), model, column="tile").collect()
        assert len(got) == len(AWKWARD) and all(0 <= r["tile"] <= 1 for r in got)
        assert len({r["tile"] for r in got if r["text"] in ("", None)}) == 1
    assert toxicity.scored(empty(spark), model).count() == 0


def test_op6_rows(spark, tokenizer):
    got = token_counts.token_counts(awkward(spark), BPE, keep=("doc_id", "text", "tile")).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(empty(spark), BPE).count() == 0


def test_op7_rows_and_tiles(spark, monkeypatch):
    got = simhash.near_groups(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {None, 7, 8, 9} and {r["component_id"] for r in zero} == {7}
    assert simhash.near_groups(empty(spark)).count() == 0
    kept = simhash.keep_one(awkward(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 1 and 7 in ids and 8 not in ids and kept.columns == awkward(spark).columns
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "SUBTILE", 4)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(s) ^ (1 << int(b)) ^ (1 << int(c)) for s in seeds for b, c in rng.integers(0, 63, (30, 2))}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(nodes)).collect()}
    order = sorted(fps)
    want = common.local_roots(len(order), [(i, j) for i in range(len(order)) for j in range(i) if (order[i] ^ order[j]).bit_count() <= 2])
    for i, f in enumerate(order):
        assert roots.get(f, f) == order[want[i]]


def test_op8_rows(spark):
    labels = spark.createDataFrame([(5, 1, None), (12, 0, None), (None, 1, None), (12, None, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, no_labels(spark)):
        got = quality.rate(awkward(spark), marks).collect()
        assert len(got) == len(AWKWARD) and not any(r["kept"] for r in got if r["doc_id"] in (7, 8, 9))
        assert quality.keep_good(awkward(spark), marks).columns == awkward(spark).columns
    assert quality.rate(empty(spark), no_labels(spark)).count() == 0


def test_op8_promise_holds():
    """With no rule of any use, false rejections stay within the promise; a telling rule is found."""
    assert quality.binomial_tail(0, 10, 0.1) == pytest.approx(0.9 ** 10) and quality.binomial_tail(10, 10, 0.3) == 1
    assert quality.binomial_tail(2, 40, 0.05) == pytest.approx(sum(__import__("math").comb(40, i) * 0.05 ** i * 0.95 ** (40 - i) for i in range(3)))
    assert quality.certified([0, 0, 5, 0], 1000, 0.01, 0.002) == 2 and quality.certified([0], 50, 0.01, 0.002) == 0


def test_op8_finds_symbol_soup(spark):
    good = [(i, "some plain words that nobody would ever reject at all " + " ".join("xyzuvwabc"[:i % 9]), "en") for i in range(900)]
    bad = [(1000 + i, "soup ### of %%% symbols *** in $$$ a &&& row ||| " * 2 + str(i), "en") for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.rate(awkward(spark, good + bad), labels, alpha=0.02).collect()}
    assert sum(not got[i]["kept"] for i, _, _ in good) == 0
    assert not any(got[i]["kept"] for i, _, _ in bad)


def test_op9_rows(spark, tokenizer):
    got = packing.pack(awkward(spark), BPE, chunk=4096).collect()
    ids = {i: (tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in AWKWARD if i is not None}
    for i, want in ids.items():
        copies = sum(j == i for j, _, _ in AWKWARD)
        assert sum(r["length"] for r in got if r["doc_id"] == i) == copies * len(want)
    assert all(r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]) for r in got if r["doc_id"] is not None)
    assert packing.pack(empty(spark), BPE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 1, 5])), min_size=1, max_size=25))
def test_best_cuts_are_cheapest(steps):
    """Against plain dynamic programming over all earlier places."""
    places = np.cumsum([0] + [s for s, _ in steps])
    costs = np.array([0] + [c for _, c in steps[:-1]] + [0])
    window, overhead = 16, 3

    def price(i, j):
        size = int(places[j] - places[i])
        return np.inf if size > window else costs[j] + overhead + (0 if size & (size - 1) == 0 else window - size)

    best = [0.0]
    for j in range(1, len(places)):
        best.append(min(best[i] + price(i, j) for i in range(j)))
    ends = packing.best_cuts(places, costs, window, overhead)
    at = [0] + [places.tolist().index(e) for e in ends]
    assert ends[-1] == places[-1]
    assert sum(price(i, j) for i, j in zip(at, at[1:])) == pytest.approx(best[-1])


def test_op10_rows(spark, tokenizer, tmp_path):
    folder = str(tmp_path / "shards")
    grammar.write_shards(awkward(spark), BPE, folder, shard_ids=300)
    got = grammar.read_shards(spark, folder).collect()
    assert len(got) == len(AWKWARD)
    want = collections.Counter((i, len(x := tokenizer.encode(t or "", add_special_tokens=False).ids + [2]), crc(x)) for i, t, _ in AWKWARD)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    none = str(tmp_path / "none")
    grammar.write_shards(empty(spark), BPE, none)
    assert grammar.read_shards(spark, none).count() == 0
    with pytest.raises(ValueError):
        grammar.Shard(b"????" + bytes(16))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(3, 6), max_size=40), min_size=1, max_size=8))
def test_repair_round_trip(texts):
    ids = np.array([i for t in texts for i in [*t, 2]], "<u4")
    counts = [len(t) + 1 for t in texts]
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, ends, sides, base = grammar.repair(ids, last, least=2)
    assert ends.sum() == len(texts)
    lengths = grammar.expansion_lengths(sides, base)
    assert sum(int(lengths[s - base]) if s >= base else 1 for s in symbols.tolist()) == len(ids)
    shard = grammar.Shard(grammar.encode_shard(ids, counts))
    assert [x.tolist() for x in shard.documents()] == [[*t, 2] for t in texts]


def test_components_on_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Every stage keeps the columns; empty tables pass through all of them."""
    folder = str(tmp_path)
    no_labels(spark).write.parquet(f"{folder}/labels.parquet")
    for df in (awkward(spark), empty(spark)):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == df.columns, name
            docs = common.written(out, name)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert (pieces.count() > 0) == (docs.count() > 0)


def most_frequent(symbols, last):
    """The largest number of places without overlap that one pair of neighbours has."""
    seen, at = collections.Counter(), {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if not last[i] and at.get(pair, -2) < i - 1:
            at[pair] = i
            seen[pair] += 1
    return max(seen.values(), default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(3, 5), max_size=60), min_size=1, max_size=8), st.integers(2, 4), st.integers(1, 4))
def test_repair_leaves_no_frequent_pair(texts, least, per_round):
    ids = np.array([i for t in texts for i in [*t, 2]], "<u4")
    last = np.zeros(len(ids), bool)
    last[np.cumsum([len(t) + 1 for t in texts]) - 1] = True
    symbols, ends, sides, base = grammar.repair(ids, last, per_round=per_round, least=least)
    assert most_frequent(symbols.tolist(), ends.tolist()) < least
    assert all(max(pair) < base + i for i, pair in enumerate(sides.tolist()))


def test_repair_shrinks_long_copies():
    """Copies of 3000 ids become few symbols each, whatever the number of rounds it takes."""
    copy = np.random.default_rng(5).integers(3, 50_000, 3000)
    ids, counts = np.tile(np.append(copy, 2), 20).astype("<u4"), [3001] * 20
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, ends, _, _ = grammar.repair(ids, last)
    assert most_frequent(symbols.tolist(), ends.tolist()) < grammar.LEAST and len(symbols) == 20
    shard = grammar.Shard(grammar.encode_shard(ids, counts))
    assert all(np.array_equal(x, ids[:3001]) for x in shard.documents())
    assert [shard.token(7, j) for j in (0, 1, 1500, 2999, 3000)] == [int(ids[j]) for j in (0, 1, 1500, 2999, 3000)]
