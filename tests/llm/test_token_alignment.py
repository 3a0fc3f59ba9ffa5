"""Token alignment against a plain walk over both token lists."""

import collections
import functools
import hashlib

import public_tokenizers
import pytest
from helpers import SF, awkward, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tallyspark.llm import token_alignment
from tallyspark.llm.units import byte_letters

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def tokens(text):
    """(id, bytes) of both sides, or nothing where they are not the text."""
    a, b = libraries()
    letter = {c: x for x, c in byte_letters().items()}
    whole = (" " + text).encode()
    left = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if not text or any(b"".join(t for _, t in side) != whole for side in (left, right)):
        return [], []
    return left, right


def groups_of(left, right):
    def ends(side):
        at, out = 0, []
        for _, t in side:
            at += len(t)
            out.append(at)
        return out
    ea, eb = ends(left), ends(right)
    out, i, j = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        a, b = [], []
        while i < len(ea) and ea[i] <= end:
            a.append(left[i][0])
            i += 1
        while j < len(eb) and eb[j] <= end:
            b.append(right[j][0])
            j += 1
        out.append((a, b))
    return out


def brute(docs):
    all_groups = [(k, *tokens(t or "")) for k, t in docs]
    all_groups = [(k, left, right, groups_of(left, right)) for k, left, right in all_groups]
    count = collections.Counter()
    for *_, groups in all_groups:
        count.update({(x, y) for a, b in groups for x in a for y in b})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for k, left, right, groups in all_groups:
        links = [(x, y) for a, b in groups for x in a for y in b]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((k, len(left), len(right), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if left else ""))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query(spark):
    assert found(entry.queries()["op13_token_alignment"](spark, SF)) == brute([(r["doc_id"], r["text"]) for r in rows()])


def test_awkward_rows(spark):
    docs = awkward(spark).unionByName(awkward(spark)).repartition(3)
    docs = docs.unionByName(spark.createDataFrame([(50, " leading", "en"), (51, "  two", "en"), (52, " ", "en"), (53, "end ", "en"),
                                                   (54, "<s>x</s> <unk>", "en"), (55, "🙂🙃 x", "en")], "doc_id long, text string, lang string"),
                            allowMissingColumns=True)
    got, pairs = token_alignment.align(docs, A_PATH, B_PATH)
    assert found(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert pairs.count() == pairs.select("a", "b").distinct().count() > 0
    assert found(token_alignment.align(empty(spark), A_PATH, B_PATH)[0]) == []


@pytest.mark.parametrize("many, at_once", [(0, 1), (3, 7), (1 << 10, 1 << 22)])
def test_groups_of_many_links(many, at_once, monkeypatch):
    """Links counted by distinct ids are the links laid out."""
    import pyarrow as pa
    monkeypatch.setattr(token_alignment, "MANY_LINKS", many)
    monkeypatch.setattr(token_alignment, "PAIRS_AT_ONCE", at_once)
    texts = ["thstorn aeiou zzzzzzzzzz 漢字漢字漢字", "a", "", "=====-----===== anan"]
    a, b = (token_alignment.kept(kind, path) for kind, path in ((token_alignment.PlainEncoder, A_PATH), (token_alignment.PieceEncoder, B_PATH)))
    row = token_alignment.align_block(3, pa.array([1, 2, 3, None], pa.int64()), pa.array(texts), a, b).to_pylist()[0]
    want = [groups_of(*tokens(t)) for t in texts]
    assert row["n_links"] == [sum(len(x) * len(y) for x, y in g) for g in want]
    count = collections.Counter(p for g in want for p in {(x, y) for a, b in g for x in a for y in b})
    assert dict(zip(zip(row["a"], row["b"]), row["n"])) == count


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9'st\n\t .,é漢▁　\x01<s>"), max_size=25), min_size=1, max_size=5))
def test_ids_of_both_sides(texts):
    """Cut texts give the libraries' ids."""
    import pyarrow as pa
    lib_a, lib_b = libraries()
    a, b = (token_alignment.kept(kind, path) for kind, path in ((token_alignment.PlainEncoder, A_PATH), (token_alignment.PieceEncoder, B_PATH)))
    n, ids = a.encode(pa.array(texts, pa.string()))
    assert token_alignment.listed(n, ids).to_pylist() == [lib_a.encode(t, add_special_tokens=False).ids for t in texts]
    n, ids = b.encode(pa.array(texts, pa.string()))
    assert token_alignment.listed(n, ids).to_pylist() == [lib_b.encode(t) for t in texts]
