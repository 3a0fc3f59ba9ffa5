"""Groups of lines that are verified at once give the components of a pair-by-pair comparison."""

import random

import numpy as np

from tallyspark.llm import line_dedup
from tallyspark.llm.common import local_roots


def shingles(line):
    line = line.ljust(line_dedup.SHINGLE, "\0")
    return {line[i:i + line_dedup.SHINGLE] for i in range(len(line) - line_dedup.SHINGLE + 1)}


def near(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) >= line_dedup.SIMILARITY


def test_linked_groups_equal_pairs():
    draw = random.Random(5)

    def edited(line):
        i = draw.randrange(len(line) + 1)
        return line[:i] + draw.choice("abcé漢") + line[i + draw.randrange(2):]

    groups, want, node = [], [], 0
    for _ in range(300):
        base = "".join(draw.choice("abcdefgh ") for _ in range(draw.choice([1, 6, 7, 30, 60])))
        lines = [base]
        for _ in range(draw.choice([1, 1, 2, 5])):
            lines.append(edited(draw.choice(lines)) if draw.random() < 0.8 else "another line " + str(draw.random()))
        tiles = [draw.randrange(2) if draw.random() < 0.2 else 0 for _ in lines]
        two = len(set(tiles)) == 2
        nodes = list(range(node, node + len(lines)))
        groups.append((nodes, lines, tiles))
        want += [(nodes[i], nodes[j]) for i in range(len(lines)) for j in range(i)
                 if not (two and tiles[i] == tiles[j]) and near(lines[i], lines[j])]
        node += len(lines)
    found = line_dedup.linked_groups(groups, line_dedup.SIMILARITY)
    assert local_roots(node, found) == local_roots(node, want)
    assert len(found) < len(want)


def test_first_lines_of_groups():
    lines = ["the same line of text", "the same line of text", "", "x", "x", "the same line of texts"]
    assert line_dedup.near_first(lines, np.array([0, 0, 2, 3, 3, 3]), 0.8).tolist() == [True, True, True, True, True, False]


def test_bands_and_hashes_of_an_empty_batch_and_of_repeated_lines(spark):
    """Only the first place of a line in a batch has bands; a batch without lines gives none."""
    docs = spark.createDataFrame([(1, "same line\n\n same line \nother"), (2, " \n"), (3, None), (None, "other\nsame line")], "doc_id long, text string").coalesce(1)
    got = line_dedup.occurrences(docs, "doc_id", "text").collect()
    assert [(r.doc_id, r.pos, r.line) for r in got] == [
        (d, p, line_dedup.line_key(x)) for d, p, x in [(1, 0, "same line"), (1, 2, "same line"), (1, 3, "other"),
                                                       (line_dedup.NULL_KEY, 0, "other"), (line_dedup.NULL_KEY, 1, "same line")]]
    assert [r.bands for r in got] == [line_dedup.band_keys(["same line"])[0].tolist(), None, line_dedup.band_keys(["other"])[0].tolist(), None, None]
    assert line_dedup.occurrences(docs.filter("doc_id = 2"), "doc_id", "text").collect() == []


def test_hashes_are_sorted_without_their_places(monkeypatch):
    """Lines are told apart by one sort of numbers; the stable sorts of places took most of the time of a group."""
    kinds, sort = [], np.argsort
    monkeypatch.setattr(line_dedup.np, "argsort", lambda x, *a, **k: kinds.append(k.get("kind")) or sort(x, *a, **k))
    lines = ["abcdefghij abcdefghij", "abcdefghij abcdefghij!", "something else", "abcdefghij abcdefghij abcdefghij", "xyz", "xyz"]
    first = np.array([0, 0, 0, 0, 4, 4])
    want = [near(x, lines[f]) for x, f in zip(lines, first)]
    assert line_dedup.near_first(lines, first, line_dedup.SIMILARITY).tolist() == want
    assert kinds == [None]
