"""The prefix trie against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, WORDS, rows

import __spark_entry__ as entry
from tallyspark.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def smallest(members):
    known = [m for m in members if m is not None]
    return min(known) if known else None


def brute(sequences):
    """Nodes of ``{conv_id: [(turn, words), ...]}``."""
    members, words = collections.defaultdict(list), {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            prefix = tuple(t for t, _ in s[:d])
            members[prefix].append(c)
            words[prefix] = s[d - 1][1] if d else 0
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * words[p]
    for p, some in members.items():
        ends = sorted(c for c in some if c is not None and len(sequences[c]) == len(p))
        out.append((smallest(some), len(p), smallest(members[p[:-1]]) if p else None, len(some), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(turns):
    """The contract's sequences of ``[(conv_id, turn, role, text)]``."""
    own = collections.defaultdict(list)
    for c, n, role, text in turns:
        own[c].append(((n is not None, n or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(s, key=lambda x: x[0])] for c, s in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        out[c] = [(t, len(WORDS.findall(t[1]))) for t in (own.get(c - c % 20, [])[:h] + s[h:] if c is not None else s)]
    return out


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def test_query(spark):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows("conversations")]
    assert found(entry.queries()["op12_prefix_trie"](spark, SF)) == brute(rebuilt(turns))


def run(spark, turns, tmp_path):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df.withColumn("path", df.text).withColumn("ids", df.turn).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return found(entry.queries()["op12_prefix_trie"](spark, str(tmp_path)))


def test_copies_nulls_and_long_conversations(spark, tmp_path):
    """A third of the conversations are equal, one is far longer than a band, some end up without turns."""
    random.seed(3)
    turns = [(c, n, "user", f"hello there {n}") for c in range(0, 60) for n in range(5)]
    turns += [(c, n, random.choice(["user", None]), random.choice(["a", "b c", "", None])) for c in range(60, 160) for n in range(random.randint(1, 6))]
    turns += [(200, n, "user", f"turn {n % 7}") for n in range(3 * prefix_trie.BAND)] + [(201, n, "user", f"turn {n % 7}") for n in range(150)]
    turns += [(None, 1, "user", "x"), (None, None, "user", "first"), (441, 0, "user", "lost"), (7001, None, None, None)]
    assert run(spark, turns, tmp_path) == brute(rebuilt(turns))


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("band", [1, 3, 64])
def test_levels_of_any_shards(seed, band, monkeypatch):
    """Shards cut anywhere in the order, merged by their open nodes; matrices of any width."""
    random.seed(seed)
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie.levels, "__defaults__", (band,))
    sequences = {c: [(bytes([x]) * 16, x) for x in random.choices(range(3), k=random.choice([0, 1, 2, 5, 9]))] for c in range(40)}
    sequences[None] = [(b"\1" * 16, 1)]
    order = sorted(sequences, key=lambda c: ([t for t, _ in sequences[c]], c is not None, c or 0))
    cuts = sorted(random.sample(range(1, len(order)), 4))
    out, pieces, shares = [], collections.defaultdict(list), {}
    for a, z in zip([0, *cuts], [*cuts, len(order)]):
        some = order[a:z]
        random.shuffle(some)
        flat = [t for c in some for t in sequences[c]]
        for batch in prefix_trie.shard_rows(pa.array([t for t, _ in flat], pa.binary()), np.array([w for _, w in flat], np.int64),
                                            np.array([len(sequences[c]) for c in some]), pa.array(some, pa.int64())):
            out += batch.to_pylist()
    for r in out:
        if r["path"] is not None:
            pieces[r["path"]] += r["ends"]
            kept = shares.setdefault(r["path"], {**r, "conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0})
            kept["conv_id"] = smallest([kept["conv_id"], r["conv_id"]])
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                kept[c] += r[c]
    merged = pa.RecordBatch.from_pylist(list(shares.values()))
    opened = [r for b in prefix_trie.roll_up_open([merged]) for r in b.to_pylist()]
    conv = {r["path"]: r["conv_id"] for r in opened}
    for r in out:
        if r["parent_path"] is not None:
            r["parent_conv_id"] = conv[r["parent_path"]]
    nodes = [{**r, "list": r["ends"]} for r in out if r["path"] is None] + [{**r, "list": pieces[r["path"]]} for r in opened]
    for r in nodes:
        r["ends_sha256"] = hashlib.sha256(",".join(map(str, sorted(r["list"]))).encode()).hexdigest()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in nodes), key=str) == brute(sequences)
