"""A worker keeps one operator's models at a time."""

import gc
import weakref

import public_tokenizers
import pyarrow as pa

from tallyspark.llm import packing, toxicity, units
from tallyspark.llm.common import process_cache

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_another_operators_models_go():
    settings = toxicity.Settings(buckets=64)
    book = process_cache("toxicity").setdefault("book", toxicity.Words(settings))
    assert process_cache("toxicity")["book"] is book
    seen = weakref.ref(book)
    del book
    coder = units.encoder(BPE)
    gc.collect()
    assert seen() is None and "book" not in process_cache("units")
    # packing keeps its table beside the encoder
    assert len(packing.sentence_ends(BPE)) and units.encoder(BPE) is coder
    process_cache("lines")
    assert units.encoder(BPE) is not coder


def test_workers_forget_the_operator_before(spark):
    def fill(batches):
        process_cache("toxicity")["left"] = bytes(1 << 20)
        yield from batches

    def kept(batches):
        units.encoder(BPE)
        import sys
        module = sys.modules["_tallyspark_worker_cache"]
        for batch in batches:
            yield batch.from_pydict({"left": [int(k == "left") for k in module.kept]})

    rows = spark.range(8, numPartitions=2)
    assert rows.mapInArrow(fill, "id long").count() == 8
    assert {r["left"] for r in rows.mapInArrow(kept, "left long").collect()} == {0}


def test_packing_keeps_a_smaller_table(spark):
    def most(batches):
        coder = units.encoder(BPE, 7)
        mine, others = coder.most, units.encoder(BPE).most
        for batch in batches:
            yield batch.from_pydict({"mine": [mine], "others": [others]})

    row, = spark.range(1, numPartitions=1).mapInArrow(most, "mine long, others long").collect()
    assert (row["mine"], row["others"]) == (7, units.TABLE_UNITS)
    assert packing.PACK_UNITS < units.TABLE_UNITS
    run = packing.pack.__code__.co_consts  # the worker's function names the bound
    assert any("PACK_UNITS" in c.co_names for c in run if hasattr(c, "co_names"))


def test_memory_of_cutting_is_given_back(monkeypatch):
    coder, given = units.UnitEncoder(BPE), []
    monkeypatch.setattr(units.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(1)})())
    assert coder.encode(pa.array(["a b c", None]))[0].tolist() == [3, 0] and given == [1]
