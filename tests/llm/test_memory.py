"""What a worker and a task hold at once, whatever the input."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.llm import language_id as li


def test_tables_of_languages_are_made_in_place():
    rnd = random.Random(5)
    samples = {k: [bytes(rnd.choices(b"abcdefghijklmnopqrstuvwxyz ", k=20_000))] for k in "wxyz"}
    model = li.Model(samples)
    model.compile()
    tracemalloc.start()
    machine = model.compile()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * sum(g.cost.nbytes + g.next.nbytes for g in machine.groups)


def test_an_operator_without_tables_gives_those_of_the_last_one_up():
    rows = pa.RecordBatch.from_pydict({"text": ["a", "b"]})
    with common.resident(("tables",), lambda: "made"):
        assert [t.num_rows for t in common.batches(iter([rows]), 1 << 20)] == [2]
        assert common._RESIDENT
    assert common._RESIDENT
    assert [t.num_rows for t in common.batches(iter([rows]), 1 << 20)] == [2]
    assert not common._RESIDENT


def test_batches_of_texts_are_bounded(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))

    def sizes(it):
        for b in it:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    found = common.map_texts(texts, sizes, "n long, size long").agg(F.sum("n"), F.max("size")).first()
    assert found[0] == 3000
    assert found[1] < 1.5 * common.BATCH_BYTES
