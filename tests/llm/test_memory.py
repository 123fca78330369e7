"""What a worker keeps between tasks, and how much the words of a group of texts take."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from basalt.llm import substring_dedup
from basalt.llm.common import arrow_map
from basalt.llm.encoding import encoder


def test_another_operator_drops_the_encoders(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")

    def held(it):
        from basalt.llm.encoding import _encoders

        n = sum(b.num_rows for b in it)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(_encoders)] if n else [], pa.int32())})

    def encode(it):
        for b in it:
            encoder(path).encode(["a word"] * b.num_rows)
            yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int32())})

    rows = spark.range(4, numPartitions=4)
    counted = lambda f, keep: [r["n"] for r in arrow_map(rows, f, "n int", keep=keep).collect()]
    assert counted(encode, True) == [1] * 4
    assert sum(counted(held, True)) > 0  # workers are used again
    assert counted(held, False) == [0] * 4


def test_words_of_a_group_are_not_held():
    rng = random.Random(1)
    rows = [{"text": " ".join(f"{rng.randrange(10**6)}" for _ in range(2000)).encode()} for _ in range(100)]
    tracemalloc.start()
    windows = substring_dedup.Windows(substring_dedup._Words(rows))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 55 * 200_000  # bytes; 200,000 words as objects alone take 50 each
    plain = substring_dedup.Windows([r["text"].split() for r in rows])
    assert np.array_equal(windows.representatives(), plain.representatives())
    assert all(map(np.array_equal, windows.fingerprints(), plain.fingerprints()))
