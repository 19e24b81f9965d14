import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lintlake.llm import common, language, packing


@pytest.fixture
def cache():
    held = common.worker_cache()
    before = dict(held)
    held.clear()
    yield held
    held.clear()
    held.update(before)


def test_a_worker_lets_the_models_of_another_operator_go(cache):
    """Spark keeps workers: the tokenizer of one stage is not held while others run."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pa.record_batch([pa.array([1]), pa.array(["some words"]), pa.array([0])], names=["doc_id", "text", "group"])
    cut = common.tidy("tokens", packing._cut(path, False, 1, 4096))
    first = [b.to_pylist() for b in cut([rows])]
    encoder = cache[path, False]
    assert [b.to_pylist() for b in cut([rows])] == first and cache[path, False] is encoder
    texts = pa.record_batch([pa.array(["some words", None])], names=["text"])
    texts = texts.add_column(1, "lang", pa.array(["en", "en"]))
    assert sum(b.num_rows for b in common.tidy("language", language._count)([texts])) > 0
    assert (path, False) not in cache and "letters" in cache


def test_cells_of_many_short_texts_need_little_memory():
    """The table of counts is not as large as all texts times all bins."""
    rng = random.Random(4)
    counts = [rng.choice([0, 1, 40]) for _ in range(500)]
    of = np.repeat(np.arange(500), counts)
    bins = np.array([rng.randrange(30) * 500 for _ in of], np.int64)
    table = np.random.default_rng(4).random((language.BINS, 3)).astype(np.float32)
    table /= table.sum(axis=0)
    tracemalloc.start()
    shares, fits, totals = language.mixture(bins, of, 500, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    assert totals.tolist() == counts
    plain = np.bincount(of * language.BINS + bins, minlength=500 * language.BINS)
    used, n = language._cells(bins, of, 500)
    assert used.tolist() == np.flatnonzero(plain).tolist() and n.tolist() == plain[used].tolist()
    for texts in (0, 3):
        used, n = language._cells(bins[:0], of[:0], texts)
        assert len(used) == len(n) == 0
