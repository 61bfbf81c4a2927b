"""What a worker holds while it encodes stays bounded, whatever the texts; ids do not depend on it."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from tracewell.llm import bpe


@pytest.fixture(scope="module")
def model():
    return bpe.load_model(bpe.default_tokenizer())


def test_a_worker_stays_small(model):
    """Texts of words that hardly repeat, in one batch of rows."""
    r = random.Random(5)
    texts = [" ".join(f"{r.choice('xyz')}{r.randrange(36**5):x}" for _ in range(1000)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    codec, last = bpe.Codec(model), None
    tracemalloc.start()
    rows = 0
    for part, some in bpe._slices(iter([batch])):
        flat, counts = codec.encode_many(some)
        rows += part.num_rows
        last = flat[flat.size - counts[-1] :].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and codec.decode(last) == texts[-1] and peak < 120e6, peak


def test_kept_parts_are_bounded_in_characters_and_words(model):
    """Parts without spaces are as long as their lines, and may hold many words."""
    r = random.Random(6)
    long = ["".join(r.choice("abc漢字é") for _ in range(9000)) for _ in range(8)]
    mixed = ["".join(f"{r.choice('xyz')}{r.randrange(10**6)}" for _ in range(600)) for _ in range(4)]
    small, large = bpe.Codec(model, cached=200), bpe.Codec(model)
    for text in [*long, *mixed, *long]:
        ids = small.encode_many([text])[0]
        assert ids.tolist() == large.encode_many([text])[0].tolist() and small.decode(ids.tolist()) == text
        assert len(small.words) <= 200 and sum(map(len, [*small.pieces, *small.words])) <= 200 * 32
