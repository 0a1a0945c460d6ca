import tracemalloc

import numpy as np

from tessera.llm import bpe, common, quality

RANKS = bpe.vocabulary(bpe.VOCABULARY)


def test_a_process_keeps_the_words_of_one_stage():
    texts = [" ".join(f"Word{k}x{i}" for i in range(k, k + 500)) for k in range(40)]
    encoder = bpe.Encoder(RANKS)
    votes = lambda: quality.Measured(quality._TOKENS, texts).votes().tolist()
    hashed = lambda: [common.hashes(common.words(t)).tolist() for t in texts]
    ids = lambda: [x.tolist() for x in encoder.encode(texts)]
    kept = lambda: (len(quality._TOKENS.index), len(common._HASHES), len(encoder.known))
    first = []
    for k, stage in enumerate((votes, hashed, ids)):
        first.append(stage())
        assert [n > 0 for n in kept()] == [k == 0, k == 1, k == 2]
    assert [votes(), hashed(), ids()] == first  # what was emptied is computed again, alike


def test_stages_one_after_another_need_no_more_than_the_largest():
    texts = [" ".join(f"w{k}x{i}" for i in range(1000)) for k in range(60)]
    encoder = bpe.Encoder(RANKS)
    stages = (lambda: quality.Measured(quality._TOKENS, texts), lambda: [common.hashes(common.words(t)) for t in texts], lambda: encoder.encode(texts))
    common._HASHES.clear()
    quality._TOKENS.forget()
    quality._bucket.cache_clear()
    tracemalloc.start()
    try:
        left = []
        for stage in stages:
            stage()
            left.append(tracemalloc.get_traced_memory()[0])
        assert max(left) < 1.2 * left[0], left  # the first keeps most
    finally:
        tracemalloc.stop()


def test_pieces_are_small():
    import pyarrow as pa

    texts = ["x" * int(n) for n in np.random.default_rng(3).integers(0, 60_000, 150)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    pieces = list(common.over_texts([batch]))
    assert [t for _, some in pieces for t in some] == texts
    assert max(sum(map(len, some)) for _, some in pieces) <= common.PIECE + 60_000
    assert [t for some in quality._pieces(batch.column("text")) for t in some] == texts
