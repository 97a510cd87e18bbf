"""A batch whose last row fills up the segments looked up together, and a batch without rows (F2)."""

import public_tokenizers
import pyarrow as pa

from ferrule.llm import sentencepiece_bpe


def lengths(texts: list[str]) -> list[int]:
    def finish(v, ids, upto):
        return ((upto[1:] - upto[:-1]).tolist(),)

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    run = sentencepiece_bpe._pieces(public_tokenizers.path("piece_bpe_32k.model"), [("id", pa.int64()), ("n", pa.int64())], finish)
    return [n for out in run([batch]) for n in out.column(1).to_pylist()]


def test_last_row_fills_the_segments(monkeypatch):
    texts = ["one two", "three four five", "six"]
    whole = lengths(texts)
    assert len(whole) == 3 and min(whole) > 0
    for most in range(1, 8):
        monkeypatch.setattr(sentencepiece_bpe, "MOST_SEGMENTS", most)
        assert lengths(texts) == whole
    assert lengths([]) == []
