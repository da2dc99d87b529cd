"""What the substring operators compare, and how much of it at a time."""

import numpy as np
import pyarrow as pa
import pytest

from sparkweir.llm import repeats, suffix_dedup

SHAPE = repeats.Shape(50, 16, "earlier")


def entries(texts):
    found = repeats.segments(np.concatenate([suffix_dedup.tokenize(t) for t in texts]), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.ones(sum(map(len, texts)), bool), SHAPE)
    out = np.zeros(len(found["at"]), repeats.ENTRY)
    for name in out.dtype.names:
        if name in found:
            out[name] = found[name]
    out["doc"], out["start"] = found["piece"], found["at"]
    return out


@pytest.mark.parametrize(("length", "asked"), [(41, False), (50, True)])
def test_segments_that_share_less_than_a_window_are_hardly_asked_for(length, asked):
    """F1"""
    rnd = np.random.default_rng(length)
    some = lambda n: bytes(rnd.integers(0, 256, n, np.uint8))
    texts = []
    for _ in range(100):
        shared = some(length)
        texts += [some(80) + shared + some(80), some(90) + shared + some(70)]
    left, spans = repeats.settle(entries(texts), SHAPE)
    requests = repeats.requests(left, SHAPE)
    assert not len(spans)
    assert len(set(requests["doc"].tolist())) == (len(texts) if asked else 0)


def test_segments_are_compared_a_few_keys_at_a_time(monkeypatch):
    """F1"""
    monkeypatch.setattr(repeats, "COMPARED", 1000)
    rnd = np.random.default_rng(5)
    rows, expected = [], []
    for key in range(200):
        text = bytes(rnd.integers(0, 256, 52, np.uint8))
        for doc in (2 * key, 2 * key + 1):
            r = np.zeros(1, repeats.REQUEST)
            r["key"], r["doc"], r["start"], r["n"] = key, doc, 7, 3
            rows.append((3, 0, None, r.tobytes() + text))
        expected.append((2 * key + 1, 7, 59))
    sizes = []

    def equal_windows(parts):
        sizes.append(sum(map(len, parts)))
        return suffix_dedup.equal_windows(parts)

    batches = list(repeats.rows_out((r[0], r[1], r[3]) for r in rows))
    out = [b for b in repeats._comparer(SHAPE, suffix_dedup._unpack, equal_windows, 1)(iter(batches))]
    spans = repeats.undealt([x for b in out for x in b.column("data").to_pylist()], repeats.SPAN)
    assert sorted(map(tuple, spans.tolist())) == expected
    assert len(sizes) > 10 and max(sizes) < 1200


def test_blobs_compress():
    """F1"""
    rows = np.zeros(10_000, repeats.SPAN)
    rows["doc"], rows["start"] = np.arange(10_000) * 7, np.random.default_rng(1).integers(0, 4000, 10_000)
    rows["end"] = rows["start"] + 50
    ((kind, bucket, blob),) = repeats.dealt(1, rows, np.zeros(10_000, np.int64), repeats.SPAN)
    assert (kind, bucket) == (1, 0) and (repeats.undealt([blob, blob], repeats.SPAN) == np.concatenate([rows, rows])).all()
    assert len(pa.Codec("lz4").compress(blob)) < 80_000
