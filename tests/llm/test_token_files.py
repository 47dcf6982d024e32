from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symloom.llm.token_files import LONG, EliasFano, Segment, token_offsets, write_segment, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(12))
def test_elias_fano(seed):
    rnd = random.Random(seed)
    values = np.array(sorted(rnd.randint(0, 10 ** rnd.randint(0, 7)) for _ in range(rnd.randint(1, 400))))
    coded = EliasFano.of(values, int(values[-1]))
    again, _ = EliasFano.read(coded.to_bytes(), 0, len(values))
    assert again.values().tolist() == values.tolist() == [again.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        again.select(len(values))


def test_selects_over_long_gaps():
    """Gaps far longer than a select may look through, at every place of a block of samples."""
    for n in (1, 63, 64, 65, 200, 1000):
        values = np.cumsum(np.where(np.arange(n) % 67 == 5, 900_000, np.arange(n) % 3))
        again, end = EliasFano.read(b"xy" + EliasFano.of(values, int(values[-1])).to_bytes(), 2, n)
        assert [again.select(i) for i in range(n)] == values.tolist() == again.values().tolist()
    ends = np.concatenate([np.ones(500, np.int64).cumsum(), [10_000_000], 10_000_000 + np.arange(500)])
    coded = EliasFano.of(ends, int(ends[-1]))
    spans = np.diff(coded.samples.astype(np.int64), append=8 * len(coded.high))
    assert len(coded.blocks) >= 1 or spans.max() <= LONG
    assert [coded.select(i) for i in range(len(ends))] == ends.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10000, 700))
    assert len(EliasFano.of(values, int(values[-1])).to_bytes()) * 8 < 10000 * 13


def test_segment():
    own = Segment(write_segment([3, None, -1], [b"\1\0\2\0", b"", b"\3\0"], 2, 7))
    assert own.doc_ids == [3, None, -1] and own.before == 7
    assert [own.document(i).tolist() for i in range(3)] == [[1, 2], [], [3]]
    with pytest.raises(ValueError):
        Segment(b"x" * 64)


@pytest.mark.parametrize("segment_ids", [50, 1 << 20])
def test_offsets(docs, rows, empty, segment_ids):
    library = Tokenizer.from_file(PATH)
    got = token_offsets(docs, PATH, 2, segment_ids).collect()
    want = {}
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got.sort(key=lambda r: r["start"])
    at, found = 0, {}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert token_offsets(empty, PATH, 2).collect() == []


def test_files_hold_the_ids(docs, rows):
    library = Tokenizer.from_file(PATH)
    texts = {r[0]: r[1] for r in rows}
    for row in write_token_files(docs, PATH, 2, 300).collect():
        own = Segment(bytes(row["data"]))
        for i, d in enumerate(own.doc_ids):
            if d is not None and d != 5:
                assert own.document(i).tolist() == [*library.encode(texts[d] or "", add_special_tokens=False).ids, 2]
