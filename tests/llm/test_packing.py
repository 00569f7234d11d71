"""Packing against one-by-one best fit, the JSON tokenizer and a rebuilt layout."""

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.queries import vocabulary_paths


def plain_best_fit(lengths, capacity):
    rests = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rests) if r >= length]
        if fits:
            rests[min(fits)[1]] -= length
        else:
            rests.append(capacity - length)
    return sorted(rests)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100, 2048])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 6)) for _ in range(rng.randint(1, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.packing_plan(histogram, capacity)
    used = {}
    for length, count in histogram.items():
        slots = plan[length]
        for rank in range(count):
            first, each, start, offset = slots[np.searchsorted(slots[:, 0], rank, side="right") - 1]
            used.setdefault(int(start + (rank - first) // each), []).append((int(offset + (rank - first) % each * length), length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in parts) for parts in used.values()) == plain_best_fit(lengths, capacity)


def test_many_documents_make_few_slots():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 2049, 1_000_000), return_counts=True)
    plan = packing.packing_plan(dict(zip(lengths.tolist(), counts.tolist())))
    assert sum(len(s) for s in plan.values()) < 4 * 2048 * 8


def test_documents_are_rebuilt(make_docs, odd_texts):
    from tokenizers import Tokenizer

    paths = vocabulary_paths()
    tokenizer = Tokenizer.from_file(paths["json_path"])
    texts = [*odd_texts, "say <|endoftext|> twice <|endoftext|>", "tick's I'LL 12345  \t\r\n  end", *(f"text number {i} " * (i % 40 + 1) for i in range(200))]
    rows = packing.packed_documents(make_docs(texts), **paths).collect()
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]
    pieces = {}
    for row in rows:
        part = ids[row["doc_id"]][row["start"] : row["start"] + row["length"]]
        assert len(part) == row["length"] and zlib.crc32(part.tobytes()) == row["ids_crc32"]
        pieces.setdefault(row["doc_id"], []).append((row["piece"], row["start"], row["length"]))
    for doc_id, own in pieces.items():
        own.sort()
        assert [p[0] for p in own] == list(range(len(own)))
        assert sum(p[2] for p in own) == len(ids[doc_id])
        assert all(p[2] == packing.CAPACITY for p in own[1:])
        assert len(own) == 1 or len(ids[doc_id]) > packing.CAPACITY
    assert set(pieces) == set(range(len(texts)))
    layout = {}
    for row in rows:
        layout.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in layout.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(layout) == len(plain_best_fit([r["length"] for r in rows], packing.CAPACITY))


def test_very_long_runs_take_the_other_scanner():
    paths = vocabulary_paths()
    text = "a" * 30_000 + " " * 30_000 + "b"
    assert packing.has_long_run(text) and not packing.has_long_run("word " * 10_000)
    assert len(packing.token_ids(text, **paths)) > 1


def test_repeated_rows_and_empty_table(make_docs):
    paths = vocabulary_paths()
    rows = packing.packed_documents(make_docs([(1, "same"), (1, "same"), (None, None)]), **paths).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.packed_documents(make_docs([]), **paths).collect() == []


def test_ids_on_request(make_docs):
    paths = vocabulary_paths()
    rows = packing.token_pieces(make_docs(["hello there"]), **paths, keep_ids=True).collect()
    assert rows[0]["ids"][-1] == packing.END_ID and len(rows[0]["ids"]) == rows[0]["length"]
