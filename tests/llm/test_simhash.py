"""SimHash against a brute-force version, and its odd inputs."""

import random
import re

import numpy as np
import xxhash

from plumbline.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest doc_id reachable, by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    firsts = {}
    for (doc_id, _), group in zip(rows, label):
        firsts.setdefault(group, []).append(doc_id)
    return [(d, format(f, "016x"), min((x for x in firsts[g] if x is not None), default=None)) for (d, _), f, g in zip(rows, fps, label)]


def family(seed, copies, words=400):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        near = list(base)
        near[rng.randrange(words)] = "changed"
        out.append(" ".join(near))
    return out


def test_near_copies_equal_all_pairs(make_docs, odd_texts):
    texts = [*odd_texts, *family(1, 12), *family(2, 3), *family(3, 30)]
    rows = [(n * 7 % 101, t) for n, t in enumerate(texts)] + [(None, "an odd one out without any id"), (3, texts[-1])]
    got = simhash.near_copies(make_docs(rows)).select("doc_id", "fingerprint", "component_id").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain_components(rows), key=key)


def test_long_runs_and_bits_apart():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, dtype=np.int64).astype(np.uint64)
    fps = {base}
    while len(fps) < 300:
        fps.add(base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))))
    fps = np.array(sorted(fps), np.uint64)
    left, right = simhash.close_pairs(fps, np.array([0, len(fps)]))
    got = {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist())}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want


def test_every_close_pair_meets_under_a_key():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(0, 2**63)) << 1 | int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        keys = []
        for fp in (a, b):
            column = pa.array(np.array([fp], np.uint64).view(np.int64))
            keys.append(set(simhash.filed(pa.RecordBatch.from_arrays([column], names=["fp"])).column(0).to_pylist()))
        assert keys[0] & keys[1]


def test_empty_table(make_docs):
    assert simhash.near_copies(make_docs([])).collect() == []
