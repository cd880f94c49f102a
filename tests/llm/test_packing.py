import itertools
import random

import numpy as np

from usagelens.llm.packing import boundaries, pack


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_against_all_choices():
    rnd = random.Random(3)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(40), rnd.randrange(1, 9)))
        counts = [rnd.randrange(1, 20) for _ in lengths]
        for k in (1, 2, 3, 5):
            got = boundaries(np.array(lengths, float), np.array(counts, float), k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
            assert len(got) <= k and padding(lengths, counts, got) == best
    assert boundaries(np.zeros(0), np.zeros(0), 4) == []


def test_pack_keeps_every_token(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 1, 5, 63, 64, 65, 200, 1000]) if i % 3 else rnd.randrange(300)) for i in range(3000)] + [(7, 12), (7, 12), (None, 9), (None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), max_tokens=64, buckets=5, budget=256).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    assert len(got) == sum(max(1, -(-(n or 0) // 64)) for _, n in rows)
    assert all(r.start == r.piece * 64 and 0 <= r.padding and r.n_tokens + r.padding == r.bucket_tokens <= 64 for r in got)
    assert len({(r.batch_id, r.slot) for r in got}) == len(got)
    sizes = {}
    for r in got:
        sizes.setdefault(r.bucket_tokens, {}).setdefault(r.batch_id, []).append(r.slot)
    for bucket, batches in sizes.items():
        room = max(1, 256 // max(1, bucket))
        assert all(sorted(s) == list(range(len(s))) and len(s) <= room for s in batches.values())
        assert sum(len(s) < room for s in batches.values()) <= 1
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
