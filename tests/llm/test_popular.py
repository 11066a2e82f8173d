"""Large groups of the jaccard stage whose sets share a popular passage and little else."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from quillspark.llm import jaccard
from tests.llm.test_operators import brute_components


@pytest.mark.parametrize("popular", [1 << 20, 40, 0])
def test_owners_of_a_passage_are_parted(spark, monkeypatch, popular):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50_000, n))
    passage = say(66)
    texts = [f"{say(20)} {passage} {say(20)}" for _ in range(90)]
    texts += [t + " tail" for t in texts[:12]] + [t.replace(t.split()[5], "other", 1) for t in texts[6:20]]
    docs = spark.createDataFrame([Row(doc_id=k, text=t) for k, t in enumerate(texts)])
    kept, keep = {}, jaccard.Workspace.keep

    def noted(self, df, name):
        kept[name] = keep(self, df, name)
        if name in ("members", "rarer-members"):
            kept[name] = kept[name].agg({"sets": "max"}).first()[0], keep(self, df, name)
            return kept[name][1]
        return kept[name]

    monkeypatch.setattr(jaccard.Workspace, "keep", noted)
    monkeypatch.setattr(jaccard, "POPULAR", popular, raising=False)
    got = Counter(map(tuple, jaccard.link_components(docs, block=12).collect()))
    assert got == brute_components(list(enumerate(texts)), 5, 80, 100)
    assert len({c for _, _, c in got}) == 90
    assert kept["members"][0] > 60
    if popular > 100:
        assert kept["rarer-members"][0] <= 6 and "links2" not in kept


def test_rare_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    hits = 0
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 40, n, np.uint64)
        cut, more = (int(rng.integers(0, n // 4 + 1)) for _ in range(2))
        a, b = np.unique(a), np.unique(np.concatenate([a[: n - cut], rng.integers(0, 1 << 40, more, np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            often = np.unique(rng.choice(np.concatenate([a, b]), int(rng.integers(0, n + 1))))
            rank = rng.permutation(len(often))
            (x, _), (y, _) = (jaccard.rare_first(s, often, rank, 80, 100) for s in (a, b))
            assert len(np.intersect1d(x, y))
            hits += 1
    assert hits > 50
