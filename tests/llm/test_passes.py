"""The jaccard stage's prefixes, shuffled in several passes."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from quillspark.llm import jaccard


def test_passes_share_out_the_hashes(spark):
    text = pa.array([" ".join(f"w{(7 * k + d) % 97}" for k in range(60 + d)) for d in range(30)] + ["", None])
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    rows = lambda **k: [h for b in jaccard._tokens(iter([batch]), 5, 80, 100, **k) for h, n in zip(b.column("hash").to_pylist(), b.column("n").to_pylist()) if n is None]
    parts = [rows(nth=k, passes=4) for k in range(4)]
    assert sorted(h for p in parts for h in p) == sorted(rows())
    assert max(map(len, parts)) < 0.5 * len(rows())


def test_passes_give_the_same_components(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(20)]
    texts = base + [t.replace(f" {t.split()[40]} ", " other ", 1) for t in base[::2]] + [""]
    docs = spark.createDataFrame([Row(doc_id=k, text=t) for k, t in enumerate(texts)])
    whole = Counter(map(tuple, jaccard.link_components(docs).collect()))
    assert len({c for _, _, c in whole}) == 21
    names = []
    keep = jaccard.Workspace.keep
    monkeypatch.setattr(jaccard.Workspace, "keep", lambda self, df, name: names.append(name) or keep(self, df, name))
    monkeypatch.setattr(jaccard, "PASS_ROWS", 100)
    assert Counter(map(tuple, jaccard.link_components(docs).collect())) == whole
    assert [n for n in names if n.startswith("shared")] == ["shared0", "shared1", "shared2", "shared3"]
