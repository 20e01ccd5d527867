"""The near-duplicates stage gets candidates from op 6's BK-trees, and compares them whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from ledgersift.llm import nearcopies, simhash


def _no_bands(batches):
    """In place of the MinHash bands: no two rows share one."""
    for batch in batches:
        keys = pa.array([[int(k)] for k in np.random.default_rng().integers(0, 1 << 62, len(batch))], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), keys], names=["doc_id", "text_hash", "bands"])


def _text(seed, n):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 5000, n))


def test_candidates_of_the_trees(spark, tmp_path, monkeypatch):
    long, filled = _text(1, 3000), "x " * 2000
    rows = [(1, long), (2, long + " end"), (3, _text(2, 3000)), (4, filled + _text(3, 300)), (5, filled + _text(4, 300)), (6, "")]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() <= 2  # similar, and near
    assert (simhash.fingerprint(rows[3][1]) ^ simhash.fingerprint(rows[4][1])).bit_count() <= 2  # near, but of few common shingles
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3, 4, 5, 6]
    monkeypatch.setattr(nearcopies, "_prints", _no_bands)
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3, 4, 5, 6]
