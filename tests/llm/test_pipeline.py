from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from test_duplicates import plain_fingerprint, plain_removals, plain_roots
from test_search import plain_hits
from test_tokens import wanted

DATA = Path("/root/testdata/sf0.001")


def test_stages_on_odd_rows(spark, edge_docs, tmp_path):
    items = spark.createDataFrame([(1, "no such passage anywhere")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == edge_docs.columns and docs.schema == edge_docs.schema, name
    texts = [r.text for r in docs.collect()]
    # Two texts repeat themselves all through, so nothing is left of them.
    full = [text for text in texts if text]
    assert None not in texts and texts.count("") == 2 and len(full) == len(set(full)) > 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    # Every text of these tables has letters and a sure language.
    prints = [plain_fingerprint(d.text, 3) for d in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    first = {}
    for d, root in sorted(zip(docs, plain_roots(len(docs), near)), key=lambda x: x[0].doc_id):
        first.setdefault(root, d)
    rows = list(first.values())
    texts = [x[4].decode("utf-8", "ignore") for x in plain_removals([d.text for d in rows], 200)]
    hits = plain_hits([(d.doc_id, t) for d, t in zip(rows, texts)], items, 10)
    clean = {doc for doc, _, n, _ in hits if n == 0}
    kept = [(d.doc_id, t) for d, t in zip(rows, texts) if d.doc_id in clean]
    ids = wanted([t for _, t in kept], "byte_bpe_50k.json", 0)
    want = Counter()
    for (doc, _), own in zip(kept, ids):
        many = -(-len(own) // 2048)
        for piece in range(many):
            want[doc, piece, len(own) - (many - 1) * 2048 if piece == 0 else 2048] += 1
    found = corpus_pipeline.run(spark, str(DATA)).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in found) == want
