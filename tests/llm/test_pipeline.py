"""The pipeline's stages over the small table, each held against a plain version of its decision."""

from test_edges import BYTE, library, packs, plain_components, plain_counts


def test_pipeline(spark, data):
    import __spark_entry__ as e
    import corpus_pipeline as p

    assert e.queries()["pipeline"] is p.run and len(p.STAGES) == 4
    docs = spark.read.parquet(f"{data}/documents.parquet")
    start, made = docs, []
    for name, stage in p.STAGES:
        docs = p.settle(stage(spark, docs, data), name)
        made.append(docs)
    quality, language, near, packed = made
    assert all(x.columns == start.columns for x in made[:3])
    text = {r.doc_id: r.text for r in start.collect()}
    keep = set()
    for d, t in text.items():
        n, _, _, _, again = plain_counts(t)
        if n >= 50 and 100 * again <= 50 * n:
            keep.add(d)
    kept = {r.doc_id for r in quality.collect()}
    assert kept <= keep and len(kept) >= 0.95 * len(keep)
    assert {r.doc_id for r in language.collect()} == kept
    first = {c for (_, _, c) in plain_components([(r.doc_id, r.text) for r in language.collect()])}
    rows = near.collect()
    assert {r.doc_id for r in rows} == first and len(rows) == len(first)
    ids = library(BYTE)
    packs(packed.collect(), [(r.doc_id, ids(r.text) + [0]) for r in rows], 2048)
