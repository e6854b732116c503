import corpus_pipeline

from tidemark.session import materialise


def test_stages_follow_each_other(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, sizes = docs, []
    for name, work in corpus_pipeline.STAGES:
        at = materialise(work(spark, at, str(tmp_path)), name)
        sizes.append(at.count())
        if name != "packing":
            assert at.columns == docs.columns
    quality, lines, near, secrets, pieces = sizes
    assert docs.count() > quality == lines > near == secrets > 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect()), key=str)
    assert len(rows(out)) == pieces
