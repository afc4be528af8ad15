import corpus_pipeline
from grove.llm import packing, pii, quality, simhash

from .test_simhash import brute_components, brute_fingerprint
from .test_tokens import check_packing


def test_stages_are_their_operators_on_what_came_before(spark, odd_docs, as_tables):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mail = "A text with enough words to be kept by the rules, which gives an address: me@example.org for all who ask."
    docs = sf.unionByName(odd_docs.drop("kept")).unionByName(spark.createDataFrame([(9000 + k, mail, "en", "s", len(mail)) for k in range(3)], sf.schema))
    folder = as_tables(documents=docs)
    got = corpus_pipeline.run(spark, folder).collect()

    judged = [(r, quality.judge(r.text, True)) for r in docs.collect()]
    kept = [(r.doc_id, j[9]) for r, j in judged if j[6]]
    named = brute_components([(d, brute_fingerprint(t)) for d, t in kept])
    one = {}
    for (d, t), (_, _, c) in zip(kept, named, strict=True):
        if d == c:
            one[d] = min(one.get(d, t), t)
    deduped = spark.createDataFrame(list(one.items()), "doc_id long, text string")
    masked = pii.sanitise(deduped).collect()
    assert sum("[EMAIL]" in r.text for r in masked if r.doc_id >= 9000) == 1 and 9000 in one and 9001 not in one
    check_packing(masked, got)
    want = packing.pack(spark.createDataFrame(masked, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_columns_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, None).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "packing"]
    assert simhash.WIDTH == 3 and simhash.RADIUS == 3
