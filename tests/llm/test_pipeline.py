import corpus_pipeline as P
from nearfold.llm import line_dedup, mixing, near_copies, quality, sentencepiece_nbest
from nearfold.llm.common import written
from tests.llm.test_near_copies import brute_kept


def test_stages_chain(spark, docs, no_docs):
    for start in (docs, no_docs):
        now = start
        for name, stage in P.STAGES[:-1]:
            now = written(stage(spark, now, ""), "test-stage")
            assert now.columns == start.columns, name
        last = P.STAGES[-1][1](spark, now, "")
        assert last.count() == now.count()


def test_stages_are_the_operators(spark, docs):
    kept = written(P.quality_rules(spark, docs, ""), "t")
    assert kept.count() == quality.quality(docs).where("kept").count() > 0
    lines = written(P.line_dedup(spark, kept, ""), "t")
    assert sorted(map(str, lines.collect())) == sorted(map(str, line_dedup.without_blocks(kept).collect()))
    one = written(P.near_dedup(spark, lines, ""), "t")
    assert one.count() == near_copies.keep_one(lines).count() == len(brute_kept(list(enumerate(r["text"] for r in lines.dropDuplicates(["doc_id", "text"]).collect()))))
    mix = written(P.mixing(spark, one, ""), "t")
    assert sum(len(r["text"].split()) for r in mix.collect()) == mixing.mix(one).groupBy().sum("taken").first()[0]
    assert P.sentencepiece(spark, mix, "").columns == sentencepiece_nbest.encode_nbest(mix, sentencepiece_path()).columns


def sentencepiece_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_run_leaves_only_what_its_reader_needs(spark, monkeypatch, tmp_path):
    from nearfold import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = P.run(spark, "/root/testdata/sf0.001")
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "nearfold").iterdir()] == ["mixing"]
    assert rows.where("round_trip").count() == rows.count() > 50
