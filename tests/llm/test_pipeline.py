"""The stages on the smallest tables: their order, their columns, and what each must not lose."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from plait.llm import mixing, near_dups, quality, tokens, toxicity
from plait.llm.registry import QUERIES
from plait.llm.shared import table, written
from tests.llm.test_small import brute_classes, prose

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "stage")
        assert out.columns == names, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= ids
        if name == "near-duplicates":
            assert out.count() == near_dups.classes(docs).select("class_id").distinct().count()
        docs, ids = out, now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


def awkward(spark, folder, rows):
    """A documents table with clashing extra columns, and labels."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, node string, size long, class_id long, copies int, start long"
    spark.createDataFrame([(*r, None, "s" if r[0] and r[0] % 2 else None, 1, 0.5, False, "n", 7, 7, 7, 7) for r in rows], kind).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 60)] + [(None, None, None), (3, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_plain_versions(spark, tmp_path):
    texts = [prose(120, i) + " snotgoblin mudbrained wretchling" * 4 * (i % 5 == 0) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[1]), (201, texts[2].replace("amber", "umber", 1)), (1, texts[1]), (None, prose(90, 300)), (300, None), (301, ""), (302, "word " * 400), (303, prose(9000, 7))]
    sf = awkward(spark, tmp_path, rows)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    good = written(corpus_pipeline.quality_rules(spark, docs, sf), "q")
    verdicts = quality.judge(docs, labels.where("quality = 1"))
    want = {r.doc_id for r in verdicts.where("kept").collect()}
    assert key(good) == sorted([(i, t) for i, t in rows if i in want], key=str) and not {300, 301, 302} & want
    clean = written(corpus_pipeline.toxicity_filter(spark, good, sf), "t")
    model = toxicity.train(good, labels.where(~toxicity.held_out("doc_id")))
    bad = {r.doc_id for r in toxicity.score(good, model, 0.7).where("predicted = 1").collect()}
    assert key(clean) == [x for x in key(good) if x[0] not in bad] and bad and all(i % 5 == 0 for i in bad)
    single = written(corpus_pipeline.near_duplicates(spark, clean, sf), "n")
    least = {}
    for d, _, c in brute_classes([x for x in key(clean)]):
        least[c] = c
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(c for c in least if c is not None) and single.where("doc_id is null").count() == 1
    mix = written(corpus_pipeline.source_mix(spark, single, sf), "m")
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == +Counter(copies) and max(copies.values()) <= 3
    whole, ids = Tokenizer.from_file(tokens.default_path()), Counter()
    for r in corpus_pipeline.sequence_packing(spark, mix, sf).collect():
        ids[r.doc_id] += r.length
    count = Counter(r.doc_id for r in mix.collect())
    assert ids == {r.doc_id: count[r.doc_id] * (len(whole.encode(r.text, add_special_tokens=False).ids) + 1) for r in mix.collect()}
    assert docs.columns == good.columns == clean.columns == single.columns == mix.columns


def test_whole_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, awkward(spark, tmp_path, [])).count() == 0
