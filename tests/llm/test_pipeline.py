import base64
from pathlib import Path

import public_tokenizers
import tiktoken

import corpus_pipeline as CP
from pagemend.llm import decontaminate, langid, neardup, pii

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def tables(prose, put):
    en = [("the of and to in that it with " + prose(i, 60)) for i in range(30)]
    bench = prose(700, 20)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(en)]
    docs += [(100, en[0], "en", "s", 1), (101, en[1].replace("with", "for"), "en", "s", 1), (102, prose(50, 30) + " " + bench, "en", "s", 1), (103, "mail me at a.b@c.de now " + prose(51, 30), "en", "s", 1), (104, None, "en", "s", 0), (105, "123 456", "en", "s", 0), (106, "世" * 100, None, "s", 0)]
    return put(documents=(docs, DDL), benchmark=([(1, bench), (2, None)], "item_id long, text string")), docs


def test_run_equals_the_operators_one_by_one(spark, put, prose):
    d, docs = tables(prose, put)
    held = lambda: {str(p) for p in Path(CP.shared_checkpoints(spark).removeprefix("file:")).iterdir()}
    before = held()
    out = {r.doc_id: r for r in CP.run(spark, d).collect()}
    left = [Path(p) for p in held() - before]
    assert [p.name.split("-")[0] for p in left] == ["pipeline"] and [p.name for p in left[0].iterdir()] == ["redact"]  # only what the last stage reads
    assert set(out) == {*range(30), 103}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = pii.chooser()
    texts = {x[0]: x[1] for x in docs}
    for key, row in out.items():
        want = pii.redact_text(texts[key], model)
        assert row.ids == enc.encode_ordinary(want) and row.n_tokens == len(row.ids)
    assert "[EMAIL]" in enc.decode(out[103].ids)


def test_each_stage_keeps_the_columns(spark, put, prose):
    d, _ = tables(prose, put)
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("class_id", langid.F.lit("clash"))
    for name, stage in CP.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
        assert stage(spark, docs.limit(0), d).count() == 0, name
    assert CP.STAGES[-1][1](spark, docs.limit(0), d).count() == 0
    assert [n for n, _ in CP.STAGES] == ["language", "near_dedup", "decontaminate", "redact", "tokenize"]


def test_stages_decide_as_the_operators(spark, put, prose):
    d, _ = tables(prose, put)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    model = langid.learn(docs, usable=~langid.held_out())
    assert ids(CP.language(spark, docs, d)) == ids(langid.identify(docs, model).where("not rejected"))
    assert ids(CP.near_dedup(spark, docs, d)) == ids(neardup.near_duplicates(docs).where("doc_id = class_id"))
    found = decontaminate.contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet"))
    assert ids(CP.decontaminated(spark, docs, d)) == ids(found.where("n_hit = 0"))
