"""Stages of the pipeline, each against a plain version on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planeweave.llm import packing, pii, simhash_dedup, source_mix
from planeweave.llm.common import ascii_words

from .test_text import linked, plain_spans

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, copies string, held string, component_id int"


def rows():
    g = np.random.default_rng(9)
    make = {"en": "the of and thing".split(), "de": "sch ung ein der".split()}
    text = lambda k, n: " ".join("".join(g.choice(make[k], 2)) for _ in range(n))
    out = [(i, text(k, int(g.integers(30, 90))), k, f"s{i % 4}") for i, k in enumerate(g.choice(list(make), 120))]
    out += [(500, out[3][1], "en", "s0"), (501, out[3][1], "en", "s1"), (502, "123 456 !!", "en", "s2"), (503, None, "de", "s3"), (504, "", "de", None)]
    out += [(505, text("en", 40) + " write to a.b@mail.example or 10.1.2.3", "en", "s2"), (506, text("de", 9000), None, None), (7, out[7][1], "en", "s3")]
    out += [(None, text("en", 50), "en", "s1"), (None, text("de", 50), "de", "s1"), (None, out[5][1], "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1]), "x", "y", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3)


def test_stages_keep_the_columns(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mix", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_languages_that_cannot_be_told_go(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()}
    assert not {502, 503, 504} & kept
    assert {r[0] for r in rows()} - {502, 503, 504} == kept


def test_texts_stay_where_no_language_is_known(spark, docs):
    kept = corpus_pipeline.keep_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((r[0], r[1]) for r in rows() if r[1] and any(map(str.isalpha, r[1])))


def test_one_document_of_each_group_stays(spark, docs):
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    told = rows()
    component = linked({n: simhash_dedup.fingerprint(r[1]) for n, r in enumerate(told)}, 4)
    groups = {}
    for n, c in component.items():
        groups.setdefault(c, []).append(n)
    first = [min(g, key=lambda n: (told[n][0] is None, told[n][0] or 0)) for g in groups.values()]
    assert Counter(r.doc_id for r in found) == Counter(told[n][0] for n in first)
    texts = {(r[0], r[1]) for r in told}
    assert all((r.doc_id, r.text) in texts for r in found) and len(found) == len(groups)
    assert sum(r.doc_id is None for r in found) == 2


def test_different_texts_of_one_id_stay(spark):
    g = np.random.default_rng(4)
    text = lambda: " ".join(f"w{g.integers(10**6)}" for _ in range(50))
    told = [(1, text(), "s"), (1, text(), "s"), (None, text(), "s"), (None, text(), "s")]
    told += [(*told[0][:2], "t"), told[2]]
    given = spark.createDataFrame(told, "doc_id long, text string, source string")
    for _ in range(2):
        found = corpus_pipeline.drop_near_duplicates(spark, given.repartition(3), "").collect()
        assert Counter((r.doc_id, r.text) for r in found) == Counter({(i, t): 1 for i, t, _ in told})
        assert len({r.source for r in found if r.text == told[0][1]}) == 1


def test_personal_data_is_replaced(spark, docs):
    found = corpus_pipeline.replace_personal_data(spark, docs, "").collect()
    want = Counter()
    for r in rows():
        text, at = r[1], 0
        if text:
            parts = []
            for a, k, b in plain_spans(text):
                parts += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
                at = b
            text = "".join([*parts, text[at:]])
        want[r[0], text, None if text is None else len(text)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in found) == want
    assert any("[EMAIL]" in (r.text or "") and "[IP]" in r.text for r in found)


def test_the_mix_takes_whole_documents(spark, docs):
    size = lambda t: len((t or "").encode().split())
    small = spark.createDataFrame([(i, " ".join(["word"] * (100 + i)), f"t{i}") for i in range(6)], "doc_id long, text string, source string")
    for given in (docs, small):
        texts = {(r.doc_id, r.text) for r in given.collect()}
        mixed, longest = Counter(), Counter()
        for r in given.collect():
            longest[r.source] = max(longest[r.source], size(r.text))
        for r in corpus_pipeline.mix_sources(spark, given, "").collect():
            assert (r.doc_id, r.text) in texts
            mixed[r.source] += size(r.text)
        goals = source_mix.targets(given.select("source", F.size(ascii_words(F.col("text"))).cast("long").alias("size")), (1.0, 2.0, 3.0), 3.0).collect()
        assert all(abs(mixed[r.source] - r.target) <= longest[r.source] / 2 + 1 for r in goals)


def test_words_are_booked_to_their_own_source(spark):
    told = [(1, "same words here " * 9, "a"), (1, "same words here " * 9, "b"), *((10 + i, f"w{i} " * 20, "ab"[i % 2]) for i in range(30))]
    given = spark.createDataFrame(told, "doc_id long, text string, source string")
    found = corpus_pipeline.mix_sources(spark, given, "").collect()
    assert {(r.doc_id, r.text, r.source) for r in found} <= set(told)
    mixed = Counter()
    for r in found:
        mixed[r.source] += len(r.text.split())
    goals = {r.source: r.target for r in source_mix.targets(given.select("source", F.size(ascii_words(F.col("text"))).cast("long").alias("size")), (1.0, 2.0, 3.0), 3.0).collect()}
    assert all(abs(mixed[k] - t) <= 14 for k, t in goals.items())


def test_the_whole_runs_to_packed_sequences(spark, tmp_path):
    spark.createDataFrame(rows(), SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    lengths = [r.n for r in found.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(lengths) <= packing.LENGTH and sum(lengths) / (packing.LENGTH * len(lengths)) > 0.8


def test_sequences_and_documents_can_be_built_again(spark, docs):
    from tokenizers import Tokenizer

    from planeweave.llm.queries import tokenizer_files

    exact = Tokenizer.from_file(tokenizer_files()[0])
    given = docs.union(docs.where("doc_id in (3, 5, 506)"))
    want = Counter((r.doc_id, tuple([*exact.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID])) for r in given.collect())
    whole, ends = {}, {}
    for r in sorted(corpus_pipeline.pack_sequences(spark, given, "").collect(), key=lambda r: (r.document, r.start)):
        held = whole.setdefault((r.document, r.doc_id), [])
        assert len(held) == r.start
        held += np.frombuffer(bytes(r.ids), "<u4").tolist()
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter((i, tuple(ids)) for (_, i), ids in whole.items()) == want
    for parts in ends.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
