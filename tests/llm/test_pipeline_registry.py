import os
import random
import zlib

import corpus_pipeline
import pytest
from llm_cases import sentence
from test_dedup import brute_fingerprint, brute_groups, brute_lines
from test_text_models import brute_hits

import __spark_entry__
from tremorlake.llm import queries

SF = "/root/testdata/sf0.001"
STAGE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered_once():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage kept, as dictionaries by doc_id (the last: its rows)."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage-test")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages):
    for df in stages[:-1]:
        assert df.columns == STAGE_COLUMNS and df.dtypes == stages[0].dtypes
    for df in stages[:-1]:
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_language_stage_drops_texts_without_letters_only(stages):
    want = {d: t for d, t in by_id(stages[0]).items() if t is not None and any(c.isalpha() for c in t)}
    assert by_id(stages[1]) == want


def test_line_stage(stages):
    want = {d: t for d, (_, _, t) in brute_lines(by_id(stages[1])).items()}
    assert by_id(stages[2]) == want


def test_near_copy_stage_keeps_one_of_each_group(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    fps = {d: brute_fingerprint(t) for d, t in before.items()}
    groups = brute_groups(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for d in sorted(before):
        least.setdefault(min(groups[fps[d]]), d)
    assert after == {d: before[d] for d in least.values()}


def test_benchmark_stage_cuts_hits_and_nothing_else(spark, stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits(before, items, 10)
    assert set(after) == {d for d, (n, hit, _) in hits.items() if len(hit) <= 0.5 * n}
    for d, t in after.items():
        n, hit, _ = hits[d]
        assert (t == before[d]) if not hit else len(t) < len(before[d])
    assert any(hit for _, hit, _ in hits.values())


def test_run_packs_what_the_stages_kept(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids)))
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, {})[r.start] = bytes(r.ids)
    want = {}
    for r in stages[5].collect():
        want.setdefault(r.doc_id, {})[r.start] = bytes(r.ids)
    join = lambda x: {d: b"".join(v[k] for k in sorted(v)) for d, v in x.items()}
    assert join(whole) == join(want) and set(whole) == set(by_id(stages[4])) and len({key(r) for r in rows}) == len(rows)


def test_pipeline_file_is_part_of_the_removable_half():
    assert os.path.dirname(corpus_pipeline.__file__) == os.path.dirname(__spark_entry__.__file__)


def test_language_stage_decides_by_n_grams(spark):
    rng = random.Random(4)
    plain = {i: sentence(rng, rng.randrange(1, 40)) for i in range(400)} | {400: "x", 401: "1 of"}
    odd = {500: "日本語のテキストだけ" * 30, 501: "щщъъыы " * 200, 502: "qqxzj wvvqk zzxq " * 20}
    blank = {600: None, 601: "12 !!", 602: ""}
    for lang in ("en", None):
        docs = spark.createDataFrame([(i, t, lang if i < 400 else None) for i, t in (plain | odd | blank).items()],
                                     "doc_id long, text string, lang string").repartition(3)
        kept = by_id(corpus_pipeline.identify_language(spark, docs, SF))
        assert kept == (plain if lang else plain | odd)


def test_language_stage_sends_texts_once(spark):
    docs = spark.createDataFrame([(1, "one text", "en", True, "a"), (2, "12", "en", False, "b")],
                                 "doc_id long, text string, lang string, known boolean, lang_pred string")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "one text", "en", True, "a")]
    assert "__llm_text" not in kept._jdf.queryExecution().toString()
