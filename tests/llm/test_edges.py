"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest

import corpus_pipeline
from parcelflow.llm import decontaminate, exact_progressive, jump_shard, langid_ecoc, packing, pii_crf, secret_ownership, simhash_bk, substring_lsm, url_trust

LONG = "alpha beta gamma delta epsilon zeta " * 20_000
ROWS = [
    (1, "One two three four five six.", "en", "a"),
    (1, "One two three four five six.", "en", "a"),
    (2, None, None, None),
    (None, "One  two three\tfour five six.", None, "b"),
    (None, None, "en", None),
    (3, "", "", ""),
    (4, " \n\t ", "en", "a"),
    (5, LONG, "en", "a"),
    (6, "x" * 300_000, "de", "a"),
    (7, "12345 !!! 67", "de", "b"),
    (8, "One two three four five six.", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n long, fp string, rows int, size string, id string"


@pytest.fixture(scope="module", params=["full", "empty"])
def docs(spark, request):
    extra = (None, 0.5, "k", 1, None, 2, "s", "i")
    return spark.createDataFrame([r + extra for r in ROWS] if request.param == "full" else [], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six", 1), (2, None, 2), (3, "", 3), (None, "alpha beta gamma delta epsilon", 4)], "item_id long, text string, n int")


def remove_repeats(docs):
    index = substring_lsm.WindowIndex(docs.sparkSession)
    index.append(docs)
    return index.remove_repeats(docs)


@pytest.mark.parametrize("operator", [langid_ecoc.identify, remove_repeats, pii_crf.personal_data, jump_shard.jump_shards, simhash_bk.near_duplicates, exact_progressive.decisions, secret_ownership.secrets])
def test_one_row_for_each_row(docs, operator):
    out = operator(docs).collect()
    assert len(out) == docs.count()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())


def test_defined_results(spark):
    docs = spark.createDataFrame([r + (None,) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_progressive.decisions(docs).collect()]
    assert sorted(x for x in kept if x[0] == 1) == [(1, 1, 4, False), (1, 1, 4, True)]
    assert (8, 1, 4, False) in kept and (None, 1, 4, False) in kept and (4, 4, 1, True) in kept
    assert sorted(x[1:] for x in kept if x[0] in (2, 3)) == [(2, 3, False), (2, 3, True)]
    prints = {r["doc_id"]: r for r in simhash_bk.near_duplicates(docs).collect() if r["doc_id"] in (2, 3, 4)}
    assert {(r["fingerprint"], r["component_id"]) for r in prints.values()} == {("0" * 16, 2)}
    lang = {r["doc_id"]: r for r in langid_ecoc.identify(docs).collect() if r["doc_id"]}
    assert [lang[i]["lang_pred"] for i in (2, 3, 4, 7)] == ["und"] * 4 and lang[7]["score"] == 0
    left = {r["doc_id"]: r for r in remove_repeats(docs).collect() if r["doc_id"]}
    assert left[5]["n_removed"] == left[5]["n_words"] == 120_000 and left[1]["n_removed"] == 0 and left[2]["n_words"] == 0
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in jump_shard.jump_shards(docs).collect() if r["doc_id"]}
    assert sizes[2] == sizes[3] == (1, 0)


def test_packing_and_decontamination(docs, items):
    cut = packing.packed(docs).collect()
    assert sum(r["length"] for r in cut if r["start"] == 0) >= len({r["doc_id"] for r in cut})
    assert sum(r["start"] == 0 for r in cut) == docs.count()
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == ({(1, 1), (None, 1), (8, 1), (5, None)} if docs.count() else set())
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_stages_keep_columns(spark, docs, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        if name != "packing":
            assert left.columns == docs.columns
        left.collect()


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([r + (None,) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"] or 0) for r in exact_progressive.drop_exact_duplicates(docs).collect())
    assert kept == [1, 2, 4, 5, 6, 7]


def test_exact_stage_by_id_and_text(spark):
    """Repeated ids with different texts, texts that differ in white space, names that the operator might use itself."""
    rows = [(1, "abc", 77, {"a": 1}), (1, "abc", 78, None), (2, " x  y", 1, None), (3, "x y", 2, None), (3, " x y", 2, None), (None, "abc", 3, None), (None, None, 3, None), (2, "", 4, None), (2, "z", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__size` int, `full` map<string,int>")
    kept = [(r["doc_id"], r["text"], r["__size"]) for r in exact_progressive.drop_exact_duplicates(docs).collect()]
    assert len(kept) == 5 and {k for k in kept if k[0] != 1} == {(2, " x  y", 1), (3, "x y", 2), (2, "", 4), (2, "z", 5)}
    assert [k[:2] for k in kept if k[0] == 1] == [(1, "abc")]


def test_near_stage_by_id_and_text(spark):
    words = [f"w{i}" for i in range(200)]
    copy, other = [*words[:199], "end"], " ".join(f"v{i}" for i in range(50))
    rows = [(1, " ".join(words), 5, "a"), (2, " ".join(copy), 6, "b"), (2, other, 7, "c"), (None, " ".join(copy), 8, "d"), (3, None, 9, "e"), (4, "", 9, "f"), (5, "short", 9, "g"), (5, "short", 9, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, gone_key string")
    kept = sorted((r["gone_key"] for r in simhash_bk.drop_near_duplicates(docs).collect()))
    assert kept == ["a", "c", "d", "e", "g", "g"]  # 3 and 4 are equal; a null id stays, and so do rows that repeat the id that stays


@pytest.mark.parametrize("full", [True, False])
def test_pages(spark, full):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "http://a.org/", "", 2), (2, "", "<a href=//b.net>", 3), (3, "://", "x" * 300_000, 4)]
    pages = spark.createDataFrame(rows if full else [], "page_id long, url string, html string, host int")
    assert url_trust.judge_urls(pages).count() == len(rows) * full
