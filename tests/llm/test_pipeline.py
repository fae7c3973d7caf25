"""The corpus pipeline's stages against what their operators say, and on odd input."""

import random
import re

import __spark_entry__ as entry
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from counterlift.llm import graph
from counterlift.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"v{i}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 9), (4, long, None, "s", 9), (4, long, "en", "s", 9), (None, "call a@b.co", "en", "s", 11), (6, "call a@b.co", "en", "s", 11)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_handles_odd_and_empty_input(spark, odd, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, odd, SF)
    if name != "packing":
        assert out.columns == pipeline.COLUMNS
    assert out.count() > 0
    assert stage(spark, odd.limit(0), SF).count() == 0


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_equal_brute_force(spark):
    """Rows with null, repeated and mixed ids: one row of each group stays, whatever its id."""
    rng = random.Random(4)
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(12)]
    near = [f"{t} more" for t in base]
    rows = [(i, base[i]) for i in range(6)] + [(5, near[4]), (4, base[7]), (None, base[8]), (None, near[8]), (None, base[9]), (20, base[9])]
    rows += [(30, near[0]), (31, base[10]), (31, base[10]), (32, None), (32, ""), (None, ""), (None, ""), (None, None), (33, " ")]
    rows = [(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = [_sets(r[1]) for r in rows]
    group = list(range(len(rows)))
    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[y] if g == group[x] else g for g in group]
    kept = {r.n_chars for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    for g in set(group):
        members = [k for k in range(len(rows)) if group[k] == g]
        left = [k for k in members if k in kept]
        assert len(left) == 1, members
        ids = [rows[k][0] for k in members]
        own = [i for i in ids if i is not None and sum(r[0] == i for r in rows) == 1]
        if own:
            assert rows[left[0]][0] == min(own)


@pytest.mark.parametrize("ids", ["i", "nullif(i, 3)"])
def test_near_duplicates_leave_texts_in_place(spark, ids):
    """Texts are not dealt anew by id, neither where ids are unique nor where one is null."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = spark.range(40).selectExpr("id AS i", "concat_ws(' ', transform(sequence(1, 30), k -> concat('w', k, '-', id div 2))) AS text")
    docs = docs.selectExpr(f"{ids} AS doc_id", "text", "'en' AS lang", "'s' AS source", "i AS n_chars")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = pipeline.drop_near_duplicates(spark, docs, SF)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("LeftAnti") and "SortMergeJoin" not in plan
        assert sorted(r.n_chars for r in kept.collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_join_small_beyond_its_limit(spark):
    big, small = spark.range(9).withColumnRenamed("id", "k"), spark.range(3).withColumnRenamed("id", "k")
    for limit in (0, 5):
        assert sorted(r.k for r in graph.join_small(big, small, "k", "left_anti", limit).collect()) == list(range(3, 9))
        assert graph.join_small(big, small, "k", limit=limit).count() == 3


def test_decontamination_judges_rows_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, item), (1, "a clean row of the same id"), (None, f"before {item} after"), (None, "clean without id"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.n_chars for r in pipeline.drop_contaminated(spark, docs, SF).collect()} == {1, 3, 4, 5}


def test_masking_changes_only_found_data(spark, odd):
    got = pipeline.mask_personal_data(spark, odd, SF).collect()
    assert len(got) == odd.count() and {r.text for r in got if r.doc_id == 6} == {"call [EMAIL]"}
    assert {r.n_chars for r in got if r.doc_id == 6} == {len("call [EMAIL]")}


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = pipeline.run(spark, SF)
    assert want == sorted((r.doc_id, r.n) for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert 0 < len(want) <= 200 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_stages_against_brute_force(spark):
    """Of the supplied documents: those dropped are near copies of a kept one, or hold a benchmark item; base data is masked."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    text = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: _sets(t) for i, t in text.items()}
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()}

    def linked(a, b):
        return bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])

    assert all(any(linked(i, j) for j in text if j < i) for i in text if i not in kept)
    assert not any(linked(i, j) for i in kept for j in kept if i < j)
    clean = {r.doc_id for r in pipeline.drop_contaminated(spark, docs, SF).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, t in text.items() if t and any(x in t for x in items)}
    assert not whole & clean and len(clean) > 0.8 * len(text)
    masked = pipeline.mask_personal_data(spark, docs, SF).collect()
    assert len(masked) == len(text) and not any(base_spans(r.text or "") for r in masked)
