"""The pipeline's stages, each against what brute force says of its input."""

import itertools

import pytest

import corpus_pipeline
from rulespan.llm.queries import QUERIES, SQL
from tests.llm.test_joins import brute_components
from tests.llm.test_texts import brute_overlap

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [{r.doc_id: r for r in df.collect()} for df in out], out


def test_stages_keep_the_columns(stages):
    frames = stages[1]
    assert all(set(df.columns) == set(frames[0].columns) for df in frames[:-1]) and set(frames[0].columns) <= set(frames[-1].columns)


def test_quality_stage_keeps_good_documents(stages, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = stages[0][1]
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values()) + 1


def test_line_stage_changes_only_what_recurs(stages):
    before, after = stages[0][1], stages[0][2]
    for d, r in after.items():
        lines = before[d].text.split("\n")
        kept = r.text.split("\n") if r.text else []
        assert r.n_chars == len(r.text) and (kept == lines or len(kept) < len(lines)) and all(x in lines for x in kept)


def test_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = stages[0][2], stages[0][3]
    want = {d for d, _, c in brute_components([(d, r.text) for d, r in before.items()], 5, 80, 100) if d == c}
    assert set(after) == want


def test_decontamination_stage_equals_brute_force(stages, spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[0][3], stages[0][4]
    assert set(after) == {d for d, r in before.items() if not any(brute_overlap(r.text, t) for t in items)}


def test_mixing_stage_samples(stages):
    before, after = stages[0][4], stages[0][5]
    assert set(after) <= set(before) and 0.2 * len(before) < len(after) < len(before) and all(0 < r.probability <= 1 for r in after.values())


def test_run_gives_the_last_stage(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(stages[0][5])


def words(c, n):
    return " ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))


def line_stage(spark, texts):
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, SF).collect()}


def test_line_stage_finds_passages_of_few_documents_and_short_lines(spark):
    passage, own = words("p", 60), lambda d: words(f"own{chr(97 + d)}", 80)
    texts = {d: f"{own(d)}\n{passage}" for d in (3, 4)}
    texts |= {d: own(5) + "\n" + words("q", 70) + end for d, end in ((5, ""), (6, " more"), (7, ""))}  # copies of each other
    texts |= {d: words(f"z{chr(97 + d // 26)}{chr(97 + d % 26)}", 9) + "\nAll rights reserved.\n12 7" for d in range(100, 160)}
    out = line_stage(spark, texts)
    assert out[3] == texts[3] and out[4] == own(4)
    assert all(out[d] == texts[d] for d in (5, 6, 7)), "copies are left to the next stage"
    assert out[100] == texts[100] and all(out[d] == texts[d].replace("All rights reserved.\n", "") for d in range(101, 160))


def test_line_stage_keeps_what_little_is_left(spark):
    passages = [words(f"p{c}", 60) for c in "abcdefghij"]
    texts = {k: p + "\n" + words(f"own{chr(97 + k)}", 80) for k, p in enumerate(passages[1:])}
    texts[50] = "\n".join(passages)  # first for one passage of ten
    texts[51] = words("tail", 20) + "\n" + "\n".join(passages[:5])
    texts[52] = "\n".join(passages[3:5]) + "\n \n"
    out = line_stage(spark, texts)
    assert out == {**{k: texts[k] for k in range(9)}, 50: passages[0], 51: words("tail", 20)}


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    rows = [(1, a), (1, a), (1, b), (None, a), (None, c), (None, c + " x"), (None, None), (2, b), (3, ""), (3, ""), (4, "x " + b), (5, None), (6, "alone")]
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), SF).collect()]
    assert sorted(x for x in out if x[0] is not None and x[1]) == [(1, a), (1, b), (6, "alone")]
    assert len([x for x in out if x[0] is None and x[1]]) == 1 and out.count((3, "")) == 2 and out.count((5, None)) == 1 and out.count((None, None)) == 1


def test_stages_take_odd_rows_and_empty_tables(spark):
    a = words("a", 60)
    rows = [(None, a), (None, "other words"), (7, None), (7, ""), (8, a), (8, "unlike text of the same id " + words("b", 70)), (9, "x" * 200_000), (8, a)]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} <= set(rows), name
        empty = stage(spark, docs.where("false"), SF)
        assert empty.columns == out.columns and empty.count() == 0, name


def test_names():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == [] and set(SQL) <= set(QUERIES)
    assert len(list(itertools.chain(corpus_pipeline.STAGES))) == 5
