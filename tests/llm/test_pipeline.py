"""The pipeline on small tables: each stage against what its operator decides on the stage's own input."""

import random

import pytest
from test_jaccard import brute

import corpus_pipeline
from supplymesh.llm import ecoc, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(6)
    made = {lang: ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(300)] for lang, letters in (("aa", "abcdefg"), ("bb", "hijklmn"))}
    rows, labels = [], []
    for i in range(240):
        lang = r.choice(list(made))
        words = r.choices(made[lang], k=r.randint(8, 60))
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["vileone", "viletwo", "scum"]))
        rows.append((i, " ".join(words), lang, "s", 1))
        labels.append((i, 1, toxic))
    rows += [(1000 + i, rows[i][1] + (" tail" if i % 2 else ""), rows[i][2], "copy", 1) for i in range(0, 60)]
    rows += [(2000, "12345 !!", None, None, None), (2001, None, None, None, None), (2002, "", "aa", None, 0), (None, rows[1][1], "aa", None, None), (7, rows[7][1], rows[7][2], "s", 1)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, dict((i, t) for i, _, t in labels)


def test_stages(spark, tables):
    folder, rows, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept.columns == columns
    one = sorted(str(r.doc_id) for r in kept.collect())
    assert one == sorted(str(r[0]) for r in rows if model.judge(r[1])[0] < 0.5)
    there = {int(x) for x in one if x != "None"}
    assert sum(t for i, t in toxic.items() if i in there) <= 0.2 * sum(toxic.values()) and sum(1 - t for i, t in toxic.items() if i in there) >= 0.95 * sum(1 - t for t in toxic.values())
    spoken = corpus_pipeline.drop_unknown_language(spark, kept, folder)
    assert spoken.columns == columns
    two = sorted(str(r.doc_id) for r in spoken.collect())
    assert not {"2000", "2001", "2002"} & set(two) and len(two) > 0.95 * (len(one) - 3)
    single = corpus_pipeline.keep_one_of_near_copies(spark, spoken, folder)
    assert single.columns == columns
    left = [(r.doc_id, r.text) for r in spoken.collect() if r.doc_id is not None]
    want = {c for _, c in brute(dict(left).items()).values()}
    assert sorted(r.doc_id for r in single.filter("doc_id is not null").collect()) == sorted(want)
    assert single.filter("doc_id is null").count() == 0  # that row copies a document with an id
    packed = corpus_pipeline.pack_sequences(spark, single, folder).collect()
    assert {g.doc_id for g in packed} == want and max(g.offset + g.length for g in packed) <= 2048


def test_near_copies_with_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a), (5, b), (5, b), (5, b + " tail"), (6, a + " tail"), (7, c), (None, c), (None, c + " tail"), (None, d), (None, d), (None, d + " tail"), (None, None), (None, None), (None, " "), (8, ""), (8, ""), (8, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    named = sorted((i, (t or "")[:40]) for i, t in got if i is not None)
    assert named == sorted([(5, a[:40]), (5, b[:40]), (7, c[:40]), (8, ""), (8, "")])
    assert sorted(str(t)[:40] for i, t in got if i is None) == sorted([d[:40], "None", "None", " "])


def test_columns_of_any_name_stay(spark, tables):
    folder, rows, _ = tables
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "evidence", "predicted", "__id", "__digest", "row", "id", "digest", "__text"]
    extra = [f"own {n}" for n in names[5:]]
    docs = spark.createDataFrame([(*r, *extra) for r in rows[:60]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names[5:]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == names
        got = kept.collect()
        assert got and all(list(r)[5:] == extra for r in got) and {r["doc_id"]: r["text"] for r in got}.items() <= {r[0]: r[1] for r in rows}.items()


def test_run(spark, tables):
    folder, _, _ = tables
    assert corpus_pipeline.run(spark, folder).count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "packing"] and corpus_pipeline.ORACLE_SQL is None
    assert ecoc.UNKNOWN == "und"


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_null_texts_in_each_stage(spark, tables, stage):
    folder, rows, _ = tables
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*rows[:40], (5000, None, None, None, None), (None, None, None, None, None), (5001, "", None, None, 0)], shape)
    kept = stage(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() <= 43
    assert stage(spark, docs.limit(0), folder).count() == 0
