"""Steps that meet every row with every question: what they return and move must not grow with both, and must stay the same."""

from corvane.llm.common import BATCH_BYTES
from corvane.operators import lanes, postings, syntax
from corvane.plans import answers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ASKED = [(1, "red door house"), (2, "lamp"), (3, "the of"), (4, "door red")]
TEXTS = [(i, " ".join(["red"] * (i % 7 + 1) + ["door"] * (i % 3) + ["house"] * (i % 5 == 0) + ["lamp"] * (i % 4) + ["x"] * (i % 11))) for i in range(1, 301)] + [(400, None), (401, "")]


def made(spark):
    return spark.createDataFrame(ASKED, "qid int, text string"), spark.createDataFrame(TEXTS, "id long, text string").repartition(3)


def test_hits_of_a_lane_are_the_best_of_each_task(spark):
    q, docs = made(spark)
    terms = postings.query_terms(q)
    whole, best = postings.question_hits(docs, "id", "text", terms), postings.question_hits(docs, "id", "text", terms, 4)
    assert rows(lanes.text_lanes(whole, 4, {"and": 1.0, "or": 0.6})) == rows(lanes.text_lanes(best, 4, {"and": 1.0, "or": 0.6}))
    assert best.count() <= 3 * 2 * 4 * 3 < whole.count()


def test_term_reach_by_counts_of_tasks_and_by_postings(spark, monkeypatch):
    q, docs = made(spark)
    terms = postings.query_terms(q)
    by_task = rows(postings.term_reach(docs, "id", "text", terms))
    assert [r[0] for r in by_task] == [1, 2, 4] and all(r[2] for r in by_task)
    monkeypatch.setattr(postings, "MATRIX_ENTRIES", 0)
    assert by_task == rows(postings.term_reach(docs, "id", "text", terms))


def test_syntax_by_rows_and_by_positions(spark, monkeypatch):
    q = spark.createDataFrame([(1, 'red "door house" -lamp'), (2, '"red door" OR lamp'), (3, "-red"), (4, '"the house" -"red door"'), (5, "of the")], "qid int, text string")
    _, docs = made(spark)
    asked = syntax.clauses(q)
    by_row = syntax.matches(docs, "id", "text", asked)
    assert "Generate" not in plan(by_row)
    got = rows(by_row)
    monkeypatch.setattr(syntax, "MATRIX_QUESTIONS", 0)
    assert got == rows(syntax.matches(docs, "id", "text", asked)) and {r[0] for r in got} >= {2}
    twice = docs.unionByName(spark.createDataFrame([(7, "door house")], "id long, text string"))  # rows with one id count as one
    monkeypatch.undo()
    got = rows(syntax.matches(twice, "id", "text", asked))
    monkeypatch.setattr(syntax, "MATRIX_QUESTIONS", 0)
    assert got == rows(syntax.matches(twice, "id", "text", asked))


def test_cover_lane_by_rows_and_by_positions(spark, monkeypatch):
    q, docs = made(spark)
    terms = postings.query_terms(q)
    by_row = syntax.cover_lane(docs, "id", "text", terms, 5)
    assert "collect_list" not in plan(by_row)
    got = rows(by_row)
    monkeypatch.setattr(syntax, "MATRIX_QUESTIONS", 0)
    assert got == rows(syntax.cover_lane(docs, "id", "text", terms, 5)) and len(got) == 15


def test_holders_by_rows_and_by_runs(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "a b c d e"), (2, "b c"), (3, "x  y z"), (4, None), (5, "c d e f g h")], "qid int, text string")
    pages = spark.createDataFrame([(1, "0 a b c d e f"), (2, "a b c d"), (3, "x  y zz"), (4, None), (5, "c d e f g hh")], "id long, page string")
    by_row = lanes.holders(asked, pages)
    assert "xxhash64" not in plan(by_row)
    got = rows(by_row)
    monkeypatch.setattr(lanes, "MATRIX_QUESTIONS", 0)
    assert got == rows(lanes.holders(asked, pages)) == [(1, 1), (2, 1), (2, 2), (3, 3), (5, 5)]


def test_spelling_by_matrix_and_by_trigrams(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in ("housse", "zzz", "mouze", "a", "hous-e", "banana", None)], "word string")
    terms = spark.createDataFrame([(t,) for t in ("house", "mouse", "houses", "ab", "anna")], "term string")
    by_matrix = lanes.nearest_terms(words, terms)
    assert "Join" not in plan(by_matrix)
    got = rows(by_matrix)
    monkeypatch.setattr(lanes, "MATRIX_TERMS", 0)
    assert got == rows(lanes.nearest_terms(words, terms)) and len(got) >= 3


def test_trigram_lane_bounds_what_a_task_holds(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    q, docs = made(spark)
    lanes.trigram_lane(q, docs, 2, 0.3)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES


def test_features_and_envelopes_read_written_words_and_lanes(spark, sf_dir):
    assert "held_words" in " ".join(answers.featured(spark, sf_dir).inputFiles())
    files = [f for f in answers.answer_envelope(spark, sf_dir).inputFiles() if "/lanes-" in f]
    assert files
