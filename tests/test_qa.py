"""Question rules, answer extraction and QA rows against Python restatements."""

from pyspark.sql import functions as F

from quire.operators import qa
from quire.plans import dataset


def rules_oracle(chunk):
    words = chunk.split()
    low = [w.lower() for w in words]
    out = []
    if any(w in qa.WHO_WORDS for w in low):
        out.append(qa.WHO_QUESTION)
    if any(w in qa.WHAT_WORDS for w in low):
        out.append(qa.WHAT_QUESTION)
    if any(w.isdigit() for w in words) or any(w in qa.WHEN_WORDS for w in low):
        out.append(qa.WHEN_QUESTION)
    if any(w in qa.WHERE_WORDS for w in low):
        out.append(qa.WHERE_QUESTION)
    return (out or list(qa.DEFAULT_QUESTIONS))[:3]


def test_rule_questions(spark):
    chunks = ["She went home. What now? In 2020 the city grew.",  # four fire, three kept
              "nothing fires here at all", "They left. The year 1999.", "city. 2020. she,",
              "WHERE is the Country", "", "²³ superscript digits", "in 2020² only", "x １２ y", "12b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chunks)], "id int, text string")
    for r in df.select("id", qa.rule_questions("text").alias("q")).collect():
        assert list(r.q) == rules_oracle(chunks[r.id]), chunks[r.id]


def test_parse_questions(spark):
    raw = "  Q one?\n\n  \nQ two?\r\nQ three?\nQ four?"
    r = spark.createDataFrame([(raw,)], "t string").select(qa.parse_questions("t").alias("q")).first()
    assert list(r.q) == [s.strip() for s in raw.split("\n") if s.strip()][:3]


def test_answer_offset_is_find(spark):
    pairs = [("b", "abcb"), ("", "abc"), ("z", "abc"), ("😀x", "a😀x😀x")]
    df = spark.createDataFrame(pairs, "a string, c string")
    got = [r.o for r in df.select(qa.answer_offset(F.col("a"), F.col("c")).alias("o")).collect()]
    assert got == [c.find(a) for a, c in pairs]


def test_extractive_answers_are_substrings(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = dataset.sentence_qa(docs).collect()
    assert rows
    for r in rows:
        assert r.id == f"{r.doc_id}_chunk_{r.chunk_no}_qa_{r.q_no}"
        assert r.answer_start >= 0
        assert r.context[r.answer_start:r.answer_start + len(r.answer)] == r.answer
        assert 0.0 <= r.score <= 1.0


def test_best_sentence_prefers_overlap_then_earliest(spark):
    ctx = "Cats sleep a lot. Dogs bark at night! Dogs bark at night. Birds sing?"
    df = spark.createDataFrame([("Why do dogs bark?", ctx), ("Unrelated words", ctx)], "q string, c string")
    got = df.select(qa.best_sentence(F.col("q"), qa.sentence_index("c")).alias("b")).collect()
    assert got[0].b.answer == "Dogs bark at night!" and got[0].b.overlap == 2
    assert got[1].b.answer == "Cats sleep a lot." and got[1].b.overlap == 0


def test_train_examples_drop_missing_answers(spark):
    flat = spark.createDataFrame(
        [("1", "ctx", "q", "a", 0), ("2", "ctx", "q", "zz", -1)],
        "id string, context string, question string, answer_text string, answer_start int")
    assert [r.id for r in qa.train_examples(flat).collect()] == ["1"]


def test_page_assembly_and_windows_with_question(spark):
    from quire.operators import chunking
    pages = spark.createDataFrame([(1, p, f"p{p}") for p in range(10)] + [(2, 0, None)],
                                  "doc long, page int, text string")
    got = {r.doc: (r.text, r.n_pages) for r in
           chunking.assemble_pages(pages, "doc", "page", "text", "|").collect()}
    assert got == {1: ("|".join(f"p{p}" for p in range(10)), 10), 2: ("", 1)}
    ctx = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(1, "a b c d", ctx)], "id int, q string, text string")
    wins = chunking.token_windows(df, ["id"], "text", 384, 128, question_col="q").orderBy("win_no").collect()
    budget = 384 - 4
    assert all(w.n_tokens <= budget for w in wins)
    assert [w.tok_start for w in wins] == list(range(0, 1000 - budget + (budget - 128), budget - 128))[:len(wins)]
    assert wins[-1].tok_start + wins[-1].n_tokens == 1000


def test_quarantine_reasons(spark):
    from quire.operators import corpus
    rows = [(1, None), (2, ""), (3, " \\t\\n "), (4, "short"), (5, "x" * 150), (6, "bad � " * 30)]
    # a replacement character that was written is text; bytes decide, see the file tests
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.status, r.reason) for r in corpus.quarantine(df, ["doc_id"]).collect()}
    assert got == {1: ("quarantine", "null_text"), 2: ("quarantine", "blank_text"),
                   3: ("quarantine", "too_short"), 4: ("quarantine", "too_short"),
                   5: ("ok", None), 6: ("ok", None)}


def test_incremental_anti_keeps_null_keys_and_drops_done(spark):
    from quire.operators import corpus
    new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "d2")], "doc_id long, text string")
    done = spark.createDataFrame([(2,), (None,), (4,)], "doc_id long")
    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    want = rows(new.join(done, "doc_id", "left_anti"))
    got = rows(corpus.incremental_anti(new, done, ["doc_id"]))
    assert got == want
    assert (None, "c") in got and (3, "d2") in got
