"""Ranking and answers: what moves, what comes back."""

import re

from pyspark.sql import functions as F

from paperloom.functions import scale
from paperloom.operators import model_map as MM
from paperloom.operators import retrieval as Q


def pages_of(spark):
    rows = [(1, 1, "the cat sat"), (1, 2, "a dog ran after the cat"), (1, 3, "nothing here"), (2, 1, ""), (2, 2, " \n"), (3, 1, "only page")]
    return spark.createDataFrame(rows, "doc int, page int, text string")


def exchanged(df):
    """Columns of every exchange of the plan."""
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]
    formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return plan, re.findall(r"\) (?:Broadcast)?Exchange\n(?:Input \[\d+\]|Output \[\d+\]): \[([^\]]*)\]", formatted)


def test_no_text_is_moved_to_rank(spark):
    pages = pages_of(spark)
    questions = spark.createDataFrame([(1, 1, "cat and dog"), (1, 2, "zebra"), (3, 1, "page")], "doc int, q_id int, question string")
    ranked = Q.rank_pages(pages, questions, "doc")
    _, moved = exchanged(ranked)
    assert moved and not any("text#" in columns for columns in moved)
    got = {(r.doc, r.q_id, r.page): r.rank for r in ranked.collect()}
    assert got[1, 1, 2] == 1 and got[1, 1, 1] == 2 and (1, 1, 3) not in got and got[3, 1, 1] == 1
    assert {k[2] for k in got if k[:2] == (1, 2)} == {1, 2, 3}


def test_every_question_comes_back(spark):
    questions = spark.createDataFrame([(1, 1, "cat"), (2, 1, "what?"), (3, 1, None), (4, 1, "unknown document"), (3, 2, "fail")], "doc int, q_id int, question string")

    def model(system, user):
        if "Question: fail" in user:
            raise RuntimeError("no model today")
        return "It says [p.1] and [p.9].", 3
    got = {(r.doc, r.q_id): r for r in MM.ask(questions, pages_of(spark), "doc", model=model).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (3, 2)}
    assert got[1, 1].kept == [1] and got[1, 1].dropped == [9] and "9" not in got[1, 1].answer
    assert got[2, 1].answer is None and "no text" in got[2, 1].note and got[4, 1].note == got[2, 1].note
    assert got[3, 2].failed and got[3, 2].note == "no model today" and got[3, 2].answer is None


def test_sieve_keeps_all_that_is_wanted(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("a"), F.concat(F.lit("t"), (F.col("id") % 90).cast("string")).alias("b"))
    wanted = rows.filter("a < 40").select("a", "b").unionByName(spark.createDataFrame([(None, "t1")], "a long, b string"))
    kept = scale.sieve(rows, wanted, ["a", "b"])
    assert kept.filter("a < 40").count() == rows.filter("a < 40").count()
    assert kept.count() < 1.05 * rows.filter("a < 40").count() + 5
    assert scale.sieve(rows, wanted.limit(0), ["a", "b"]).count() == 0
    assert scale.sieve(rows, wanted, ["a", "b"], bits=64).filter("a < 40").count() == rows.filter("a < 40").count()
