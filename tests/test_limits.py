"""The time limit of ask, and the rebuild in the background."""

import threading
import time

import pytest

from quillspark.plans.engine import Config, Engine

PAGES = "doc_id bigint, page_number int, text string"


class Slow:
    name = "slow"

    def generate(self, questions, contexts, prompts):
        time.sleep(40)
        return ["late"] * len(questions)


def pages(spark, about, doc=1):
    text = " ".join(f"The {about} number {i} stands by the river and is {i} feet tall, as everyone knows." for i in range(20))
    return spark.createDataFrame([(doc, 1, text)], PAGES)


@pytest.fixture
def engine(spark):
    made = Engine(spark, Config(strategy="sentences", threshold=0.0))
    made.build(pages(spark, "tower"))
    return made


def test_a_slow_answer_is_given_up(spark, engine):
    slow = Engine(spark, engine.config, generator=Slow())
    slow.load(engine.path)
    began = time.time()
    got = slow.ask("how tall is the tower?", conv_id=7, timeout=4)
    assert time.time() - began < 20
    assert got["model_used"] == "timeout" and got["sources"] == [] and got["confidence"] == 0 and got["response_time_ms"] >= 4_000
    assert slow.history().count() == 0
    tracker = spark.sparkContext.statusTracker()
    assert not tracker.getActiveJobsIds()
    # The same session goes on, and other threads' jobs weren't touched.
    assert engine.ask("how tall is the tower?", timeout=120)["model_used"] == "extractive"


def test_errors_and_no_limit_pass_through(spark, engine):
    with pytest.raises(ValueError):
        engine.ask("", timeout=60)
    with pytest.raises(ValueError):
        engine.ask("x?", timeout=60, max_chunks=99)
    assert engine.ask("how tall is the tower?", timeout=0)["n_sources"] > 0


def test_only_its_own_jobs_are_cancelled(spark, engine):
    slow = Engine(spark, engine.config, generator=Slow())
    slow.load(engine.path)
    out = []
    other = threading.Thread(target=lambda: out.append(spark.range(0, 50_000_000, 1, 8).selectExpr("sum(hash(id))").first()))
    other.start()
    assert slow.ask("how tall?", timeout=3)["model_used"] == "timeout"
    other.join()
    assert len(out) == 1


def test_rebuild_in_background(spark, engine):
    before = engine.store
    done = engine.rebuild_in_background(pages(spark, "windmill", 2))
    served = engine.ask("how tall is the tower?")  # from either store
    assert served["model_used"] == "extractive"
    assert done.result(120) is engine.store is not before
    assert "windmill" in engine.ask("how tall is the windmill?")["context"] and "tower" not in engine.search_text("tower")[0]["content"]
    failed = engine.rebuild_in_background(spark.createDataFrame([(1,)], "other int"))
    with pytest.raises(Exception, match="text"):
        failed.result(120)
    assert engine.search_text("windmill")
