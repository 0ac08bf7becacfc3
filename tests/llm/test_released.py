"""Shuffle files of finished steps do not wait for the driver's garbage collection."""

import time

from pagemend.llm import neardup


def test_shuffles_of_finished_steps_go(spark):
    live = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    words = [f"w{n}" for n in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 7 :] + [f"x{i % 3}"])) for i in range(60)], "doc_id long, text string")
    before, out = live(), neardup.near_duplicates(docs)
    ends = time.time() + 10
    while (left := live() - before) > 16 and time.time() < ends:
        time.sleep(0.2)
    assert left <= 16 and out.count() == 60
