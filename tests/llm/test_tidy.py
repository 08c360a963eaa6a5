"""Intermediate files that nothing reads any more are gone while a job goes on."""

import os

from siltstream.llm.suffix_dedup import remove_repeated_bytes
from siltstream.plans.shared import put, scratch, shared_dir


def test_anchors_and_runs_are_dropped(spark):
    """Once contexts are written, anchors and runs are deleted; the result is made from what stays."""
    docs = spark.createDataFrame([(i, "".join(chr(97 + (i % 3 * 7 + j * j) % 23) for j in range(300))) for i in range(9)], "doc_id long, text string")
    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    out = remove_repeated_bytes(docs)
    left = sorted(n.split("-")[1] for n in set(os.listdir(root)) - before)
    assert not {"anchors", "runs"} & set(left) and "contexts" in left
    assert sorted((r.doc_id, r.n_removed) for r in out.collect())[3:] == [(i, 300) for i in range(3, 9)]


def test_tidy_put_keeps_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    d = put(spark.range(100).repartition(3, "id"), scratch(spark, "tidy"), tidy=True)
    assert d.count() == 100 and spark.conf.get(name, "false") == before
