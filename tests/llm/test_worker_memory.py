"""What Python workers hold after a stage: Spark keeps them, and their memory counts against the executor."""

import os
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from undula.llm import decontam, toxicity


def held(spark) -> int:
    """Private MB of the largest Python worker."""

    def run(batches):
        import pyarrow as pa

        for _ in batches:
            time.sleep(0.5)  # so that each task is in a worker of its own
            found = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{os.getpid()}/smaps_rollup").read_text())
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, found)) >> 10], pa.int64())], ["mb"])

    return spark.range(0, 4, 1, 4).mapInArrow(run, "mb long").agg(F.max("mb")).first()[0]


def spent(spark, stage: str) -> None:
    text = F.expr("array_join(transform(sequence(1, 700), k -> substring(md5(concat(id, ':', k)), 1, 8)), ' ')")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    if stage == "toxicity":
        labels = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "int(id % 9 = 0) AS toxic")
        docs = toxicity.without_toxic(docs, toxicity.fit(docs.where("doc_id < 400"), labels))
    else:
        docs = decontam.without_contaminated(docs, spark.createDataFrame([(k, "one two three four five six") for k in range(50)], "item_id long, text string"))
    docs.write.format("noop").mode("overwrite").save()


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
@pytest.mark.parametrize("stage", ["toxicity", "decontamination"])
def test_workers_give_back_what_a_stage_has_freed(spark, stage):
    before = held(spark)
    spent(spark, stage)
    assert held(spark) < max(before, 40) + 50


def test_words_are_dropped_after_the_encoding():
    from undula.llm import tokens

    tokens.word_vocabulary(tokens.vocabulary_path("word_bpe_49k.json"))
    tokens.drop_vocabularies()
    assert not tokens._loaded
