"""Model replies that are asked for once: a durable table by prompt hash, written before it is read.

Prompts that the table lacks are found by an anti-join of their hashes, dealt out once by round and asked in
rounds of a bounded number of calls, some of them beside each other, each a job of its own. Rounds that
have ended are committed together as soon as the commit before is done. Whatever reads replies afterwards joins them by hash, so judging
twice, a lost executor while judging, or the next run over the same chunks calls nothing again; a
round that fails is asked again as a whole, and no earlier one is.
"""

from __future__ import annotations

import json
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.sources import scratch
from proofmill.sources.store import ChunkStore

#: Prompts of a round, about.
ROUND = 50_000
#: Rounds that run beside each other: each is a short job.
AT_ONCE = 8
REPLY = "prompt_hash string, reply string"


def answers(model, prompts: list[str]) -> list[str]:
    """A reply for each prompt; a call that fails gives an error object, and the model goes on after it."""
    replies: list[str] = []
    while len(replies) < len(prompts):
        before = len(replies)
        try:
            replies.extend(islice(model(iter(prompts[before:])), len(prompts) - before))
            if len(replies) == before:
                raise ValueError("no reply")
        except Exception as e:  # noqa: BLE001  a failing model call falls back, it never fails the job
            replies.append(json.dumps({"error": str(e)}))
    return replies


class ReplyTable:
    def __init__(self, spark: SparkSession, path: str, shards: int = 16):
        self.spark, self.store = spark, ChunkStore(spark, path, shards, "prompt_hash")

    def replies(self) -> DataFrame:
        return self.store.read() if self.store.version() else self.spark.createDataFrame([], REPLY)

    def ask(self, prompts: DataFrame, model, most: int = ROUND) -> int:
        """Asks the model for every prompt (column prompt) without a reply; how many those were."""
        wanted = prompts.select("prompt", F.sha2("prompt", 256).alias("prompt_hash")).where(F.col("prompt").isNotNull())
        at = scratch.shared(self.spark, "asked")
        if self.store.version():  # hashes alone meet first: texts move only where a reply is missing
            wanted.select("prompt_hash").distinct().join(self.replies().select("prompt_hash"), "prompt_hash", "left_anti").write.parquet(f"{at}-hashes")
            lacking = self.spark.read.schema("prompt_hash string").parquet(f"{at}-hashes")
            if lacking.isEmpty():
                return 0
            wanted = wanted.join(lacking, "prompt_hash", "left_semi")
        wanted.select("prompt", "prompt_hash").dropDuplicates(["prompt_hash"]).write.parquet(at)
        missing = self.spark.read.schema("prompt string, prompt_hash string").parquet(at)
        count = missing.count()
        rounds = -(-count // most)

        def run(frames):
            for frame in frames:
                frame["reply"] = answers(model, frame["prompt"].tolist())
                yield frame[["prompt_hash", "reply"]]

        if rounds > 1:  # dealt out once, so that a round reads its own prompts alone
            dealt = missing.withColumn("round", F.pmod(F.xxhash64("prompt_hash"), F.lit(rounds)).cast("int"))
            dealt.repartition("round").write.partitionBy("round").parquet(f"{at}-rounds")

        filled = [r["round"] for r in dealt.select("round").distinct().collect()] if rounds > 1 else range(rounds)

        def one(number: int) -> str:
            part = self.spark.read.schema("prompt string, prompt_hash string").parquet(f"{at}-rounds/round={number}") if rounds > 1 else missing
            out = f"{at}-{number}"  # written by the tasks that call; the store deals it out from there
            part.mapInPandas(run, REPLY).write.parquet(out)
            return out

        failed, waiting = None, set()
        with ThreadPoolExecutor(AT_ONCE) as pool:  # after one that fails no further round begins; those under way end
            try:
                waiting = {pool.submit(one, number) for number in filled}
                while waiting:
                    done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                    failed = next((e for e in (w.exception() for w in done) if e), failed)
                    if failed:
                        waiting = {w for w in waiting if not w.cancel()}
                    outs = [w.result() for w in done if not w.exception()]
                    if outs:
                        self.store.store(self.spark.read.schema(REPLY).parquet(*outs))
            finally:
                for w in waiting:
                    w.cancel()
        if failed:
            raise failed
        return count
