"""Answers of a model, kept by prompt, so that each prompt is asked once."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcelode.operators.verdicts import BATCH, SYSTEM_PROMPT
from sourcelode.session import kept
from sourcelode.sources.manifests import Manifests

SHAPE = "prompt_hash string, answer string"


def prompt_hash(prompt, model) -> F.Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(SYSTEM_PROMPT), prompt), 256)


class AnswerLedger:
    """Answers below one folder, by the hash of model, system prompt and prompt.

    Asking takes the distinct prompts without an answer. A task stores each batch of answers as soon as it has them,
    one small file per prompt; a task that is repeated, or a job that is started again, finds these and asks only for
    what is missing. When all are there they become a Parquet folder that the next manifest names, and the small
    files go.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = ""):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.manifests = Manifests(spark, f"{self.path}/versions")

    def _folders(self) -> list[str]:
        return self.manifests.read(max(self.manifests.versions(), default=0))["tables"].get("answers", [])

    def answers(self) -> DataFrame:
        """All stored answers: prompt_hash, answer."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], SHAPE)
        return self.spark.read.schema(SHAPE).parquet(*[f"{self.path}/data/{folder}" for folder in folders])

    def ask(self, prompts: DataFrame, row_id: str, client, tasks: int, batch: int = BATCH) -> DataFrame:
        """(row_id, analysis_json, doubt_json) for rows with analysis_prompt and doubt_prompt.

        ``client(system_prompt, [prompt, ...]) -> [answer, ...]`` as for ``batch_infer``; an error of it fails the task,
        which Spark repeats. ``tasks`` bounds how many batches are in flight.
        """
        hashed = kept(prompts.select(
            row_id, "analysis_prompt", "doubt_prompt", prompt_hash(F.col("analysis_prompt"), self.model).alias("_judge"),
            prompt_hash(F.col("doubt_prompt"), self.model).alias("_doubt"),
        ), "prompts")
        both = hashed.select("_judge", "analysis_prompt").toDF("prompt_hash", "prompt").unionByName(
            hashed.select("_doubt", "doubt_prompt").toDF("prompt_hash", "prompt"))
        # Tasks drop their own copies before prompts are shuffled.
        missing = both.where(F.col("prompt").isNotNull()).dropDuplicates(["prompt_hash"]).join(self.answers(), "prompt_hash", "left_anti")
        self._add(missing.repartition(tasks, "prompt_hash").mapInPandas(self._asker(client, batch), SHAPE))
        known = self.answers()
        judged = known.select(F.col("prompt_hash").alias("_judge"), F.col("answer").alias("analysis_json"))
        doubted = known.select(F.col("prompt_hash").alias("_doubt"), F.col("answer").alias("doubt_json"))
        return hashed.join(judged, "_judge", "left").join(doubted, "_doubt", "left").select(row_id, "analysis_json", "doubt_json")

    def _asker(self, client, batch: int):
        pending, size, system_prompt = f"{self.path}/pending", batch, SYSTEM_PROMPT

        def ask(frames):
            import pandas as pd
            from pyarrow import fs

            system, folder = fs.FileSystem.from_uri(pending) if "://" in pending else (fs.LocalFileSystem(), pending)
            system.create_dir(folder, recursive=True)

            def stored(key):
                path = f"{folder}/{key}"
                if system.get_file_info(path).type != fs.FileType.File:
                    return None
                with system.open_input_stream(path) as stream:
                    return stream.read().decode()

            for frame in frames:
                found = {key: stored(key) for key in frame["prompt_hash"]}
                open_rows = frame[[found[key] is None for key in frame["prompt_hash"]]]
                for start in range(0, len(open_rows), size):
                    part = open_rows.iloc[start : start + size]
                    answers = list(client(system_prompt, part["prompt"].tolist()))
                    if len(answers) != len(part):
                        raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                    for key, answer in zip(part["prompt_hash"], answers):
                        draft = f"{folder}/.{key}-{uuid.uuid4().hex}"
                        with system.open_output_stream(draft) as stream:
                            stream.write(str(answer).encode())
                        system.move(draft, f"{folder}/{key}")
                        found[key] = str(answer)
                yield pd.DataFrame({"prompt_hash": list(found), "answer": list(found.values())})

        return ask

    def _add(self, answers: DataFrame) -> None:
        folder = uuid.uuid4().hex
        answers.write.parquet(f"{self.path}/data/{folder}")
        while True:
            version = max(self.manifests.versions(), default=0)
            named = self.manifests.read(version)["tables"].get("answers", [])
            if self.manifests.create(version + 1, {"tables": {"answers": [*named, folder]}}):
                break
        system, pending = self.manifests.folder(f"{self.path}/pending")
        system.delete(pending, True)
