"""Running a workflow: run parameters, the kinds of run, and a command line around them."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from ..streaming.scoring import score_stream
from .features import Workflow, WorkflowModel

RUN_TYPES = ("train", "score", "streaming_score", "features", "evaluate")


@dataclass
class RunParams:
    """Parameters of a run, from JSON or YAML: stage and reader parameters by name, and where things are."""

    stage_params: dict = field(default_factory=dict)
    reader_params: dict = field(default_factory=dict)
    model_location: str | None = None
    write_location: str | None = None
    metrics_location: str | None = None
    checkpoint_location: str | None = None
    custom: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> RunParams:
        try:
            found = json.loads(text)
        except ValueError:
            import yaml

            found = yaml.safe_load(text)
        snake = {"".join(f"_{c.lower()}" if c.isupper() else c for c in k): v for k, v in (found or {}).items()}
        unknown = snake.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown run parameters: {', '.join(sorted(unknown))}")
        return cls(**snake)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


@dataclass
class Runner:
    """A workflow and where its rows come from: functions of (spark, params) to frames of raw features."""

    workflow: Workflow
    training: Callable[[SparkSession, RunParams], DataFrame]
    scoring: Callable[[SparkSession, RunParams], DataFrame] | None = None
    streaming: Callable[[SparkSession, RunParams], DataFrame] | None = None
    metric: str = "au_pr"
    on_end: list[Callable[[dict], None]] = field(default_factory=list)

    def run(self, spark: SparkSession, kind: str, params: RunParams) -> dict:
        """Does one run and returns what it found; with a metrics location it is also written there. Jobs carry the run's kind
        as their group."""
        if kind not in RUN_TYPES:
            raise ValueError(f"a run is one of {', '.join(RUN_TYPES)}")
        began = time.time()
        spark.sparkContext.setJobGroup(kind, f"workflow: {kind}")
        try:
            out = {"run": kind} | getattr(self, f"_{kind}")(spark, params)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        out["seconds"] = round(time.time() - began, 3)
        if params.metrics_location:
            spark.createDataFrame([(json.dumps(out, default=str),)], "metrics string").coalesce(1).write.mode("overwrite").text(params.metrics_location)
        for f in self.on_end:
            f(out)
        return out

    def _train(self, spark: SparkSession, params: RunParams) -> dict:
        model = self.workflow.train(self.training(spark, params))
        model.save(spark, params.model_location)
        return {"summary": model.insights(), "filtered": model.filtered}

    def _loaded(self, spark: SparkSession, params: RunParams) -> WorkflowModel:
        return WorkflowModel.load(spark, params.model_location)

    def _score(self, spark: SparkSession, params: RunParams) -> dict:
        out = self._loaded(spark, params).score((self.scoring or self.training)(spark, params))
        out.write.mode("overwrite").parquet(params.write_location)
        return {"rows": spark.read.parquet(params.write_location).count()}

    def _streaming_score(self, spark: SparkSession, params: RunParams) -> dict:
        query = score_stream(self._loaded(spark, params), self.streaming(spark, params), params.write_location, params.checkpoint_location)
        return {"batches": len(query.recentProgress)}

    def _features(self, spark: SparkSession, params: RunParams) -> dict:
        df = self.training(spark, params)
        self.workflow.train(df).transform(df).write.mode("overwrite").parquet(params.write_location)
        return {"rows": spark.read.parquet(params.write_location).count()}

    def _evaluate(self, spark: SparkSession, params: RunParams) -> dict:
        return {self.metric: self._loaded(spark, params).evaluate((self.scoring or self.training)(spark, params), self.metric)}


def main(runner: Runner, args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """The command line of an application: --run-type and --params FILE, or single locations."""
    p = argparse.ArgumentParser()
    p.add_argument("--run-type", choices=RUN_TYPES, required=True)
    p.add_argument("--params")
    for name in ("model", "write", "metrics", "checkpoint"):
        p.add_argument(f"--{name}-location")
    a = p.parse_args(args)
    params = RunParams()
    if a.params:
        with open(a.params) as f:
            params = RunParams.parse(f.read())
    for name in ("model", "write", "metrics", "checkpoint"):
        if getattr(a, f"{name}_location"):
            setattr(params, f"{name}_location", getattr(a, f"{name}_location"))
    return runner.run(spark or SparkSession.builder.appName("featherloom").getOrCreate(), a.run_type, params)


def generate_project(df: DataFrame, response: str, key: str, name: str) -> str:
    """Source of an application for a table: its kind of problem from the response's values, a feature for each column."""
    from ..types import infer

    distinct = df.select(response).distinct().limit(31).count()
    kind = "binary" if distinct == 2 else "multi" if distinct <= 30 else "regression"
    rows = [f'    raw("{f.name}", "{infer(f)}"),' for f in df.schema.fields if f.name not in (response, key)]
    return "\n".join([
        f'"""{name}: a {kind} model of {response}."""', "", "from featherloom.plans.features import Workflow, raw, sanity_check, select_model, auto_encode",
        f"from featherloom.plans.models import {kind}_selector", "from featherloom.plans.runner import Runner, main", "",
        f'label = raw("{response}", "RealNN", response=True)', "predictors = [", *rows, "]",
        "checked = sanity_check(label, auto_encode(predictors))", f"prediction = select_model(label, checked, {kind}_selector())",
        f'workflow = Workflow([prediction], key="{key}")', "",
        'if __name__ == "__main__":', '    main(Runner(workflow, lambda spark, params: spark.read.parquet(params.reader_params["path"])))', "",
    ])
