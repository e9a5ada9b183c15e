"""Records through ordered stages in one Arrow pass, and questions to several models at a time.

Both run inside tasks on batches: what is in flight is bounded, whatever the number of rows, and what goes wrong with one row or model is said in the result.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, TimeoutError as Late
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_folder

MOST_MODELS = 12


class Drop(Exception):
    """Raised by a stage to take a record out, with the reason and, if it likes, what it had made of the record."""

    def __init__(self, reason: str = "", payload: Any = None):
        super().__init__(reason)
        self.reason, self.payload = reason, payload


@dataclass(frozen=True)
class Stage:
    """A step that takes a record and gives the record for the next. ``open`` and ``close`` run once in each task, before its first and after its last record."""

    name: str
    process: Callable[[dict], dict]
    open: Callable[[], None] | None = None
    close: Callable[[], None] | None = None


@dataclass
class Passed:
    """``kept``: place and the columns of the schema; ``dropped``: place, stage, reason, payload (JSON) and item (JSON of the record as it came)."""

    kept: DataFrame
    dropped: DataFrame


def through(rows: DataFrame, stages: list[Stage], schema: str) -> Passed:
    """Every row through the stages in order. ``place`` numbers the rows as they came, so their order can be had again; kept and dropped together are all rows.

    A stage that fails otherwise than by Drop fails the job, and the error names the stage and the place: a mistake in a stage never loses records in silence.
    """
    checkpoint_folder(rows.sparkSession)
    shape = rows.sparkSession.createDataFrame([], schema).schema
    names = list(rows.columns)
    out = StructType.fromDDL(f"place bigint, kept struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in shape)}>, stage string, reason string, payload string, item string")
    numbered = rows.select(F.monotonically_increasing_id().alias("place"), F.struct(*names).alias("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[Stage] = []
        try:
            for stage in stages:
                if stage.open:
                    stage.open()
                opened.append(stage)
            for batch in batches:
                told = [_one(place, item, stages, shape.names) for place, item in zip(batch.column("place").to_pylist(), batch.column("item").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(told, arrow)
        finally:
            for stage in reversed(opened):
                if stage.close:
                    stage.close()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    done = numbered.mapInArrow(run, out).checkpoint()
    return Passed(done.filter("reason is null").select("place", "kept.*"), done.filter("reason is not null").select("place", "stage", "reason", "payload", "item"))


def _one(place: int, item: dict, stages: list[Stage], names: list[str]) -> dict:
    now = dict(item)
    for stage in stages:
        try:
            now = stage.process(now)
        except Drop as drop:
            payload = None if drop.payload is None else json.dumps(drop.payload, default=str)
            return {"place": place, "kept": None, "stage": stage.name, "reason": drop.reason or "no reason given", "payload": payload, "item": json.dumps(item, default=str)}
        except Exception as error:
            raise RuntimeError(f"stage {stage.name!r} failed on the record at place {place}: {error!r}") from error
    return {"place": place, "kept": {n: now.get(n) for n in names}, "stage": None, "reason": None, "payload": None, "item": None}


ANSWERS = "question string, model string, ok boolean, answer string, error string, seconds double"


def ask_many(questions: DataFrame, models: dict[str, Callable[[str], str]], concurrency: int = 4, patience: float = 60.0, gives_up_after: int = 5) -> DataFrame:
    """question, model, ok, answer, error, seconds of every question (question, prompt) to every model, at most MOST_MODELS of them.

    A task has at most ``concurrency`` calls in flight. An error, an empty answer or an answer that takes longer than ``patience`` seconds is a row that says so and touches no
    other model. After ``gives_up_after`` failures in a row a task stops asking that model and says that too. Answers are in the order of the questions and models.
    """
    if len(models) > MOST_MODELS:
        raise ValueError(f"at most {MOST_MODELS} models")
    names = [x.split()[0] for x in ANSWERS.split(", ")]
    kinds = pa.schema([("question", pa.string()), ("model", pa.string()), ("ok", pa.bool_()), ("answer", pa.string()), ("error", pa.string()), ("seconds", pa.float64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failures = dict.fromkeys(models, 0)
        pool = ThreadPoolExecutor(concurrency)

        def call(model: str, prompt: str) -> tuple[str, float]:
            start = time.monotonic()
            return models[model](prompt), time.monotonic() - start

        def settled(question: str, model: str, future: Future | None) -> tuple:
            if future is None:
                return question, model, False, None, "not asked after repeated failures", 0.0
            try:
                answer, took = future.result(patience)
                good = bool(answer and answer.strip())
                row = question, model, good, answer if good else None, None if good else "empty answer", took
            except Late:
                row = question, model, False, None, f"no answer within {patience:g} s", patience
            except Exception as error:  # noqa: BLE001  whatever a model raises is its answer
                row = question, model, False, None, f"{type(error).__name__}: {error}"[:300], 0.0
            failures[model] = 0 if row[2] else failures[model] + 1
            return row

        try:
            for batch in batches:
                asked = [(q, m, p) for q, p in zip(batch.column("question").to_pylist(), batch.column("prompt").to_pylist(), strict=True) for m in models]
                for a in range(0, len(asked), concurrency):
                    futures = [(q, m, pool.submit(call, m, p or "") if failures[m] < gives_up_after else None) for q, m, p in asked[a : a + concurrency]]
                    rows = [settled(*f) for f in futures]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return questions.select("question", "prompt").mapInArrow(ask, ANSWERS)
