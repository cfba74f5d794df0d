"""Parsing of judge outputs, language-model windows, and the stages that call injected models."""

from __future__ import annotations

import asyncio
import contextlib
import inspect
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import scalars as s
from ..functions import text as t
from ..functions.batches import bounded, slices

ERROR_MARKS = "ERROR:|failed to parse|maximum model length"


def repair_json(c: Column) -> Column:
    """Without commas before a closing bracket; one pass reaches what repeated passes do."""
    return F.regexp_replace(c, r"(?:,\s*)*,(\s*[}\]])", "$1")


def json_object(c: Column) -> Column:
    """The object in a model's answer as text: the whole answer, or else what stands between its outermost braces; NULL if neither is one."""
    whole = repair_json(F.trim(c))
    blob = repair_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))
    is_object = lambda x: F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{")
    return F.when(is_object(whole), whole).when(is_object(blob), blob)


def reasons(obj: Column) -> Column:
    """The reasons of a judge as non-blank lines, from a list or from a text with bullets."""
    own = F.get_json_object(obj, "$.reasons")
    listed = F.filter(F.transform(F.from_json(own, "array<string>"), lambda r: F.trim(r)), lambda r: r != "")
    lines = F.filter(F.transform(F.split(own, r"\r\n|[\n\r]"), lambda r: F.regexp_replace(r, r"^[ \t\-•*]+|[ \t\-•*]+$", "")), lambda r: r != "")
    is_list = F.ltrim(own).startswith("[") & F.try_parse_json(own).isNotNull()
    is_other = F.ltrim(own).startswith("{")
    return F.when(own.isNull() | is_other, F.array().cast("array<string>")).when(is_list, listed).otherwise(lines)


def fill_reasons(c: Column, least: int = 3, most: int = 8, filler: str = "(no reason given)") -> Column:
    missing = F.greatest(F.lit(least) - F.size(c), F.lit(0))
    return F.slice(F.concat(c, F.array_repeat(F.lit(filler), missing)), 1, most)


def is_error(reasons_col: Column) -> Column:
    return F.coalesce(F.exists(reasons_col, lambda r: r.rlike(ERROR_MARKS)), F.lit(False))


def parse_answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds native_like_score 0..10, confidence 0..1, verdict 0/1, reasons and parsed; what can't be parsed gets the fallback record."""
    obj = F.col("__obj")
    out = df.withColumn("__obj", json_object(F.col(raw)))
    value = lambda k: F.get_json_object(obj, f"$.{k}")
    fallback = F.array(F.concat(F.lit("ERROR: failed to parse: "), F.coalesce(F.substring(F.col(raw), 1, 80), F.lit(""))))
    return out.withColumns(
        {
            "parsed": obj.isNotNull(),
            "native_like_score": s.clamp(value("native_like_score"), 0, 10, 5, whole=True),
            "confidence": s.clamp(value("confidence"), 0.0, 1.0, 0.0),
            "verdict": s.clamp(value("verdict"), 0, 1, 0, whole=True),
            "reasons": fill_reasons(F.when(obj.isNull(), fallback).otherwise(reasons(obj))),
        }
    ).drop("__obj")


@dataclass(frozen=True)
class Calls:
    """How a task calls its judge. together: calls at a time; deadline: seconds for a call, None for any; wait: seconds before the second try, doubled for each further one up to most_wait."""

    retries: int = 2
    together: int = 1
    deadline: float | None = None
    wait: float = 0.0
    most_wait: float = 60.0


async def _threaded(model: Callable[[str], str], prompt: str) -> str:
    """model(prompt) in a thread of its own, which a deadline leaves behind: it ends by itself or with the worker."""
    loop = asyncio.get_running_loop()
    answer: asyncio.Future = loop.create_future()

    def put(how: str, value) -> None:
        if not answer.done():
            getattr(answer, how)(value)

    def work() -> None:
        try:
            how, value = "set_result", model(prompt)
        except Exception as e:  # noqa: BLE001 raised again where it is awaited
            how, value = "set_exception", e
        with contextlib.suppress(RuntimeError):  # the loop may be gone
            loop.call_soon_threadsafe(put, how, value)

    threading.Thread(target=work, daemon=True).start()
    return await answer


async def answers(model, prompts: list[str], calls: Calls) -> list[str]:
    """The answers in the order of the prompts; a call that fails or comes too late is tried again, and in the end an ERROR text. model may be a coroutine function."""
    free = asyncio.Semaphore(max(1, calls.together))
    call = model if inspect.iscoroutinefunction(model) or inspect.iscoroutinefunction(getattr(model, "__call__", None)) else lambda p: _threaded(model, p)

    async def one(prompt: str) -> str:
        answer = ""
        for k in range(calls.retries + 1):
            if k and calls.wait:  # without a place: others are asked meanwhile
                await asyncio.sleep(min(calls.most_wait, calls.wait * 2 ** (k - 1)))
            async with free:
                try:
                    return await asyncio.wait_for(call(prompt), calls.deadline)
                except TimeoutError:
                    answer = f"ERROR: no answer within {calls.deadline} s" if calls.deadline is not None else "ERROR: timed out"
                except Exception as e:  # noqa: BLE001 a failed row is data
                    answer = f"ERROR: {e}"
        return answer

    return list(await asyncio.gather(*(one(p) for p in prompts)))


def ask(prompts: DataFrame, judge: Callable[[], Callable[[str], str]], prompt_col: str = "prompt", retries: int = 2, batch_size: int = 16, calls: Calls | None = None) -> DataFrame:
    """Adds `raw`, the judge's answer, or an ERROR text after so many retries. judge() is called once per task.

    A judge with a method `batch` gets batch_size prompts at a time; the prompts of a batch that fails are asked one by one.
    calls: several at a time in a task, with deadlines and growing waits (retries counts if there is none); rows keep their order.
    """
    schema = StructType([*prompts.schema, StructField("raw", StringType())])
    how = calls or Calls(retries)

    def several(model, some):
        if hasattr(model, "batch"):
            try:
                found = list(model.batch(some))
                if len(found) == len(some):
                    return found
            except Exception:  # noqa: BLE001 asked one by one below
                pass
        return asyncio.run(answers(model, some, how))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = judge()
        size = max(batch_size, 8 * how.together)
        for frame in frames:
            own = frame[prompt_col].tolist()
            step = batch_size if hasattr(model, "batch") else size
            yield frame.assign(raw=[a for i in range(0, len(own), step) for a in several(model, own[i : i + step])])

    return prompts.mapInPandas(run, schema)


def token_budget(max_len: int = 8192, overhead: int = 0, new_tokens: int = 256, reserve: int = 64, least: int = 64) -> int:
    return max(least, max_len - overhead - new_tokens - reserve)


#: Windows that a scorer gets at a time.
SCORED = 512


def perplexity(docs: DataFrame, scorer: Callable[[], Callable[[list[list[str]]], list[float]]], id_col: str = "doc_id", text_col: str = "text", window: int = 256, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """n_tokens, n_windows, n_pred_tokens, neg_log_likelihood, perplexity and status of each row, repeated and null ids included.

    Windows are consecutive and have two tokens or more; scorer() is called once per task and returns, for each
    window, the sum of the negative log likelihoods of all its tokens but the first. A text is cut and scored in
    one pass over its row: tokens are what white space parts, or an array of them by `tokens`.
    """
    own = tokens(F.col(text_col)) if tokens else t.squeeze(F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        for batch in (part for whole in batches for part in slices(whole, "own")):
            rows = [x if x is None or tokens else x.split(" ") if x else [] for x in batch.column("own").to_pylist()]
            cut = [(i, r[k : k + window]) for i, r in enumerate(rows) if r for k in range(0, len(r), window) if len(r) - k >= 2]
            count, predicted, sums = [0] * len(rows), [0] * len(rows), [None] * len(rows)
            for k in range(0, len(cut), SCORED):
                part = cut[k : k + SCORED]
                for (i, w), x in zip(part, model([w for _, w in part]), strict=True):
                    count[i] += 1
                    predicted[i] += len(w) - 1
                    sums[i] = (sums[i] or 0.0) + float(x)
            columns = [pa.array([None if r is None else len(r) for r in rows], pa.int32()), pa.array(count, pa.int64()), pa.array(predicted, pa.int64()), pa.array(sums, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_tokens", "n_windows", "n_pred_tokens", "neg_log_likelihood"])

    bounded(docs.sparkSession)
    scored = docs.select(id_col, own.alias("own")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int, n_windows long, n_pred_tokens long, neg_log_likelihood double")
    status = F.when(F.col("n_tokens") < 1, "empty").when(F.col("neg_log_likelihood").isNull(), "too_short").otherwise("ok")
    return scored.withColumns({"perplexity": F.exp(F.col("neg_log_likelihood") / F.nullif("n_pred_tokens", F.lit(0))), "status": status})
