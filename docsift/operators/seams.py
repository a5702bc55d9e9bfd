"""Where Python must run: recognition engines, classifiers and language models behind narrow Arrow interfaces.

An engine is made once in each Python worker. It sees a batch at a time; rows that fail give an error, not an exception.
"""

import time
from collections.abc import Callable, Iterator
from functools import cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import kept

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


class Engine(Protocol):
    """Recognises the text of an encoded image: (text, confidence, (x1, y1, x2, y2) or None) for each box."""

    def recognise(self, image: bytes) -> list[tuple[str, float, tuple[int, int, int, int] | None]]: ...


class StubEngine:
    """Takes the image's bytes as UTF-8 text and lays its words out ten a line, each a little off its line."""

    def recognise(self, image):
        words = [w for w in image.decode("utf-8", "replace").replace("\n", " ").split(" ") if w]
        place = lambda i: (i % 10 * 40, i // 10 * 20 + i * 7 % 15)
        return [(w, (i % 10 + 1) / 10, (x := place(i))[0:1] + x[1:2] + (x[0] + 30, x[1] + 12)) for i, w in enumerate(words)]


def unavailable(name: str) -> Callable[[], Engine]:
    """A factory for an engine whose library isn't installed: using it says so."""

    def make():
        raise NotImplementedError(f"{name}: this back end isn't installed; pass an engine of your own")

    return make


ENGINES: dict[str, Callable[[], Engine]] = {"stub": StubEngine, "paddleocr": unavailable("paddleocr"), "tesseract": unavailable("tesseract")}


def engine(name: str) -> Callable[[], Engine]:
    if name not in ENGINES:
        raise ValueError(f"unknown engine: {name}")
    return ENGINES[name]


@cache
def _made(factory: Callable[[], object]) -> object:
    return factory()


def recognise(images: DataFrame, factory: Callable[[], Engine], id_col: str = "doc_id", image_col: str = "image", keep_errors: bool = False) -> DataFrame:
    """(doc_id, seq, text, confidence, bbox, error, seconds): a row for each box, with the seconds of its whole image. With keep_errors an image that fails, is null or has no text is a row
    without a box, with its error if there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            own, broken = _made(factory), None
        except Exception as e:  # noqa: BLE001
            own, broken = None, str(e)
        for batch in batches:
            out = []
            for doc, image in zip(batch.doc_id, batch.image, strict=True):
                began = time.perf_counter()
                try:
                    boxes, error = ([], broken) if own is None else ([], "no image") if image is None else (own.recognise(bytes(image)), None)
                except Exception as e:  # noqa: BLE001
                    boxes, error = [], str(e)
                took = time.perf_counter() - began
                out += [(doc, i, t, float(c), dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)) if b else None, None, took) for i, (t, c, b) in enumerate(boxes)]
                if not boxes and keep_errors:
                    out.append((doc, None, None, None, None, error, took))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "text", "confidence", "bbox", "error", "seconds"])

    source = images.select(F.col(id_col).alias("doc_id"), F.col(image_col).alias("image"))
    source = source if keep_errors else source.where("image is not null")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, seq int, text string, confidence double, bbox {BOX}, error string, seconds double")


def answered(prompts: DataFrame, ask: Callable[[str], str], id_col: str = "doc_id", prompt_col: str = "prompt", retries: int = 1, wait: float = 65.0, spacing: float = 0.0) -> DataFrame:
    """(id, answer, error) from a language-model client. A rate-limit error (429) is retried after wait seconds; spacing seconds pass between
    calls. Coalesce the prompts to bound how many calls run at once."""

    def one(prompt: str):
        for attempt in range(retries + 1):
            try:
                return ask(prompt), None
            except Exception as e:  # noqa: BLE001
                if "429" not in str(e) or attempt == retries:
                    return None, str(e)
                time.sleep(wait)
        return None, "no attempt"

    def run(batches):
        for batch in batches:
            out = []
            for p in batch.prompt:
                out.append(one(p))
                if spacing:
                    time.sleep(spacing)
            yield pd.DataFrame({"doc_id": batch.doc_id, "answer": [a for a, _ in out], "error": [e for _, e in out]})

    source = prompts.select(F.col(id_col).alias("doc_id"), F.col(prompt_col).alias("prompt"))
    return source.mapInPandas(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, answer string, error string")


#: What a client's error says when it is asked too often.
REFUSED = r"429|RESOURCE_EXHAUSTED"
ASKED = "doc_id {kind}, prompt string, attempts int, answer string, error string, seconds double, asked boolean"


def asked_once(queue: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """(doc_id, prompt, attempts, answer, error, seconds, asked) of a queue (doc_id, prompt, attempts). A task that is refused asks nothing more: its other rows come back unasked."""
    import re

    import pyarrow as pa

    def run(batches):
        closed = False
        for batch in batches:
            out = []
            for prompt, attempts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                answer = error = None
                if closed:
                    out.append((attempts, answer, error, 0.0, False))
                    continue
                began = time.perf_counter()
                try:
                    answer = ask(prompt)
                except Exception as e:  # noqa: BLE001
                    error = str(e)
                    closed = re.search(REFUSED, error) is not None
                out.append((attempts + 1, answer, error, time.perf_counter() - began, True))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "prompt", "attempts", "answer", "error", "seconds", "asked"])

    return queue.mapInArrow(run, ASKED.format(kind=queue.schema["doc_id"].dataType.simpleString()))


def answered_in_passes(prompts: DataFrame, ask: Callable[[str], str], folder: str | None = None, attempts: int = 2, wait: float = 65.0, calls: int | None = None, id_col: str = "doc_id", prompt_col: str = "prompt") -> DataFrame:
    """(doc_id, answer, error, attempts, seconds) of every prompt, from a client that may refuse to be asked so often.

    Refused prompts go back to a queue and are asked again in a later pass, each up to attempts times; no task waits. calls: how many prompts a pass takes from the queue,
    all tasks together; wait: seconds between passes. The queue and each pass's answers are written, so that a lost executor or a second reader asks nothing again. doc_id is unique.
    """
    queue = kept(prompts.select(F.col(id_col).alias("doc_id"), F.col(prompt_col).cast("string").alias("prompt"), F.lit(0).alias("attempts")), "queue", folder)
    done = None
    while not queue.isEmpty():
        if done is not None and wait:
            time.sleep(wait)
        now = queue if calls is None else kept(queue.orderBy("attempts", "doc_id").limit(calls), "pass", folder)
        out = kept(asked_once(now, ask), "answers", folder)
        again = ~F.col("asked") | (F.coalesce(F.col("error").rlike(REFUSED), F.lit(False)) & (F.col("attempts") < attempts))
        left = out.where(again).select("doc_id", "prompt", "attempts")
        if calls is not None:
            left = left.unionByName(queue.join(now.select("doc_id"), "doc_id", "left_anti").select("doc_id", "prompt", "attempts"))
        own = out.where(~again).select("doc_id", "answer", "error", "attempts", "seconds")
        done = own if done is None else done.unionByName(own)
        queue = kept(left, "queue", folder)
    return done if done is not None else queue.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("answer", "string"), ("error", "string"), ("attempts", "int"), ("seconds", "double"))))


def classified(images: DataFrame, factory: Callable[[], Callable[[np.ndarray], np.ndarray]], features_col: str = "features", id_col: str = "doc_id") -> DataFrame:
    """(id, p): class probabilities from a model that maps a batch of feature rows to rows of logits."""

    def run(batches):
        model = _made(factory)
        for batch in batches:
            logits = np.asarray(model(np.array(batch.features.tolist(), float)), float)
            powers = np.exp(logits - logits.max(1, keepdims=True))
            yield pd.DataFrame({"doc_id": batch.doc_id, "p": list(powers / powers.sum(1, keepdims=True))})

    source = images.select(F.col(id_col).alias("doc_id"), F.col(features_col).alias("features"))
    return source.mapInPandas(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, p array<double>")
