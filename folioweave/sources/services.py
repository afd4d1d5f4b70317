"""Network services and codecs as pluggable functions over batches, called only for rows that need them.

A service is a function of a list of texts to a list of results. It is called in
one mapInArrow per partition, for as many texts at once as their results may fill
RESULT_BYTES, since an answer can be many times its text; what is stored already is
anti-joined away before, and results are written by key, so a retried task never
repeats stored work.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from folioweave.functions.errors import CLASSES, CODES
from folioweave.functions.plain import values

#: Attempts of each client, and the classes of errors that end its run: nothing after them is asked for.
ATTEMPTS = {"primary": 6, "fallback": 4, "primary_speech": 6, "fallback_speech": 1}
ABORTS = {"primary": ("daily_quota",), "fallback": ("daily_quota", "authentication", "model_not_found"), "primary_speech": ("daily_quota", "model_not_found"), "fallback_speech": ()}
RETRIES = ("rate_limit", "temporary")
Cleaner = Callable[[list[str]], list[str]]
Speaker = Callable[[list[str]], list[bytes]]


def identity_cleaner(texts: list[str]) -> list[str]:
    """A deterministic stand-in for a cleaning service."""
    return [" ".join(t.split()) for t in texts]


def tone_speaker(texts: list[str]) -> list[bytes]:
    """A deterministic stand-in for a narration service: 16-bit PCM of 160 frames a word."""
    return [b"\x01\x00" * 160 * max(1, len(t.split())) for t in texts]


#: Results of about so many bytes live at once in a worker; a call takes at most MOST_TEXTS texts.
RESULT_BYTES, MOST_TEXTS = 16 << 20, 256


def shares(weights: list[int], room: Callable[[], float]) -> Iterator[tuple[int, int, int]]:
    """(start, end, weight) of runs of texts, each of one text at least; room() is asked before each run."""
    start = 0
    while start < len(weights):
        end, held, most = start, 0, room()
        while end < len(weights) and end - start < MOST_TEXTS and (end == start or held + weights[end] <= most):
            held, end = held + weights[end], end + 1
        yield start, end, held
        start = end


def applied(df: DataFrame, service: Callable[[list[str]], list], text: str, output: str, kind: str, done: DataFrame | None = None, keys: tuple[str, ...] = (), score: tuple[str, Callable] | None = None) -> DataFrame:
    """df with the service's result per row; rows whose keys are in `done` are left out.

    score: name and function of a double column, of a text and its result, computed in the same worker.
    """
    todo = df.join(done.select(*keys), list(keys), "left_anti") if done is not None else df
    names = todo.columns
    made = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = getattr(service, "begin", None)
        call, growth = begin() if begin else service, 16384.0
        for batch in batches:
            # 16 for each text stand for results of texts that are short or null.
            weights = [16 + n for n in pc.fill_null(pc.binary_length(batch.column(names.index(text))), 0).to_pylist()]
            for start, end, weight in shares(weights, lambda: RESULT_BYTES / growth):
                part = batch.slice(start, end - start)
                texts = values(part.column(names.index(text)))
                results = call(texts)
                # Bytes of a result for each byte of a text, as in the last call; a fall is trusted by halves.
                growth = max(sum(map(size_of, results)) / weight, growth / 2)
                columns, titles = [*part.columns, pa.array(results, made)], [*names, output]
                if score:
                    columns.append(pa.array([score[1](a, b) for a, b in zip(texts, results, strict=True)], pa.float64()))
                    titles.append(score[0])
                yield pa.RecordBatch.from_arrays(columns, names=titles)

    more = [f"`{output}` {kind}"] + ([f"`{score[0]}` double"] if score else [])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields] + more)
    return todo.mapInArrow(run, schema)


def size_of(result) -> int:
    """About the bytes of a service's result: a text, bytes, or a record with a value."""
    value = result.get("value") if isinstance(result, dict) else result
    return 64 + (len(value) if isinstance(value, (str, bytes, bytearray)) else 0)


def class_of(message: str) -> str:
    """The class of an error's message, by the table that the Column expressions use."""
    low = message.lower()
    code = re.search(rf"\b({'|'.join(map(str, CODES['any']))})\b", message)
    return next((name for name, codes, markers in CLASSES if (code and int(code[1]) in codes) or any(m in low for m in markers)), "unknown")


def attempted(call: Callable[[str], object], client: str = "primary", spacing: float = 0.0, wait: Callable[[str, int], float] | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[dict]]:
    """A batch service from one that answers a single text or raises: results with value, error, error_class, attempts.

    An empty answer is an error. Rate limits and temporary errors are tried again, after wait(message, attempt) seconds,
    up to the client's number of attempts; other errors at once end the text, and those of ABORTS the run: what
    follows has no attempts.
    """
    def one(text: str) -> dict:
        for attempt in range(1, ATTEMPTS[client] + 1):
            try:
                value = call(text)
                if value is None or not len(value):
                    raise RuntimeError("empty answer")
                return {"value": value, "error": None, "error_class": None, "attempts": attempt}
            except Exception as error:  # a service may raise anything; its message decides
                message = str(error)
                kind = class_of(message)
                if kind not in RETRIES or attempt == ATTEMPTS[client]:
                    return {"value": None, "error": message, "error_class": kind, "attempts": attempt}
                sleep(wait(message, attempt) if wait else 0.0)
        raise AssertionError("unreachable")

    def begin() -> Callable[[list[str]], list[dict]]:
        """A run: its calls share the spacing, and an abort ends all that follow."""
        asked = aborted = False

        def run(texts: list[str]) -> list[dict]:
            nonlocal asked, aborted
            out: list[dict] = []
            for text in texts:
                if aborted:
                    out.append({"value": None, "error": None, "error_class": None, "attempts": 0})
                    continue
                if asked and spacing:
                    sleep(spacing)
                out.append(one(text))
                asked, aborted = True, out[-1]["error_class"] in ABORTS[client]
            return out

        return run

    def alone(texts: list[str]) -> list[dict]:
        return begin()(texts)

    alone.begin = begin
    return alone


def merged(chunks: DataFrame, merger: Callable[[list[bytes]], bytes] = b"".join, content: str = "content", job: str = "job", no: str = "chunk_no") -> DataFrame:
    """A file per job from its chunks' files in order, by a pluggable merger; MP3 frames need no more than to follow each other."""
    parts = chunks.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(no, content))), lambda x: x[content]).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({job: batch[job], "content": [merger([bytes(x) for x in p]) for p in batch["parts"]]})

    return parts.mapInPandas(run, f"`{job}` {chunks.schema[job].dataType.simpleString()}, content binary")


def listing(models: DataFrame, action: str = "generateContent") -> DataFrame:
    """Names of models that support an action."""
    return models.where(F.array_contains("actions", action)).select("name")
