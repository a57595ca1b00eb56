"""Scoring: add a parsed answer (``result``) to every service row.

Two kinds of scorer share one output contract, a ``result`` column of type
``STRUCT<assessments: ARRAY<STRUCT<component, classification, reasoning>>>``:

* :class:`RuleScorer` -- the offline scorer. Built-in Columns only, so the
  scored plan stays inside whole-stage codegen and never shuffles. With
  ``as_text=True`` it emits the JSON answer a model would send (``raw``) and
  goes through the same parse tail as a model answer.
* :class:`EndpointScorer` -- a model behind an HTTP endpoint, called from
  ``mapInArrow`` once per row, with a bounded number of calls at a time in a
  task. The input is round-robin repartitioned *below* the Python stage, so
  calls fan out over ``partitions`` tasks and a hot key cannot pile up in one.

Model answers must be written before they are used twice (see
``plans.pipelines``): every action on a lazy scored frame calls the model
again.
"""
from __future__ import annotations

import http.client
import json
import threading
import time
import urllib.parse
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..constants import (CLASSES, EMAIL_OPTIONS, FULL_RUN_PARTITIONS, MAX_TEST_PARTITIONS,
                         NOTES_SEPARATOR, SCORING_OPTIONS)
from ..functions import json_text
from ..functions.rules import BALANCED, Thresholds, assessments, with_signals
from ..session import small_methods
from .prompts import prompt_texts

#: What a model must answer: a list of assessments with a fixed class enum.
RESPONSE_FORMAT = {
    "type": "json_schema",
    "json_schema": {
        "name": "assessments",
        "strict": True,
        "schema": {
            "type": "object",
            "required": ["assessments"],
            "properties": {"assessments": {"type": "array", "items": {
                "type": "object",
                "required": ["component", "classification", "reasoning"],
                "properties": {
                    "component": {"type": "string"},
                    "classification": {"type": "string", "enum": list(CLASSES)},
                    "reasoning": {"type": "string"},
                },
            }}},
        },
    },
}


@dataclass
class RuleScorer:
    """Offline scorer over the notes text; ``as_text`` emits the answer as
    JSON text (``raw``) and parses it back."""
    thresholds: Thresholds = BALANCED
    as_text: bool = False

    def raw(self, keys: list[str]) -> Column:
        """The answer text over the columns of ``rules.with_signals``."""
        return F.to_json(F.struct(assessments(keys, self.thresholds).alias("assessments")))


class ClientError(Exception):
    """The endpoint refused the request; the same request would fail again."""


class Throttled(OSError):
    """The endpoint asks for a pause (429, 503): ``after`` seconds, None if it didn't say."""

    def __init__(self, why: str, after: float | None = None):
        super().__init__(why)
        self.after = after


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header: a number, or a date (then from ``now``, epoch seconds)."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


class Pace:
    """Turns of one worker's calls, at least ``gap`` seconds apart, whatever tasks the worker runs one after the other.

    The first turn comes after ``offset``, so that the workers of a stage don't all begin at once."""

    def __init__(self, gap: float, offset: float = 0.0):
        self.lock, self.gap = threading.Lock(), gap
        self.due = time.monotonic() + offset

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.due)
            self.due = at + self.gap
        if at > now:  # a sleep of no time would still hand the interpreter to another thread, at every call
            time.sleep(max(0.0, at - time.monotonic()))

    def hold(self, seconds: float) -> None:
        """No turn before then."""
        with self.lock:
            self.due = max(self.due, time.monotonic() + seconds)


_PACES: dict[tuple, Pace] = {}


def pace(url: str, model: str, per_second: float, slots: int) -> Pace:
    """This worker's turns for an endpoint: its share of the budget. They outlive a task: the next one in this worker waits for them too."""
    key = (url, model, per_second, slots)
    if key not in _PACES:
        task = TaskContext.get()
        gap = slots / per_second
        # The tasks that start together begin one after the other, none before its first turn is due.
        _PACES[key] = Pace(gap, gap * (1 + task.partitionId() % slots) / slots if task else 0.0)
    return _PACES[key]


def task_slots(spark: SparkSession, partitions: int | None = None) -> int:
    """Tasks that can run at a time: executors by cores where the session tells, no more than there are ``partitions``.

    Executors that come and go count by their highest number; without one, every partition counts."""
    def setting(name: str) -> int | None:
        value = spark.conf.get(name, None)
        return int(value) if value and value.isdigit() else None

    cores = (setting("spark.executor.cores") or 1) // (setting("spark.task.cpus") or 1) or 1
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        most = setting("spark.dynamicAllocation.maxExecutors")
        slots = most * cores if most else None
    elif setting("spark.executor.instances"):
        slots = setting("spark.executor.instances") * cores
    else:
        slots = spark.sparkContext.defaultParallelism
    return max(1, min(x for x in (slots, partitions, 1 << 20) if x))


def post_json(url: str, headers: dict, timeout_s: float) -> Callable[[dict], dict]:
    """Sends a body and returns the answer, over one kept connection per thread."""
    at = urllib.parse.urlsplit(url)
    kept = threading.local()

    def send(body: dict) -> dict:
        if getattr(kept, "conn", None) is None:
            kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
            kept.conn = kind(at.netloc, timeout=timeout_s)
        try:
            kept.conn.request("POST", at.path or "/", json.dumps(body).encode(), headers)
            got = kept.conn.getresponse()
            data = got.read()
        except Exception:
            kept.conn.close()
            kept.conn = None
            raise
        if got.status in (429, 503):
            raise Throttled(f"{got.status} {got.reason}", retry_after(got.getheader("Retry-After")))
        if 400 <= got.status < 500 and got.status != 408:
            raise ClientError(f"{got.status} {got.reason}")
        if got.status >= 300:
            raise OSError(f"{got.status} {got.reason}")
        return json.loads(data)

    return send


@dataclass
class EndpointScorer:
    """Chat-completions endpoint (a JSON API over HTTP).

    A picklable factory: ``client()`` runs once per task on the executor and
    returns a :class:`Calls`: ``list[str | None] -> list[(text, error)]``. A
    NULL input is not sent. A failed call gives (NULL, why); refused requests
    (4xx) are not tried again; an endpoint that asks for a pause gets it, and
    the worker's other calls wait too (a pause of more than ``max_pause``
    seconds is a failure). ``concurrency`` calls are open at a time in a task.
    ``per_second`` is the budget of the whole job (0: no limit); a task keeps
    to its share of it, ``client(slots)`` of ``slots`` tasks. ``transport``
    replaces the HTTP call: a picklable function from a body to an answer.
    """
    url: str
    model: str
    prompt: str = ""
    separator: str = NOTES_SEPARATOR
    token: str | None = None
    response_format: dict | None = None
    options: dict = field(default_factory=dict)
    retries: int = 3
    timeout_s: float = 60.0
    concurrency: int = 4
    per_second: float = 0.0
    max_pause: float = 300.0
    transport: Callable[[dict], dict] | None = None

    def body(self, text: str) -> dict:
        out = {"model": self.model,
               "messages": [{"role": "user", "content": self.prompt + self.separator + text}],
               **self.options}
        if self.response_format:
            out["response_format"] = self.response_format
        return out

    def client(self, slots: int = 1) -> Calls:
        headers = {"Content-Type": "application/json"}
        if self.token:
            headers["Authorization"] = f"Bearer {self.token}"
        send = self.transport or post_json(self.url, headers, self.timeout_s)
        turns = pace(self.url, self.model, self.per_second, slots) if self.per_second > 0 else Pace(0.0)

        def one(text: str | None) -> tuple[str | None, str | None]:
            if text is None:
                return None, None
            why = "no try"
            for attempt in range(self.retries):
                try:
                    turns.wait()
                    return send(self.body(text))["choices"][0]["message"]["content"], None
                except ClientError as e:
                    return None, f"refused: {e}"
                except Throttled as e:
                    why = f"{type(e).__name__}: {e}"
                    if e.after is not None and e.after > self.max_pause:
                        break
                    turns.hold(2 ** attempt if e.after is None else e.after)
                except Exception as e:  # noqa: BLE001 - tried again, then reported
                    why = f"{type(e).__name__}: {e}"
                    if attempt + 1 < self.retries:
                        time.sleep(2 ** attempt)
            return None, f"failed: {why}"

        return Calls(one, max(1, self.concurrency))


class Calls:
    """A task's calls, some at a time; ``close`` ends its threads.

    Each thread takes the next row of the batch when its last call is done: a
    batch costs one future a thread, not one a row."""

    def __init__(self, one: Callable, concurrency: int):
        self.one, self.concurrency, self.pool = one, concurrency, ThreadPoolExecutor(concurrency)
        self.open: deque[int] = deque()

    def __call__(self, batch: list[str | None]) -> list[tuple[str | None, str | None]]:
        out: list = [None] * len(batch)
        self.open.extend(range(len(batch)))

        def work() -> None:
            while True:
                try:
                    k = self.open.popleft()
                except IndexError:
                    return
                out[k] = self.one(batch[k])

        threads = [self.pool.submit(work) for _ in range(min(self.concurrency, len(batch)))]
        try:
            for t in threads:
                t.result()
        except BaseException:
            self.open.clear()  # nothing more is sent
            raise
        return out

    def close(self) -> None:
        self.open.clear()
        self.pool.shutdown(wait=False, cancel_futures=True)


def scoring_options(n_keys: int, tokens_per_key: int = SCORING_OPTIONS["max_tokens"]) -> dict:
    """Options of a scoring call: room for one reasoning per component."""
    return {**SCORING_OPTIONS, "max_tokens": max(1, n_keys) * tokens_per_key}


def config_scorer(spark: SparkSession, config, url: str, **client) -> EndpointScorer:
    """The scorer of a configuration: its model, its full prompt, the answer
    contract, and a token limit that grows with its components."""
    return EndpointScorer(
        url=url, model=config.model_endpoint,
        prompt=prompt_texts(spark, config.components, config.prompt_text),
        response_format=RESPONSE_FORMAT, options=scoring_options(len(config.keys)), **client)


def text_drafter(url: str, model: str, **client) -> EndpointScorer:
    """Free-text mode: the input is the whole prompt."""
    return EndpointScorer(url=url, model=model, prompt="", separator="",
                          options=dict(EMAIL_OPTIONS), **client)


@dataclass
class CannedScorer:
    """Offline stand-in for an endpoint: a fixed answer per notes text
    (``default`` otherwise). ``calls`` is an optional accumulator counting
    rows sent, to check that each row is scored exactly once."""
    answers: dict
    default: str | None = None
    calls: object = None

    def body(self, text: str) -> dict:
        return {"canned": sorted(self.answers.items()), "default": self.default, "text": text}

    def client(self) -> Callable[[list[str | None]], list[tuple[str | None, str | None]]]:
        answers, default, calls = self.answers, self.default, self.calls

        def call(batch: list[str | None]) -> list[tuple[str | None, str | None]]:
            if calls is not None:
                calls.add(len(batch))
            return [(answers.get(n, default), None) for n in batch]
        return call


def full_run_partitions(spark: SparkSession) -> int:
    """Fan-out for scoring a whole table: the session's shuffle partitions,
    which grow with the data, and no fewer than 32. Starts no job."""
    return max(FULL_RUN_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sample_partitions(limit: int, most: int = MAX_TEST_PARTITIONS) -> int:
    """Fan-out for a sample of ``limit`` rows: one row per task, ``most`` at most."""
    return max(1, min(int(limit), most))


def score_python(df: DataFrame, factory: Callable[[], Callable[[list], list]],
                 notes_col: str = "service_performed", partitions: int | None = None,
                 out_col: str = "raw", error_col: str | None = None, per_second: float = 0.0) -> DataFrame:
    """Call a Python scorer over ``notes_col``; adds a string column, and with
    ``error_col`` why a call gave none. All other columns pass untouched.

    With a budget of calls ``per_second`` the factory is told how many tasks
    can run at a time, among which the scorer divides it.

    The exchange sits below ``mapInArrow`` (not above it, as a SQL
    REPARTITION hint on the projection would place it)."""
    if partitions:
        df = df.repartition(int(partitions))
    added = [out_col, *([error_col] if error_col else [])]
    out_schema = T.StructType(df.schema.fields + [T.StructField(c, T.StringType()) for c in added])
    shared = {"slots": task_slots(df.sparkSession, partitions)} if per_second > 0 else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory(**shared)
        try:
            for batch in batches:
                notes = batch.column(batch.schema.get_field_index(notes_col)).to_pylist()
                got = call(notes)
                new = [pa.array([g[k] for g in got], pa.string()) for k in range(len(added))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])
        finally:
            getattr(call, "close", lambda: None)()

    return df.mapInArrow(run, out_schema)


def parsed(df: DataFrame, clean: bool = False, result_col: str = "result", raw_col: str = "raw") -> DataFrame:
    """Add the parsed answer of a text column (bad text gives a NULL list)."""
    raw = json_text.strip_fence(F.col(raw_col)) if clean else F.col(raw_col)
    return df.withColumn(result_col, F.from_json(raw, schemas.RESPONSE))


def score(df: DataFrame, keys: list[str], scorer=None, notes_col: str = "service_performed",
          partitions: int | None = None, clean: bool = False, result_col: str = "result",
          raw_col: str = "raw", error_col: str | None = None) -> DataFrame:
    """Add ``result`` (parsed answer) to every row of ``df``.

    ``keys`` are the component keys the answer must cover, in config order.
    ``clean`` strips a markdown fence before parsing (off by default: the
    plain parser loses fenced answers, and that loss is reported, not hidden).
    """
    scorer = scorer or RuleScorer()
    if isinstance(scorer, RuleScorer):
        small_methods(df.sparkSession)
        base, added = with_signals(df, keys, notes_col)
        if not scorer.as_text:
            out = base.withColumn(
                result_col, F.struct(assessments(keys, scorer.thresholds).alias("assessments")))
            return out.drop(*added)
        out = base.withColumn(raw_col, scorer.raw(keys)).drop(*added)
    else:
        out = score_python(df, scorer.client, notes_col, partitions, out_col=raw_col, error_col=error_col,
                           per_second=getattr(scorer, "per_second", 0.0))
    return parsed(out, clean, result_col, raw_col)
