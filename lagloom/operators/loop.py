"""The hypothesis loop: generate, validate, run with repair, evaluate, record. Language models are callables."""

from __future__ import annotations

import json
import os
import random
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lagloom.functions import fixed
from lagloom.operators.audit import first_r

#: Spark's own error classes, by the classes of the log.
SPARK_CLASSES = {
    "schema_column": ["UNRESOLVED_COLUMN", "FIELD_NOT_FOUND"],
    "window_in_where": ["WINDOW function is not allowed in", "window functions inside WHERE"],
    "lag_scalar": ["requires an OVER clause"],
    "type_arithmetic": ["DATATYPE_MISMATCH"],
    "type_cast": ["CAST_INVALID_INPUT", "CANNOT_PARSE"],
    "catalog": ["UNRESOLVED_ROUTINE", "TABLE_OR_VIEW_NOT_FOUND"],
    "syntax": ["PARSE_SYNTAX_ERROR"],
}


def classify_error(message: str) -> str:
    """The class of an error message, of the log's taxonomy or of Spark's."""
    low = message.lower()
    for table in (fixed.ERROR_CLASSES, SPARK_CLASSES):
        for name, parts in table.items():
            if any(p.lower() in low for p in parts):
                return name
    return "unknown"


def fingerprint(hypothesis: str, chars: int = 55) -> str:
    """As functions.text.hypothesis_fingerprint, of one string."""
    return re.sub(r"\d+", "N", hypothesis[:chars].lower().strip())


def json_block(reply: str) -> dict:
    """The outermost JSON object in a model's reply; empty if there is none."""
    m = re.search(r"\{.*\}", reply, re.S)
    try:
        return json.loads(m[0]) if m else {}
    except ValueError:
        return {}


def unfenced(sql: str) -> str:
    return re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", sql).strip()


def spark_runner(spark: SparkSession, most: int = 1000) -> Callable[[str], tuple[list[str], list[tuple]]]:
    """Runs a statement to its rows. Spark is lazy, so only the action shows errors of execution.

    A result of more than ``most`` rows is an error, not a cut one: a finding is an aggregate, and n is one of its
    columns.
    """

    def run(sql: str) -> tuple[list[str], list[tuple]]:
        df = spark.sql(sql)
        rows = [tuple(r) for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"the statement gives more than {most} rows: aggregate them")
        return df.columns, rows

    return run


def bound_runner(spark: SparkSession, **values: object) -> Callable[[str], list[tuple]]:
    """Runs statements with named parameters (``:name``), bound by Spark and never pasted into the text."""
    return lambda sql: [tuple(r) for r in spark.sql(sql, args=values).collect()]


@dataclass
class Attempt:
    sql: str
    error: str | None = None
    error_type: str | None = None


def execute_with_repair(run: Callable, sql: str, repair: Callable[[str, str, str], str] | None, max_attempts: int = 3) -> tuple[list[str], list[tuple], list[Attempt]]:
    """(columns, rows, attempts); raises the last error when no attempt succeeds."""
    attempts: list[Attempt] = []
    while True:
        try:
            columns, rows = run(sql)
            attempts.append(Attempt(sql))
            return columns, rows, attempts
        except Exception as e:
            attempts.append(Attempt(sql, str(e), classify_error(str(e))))
            if repair is None or len(attempts) >= max_attempts:
                raise
            sql = unfenced(repair(sql, str(e), attempts[-1].error_type))


def evaluate(r: float | None, n: int) -> tuple[bool | None, int]:
    """(confirmed, score) by the size of r and of the sample; few rows never confirm."""
    if r is None:
        return None, 0
    score = min(100, round(100 * abs(r)))
    if n < 30:
        return None, min(score, 40)
    return (True if abs(r) >= 0.35 else None if abs(r) >= 0.20 else False), score


def sample_size(columns: list[str], rows: list[tuple]) -> int:
    """n of a result: its column n, or else the first whole number above 1; 0 if there is none."""
    named = [row[columns.index("n")] for row in rows] if "n" in columns else []
    return next((v for v in [*named, *(v for row in rows for v in row)] if isinstance(v, int) and not isinstance(v, bool) and v > 1), 0)


@dataclass
class Memory:
    """Files that outlive a run: principles.md, knowledge.md, regime.json, blacklist.json, patterns.md; a journal."""

    folder: str

    def known(self) -> dict[str, str]:
        """What a generator is told, by name; missing files are empty."""
        out = {}
        for name in ("principles.md", "knowledge.md", "regime.json", "patterns.md"):
            path = os.path.join(self.folder, name)
            out[name.split(".")[0]] = open(path, encoding="utf-8").read().strip() if os.path.exists(path) else ""
        return out

    def blacklist(self) -> set[str]:
        path = os.path.join(self.folder, "blacklist.json")
        return set(json.load(open(path, encoding="utf-8"))) if os.path.exists(path) else set()

    def record(self, record: dict) -> None:
        """One line of the journal; the statement of a confirmed finding also goes to the patterns."""
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, "journal.jsonl"), "a", encoding="utf-8") as f:
            f.write(json.dumps({k: v for k, v in record.items() if k != "attempts"}, ensure_ascii=False, default=str) + "\n")
        if record["confirmed"] is True:
            with open(os.path.join(self.folder, "patterns.md"), "a", encoding="utf-8") as f:
                f.write(f"- {record['score']}: {record['hypothesis']}: `{' '.join(record['sql'].split())}`\n")

    def learn(self, records: list[dict], synthesize: Callable[[str, list[dict]], str] | None = None) -> bool:
        """Knowledge from the confirmed findings; ``synthesize`` joins old and new, by default they are listed."""
        confirmed = [r for r in records if r["confirmed"] is True]
        if not confirmed:
            return False
        old = self.known()["knowledge"]
        listed = "\n".join(f"- [{r['score']}] {r['hypothesis']}" for r in confirmed)
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, "knowledge.md"), "w", encoding="utf-8") as f:
            f.write((synthesize(old, confirmed) if synthesize else f"{old}\n{listed}".strip()) + "\n")
        return True


@dataclass
class Loop:
    """Iterations over lags and topics.

    ``generate(context, lag, known)`` gives a reply with a JSON object of hypothesis, sql and next_hypothesis. The
    context of an iteration is the one before's next hypothesis, but for these jumps to a topic: after every
    ``reflect_every`` iterations the next topic in turn; a hypothesis or context that has come up ``repeat_limit`` times
    (it joins the blacklist) or is on the blacklist, and one in ``1 / jump`` of the rest, a topic drawn at random.
    """

    generate: Callable[[str, int, dict], str]
    run: Callable
    repair: Callable | None = None
    reflect: Callable[[list[dict]], str] | None = None
    lags: list[int] = field(default_factory=lambda: list(fixed.LAGS))
    topics: list[str] = field(default_factory=lambda: list(fixed.TOPICS))
    blacklist: set[str] = field(default_factory=set)
    repeat_limit: int = 3
    reflect_every: int = 5
    jump: float = 0.25
    max_seconds: float | None = None
    memory: Memory | None = None
    seed: int | None = None
    clock: Callable[[], float] = time.monotonic

    def __call__(self, iterations: int, hint: str = "") -> list[dict]:
        records: list[dict] = []
        seen: Counter[str] = Counter()
        rng, began, context = random.Random(self.seed), self.clock(), hint
        self.blacklist |= self.memory.blacklist() if self.memory else set()

        def trapped(key: str) -> bool:
            """Whether a fingerprint has come up too often; from then on it is blacklisted."""
            if key and (key in self.blacklist or seen[key] >= self.repeat_limit):
                self.blacklist.add(key)
                return True
            return False

        for i in range(1, iterations + 1):
            if self.max_seconds is not None and self.clock() - began >= self.max_seconds:
                break
            key = fingerprint(context)
            seen[key] += key not in self.blacklist
            if trapped(key):
                context = rng.choice(self.topics)
            record = self._iterate(i, context, self.memory.known() if self.memory else {})
            key = fingerprint(record["hypothesis"])
            seen[key] += 1
            record["blocked"] = trapped(key)
            records.append(record)
            if self.memory:
                self.memory.record(record)
            if i % self.reflect_every == 0:
                if self.reflect:
                    record["reflection"] = self.reflect(records[-self.reflect_every :])
                context, record["jump"] = self.topics[(i // self.reflect_every - 1) % len(self.topics)], "topic"
            elif record["blocked"]:
                context, record["jump"] = rng.choice(self.topics), "repeat"
            elif rng.random() < self.jump:
                context, record["jump"] = rng.choice(self.topics), "random"
            else:
                context = record["next_hypothesis"]
        if self.memory:
            self.memory.learn(records)
        return records

    def _iterate(self, i: int, context: str, known: dict) -> dict:
        lag = self.lags[(i - 1) % len(self.lags)]
        record = {"iteration": i, "lag": lag, "context": context, "hypothesis": "", "next_hypothesis": "", "sql": "", "confirmed": None, "score": 0, "attempts": [], "jump": None}
        try:
            made = json_block(self.generate(context, lag, known))
            record |= {k: str(made.get(k) or "") for k in ("hypothesis", "next_hypothesis", "sql")}
            columns, rows, record["attempts"] = execute_with_repair(self.run, unfenced(record["sql"]), self.repair)
            record["confirmed"], record["score"] = evaluate(first_r(rows), sample_size(columns, rows))
        except Exception as e:
            record["error"] = str(e)
        return record


def supervise(start: Callable[[float], int], seconds: float, delay: float = 10, least: float = 60, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, then: Callable[[], None] | None = None) -> int:
    """Run ``start(seconds left)`` again whenever it ends, until the time is up; then ``then`` (an audit). Gives the runs.

    ``start`` blocks until its run has ended, as subprocess.call does, and is told how long it may take. A run that ends
    with less than ``least`` seconds left is the last.
    """
    end, runs = clock() + seconds, 0
    while (left := end - clock()) > 0 and (runs == 0 or left > least):
        start(max(left, least) if runs == 0 else left)
        runs += 1
        sleep(min(delay, max(0.0, end - clock())))
    if then:
        then()
    return runs
