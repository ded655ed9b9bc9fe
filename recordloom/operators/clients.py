"""Calls of injected functions for each row, with their errors as rows, and programs run in child processes."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Limits of a child process (seconds, bytes, files).
CPU_SECONDS, MEMORY, FILE_BYTES, OPEN_FILES = 10, 1 << 30, 10 << 20, 64


def call_each(rows: DataFrame, row_id: str, request: str, make_client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``row_id, status, response, error`` of a function that is made once per task and called for each request.

    Parallelism is that of the partitions; a call that raises gives a row of status error, and the others go on.
    """
    kind = rows.schema[row_id].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            out = []
            for key, text in zip(pdf[row_id], pdf[request]):
                try:
                    out.append((key, "ok", client(text), None))
                except Exception as e:
                    out.append((key, "error", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[row_id, "status", "response", "error"])

    return rows.select(row_id, request).mapInPandas(work, f"{row_id} {kind}, status string, response string, error string")


def _limits() -> None:
    import resource

    for what, value in ((resource.RLIMIT_CPU, CPU_SECONDS), (resource.RLIMIT_AS, MEMORY), (resource.RLIMIT_FSIZE, FILE_BYTES), (resource.RLIMIT_NOFILE, OPEN_FILES)):
        resource.setrlimit(what, (value, value))


#: What the end of a child process means, by the name of the exception.
CATEGORIES = {
    "SyntaxError": "syntax_error", "IndentationError": "syntax_error", "ImportError": "import_error",
    "ModuleNotFoundError": "import_error", "AssertionError": "assertion_failure",
}


def run_program(source: str, tests: str, timeout: float = 10.0) -> str:
    """Category of a program with its tests in an isolated interpreter of its own folder, with limits."""
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run(
                [sys.executable, "-I", "-c", f"{source}\n{tests}\n"], cwd=folder, env={"PATH": "/usr/bin:/bin"},
                capture_output=True, text=True, timeout=timeout, preexec_fn=_limits,
            )
        except subprocess.TimeoutExpired:
            return "timeout"
    if not done.returncode:
        return "passed"
    name = (done.stderr.strip().split("\n") or [""])[-1].split(":")[0].strip()
    return CATEGORIES.get(name, "runtime_error")


def verify(rows: DataFrame, row_id: str, source: str, tests: str, timeout: float = 10.0) -> DataFrame:
    """``row_id, failure_category`` of each program; a null program is an extraction error."""
    kind = rows.schema[row_id].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            categories = ["extraction_error" if s is None else run_program(s, t or "", timeout) for s, t in zip(pdf[source], pdf[tests])]
            yield pd.DataFrame({row_id: pdf[row_id], "failure_category": categories})

    return rows.select(row_id, source, tests).mapInPandas(work, f"{row_id} {kind}, failure_category string")
