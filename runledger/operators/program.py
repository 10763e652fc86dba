"""External programs and gang-started functions over partitions."""

from __future__ import annotations

import os
import subprocess
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def run_program(
    rows: DataFrame, command: list[str], column: str, env: dict[str, str] | None = None,
    timeout_s: float | None = None, allowed: tuple[int, ...] = (0,), may_stop_early: bool = False,
) -> DataFrame:
    """Lines a program writes when each partition's ``column`` is fed to it line by line.

    One process per partition, streamed both ways. It is killed at the timeout and whenever its task ends. An
    exit code that is not allowed, rows that cannot be read, and input that the program leaves unread (unless it
    ``may_stop_early``) fail the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proc = subprocess.Popen(
            command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8",
            env={**os.environ, **(env or {})},
        )
        failures: list[BaseException] = []

        def feed() -> None:
            try:
                for batch in batches:
                    proc.stdin.writelines(f"{v}\n" for v in batch[column])
                proc.stdin.close()
            except BrokenPipeError as e:
                if not may_stop_early:
                    failures.append(e)
            except BaseException as e:  # raised again by the task
                failures.append(e)
                proc.kill()

        feeder = threading.Thread(target=feed, daemon=True)
        clock = threading.Timer(timeout_s, proc.kill) if timeout_s else None
        try:
            feeder.start()
            if clock:
                clock.start()
            lines: list[str] = []
            for line in proc.stdout:
                lines.append(line.rstrip("\n"))
                if len(lines) == 10_000:
                    yield pd.DataFrame({"line": lines})
                    lines = []
            if lines:
                yield pd.DataFrame({"line": lines})
            code = proc.wait()
            feeder.join()
            stopped = [e for e in failures if not isinstance(e, BrokenPipeError)]
            if stopped:
                raise stopped[0]
            if code not in allowed:
                raise RuntimeError(f"{command[0]} ended with exit code {code}")
            if failures:
                raise RuntimeError(f"{command[0]} ended before it had read all its input")
        finally:
            if clock:
                clock.cancel()
            if proc.poll() is None:
                proc.kill()
                proc.wait()

    return rows.select(column).mapInPandas(run, "line string")


def gang_run(
    rows: DataFrame, members: int,
    work: Callable[[Iterator[pd.DataFrame], int, list[str]], Iterator[pd.DataFrame]], schema: str,
) -> DataFrame:
    """Run ``work(batches, rank, addresses)`` on ``members`` partitions that all start together.

    Barrier mode: no member starts before all have a slot, and each gets every address.
    """

    def member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        gang = BarrierTaskContext.get()
        addresses = gang.allGather(gang.getTaskInfos()[gang.partitionId()].address)
        yield from work(batches, gang.partitionId(), addresses)

    return rows.repartition(members).mapInPandas(member, schema, barrier=True)
