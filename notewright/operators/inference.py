"""Batch inference as a resumable table of attempts, through a client that the caller supplies.

A client is made once a worker by `connect`, a function that must be picklable; its method
`async complete(server, prompt, max_tokens) -> str` raises ConnectionError if a server can't be
reached and any other error if a request fails. Results stay on their row; an error becomes that
row's status, so no task fails over one. Calls are at least once: a lost task asks again, so
speculation should be off, and results are written before anything reads them twice.
"""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.functions import budgets
from notewright.functions.jsontext import json_valid
from notewright.operators.prepare import with_defaults
from notewright.schemas import inference_state
from notewright.sources.shared import place, written

#: Attempts of one request over different servers, and requests in flight a task.
ATTEMPTS, IN_FLIGHT = 3, 32
#: About so many bytes of prompts go to a task of a round; larger tables take further waves of tasks, dealt in blocks of rows.
WAVE_BYTES, BLOCK_ROWS = 32 << 20, 1024


class ModelClient(Protocol):
    async def complete(self, server: str, prompt: str, max_tokens: int) -> str: ...


class ServerPool:
    """Servers in turn; one that can't be reached is left out from then on, within this worker."""

    def __init__(self, client: ModelClient, servers: Sequence[str], first: int = 0):
        self.client, self.servers, self.turn, self.dead = client, list(servers), first, set()

    def _next(self) -> str | None:
        for _ in self.servers:
            server = self.servers[self.turn % len(self.servers)]
            self.turn += 1
            if server not in self.dead:
                return server
        return None

    async def call(self, prompt: str, max_tokens: int) -> tuple[str | None, str | None]:
        """(output, error), one of which is null."""
        last: Exception | None = None
        for _ in range(ATTEMPTS):
            server = self._next()
            if server is None:
                return None, "all servers are unreachable"
            try:
                return await self.client.complete(server, prompt, max_tokens), None
            except ConnectionError as problem:
                last = problem
                self.dead.add(server)
            except Exception as problem:  # noqa: BLE001  whatever a client raises becomes the row's error
                return None, str(problem) or type(problem).__name__
        return None, f"all attempts failed: {last}"


def infer(df: DataFrame, connect: Callable[[], ModelClient], servers: Sequence[str], prompt: str, budget: str, out: str, in_flight: int = IN_FLIGHT) -> DataFrame:
    """df with <out>, <out>_status and <out>_error: each prompt's completion within its budget.

    How many requests run at once is tasks at work times in_flight. A null prompt is an error.
    """
    added = [out, f"{out}_status", f"{out}_error"]
    kept = [f for f in df.schema.fields if f.name not in added]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(n, T.StringType()) for n in added])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        pool = ServerPool(connect(), servers, context.partitionId() if context else 0)

        async def all_of(prompts, most):
            gate = asyncio.Semaphore(in_flight)

            async def one(text, tokens):
                if text is None:
                    return None, "no prompt"
                async with gate:
                    return await pool.call(text, int(tokens))

            return await asyncio.gather(*map(one, prompts, most))

        for batch in batches:
            column = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            done = asyncio.run(all_of(column(prompt).to_pylist(), column(budget).to_pylist()))
            outputs, errors = [o for o, _ in done], [e for _, e in done]
            status = ["success" if e is None else "error" for e in errors]
            yield pa.RecordBatch.from_arrays([column(n) for n in names] + [pa.array(x, pa.string()) for x in (outputs, status, errors)], names=names + added)

    return df.mapInArrow(run, schema)


def infer_in_rounds(
    df: DataFrame, connect: Callable[[], ModelClient], servers: Sequence[str], key: str, prompt: str, budget: str, out: str, attempts: int = ATTEMPTS, in_flight: int = IN_FLIGHT, most_in_flight: int = 256
) -> DataFrame:
    """infer() with the health of servers known to all tasks and a cap on requests in flight over the whole cluster.

    A round puts every open row to one living server, chosen by its key; a server that can't be
    reached is asked no more by its task, and by none in later rounds. Rows that were not answered go
    on to the next round, at most `attempts` of them. Each round is written before the next one
    starts, so a lost executor repeats only requests of its own tasks. As many tasks run at once as
    share out most_in_flight, whatever the cluster; a round of more than WAVE_BYTES for each of them is
    dealt in blocks of rows to waves of so many tasks, one wave after another. Adds <out>, <out>_status, <out>_error and <out>_attempts.
    """
    added = T._parse_datatype_string(f"`{out}` string, `{out}_status` string, `{out}_error` string, `{out}_attempts` int")
    kept = [f for f in df.schema.fields if f.name not in added.names]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *added.fields, T.StructField("_server", T.StringType()), T.StructField("_down", T.BooleanType())])

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        client, dead = connect(), set()

        async def one(gate, text, tokens, server):
            """(output, error, whether it was asked, whether the server is down)"""
            if text is None:
                return None, "no prompt", 0, False
            async with gate:
                if server in dead:
                    return None, server, 0, True
                try:
                    return await client.complete(server, text, int(tokens)), None, 1, False
                except ConnectionError as problem:
                    dead.add(server)
                    return None, f"all attempts failed: {problem}", 1, True
                except Exception as problem:  # noqa: BLE001  whatever a client raises becomes the row's error
                    return None, str(problem) or type(problem).__name__, 1, False

        async def all_of(*columns):
            gate = asyncio.Semaphore(in_flight)
            return await asyncio.gather(*[one(gate, *row) for row in zip(*columns, strict=True)])

        for batch in batches:
            column = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            done = asyncio.run(all_of(*[column(n).to_pylist() for n in (prompt, budget, "_server")]))
            asked = [a + d[2] for a, d in zip(column(f"{out}_attempts").to_pylist(), done, strict=True)]
            new = [pa.array([d[0] for d in done], pa.string()), pa.array(["success" if d[1] is None else "error" for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array(asked, pa.int32())]
            yield pa.RecordBatch.from_arrays([column(n) for n in names] + new + [column("_server"), pa.array([d[3] for d in done], pa.bool_())], names=schema.names)

    open_, settled, dead = df.select(*names, F.lit(0).alias(f"{out}_attempts")), [], set()
    for n in range(attempts):
        alive = [s for s in servers if s not in dead]
        if not alive:
            break
        server = F.element_at(F.array(*map(F.lit, alive)), (F.pmod(F.xxhash64(key, F.lit(n)), F.lit(len(alive))) + 1).cast("int"))
        asked = _in_waves(open_.withColumn("_server", server), prompt, max(1, most_in_flight // in_flight), ask, schema)
        settled.append(asked.where("NOT _down"))
        down = asked.where("_down")
        dead |= {r[0] for r in down.select("_server").distinct().collect()}  # servers are few
        open_ = down.select(*names, f"{out}_attempts")
        if not dead or open_.isEmpty():
            open_ = None
            break
    columns = [*names, *added.names]
    if open_ is not None:
        failed = F.lit("all servers are unreachable" if len(dead) == len(set(servers)) else "all attempts failed")
        settled.append(open_.select(*names, F.lit(None).cast("string").alias(out), F.lit("error").alias(f"{out}_status"), failed.alias(f"{out}_error"), f"{out}_attempts"))
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in settled])


def _in_waves(rows: DataFrame, prompt: str, tasks: int, ask: Callable[[Iterator], Iterator], schema: T.StructType) -> DataFrame:
    """rows through ask, written; at most `tasks` tasks run at once, and what one reads is bounded."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length(prompt)), F.lit(0))).first()[0]
    waves = -(-size // (tasks * WAVE_BYTES))
    if waves <= 1:
        return written(rows.coalesce(tasks).mapInArrow(ask, schema), "asked")
    dealt, asked = place(spark, "waves"), place(spark, "asked")
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS.bit_length() - 1) + F.spark_partition_id()  # no shuffle: each task deals out its own rows
    rows.withColumn("_wave", F.pmod(block, F.lit(waves)).cast("int")).write.partitionBy("_wave").parquet(dealt)
    table = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_wave", T.IntegerType())])).parquet(dealt)
    for wave in range(waves):
        table.where(F.col("_wave") == wave).drop("_wave").coalesce(tasks).mapInArrow(ask, schema).write.mode("append").parquet(asked)
    return spark.read.schema(schema).parquet(asked)


def check_key(df: DataFrame, key: str) -> None:
    """Raises ValueError if key is null or repeated in df: results could not be told apart."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).head(1)
    if bad:
        raise ValueError(f"{key} is no key: {bad[0][0]} occurs {bad[0][1]} times")


def resume(df: DataFrame, previous: DataFrame, key: str, out: str, valid: str, only_valid: bool = True) -> DataFrame:
    """df with the previous results of rows that are valid there, or of all, and the previous budgets of all."""
    state = inference_state(out, valid)
    tokens = f"{out}_max_tokens"
    old = previous.select(key, F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in state])
    joined = with_defaults(df, state, unless=out).join(old, key, "left")
    take = F.coalesce(F.col(f"_{valid}") if only_valid else F.col("_known"), F.lit(False))
    taken = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in state}
    taken[tokens] = F.when(F.col("_known"), F.col(f"_{tokens}")).otherwise(F.col(tokens))
    return joined.withColumns(taken).drop("_known", *[f"_{c}" for c in state])


def attempts(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of attempts, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest(table: DataFrame, key: str, out: str, valid: str) -> DataFrame:
    """One row a key: a valid result if there is one, else the last; with the last budget."""
    result = F.struct(*[F.col(c) for c in inference_state(out, valid) if c != f"{out}_max_tokens"])
    found = table.groupBy(key).agg(F.max_by(result, F.struct(valid, "attempt")).alias("_r"), F.max_by(f"{out}_max_tokens", "attempt").alias(f"{out}_max_tokens"))
    return found.select(key, "_r.*", f"{out}_max_tokens")


def run_attempt(
    df: DataFrame,
    path: str,
    connect: Callable[[], ModelClient],
    servers: Sequence[str],
    key: str,
    prompt: str = "prompt",
    out: str = "concepts",
    valid: str = "valid_output",
    next_budget: Callable[[Column, Column], Column] = lambda last, _: budgets.doubled(last),
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Ask for every row that has no valid output yet, add an attempt to the table at path, and
    return df with all results so far. A second run asks for invalid rows alone."""
    spark, tokens = df.sparkSession, f"{out}_max_tokens"
    check_key(df, key)
    before = attempts(spark, path)
    state = with_defaults(df, inference_state(out, valid), unless=out) if before is None else resume(df, latest(before, key, out, valid), key, out, valid)
    todo = state.where(~F.col(valid)).select(key, prompt, next_budget(F.col(tokens), F.col(prompt)).alias(tokens))
    if not todo.isEmpty():
        number = 1 if before is None else before.agg(F.max("attempt")).first()[0] + 1
        done = infer(todo, connect, servers, prompt, tokens, out, in_flight)
        done.withColumn(valid, json_valid(F.col(out))).select(key, *inference_state(out, valid)).write.parquet(f"{path}/attempt={number}")
    after = attempts(spark, path)
    return state if after is None else resume(df, latest(after, key, out, valid), key, out, valid, only_valid=False)


def file_report(state: DataFrame, file: str, out: str = "concepts") -> DataFrame:
    """Per file: rows, successes and errors, by status (a success need not be valid JSON)."""
    is_ = lambda s: F.count_if(F.coalesce(F.col(f"{out}_status") == s, F.lit(False)))
    return state.groupBy(file).agg(F.count(F.lit(1)).alias("total"), is_("success").alias("success"), is_("error").alias("errors"))


def totals(report: DataFrame) -> DataFrame:
    """One row over all files."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "success", "errors")]
    return report.agg(F.count(F.lit(1)).alias("n_files"), *sums)


def failures(report: DataFrame, file: str, most: int = 5) -> DataFrame:
    """The first files, by name, in which nothing succeeded: a report, `most` rows at most."""
    return report.where("total > 0 AND success = 0").orderBy(file).limit(most)
