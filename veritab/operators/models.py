"""Model stages as pluggable batch functions: neural models enter by name, never by import."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators.checkpoints import cut

#: A factory returns a function from a list of conversations to a list of responses; it runs once a worker.
ADAPTERS: dict[str, Callable[[], Callable[[list], list]]] = {}


def register(name: str, factory: Callable[[], Callable[[list], list]]) -> None:
    """Make a model available under a part of its name."""
    ADAPTERS[name] = factory


def adapter(name: str) -> Callable[[], Callable[[list], list]]:
    """The adapter whose key the model's name holds, the longest of several."""
    fits = sorted((k for k in ADAPTERS if k in name.lower()), key=len)
    if not fits:
        raise ValueError(f"no adapter for {name}")
    return ADAPTERS[fits[-1]]


class Failed(Exception):
    """What a model raised in its own process, or how that ended: ``kind`` is the error's name."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(text)
        self.kind = kind


def _called(model: Callable[[list], list], prompts: list, timeout: float | None) -> list:
    """A model's answers; an error where they take longer than ``timeout`` seconds.

    With a limit each call runs in a process forked for it, which is killed when the limit is reached, so hung calls don't pile up in a worker. What such
    a call changes in the model is lost with its process.
    """
    if timeout is None:
        return list(model(prompts))
    import multiprocessing

    context = multiprocessing.get_context("fork")
    ours, theirs = context.Pipe(duplex=False)

    def call() -> None:
        ours.close()
        try:
            told = (list(model(prompts)), None, "")
        except BaseException as e:  # whatever a model raises
            told = (None, type(e).__name__, str(e))
        theirs.send(told)

    process = context.Process(target=call, daemon=True)
    process.start()
    theirs.close()
    try:
        if not ours.poll(timeout):
            raise TimeoutError(f"no answer within {timeout} seconds")
        answers, kind, text = ours.recv()
    except EOFError:
        answers, kind, text = None, "ProcessEnded", "the call's process ended without an answer"
    finally:
        process.kill()
        process.join()
        ours.close()
    if kind is not None:
        raise Failed(kind, text)
    return answers


def generated(df: DataFrame, factory: Callable, prompt: str, output: str = "response", batch: int = 64, retries: int = 0, timeout: float | None = None, reason: str | None = None) -> DataFrame:
    """``df`` with a model's answer to each prompt, in batches.

    A batch that fails, gives another number of answers or takes longer than ``timeout`` seconds is tried again; one that keeps failing gives nulls, and ``reason``, if
    a column is named, has the kind of the last error.
    """
    columns = df.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in pdfs:
            out: list = []
            why: list = []
            for i in range(0, len(pdf), batch):
                own = pdf[prompt].iloc[i : i + batch].tolist()
                answers, error = [None] * len(own), None
                for _ in range(retries + 1):
                    try:
                        answers = _called(model, own, timeout)
                        if len(answers) != len(own):
                            raise ValueError("another number of answers")
                        error = None
                        break
                    except Exception as e:  # whatever a model raises
                        answers, error = [None] * len(own), getattr(e, "kind", type(e).__name__)
                out += answers
                why += [error] * len(own)
            pdf = pdf.assign(**{output: out})
            yield (pdf.assign(**{reason: why}) if reason else pdf)[[*columns, output, *([reason] if reason else [])]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{output}` string" + (f", `{reason}` string" if reason else ""))


def encoded(df: DataFrame, factory: Callable, texts: str, output: str = "vectors", chunk: int = 256) -> DataFrame:
    """``df`` with unit vectors of an array of texts each, encoded in chunks that go over rows."""
    columns = df.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = factory()
        for pdf in pdfs:
            flat = [t for own in pdf[texts] for t in own]
            parts = [np.asarray(model(flat[i : i + chunk]), np.float64) for i in range(0, len(flat), chunk)]
            every = np.concatenate(parts) if parts else np.zeros((0, 1))
            every = every / np.maximum(np.linalg.norm(every, axis=1, keepdims=True), 1e-300)
            ends = np.cumsum([len(own) for own in pdf[texts]])
            yield pdf.assign(**{output: [every[e - len(own) : e].tolist() for e, own in zip(ends, pdf[texts], strict=True)]})[[*columns, output]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{output}` array<array<double>>")


def with_retries(df: DataFrame, factory: Callable, prompt: str, valid, key: str, rounds: int = 2, output: str = "response") -> DataFrame:
    """Answers of all rows; rows whose answer isn't valid are asked again, ``rounds`` times at most; ``retry_count`` tells how often."""
    done = cut(generated(df, factory, prompt, output).withColumn("retry_count", F.lit(0)))
    for k in range(1, rounds + 1):
        bad = done.where(~F.coalesce(valid, F.lit(False)))
        if bad.isEmpty():
            break
        again = generated(bad.drop(output, "retry_count"), factory, prompt, output).withColumn("retry_count", F.lit(k))
        done = cut(done.where(F.coalesce(valid, F.lit(False))).unionByName(again))
    return done


def multi_turn(df: DataFrame, factory: Callable, turns: str = "turns", output: str = "responses") -> DataFrame:
    """``df`` with the answers to several user turns, each asked with all before it."""
    columns = df.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in pdfs:
            said: list[list] = [[] for _ in range(len(pdf))]
            asked = [list(t) for t in pdf[turns]]
            for k in range(max(map(len, asked), default=0)):
                own = [i for i, t in enumerate(asked) if k < len(t)]
                for i, answer in zip(own, model([[x for pair in zip(asked[i][:k], said[i], strict=True) for x in pair] + [asked[i][k]] for i in own]), strict=True):
                    said[i].append(answer)
            yield pdf.assign(**{output: said})[[*columns, output]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{output}` array<string>")
