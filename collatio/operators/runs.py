"""Runs of models over images: pending work, an exchangeable client, the call log, manifests."""

from __future__ import annotations

import base64
import json
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from urllib import error, request

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import experiment_name, folder_name
from ..sources import files, shared

LOG = (
    "created_at string, status string, experiment_id int, model string, image string, output_file string, text string, characters int, lines int, wall_seconds double, "
    "total_duration_seconds double, load_duration_seconds double, prompt_eval_duration_seconds double, eval_duration_seconds double, prompt_eval_count int, eval_count int, done_reason string, error string"
)
DURATIONS = ("total_duration", "load_duration", "prompt_eval_duration", "eval_duration")
#: Parameters of a run that a resumed one must share, with their defaults (fixed values).
DEFAULTS = {"num_ctx": 8192, "num_predict": 4096, "keep_alive": "30m", "timeout_seconds": 1800, "temperature": 0, "seed": 42, "stream": False, "think": False}
#: Models of one run that are broadcast; more are joined by a shuffle.
MODELS = 10_000


class CallError(RuntimeError):
    """A call that gave no answer: refused, unreachable, not JSON, or without a text."""


class Settings(ValueError):
    """A resumed run asks for something else than the run that it resumes."""


def body(model: str, prompt: str, image: bytes, parameters: dict = DEFAULTS) -> dict:
    """The request for one image."""
    options = {k: parameters[k] for k in ("temperature", "seed", "num_ctx", "num_predict")}
    message = {"role": "user", "content": prompt, "images": [base64.b64encode(image).decode()]}
    return {"model": model, "messages": [message], "options": options, **{k: parameters[k] for k in ("stream", "think", "keep_alive")}}


class HttpClient:
    """A model server over HTTP with JSON. Made once a task; called with model, prompt and image."""

    def __init__(self, url: str, parameters: dict = DEFAULTS):
        self.url, self.parameters, self.used = url.rstrip("/"), parameters, set()

    def json(self, endpoint: str, payload: dict | None = None, timeout: float = 30) -> dict:
        data = None if payload is None else json.dumps(payload).encode()
        headers = {"Accept": "application/json"} | ({} if data is None else {"Content-Type": "application/json"})
        try:
            with request.urlopen(request.Request(self.url + endpoint, data, headers), timeout=timeout) as answer:
                raw = answer.read().decode()
        except error.HTTPError as e:
            raise CallError(f"HTTP {e.code}: {e.read().decode(errors='replace')}") from e
        except OSError as e:
            raise CallError(f"{self.url} can't be reached: {e}") from e
        try:
            return json.loads(raw)
        except ValueError as e:
            raise CallError(f"the answer isn't JSON: {raw[:500]}") from e

    def installed(self) -> list[str]:
        return sorted({m["name"] for m in self.json("/api/tags").get("models", []) if isinstance(m.get("name"), str)})

    def __call__(self, model: str, prompt: str, image: bytes) -> dict:
        self.used.add(model)
        return self.json("/api/chat", body(model, prompt, image, self.parameters), self.parameters["timeout_seconds"])

    def close(self) -> None:
        """Asks the server to unload the models used; that it can't is no error."""
        for model in self.used:
            try:
                self.json("/api/generate", {"model": model, "prompt": "", "stream": False, "keep_alive": 0}, 120)
            except CallError:
                pass


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """With the broadcast hint only if so few rows were counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pending(images: DataFrame, models: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Images and models without an output yet."""
    every = images.crossJoin(bounded(models, MODELS))
    return every if overwrite else every.join(done, ["model", "image"], "left_anti")


def seconds(ns) -> float | None:
    return round(ns / 1e9, 6) if isinstance(ns, (int, float)) and not isinstance(ns, bool) else None


def text_of(answer: dict) -> str:
    text = (answer.get("message") or {}).get("content")
    if not isinstance(text, str):
        raise CallError(f"the answer has no text: {answer}")
    return text


def transcribe(work: DataFrame, client: Callable[[], Callable[[str, str, bytes], dict]], experiment: int, folder: str | None = None) -> DataFrame:
    """work: model, image, prompt, content. client() makes, once a task, a function of model, prompt and bytes that answers {message: {content}, ...durations in ns, ...}. An error of a call is a row; the others go on. folder: the shared folder of the experiment, where each text is kept verbatim as <model>/<image's stem>.txt."""
    names = [x.split()[0] for x in LOG.split(", ")]

    def keep(model_folder: str, stem: str, text: str) -> str:
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(folder)
        at.create_dir(f"{root}/{model_folder}", recursive=True)
        own, path = f"{root}/{model_folder}/.{uuid.uuid4().hex}", f"{root}/{model_folder}/{stem}.txt"
        with at.open_output_stream(own) as f:
            f.write(text.encode())
        at.move(own, path)
        return path

    def run(batches):
        ask = client()
        try:
            for batch in batches:
                rows = []
                for model, image, prompt, content, model_folder in batch.itertuples(index=False):
                    row = dict.fromkeys(names) | {"created_at": datetime.now(UTC).isoformat(), "experiment_id": experiment, "model": model, "image": image}
                    began = time.monotonic()
                    try:
                        answer = ask(model, prompt, content)
                        wall, text = time.monotonic() - began, text_of(answer)
                        stem = image.rpartition(".")[0] or image
                        row |= {"status": "completed", "text": text, "characters": len(text), "lines": len(text.splitlines()), "output_file": keep(model_folder, stem, text) if folder else f"{stem}.txt", "wall_seconds": round(wall, 3), "done_reason": answer.get("done_reason")}
                        row |= {f"{d}_seconds": seconds(answer.get(d)) for d in DURATIONS} | {c: answer.get(c) for c in ("prompt_eval_count", "eval_count")}
                    except Exception as e:  # the log keeps what went wrong
                        row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
                    rows.append(row)
                yield pd.DataFrame(rows, columns=names)
        finally:
            close = getattr(ask, "close", None)
            if close:
                close()

    return work.select("model", "image", "prompt", "content", folder_name(F.col("model")).alias("folder")).mapInPandas(run, LOG)


def prompt(model: Column, prompts: dict[str, str], default: str) -> Column:
    if not prompts:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in prompts.items() for x in kv)), model), F.lit(default))


def unavailable(requested: DataFrame, installed: DataFrame) -> DataFrame:
    return requested.join(installed, "model", "left_anti")


def next_experiment(folders: DataFrame) -> DataFrame:
    number = F.regexp_extract("folder", r"^experiment_(\d+)$", 1)
    return folders.where(F.col("folder").rlike(r"^experiment_\d+$")).agg((F.coalesce(F.max(number.cast("int")), F.lit(0)) + 1).alias("next_id"))


#: What a resumed run may not change, in the order in which differences are told.
COMPARED = ("image_directory", "images", "parameters", "description")


def manifest_differences(saved: str, asked: str) -> Column:
    """Names of what a resumed run would change, of two struct columns; the images count with their order, a description only where both have one."""
    a, b = F.col(saved), F.col(asked)
    differs = [F.when(~a[n].eqNullSafe(b[n]) & ((F.coalesce(a[n], F.lit("")) != "") & (F.coalesce(b[n], F.lit("")) != "") if n == "description" else F.lit(True)), n) for n in COMPARED]
    return F.filter(F.array(*differs), lambda n: n.isNotNull())


def differences(saved: dict, asked: dict) -> list[str]:
    """The same of two manifests as read."""
    both = saved.get("description") and asked.get("description")
    return [n for n in COMPARED if saved.get(n) != asked.get(n) and (n != "description" or both)]


def joined_models(saved: Column, asked: Column) -> Column:
    """Models of all runs, each once, in order of appearance."""
    return F.array_distinct(F.concat(saved, asked))


def read_manifest(spark: SparkSession, folder: str) -> dict:
    try:
        return json.loads(shared.read_text(spark, f"{folder}/experiment.json"))
    except ValueError as e:
        raise Settings(f"{folder}/experiment.json can't be read: {e}") from e


def write_manifest(spark: SparkSession, folder: str, data: dict) -> dict:
    shared.write_text(spark, f"{folder}/experiment.json", json.dumps(data, ensure_ascii=False, indent=2) + "\n")
    return data


def open_experiment(spark: SparkSession, folder: str, experiment: int, *, image_directory: str, images: list[str], models: list[str], description: str = "", parameters: dict = DEFAULTS) -> dict:
    """The manifest of a run: made by the first; a later one must agree with it, and adds its models."""
    now, models = datetime.now(UTC).isoformat(), list(dict.fromkeys(models))
    asked = {"image_directory": image_directory, "images": images, "parameters": dict(parameters), "description": description}
    if not shared.exists(spark, f"{folder}/experiment.json"):
        fresh = {"experiment_id": experiment, "created_at": now, "updated_at": now, "status": "running", **asked, "number_of_images": len(images), "models": models, "summary": {"completed": 0, "skipped": 0, "errors": 0}}
        return write_manifest(spark, folder, fresh)
    saved = read_manifest(spark, folder)
    changed = differences(saved, asked)
    if changed:
        raise Settings(f"the experiment was begun with other settings: {', '.join(changed)}")
    saved |= {"updated_at": now, "status": "running", "description": saved.get("description") or description, "models": list(dict.fromkeys([*saved.get("models", []), *models]))}
    return write_manifest(spark, folder, saved)


def close_experiment(spark: SparkSession, folder: str, summary: dict[str, int]) -> dict:
    now = datetime.now(UTC).isoformat()
    return write_manifest(spark, folder, read_manifest(spark, folder) | {"updated_at": now, "status": "completed_with_errors" if summary["errors"] else "completed", "summary": summary})


def keep_prompt(spark: SparkSession, folder: str, text: str) -> None:
    """A model's prompt is written once; another one later is an error."""
    path = f"{folder}/prompt.txt"
    if not shared.exists(spark, path):
        shared.write_text(spark, path, text)
    elif shared.read_text(spark, path) != text:
        raise Settings(f"{path} holds another prompt")


def run(spark: SparkSession, *, image_dir: str, output_dir: str, models: list[str], client: Callable[[], Callable], installed: list[str], default_prompt: str, prompts: dict[str, str] | None = None, experiment: int | None = None, description: str = "", limit: int | None = None, overwrite: bool = False, parameters: dict = DEFAULTS) -> tuple[int, dict[str, int]]:
    """A whole run: 1 if it can't begin, 2 if calls failed, else 0; and its totals. A model whose folder can't be prepared fails for all images."""
    totals = {"completed": 0, "skipped": 0, "errors": 0}
    missing = [m for m in models if m not in set(installed)]
    if missing or (experiment is not None and experiment < 1):
        return 1, totals
    try:
        images = files.images(spark, image_dir, limit).select("image", "path")
        names = [r["image"] for r in images.collect()]  # a listing
        if experiment is None:
            found = files.experiments(spark, output_dir)
            experiment = next_experiment(found).first()[0]
        name = spark.range(1).select(experiment_name(F.lit(experiment))).first()[0]
        folder = f"{output_dir}/{name}"
        open_experiment(spark, folder, experiment, image_directory=image_dir, images=names, models=models, description=description, parameters=parameters)
    except (files.NoInput, Settings, ValueError):
        return 1, totals
    ready = []
    for model, sub in spark.createDataFrame([(m,) for m in dict.fromkeys(models)], "model string").select("model", folder_name(F.col("model"))).collect():
        try:
            keep_prompt(spark, f"{folder}/{sub}", (prompts or {}).get(model, default_prompt))
            ready.append((model, sub))
        except Settings:
            totals["errors"] += len(names)
    if ready:
        every = spark.createDataFrame(ready, "model string, folder string")
        listed = files.listing(spark, f"{folder}/*/*.txt").select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"))
        stems = images.select("image", "path", F.regexp_replace("image", r"\.[^.]*$", "").alias("stem"))
        done = every.join(listed, "folder").join(stems, "stem").select("model", "image")
        content = spark.read.format("binaryFile").load(image_dir).select(F.regexp_extract("path", "([^/]+)$", 1).alias("image"), "content")
        work = pending(stems.select("image"), every.select("model"), done, overwrite).join(content, "image").withColumn("prompt", prompt(F.col("model"), prompts or {}, default_prompt))
        log = f"{folder}/log-{uuid.uuid4().hex[:8]}"
        transcribe(work, client, experiment, folder).write.json(log)
        counted = {r["status"]: r["count"] for r in spark.read.schema(LOG).json(log).groupBy("status").count().collect()}
        totals["completed"] += counted.get("completed", 0)
        totals["errors"] += counted.get("error", 0)
        totals["skipped"] += len(ready) * len(names) - sum(counted.values())
    close_experiment(spark, folder, totals)
    return (2 if totals["errors"] else 0), totals


def totals(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "error").alias("errors"))


def manifest(log: DataFrame) -> DataFrame:
    status = F.when(F.col("errors") == 0, "completed").otherwise("completed_with_errors")
    return totals(log, ["experiment_id"]).withColumn("status", status)


def latency(log: DataFrame) -> DataFrame:
    done = log.where("status = 'completed'")
    return done.groupBy("model").agg(F.count("*").alias("calls"), F.avg("wall_seconds").alias("mean_seconds"), F.max("wall_seconds").alias("max_seconds"), F.sum("tokens").alias("tokens"), F.try_divide(F.sum("tokens"), F.sum("wall_seconds")).alias("tokens_per_second"))
