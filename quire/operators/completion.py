"""The deterministic side of extraction by a completion service: prompts, replies, attempts.

Replies are a table (doc_id, attempt, content). A client is any function from batches of prompts to batches of replies, run by
complete(); tests replay a table instead. extract() runs the rounds of attempts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions import classify, text
from quire.functions.jsontext import json_object
from quire.sources import records
from quire.sources.shared import append, appended, shared_dir, written

CONTEXT_TOKENS = 32_768
WARN_SHARE = 0.75
MOST_ATTEMPTS = 4
#: Characters kept of a reply that goes back, of a reply of an odd structure, of an error, and of a reply that is no JSON.
MOST_PREVIOUS, MOST_ODD, MOST_ERROR, MOST_NOT_JSON = 2_000, 500, 400, 300
MOST_WORDS = 6
#: The numbered sections that a document may belong to carry their names as data; this is the instruction.
SYSTEM = "Read the procedure below and answer with one JSON object that has its title, type, overview, materials, procedure sections with steps and callouts, notes and references. Add nothing that the text lacks."
TASK = "Answer with the JSON object only."


def conventions() -> str:
    """The conventions part of a prompt: the first words of each callout class, and the stopping phrases."""
    lines = [f"- {kind}: {', '.join(words.split('|')[:MOST_WORDS])}" for kind, words in classify.CALLOUT_WORDS.items()]
    return "\n".join(["Callouts:", *lines, "Stopping points: " + ", ".join(classify.STOPPING.split("|"))])


def user_message(body: Column, filename: Column | None = None, section: Column | None = None, kind: Column | None = None) -> Column:
    """Conventions, the hints that aren't empty, the text, the task; parts joined by blank lines."""
    hint = lambda name, c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(f"{name}: "), c)) if c is not None else F.lit(None)
    return F.concat_ws("\n\n", F.lit(conventions()), hint("File", filename), hint("Section", section), hint("Type", kind), text.strip(body), F.lit(TASK))


def retry_message(previous: Column, errors: Column) -> Column:
    cut = F.when(F.length(previous) > MOST_PREVIOUS, F.concat(F.left(previous, F.lit(MOST_PREVIOUS)), F.lit("\n[cut]"))).otherwise(previous)
    return F.concat_ws("\n\n", F.lit("The answer was not valid:"), errors, F.lit("It was:"), cut, F.lit(TASK))


def messages(user: Column) -> Column:
    made = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(made("system", F.lit(SYSTEM)), made("user", user))


def request(model: str, turns: Column, most_tokens: int = 4096) -> Column:
    """The request body as JSON text, of the turns of a conversation (see messages())."""
    options = F.struct(F.lit(0.1).alias("temperature"), F.lit(most_tokens).alias("num_predict"))
    return F.to_json(F.struct(F.lit(model).alias("model"), turns.alias("messages"), F.lit(False).alias("stream"), F.lit("json").alias("format"), options.alias("options")))


def token_budget(user: Column, system: str = SYSTEM) -> Column:
    """struct<total, over>: estimated tokens of a request, and whether they pass the warning level."""
    total = text.estimate_tokens(user) + max(1, int(len(system) / 3.5))
    return F.struct(total.alias("total"), (total > CONTEXT_TOKENS * WARN_SHARE).alias("over"))


class Unavailable(RuntimeError):
    """The completion service can't be reached."""


Reply = tuple[str | None, str | None]  # content; what went wrong


class HttpClient:
    """Posts request bodies (JSON texts), `in_flight` of them at once, and gives (content, problem) for each. Problems: unavailable, not_json and odd_structure, with the beginning of what came."""

    def __init__(self, url: str, timeout: float = 120.0, in_flight: int = 4):
        self.url, self.timeout, self.in_flight = url, timeout, in_flight

    def one(self, body: str) -> Reply:
        from urllib import error, request

        sent = request.Request(self.url, body.encode(), {"Content-Type": "application/json"})
        try:
            with request.urlopen(sent, timeout=self.timeout) as r:
                said = r.read().decode("utf-8", "replace")
        except error.HTTPError as e:
            return None, f"http_{e.code}: {e.read().decode('utf-8', 'replace')[:MOST_ERROR]}"
        except OSError as e:
            return None, f"unavailable: {e}"
        try:
            answer = json.loads(said)
        except ValueError:
            return None, f"not_json: {said[:MOST_NOT_JSON]}"
        content = answer.get("message", {}).get("content") if isinstance(answer, dict) and isinstance(answer.get("message"), dict) else None
        return (content, None) if isinstance(content, str) else (None, f"odd_structure: {said[:MOST_ODD]}")

    def __call__(self, bodies: list[str]) -> list[Reply]:
        with ThreadPoolExecutor(self.in_flight) as pool:
            return list(pool.map(self.one, bodies))


def complete(requests: DataFrame, client: Callable[[list[str]], list[str | Reply]], column: str = "user_message") -> DataFrame:
    """doc_id and a column of prompts or request bodies -> doc_id, content, problem. The client is called on Arrow batches in the executors; it gives a content, or (content, problem), for each."""
    schema = StructType([StructField("doc_id", requests.schema["doc_id"].dataType), StructField("content", StringType()), StructField("problem", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                replies = [r if isinstance(r, tuple) else (r, None) for r in client(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in replies], pa.string()), pa.array([r[1] for r in replies], pa.string())], names=["doc_id", "content", "problem"])

    return requests.select("doc_id", column).mapInArrow(run, schema)


def read_attempts(replies: DataFrame) -> DataFrame:
    """doc_id, attempt, content[, problem] -> with object, failure_kind (null if valid), detail and title.

    A reply is valid if its JSON object, post-processed, breaks no rule of a record but those that a later stage fills (section number and name). Kinds: the client's problem,
    no_json, incomplete, parse_error, validation_error."""
    problem = F.col("problem") if "problem" in replies.columns else F.lit(None).cast("string")
    found = replies.withColumn("found", json_object(F.col("content"))).withColumn("trouble", problem)
    # a reply is parsed once; what isn't JSON gives null
    parsed = found.withColumn("json", F.try_parse_json("found.object")).withColumn("record", records.post_processed(F.col("found.object")))
    broken = records.broken(F.col("record"), F.col("json"))
    later = [f"{c}_{what}" for c in ("section_number", "section_name", "overview", "section_type") for what in ("missing", "mistyped")] + ["after_step_mistyped"]
    broken = F.filter(broken, lambda v: ~v["rule"].isin(later))
    parsed = parsed.withColumn("broken", F.when(F.col("json").isNotNull(), broken))
    kind = (
        F.when(F.col("trouble").isNotNull(), F.regexp_extract("trouble", "^([a-z_]+)", 1))
        .when(F.col("found.problem") == "no object", "no_json")
        .when(F.col("found.problem").isNotNull(), "incomplete")
        .when(F.col("json").isNull(), "parse_error")
        .when(F.size("broken") > 0, "validation_error")
    )
    detail = F.coalesce("trouble", F.when(F.size("broken") > 0, F.array_join(F.transform("broken", lambda v: F.concat_ws(" ", v["rule"], v["path"])), "; ")), F.lit(""))
    return parsed.select("doc_id", "attempt", F.col("found.object").alias("object"), kind.alias("failure_kind"), F.left(detail, F.lit(MOST_ERROR)).alias("detail"), F.col("record.title").alias("title"))


def first_valid(attempts: DataFrame) -> DataFrame:
    """doc_id, attempt, title, object, source: the first valid attempt, or the heuristic's turn."""
    good = F.when(F.col("failure_kind").isNull(), F.col("attempt"))
    out = attempts.groupBy("doc_id").agg(F.min(good).alias("attempt"), F.min_by("title", good).alias("title"), F.min_by("object", good).alias("object"))
    return out.withColumn("source", F.when(F.col("attempt").isNull(), "heuristic").otherwise("completion"))


def with_fallback(attempts: DataFrame, fallback: DataFrame, source_filename: Column | None = None) -> DataFrame:
    """doc_id, record, source, attempt: a row for each document of either side. The record of the first valid attempt, post-processed and with the file's own name (of `fallback`'s columns), else the
    heuristic's (doc_id, record); source says which: completion, heuristic, or none if a document has neither."""
    name = F.coalesce(source_filename if source_filename is not None else F.lit(None), F.col("record.source_filename"))
    both = first_valid(attempts).select("doc_id", "attempt", "object").join(fallback.withColumn("own_name", name).select("doc_id", "record", "own_name"), "doc_id", "full")
    # a document's name is the file's, not what the service says
    said = text.once(records.post_processed(F.col("object")), lambda r: F.when(r.isNotNull(), r.withField("source_filename", F.coalesce(F.col("own_name"), r["source_filename"]))))
    kind = F.when(F.col("attempt").isNotNull(), "completion").when(F.col("record").isNotNull(), "heuristic").otherwise("none")
    return both.select("doc_id", F.when(F.col("attempt").isNotNull(), said).otherwise(F.col("record").cast(StructType.fromDDL(records.RECORD))).alias("record"), kind.alias("source"), "attempt")


def _asked(pending: DataFrame, client: Callable[[list[str]], list[str | Reply]], model: str, folder: str) -> DataFrame:
    """doc_id, content, problem of a round's requests. Those that the round's folder has replies to aren't sent; new replies are appended to it, but for those that never came."""
    bodies = pending.select("doc_id", request(model, F.col("turns")).alias("body")).withColumn("request", F.sha2("body", 256))
    kind = bodies.select("doc_id", "request", F.lit("").alias("content"), F.lit("").alias("problem")).schema
    known = appended(bodies.sparkSession, folder, StructType([StructField(f.name, f.dataType) for f in kind]))
    todo = written(bodies.join(known, ["doc_id", "request"], "left_anti"), "requests")
    came = written(complete(todo, client, "body").join(todo.select("doc_id", "request"), "doc_id"), "replies")
    lost = F.coalesce(F.startswith("problem", F.lit("unavailable")), F.lit(False))
    n, n_lost, one = came.agg(F.count("*"), F.count_if(lost), F.max(F.when(lost, F.col("problem")))).first()
    if n and n == n_lost and known.isEmpty():
        raise Unavailable(one)
    append(came.where(~lost).select(*kind.names), folder)
    mine = bodies.select("doc_id", "request")
    old = known.join(mine, ["doc_id", "request"]).dropDuplicates(["doc_id"])
    return written(old.select("doc_id", "content", "problem").unionByName(came.select("doc_id", "content", "problem")), "round")


def extract(prompts: DataFrame, client: Callable[[list[str]], list[str | Reply]], model: str = "model", most_attempts: int = MOST_ATTEMPTS, store: str | None = None) -> DataFrame:
    """doc_id, user_message -> all attempts: doc_id, attempt, object, failure_kind, detail, title, as a written table.

    A round sends the request of each document that has no valid reply yet; a reply that isn't valid goes back with what was wrong with it, as another turn of the conversation; a request that no
    reply came to is sent again as it was. Each round is a distributed pass, written before the next. Unavailable is raised if no reply at all comes. What is invalid in the end is the heuristic's turn (with_fallback).

    `store` is a folder that outlives the run: each round's replies are appended there under their request's hash, and a run that finds a reply doesn't send the request again, so a run
    that broke off goes on where it was, and documents that come later cost their own requests alone."""
    store = store or shared_dir(prompts.sparkSession)
    turn = "array<struct<role: string, content: string>>"
    pending = prompts.select("doc_id", messages(F.col("user_message")).cast(turn).alias("turns"))
    done = []
    for attempt in range(1, most_attempts + 1):
        replies = _asked(pending, client, model, f"{store.rstrip('/')}/attempt={attempt}").withColumn("attempt", F.lit(attempt))
        read = written(read_attempts(replies), "attempts")
        done.append(read)
        failed = read.where("failure_kind is not null")
        if attempt == most_attempts or failed.isEmpty():
            break
        said = F.coalesce(F.col("content"), F.lit(""))
        made = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        again = F.array(made("assistant", said), made("user", retry_message(said, F.concat_ws(": ", "failure_kind", "detail")))).cast(turn)
        more = failed.join(replies.select("doc_id", "content"), "doc_id").select("doc_id", F.when(F.col("failure_kind") == "unavailable", F.expr("array()").cast(turn)).otherwise(again).alias("more"))
        pending = written(pending.join(more, "doc_id").select("doc_id", F.concat("turns", "more").alias("turns")), "pending")
    return reduce(DataFrame.unionByName, done)


def nested(content: Column, *path: str, default: str = "") -> Column:
    """The text at a path of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(content, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path)), F.lit(default))
