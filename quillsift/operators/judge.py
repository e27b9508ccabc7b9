"""Second opinions from a model: batches, prompts, and what becomes of its answers.

The provider is any object with ask(system, user) -> parsed JSON or None; it runs in mapInPandas over batches
that were written before, so that hidden text is out of reach and a retried task asks for the same batch.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


class Provider(Protocol):
    def ask(self, system: str, user: str) -> dict | None: ...


class Unavailable(RuntimeError):
    """The provider cannot be reached or lacks the model."""


class LocalProvider:
    """A chat endpoint on this host that is asked for JSON at temperature zero. Off unless it is constructed."""

    def __init__(self, model: str, url: str = "http://127.0.0.1:11434/api/chat", timeout: float = 120):
        self.model, self.url, self.timeout = model, url, timeout

    def ask(self, system: str, user: str) -> dict | None:
        body = {"model": self.model, "stream": False, "format": "json", "options": {"temperature": 0}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                reply = json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise Unavailable(self.model) from e
            return None
        except (OSError, ValueError) as e:
            raise Unavailable(str(e)) from e
        if reply.get("done_reason") == "length":
            return None
        try:
            return json.loads(reply.get("message", {}).get("content", ""))
        except ValueError:
            return None


def eligible(segments: DataFrame) -> DataFrame:
    """Segments that a model may be asked about: below the bar and not hidden."""
    return segments.where((F.col("confidence") < fixed.JUDGE_BELOW) & (F.col("zone") != "hidden"))


def batches(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, batch from 0): greedy batches in order, bounded in segments and in tokens."""
    n = F.least(F.col("tokens_est"), F.lit(fixed.SEGMENT_CHARS // 4)).alias("n")
    own = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", n))).alias("own"))
    full = f"a.c > 0 AND (a.c >= {fixed.BATCH_SEGMENTS} OR a.t + x.n > {fixed.BATCH_TOKENS})"
    fold = f"""aggregate(own, named_struct('b', 0, 'c', 0, 't', 0, 'out', cast(array() as array<int>)),
        (a, x) -> CASE WHEN {full} THEN named_struct('b', a.b + 1, 'c', 1, 't', int(x.n), 'out', concat(a.out, array(a.b + 1)))
            ELSE named_struct('b', a.b, 'c', a.c + 1, 't', int(a.t + x.n), 'out', concat(a.out, array(a.b))) END, a -> a.out)"""
    return own.select(key, F.explode_outer(F.arrays_zip("own", F.expr(fold).alias("b"))).alias("x")).where("x IS NOT NULL").select(key, F.col("x.own.seq").alias("seq"), F.col("x.b").alias("batch"))


def prompts(segments: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, batch, prompt) of batched segments."""
    body = F.when(F.length("text") > fixed.SEGMENT_CHARS, F.concat(F.rtrim(F.substring("text", 1, fixed.SEGMENT_CHARS)), F.lit(" […]"))).otherwise(F.col("text"))
    section = F.array_join("heading_path", " > ")
    part = F.concat(F.lit('<segment id="'), F.col("segment_id"), F.lit('" section="'), text.xml_attribute(F.when(section == "", "(no heading)").otherwise(section)), F.lit('">\n'), body, F.lit("\n</segment>"))
    rows = segments.join(batches(segments, key), [key, "seq"]).groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct("seq", "segment_id", part.alias("p")))).alias("own"))
    rows = rows.join(titles.select(key, "title"), key, "left")
    head = F.concat(F.lit("Document title: "), F.coalesce("title", F.lit("(none)")), F.lit("\n\n<document>\n"))
    ask = F.concat(F.lit("\n</document>\n\nClassify segments: "), F.array_join(F.transform("own", lambda x: x["segment_id"]), ", "), F.lit("."))
    return rows.select(key, "batch", F.concat(head, F.array_join(F.transform("own", lambda x: x["p"]), "\n"), ask).alias("prompt"))


def ask(prompts: DataFrame, provider: Provider, system: str, key: str = "doc_id") -> DataFrame:
    """(key, batch, segment_id, zone, confidence): the labels in the answers; an answer that is no JSON of labels gives none."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, batch, prompt in zip(frame[key], frame["batch"], frame["prompt"], strict=True):
                answer = provider.ask(system, prompt)
                labels = answer.get("labels", []) if isinstance(answer, dict) else []
                rows += [(k, batch, str(x.get("id")), x.get("zone"), x.get("confidence")) for x in labels if isinstance(x, dict)]
            yield pd.DataFrame(rows, columns=[key, "batch", "segment_id", "zone", "confidence"])

    return prompts.mapInPandas(run, f"`{key}` {kind}, batch int, segment_id string, zone string, confidence string")


def ask_documents(outlines: DataFrame, provider: Provider, system: str, fields: list[str], key: str = "doc_id") -> DataFrame:
    """(key, fields as strings, lists as JSON) of the answers about whole documents, from (key, seq, entry) of emit.outline.
    An answer without a field gives null; a document without an answer gives no row."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda x: x["entry"]), "\n")
    rows = outlines.groupBy(key).agg(F.concat(F.lit("<document>\n"), body, F.lit("\n</document>")).alias("prompt"))
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        for frame in frames:
            found = [(k, provider.ask(system, p)) for k, p in zip(frame[key], frame["prompt"], strict=True)]
            yield pd.DataFrame([(k, *(flat(a.get(f)) for f in fields)) for k, a in found if isinstance(a, dict)], columns=[key, *fields])

    return rows.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"`{f}` string" for f in fields))


def overviews(outlines: DataFrame, provider: Provider, system: str, key: str = "doc_id") -> DataFrame:
    """(key, overview, doc_type): a paragraph and a known type, `other` for an unknown one."""
    rows = ask_documents(outlines, provider, system, ["overview", "doc_type"], key).where("overview IS NOT NULL")
    return rows.select(key, "overview", F.when(F.col("doc_type").isin(*fixed.DOC_TYPES), F.col("doc_type")).otherwise("other").alias("doc_type"))


def usage(calls: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """(model, calls, failures, tokens_in, tokens_out, cost) of calls (model, tokens_in, tokens_out, ok) at prices a million
    tokens (model, price_in, price_out); unknown models cost the default."""
    by = calls.groupBy("model").agg(F.count("*").alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("failures"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    rows = by.join(F.broadcast(prices), "model", "left").fillna({"price_in": default[0], "price_out": default[1]})
    return rows.select("model", "calls", "failures", "tokens_in", "tokens_out", text.usage_cost("tokens_in", "tokens_out", "price_in", "price_out").alias("cost"))


def once(replies: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Replies by their keys, values only where the keys occur once, with the number of occurrences as `replies`."""
    return replies.groupBy(*keys).agg(F.count("*").alias("replies"), *(F.when(F.count("*") == 1, F.min(v)).alias("reply_" + v) for v in values))


def merge(segments: DataFrame, replies: DataFrame, answered: DataFrame, key: str = "doc_id") -> DataFrame:
    """segments with the labels that hold taken over.

    answered has (key, seq) of segments whose batch was answered: others stay as they are. An id that is missing
    or repeated, an unknown zone, and a low confidence against a rule of 0.5 or more leave a signal only."""
    zone, sure = F.col("reply_zone"), F.col("reply_confidence")
    rows = segments.join(answered.select(key, "seq").distinct().withColumn("_asked", F.lit(True)), [key, "seq"], "left").join(once(replies, [key, "segment_id"], ["zone", "confidence"]), [key, "segment_id"], "left")
    value = F.coalesce(*(F.when(sure == n, F.lit(v)) for n, v in fixed.JUDGE_CONFIDENCE.items()))
    asked = F.coalesce("_asked", F.lit(False))
    lone = asked & (F.coalesce("replies", F.lit(0)) == 1) & zone.isin(*[z for z in fixed.ZONES if z != "hidden"]) & sure.isin(*fixed.JUDGE_CONFIDENCE)
    weak = (sure == "low") & (F.col("confidence") >= 0.5)
    take = F.coalesce(lone & (zone != "unknown") & ~weak, F.lit(False))
    signal = F.when(asked & ~F.coalesce(lone, F.lit(False)), "llm:missing_or_duplicate_id").when(lone & (zone == "unknown"), "llm:unknown").when(lone & weak, F.concat(F.lit("llm:low("), zone, F.lit(")"))).when(take, F.concat(F.lit("llm:"), sure))
    out = {
        "signals": F.when(signal.isNull(), F.col("signals")).otherwise(F.concat("signals", F.array(signal))),
        "zone": F.when(take, zone).otherwise(F.col("zone")), "confidence": F.when(take, value).otherwise(F.col("confidence")), "method": F.when(take, "llm").otherwise(F.col("method")),
    }
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in segments.columns))


def context(body: str, start: str, end: str) -> Column:
    """A span with the text around it, white space collapsed."""
    low = F.greatest(F.lit(0), F.coalesce(F.col(start), F.lit(0)) - fixed.CONTEXT_CHARS)
    high = F.least(F.length(body), F.coalesce(F.col(end), F.length(body)) + fixed.CONTEXT_CHARS)
    return text.collapse(F.substring(F.col(body), low + 1, high - low))


def confirm(findings: DataFrame, verdicts: DataFrame, key: str = "doc_id", tie: str = "finding") -> DataFrame:
    """Open D1 findings after a model's verdicts (key, flag, verdict), flags f1, f2 … in order. Nothing is removed."""
    flagged = (F.col("detector") == "D1") & (F.col("status") != "quarantined") & F.col("segment_id").isNotNull()
    number = F.row_number().over(Window.partitionBy(key, flagged).orderBy(tie))
    rows = findings.withColumn("_f", F.when(flagged, F.concat(F.lit("f"), number)))
    rows = rows.join(once(verdicts.withColumnRenamed("flag", "_f"), [key, "_f"], ["verdict"]), [key, "_f"], "left")
    said = F.col("reply_verdict")
    out = {
        "severity": F.when(said.isin("quoted", "benign"), "info").otherwise(F.col("severity")),
        "status": F.when(said == "benign", "dismissed").otherwise(F.col("status")),
        "note": F.when(said == "directive", F.concat(F.coalesce("note", F.lit("")), F.lit("; confirmed by the model")))
        .when(said == "quoted", "quoted: the document discusses such text").when(said == "benign", "judged benign by the model").otherwise(F.col("note")),
    }
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in findings.columns))


def mode(available: str | None, classifier: bool) -> tuple[str, list[str]]:
    """The mode of an analysis and its warnings: the model if there is one, else the classifier, else the rules."""
    if available:
        return "llm", []
    return ("distilled", []) if classifier else ("heuristic-only", ["no model was available: zones are those of the rules"])
