"""Enrichment of articles in four rounds with an injected chat function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "content_type string, classification_reason string, translated_title string, translated_body string, summary string, tags array<string>, translation_status string, summary_status string, tagging_status string, failed_step string, error_message string"
STEPS = ("ad_judgment", "translation", "summary", "tagging")


class RateLimited(Exception):
    """The provider asks to come back later: no retry within the step."""


def object_of(text: str) -> dict:
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("payload must be an object")
    return value


def _text(payload: dict, key: str) -> str:
    value = payload.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{key} must be a non-empty text")
    return value.strip()


def read_judgment(payload: dict) -> tuple[str, str]:
    kind = payload.get("content_type")
    if kind not in ("article", "advertisement", "uncertain"):
        raise ValueError("content_type is none of the known ones")
    return kind, str(payload.get("reason") or "")


def read_tags(payload: dict) -> list[str]:
    raw = payload.get("tags")
    if not isinstance(raw, list) or not all(isinstance(t, str) for t in raw):
        raise ValueError("tags must be a list of texts")
    tags = list(dict.fromkeys(t.strip() for t in raw if t.strip()))
    if not 3 <= len(tags) <= 8:
        raise ValueError("three to eight tags are needed")
    return tags


def prompt(step: str, title: str, body: str) -> str:
    asks = {
        "ad_judgment": f"Is this an article, an advertisement, or uncertain? Answer as JSON with content_type and reason.\n\n{title}\n\n{body}",
        "translation": "Translate title and body into Chinese. Answer as JSON with title and body.",
        "summary": "Summarise the article in Chinese. Answer as JSON with summary.",
        "tagging": "Give three to eight tags. Answer as JSON with tags.",
    }
    return asks[step]


def converse(send: Callable[[list[dict]], str], title: str, body: str, attempts: int = 2) -> dict:
    """One article: a growing conversation, in which only rounds that worked stay.

    An advertisement ends it; a failed translation ends it; a failed summary or
    tagging leaves the rest standing.
    """
    out = dict.fromkeys(("classification_reason", "translated_title", "translated_body", "summary", "failed_step", "error_message"), "") | {"content_type": "", "tags": [], "translation_status": "skipped", "summary_status": "skipped", "tagging_status": "skipped"}
    history: list[dict] = []

    def step(name: str, read: Callable[[dict], object]):
        ask = {"role": "user", "content": prompt(name, title, body)}
        error: Exception | None = None
        for _ in range(attempts):
            try:
                said = send([*history, ask])
                value = read(object_of(said))
            except RateLimited:
                raise
            except Exception as e:  # noqa: BLE001  any bad answer is tried again
                error = e
                continue
            history.extend([ask, {"role": "assistant", "content": said}])
            return value
        if not out["failed_step"]:
            out.update(failed_step=name, error_message=str(error))
        return None

    judged = step("ad_judgment", read_judgment)
    if judged is None:
        return out | {"translation_status": "failed"}
    out["content_type"], out["classification_reason"] = judged
    if out["content_type"] == "advertisement":
        return out
    translated = step("translation", lambda p: (_text(p, "title"), _text(p, "body")))
    if translated is None:
        return out | {"translation_status": "failed"}
    out |= {"translation_status": "succeeded", "translated_title": translated[0], "translated_body": translated[1]}
    summary = step("summary", lambda p: _text(p, "summary"))
    out |= {"summary_status": "failed"} if summary is None else {"summary_status": "succeeded", "summary": summary}
    tags = step("tagging", read_tags)
    return out | ({"tagging_status": "failed"} if tags is None else {"tagging_status": "succeeded", "tags": tags})


def enrich(articles: DataFrame, make_send: Callable[[], Callable[[list[dict]], str]], attempts: int = 2) -> DataFrame:
    """``articles`` (article_id, title, body_text) with results; a sender a task."""
    kind = dict(articles.dtypes)["article_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = make_send()
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                try:
                    rows.append({"article_id": row.article_id} | converse(send, row.title, row.body_text, attempts))
                except RateLimited as e:
                    rows.append({"article_id": row.article_id} | converse(_refuse(str(e)), row.title, row.body_text, 1) | {"failed_step": "rate_limited", "error_message": str(e)})
            yield pd.DataFrame(rows, columns=["article_id", *[x.split()[0] for x in RESULT.split(", ")]])

    return articles.select("article_id", "title", "body_text").mapInPandas(run, f"article_id {kind}, {RESULT}")


def _refuse(why: str) -> Callable[[list[dict]], str]:
    def send(_: list[dict]) -> str:
        raise ValueError(why)
    return send


def outcome(results: DataFrame) -> DataFrame:
    """The run status each result stands for."""
    status = (
        F.when(F.col("content_type") == "advertisement", "skipped_advertisement")
        .when(F.col("translation_status") == "failed", "failed")
        .when((F.col("summary_status") == "succeeded") & (F.col("tagging_status") == "succeeded"), "succeeded")
        .otherwise("partial")
    )
    return results.withColumn("status", status)


def best_runs(runs: DataFrame) -> DataFrame:
    """(article_key, input_hash, enrichment_run_id): the latest of succeeded ``runs``."""
    return runs.groupBy("article_key", "input_hash").agg(F.max_by("enrichment_run_id", F.struct("finished_at", "seq")).alias("enrichment_run_id"))


def reusable(articles: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles with a run to reuse, articles to enrich), by key and input hash;
    the look-up comes before any call. ``runs`` are succeeded ones."""
    best = best_runs(runs)
    return articles.join(best, ["article_key", "input_hash"]), articles.join(best, ["article_key", "input_hash"], "left_anti")


def looked_up(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """(article_key, input_hash, enrichment_run_id) for each of an article's ``input_hashes``,
    with null where no run can be reused.

    The best runs of a key, one an input, meet its article as a map, so that articles
    are dealt by key and their inputs aren't shuffled."""
    entry = F.struct("input_hash", "enrichment_run_id")
    known = best_runs(runs).filter("input_hash is not null").groupBy("article_key").agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    rows = articles.join(known, "article_key", "left").select("article_key", F.explode("input_hashes").alias("input_hash"), "known")
    return rows.select("article_key", "input_hash", F.try_element_at("known", F.col("input_hash")).alias("enrichment_run_id"))
