"""Query plans from free text: phrases of a concept registry, dates, distances and places become chips with a route.

The registry is a table that the user names (id, kind, synonyms, evidence, route, max_gsd_m, layer_requirement), read
with its schema. Phrases of the text meet synonyms by equality; the longest match at a place wins.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REGISTRY = "id string, kind string, synonyms array<string>, evidence string, route string, max_gsd_m double, layer_requirement string, evidence_otherwise string"
LONGEST = 8  # words of a phrase
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The concepts of a file of JSON lines."""
    return spark.read.schema(REGISTRY).json(path)


def matches(texts: DataFrame, concepts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, at, words, concept, kind, evidence, route and so on of the phrases of each text, those inside a longer one left out.

    A phrase of two concepts of different kinds gives both. A text's own phrases are compared with each other only.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{N}-]+"), lambda x: x != "")
    rows = texts.select(F.col(key).alias("key"), words.alias("w"))
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("w") - i)), lambda n: F.struct(i.alias("at"), n.alias("words"), F.array_join(F.slice("w", i + 1, n), " ").alias("phrase")))))
    phrases = rows.where(F.size("w") > 0).select("key", F.explode(cut).alias("x")).select("key", "x.*")
    synonyms = concepts.select(F.col("id").alias("concept"), "kind", "evidence", "route", "max_gsd_m", "layer_requirement", "evidence_otherwise", F.explode("synonyms").alias("s"))
    synonyms = synonyms.select("*", F.array_join(F.filter(F.split(F.lower("s"), r"[^\p{L}\p{M}\p{N}-]+"), lambda x: x != ""), " ").alias("phrase")).drop("s").distinct()
    found = phrases.join(synonyms, "phrase")
    # A match is inside another if a longer one begins no later and ends no earlier.
    spans = found.groupBy("key").agg(F.collect_set(F.struct("at", "words")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["words"] > F.col("words")) & (s["at"] <= F.col("at")) & (s["at"] + s["words"] >= F.col("at") + F.col("words")))
    return found.join(spans, "key").where(~inside).drop("spans").withColumnRenamed("key", key)


def dates(text: str, today: dt.date) -> tuple[str | None, str | None]:
    """From and to of the time that a text speaks of: between years, since or before one, in a month or year, the last so many."""
    low = text.lower()
    month = "|".join(MONTHS)
    if m := re.search(r"between (\d{4}) and (\d{4})", low):
        return f"{m[1]}-01-01", f"{m[2]}-12-31"
    if m := re.search(rf"\bin ({month}) (\d{{4}})", low):
        first = dt.date(int(m[2]), MONTHS.index(m[1]) + 1, 1)
        return first.isoformat(), ((first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)).isoformat()
    if m := re.search(rf"\b(since|after|before|until) (?:({month}) )?(\d{{4}})", low):
        day = dt.date(int(m[3]), MONTHS.index(m[2]) + 1 if m[2] else 1, 1).isoformat()
        return (day, None) if m[1] in ("since", "after") else (None, day)
    if m := re.search(r"\blast (\d+) (day|week|month|year)s?", low):
        return (today - dt.timedelta(days=int(m[1]) * {"day": 1, "week": 7, "month": 30, "year": 365}[m[2]])).isoformat(), today.isoformat()
    if m := re.search(r"\bin (\d{4})\b", low):
        return f"{m[1]}-01-01", f"{m[1]}-12-31"
    return None, None


def distance_m(text: str, default: int) -> int | None:
    """The distance in metres that a text names, the default after a bare `near`, else null."""
    if m := re.search(r"(\d+(?:\.\d+)?) ?(km|kilomet(?:er|re)s?|m|met(?:er|re)s?)\b", text.lower()):
        return round(float(m[1]) * (1000 if m[2][0] == "k" else 1))
    return default if re.search(r"\bnear\b", text.lower()) else None


def plan(spark: SparkSession, text: str, concepts: DataFrame, today: dt.date, gsd_m: float, layers: list[str], near_m: int) -> dict:
    """The plan of one text: intent, chips, what cannot be verified and why, and the part that can be answered."""
    rows = matches(spark.createDataFrame([(1, text)], "id int, text string"), concepts)
    order = W.partitionBy("at").orderBy("kind", "concept")
    found = rows.withColumn("place", F.row_number().over(order)).orderBy("at", "place").collect()  # of one text
    chips, open_ones = [], []
    for r in found:
        chip = {"id": r.concept, "kind": r.kind, "label": r.phrase, "evidence": r.evidence, "route": r.route, "applied": True}
        if r.layer_requirement and r.layer_requirement not in layers:
            chip |= {"evidence": r.evidence_otherwise or "unverifiable", "applied": False}
            open_ones.append({"phrase": r.phrase, "conceptId": r.concept, "reason": "layer not loaded", "wouldNeed": r.layer_requirement})
        elif r.max_gsd_m is not None and gsd_m > r.max_gsd_m:
            chip |= {"evidence": "unverifiable", "applied": False}
            open_ones.append({"phrase": r.phrase, "conceptId": r.concept, "reason": f"not resolvable at {gsd_m:g} m", "wouldNeed": f"{r.max_gsd_m:g} m"})
        chips.append(chip)
    since, until = dates(text, today)
    if since or until:
        chips.append({"id": "time", "kind": "metadata", "label": f"{since or ''}..{until or ''}", "evidence": "temporal", "route": "filter", "applied": True, "value": {"from": since, "to": until}})
    if (near := distance_m(text, near_m)) is not None:
        chips.append({"id": "distance", "kind": "spatial", "label": f"{near} m", "evidence": "spatial", "route": "filter", "applied": True, "value": {"m": near}})
    live = [c for c in chips if c["applied"] and c["route"] != "none"]
    kinds = {c["kind"] for c in live}
    intent = "find_changes" if "change" in kinds else "find_similar" if re.search(r"\b(similar|like this)\b", text.lower()) else "history" if re.search(r"\b(history|timeline)\b", text.lower()) else "find_appearance" if "visual" in kinds else "unanswerable"
    return {"text": text, "intent": intent, "chips": chips, "unverifiable": open_ones, "parser": "deterministic", "referenceDate": today.isoformat(), "answerablePart": " ".join(c["label"] for c in live)}
