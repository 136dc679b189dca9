"""A slot for a model behind the rules: only the rows that the rules are unsure of reach it, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from . import casework as C

# What the rules must reach, rows of a call, what a text without words, and an answer outside the categories, count.
LEAST_CONFIDENCE, LEAST_COVERAGE = 0.6, 0.4
BATCH = 5
BLANK_CONFIDENCE, UNKNOWN_CONFIDENCE, UNSAID_CONFIDENCE = 0.1, 0.3, 0.5
OTHER = "other_evidence"
FIELDS = (*C.IDENTITY, "legal_representative", "relationship", *C.TREATMENT, "symptoms")

#: A model: takes materials (material_id, text, case_type, categories) and gives as many answers (category, confidence, extracted).
Engine = Callable[[list[dict[str, Any]]], list[dict[str, Any]]]
#: Makes the engine in each task.
EngineOf = Callable[[], Engine]


def ruled(materials: DataFrame) -> DataFrame:
    """materials (material_id, case_type, filename, ocr_text) with what the rules say: category, confidence, coverage, FIELDS, total_amount, blank and sure.

    A blank text is other evidence. Coverage counts fields that were found, fee items and the total; title,
    document type and its confidence are always there.
    """
    rows = C.classified(materials).withColumns({"_e": C.extracted(F.col("ocr_text")), "_r": C.relations(F.col("ocr_text")), "blank": F.coalesce(stripped(F.col("ocr_text")), F.lit("")) == ""})
    rows = rows.withColumns({f: F.col(f"_e.{f}") if f in (*C.IDENTITY, *C.TREATMENT) else F.col(f"_r.{f}") for f in FIELDS} | {"total_amount": F.col("_r.total_amount")})
    amounts = F.transform(F.regexp_extract_all("ocr_text", F.lit(r"([\x{4e00}-\x{9fff}]+费)[：:\s]*[¥￥]?([\d,.]+)"), F.lit(2)), lambda a: F.regexp_replace(a, ",", "").try_cast("double"))
    items = F.when(F.col("ocr_text").contains("费"), F.size(F.array_compact(amounts))).otherwise(0)
    found = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    filled = sum((F.coalesce((F.col(f) != "").cast("int"), F.lit(0)) for f in FIELDS), F.lit(0))
    total = (F.col("total_amount") != 0).cast("int")
    rows = rows.withColumn("_i", items).withColumn("coverage", (3 + filled + F.col("_i") + total) / (3 + found + F.col("_i") + 1))
    rows = rows.withColumn("sure", F.col("blank") | ((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("coverage") >= LEAST_COVERAGE)))
    rows = rows.withColumns({"category": F.when(F.col("blank"), OTHER).otherwise(F.col("category")), "confidence": F.when(F.col("blank"), BLANK_CONFIDENCE).otherwise(F.col("confidence"))})
    # exploded, so that a filter on it does not run the rules a second time
    return rows.select("material_id", "case_type", "ocr_text", "category", "confidence", "coverage", *FIELDS, "total_amount", "blank", F.explode(F.array("sure")).alias("sure"))


def categories(case_type: str | None) -> list[str]:
    return [c for c in C.ORDER if case_type == "death" or c not in C.DEATH_ONLY]


def checked(answer: Any, allowed: list[str]) -> tuple[str, float, dict[str, Any]]:
    """An answer's category, confidence (0 to 1) and fields; raises where it is none."""
    category, extracted = answer.get("category", OTHER), answer.get("extracted") or {}
    confidence = round(min(1.0, max(0.0, float(answer.get("confidence", UNSAID_CONFIDENCE)))), 2)
    return (category, confidence, dict(extracted)) if category in allowed else (OTHER, UNKNOWN_CONFIDENCE, dict(extracted))


def asked(engine: Engine, items: list[dict[str, Any]], tries: int) -> list[tuple[tuple | None, int]]:
    """Per item its checked answer (None: none came) and the calls that it took part in: one for all, then up to tries alone."""
    out: list[tuple[tuple | None, int]] = [(None, 1)] * len(items)
    try:
        answers = engine(items)
        if len(answers) != len(items):
            raise ValueError(f"{len(answers)} answers to {len(items)} materials")
    except Exception:  # whatever a model raises
        answers = [None] * len(items)
    for k, item in enumerate(items):
        answer, calls = answers[k], 1
        for left in range(tries, -1, -1):
            try:
                out[k] = (checked(answer, item["categories"]), calls)
                break
            except Exception:
                out[k] = (None, calls)
            if left:
                calls += 1
                try:
                    answer = engine([item])[0]
                except Exception:
                    answer = None
    return out


def with_model(rows: DataFrame, engine_of: EngineOf | None = None, batch: int = BATCH, tries: int = 1) -> DataFrame:
    """ruled() rows (stored() ones, as both kinds are read) with the model's answers where the rules are unsure: material_id, category, confidence, FIELDS, total_amount, answered_by, calls.

    engine_of makes the engine in each task; it is called with batch rows, then alone for rows without an
    answer (tries times), and after that the rules' result stands. A field is the model's unless empty, the
    total the rules' unless 0. Without an engine the rules' results stand and answered_by says so.
    """
    kept = ["material_id", "category", "confidence", *FIELDS, "total_amount"]
    types = dict(rows.dtypes)
    settled = rows.where("sure").select(*kept, F.lit("rules").alias("answered_by"), F.lit(0).alias("calls"))
    unsure = rows.where("not sure")
    if engine_of is None:
        return settled.unionByName(unsure.select(*kept, F.lit("rules, unsure").alias("answered_by"), F.lit(0).alias("calls")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, waiting = engine_of(), []

        def settle(some: list[dict]) -> list[dict]:
            items = [{"material_id": r["material_id"], "text": r["ocr_text"], "case_type": r["case_type"], "categories": categories(r["case_type"])} for r in some]
            out = []
            for r, (answer, calls) in zip(some, asked(engine, items, tries)):
                r = {c: r[c] for c in kept} | {"answered_by": "rules, no answer", "calls": calls}
                if answer:
                    category, confidence, extracted = answer
                    r |= {"category": category, "confidence": confidence, "answered_by": "model"}
                    r |= {f: str(extracted[f]) if extracted.get(f) else r[f] for f in FIELDS}
                    r["total_amount"] = r["total_amount"] or float(extracted.get("total_amount") or 0.0)
                out.append(r)
            return out

        # one frame out for each frame in: a frame of its own for each call costs many times what the call does
        columns = [*kept, "answered_by", "calls"]
        for frame in frames:
            waiting += frame.astype(object).where(frame.notna(), None).to_dict("records")
            whole = len(waiting) - len(waiting) % batch
            out = [r for k in range(0, whole, batch) for r in settle(waiting[k : k + batch])]
            waiting = waiting[whole:]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if waiting:
            yield pd.DataFrame(settle(waiting), columns=columns)

    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", answered_by string, calls int"
    return settled.unionByName(unsure.select(*kept, "ocr_text", "case_type").mapInPandas(run, schema))
