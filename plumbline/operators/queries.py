"""Retrieval query texts: purpose-specific builders, allow-lists and term translation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx

# Leading phrases per purpose.
DATASET_PHRASE = "bearing dataset experimental context test rig operating condition"
DIAGNOSTIC_PHRASE = "bearing vibration condition monitoring diagnostic technical evidence"
INSPECTION_PHRASE = "bearing inspection checks failure analysis maintenance action technical guidance"
COUNTER_PHRASE = "bearing alternative explanation contradictory conditions counter evidence inspection"

# Question rules and terms of the bearing domain, longest phrases first.
QUESTION_RULES = {
    "베어링 외륜 손상의 주요 진동 특징은": "bearing outer race damage vibration characteristics",
    "베어링 내륜 손상의 원인은 무엇인가": "causes of bearing inner race damage",
    "베어링 손상 시 점검해야 할 사항은": "bearing damage inspection procedure",
    "베어링 윤활 부족으로 발생하는 문제는": "bearing problems caused by inadequate lubrication",
    "베어링 진동에서 첨도는 무엇을 의미하는가": "meaning of kurtosis in bearing vibration",
}
TERMS = (
    ("외륜 손상", "outer race damage"),
    ("내륜 손상", "inner race damage"),
    ("진동 특징", "vibration characteristics"),
    ("점검 절차", "inspection procedure"),
    ("윤활 부족", "inadequate lubrication"),
    ("베어링", "bearing"),
    ("외륜", "outer race"),
    ("내륜", "inner race"),
    ("손상", "damage"),
    ("진동", "vibration"),
    ("특징", "characteristics"),
    ("점검", "inspection"),
    ("윤활", "lubrication"),
    ("첨도", "kurtosis"),
    ("고장", "fault"),
    ("원인", "causes"),
)
QUESTION_MARKS = r"[?？!！.。]+$"


def purpose_text(purpose: Column, status: Column, predicted: Column, condition: Column, features: Column) -> Column:
    """Query text of a run; ``features`` is a map of feature name to value."""
    listed = tx.feature_text(features)
    state = F.concat(F.lit("analysis status "), status)
    label = F.concat(F.lit("predicted class "), predicted)
    where = F.concat(F.lit("operating condition "), condition)

    def joined(*parts: Column) -> Column:
        return F.concat_ws(" ", *parts)

    return (
        F.when(purpose == "DATASET_EVIDENCE", joined(F.lit(DATASET_PHRASE), state, where))
        .when(
            purpose == "DIAGNOSTIC_EVIDENCE",
            joined(F.lit(DIAGNOSTIC_PHRASE), state, label, F.nullif(listed, F.lit("")), where),
        )
        .otherwise(joined(F.lit(INSPECTION_PHRASE), state, label, where))
    )


def refined_text(missing: Column, retry: Column) -> Column:
    listed = F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise("missing diagnostic context")
    return F.concat(F.lit("bearing technical evidence needed to address "), listed, F.lit(" workflow refinement "), retry.cast("string"))


def with_purpose_filter(queries: DataFrame, allow_lists: Mapping[tuple[str, str], Sequence[str]], max_tier: int = 2) -> DataFrame:
    """Attach the sources a (purpose, mode) pair may read; the list is a literal of a few rows."""
    sources = None
    for (purpose, mode), allowed in allow_lists.items():
        hit = (F.col("purpose") == purpose) & (F.col("mode") == mode)
        value = F.array(*[F.lit(s) for s in allowed])
        sources = F.when(hit, value) if sources is None else sources.when(hit, value)
    return queries.withColumns({"sources": sources, "max_tier": F.lit(max_tier)})


def translate(questions: DataFrame, rules: Mapping[str, str] = QUESTION_RULES, terms=TERMS) -> DataFrame:
    """Rule or dictionary translation of questions, with the fragments left untranslated."""
    asked = tx.squeeze(F.col("question"))
    bare = F.regexp_replace(asked, QUESTION_MARKS, "")
    korean, latin = F.rlike(asked, F.lit("[가-힣]")), F.rlike(asked, F.lit("[A-Za-z]"))
    rule = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), bare)
    replaced = asked
    for source, target in terms:
        replaced = F.replace(replaced, F.lit(source), F.lit(target))
    replaced = tx.squeeze(F.regexp_replace(replaced, QUESTION_MARKS, ""))
    text = F.when(~korean, asked).otherwise(F.coalesce(rule, replaced))
    left = F.array_distinct(F.regexp_extract_all(text, F.lit("[가-힣]+"), F.lit(0)))
    method = (
        F.when(asked == "", "EMPTY")
        .when(~korean, "DIRECT")
        .when(rule.isNotNull() | (F.size(left) == 0), "RULE_DICTIONARY")
        .otherwise("SAFE_FALLBACK")
    )
    return questions.withColumns(
        {
            "search_query": text,
            "language": F.when(asked == "", "empty").when(~korean, "en").when(latin, "mixed").otherwise("ko"),
            "method": method,
            "translated": korean & (rule.isNotNull() | (replaced != bare)),
            "complete": (asked != "") & (F.size(left) == 0),
            "unmapped": F.array_join(left, ","),
        }
    )


# Query text and mode per label of a process row, the five features a query may carry, the note.
PROCESS_QUERIES = {
    "FAIL": (
        "FAIL_EVIDENCE_CONTEXT",
        "KAMP 정밀가공 제품 품질 Ground Truth 불량. "
        "Spindle Speed, Spindle Load, Servo Load 공정 데이터와 관련하여 "
        "Guidebook이 설명하는 공구 마모와 부하 증가, 가공 불량 가능성, "
        "작업자의 가공 설정값 및 공구 상태 점검 근거를 검색한다.",
    ),
    "PASS": (
        "PASS_CONTROL_CONTEXT",
        "KAMP 정밀가공 제품 품질 Ground Truth 양품. "
        "Spindle Speed, Spindle Load, Servo Load 공정 데이터의 정의와 품질 관계 근거를 검색한다. "
        "제품 양품을 정상 설비 또는 고장 없음으로 확대 해석하지 않는다.",
    ),
}
PROCESS_FEATURES = ("SpindleSpeed_max", "SpindleLoad_max", "SpindleLoad_std", "ServoLoad_X_std", "ServoLoad_Z1_max")
PROCESS_NOTE = "Feature values are retrieval context only and do not establish a specific fault cause."
TRUTH_SOURCE = "dataset_ground_truth"


def process_contexts(rows: DataFrame) -> DataFrame:
    """Query context of labelled process rows (status, source_type, prediction and the features).

    A row whose label was predicted or does not come from the dataset gets no query but the reason.
    """
    trusted = F.coalesce(~F.col("prediction") & (F.col("source_type") == TRUTH_SOURCE), F.lit(False))
    side = F.when(trusted, F.when(F.col("status") == "FAIL", "FAIL").otherwise("PASS"))
    texts = [F.when(side == name, value[i]) for i in (0, 1) for name, value in PROCESS_QUERIES.items()]
    half = len(PROCESS_QUERIES)
    return rows.withColumns(
        {
            "mode": F.coalesce(*texts[:half]),
            "query": F.coalesce(*texts[half:]),
            "feature_context": F.when(trusted, F.struct(*PROCESS_FEATURES)),
            "cause_inference_allowed": F.lit(False),
            "safety_note": F.lit(PROCESS_NOTE),
            "rejection": F.when(~trusted, "NOT_DATASET_TRUTH"),
        }
    )
