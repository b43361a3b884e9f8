"""The flat feature row of a question and its first output: every signal as a number under one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import consistency as C
from routeloom.functions import text as T
from routeloom.operators.policies import answer_error_policies, trusted
from routeloom.operators.prefix import unused
from routeloom.operators.texts import once_per_text, spread


def flattened(df: DataFrame, prefix: str, column: str) -> list[Column]:
    """Doubles of a struct's numeric and boolean fields, nested ones too, as <prefix>_<field>; nulls are 0, and fields of
    other kinds (text, arrays) are left out."""
    out = []

    def walk(kind, at: Column, name: str) -> None:
        for f in kind.fields:
            here = f"{name}_{f.name}" if name else f.name
            if f.dataType.typeName() == "struct":
                walk(f.dataType, at[f.name], here)
            elif f.dataType.typeName() in ("boolean", "integer", "long", "double", "float", "short", "byte") or f.dataType.typeName().startswith("decimal"):
                out.append(F.coalesce(at[f.name].cast("double"), F.lit(0.0)).alias(here))

    walk(df.schema[column].dataType, F.col(column), prefix)
    return out


def numeric_features(df: DataFrame, key: str, question: str, output: str, answer: str) -> DataFrame:
    """(key, q_*, tq_*, cons_*, role_*, calibrated_strong_escalation_candidate, self_*, cal_*, step_*, fp_*, unified_*, v6_*,
    v7_*), all doubles, of every row: question, target, constraint, role, self-verification, calibration, step and
    first-pass features, the unified scores and the answer-error policies. Null texts count as empty. Equal texts are
    worked on once. Each group is staged as a struct before the next is computed, and the groups are parted by `spread`, so
    that no text is read twice for one signal."""
    names = [unused(df.columns, n) for n in ("question_text", "output_text", "answer_text")]
    base = df.select(key, *[F.col(c).alias(n) for c, n in zip((question, output, answer), names)])
    x = once_per_text(base, names, lambda texts: _text_features(texts, *names))
    return x.select(key, *[c for c in x.columns if c not in (key, *names)])


def _text_features(base: DataFrame, q: str, t: str, a: str) -> DataFrame:
    names = (q, t, a)
    x = spread(C.with_unified_error(base, q, t, a), *names)
    x, parts = C.staged(x, "asked", T.text_parts(F.col(q)))
    constraint, role = F.col("constraint"), F.col("role")
    groups = {
        "q": F.struct(*[c.alias(k) for k, c in T.query_features(F.col(q), parts).items()]), "tq": F.struct(*[c.alias(k) for k, c in T.target_features(F.col(q), parts).items()]),
        "cons": F.struct(*[constraint[f].alias(f) for f in x.schema["constraint"].dataType.names if f.endswith("_suspected")]),
        "role_of": F.struct(role["role_warning_score"].alias("role_warning_score"), role["role_strong_error_score"].alias("role_strong_error_score"), (role["calibrated_decision"] == "strong_escalation_candidate").alias("calibrated_strong_escalation_candidate")),
        "self_of": F.col("self"), "cal": F.col("calibration"), "step_of": F.col("step"),
        "fp": F.struct(*[c.alias(k) for k, c in T.first_pass_features(F.col(t), F.col(a)).items()]),
        "unified": F.struct(F.col("unified_error_score").alias("error_score"), F.col("unified_confidence_score").alias("confidence_score")),
    }
    x = spread(C.unstaged(x.withColumns(groups), "asked").select(*names, *groups), *names)
    x = spread(answer_error_policies(x, q, t), *names)
    x = x.withColumns({
        "v6": F.struct(F.col("answer_error_score"), F.col("explanation_warning_score"), trusted(F.col("trust")).alias("final_answer_confident"), (F.col("revise_reason") != "no_escalation").alias("revise_recommended")),
        "v7": F.struct(F.col("late_error_score").alias("answer_error_score"), (F.col("late_error_score") - F.col("answer_error_score")).alias("extra_answer_error"), trusted(F.col("late_trust")).alias("final_answer_confident"), (F.col("late_revise_reason") != "no_escalation").alias("revise_recommended")),
    })
    prefixes = {"role_of": "", "self_of": "self", "step_of": "step"}
    return x.select(*names, *[c for g in (*groups, "v6", "v7") for c in flattened(x, prefixes.get(g, g), g)])
