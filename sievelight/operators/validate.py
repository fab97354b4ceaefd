"""Record, run and artefact rules as violation rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Names of splits, and the forms of detector and variant names.
SPLITS = ("train", "validation", "test")
DETECTOR, VARIANT = r"^[a-z0-9_]+\z", r"^[A-Za-z0-9_.-]+\z"


class DataIntegrityError(ValueError):
    """Data break a rule that must hold."""


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _optional(c: Column, test: Column) -> Column:
    return c.isNull() | test


def record_rules() -> dict[str, Column]:
    """Rule name to the condition a detector record must meet."""
    col = F.col
    amount = lambda c: _optional(col(c), finite(col(c)) & (col(c) >= 0))
    count = lambda c: _optional(col(c), col(c) >= 0)
    named = lambda c, form: F.coalesce(col(c).rlike(form), F.lit(False))
    return {
        "sample_id": ~is_blank(col("sample_id")),
        "split": F.coalesce(col("split").isin(*SPLITS), F.lit(False)),
        "detector": named("detector", DETECTOR),
        "variant": named("variant", VARIANT),
        "score": finite(col("score")),
        "pred_label": _optional(col("pred_label"), col("pred_label").isin(0, 1)),
        "config_hash": ~is_blank(col("config_hash")),
        "prompt_version": ~is_blank(col("prompt_version")),
        "latency_s": amount("latency_s"),
        "peak_gpu_mem_mb": amount("peak_gpu_mem_mb"),
        "n_generations": count("n_generations"),
        "n_generated_tokens": count("n_generated_tokens"),
    }


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "sample_id") -> DataFrame:
    """(key, rule) for every rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in rules.items()]))
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def record_violations(records: DataFrame) -> DataFrame:
    return violations(records, record_rules())


def run_violations(records: DataFrame, meta: DataFrame) -> DataFrame:
    """(rule, detail) rows for a run: count, unique ids, one provenance, threshold and labels that agree."""
    m = meta.first()
    one = records.agg(
        F.count("*").alias("n"),
        F.countDistinct("sample_id").alias("ids"),
        *[F.countDistinct(c).alias(f"d_{c}") for c in ("detector", "variant", "split", "config_hash", "prompt_version")],
        F.sum(F.col("pred_label").isNotNull().cast("int")).alias("preds"),
        F.sum((F.col("pred_label") != (F.col("score") >= F.lit(m["threshold"]).cast("double")).cast("int")).cast("int")).alias("wrong"),
    ).first()
    found = []
    if one.n != m["n_records"]:
        found.append(("n_records", f"{one.n} rows, {m['n_records']} announced"))
    if one.ids != one.n:
        found.append(("unique_ids", f"{one.n - one.ids} repeated"))
    found += [("homogeneous", c) for c in ("detector", "variant", "split", "config_hash", "prompt_version") if one[f"d_{c}"] > 1]
    if (m["threshold"] is None and one.preds) or (m["threshold"] is not None and one.preds != one.n):
        found.append(("threshold_and_labels", f"{one.preds} of {one.n} labelled"))
    if m["threshold"] is not None and m["threshold_source"] != "validation":
        found.append(("threshold_source", str(m["threshold_source"])))
    if one.wrong:
        found.append(("label_rule", f"{one.wrong} rows"))
    return records.sparkSession.createDataFrame(found, "rule string, detail string")


def sample_rules() -> dict[str, Column]:
    text = {c: ~is_blank(F.col(c)) for c in ("sample_id", "pair_id", "question", "knowledge", "answer")}
    return text | {
        "split": F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "label": F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "answer_length_chars": F.coalesce(F.col("answer_length_chars") == F.length("answer"), F.lit(False)),
    }


def score_rules() -> dict[str, Column]:
    return {"score": finite(F.col("score")), "pred_label": _optional(F.col("pred_label"), F.col("pred_label").isin(0, 1))}


def latency(rows: DataFrame) -> Column:
    """latency_s, or the older runtime_sec."""
    return F.coalesce(F.col("latency_s"), F.col("runtime_sec")) if "runtime_sec" in rows.columns else F.col("latency_s")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that one of two tables of the same columns holds more often than the other."""
    sides = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    return sides.groupBy(*a.columns).agg(F.sum("_side").alias("_more")).filter("_more <> 0").drop("_more")


def require_none(problems: DataFrame, what: str, show: int = 5) -> None:
    """Raise if ``problems`` has rows, naming the first few."""
    first = problems.limit(show).collect()
    if first:
        raise DataIntegrityError(f"{what}: " + "; ".join(str(tuple(r)) for r in first))


class Rule(NamedTuple):
    """What a field of a small state must hold; ``field`` is a dotted path, and what isn't there is None."""

    field: str
    holds: Callable[[object], bool]
    says: str


def field_of(state: object, field: str) -> object:
    for name in field.split("."):
        state = state.get(name) if isinstance(state, dict) else None
    return state


def broken_rules(state: dict, rules: list[Rule]) -> list[str]:
    """``field: says`` of every rule that ``state`` breaks, in the order of the rules."""
    return [f"{r.field}: {r.says}" for r in rules if not r.holds(field_of(state, r.field))]


def require_rules(state: dict, rules: list[Rule], what: str) -> None:
    """Raise, naming every broken rule."""
    if found := broken_rules(state, rules):
        raise DataIntegrityError(f"{what}: " + "; ".join(found))


def checks(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, ok, n_problems) for named problem frames."""
    out = None
    for name, problems in rows:
        row = problems.agg(F.count("*").alias("n_problems")).select(F.lit(name).alias("name"), (F.col("n_problems") == 0).alias("ok"), "n_problems")
        out = row if out is None else out.unionByName(row)
    return out


def inverted_score_warning(auroc: Column, least: float = 0.45) -> Column:
    return F.when(auroc < least, F.concat(F.lit("AUROC below "), F.lit(str(least)), F.lit(": the score may be inverted")))


def reject_counts(rows: DataFrame, columns: tuple[str, ...] = ("knowledge", "question", "right_answer", "hallucinated_answer")) -> DataFrame:
    """(n_valid, n_rejected) of raw pairs."""
    blank = F.lit(False)
    for c in columns:
        blank = blank | is_blank(F.col(c))
    return rows.agg(F.count_if(~blank).alias("n_valid"), F.count_if(blank).alias("n_rejected"))


def valid_raw(rows: DataFrame, columns: tuple[str, ...] = ("knowledge", "question", "right_answer", "hallucinated_answer")) -> DataFrame:
    """Raw pairs with all texts present and not blank."""
    test = F.lit(True)
    for c in columns:
        test = test & ~is_blank(F.col(c))
    return rows.filter(test)
