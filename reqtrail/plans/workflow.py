"""Stages from requirements and functions to verified pairs. A stage maps DataFrames to a DataFrame; scorer stages should be written before they are used twice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dictionary, overlap, relations, scorers


def judge_roles(requirements: DataFrame, scorer: scorers.Scorer | None = None, **options) -> DataFrame:
    """Requirements (sr, ...) with roles and the comma-joined Role."""
    out = scorers.scored(requirements, scorer or scorers.RoleRules(), ["sr", *(c for c in ("context",) if c in requirements.columns)], options.pop("concurrency", scorers.ROLE_ROWS), keep_error=False, **options)
    return out.withColumn("Role", text.list_to_cell(F.col("roles")))


def with_context(requirements: DataFrame, previous: str = "Previous Paragraph", current: str = "Current Paragraph", following: str = "Next Paragraph") -> DataFrame:
    return requirements.withColumn("context", text.context(F.col(f"`{previous}`"), F.col(f"`{current}`"), F.col(f"`{following}`")))


def extract_constraints(requirements: DataFrame, document: str, scorer: scorers.Scorer | None = None, role: str = "Role", **options) -> DataFrame:
    """Requirements of the right roles with conditions and actions, as lists and comma-joined. The filter comes before the calls."""
    kept = relations.role_filter(requirements, document, role)
    out = scorers.scored(kept, scorer or scorers.ConstraintRules(), ["sr", *(c for c in ("context",) if c in kept.columns)], options.pop("concurrency", scorers.CONSTRAINT_ROWS), keep_error=False, **options)
    # Spark's column names ignore case, so the lists have names of their own.
    out = out.withColumnsRenamed({"conditions": "condition_list", "actions": "action_list"})
    return out.withColumn("Conditions", text.list_to_cell(F.col("condition_list"))).withColumn("Actions", text.list_to_cell(F.col("action_list")))


def add_keywords(requirements: DataFrame, keywords: Mapping, column: str = "SR Text") -> DataFrame:
    for name, rule in text.keyword_columns(F.col(f"`{column}`"), keywords).items():
        requirements = requirements.withColumn(name, rule)
    return requirements


def relevant_functions(functions: DataFrame, keywords: list[str], column: str = "source_code") -> DataFrame:
    """The quick filter: functions that have a keyword of the protocol, with the keywords found."""
    return functions.withColumn("keywords", text.keywords_ci(F.col(column), keywords)).filter(F.size("keywords") > 0)


def dual_filter(functions: DataFrame, scorer: scorers.Scorer, **options) -> DataFrame:
    """Functions with keyword and subcategory lists, status and error."""
    return scorers.scored(functions, scorer, ["function_id", "function_name", "source_code"], **options)


def as_cells(results: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Lists as JSON text, for CSV."""
    for c in columns:
        if c in results.columns:
            results = results.withColumn(c, text.list_to_json(F.col(c)))
    return results


def map_code(functions: DataFrame, requirements: DataFrame, columns: Mapping[str, str], mode: str = "compat") -> DataFrame:
    return dictionary.dictionary_join(functions, requirements, columns, mode=mode)


def heuristic_candidates(functions: DataFrame, requirements: DataFrame, k: int = overlap.TOP_K) -> DataFrame:
    return overlap.candidates(functions, requirements, k).select("function_id", "function_name", "file_path", "sr_ids")


def pairs(mapped: DataFrame, functions: DataFrame, requirements: DataFrame, ids: str = "sr_ids") -> DataFrame:
    """A row for each function and requirement of its list, with both texts."""
    each = mapped.select("function_id", F.explode(ids).alias("sr_id"))
    return each.join(functions.select("function_id", "source_code"), "function_id").join(requirements.select("sr_id", "sr"), "sr_id")


def verify(pairs_: DataFrame, scorer: scorers.Scorer | None = None, dependencies: DataFrame | None = None, **options) -> DataFrame:
    """Pairs with an outcome; the final verification adds the dependencies of a function to what the scorer sees."""
    inputs = ["sr", "source_code"]
    if dependencies is not None:
        pairs_ = pairs_.join(dependencies.select("function_id", "dependencies"), "function_id", "left")
        inputs.append("dependencies")
    return scorers.scored(pairs_, scorer or scorers.OverlapVerifier(), inputs, **options)


def full_matches(projects: Mapping[str, DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """Pairs of all projects that match in full, and their number for each project; projects without a table are left out."""
    stacked = relations.outcome_filter(relations.stacked({k: v for k, v in projects.items() if v is not None}))
    return stacked, stacked.groupBy("project").agg(F.count("*").alias("matches"))
