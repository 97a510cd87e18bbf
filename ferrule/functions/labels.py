"""Labels, predicates and rule lists as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Question types that take several hops.
MULTI_HOP = (
    "Compare(Compose(TableQ,ImageQ),Compose(TableQ,TextQ))", "Compare(Compose(TableQ,ImageQ),TableQ)", "Compare(TableQ,Compose(TableQ,TextQ))",
    "Compose(ImageQ,TableQ)", "Compose(ImageQ,TextQ)", "Compose(TableQ,ImageListQ)", "Compose(TableQ,TextQ)", "Compose(TextQ,ImageListQ)",
    "Compose(TextQ,TableQ)", "Intersect(ImageListQ,TableQ)", "Intersect(ImageListQ,TextQ)", "Intersect(TableQ,TextQ)",
)
SINGLE_HOP = ("TextQ", "TableQ", "ImageQ", "ImageListQ")


def hop(question_type: Column) -> Column:
    return F.when(question_type.isin(*MULTI_HOP), "multi-hop").otherwise("single-hop")


def is_single_hop(question_type: Column, supports: Column) -> Column:
    """One of the plain types; a text question needs exactly one support."""
    return question_type.isin(*SINGLE_HOP) & ((question_type != "TextQ") | (F.size(supports) == 1))


def group_label(metadata: Column, key: str, column: Column, default: str) -> Column:
    """The label in the metadata, else that of the row, else the default."""
    return F.coalesce(metadata[key].cast("string"), column.cast("string"), F.lit(default))


def modality(modalities: Column) -> Column:
    """The one modality of the answers; "unknown" without any, an error with several."""
    found = F.array_distinct(F.array_compact(modalities))
    several = F.raise_error(F.concat(F.lit("several modalities: "), F.array_join(found, ", "))).cast("string")
    return F.when(F.size(found) > 1, several).otherwise(F.coalesce(F.get(found, 0), F.lit("unknown")))


def scalar_text(value: Column) -> Column:
    """A JSON scalar as a scripting language spells it: True, False and None; strings as they are."""
    return F.when(value == "true", "True").when(value == "false", "False").when(value.isNull() | (value == "null"), "None").otherwise(value)


def admissible(value: Column, reference: Column, tolerance: float) -> Column:
    return value >= reference - tolerance


def near_budget(cost: Column, budget: Column, share: float = 0.05) -> Column:
    return F.abs(cost - budget) <= share * budget


def interval_label(low_90: Column, high_90: Column, low_95: Column, high_95: Column, margin: float = 1.0) -> Column:
    """superior, inferior, equivalent or unresolved, in that precedence."""
    return F.when(low_95 > 0, "superior").when(high_95 < 0, "inferior").when((low_90 >= -margin) & (high_90 <= margin), "equivalent").otherwise("unresolved")


def hardware_class(name: Column, classes: dict[str, str]) -> Column:
    """The label of the first class whose mark the upper-cased name holds, else "other"."""
    out = None
    for mark, label in classes.items():
        out = (F if out is None else out).when(F.upper(name).contains(mark), label)
    return out.otherwise("other")


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold (null counts as not), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))


def verdict(text: Column, truncated: Column) -> Column:
    """correct, incorrect or uncertain from a judge's JSON {"verdict": ...}; a cut-off or malformed one is uncertain."""
    said = F.lower(F.get_json_object(text, "$.verdict"))
    return F.when(truncated | said.isNull() | ~said.isin("correct", "incorrect"), "uncertain").otherwise(said)


def gate_outcome(fit_ok: Column, held_ok: Column, drop_ok: Column) -> Column:
    """Five outcomes of two gates in precedence: unmeasured, unfit, unreliable, unstable, reliable."""
    unmeasured = fit_ok.isNull() | held_ok.isNull() | drop_ok.isNull()
    return F.when(unmeasured, "unmeasured").when(~fit_ok, "unfit").when(~held_ok, "unreliable").when(~drop_ok, "unstable").otherwise("reliable")
