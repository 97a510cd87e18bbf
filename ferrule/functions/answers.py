"""Answer normalisation and scores as Columns: strings or lists of spans.

A span is lowered and cut at spaces and hyphens; tokens that aren't numbers lose
ASCII punctuation; articles go; numbers, and number words, become the text of a
float. Scores compare sets of tokens, gated by shared numbers, and lists by the
assignment of spans that has the greatest sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.assignment import span_scores

#: ASCII punctuation, articles, and the numbers that words stand for.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = "a|an|the"
NUMBER_WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True)) | {
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000, "point": 0,
}
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"
MOST_SPANS = 20


def squeezed(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_number(token: Column) -> Column:
    return F.trim(token).rlike(NUMBER)


def float_text(token: Column) -> Column:
    """The text that a scripting language's float has: plain up to 1e16, with a fraction always, exponents of two digits."""
    t = F.trim(token)
    infinite = F.regexp_extract(t, r"^([+-]?)(inf|infinity|nan)$", 2)
    sign = F.when(t.startswith("-"), "-").otherwise("")
    x = F.regexp_replace(t, "_", "").try_cast("double")
    size, text = F.abs(x), x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    short = F.concat(F.regexp_replace(F.regexp_extract(text, "^([^E]*)E", 1), r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(infinite == "nan", "nan").when(infinite != "", F.concat(sign, F.lit("inf"))).when((size == float("inf")), F.concat(sign, F.lit("inf")))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)
    )


def normalized(span: Column) -> Column:
    """One span's normal form."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], f"{float(pair[1])}")])
    marks = F.lit(PUNCTUATION)
    tokens = F.filter(F.split(F.lower(F.coalesce(span.cast("string"), F.lit(""))), "[ -]"), lambda t: t != "")
    tokens = F.transform(tokens, lambda t: F.when(is_number(t), t).otherwise(F.call_function("translate", t, marks, F.lit(""))))
    tokens = F.transform(tokens, lambda t: squeezed(F.regexp_replace(t, rf"(?U)\b(?:{ARTICLES})\b", " ")))
    tokens = F.transform(tokens, lambda t: F.when(is_number(t), float_text(t)).otherwise(F.coalesce(F.try_element_at(words, t), t)))
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def bag(span: Column) -> Column:
    """The set of tokens of a normal form."""
    return F.array_distinct(F.filter(F.split(span, " "), lambda t: t != ""))


def numbers_match(predicted: Column, gold: Column) -> Column:
    """Whether the gold bag has no numbers, or shares one with the prediction."""
    numbers = lambda a: F.filter(a, is_number)
    return (F.size(numbers(gold)) == 0) | F.arrays_overlap(numbers(gold), numbers(predicted))


def bag_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two bags; an empty prediction has precision 1, an empty gold recall 1."""
    both = F.size(F.array_intersect(predicted, gold)).cast("double")
    precision = F.when(F.size(predicted) == 0, 1.0).otherwise(F.try_divide(both, F.size(predicted)))
    recall = F.when(F.size(gold) == 0, 1.0).otherwise(F.try_divide(both, F.size(gold)))
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def _gated(predicted: Column, gold: Column) -> Column:
    return F.when(numbers_match(predicted, gold), bag_f1(predicted, gold)).otherwise(0.0)


def list_scores(predicted: Column, gold: Column) -> Column:
    """(em, f1) of two lists of spans.

    em is 1 if both have the same set of normal forms and the same length. f1 is
    the best assignment's sum by the longer list's length, to two places, 0 if
    both are empty; more than MOST_SPANS predicted spans are an error.
    """
    s = span_scores(F.transform(predicted, normalized), F.transform(gold, normalized), NUMBER)
    longest = F.greatest(F.size(predicted), F.size(gold), F.lit(1))
    total = F.when(F.size(predicted) > MOST_SPANS, F.raise_error(F.lit("too many predicted spans")).cast("double")).otherwise(s["total"])
    return F.struct(s["em"].alias("em"), F.bround(total / longest, 2).alias("f1"))


def list_em(predicted: Column, gold: Column) -> Column:
    return list_scores(predicted, gold)["em"]


def list_f1(predicted: Column, gold: Column) -> Column:
    return list_scores(predicted, gold)["f1"]


def text_em(predicted: Column, gold: Column) -> Column:
    """``list_em`` of two single spans."""
    return (normalized(predicted) == normalized(gold)).cast("double")


def text_f1(predicted: Column, gold: Column) -> Column:
    """``list_f1`` of two single spans."""
    return F.bround(_gated(bag(normalized(predicted)), bag(normalized(gold))), 2)


def text_scores(predicted: Column, gold: Column) -> Column:
    """(em, f1) as ``text_em`` and ``text_f1`` have them; each normal form and each bag is made once."""
    forms = F.array(F.struct(normalized(predicted).alias("p"), normalized(gold).alias("g")))
    bags = F.transform(forms, lambda s: F.struct((s["p"] == s["g"]).cast("double").alias("em"), bag(s["p"]).alias("p"), bag(s["g"]).alias("g")))
    return F.transform(bags, lambda s: F.struct(s["em"].alias("em"), F.bround(_gated(s["p"], s["g"]), 2).alias("f1")))[0]


def prediction_spans(prediction: Column) -> Column:
    """A JSON list of scalars as its spans, anything else as one span."""
    text = F.trim(prediction)
    items = F.from_json(F.when(text.startswith("[") & text.endswith("]"), text), "array<string>")
    nested = F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.startswith("{") | x.startswith("["))
    return F.when(items.isNull() | nested, F.array(F.coalesce(prediction, F.lit("")))).otherwise(items)


def complete_correct(prediction: Column, alternatives: Column) -> Column:
    """Whether the prediction (a JSON list, or one answer) equals any alternative as a multiset of lowered, squeezed items."""
    items = lambda a: F.array_sort(F.transform(a, lambda x: squeezed(F.lower(x))))
    mine = items(prediction_spans(prediction))
    return F.exists(alternatives, lambda a: items(a) == mine)
