"""Labels, recodes and the linear policy rule (PR9–PR12, PR17, PR18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Policy-rule constant and weights, inflation target of the views.
RULE_CONSTANT = 2.0
RULE_WEIGHT_INFLATION = 0.5
RULE_WEIGHT_GAP = 0.5
TARGET = 5.0

# Period cuts of the views and their labels, in order.
PERIOD_CUTS = ("1996-01-01", "1998-01-01", "2000-01-01")
PERIOD_LABELS = ("before 1996", "1996-1997", "1998-1999", "since 2000")

# Display names of the panel's columns: mean price in thousands, mean discount in
# percentage points from 5, mean quantity from 25.5.
VARIABLE_LABELS = {
    "(Intercept)": "intercept",
    "x1": "discount, centred",
    "x2": "quantity, centred",
    "y": "price (thousands)",
    "y_l1": "price one month before",
}


def inflation(deviation: Column, target: float = TARGET) -> Column:
    """PR9: level from deviation and a constant target."""
    return deviation + F.lit(target)


def rule_score(infl: Column, deviation: Column, gap: Column) -> Column:
    """PR10: c + π + a(π − π*) + b·gap."""
    return (F.lit(RULE_CONSTANT) + infl + F.lit(RULE_WEIGHT_INFLATION) * deviation
            + F.lit(RULE_WEIGHT_GAP) * gap)


def period_label(d: Column, cuts: Sequence[str] = PERIOD_CUTS,
                 labels: Sequence[str] = PERIOD_LABELS) -> Column:
    """PR11: first matching branch; a NULL date gives a NULL label (no default)."""
    c = [F.to_date(F.lit(x)) for x in cuts]
    e = F.when(d < c[0], F.lit(labels[0]))
    for i in range(1, len(c)):
        e = e.when((d >= c[i - 1]) & (d < c[i]), F.lit(labels[i]))
    return e.when(d >= c[-1], F.lit(labels[-1]))


def label_order(label: Column, labels: Sequence[str] = PERIOD_LABELS) -> Column:
    """SO2: integer order of a label in a given list (NULL if absent)."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), label).cast("int")


def recode(c: Column, mapping: Mapping[str, str] = VARIABLE_LABELS) -> Column:
    """PR12: dictionary recode, unmatched values kept."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(m, c), c)


def significance_label(p: Column, level: float = 0.05) -> Column:
    """PR18: 'significant' when p <= level."""
    return F.when(p <= level, F.lit("significant")).when(p > level, F.lit("not significant"))


def effect_label(estimate: Column, p: Column, level: float = 0.05) -> Column:
    """PR18: sign and significance wording of an effect."""
    sign = F.when(estimate > 0, F.lit("positive")).when(estimate < 0, F.lit("negative")).otherwise(F.lit("zero"))
    return F.concat_ws(" ", sign, F.lit("and"), significance_label(p, level))

