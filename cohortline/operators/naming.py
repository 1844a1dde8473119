"""Names of series and of their baselines, and display forms of values."""

from __future__ import annotations

from ..functions.codes import FUEL_TYPES, VEHICLE_CLASSES, VEHICLE_TYPES
from .filters import FilterSpec
from .metrics import Metric

LABELS = {
    "regions": "Region", "mrcs": "MRC", "municipalities": "Municipality", "classes": "Class", "types": "Type", "makes": "Make", "models": "Model", "colors": "Color", "model_years": "Model Year",
    "fuels": "Fuel", "axles": "Axles", "age_ranges": "Age", "licence_types": "Licence", "age_groups": "Age Group", "genders": "Gender", "experience": "Experience", "licence_classes": "Licence Class",
}
CODES = {"classes": VEHICLE_CLASSES, "types": VEHICLE_TYPES, "fuels": FUEL_TYPES}
METRICS = {"count": "Count", "sum": "Total", "average": "Average", "median": "Median", "minimum": "Minimum", "maximum": "Maximum", "coverage": "Coverage", "missing": "Missing", "wear_average": "Average Road Wear", "wear_sum": "Total Road Wear", "wear_median": "Median Road Wear"}


def shown(field: str, value: object) -> str:
    """A filter's value as text: a code's description if it is known, else the value."""
    if field == "models":
        return f"{value[1]} ({value[0]})"
    if field == "age_ranges":
        a, b = value
        return f"{a}+ years" if b is None else f"{a}-{b} years"
    return CODES.get(field, {}).get(value, str(value))


def parts(spec: FilterSpec) -> dict[str, str]:
    """What each filter takes, values sorted."""
    return {LABELS[f]: " OR ".join(sorted(shown(f, v) for v in getattr(spec, f))) for f in LABELS if getattr(spec, f)}


def series_name(spec: FilterSpec, metric: Metric = Metric()) -> str:
    filters = " AND ".join(f"[{label}: {values}]" for label, values in parts(spec).items())
    what = METRICS[metric.kind] + (f" of {metric.field}" if metric.field else "")
    return f"{what} in {filters}" if filters else what if metric.kind != "count" or metric.field else "All"


def percentage_name(spec: FilterSpec, dropped: tuple[str, ...]) -> str:
    """``% [what is counted] in [what it is counted in]``."""
    own = " AND ".join(f"[{LABELS[f]}: {' OR '.join(sorted(shown(f, v) for v in getattr(spec, f) or ()))}]" for f in dropped)
    base = series_name(spec.without(*dropped))
    return f"% {own} in {base}"


def show(value: float, unit: str = "") -> str:
    """A value for a label: thousands apart, fewer decimals for larger values, K, M and exponents for very large ones."""
    size = abs(value)
    if size >= 1e12:
        text = f"{value:.2e}"
    elif size >= 1e9:
        text = f"{value / 1e9:.2f}B"
    elif size >= 1e7:
        text = f"{value / 1e6:.1f}M"
    elif size >= 1e6:
        text = f"{value / 1e6:.2f}M"
    elif value == int(value):
        text = f"{int(value):,}"
    else:
        text = f"{value:,.{0 if size >= 1000 else 1 if size >= 100 else 2}f}"
    return f"{text} {unit}".strip()


# Names and units of measured fields, what the two families count, labels of a query's pattern, and names of
# categories in the order in which a baseline is searched for the one that it drops.
FIELDS = {"age": ("Vehicle Age", "years"), "net_mass": ("Vehicle Mass", "kg"), "displacement": ("Engine Displacement", "cm³"), "cylinder_count": ("Cylinders", None), "model_year": ("Model Year", None), "max_axles": ("Axle Count", None)}
COUNTED = {"vehicles": ("vehicles", "Vehicles"), "licences": ("license holders", "License Holders")}
PATTERN = {"vehicles": {"classes": "Classifications", "fuels": "Fuel"}, "licences": {"licence_types": "License types", "age_groups": "Age groups"}}
PLACES = {"regions": "Regions", "mrcs": "MRCs", "municipalities": "Municipalities"}
DROPPED = {
    "fuels": "fuel types", "classes": "vehicle classes", "types": "vehicle types", "regions": "regions", "makes": "makes", "models": "models", "colors": "colors", "model_years": "model years", "mrcs": "MRCs",
    "municipalities": "municipalities", "age_ranges": "age ranges", "licence_types": "license types", "age_groups": "age groups", "genders": "genders", "experience": "experience levels", "licence_classes": "license classes",
}
#: Words around the values of a dropped category, for one value and for more.
AROUND = {"regions": ("Region {}", "Regions {}"), "model_years": ("{} Model Year", "{} Model Years"), "licence_classes": ("License Class {}", "License Classes {}")}
#: Categories of which a name shows two values at most.
SHORT = ("makes", "models", "colors")


def adaptive(value: float) -> str:
    """Fewer decimals for larger values: three below 0.1, two below 1, one below 10, none from there on."""
    size = abs(value)
    return f"{value:.{3 if size < 0.1 else 2 if size < 1 else 1 if size < 10 else 0}f}"


def value_text(value: float, metric: Metric, family: str = "vehicles", normalised: bool = False) -> str:
    """A value as it is shown, by its metric: units of what is counted, tonnes, percent, K, M or an exponent for road wear."""
    whole = f"{int(value):,}"
    if normalised and 0.1 <= value <= 10:
        return f"{value:.2f}"
    if metric.kind == "count":
        return f"{whole} {COUNTED[family][0]}"
    if metric.kind == "sum" and metric.field == "net_mass":
        return f"{value / 1000:.1f} tonnes" if value > 10_000 else f"{whole} kg"
    if metric.kind in ("average", "median", "minimum", "maximum"):
        return adaptive(value) if metric.field in ("age", "displacement") else whole
    if metric.kind in ("percentage", "coverage"):
        return f"{adaptive(value)}%"
    if metric.kind == "missing":
        return f"{whole} NULL values"
    if metric.kind.startswith("wear"):
        if normalised:
            return f"{value:.2f} RWI"
        scales = ((1e12, f"{value:.2e}"), (1e6, f"{value / 1e6:.2f} M"), (1e3, f"{value / 1e3:.2f} K"))
        return next((text for least, text in scales if value > least), whole) + " RWI"
    return whole


def axis_label(metric: Metric, family: str = "vehicles", normalised: bool = False) -> str:
    """What the values of a metric are, with the unit."""
    if metric.kind.startswith("wear"):
        return f"{METRICS[metric.kind]} Index ({'Normalized' if normalised else 'Raw'})"
    if metric.kind in ("count", "percentage", "coverage", "missing"):
        return {"count": f"Number of {COUNTED[family][1]}", "percentage": "Percentage (%)", "coverage": "Coverage (%)", "missing": "NULL Count"}[metric.kind]
    name, unit = FIELDS.get(metric.field, (metric.field, None))
    return f"{METRICS[metric.kind]} {name}" + (f" ({unit})" if unit else "")


def _values(spec: FilterSpec, field: str) -> list[str]:
    return sorted(shown(field, v) for v in getattr(spec, field) or ())


def baseline_name(baseline: FilterSpec, family: str = "vehicles") -> str:
    """What a percentage is counted in: the filters that are left; of the places only the widest, fuels without a label."""
    place = next((f for f in PLACES if _values(baseline, f)), None)
    fields = ["classes", "types", "fuels", place, "makes", "models", "colors", "licence_types", "age_groups", "genders", "experience", "licence_classes"]
    said = [(f, " OR ".join(_values(baseline, f))) for f in fields if f and _values(baseline, f)]
    return " AND ".join(f"[{text}]" if f == "fuels" else f"[{LABELS[f]}: {text}]" for f, text in said) or f"All {COUNTED[family][1]}"


def dropped_category(spec: FilterSpec, baseline: FilterSpec) -> str | None:
    """The first category that a specification filters and its baseline does not."""
    return next((f for f in DROPPED if getattr(spec, f) and not getattr(baseline, f)), None)


def dropped_text(spec: FilterSpec, category: str | None) -> str | None:
    """The values of that category in words."""
    values = _values(spec, category) if category in DROPPED and category not in ("mrcs", "municipalities", "age_ranges") else []
    if not values:
        return None
    text = " & ".join(values[:2] + ["Others"] * (len(values) > 2) if category in SHORT else values)
    return AROUND.get(category, ("{}", "{}"))[len(values) > 1].format(text)


def pattern(spec: FilterSpec, family: str = "vehicles") -> str:
    """A query in one line: family, years, the widest places, and its main filters, long lists cut to two values and their number."""
    def listed(field: str, label: str) -> str:
        values = sorted(map(str, getattr(spec, field)))
        return f"{label}: {', '.join(values[:2])}" + (f"... ({len(values)} total)" if len(values) > 2 else "")

    out = [{"vehicles": "Vehicle", "licences": "License"}[family]]
    if spec.years:
        years = sorted(spec.years)
        out.append("Years: " + (", ".join(map(str, years)) if len(years) <= 3 else f"{years[0]}–{years[-1]} ({len(years)} years)"))
    place = next((f for f in PLACES if getattr(spec, f)), None)
    out += [listed(place, PLACES[place])] if place else []
    out += [listed(f, label) for f, label in PATTERN[family].items() if getattr(spec, f)]
    if family == "vehicles" and spec.age_ranges:
        out.append(f"Age ranges: {len(spec.age_ranges)}")
    return " • ".join(out)
