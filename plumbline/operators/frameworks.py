"""Quality frameworks (dimensions and factors), how far measures cover them, and model proposals from profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import pattern_to_regex
from plumbline.operators import metrics as M
from plumbline.operators.profile import Profile


@dataclass(frozen=True)
class Framework:
    """A named set of (dimension, factor)."""

    name: str
    factors: tuple[tuple[str, str], ...]


def quality_framework(name: str, factors: list[tuple[str, str]]) -> Framework:
    if not factors or len(set(factors)) != len(factors):
        raise ValueError("a framework has distinct factors")
    return Framework(name, tuple(factors))


def framework_agesic() -> Framework:
    """The dimensions and factors of the Uruguayan government's data quality model."""
    return quality_framework(
        "agesic",
        [
            ("accuracy", "semantic_correctness"), ("accuracy", "syntactic_correctness"), ("accuracy", "precision"), ("completeness", "coverage"), ("completeness", "density"), ("freshness", "currency"), ("freshness", "timeliness"),
            ("consistency", "domain_integrity"), ("consistency", "intra_entity_integrity"), ("consistency", "inter_entity_integrity"), ("uniqueness", "no_duplication"), ("uniqueness", "no_contradiction"),
        ],
    )


def framework_iso25012() -> Framework:
    """The fifteen characteristics of ISO/IEC 25012."""
    inherent = ("accuracy", "completeness", "consistency", "credibility", "currentness")
    both = ("accessibility", "compliance", "confidentiality", "efficiency", "precision", "traceability", "understandability")
    system = ("availability", "portability", "recoverability")
    return quality_framework("iso25012", [("inherent", x) for x in inherent] + [("inherent_and_system", x) for x in both] + [("system", x) for x in system])


def framework_cepal() -> Framework:
    """Quality principles for statistical output, by level."""
    return quality_framework(
        "cepal",
        [("output", x) for x in ("relevance", "accuracy", "reliability", "timeliness", "punctuality", "accessibility", "clarity", "coherence", "comparability", "metadata")]
        + [("process", x) for x in ("methodology", "cost_effectiveness", "procedures", "respondent_burden")]
        + [("institution", x) for x in ("legal_framework", "confidentiality", "commitment_to_quality", "resources")],
    )


def framework_catalog() -> list[dict]:
    """Which metric measures each factor, and whether it is implemented here."""
    have = {**M.CORE_METRICS, **M.REFERENCE_METRICS}
    rows = [{"dimension": m.dimension, "factor": m.factor, "metric": m.name, "granularity": m.granularity, "result_type": m.result_type, "state": "implemented"} for m in have.values()]
    measured = {(r["dimension"], r["factor"]) for r in rows}
    for ratio in ("ratio", "threshold_ratio", "mean", "weighted_mean"):
        rows += [{"dimension": d, "factor": f, "metric": f"{ratio}_of_{f}", "granularity": "table", "result_type": "real", "state": "by_aggregation"} for d, f in sorted(measured)]
    return rows


def framework_coverage(measures: DataFrame, framework: Framework) -> DataFrame:
    """Per factor of a framework the metrics and measures that there are."""
    factors = measures.sparkSession.createDataFrame(list(framework.factors), "dimension string, factor string")
    have = measures.groupBy("dimension", "factor").agg(F.countDistinct("metric").alias("m"), F.count("*").alias("n"))
    joined = F.broadcast(factors).join(have, ["dimension", "factor"], "left")
    return joined.select("dimension", "factor", F.coalesce("m", F.lit(0)).alias("n_metrics"), F.coalesce("n", F.lit(0)).alias("n_measures"), F.col("n").isNotNull().alias("measured"))


def propose_model(profile: Profile, max_domain: int = 20, max_proposals: int = 100, patterns: dict[str, list[dict]] | None = None) -> list[dict]:
    """Metrics that a profile suggests: each with what it rests on; none is used before it is confirmed."""
    out = []

    def add(metric, columns, properties, why):
        out.append({"metric": metric, "attributes": columns, "properties": properties, "reason": why, "confirmed": False})

    for r in profile.columns:
        name = r["column"]
        if r["state"] == "not_applicable":
            continue
        if r.get("missing_rate") == 0:
            add("not_null", [name], {}, "no value is missing")
        if r["declared_type"] == "text" and r.get("n_distinct") and r["n_distinct"] <= max_domain and (r.get("distinct_rate") or 1) < 0.1:
            add("allowed_values", [name], {"values": None}, f"{r['n_distinct']} distinct values")
        if r["declared_type"] in ("integer", "double") and r.get("min") is not None and r["min"] >= 0:
            add("allowed_range", [name], {"low": 0}, "no negative value")
        if r.get("distinct_rate") == 1 and not r["n_missing"]:
            add("duplicate_attribute", [name], {}, "all values are distinct")
        for p in (patterns or {}).get(name, [])[:1]:
            if p["share"] >= 0.95:
                add("format", [name], {"regex": pattern_to_regex(p["pattern"])}, f"shape of {p['share']:.0%}")
    return out[:max_proposals]


def model_from_proposal(proposal: list[dict], entity: str, key: list[str] = ()) -> M.Model:
    """A model of the confirmed proposals."""
    chosen = [p for p in proposal if p["confirmed"] and all(v is not None for v in p["properties"].values())]
    if not chosen:
        raise ValueError("no proposal is confirmed")
    return M.model(*[M.bind(M.specialize(M.CORE_METRICS[p["metric"]], **p["properties"]), entity, p["attributes"], key=key) for p in chosen])


def analyze(df: DataFrame, name: str = "table", key: list[str] | None = None, **options) -> dict:
    """Profile, distributions, variables, associations, proposal, cleaning plan, and measures of what the profile supports, in one call."""
    from plumbline.operators import aggregate as A
    from plumbline.operators import clean, findings, stats

    p = findings.profile(df, name, key=key, **options)
    proposal = [x | {"confirmed": x["metric"] in ("not_null", "allowed_range", "duplicate_attribute")} for x in propose_model(p)]
    out = {"profile": p, "top_values": stats.top_values(df), "quantiles": stats.quantiles(df), "variables": findings.classify_variables(df, p.columns), "associations": stats.detect_associations(df), "proposal": proposal, "plan": clean.plan_cleaning(p)}
    if any(x["confirmed"] for x in proposal):
        measures = M.measure(model_from_proposal(proposal, name, key or ()), {name: df})
        out |= {"measures": measures, "dashboard": A.dashboard(measures), "coverage": framework_coverage(measures, framework_agesic())}
    return out
